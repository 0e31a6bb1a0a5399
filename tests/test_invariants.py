"""Invariants over the driver tables: splits disjoint and
complete, chunks re-cover every word, packed windows x L = trimmed tokens,
confusion-matrix sum = n, histogram sum = non-null count, exact sample size,
idempotent dedup."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as textfn
from tessera.operators import evaluate as ev
from tessera.operators import prep
from tessera.operators import profile as pr
from tessera.operators import tokens as tk
from tessera.operators import transforms as tf
from tessera.sources.files import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_random_split_disjoint_and_complete(spark):
    docs = table(spark, SF, "documents").select("doc_id")
    s = prep.random_split(docs, "doc_id", 0.8, 3)
    assert s.count() == docs.count()
    assert s.groupBy("doc_id").count().where("count > 1").count() == 0
    share = s.where("split = 'train'").count() / s.count()
    assert 0.6 < share < 0.95


def test_chunks_recover_all_words(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    L, ov = 50, 10
    chunks = tf.text_split(docs, "text", L, ov)
    # the first (L - ov) words of each chunk, plus the whole last chunk, rebuild the document
    n_words = docs.select(F.sum(F.size(textfn.words(F.col("text"))))).first()[0]
    c = chunks.withColumn("n", F.size(textfn.words(F.col("text"))))
    last = c.groupBy("doc_id").agg(F.max("_chunk_idx").alias("last"))
    j = c.join(last, "doc_id")
    rebuilt = j.select(F.when(F.col("_chunk_idx") == F.col("last"), F.col("n"))
                       .otherwise(F.least(F.col("n"), F.lit(L - ov))).alias("k")).agg(F.sum("k")).first()[0]
    assert rebuilt == n_words


def test_packed_windows_cover_trimmed_tokens(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    L = 64
    total = docs.select(F.sum(F.length("text"))).first()[0]
    packed = tk.pack_sequences(docs, L, n_tokens=F.length("text"), encode_fn=tk.char_encoder(tk.char_vocab(docs)))
    n = packed.count()
    assert n == (total - 1) // L
    assert packed.where(F.size("input_ids") != L).count() == 0
    assert packed.where("split = 'validation'").count() == max(1, n // 10)


def test_confusion_sum_and_histogram_sum(spark):
    lab = table(spark, SF, "labels")
    assert ev.confusion_matrix(lab, "quality", "toxic").agg(F.sum("count")).first()[0] == lab.count()
    ev_t = table(spark, SF, "events")
    h = pr.histogram(ev_t, "value").agg(F.sum("count")).first()[0]
    assert h == ev_t.where(F.col("value").isNotNull()).count()


def test_sample_size_and_dedup_idempotent(spark):
    docs = table(spark, SF, "documents")
    assert tf.sample(docs.select("doc_id"), 37, 5, "doc_id").count() == 37
    ev_t = table(spark, SF, "events").select("user_id", "event_type", "event_id", "ts")
    once = tf.deduplicate(ev_t, "user_id,event_type", "ts,event_id")
    twice = tf.deduplicate(once, "user_id,event_type", "ts,event_id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
