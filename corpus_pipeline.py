"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination,
mixing, sharding.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
next one's docs.  All but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, mixing, queries, sharding, simhash, toxicity
from tessera.llm.common import materialise, ship_package, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; fitted on the labels outside the held-out quarter."""
    ship_package(spark)
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.sample_labelled(docs, labels.filter(~queries.held_out(labels["doc_id"]))))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: 4-word shingles, 4 bits."""
    ship_package(spark)
    return simhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a 10-word window of a benchmark item go."""
    ship_package(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1 over the sources, 150 % of all words, at most two passes."""
    ship_package(spark)
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """16 shards with equal counts, in a global random order."""
    ship_package(spark)
    return sharding.external_shuffle(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark),
          ("mixing", mix_sources), ("sharding", shard)]

#: Learned scores, SimHash and a seeded Fisher-Yates shuffle have no SQL form;
#: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
