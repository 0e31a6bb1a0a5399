"""Evaluation over prediction tables.

Classification metrics come from one ``groupBy(true, pred)`` (partial
aggregation; at most labels^2 rows leave it).  Regression metrics are one
aggregate.  Generation metrics tokenise JVM-side and count clipped n-gram
matches inside each pair (its two token lists are one row), vectorised per
Arrow batch with numpy - no n-gram rows are materialised or shuffled;
``gram_counts`` keeps the all-Spark explode / aggregate formulation.
ROUGE-L needs an LCS: a vectorised pandas UDF using the bit-parallel LCS
length (Python big integers, O(m * n / 64) word operations per pair).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.numeric import fround

from tessera.functions import text as textfn

# Fixed value: automatic task choice - at most 50 distinct truths is classification.
AUTO_CLASSIFICATION_MAX_LABELS = 50
MAX_LABELS = 10_000  # the label grid is labels^2 cells; its list is one value


# --------------------------------------------------------------------------- classification


def pair_counts(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    return df.groupBy(F.col(y_true).cast("string").alias("t"), F.col(y_pred).cast("string").alias("p")) \
        .agg(F.count(F.lit(1)).alias("n"))


def label_set(df: DataFrame, y_true: str, y_pred: str, labels=None) -> DataFrame:
    if labels is not None:
        rows = [(str(x), i) for i, x in enumerate(labels)]
        return df.sparkSession.createDataFrame(rows, "label string, label_idx int")
    both = df.select(F.col(y_true).cast("string").alias("label")).union(
        df.select(F.col(y_pred).cast("string").alias("label"))).where(F.col("label").isNotNull()).distinct()
    return both


def confusion_matrix(df: DataFrame, y_true: str, y_pred: str, labels=None, zeros: bool = True) -> DataFrame:
    """true_label, pred_label, count for every label pair (zeros included).
    The label grid is an ``explode`` of the (bounded) label list, not a
    cross join; ``zeros=False`` leaves it out and gives the pairs that occur,
    for any number of labels."""
    pc = pair_counts(df, y_true, y_pred)
    if not zeros:
        return pc.where("t is not null and p is not null").select(
            F.col("t").alias("true_label"), F.col("p").alias("pred_label"), F.col("n").cast("bigint").alias("count"))
    lab = label_set(df, y_true, y_pred, labels).select("label")
    n_labels = lab.limit(MAX_LABELS + 1).count()
    if n_labels > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} distinct labels: pass zeros=False")
    all_labels = lab.agg(F.sort_array(F.collect_list("label")).alias("ls")).select("ls").scalar()
    grid = lab.select(F.col("label").alias("true_label"), F.explode(all_labels).alias("pred_label"))
    return (grid.join(pc, (grid.true_label == pc.t) & (grid.pred_label == pc.p), "left")
            .select("true_label", "pred_label", F.coalesce(pc.n, F.lit(0)).cast("bigint").alias("count")))


def accuracy(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    hit = F.col(y_true).cast("string") == F.col(y_pred).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(hit, F.lit(False))).alias("c")).select(
        fround(F.col("c") / F.col("n"), 4).alias("accuracy"),
        F.col("c").cast("bigint").alias("correct"),
        F.col("n").cast("bigint").alias("total_samples"))


def per_class_metrics(df: DataFrame, y_true: str, y_pred: str, labels=None) -> DataFrame:
    """label, precision, recall, f1 (4 dp, 0 when undefined), support."""
    pc = pair_counts(df, y_true, y_pred)
    sums = pc.select(
        F.explode(F.array(
            F.struct(F.col("t").alias("label"), F.col("n").alias("true_n"), F.lit(0).cast("bigint").alias("pred_n"),
                     F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")),
            F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("true_n"), F.col("n").alias("pred_n"),
                     F.lit(0).cast("bigint").alias("tp")))).alias("s")).select("s.*")
    agg = sums.groupBy("label").agg(F.sum("true_n").alias("support"), F.sum("pred_n").alias("pred_n"),
                                    F.sum("tp").alias("tp"))
    if labels is None:
        m = agg.where(F.col("label").isNotNull())  # every label is in the pair counts: one scan
    else:
        lab = label_set(df, y_true, y_pred, labels).select("label")
        m = lab.join(agg, "label", "left").na.fill(0, ["support", "pred_n", "tp"])
    prec = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    m = m.select("label", "support", prec.alias("p"), rec.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(F.lit(0.0))
    return m.select("label", fround("p", 4).alias("precision"), fround("r", 4).alias("recall"),
                    fround(f1, 4).alias("f1"), F.col("support").cast("bigint").alias("support"))


def macro_metrics(df: DataFrame, y_true: str, y_pred: str, labels=None) -> DataFrame:
    """Macro P/R/F1 and weighted F1 from the already rounded per-class values."""
    pcm = per_class_metrics(df, y_true, y_pred, labels)
    agg = pcm.agg(F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"), F.sum("support").alias("ts"))
    return agg.select(fround("mp", 4).alias("macro_precision"), fround("mr", 4).alias("macro_recall"),
                      fround("mf", 4).alias("macro_f1"),
                      fround(F.col("wf") / F.greatest(F.col("ts"), F.lit(1)), 4).alias("weighted_f1"))


# --------------------------------------------------------------------------- regression


def regression_metrics(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    t, p = F.col(y_true).cast("double"), F.col(y_pred).cast("double")
    e = t - p
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"),
                 F.var_pop(t).alias("vt"),
                 F.sum(F.abs(e) / F.greatest(F.abs(t), F.lit(1e-8))).alias("ape"),
                 F.min(e).alias("emin"), F.max(e).alias("emax"), F.avg(e).alias("emean"))
    sst = F.col("vt") * F.col("n")
    mse = F.col("sse") / F.col("n")
    return agg.select(
        fround(mse, 6).alias("mse"), fround(F.sqrt(mse), 6).alias("rmse"),
        fround(F.col("sae") / F.col("n"), 6).alias("mae"),
        fround(F.when(sst > 0, 1 - F.col("sse") / sst).otherwise(F.lit(0.0)), 6).alias("r2"),
        fround(F.col("ape") / F.col("n") * 100, 2).alias("mape"),
        F.col("n").cast("bigint").alias("total_samples"),
        fround("emin", 4).alias("residual_min"), fround("emax", 4).alias("residual_max"),
        fround("emean", 4).alias("residual_mean"))


# --------------------------------------------------------------------------- generation


def tokens(c: Column) -> Column:
    return textfn.words(F.lower(c))


def token_hashes(toks: Column) -> Column:
    return F.transform(toks, lambda t: F.xxhash64(t))


def ngram_hashes(hashes: Column, n: int) -> Column:
    """n-grams as 64-bit hashes combined from the (already materialised)
    per-token hashes: counts are only compared inside one pair, where a
    collision among its few thousand n-grams is negligible, and the shuffle
    key is 8 bytes."""
    k = F.size(hashes) - n + 1
    return F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1),
                                     lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]))) \
        .otherwise(F.array().cast("array<bigint>"))


def _tokenised_pairs(df: DataFrame, ref: str, pred: str, pair_id: str) -> DataFrame:
    return df.select(F.col(pair_id).alias("pair_id"), tokens(F.col(ref)).alias("rt"), tokens(F.col(pred)).alias("pt"))


def gram_counts(pairs: DataFrame, orders=(1, 2, 3, 4)) -> DataFrame:
    """pair_id, n, g (hash), rc, pc: per-pair n-gram counts on both sides."""
    def tag(n: int, r: int):
        # one-argument lambda: F.transform treats a second parameter as the index
        return lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(r).alias("r"), F.lit(1 - r).alias("p"))

    # token hashes are materialised as columns first, so the n-gram lambdas
    # read them instead of re-hashing strings per n-gram
    hashed = pairs.select("pair_id", token_hashes(F.col("rt")).alias("rh"), token_hashes(F.col("pt")).alias("ph"))
    items = []
    for n in orders:
        items.append(F.transform(ngram_hashes(F.col("rh"), n), tag(n, 1)))
        items.append(F.transform(ngram_hashes(F.col("ph"), n), tag(n, 0)))
    grams = hashed.select("pair_id", F.inline(F.concat(*items)))
    return grams.groupBy("pair_id", "n", "g").agg(F.sum("r").alias("rc"), F.sum("p").alias("pc"))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _ngram_keys(ids: np.ndarray, offsets: np.ndarray, n: int):
    """(pair index, uint64 key) of every n-gram that stays inside its pair."""
    lens = np.diff(offsets)
    pidx = np.repeat(np.arange(len(lens)), lens)
    if len(ids) == 0:
        return pidx[:0], np.zeros(0, np.uint64)
    starts = np.arange(len(ids))
    valid = starts + n - 1 < offsets[1:][pidx]
    key = np.zeros(len(ids), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            nxt = ids[np.minimum(starts + j, len(ids) - 1)].astype(np.uint64) + np.uint64(1)
            key = key * _MIX + nxt
    return pidx[valid], key[valid]


def _counted(pidx: np.ndarray, key: np.ndarray):
    order = np.lexsort((key, pidx))
    p, k = pidx[order], key[order]
    if len(p) == 0:
        return p, k, np.zeros(0, np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (k[1:] != k[:-1])
    idx = np.flatnonzero(new)
    counts = np.diff(np.append(idx, len(p)))
    return p[idx], k[idx], counts


def _clipped(ids_r, off_r, ids_p, off_p, n: int, n_pairs: int) -> np.ndarray:
    pr_, kr, cr = _counted(*_ngram_keys(ids_r, off_r, n))
    pp, kp, cp = _counted(*_ngram_keys(ids_p, off_p, n))
    p = np.concatenate([pr_, pp])
    k = np.concatenate([kr, kp])
    c = np.concatenate([cr, cp])
    order = np.lexsort((k, p))
    p, k, c = p[order], k[order], c[order]
    same = (p[1:] == p[:-1]) & (k[1:] == k[:-1])
    out = np.zeros(n_pairs, np.int64)
    if same.any():
        i = np.flatnonzero(same)
        np.add.at(out, p[i], np.minimum(c[i], c[i + 1]))
    return out


def pair_overlaps(pairs: DataFrame, orders=(1, 2, 3, 4)) -> DataFrame:
    """pair_id, lr, lp, m1..m4: clipped n-gram matches counted inside each
    pair (the pair's two token lists are already in one row), vectorised
    over each Arrow batch with numpy: no n-gram rows and no shuffle.
    Input: pair_id, rt, pt (token arrays, tokenised JVM-side)."""
    schema = T.StructType([T.StructField("pair_id", T.LongType()), T.StructField("lr", T.LongType()),
                           T.StructField("lp", T.LongType())] +
                          [T.StructField(f"m{n}", T.LongType()) for n in (1, 2, 3, 4)])
    want = tuple(orders)

    def per_batch(batches):
        for rb in batches:
            rt, pt = rb.column(1), rb.column(2)
            n_pairs = rb.num_rows
            off_r = np.asarray(rt.offsets.to_numpy(), np.int64) - rt.offsets[0].as_py()
            off_p = np.asarray(pt.offsets.to_numpy(), np.int64) - pt.offsets[0].as_py()
            flat_r, flat_p = rt.flatten(), pt.flatten()
            inv = pa.chunked_array([flat_r, flat_p]).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
            ids_r, ids_p = inv[:len(flat_r)], inv[len(flat_r):]
            cols = [rb.column(0).cast(pa.int64()), pa.array(np.diff(off_r), pa.int64()),
                    pa.array(np.diff(off_p), pa.int64())]
            for n in (1, 2, 3, 4):
                m = _clipped(ids_r, off_r, ids_p, off_p, n, n_pairs) if n in want else np.zeros(n_pairs, np.int64)
                cols.append(pa.array(m, pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])
    return pairs.select("pair_id", "rt", "pt").mapInArrow(per_batch, schema)


def generation_pair_scores(df: DataFrame, ref: str, pred: str, pair_id: str, orders=(1, 2, 3, 4)) -> DataFrame:
    """Per pair: bleu_1..4 precisions, rouge_1 / rouge_2 F1, exact flag
    (only the n-gram orders asked for are exploded)."""
    pairs = df.select(F.col(pair_id).cast("long").alias("pair_id"), tokens(F.col(ref)).alias("rt"),
                      tokens(F.col(pred)).alias("pt"))
    base = pair_overlaps(pairs, orders)
    cols = [F.col("pair_id")]
    for n in (1, 2, 3, 4):
        tot = F.col("lp") - n + 1
        cols.append(F.when(tot > 0, F.col(f"m{n}") / tot).otherwise(F.lit(0.0)).alias(f"bleu_{n}"))

    def f1(m, lp, lr):
        pp = m / F.greatest(lp, F.lit(1))
        rr = m / F.greatest(lr, F.lit(1))
        return 2 * pp * rr / F.greatest(pp + rr, F.lit(1e-8))
    cols.append(f1(F.col("m1"), F.col("lp"), F.col("lr")).alias("rouge_1"))
    cols.append(f1(F.col("m2"), F.greatest(F.col("lp") - 1, F.lit(0)), F.greatest(F.col("lr") - 1, F.lit(0))).alias("rouge_2"))
    return base.select(*cols)


def exact_match(df: DataFrame, ref: str, pred: str) -> DataFrame:
    hit = textfn.strip(F.col(ref)) == textfn.strip(F.col(pred))
    return df.agg(fround(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), 4).alias("exact_match"),
                  F.count(F.lit(1)).cast("bigint").alias("total_samples"))


def bleu_n(df: DataFrame, ref: str, pred: str, pair_id: str) -> DataFrame:
    s = generation_pair_scores(df, ref, pred, pair_id)
    return s.agg(*[fround(F.avg(f"bleu_{n}"), 4).alias(f"bleu_{n}") for n in (1, 2, 3, 4)])


def rouge_12(df: DataFrame, ref: str, pred: str, pair_id: str) -> DataFrame:
    s = generation_pair_scores(df, ref, pred, pair_id, orders=(1, 2))
    return s.agg(fround(F.avg("rouge_1"), 4).alias("rouge_1"), fround(F.avg("rouge_2"), 4).alias("rouge_2"))


def lcs_length_of(a: list, b: list) -> int:
    """LCS length of two token lists, bit-parallel: bit i of ``row`` is clear
    where the dynamic-programming row rises at token i of ``a``; one token of
    ``b`` updates all of it by an addition, so that a step over a hundred
    thousand tokens is a few machine words' work per 64 of them."""
    if len(a) < len(b):
        a, b = b, a  # fewer steps over a longer row
    where: dict = {}
    for i, token in enumerate(a):
        where.setdefault(token, []).append(i)

    def mask(places: list) -> int:
        out = bytearray((len(a) >> 3) + 1)
        for i in places:
            out[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(out, "little")
    # only masks of frequent tokens are kept: few, so that their size stays near that of the texts
    kept = {token: mask(where[token]) for token in set(b) & where.keys() if len(where[token]) > 64 or len(a) <= 4096}
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        if token in where:
            matched = row & (kept[token] if token in kept else mask(where[token]))
            row = ((row + matched) | (row - matched)) & full
    return len(a) - row.bit_count()


def lcs_lengths(a: list, b: list) -> np.ndarray:
    """LCS length of each pair of id arrays."""
    return np.array([lcs_length_of(list(x), list(y)) for x, y in zip(a, b)], np.int64)


def _lcs_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    """LCS length of two token lists per row (null: empty)."""
    return pa.array([lcs_length_of(x or [], y or []) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64())


def lcs_length(a: Column, b: Column) -> Column:
    @F.arrow_udf(T.LongType())
    def lengths(x: pa.Array, y: pa.Array) -> pa.Array:
        return _lcs_batch(x, y)
    return lengths(a, b)


def rouge_l(df: DataFrame, ref: str, pred: str) -> DataFrame:
    rt, pt = tokens(F.col(ref)), tokens(F.col(pred))
    lcs = lcs_length(rt, pt)
    pp = lcs / F.greatest(F.size(pt), F.lit(1))
    rr = lcs / F.greatest(F.size(rt), F.lit(1))
    f = 2 * pp * rr / F.greatest(pp + rr, F.lit(1e-8))
    return df.select(f.alias("f")).agg(fround(F.avg("f"), 4).alias("rouge_l"))


# --------------------------------------------------------------------------- auto / QA


def auto_eval(df: DataFrame, y_true: str, y_pred: str, max_labels: int = AUTO_CLASSIFICATION_MAX_LABELS) -> DataFrame:
    """task, metric, value: classification when y_true has <= max_labels
    distinct values, else regression (one small action decides)."""
    # only "more than max_labels?" matters: stop at max_labels + 1 values
    n_distinct = df.select(y_true).where(F.col(y_true).isNotNull()).distinct().limit(max_labels + 1).count()
    if n_distinct <= max_labels:
        acc = accuracy(df, y_true, y_pred).select("accuracy")
        mm = macro_metrics(df, y_true, y_pred)
        wide = _one_row_concat(acc, mm)
        task = "classification"
    else:
        wide = regression_metrics(df, y_true, y_pred).drop("total_samples")
        task = "regression"
    cols = wide.columns
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return wide.selectExpr(f"'{task}' AS task", f"stack({len(cols)}, {stack}) AS (metric, value)")


def _one_row_concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Side-by-side of two one-row aggregates via scalar subqueries."""
    rb = b.first()  # one-row aggregate: its values become literals
    return a.select(*[F.col(c) for c in a.columns], *[F.lit(rb[c]).alias(c) for c in b.columns])


def qa_scores(df: DataFrame, category: str, generated: str, expected: str, latency: str | None = None) -> DataFrame:
    """Per category: correct, total, score (4 dp), avg latency (2 dp); plus
    an ``__overall__`` row."""
    hit = textfn.answer_matches(F.col(generated), F.col(expected))
    base = df.select(F.col(category).cast("string").alias("category"), hit.alias("ok"),
                     (F.col(latency).cast("double") if latency else F.lit(None).cast("double")).alias("lat"))
    both = base.rollup("category").agg(F.count_if("ok").alias("correct"), F.count(F.lit(1)).alias("total"), F.avg("lat").alias("lat"),
                                       F.grouping("category").alias("__all"))  # one scan
    both = both.withColumn("category", F.when(F.col("__all") == 1, F.lit("__overall__")).otherwise(F.col("category")))
    return both.select(
        "category", F.col("correct").cast("bigint").alias("correct"), F.col("total").cast("bigint").alias("total"),
        fround(F.col("correct") / F.col("total"), 4).alias("score"), fround("lat", 2).alias("avg_latency"))
