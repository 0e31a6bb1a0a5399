"""Vector operators: brute-force cosine top-k and per-vector statistics.

Top-k: blocks of queries are broadcast to the tasks; every corpus partition
scores them with matrix products in numpy and keeps only its own top ``k``
per query, so at most ``k * queries`` rows per task reach the final exchange.  No cross join and
no per-pair rows are materialised.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.numeric import fround

#: Queries in one broadcast; more are dealt into blocks of about this many.
QUERY_BLOCK = 10_000
SCORE_CELLS = 4_000_000  # scores a task holds at a time


def _best(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best (query, row, score) per query; ties by the row's id."""
    order = np.lexsort((rows, -scores, ids))
    ids, rows, scores = ids[order], rows[order], scores[order]
    first = np.searchsorted(ids, ids, side="left")
    keep = np.arange(len(ids)) - first < k
    return ids[keep], rows[keep], scores[keep]


def cosine_topk(corpus: DataFrame, queries: DataFrame, k: int = 5, corpus_id: str = "vec_id",
                corpus_vec: str = "embedding", query_id: str = "query_id", query_vec: str = "embedding",
                block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, score (cosine), rank (1..k; score desc, id asc).

    The queries are broadcast; beyond ``block`` they are dealt into blocks by
    a hash, one scan of the corpus each.  A task scores by matrix products of
    bounded size and ships at most ``k`` rows per query."""
    n_blocks = max(1, -(-queries.count() // block))
    part = F.pmod(F.xxhash64(query_id), F.lit(n_blocks))
    out = None
    for b in range(n_blocks):
        some = _topk_block(corpus, queries.where(part == b) if n_blocks > 1 else queries, int(k), corpus_id, corpus_vec,
                           query_id, query_vec)
        out = some if out is None else out.unionByName(some)
    return out


def _topk_block(corpus: DataFrame, queries: DataFrame, k: int, corpus_id: str, corpus_vec: str, query_id: str,
                query_vec: str) -> DataFrame:
    rows = queries.select(query_id, query_vec).collect()  # one block
    q_ids = np.array([r[0] for r in rows], dtype=np.int64)
    q = np.array([np.asarray(r[1], dtype=np.float64) for r in rows], dtype=np.float64).reshape(len(rows), -1)
    qn = np.linalg.norm(q, axis=1)
    qn[qn == 0] = 1.0
    bc = corpus.sparkSession.sparkContext.broadcast((q_ids, q / qn[:, None]))

    def score(batches):
        ids, qm = bc.value
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for pdf in batches:
            if pdf.empty or len(ids) == 0:
                continue
            m = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf[corpus_vec]])
            norms = np.linalg.norm(m, axis=1)
            norms[norms == 0] = 1.0
            m /= norms[:, None]
            cids = pdf[corpus_id].to_numpy(dtype=np.int64)
            step = max(1, SCORE_CELLS // len(m))
            found = [best]
            for a in range(0, len(ids), step):
                s = m @ qm[a:a + step].T  # rows x queries
                kth = np.partition(s, max(0, len(m) - k), axis=0)[max(0, len(m) - k)]
                r, c = np.nonzero(s >= kth)  # ties at the k-th place stay in
                found.append(_best(c + a, cids[r], s[r, c], k))
            best = _best(*[np.concatenate(x) for x in zip(*found)], k)
        yield pd.DataFrame({"query_id": ids[best[0]] if len(ids) else best[0], "vec_id": best[1], "score": best[2]})

    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()),
                           T.StructField("score", T.DoubleType())])
    partial = corpus.select(corpus_id, corpus_vec).mapInPandas(score, schema)
    from pyspark.sql import Window
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("query_id").alias(query_id), F.col("vec_id").alias(corpus_id),
                    fround("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")))


def centroids(df: DataFrame, group: str, vec: str = "embedding") -> DataFrame:
    """Mean vector per group (element-wise, via posexplode + groupBy)."""
    ex = df.select(group, F.posexplode(vec).alias("i", "v"))
    g = ex.groupBy(group, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return g.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("s")) \
        .select(F.col(group), F.col("s.m").alias(vec))


def _fsum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def vector_stats(df: DataFrame, vec: str = "embedding", dead_eps: float = 1e-6) -> DataFrame:
    """Per vector: mean, std (sample), min, max, abs_max, dead_pct (|x| <
    1e-6), l2 norm - the activation / weight statistics of the reference,
    computed on an array column (6 dp).  The double array and the mean are
    materialised as columns first, so lambdas read them instead of
    re-evaluating them per element."""
    keep = [c for c in df.columns if c != vec]
    a = df.select(*keep, F.transform(F.col(vec), lambda v: v.cast("double")).alias("__x"))
    x = F.col("__x")
    n = F.size(x)
    a = a.select(*keep, "__x", F.when(n > 0, _fsum(x) / n).alias("__mean"))
    mean = F.col("__mean")
    var = F.when(n > 1, _fsum(F.transform(x, lambda v: (v - mean) * (v - mean))) / (n - 1))
    return a.select(
        *keep,
        fround(mean, 6).alias("mean"), fround(F.sqrt(var), 6).alias("std"),
        fround(F.array_min(x), 6).alias("min"), fround(F.array_max(x), 6).alias("max"),
        fround(F.array_max(F.transform(x, lambda v: F.abs(v))), 6).alias("abs_max"),
        fround(F.when(n > 0, F.size(F.filter(x, lambda v: F.abs(v) < dead_eps)) / n * 100), 6).alias("dead_pct"),
        fround(F.sqrt(_fsum(F.transform(x, lambda v: v * v))), 6).alias("l2_norm"))
