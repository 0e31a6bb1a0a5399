"""Registered queries: cosine top-k retrieval and per-vector statistics
over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import vectors as vx
from tessera.plans.registry import query
from tessera.sources.files import table


def _topk(spark, d):
    emb = table(spark, d, "embeddings")
    # queries: one centroid per label (bounded by the label count, size-checked)
    q = vx.centroids(emb, "label").withColumnRenamed("label", "query_id") \
        .withColumn("query_id", F.col("query_id").cast("bigint"))
    return vx.cosine_topk(emb, q, k=5)


query("cosine_topk", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT label, i, avg(v[i]) AS m FROM e, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) r GROUP BY label, i),
c AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM x GROUP BY label),
s AS (SELECT c.query_id, e.vec_id, list_dot_product(e.v, c.q) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.q, c.q))) AS score
  FROM c CROSS JOIN e)
SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) t WHERE rank <= 5""")(_topk)

_V = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"
query("vector_stats", f"""WITH e AS (SELECT vec_id, label, {_V} AS x FROM embeddings),
m AS (SELECT *, list_reduce(x, lambda a, b: a + b) / len(x) AS mean FROM e)
SELECT vec_id, label, round(mean, 6) AS mean,
 round(sqrt(list_reduce(list_transform(x, lambda v: (v - mean) * (v - mean)), lambda a, b: a + b) / (len(x) - 1)), 6) AS std,
 round(list_min(x), 6) AS min, round(list_max(x), 6) AS max, round(list_max(list_transform(x, lambda v: abs(v))), 6) AS abs_max,
 round(len(list_filter(x, lambda v: abs(v) < 1e-6)) / len(x) * 100, 6) AS dead_pct,
 round(sqrt(list_reduce(list_transform(x, lambda v: v * v), lambda a, b: a + b)), 6) AS l2_norm FROM m""")(
    lambda spark, d: vx.vector_stats(table(spark, d, "embeddings")))
