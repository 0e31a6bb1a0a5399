"""Registered queries: column profile, histogram, top values, text lengths,
label distribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import profile as pr
from tessera.plans.registry import query
from tessera.sources.files import table

_ORDERS = [("o_orderkey", False), ("o_custkey", False), ("o_orderstatus", True), ("o_totalprice", False),
           ("o_orderdate", False), ("o_orderpriority", True)]


def _counts_sql():
    parts = []
    for c, is_str in _ORDERS:
        blank = f"({c} IS NULL OR {c} = '')" if is_str else f"{c} IS NULL"
        parts.append(f"""SELECT '{c}' AS column, CAST(count(*) AS BIGINT) AS count,
 CAST(count(*) FILTER (WHERE {blank}) AS BIGINT) AS null_count,
 round(count(*) FILTER (WHERE {blank}) / count(*) * 100, 1) AS null_pct,
 CAST(count(DISTINCT CAST({c} AS VARCHAR)) FILTER (WHERE NOT {blank}) AS BIGINT) AS unique,
 CAST(count(*) AS BIGINT) AS row_count, CAST({len(_ORDERS)} AS BIGINT) AS col_count FROM orders""")
    return "\nUNION ALL\n".join(parts)


query("profile_counts", _counts_sql())(lambda spark, d: pr.profile_counts(table(spark, d, "orders")))

_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax"]


def _numeric_sql():
    parts = []
    for c in _LI_NUM:
        parts.append(f"""SELECT '{c}' AS column, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
 round(avg({c}), 4) AS mean,
 (SELECT CAST(x AS DOUBLE) FROM (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) - 1 AS rn, count(*) OVER () AS n
   FROM lineitem WHERE {c} IS NOT NULL) WHERE rn = n // 2) AS median FROM lineitem""")
    return "\nUNION ALL\n".join(parts)


query("profile_numeric", _numeric_sql())(lambda spark, d: pr.numeric_profile(table(spark, d, "lineitem", spread=True).select(*_LI_NUM)))

query("histogram", """WITH v AS (SELECT value AS x FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
s AS (SELECT min(x) AS mn, max(x) AS mx, least(count(DISTINCT x), 20) AS nb FROM v),
s2 AS (SELECT mn, (mx - mn) / nb AS step, nb FROM s WHERE nb > 1 AND (mx - mn) / nb > 0),
c AS (SELECT least(CAST(floor((x - mn) / step) AS BIGINT), nb - 1) AS bucket, count(*) AS cnt FROM v, s2 GROUP BY 1),
g AS (SELECT unnest(generate_series(0, nb - 1)) AS bucket, mn, step FROM s2)
SELECT CAST(g.bucket AS BIGINT) AS bucket, round(mn + g.bucket * step, 2) AS label,
 CAST(coalesce(cnt, 0) AS BIGINT) AS count FROM g LEFT JOIN c USING (bucket)""")(
    lambda spark, d: pr.histogram(table(spark, d, "events"), "value"))

_CAT = ["o_orderstatus", "o_orderdate", "o_orderpriority"]


def _top_sql():
    vc = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM orders "
        f"WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '' GROUP BY 2" for c in _CAT)
    return f"""SELECT "column", value, CAST(count AS BIGINT) AS count, CAST(rank AS BIGINT) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM ({vc}) v) t WHERE rank <= 20"""


query("profile_top_values", _top_sql())(
    lambda spark, d: pr.top_values(table(spark, d, "orders"), pr.categorical_columns(table(spark, d, "orders"))))


def _len_sql():
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column, round(avg(length({c})), 1) AS avg_length, CAST(max(length({c})) AS BIGINT) AS max_length "
        f"FROM documents WHERE {c} IS NOT NULL AND {c} <> ''" for c in ("text", "lang", "source"))


query("profile_text_length", _len_sql())(
    lambda spark, d: pr.text_lengths(table(spark, d, "documents"),
                                     pr.categorical_columns(table(spark, d, "documents"))))


def _labelled_docs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    lab = table(spark, d, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("label"))
    return docs.join(lab, "doc_id", "left")


query("label_distribution", """SELECT coalesce(CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, 'unknown') AS label,
 CAST(count(*) AS BIGINT) AS count FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")(
    lambda spark, d: pr.label_distribution(_labelled_docs(spark, d)))
