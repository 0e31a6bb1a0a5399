"""Registered queries for the pipeline transforms (projection, filters,
nulls, casts, expressions, joins, dedup, ordering, union) and the
declarative ETL flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import formulas
from tessera.functions.numeric import fround

from tessera.operators import transforms as tf
from tessera.plans.pipeline import Pipeline
from tessera.plans.registry import query
from tessera.sources.files import table

# --------------------------------------------------------------------------- declarative ETL


def etl_flow(spark, sf_dir):
    p = Pipeline("orders report", spark)
    p.add_source("orders", table(spark, sf_dir, "orders"))
    p.add_source("customer", table(spark, sf_dir, "customer"))
    p.add_step("filter_rows", {"column": "o_orderstatus", "operator": "==", "value": "F"})
    p.add_step("cast_type", {"column": "o_totalprice", "dtype": "float"})
    p.add_step("merge", {"right_source_id": "customer", "on": "o_custkey", "right_on": "c_custkey",
                         "how": "inner"})
    p.add_step("deduplicate", {"columns": "o_custkey", "order_by": "o_orderdate,o_orderkey"})
    p.add_step("sort", {"column": "o_totalprice", "descending": True, "tie_break": "o_orderkey"})
    p.add_step("limit", {"n": 100})
    p.add_step("select_columns", {"columns": "o_orderkey,o_custkey,o_totalprice,c_name,c_mktsegment,c_nationkey"})
    return p.build()


query("declarative_etl", """
WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F'),
j AS (SELECT * FROM f JOIN customer c ON f.o_custkey IS NOT DISTINCT FROM c.c_custkey),
d AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)
SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment, c_nationkey
FROM d ORDER BY o_totalprice DESC, o_orderkey LIMIT 100
""")(etl_flow)

# --------------------------------------------------------------------------- projection


@query("scan_parquet", """
SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity >= 10
""")
def scan_parquet(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return tf.filter_rows(li, "l_quantity", ">=", "10").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")


@query("select_columns", """
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(NULL AS VARCHAR) AS o_missing FROM orders
""")
def q_select_columns(spark, sf_dir):
    return tf.select_columns(table(spark, sf_dir, "orders"), "o_orderkey, o_custkey, o_orderstatus, o_missing")


@query("drop_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def q_drop_columns(spark, sf_dir):
    return tf.drop_columns(table(spark, sf_dir, "customer"), "c_name,c_acctbal,not_there")


@query("rename_columns", """
SELECT p_partkey, p_name AS name, p_brand, p_type, p_size AS size, p_retailprice FROM part
""")
def q_rename_columns(spark, sf_dir):
    return tf.rename_columns(table(spark, sf_dir, "part"), '{"p_name": "name", "p_size": "size", "zz": "yy"}')


@query("preview", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")
def q_preview(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return tf.limit(tf.sort(o, "o_orderkey"), 20)


# --------------------------------------------------------------------------- filters

_ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
_LI_COLS = "l_orderkey, l_linenumber, l_quantity, l_discount, l_tax"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(*[c.strip() for c in _ORDER_COLS.split(",")])


def _lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*[c.strip() for c in _LI_COLS.split(",")])


query("filter_eq", f"SELECT {_ORDER_COLS} FROM orders WHERE o_orderpriority = '1-URGENT'")(
    lambda spark, d: tf.filter_rows(_orders(spark, d), "o_orderpriority", "==", "1-URGENT"))
query("filter_ne", f"SELECT {_ORDER_COLS} FROM orders WHERE o_orderstatus <> 'O'")(
    lambda spark, d: tf.filter_rows(_orders(spark, d), "o_orderstatus", "!=", "O"))
query("filter_gt", f"SELECT {_LI_COLS} FROM lineitem WHERE l_quantity > 25")(
    lambda spark, d: tf.filter_rows(_lineitem(spark, d), "l_quantity", ">", "25"))
query("filter_lt", f"SELECT {_LI_COLS} FROM lineitem WHERE l_discount < 0.05")(
    lambda spark, d: tf.filter_rows(_lineitem(spark, d), "l_discount", "<", "0.05"))
query("filter_ge", f"SELECT {_LI_COLS} FROM lineitem WHERE l_tax >= 0.04")(
    lambda spark, d: tf.filter_rows(_lineitem(spark, d), "l_tax", ">=", "0.04"))
query("filter_le", f"SELECT {_LI_COLS} FROM lineitem WHERE l_quantity <= 10")(
    lambda spark, d: tf.filter_rows(_lineitem(spark, d), "l_quantity", "<=", "10"))


def _docs_meta(spark, d):
    return table(spark, d, "documents")


query("filter_contains", """
SELECT doc_id, lang, source, n_chars FROM documents WHERE contains(lower(text), 'the')
""")(lambda spark, d: tf.filter_rows(_docs_meta(spark, d), "text", "contains", "THE")
     .select("doc_id", "lang", "source", "n_chars"))
query("filter_not_contains", """
SELECT doc_id, lang, source, n_chars FROM documents WHERE text IS NOT NULL AND NOT contains(lower(text), 'the')
""")(lambda spark, d: tf.filter_rows(_docs_meta(spark, d), "text", "not_contains", "The")
     .select("doc_id", "lang", "source", "n_chars"))
query("filter_regex", """
SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE regexp_matches(c_mktsegment, 'MACH|AUTO')
""")(lambda spark, d: tf.filter_rows(table(spark, d, "customer"), "c_mktsegment", "regex", "MACH|AUTO")
     .select("c_custkey", "c_name", "c_mktsegment"))

# documents with blanks injected: lang '' for German, source null for src3
_BLANKED_SQL = """(SELECT doc_id, CASE WHEN lang = 'de' THEN '' ELSE lang END AS lang,
  CASE WHEN source = 'src3' THEN NULL ELSE source END AS source, n_chars FROM documents)"""


def _blanked(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id",
                       F.when(F.col("lang") == "de", F.lit("")).otherwise(F.col("lang")).alias("lang"),
                       F.when(F.col("source") == "src3", F.lit(None)).otherwise(F.col("source")).alias("source"),
                       "n_chars")


query("filter_is_null", f"SELECT * FROM {_BLANKED_SQL} t WHERE lang IS NULL OR lang = ''")(
    lambda spark, d: tf.filter_rows(_blanked(spark, d), "lang", "is_null"))
query("filter_not_null", f"SELECT * FROM {_BLANKED_SQL} t WHERE source IS NOT NULL AND source <> ''")(
    lambda spark, d: tf.filter_rows(_blanked(spark, d), "source", "not_null"))
query("drop_nulls", f"""SELECT * FROM {_BLANKED_SQL} t
WHERE lang IS NOT NULL AND lang <> '' AND source IS NOT NULL AND source <> ''""")(
    lambda spark, d: tf.drop_nulls(_blanked(spark, d)))

# --------------------------------------------------------------------------- fill

query("fill_value", f"""SELECT doc_id, CASE WHEN lang IS NULL OR lang = '' THEN 'xx' ELSE lang END AS lang,
source, n_chars FROM {_BLANKED_SQL} t""")(
    lambda spark, d: tf.fill_nulls(_blanked(spark, d), "lang", "value", "xx"))
query("fill_mode", f"""SELECT doc_id, lang,
coalesce(NULLIF(source, ''), (SELECT source FROM {_BLANKED_SQL} s WHERE source IS NOT NULL AND source <> ''
   GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)) AS source, n_chars FROM {_BLANKED_SQL} t""")(
    lambda spark, d: tf.fill_nulls(_blanked(spark, d), "source", "mode"))

_DISC_SQL = "(SELECT l_orderkey, l_linenumber, NULLIF(l_discount, 0.0) AS l_discount FROM lineitem)"


def _disc(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.when(F.col("l_discount") == 0.0, F.lit(None)).otherwise(F.col("l_discount")).alias("l_discount"))


query("fill_mean", f"""SELECT l_orderkey, l_linenumber,
round(coalesce(l_discount, (SELECT coalesce(avg(l_discount), 0) FROM {_DISC_SQL} a)), 6) AS l_discount
FROM {_DISC_SQL} t""")(
    lambda spark, d: tf.fill_nulls(_disc(spark, d), "l_discount", "mean")
    .withColumn("l_discount", fround("l_discount", 6)))
query("fill_median", f"""SELECT l_orderkey, l_linenumber,
coalesce(l_discount, (SELECT x FROM (SELECT l_discount AS x, row_number() OVER (ORDER BY l_discount) - 1 AS rn,
  count(*) OVER () AS n FROM {_DISC_SQL} v WHERE l_discount IS NOT NULL) WHERE rn = n // 2)) AS l_discount
FROM {_DISC_SQL} t""")(
    lambda spark, d: tf.fill_nulls(_disc(spark, d), "l_discount", "median"))

_EV_NULL_SQL = """(SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value
FROM events)"""


def _ev_null(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", "user_id", "ts",
                     F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value")).alias("value"))


query("fill_ffill", f"""SELECT event_id, user_id, coalesce(value, last_value(value IGNORE NULLS) OVER
 (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS value
FROM {_EV_NULL_SQL} t""")(
    lambda spark, d: tf.fill_nulls(_ev_null(spark, d), "value", "ffill", order_by="ts,event_id",
                                   partition_by="user_id").drop("ts"))
query("fill_bfill", f"""SELECT event_id, user_id, coalesce(value, first_value(value IGNORE NULLS) OVER
 (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
FROM {_EV_NULL_SQL} t""")(
    lambda spark, d: tf.fill_nulls(_ev_null(spark, d), "value", "bfill", order_by="ts,event_id",
                                   partition_by="user_id").drop("ts"))

# --------------------------------------------------------------------------- casts / expressions


def _cust_strings(spark, d):
    c = table(spark, d, "customer")
    return c.select(
        "c_custkey",
        F.substring("c_name", 10, 100).alias("cust_no"),
        F.format_string("%.2f", "c_acctbal").alias("bal"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "yes").when(F.col("c_mktsegment") == "BUILDING", "1")
         .when(F.col("c_mktsegment") == "AUTOMOBILE", "True").otherwise(F.col("c_mktsegment")).alias("flag"),
        "c_nationkey")


query("cast_int", "SELECT c_custkey, CAST(trunc(TRY_CAST(substring(c_name, 10, 100) AS DOUBLE)) AS BIGINT) AS cust_no FROM customer")(
    lambda spark, d: tf.cast_type(_cust_strings(spark, d), "cust_no", "int").select("c_custkey", "cust_no"))
query("cast_float", "SELECT c_custkey, TRY_CAST(printf('%.2f', c_acctbal) AS DOUBLE) AS bal FROM customer")(
    lambda spark, d: tf.cast_type(_cust_strings(spark, d), "bal", "float").select("c_custkey", "bal"))
query("cast_bool", """SELECT c_custkey, lower(CASE c_mktsegment WHEN 'MACHINERY' THEN 'yes' WHEN 'BUILDING' THEN '1'
 WHEN 'AUTOMOBILE' THEN 'True' ELSE c_mktsegment END) IN ('true', '1', 'yes') AS flag FROM customer""")(
    lambda spark, d: tf.cast_type(_cust_strings(spark, d), "flag", "bool").select("c_custkey", "flag"))
query("cast_str", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")(
    lambda spark, d: tf.cast_type(_cust_strings(spark, d), "c_nationkey", "str").select("c_custkey", "c_nationkey"))

query("add_column", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS revenue,
 CAST(l_quantity AS BIGINT) // 10 AS qty_band FROM lineitem""")(
    lambda spark, d: tf.add_column(
        tf.add_column(table(spark, d, "lineitem"), "revenue", "round(l_extendedprice * (1 - l_discount), 6)"),
        "qty_band", "try_cast(l_quantity AS BIGINT) div 10").select("l_orderkey", "l_linenumber", "revenue", "qty_band"))

# --------------------------------------------------------------------------- joins

_L_SQL = """(SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL ELSE o_custkey END
 AS o_custkey, o_totalprice, o_orderstatus FROM orders)"""
_R_SQL = """(SELECT CASE WHEN c_mktsegment = 'HOUSEHOLD' AND c_nationkey = 0 THEN NULL ELSE c_custkey END AS o_custkey,
 c_name, c_acctbal AS o_totalprice FROM customer)"""


def _merge_sides(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer")
    left = o.select("o_orderkey",
                    F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), F.lit(None))
                    .otherwise(F.col("o_custkey")).alias("o_custkey"), "o_totalprice", "o_orderstatus")
    right = c.select(F.when((F.col("c_mktsegment") == "HOUSEHOLD") & (F.col("c_nationkey") == 0), F.lit(None))
                     .otherwise(F.col("c_custkey")).alias("o_custkey"), "c_name",
                     F.col("c_acctbal").alias("o_totalprice"))
    return left, right


def _merge_sql(join: str, key: str) -> str:
    return f"""SELECT l.o_orderkey, {key} AS o_custkey, l.o_totalprice, l.o_orderstatus, r.c_name,
 r.o_totalprice AS o_totalprice_right FROM {_L_SQL} l {join} JOIN {_R_SQL} r
 ON l.o_custkey IS NOT DISTINCT FROM r.o_custkey"""


for _how, _join, _key in (("inner", "INNER", "l.o_custkey"), ("left", "LEFT", "l.o_custkey"),
                          ("right", "RIGHT", "r.o_custkey"), ("outer", "FULL", "coalesce(l.o_custkey, r.o_custkey)")):
    def _mk(how):
        def run(spark, d):
            left, right = _merge_sides(spark, d)
            return tf.merge(left, right, "o_custkey", how, split_heavy=True)  # the null key is heavy on both sides
        return run
    query(f"merge_{_how}", _merge_sql(_join, _key))(_mk(_how))


# a third of the orders share the null key, which one customer has too; parts of 1,000 rows
def _heavy_sides(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("k"))
    customer = table(spark, d, "customer").select(F.when(F.col("c_custkey") != 7, F.col("c_custkey")).alias("k"), "c_name")
    return orders, customer


for _how, _join in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    query(f"merge_heavy_{_how}", f"""SELECT o_orderkey, coalesce(o.k, c.k) AS k, c_name
 FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS k FROM orders) o
 {_join} (SELECT CASE WHEN c_custkey <> 7 THEN c_custkey END AS k, c_name FROM customer) c ON o.k IS NOT DISTINCT FROM c.k""")(
        lambda spark, d, how=_how: tf.merge(*_heavy_sides(spark, d), "k", how, split_heavy=True, heavy_rows=1000))

# --------------------------------------------------------------------------- dedup / order / union

query("dedup_all", "SELECT DISTINCT user_id, event_type FROM events")(
    lambda spark, d: tf.deduplicate(table(spark, d, "events").select("user_id", "event_type")))
query("dedup_keys", """SELECT event_id, user_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")(
    lambda spark, d: tf.deduplicate(table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts"),
                                    "user_id,event_type", "ts,event_id").drop("ts"))
query("sort_desc", """SELECT p_partkey, p_name, p_retailprice,
 CAST(row_number() OVER (ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS BIGINT) AS rank FROM part""")(
    lambda spark, d: tf.sort_ranked(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"),
                                    "p_retailprice", True, "p_partkey"))
query("sort_asc", """SELECT p_partkey, p_name, p_retailprice,
 CAST(row_number() OVER (ORDER BY p_retailprice NULLS FIRST, p_partkey) AS BIGINT) AS rank FROM part""")(
    lambda spark, d: tf.sort_ranked(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"),
                                    "p_retailprice", False, "p_partkey"))
query("limit_n", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")(
    lambda spark, d: tf.limit(tf.sort(table(spark, d, "orders").select("o_orderkey", "o_totalprice"),
                                      "o_totalprice", True, "o_orderkey"), 50))
query("sample_n", """SELECT doc_id, lang, source FROM documents
ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42')), doc_id LIMIT 100""")(
    lambda spark, d: tf.sample(table(spark, d, "documents").select("doc_id", "lang", "source"), 100, 42, "doc_id"))
query("page", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100 OFFSET 200")(
    lambda spark, d: tf.page(table(spark, d, "customer").select("c_custkey", "c_name"), 200, 100, "c_custkey"))
query("concat", """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
UNION ALL BY NAME SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""")(
    lambda spark, d: tf.concat(table(spark, d, "customer"), table(spark, d, "supplier")))


def _add_column_function(spark, d):
    formulas.register_function(spark, "net_price", "price double, discount double, tax double", "double",
                               "price * (1 - discount) * (1 + coalesce(tax, 0))")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return tf.add_column(li, "net", "net_price(l_extendedprice, l_discount, l_tax)")


query("add_column_function", """SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax,
 l_extendedprice * (1 - l_discount) * (1 + coalesce(l_tax, 0)) AS net FROM lineitem""")(_add_column_function)


def _pipeline_stats(spark, d):
    """The statistics of a pipeline's result, a row per column."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    p = Pipeline("stats", spark).add_source("orders", orders)
    p.add_step("filter_rows", {"column": "o_orderstatus", "operator": "!=", "value": "P"})
    stats = p.stats()
    rows = [(c, s["type"], s["count"], s["null_count"], s["unique"], s.get("median"), (s.get("top_values") or [{}])[0].get("value"),
             s.get("max_length")) for c, s in stats["columns"].items()]  # a row per column
    return spark.createDataFrame(rows, "column string, type string, count bigint, null_count bigint, unique bigint, median double, "
                                       "top string, max_length bigint")


def _pipeline_stats_sql() -> str:
    def one(c: str, number: bool) -> str:
        median = f"(SELECT CAST(x AS DOUBLE) FROM (SELECT {c} AS x, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM o) WHERE i = n // 2)"
        top = f"(SELECT {c} FROM o GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        return f"""SELECT '{c}' AS column, '{'numeric' if number else 'categorical'}' AS type, count(*)::BIGINT AS count,
 count(*) FILTER ({c} IS NULL)::BIGINT AS null_count, count(DISTINCT {c})::BIGINT AS unique, {median if number else 'NULL::DOUBLE'} AS median,
 {'NULL' if number else top} AS top, {'NULL' if number else f'max(length({c}))'}::BIGINT AS max_length FROM o"""
    parts = [one(c, c in ("o_orderkey", "o_totalprice")) for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")]
    return "WITH o AS (SELECT * FROM orders WHERE o_orderstatus <> 'P')\n" + "\nUNION ALL ".join(parts)


query("pipeline_stats", _pipeline_stats_sql())(_pipeline_stats)
