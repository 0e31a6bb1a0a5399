"""Registered queries: file scans and sinks (written under the checkpoint
folder, then read back), Kafka record encoding, file inventories."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tessera.plans.q_datasets import scratch
from tessera.plans.registry import query
from tessera.sources import inventory as inv
from tessera.sources import sinks
from tessera.sources.files import read_csv, read_json, table


def _scan_csv(spark, d):
    path = scratch(spark, "scan_csv")
    sinks.write_csv(table(spark, d, "customer"), path)
    return read_csv(spark, path)


query("scan_csv", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
 CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer""")(_scan_csv)


def _scan_jsonl(spark, d):
    path = scratch(spark, "scan_jsonl")
    sinks.write_jsonl(table(spark, d, "events").drop("ts"), path)
    return read_json(spark, path, lines=True)


def _csv_round_trip(spark, d):
    path = scratch(spark, "csv_text")
    sinks.write_csv(table(spark, d, "documents").select("doc_id", "text"), path)
    return read_csv(spark, path).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


# texts with quotes, separators and line breaks
query("csv_round_trip", "SELECT doc_id, text FROM documents")(_csv_round_trip)

query("scan_jsonl", "SELECT event_id, user_id, event_type, value, props FROM events")(_scan_jsonl)


def _sink_csv(spark, d):
    path = scratch(spark, "sink_csv")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    sinks.write_csv(li, path)
    return spark.read.option("header", True).schema(li.schema).csv(path)


query("sink_csv", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem")(_sink_csv)


def _sink_jsonl(spark, d):
    path = scratch(spark, "sink_jsonl")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    sinks.write_jsonl(o, path)
    return spark.read.schema(o.schema).json(path)


query("sink_jsonl", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")(_sink_jsonl)


def _sink_json_array(spark, d):
    path = scratch(spark, "sink_json_array")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    sinks.write_json_array(o, path, files=3)
    return read_json(spark, path, lines=False, schema=o.schema)


query("sink_json_array", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")(_sink_json_array)


def _sink_parquet(spark, d):
    path = scratch(spark, "sink_parquet")
    sinks.write_parquet(table(spark, d, "lineitem").drop("l_shipdate"), path, partition_by=["l_returnflag"])
    return spark.read.parquet(path)


query("sink_parquet", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
 l_tax, l_linestatus, l_returnflag FROM lineitem""")(_sink_parquet)

query("kafka_encode", """SELECT CAST(user_id AS VARCHAR) AS key, CAST(to_json({'event_id': event_id, 'user_id': user_id,
 'event_type': event_type, 'props': props}) AS VARCHAR) AS value FROM events""")(
    lambda spark, d: sinks.kafka_records(table(spark, d, "events").select("event_id", "user_id", "event_type", "props"),
                                         key="user_id"))

# ---- file inventories: a tree of files that Spark writes from the tables, one per label


_TREE = {"documents": ("lang", "csv"), "orders": ("o_orderstatus", "csv"), "events": ("event_type", "json"),
         "lineitem": ("l_returnflag", "parquet")}


def _write_tree(rows, root: str, name: str) -> None:
    key, fmt = _TREE[name]
    w = rows.repartition(key).write.mode("overwrite").partitionBy(key)
    (w.option("header", True) if fmt == "csv" else w).format(fmt).save(os.path.join(root, name))


def _documents_tree(spark, d):
    """The documents' lengths, a CSV file per language."""
    root = scratch(spark, "tree")
    _write_tree(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), root, "documents")
    return root


def _profile_tree(spark, d):
    """A file per label of four tables, with the label's number of rows: what
    a profile looks at is names and kinds of files."""
    root = scratch(spark, "tree")
    for name, (key, _) in _TREE.items():
        _write_tree(table(spark, d, name).groupBy(key).agg(F.count(F.lit(1)).alias("n")), root, name)
    return root


def _labelled_files(spark, d):
    files = inv.file_inventory(spark, os.path.join(_documents_tree(spark, d), "documents"), glob="*.csv")
    return files.select("path", "size")


query("file_inventory", """SELECT 'lang=' || lang AS folder, CAST(1 AS BIGINT) AS n_files FROM documents WHERE lang IS NOT NULL GROUP BY lang""")(
    lambda spark, d: _labelled_files(spark, d).where("size > 0").groupBy(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("n_files")))


def _folder_labels(spark, d):
    """Rows per label: the label is the folder a row's file lies in."""
    root = os.path.join(_documents_tree(spark, d), "documents")
    labels = inv.folder_labels(inv.file_inventory(spark, root, glob="*.csv")).withColumnRenamed("path", "file")
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).csv(root).select(F.col("_metadata.file_path").alias("at"))
    return rows.join(labels, F.regexp_replace("at", "^file:/*", "/") == F.regexp_replace("file", "^file:/*", "/")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"))


query("folder_labels", """SELECT 'lang=' || lang AS label, count(*) AS n_rows FROM documents WHERE lang IS NOT NULL GROUP BY 1""")(_folder_labels)


def _profiles(spark, d):
    root = _profile_tree(spark, d)
    out = None
    for name in ("documents", "orders", "events", "lineitem"):
        sub = os.path.join(root, name)
        files = inv.file_inventory(spark, sub).where(~F.col("path").contains("_SUCCESS"))
        p = inv.dir_profile(files, sub).select(F.lit(name).alias("dir"), F.array_join("subdirs", ",").alias("subdirs"),
                                               F.col("file_count").alias("files_at_top"))
        flat = inv.dir_profile(files.withColumn("path", F.concat(F.lit(sub + "/"), F.regexp_extract("path", r"([^/]+)$", 1))), sub)
        t = flat.select(inv.detect_type(F.col("files_by_extension"), F.array().cast("array<string>")).alias("detected_type"),
                        F.col("file_count").alias("n_files")).first()  # one row
        p = p.select("*", F.lit(t.detected_type).alias("detected_type"), F.lit(t.n_files).alias("n_files"))
        out = p if out is None else out.unionByName(p)
    return out


_DIRS_SQL = " UNION ALL ".join(
    f"""SELECT '{t}' AS dir, string_agg(DISTINCT '{k}=' || {k}, ',' ORDER BY '{k}=' || {k}) AS subdirs, CAST(0 AS BIGINT) AS files_at_top,
 '{kind}' AS detected_type, CAST(count(DISTINCT {k}) AS BIGINT) AS n_files FROM {t}"""
    for t, k, kind in (("documents", "lang", "tabular"), ("orders", "o_orderstatus", "tabular"), ("events", "event_type", "text"),
                       ("lineitem", "l_returnflag", "unknown")))

query("dir_profile", f"SELECT dir, subdirs, files_at_top FROM ({_DIRS_SQL}) t")(
    lambda spark, d: _profiles(spark, d).select("dir", "subdirs", "files_at_top"))
query("detect_type", f"SELECT dir, detected_type, n_files FROM ({_DIRS_SQL}) t")(
    lambda spark, d: _profiles(spark, d).select("dir", "detected_type", "n_files"))


def _file_summary(spark, d):
    path = scratch(spark, "summary")
    table(spark, d, "customer").write.mode("overwrite").option("header", True).csv(path)
    df = inv.file_summary(spark, path, "csv")
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


query("file_summary", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(5 AS BIGINT) AS n_columns FROM customer")(_file_summary)
