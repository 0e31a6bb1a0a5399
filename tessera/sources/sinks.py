"""Sinks: CSV, JSON lines, Parquet, JDBC, Kafka encoding and the network
sinks' writers.  Every write is a distributed job (one file per task)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.datasets import json_encode_nested
from tessera.sources.connectors import FORMATS, elasticsearch_options, jdbc_options, mongo_options


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", delimiter: str = ",") -> None:
    json_encode_nested(df).write.mode(mode).option("header", True).option("sep", delimiter) \
        .option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


#: Rows of a JSON array file.
ARRAY_ROWS = 500_000


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite", files: int = 1, max_rows: int = ARRAY_ROWS) -> None:
    """Files that are one JSON array each, a row an object: every task writes
    its own, an empty one ``[]``.  ``read_json(lines=False)`` reads them back,
    each by one task: so rows are dealt evenly to ``files`` of them, or to as
    many as keep a file to ``max_rows``."""
    files = max(files, -(-df.count() // max_rows))
    if files > 1:
        df = df.repartition(files)

    def framed(batches):
        sign = "["
        for b in batches:
            if b.num_rows:
                rows = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([sign + rows[0], *("," + r for r in rows[1:])])], names=["value"])
                sign = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if sign == "," else "[]"])], names=["value"])
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
    rows.mapInArrow(framed, "value string").write.mode(mode).text(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_jdbc(df: DataFrame, vendor: str, table: str, mode: str = "append", batchsize: int = 10_000, **conn) -> None:
    """Batched inserts from every task (the reference inserts row by row)."""
    opts = jdbc_options(vendor, table=table, **conn)
    opts.pop("fetchsize", None)
    df.write.format("jdbc").options(**opts).option("batchsize", str(batchsize)).mode(mode).save()


def kafka_records(df: DataFrame, key: str | None = None) -> DataFrame:
    """key / value columns: every row as one JSON object."""
    cols = [F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value")]
    if key:
        cols.insert(0, F.col(key).cast("string").alias("key"))
    return df.select(*cols)


def write_kafka(df: DataFrame, bootstrap: str, topic: str, key: str | None = None) -> None:
    kafka_records(df, key).write.format("kafka").option("kafka.bootstrap.servers", bootstrap) \
        .option("topic", topic).save()


def write_mongo(df: DataFrame, uri: str, database: str, collection: str, mode: str = "append") -> None:
    df.write.format(FORMATS["mongodb"]).options(**mongo_options(uri, database, collection)).mode(mode).save()


def write_elasticsearch(df: DataFrame, nodes: str, index: str, mode: str = "append") -> None:
    df.write.format(FORMATS["elasticsearch"]).options(**elasticsearch_options(nodes, index)).mode(mode).save()


def unsupported_sink(kind: str):
    """The reference reports success for Redis / BigQuery sinks without
    writing; here a missing connector is an error."""
    raise ValueError(f"sink {kind!r} needs its Spark connector on the classpath; none is configured")
