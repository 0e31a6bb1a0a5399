"""Structured Streaming: JSON ingest with a stateless step subset, latest
reading per device, live run summaries, and the rule deciding which
pipeline steps may run on a stream.

Bounded behaviour (the reference reads a topic until it is idle) maps to
``trigger(availableNow=True)``: every file / offset present at start is
processed, then the query stops.  Checkpoints live under the shared
checkpoint folder, one fresh location per query run.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import checkpoint_dir

# Steps that keep no state across rows and may run on a stream.  merge is
# allowed with a static right side only; deduplicate only as
# dropDuplicatesWithinWatermark.
STREAM_SAFE_OPS = ("select_columns", "drop_columns", "rename_columns", "filter_rows", "drop_nulls",
                   "fill_nulls:value", "cast_type", "add_column", "text_clean", "text_split",
                   "flatten_json", "concat", "merge")
STREAM_REJECTED_OPS = ("fill_nulls:mean", "fill_nulls:median", "fill_nulls:mode", "fill_nulls:ffill",
                       "fill_nulls:bfill", "sort", "limit", "sample", "deduplicate")


def check_stream_step(df: DataFrame, op: str, params: dict | None = None, right: DataFrame | None = None) -> None:
    """Raise early (at build time) when ``op`` cannot run on a stream."""
    if not df.isStreaming:
        return
    p = params or {}
    key = f"{op}:{p.get('strategy', 'value')}" if op == "fill_nulls" else op
    if op == "deduplicate" and p.get("watermark"):
        return  # dropDuplicatesWithinWatermark: state bounded by the watermark
    if key in STREAM_REJECTED_OPS:
        raise ValueError(f"step {key} needs the whole table and cannot run on a stream")
    if op == "flatten_json" and not p.get("schema"):
        raise ValueError("flatten_json on a stream needs an explicit schema")
    if op == "merge" and right is not None and right.isStreaming:
        raise ValueError("merge on a stream needs a static right side")
    if key not in STREAM_SAFE_OPS:
        raise ValueError(f"unknown or unsupported streaming step {key}")


def run_location(spark: SparkSession, name: str) -> str:
    base = checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def json_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """JSON-lines file stream (the broker-free stand-in for a Kafka topic)."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(path)


def files_a_batch(spark: SparkSession, path: str, least: int, batches: int = 8) -> int:
    """How many files of a folder a batch takes for about ``batches`` of them
    in all (``least`` files at least): a sink with one row per key is written
    anew by every batch, so their number must not grow with the input."""
    return max(least, -(-len(spark.read.text(path).inputFiles()) // batches))


def parse_lines(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Text lines -> (parsed struct or null, raw text).  Malformed lines
    keep their text so they can go to a raw-event output."""
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    ok = F.col(column).isNotNull() & F.try_parse_json(F.col(column)).isNotNull()
    return lines.select(F.when(ok, parsed).alias("event"), F.when(~ok, F.col(column)).alias("raw"))


def run_available_now(df: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet",
                      mode: str = "append") -> None:
    q = (df.writeStream.format(fmt).outputMode(mode).option("path", sink_path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def run_foreach_batch(df: DataFrame, fn, checkpoint: str, mode: str = "update") -> None:
    q = (df.writeStream.outputMode(mode).foreachBatch(fn).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def latest_per_key(events: DataFrame, key: str, ts: str, cols: list[str]) -> DataFrame:
    """Latest event per key: ``max_by(struct, (ts, tie))`` - a streaming
    aggregate whose state is one row per key."""
    order = F.struct(F.col(ts), *[F.col(c) for c in cols])
    return events.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in [ts, *cols]]), order).alias("latest")) \
        .select(key, "latest.*")


def kafka_stream(spark: SparkSession, bootstrap: str, topic: str, schema: T.StructType | None = None,
                 starting: str = "earliest", max_offsets: int | None = None) -> DataFrame:
    """Kafka topic as a stream of decoded JSON values (needs the Kafka
    connector on the classpath).  Non-object values are wrapped as
    ``{"value": v}``; with a schema the JSON becomes columns."""
    from tessera.sources.connectors import decode_kafka_json
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
         .option("subscribe", topic).option("startingOffsets", starting))
    if max_offsets:
        r = r.option("maxOffsetsPerTrigger", str(max_offsets))
    raw = r.load().select(F.col("value").cast("string").alias("value"))
    return decode_kafka_json(raw, schema)


def dedup_stream(df: DataFrame, columns: list[str], event_time: str, delay: str = "10 minutes") -> DataFrame:
    """Streaming deduplication: the first row per key within the watermark
    (state is dropped once the watermark passes)."""
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(columns)
