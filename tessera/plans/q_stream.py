"""Registered streaming queries.  Each stages ``events`` as JSON-lines files
(the stream source), runs the streaming query with an ``availableNow``
trigger into a sink under the checkpoint folder, and returns the sink read
back as a batch DataFrame."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import streaming as st
from tessera.functions.numeric import fround
from tessera.operators import transforms as tf
from tessera.plans.registry import query
from tessera.sources import topics
from tessera.sources.files import table
from tessera.streaming import state

EVENT_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                             T.StructField("ts", T.StringType()), T.StructField("event_type", T.StringType()),
                             T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _stage_events(spark, d, root: str) -> str:
    src = os.path.join(root, "source")
    ev = table(spark, d, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                                          "event_type", "value", "props")
    ev.repartition("event_id").write.mode("overwrite").json(src)
    return src


def _stream_filter(spark, d):
    root = st.run_location(spark, "filter")
    src = _stage_events(spark, d, root)
    stream = st.json_stream(spark, src, EVENT_SCHEMA, max_files=2)
    st.check_stream_step(stream, "filter_rows")
    out = tf.filter_rows(stream, "event_type", "==", "purchase")
    st.check_stream_step(out, "cast_type")
    out = tf.cast_type(out, "value", "float")
    out = tf.flatten_json(out, "props", "k bigint")
    sink = os.path.join(root, "sink")
    st.run_available_now(out, sink, os.path.join(root, "ckpt"))
    return spark.read.parquet(sink)


query("stream_filter", """SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type, value,
 CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events WHERE event_type = 'purchase'""")(_stream_filter)


def _stage_lines(spark, d, root: str) -> str:
    """JSON lines with malformed readings: error events are cut short."""
    src = os.path.join(root, "lines")
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    js = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    line = F.when(F.col("event_type") == "error", F.substring(js, 1, 12)).otherwise(js)
    ev.select(line.alias("value")).repartition("value").write.mode("overwrite").text(src)
    return src


_READING = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                         T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


def _stream_latest(spark, d):
    """Latest reading per device (user_id) and the malformed lines, from one
    run over a text stream.  State is one row per device, the sink too; lines
    that are no reading pass through under keys that spread them."""
    root = st.run_location(spark, "latest")
    src = _stage_lines(spark, d, root)
    parsed = st.parse_lines(spark.readStream.option("maxFilesPerTrigger", st.files_a_batch(spark, src, 2)).text(src), _READING)
    spread = -1 - F.pmod(F.xxhash64("raw"), F.lit(64))
    rows = parsed.select(F.when(F.col("raw").isNull(), F.col("event.user_id")).otherwise(spread).alias("user_id"),
                         "event.event_id", "event.event_type", "event.value", "raw")
    fields = ["event_id", "event_type", "value"]
    changes = state.latest_rows(rows, "user_id", "event_id", fields, raw="raw")
    sink = state.KeyedSink(spark, os.path.join(root, "latest"), "user_id", changes.drop("raw").schema, gone="gone")
    raws = state.AppendSink(os.path.join(root, "raw"))

    def write(batch, number):
        batch = batch.persist()
        sink.write(batch.where("raw is null").drop("raw"), number)
        raws.write(batch.where("raw is not null").select("raw"), number)
        batch.unpersist()
    st.run_foreach_batch(changes, write, os.path.join(root, "ckpt"), mode="update")
    return sink.read()


query("stream_latest", """SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
 arg_max(value, event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY user_id""")(_stream_latest)


def _stream_raw(spark, d):
    root = st.run_location(spark, "raw")
    src = _stage_lines(spark, d, root)
    parsed = st.parse_lines(spark.readStream.text(src), _READING)
    sink = os.path.join(root, "raw")
    st.run_available_now(parsed.where(F.col("raw").isNotNull()).select("raw"), sink, os.path.join(root, "ckpt"))
    return spark.read.parquet(sink)


query("stream_raw_events", """SELECT substr(to_json({'event_id': event_id, 'user_id': user_id, 'event_type': event_type,
 'value': value}), 1, 12) AS raw FROM events WHERE event_type = 'error'""")(_stream_raw)


def _stream_run_summary(spark, d):
    """Live run summary: one state row and one sink row per run (steps, mean
    and least metric, last step), brought up to date by every micro-batch."""
    root = st.run_location(spark, "runs")
    src = _stage_events(spark, d, root)
    steps = st.json_stream(spark, src, EVENT_SCHEMA, max_files=st.files_a_batch(spark, src, 2)).withColumn("loss", F.col("value") / 100.0)
    changes = state.running_summary(steps, "user_id", "event_id", "loss")
    sink = state.KeyedSink(spark, os.path.join(root, "summary"), "user_id", changes.schema)
    st.run_foreach_batch(changes, sink.write, os.path.join(root, "ckpt"), mode="update")
    return sink.read().select("user_id", "steps", fround(F.col("total") / F.col("known"), 6).alias("mean_loss"),
                              F.col("least").alias("best_loss"), F.col("last").alias("last_step"))


query("stream_run_summary", """SELECT user_id, CAST(count(*) AS BIGINT) AS steps, round(avg(value / 100.0), 6) AS mean_loss,
 min(value / 100.0) AS best_loss, max(event_id) AS last_step FROM events GROUP BY user_id""")(_stream_run_summary)


def _topic(spark, d) -> str:
    root = st.run_location(spark, "topic")
    ev = table(spark, d, "events").select("event_id", F.col("user_id").alias("k"),
                                          F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("v"))
    topics.write_topic(ev, os.path.join(root, "log"), "k", "v", partitions=4, segment_rows=5_000, order=["event_id"])
    return root


def _topic_batch(spark, d):
    """The topic in two bounded reads: up to the middle of each partition, and on from there."""
    path = os.path.join(_topic(spark, d), "log")
    middle = {p: o // 2 for p, o in topics.end_offsets(path).items()}
    both = topics.read_topic(spark, path, ending=middle).unionByName(topics.read_topic(spark, path, starting=middle))
    return both.select(F.from_json("value", _READING).alias("r")).select("r.*")


query("topic_batch", "SELECT event_id, user_id, event_type, value FROM events")(_topic_batch)


def _topic_until_idle(spark, d):
    """Readings per event type of a topic stream that ends when it is idle."""
    root = _topic(spark, d)
    sink = state.AppendSink(os.path.join(root, "out"))
    rows = topics.topic_stream(spark, os.path.join(root, "log")).select(F.from_json("value", _READING).alias("r")).select("r.*")
    topics.read_until_idle(rows, sink.write, os.path.join(root, "ckpt"), idle_seconds=2.0)
    return spark.read.schema(_READING).parquet(os.path.join(root, "out")).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


query("topic_until_idle", """SELECT event_type, CAST(count(*) AS BIGINT) AS n, max(event_id) AS last
 FROM events GROUP BY event_type""")(_topic_until_idle)
