"""A partitioned topic in a shared folder: ``partition=K/segment=BASE`` folders
of text files whose n-th line is the message at offset BASE + n.  It is read
as a batch or a stream with offsets per partition, like a topic of a broker,
and ``read_until_idle`` ends a stream after a number of rows or a quiet while.

The reader runs in Python and opens the files itself, so the folder must be
one that the driver and all executors see."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "segment_topic"
SCHEMA = "partition int, offset long, value string"


def write_topic(messages: DataFrame, path: str, key: str, value: str, partitions: int = 4, segment_rows: int = 100_000,
                order: list[str] | None = None) -> None:
    """``messages`` as a topic: partition by a hash of the key, offsets in the
    order given (by default key, then value)."""
    from tessera.operators.numbering import positions_within
    rows = messages.select(F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int").alias("partition"), *dict.fromkeys([key, value, *(order or [])]))
    placed = positions_within(rows, ["partition"], order or [key, value], out="__at")
    segment = (F.floor(F.col("__at") / segment_rows) * segment_rows).cast("long")
    (placed.select("partition", segment.alias("segment"), "__at", F.col(value).alias("value"))
     .repartition("partition", "segment").sortWithinPartitions("partition", "segment", "__at").select("partition", "segment", "value")
     .write.mode("append").partitionBy("partition", "segment").option("compression", "none").text(path))


def _segments(path: str) -> dict[int, list[tuple[int, str]]]:
    """Per partition the (base offset, file) of its segments, in order."""
    found: dict[int, list] = {}
    for part in os.listdir(path):
        if m := re.fullmatch(r"partition=(\d+)", part):
            for seg in os.listdir(os.path.join(path, part)):
                if s := re.fullmatch(r"segment=(\d+)", seg):
                    folder = os.path.join(path, part, seg)
                    found.setdefault(int(m[1]), []).extend(
                        (int(s[1]), os.path.join(folder, f)) for f in os.listdir(folder) if f.startswith("part-"))
    return {p: sorted(s) for p, s in found.items()}


def _lines(file: str) -> Iterator[str]:
    with open(file, encoding="utf-8", newline="\n") as f:
        for line in f:
            if not line.endswith("\n"):
                return  # a message still being written
            yield line[:-1]


def end_offsets(path: str) -> dict[str, int]:
    """Per partition the offset after its last whole message; only the last
    segment is counted."""
    return {str(p): s[-1][0] + sum(1 for _ in _lines(s[-1][1])) for p, s in _segments(path).items()}


class Part(InputPartition):
    def __init__(self, partition: int, start: int, end: int):
        super().__init__((partition, start, end))
        self.partition, self.start, self.end = partition, start, end


def _parts(start: dict, end: dict) -> list[Part]:
    return [Part(int(p), int(start.get(p, 0)), int(e)) for p, e in sorted(end.items()) if int(start.get(p, 0)) < int(e)]


def _messages(path: str, part: Part | None) -> Iterator[tuple]:
    if part is None:  # a range without partitions
        return
    segments = _segments(path).get(part.partition, [])
    for i, (base, file) in enumerate(segments):
        if base >= part.end or (i + 1 < len(segments) and segments[i + 1][0] <= part.start):
            continue
        for at, line in enumerate(_lines(file), base):
            if at >= part.end:
                return
            if at >= part.start:
                yield part.partition, at, line


def _folder(options: dict) -> str:
    path = options["path"]
    return path[len("file:"):] if path.startswith("file:") else path


class TopicReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.start = _folder(options), json.loads(options.get("startingOffsets", "{}"))
        self.end = json.loads(options["endingOffsets"]) if "endingOffsets" in options else None

    def partitions(self):
        return _parts(self.start, self.end if self.end is not None else end_offsets(self.path))

    def read(self, partition: Part) -> Iterator[tuple]:
        return _messages(self.path, partition)


class TopicStreamReader(DataSourceStreamReader):
    """A batch takes all whole messages that are there when it begins."""

    def __init__(self, options: dict):
        self.path, self.start = _folder(options), json.loads(options.get("startingOffsets", "{}"))

    def initialOffset(self) -> dict:
        return {p: int(o) for p, o in self.start.items()}

    def latestOffset(self) -> dict:
        return end_offsets(self.path)

    def partitions(self, start: dict, end: dict):
        return _parts(start, end)

    def read(self, partition: Part) -> Iterator[tuple]:
        return _messages(self.path, partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class TopicSource(DataSource):
    """``spark.read`` / ``spark.readStream.format("segment_topic")``.  Options:
    ``path``; ``startingOffsets`` and, for a batch, ``endingOffsets`` (JSON,
    offset by partition; without them from 0 to the end)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TopicReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TopicStreamReader(self.options)


def read_topic(spark: SparkSession, path: str, starting: dict | None = None, ending: dict | None = None) -> DataFrame:
    """The messages between the offsets (partition: offset) as a batch."""
    spark.dataSource.register(TopicSource)
    r = spark.read.format(FORMAT).option("startingOffsets", json.dumps(starting or {}))
    if ending is not None:
        r = r.option("endingOffsets", json.dumps(ending))
    return r.load(path)


def topic_stream(spark: SparkSession, path: str, starting: dict | None = None) -> DataFrame:
    spark.dataSource.register(TopicSource)
    return spark.readStream.format(FORMAT).option("startingOffsets", json.dumps(starting or {})).load(path)


def read_until_idle(stream: DataFrame, write: Callable, checkpoint: str, idle_seconds: float = 5.0, max_rows: int | None = None,
                    mode: str = "append", interval: str = "200 milliseconds", poll: float = 0.1) -> int:
    """Runs ``write(batch, number)`` on any stream (this topic's, a broker's)
    until ``max_rows`` input rows were seen or none came for ``idle_seconds``;
    the rows seen.  Whole batches are taken, so the last one may go beyond
    ``max_rows``; a later call with the same checkpoint goes on after it."""
    seen = {"rows": 0, "at": time.monotonic()}
    q = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(processingTime=interval).start())
    done: set[int] = set()
    looked = False  # idle time counts from the first look for rows, however long the start takes
    try:
        while q.isActive:
            status, progress = q.status, q.recentProgress  # in this order: a trigger that has ended has told its rows
            for p in progress:
                if p["numInputRows"] and p["batchId"] not in done:
                    done.add(p["batchId"])
                    seen["rows"] += p["numInputRows"]
                    seen["at"] = time.monotonic()
            if not looked:
                looked, seen["at"] = bool(progress) or status["message"].startswith("Waiting"), time.monotonic()
            busy = status["isTriggerActive"]
            if max_rows is not None and seen["rows"] >= max_rows:
                break
            if not busy and time.monotonic() - seen["at"] >= idle_seconds:
                break
            time.sleep(poll)
        if q.exception() is not None:
            raise q.exception()
    finally:
        q.stop()
    return seen["rows"]
