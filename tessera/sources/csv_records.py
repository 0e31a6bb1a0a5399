"""CSV with quoted line breaks, read in parallel byte ranges.

Spark's text reader cuts files into ranges at line ends; whether a line begins
a record depends on whether a quoted value is open there, and so on all that
comes before.  A first pass reads each range under both assumptions and keeps
what either leaves open at its end, one row a range.  Following these through
a file's ranges settles every range's beginning, and a second pass cuts the
records.  A record across ranges is put together from their ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANGE = "file long, start long, "
_RECORDS = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()), ("text", pa.string())])
#: Kinds of pieces: whole records, a record's rest from the range before, a record that the range leaves open.
WHOLE, REST, OPEN = 0, 1, 2


def ends_open(line: str, open_: bool, sep: str = ",", quote: str = '"') -> bool:
    """Whether a quoted value is open after the line.  A quote opens a value
    only at its start; two are one of the value's own; after the closing one
    the value goes on, unquoted, to the next separator."""
    at = 0
    while True:
        if open_:
            at = line.find(quote, at)
            if at < 0:
                return True
            if line.startswith(quote, at + 1):
                at += 2
                continue
            open_ = False
        elif line.startswith(quote, at):
            open_, at = True, at + 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _ranges(batches: Iterator[pa.RecordBatch], quote: str) -> Iterator[tuple]:
    """(file, start, lines, places of the lines with a quote) of the runs of
    lines of one range."""
    for b in batches:
        if not b.num_rows:
            continue
        file, start = (b.column(i).to_numpy() for i in (0, 1))
        quoted = pc.match_substring(b.column(2), quote).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            yield int(file[i]), int(start[i]), b.column(2).slice(i, j - i), np.flatnonzero(quoted[i:j]).tolist()


def _leaves(batches: Iterator[pa.RecordBatch], sep: str, quote: str) -> Iterator[pa.RecordBatch]:
    """Per range what it leaves open if it begins outside, and inside, a value."""
    done: dict[tuple[int, int], list[bool]] = {}
    for file, start, lines, places in _ranges(batches, quote):
        state = done.setdefault((file, start), [False, True])
        for i in places:
            line, (outside, inside) = lines[i].as_py(), state
            state[0] = ends_open(line, outside, sep, quote)
            state[1] = state[0] if inside == outside else ends_open(line, inside, sep, quote)
    if done:
        yield pa.RecordBatch.from_pydict({"file": [f for f, _ in done], "start": [s for _, s in done],
                                          "outside": [s[0] for s in done.values()], "inside": [s[1] for s in done.values()]})


def _cut(batches: Iterator[pa.RecordBatch], begins_open: frozenset, sep: str, quote: str) -> Iterator[pa.RecordBatch]:
    at, open_, pending, kind, first = None, False, [], WHOLE, False
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out)) or [[]] * len(_RECORDS)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RECORDS)], schema=_RECORDS)

    def close() -> None:
        if pending:
            out.append((*at, REST if kind == REST else OPEN, first, "\n".join(pending)))
            pending.clear()

    for file, start, lines, places in _ranges(batches, quote):
        if at != (file, start):
            close()
            at, open_ = (file, start), (file, start) in begins_open
            kind, first = (REST if open_ else WHOLE), start == 0
        texts, places = lines.to_pylist(), set(places)
        for i, line in enumerate(texts):
            pending.append(line)
            if i in places:
                open_ = ends_open(line, open_, sep, quote)
            if not open_:
                out.append((*at, kind, first, "\n".join(pending)))
                pending.clear()
                kind, first = WHOLE, False
        yield batch()
    close()
    yield batch()


def read_csv_records(spark: SparkSession, path: str, sep: str = ",", quote: str = '"', schema: T.StructType | str | None = None) -> DataFrame:
    """The rows of UTF-8 CSV files with a header line each, as a whole-file
    read gives them (all columns are strings without a ``schema``), but that
    quoted line breaks stay as they are where lines end in CRLF."""
    whole = spark.read.option("header", True).option("sep", sep).option("quote", quote).option("escape", quote).option("multiLine", True)
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    columns = schema or T.StructType([T.StructField(c, T.StringType()) for c in whole.csv(path).columns])
    if not columns.fields:
        return whole.csv(path)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    # one row a range of maxPartitionBytes
    leaves = lines.mapInArrow(lambda it: _leaves(it, sep, quote), _RANGE + "outside boolean, inside boolean")
    begins, before, file = [], False, None
    for r in leaves.orderBy("file", "start").toLocalIterator():
        before = False if r.file != file else before
        file = r.file
        if before:
            begins.append((r.file, r.start))
        before = r.inside if before else r.outside
    shared = spark.sparkContext.broadcast(frozenset(begins))  # at most one pair of numbers a range
    pieces = lines.mapInArrow(lambda it: _cut(it, shared.value, sep, quote), _RANGE + "kind int, first boolean, text string")
    records = pieces.where(F.col("kind") == WHOLE).select("first", "text")
    if begins:
        # a rest belongs to the nearest open end before it; a range's rest comes before its own open end
        order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
        ends = pieces.where(F.col("kind") != WHOLE).withColumn(
            "owner", F.last(F.when(F.col("kind") == OPEN, F.col("start")), ignorenulls=True).over(order))
        joined = ends.groupBy("file", "owner").agg(F.max("first").alias("first"), F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct((F.col("start") - F.col("owner")).alias("at"), "text"))), lambda x: x["text"]), "\n").alias("text"))
        records = records.unionByName(joined.select("first", "text"))
    else:
        records = records.unionByName(pieces.where(F.col("kind") != WHOLE).select("first", "text"))
    text = F.regexp_replace("text", "\r$", "")
    rows = records.where(~F.col("first")).select(text.alias("text")).where("text <> ''")
    options = {"sep": sep, "quote": quote, "escape": quote, "multiLine": "true"}
    return rows.select(F.from_csv("text", _ddl(columns), options).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
