"""Keyed state on streams: one state row per key (``transformWithState``),
timers that let idle keys go, and a sink with one row per key in which a
replayed batch changes nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Fixed value: the provider that keeps state in RocksDB, as this operator needs it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _value(state) -> tuple | None:
    return tuple(state.get()) if state.exists() else None


class Latest(StatefulProcessor):
    """The row of greatest ``order`` per key; emits a key's row whenever a
    batch changes it, and once more, marked as gone, when the key was idle for
    ``idle_ms`` (processing time; None: never).  Rows with a text in ``raw``
    leave the state alone and pass through."""

    def __init__(self, key: str, order: str, fields: list[str], schema: T.StructType, idle_ms: int | None, raw: str | None):
        self.key, self.order, self.fields, self.schema, self.idle_ms, self.raw = key, order, fields, schema, idle_ms, raw

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", T.StructType([self.schema[f] for f in self.fields]))

    def _plain(self, field: str, x):
        """A pandas cell as the Python value of its column's type (a column
        with nulls turns whole numbers into floats)."""
        if pd.isna(x):
            return None
        return int(x) if isinstance(self.schema[field].dataType, T.IntegralType) else x.item() if hasattr(x, "item") else x

    def _row(self, key, values, gone: bool) -> pd.DataFrame:
        row = {self.key: [key[0]], **{f: [x] for f, x in zip(self.fields, values)}, "gone": [gone]}
        return pd.DataFrame({**row, self.raw: [None]} if self.raw else row)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best, place = _value(self.state), self.fields.index(self.order)
        changed = seen = False
        for batch in rows:
            if self.raw:
                passed = batch.loc[batch[self.raw].notna(), self.raw]
                if len(passed):
                    yield pd.DataFrame({self.key: key[0], **{f: None for f in self.fields}, "gone": False, self.raw: passed.tolist()})
                batch = batch.loc[batch[self.raw].isna()]
            batch = batch.loc[batch[self.order].notna()]
            if not len(batch):
                continue
            seen, top = True, batch[self.order].idxmax()
            if best is None or batch[self.order][top] > best[place]:
                best, changed = tuple(self._plain(f, batch[f][top]) for f in self.fields), True
        if seen and self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if changed:
            self.state.update(best)
            yield self._row(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = _value(self.state)
        self.state.clear()
        yield self._row(key, last or [None] * len(self.fields), True)

    def close(self) -> None:
        pass


def _stateful(events: DataFrame, key: str, processor: StatefulProcessor, out: T.StructType, timers: bool) -> DataFrame:
    events.sparkSession.conf.set(*STATE_STORE)
    return events.groupBy(key).transformWithStateInPandas(processor, out, "Update", "ProcessingTime" if timers else "None")


def latest_rows(events: DataFrame, key: str, order: str, fields: list[str], idle_ms: int | None = None,
                raw: str | None = None) -> DataFrame:
    """The changed keys of each batch: ``key, fields..., gone``.  ``order`` is
    one of ``fields``; rows with a null order do not count.  ``raw`` names a
    text column whose rows pass through in it (give them keys that spread)."""
    rows = events.select(key, *fields, *([raw] if raw else []))
    out = T.StructType([rows.schema[key], *[rows.schema[f] for f in fields], T.StructField("gone", T.BooleanType()),
                        *([T.StructField(raw, T.StringType())] if raw else [])])
    return _stateful(rows, key, Latest(key, order, fields, rows.schema, idle_ms, raw), out, idle_ms is not None)


def running_summary(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The changed keys of each batch: ``key, steps, known, total, least, last``.
    A streaming aggregate, one state row per key: a batch's rows are summed up
    before they meet the state, and no key costs a call of Python."""
    events.sparkSession.conf.set(*STATE_STORE)
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))  # NaN is no value
    return events.withColumn("__v", v).groupBy(key).agg(
        F.count(F.lit(1)).alias("steps"), F.count("__v").alias("known"), F.coalesce(F.sum("__v"), F.lit(0.0)).alias("total"),
        F.min("__v").alias("least"), F.max(F.col(order).cast("long")).alias("last"))


class KeyedSink:
    """A table with one row per key, kept up to date by batches of changed
    keys.  Two folders take turns: a batch is merged with the current one into
    the other, and a log row makes that the current one.  A batch whose number
    the log has is left out, so a replay changes nothing; one that died before
    its log row is simply written again.  Any store that Spark writes to will do."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, gone: str | None = None):
        self.spark, self.path, self.key, self.gone = spark, path.rstrip("/"), key, gone
        self.schema = T.StructType([f for f in schema.fields if f.name != gone])
        self._log = T.StructType([T.StructField("batch", T.LongType()), T.StructField("turn", T.IntegerType())])
        self.spark.createDataFrame([], self._log).write.mode("append").parquet(f"{self.path}/log")

    def _last(self):
        log = self.spark.read.schema(self._log).parquet(f"{self.path}/log")
        return log.agg(F.max(F.struct("batch", "turn")).alias("l")).first().l

    def read(self) -> DataFrame:
        last = self._last()
        if last is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/table{last.turn}")

    def write(self, batch: DataFrame, number: int) -> None:
        """The ``foreachBatch`` function."""
        last = self._last()
        if last is not None and number <= last.batch:
            return
        turn = 0 if last is None else 1 - last.turn
        batch = batch.persist()
        try:
            rows = batch.where(~F.col(self.gone)).drop(self.gone) if self.gone else batch
            kept = self.read().join(batch.select(F.col(self.key).alias("__k")), F.col(self.key).eqNullSafe(F.col("__k")), "left_anti")
            kept.unionByName(rows.select(*self.schema.names)).write.mode("overwrite").parquet(f"{self.path}/table{turn}")
        finally:
            batch.unpersist()
        self.spark.createDataFrame([(number, turn)], self._log).coalesce(1).write.mode("append").parquet(f"{self.path}/log")


class AppendSink:
    """Rows of batches in a folder per batch: a replayed batch overwrites its own."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={int(number)}")
