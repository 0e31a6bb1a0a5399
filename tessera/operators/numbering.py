"""Global positions, prefix sums and look-backs without a single-task window.

``Window.orderBy(...)`` with no partition moves every row to one task.  Here
Spark's own range partitioning cuts the rows, on the real values of all order
columns (nulls and NaN where the sort puts them) and a tie-break, into cells
of at most about ``CELL_ROWS`` rows; each cell is sorted, and the table of
numbered rows is checkpointed once.  What lies before a cell comes from a
table with one row per cell, or per (cell, key); keys are compared null-safe.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.numeric import fdigits
from tessera.session import checkpoint_dir

CELL_ROWS = 1_000_000


def _hashable(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _hashable(t.elementType)
    if isinstance(t, T.StructType):
        return all(_hashable(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.VariantType))


def row_tie(df: DataFrame) -> Column:
    """The tie-break: a hash of the row."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)])


def cells(df: DataFrame, order: list, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` with ``__cell`` and ``__row`` (0-based in its cell): cells in
    order, rows in order, equal rows by a hash of the row.  Rows equal in
    everything are cut too, so no value can fill a cell beyond its size."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // cell_rows))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    tied = df.withColumn("__tie", row_tie(df)).withColumn("__id", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(n, *cols, "__tie", "__id").sortWithinPartitions(*cols, "__tie", "__id")
    at = F.monotonically_increasing_id()  # partition in the upper bits, row in the lower 33
    return (ranged.withColumn("__at", at).withColumn("__cell", F.shiftright("__at", 33))
            .withColumn("__row", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1).cast("long")))
            .drop("__tie", "__id", "__at").checkpoint())


def same_keys(left: str, right: str, keys: list[str], also: list[str] = ()) -> Column:
    """Null-safe equality of ``keys``, plain equality of ``also``."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
                  + [F.col(f"{left}.{k}") == F.col(f"{right}.{k}") for k in also])


def with_keys(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined with ``other`` on ``keys``, nulls matching nulls; the
    columns of ``df``, then the rest of ``other``'s."""
    j = df.alias("l").join(other.alias("r"), same_keys("l", "r", keys), how)
    return j.select("l.*", *[F.col(f"r.{c}") for c in other.columns if c not in keys])


def _with_cells(df: DataFrame, per_cell: DataFrame, keys: list[str]) -> DataFrame:
    j = df.alias("l").join(per_cell.alias("r"), same_keys("l", "r", keys, ["__cell"]))
    return j.select("l.*", *[F.col(f"r.{c}") for c in per_cell.columns if c not in (*keys, "__cell")])


def _before_cells(numbered: DataFrame, value: Column) -> DataFrame:
    """``__cell, __base``: the sum of ``value`` over all earlier cells."""
    totals = numbered.groupBy("__cell").agg(F.sum(value).alias("__t"))
    earlier = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("__cell", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__base"))


def prefix_sum(df: DataFrame, order: list, weight: Column | str | None = None, *, out: str = "offset",
               number: str | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Add ``out`` = sum of ``weight`` (default 1; null counts 0) over all rows
    strictly before this one in ``order`` (column names, or sort columns), and
    the row number as ``number`` if named."""
    if weight is None:
        numbered = cells(df, order, cell_rows)
        within = F.col("__row")
        base = _before_cells(numbered, F.lit(1).cast("long"))
    else:
        w = F.col(weight) if isinstance(weight, str) else weight
        numbered = cells(df.withColumn("__w", F.coalesce(w.cast("long"), F.lit(0).cast("long"))), order, cell_rows)
        within = F.coalesce(F.sum("__w").over(Window.partitionBy("__cell").orderBy("__row")
                                              .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        base = _before_cells(numbered, F.col("__w"))
    if number:
        base = base.join(_before_cells(numbered, F.lit(1).cast("long")).withColumnRenamed("__base", "__rows"), "__cell")
    # one row per cell: rows / CELL_ROWS, or the number of shuffle partitions
    j = numbered.join(F.broadcast(base), "__cell").withColumn(out, (F.col("__base") + within).cast("long"))
    if number:
        j = j.withColumn(number, (F.col("__rows") + F.col("__row")).cast("long"))
    new = [out, *([number] if number else [])]
    return j.select(*[c for c in df.columns if c not in new], *new)


def offsets_by_key(df: DataFrame, keys: list[str], weight: Column | str | None = None, *, out: str = "offset",
                   number: str | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``prefix_sum`` in the order of ``keys`` for wide rows with one row per
    key: only ``keys`` and the weight are sorted, hashed and checkpointed, and
    the rows meet their offsets in one join.  Rows that share a key take the
    wide way, where a hash of the row breaks the tie.  ``df`` is read twice, so
    hand over one that is written down if it is costly."""
    w = F.lit(1) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    placed = prefix_sum(df.select(*keys, w.cast("long").alias("__w")), keys, "__w", out=out, number=number,
                        cell_rows=cell_rows).drop("__w")
    if placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").limit(1).count():
        return prefix_sum(df, keys, weight if weight is not None else None, out=out, number=number, cell_rows=cell_rows)
    return with_keys(df, placed, keys)


def row_numbers(df: DataFrame, order: list, *, out: str = "row_id") -> DataFrame:
    """0-based global row number in ``order``."""
    return prefix_sum(df, order, None, out=out)


def _keyed_cells(df: DataFrame, keys: list[str], order: list, cell_rows: int, *aggs: Column) -> tuple[DataFrame, DataFrame]:
    """The cells of ``keys, order``, and per (cell, key) the first row, the
    count, ``aggs``, and ``__pos0``: the key's rows in earlier cells.  A key
    has at most one row per cell there, however many rows it has."""
    numbered = cells(df, [*keys, *order], cell_rows)
    per = numbered.groupBy("__cell", *keys).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"), *aggs)
    earlier = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    return numbered, per.withColumn("__pos0", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))


def positions_within(df: DataFrame, keys: list[str], order: list, *, out: str = "pos",
                     cell_rows: int = CELL_ROWS) -> DataFrame:
    """0-based position of each row inside its ``keys`` group in ``order``;
    a null key is a group.  A group of any size is numbered by many tasks."""
    numbered, per = _keyed_cells(df, keys, order, cell_rows)
    placed = _with_cells(numbered, per.select("__cell", *keys, "__first", "__pos0"), keys)
    return placed.withColumn(out, (F.col("__row") - F.col("__first") + F.col("__pos0")).cast("long")) \
        .drop("__cell", "__row", "__first", "__pos0")


def lag_within(df: DataFrame, keys: list[str], order: list, value: str, *, out: str, pos: str = "pos",
               cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds ``pos`` and ``out``, the ``value`` of the previous row of the group:
    a lag inside the cell, and the last value of the key's previous cell."""
    numbered, per = _keyed_cells(df, keys, order, cell_rows, F.max_by(F.struct(value), "__row").alias("__last"))
    per = per.withColumn("__carry", F.lag(F.col("__last")[value]).over(Window.partitionBy(*keys).orderBy("__cell")))
    j = _with_cells(numbered, per.drop("__last", "__n"), keys)
    inside = F.lag(value).over(Window.partitionBy("__cell", *keys).orderBy("__row"))
    return (j.withColumn(out, F.when(F.col("__row") == F.col("__first"), F.col("__carry")).otherwise(inside))
            .withColumn(pos, (F.col("__row") - F.col("__first") + F.col("__pos0")).cast("long"))
            .drop("__cell", "__row", "__first", "__pos0", "__carry"))


def trailing_mean(df: DataFrame, keys: list[str], order: list, value: str, window: int, *, out: str, pos: str = "pos",
                  cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds ``pos``, ``out`` (mean of the last ``window`` values of the group,
    this row included; nulls do not count) and ``__total`` (the group's rows).

    The last ``window - 1`` rows before a cell are copied into it, so that the
    window runs inside cells; no self-join."""
    numbered, per = _keyed_cells(df, keys, order, cell_rows)
    by_key = Window.partitionBy(*keys)
    later = by_key.orderBy("__cell").rowsBetween(1, window - 1) if window > 1 else by_key.orderBy("__cell").rowsBetween(1, 1)
    end = F.col("__pos0") + F.col("__n")
    # the key's next cells that start within reach of this one's last rows: fewer than ``window``
    reach = F.filter(F.collect_list(F.struct(F.col("__cell").alias("c"), F.col("__pos0").alias("p"))).over(later),
                     lambda x: x["p"] < F.col("__end") + window - 1)
    per = per.withColumn("__end", end).withColumn("__next", reach) \
        .withColumn("__total", F.sum("__n").over(by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    j = _with_cells(numbered, per.drop("__n", "__end"), keys)
    j = j.withColumn(pos, (F.col("__row") - F.col("__first") + F.col("__pos0")).cast("long"))
    needed = F.transform(F.filter("__next", lambda x: x["p"] < F.col(pos) + window), lambda x: x["c"])
    copies = j.withColumn("__to", F.explode(F.concat(F.array("__cell"), needed)))
    w = Window.partitionBy("__to", *keys).orderBy(pos).rowsBetween(-(window - 1), 0)
    x = F.col(value).cast("double")
    return (copies.withColumn(out, fdigits(F.sum(x).over(w)) / F.count(x).over(w)).filter(F.col("__to") == F.col("__cell"))
            .drop("__cell", "__row", "__first", "__pos0", "__next", "__to"))


def fill_forward_backward(df: DataFrame, keys: list[str], order: list, value: str, backward: bool = False,
                          out: str | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Last (or next) non-null ``value`` in ``order`` within ``keys`` (a null
    key is a group).  Each cell fills locally; the value carried into a cell is
    the last (first) non-null one of the key's earlier (later) cells."""
    out = out or value
    v, at = F.col(value), F.when(F.col(value).isNotNull(), F.col("__row"))
    edge = (F.min_by if backward else F.max_by)(v, at).alias("__edge")
    numbered, per = _keyed_cells(df, keys, order, cell_rows, edge)
    by_cell = Window.partitionBy(*keys).orderBy("__cell") if keys else Window.orderBy("__cell")
    inside = Window.partitionBy("__cell", *keys).orderBy("__row")
    if backward:
        carry = F.first("__edge", ignorenulls=True).over(by_cell.rowsBetween(1, Window.unboundedFollowing))
        local = F.first(v, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    else:
        carry = F.last("__edge", ignorenulls=True).over(by_cell.rowsBetween(Window.unboundedPreceding, -1))
        local = F.last(v, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    j = _with_cells(numbered, per.select("__cell", *keys, carry.alias("__carry")), keys)
    return j.withColumn(out, F.coalesce(local, F.col("__carry"))).select(*[c for c in df.columns if c != out], out) \
        if out != value else j.withColumn(value, F.coalesce(local, F.col("__carry"))).select(*df.columns)
