"""Column profiling: counts, numeric summaries, histograms, top values and
text lengths.

Counts are one wide aggregate.  Distinct counts and top values come from a
long ``(column, value)`` table aggregated with partial (map-side)
aggregation, so a hot value is pre-combined before the shuffle, and the
top-k filter is a ``row_number`` limit that Spark pushes below the shuffle
(``WindowGroupLimit``).  Medians come from ``kth_smallest_many`` (sketch
brackets, then exact counts) instead of a one-task sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import fround
from pyspark.sql import types as T

from tessera.functions.columns import is_blank, is_numeric_type, is_string_type, not_blank
from tessera.operators.quantiles import kth_smallest_many, rank_stats

# Profile sizes, as in the reference.
TOP_K = 20          # top values per categorical column
MAX_BUCKETS = 20    # histogram buckets: min(20, distinct values)


def long_values(df: DataFrame, columns=None) -> DataFrame:
    """``(column, value)`` rows with the string form of every non-blank cell."""
    cols = list(columns or df.columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return (df.select(F.explode(pairs).alias("p"))
            .select("p.column", "p.value")
            .where(F.col("value").isNotNull() & (F.col("value") != "")))


LONG_VALUE_CHARS = 32


def value_counts(df: DataFrame, columns=None) -> DataFrame:
    return long_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def distinct_key(value: Column, hash_over: int | None = LONG_VALUE_CHARS) -> Column:
    """Distinct-counting key: values of up to ``hash_over`` characters as they
    are (None: all of them, exactly); longer ones as two independent 64-bit hashes plus the length, so counting the distinct
    texts of a large column shuffles 24 bytes per value instead of the text
    (two values collide only if both hashes and the length agree)."""
    if hash_over is None:
        return value
    long_v = F.length(value) > hash_over
    return F.struct(F.when(~long_v, value).alias("v"),
                    # the number first: it seeds the hash of the value, so the two differ from the first byte on
                    F.when(long_v, F.xxhash64(F.lit(1), value)).alias("h1"),
                    F.when(long_v, F.xxhash64(F.lit(2), value)).alias("h2"),
                    F.when(long_v, F.length(value)).alias("n"))


def profile_counts(df: DataFrame, approx_unique: bool = False, hash_over: int | None = LONG_VALUE_CHARS) -> DataFrame:
    """column, count, null_count, null_pct (1 dp), unique, row_count, col_count.
    ``approx_unique`` swaps the exact distinct count for a HyperLogLog++
    sketch (no shuffle of distinct values); ``hash_over``: see ``distinct_key``."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count_if(is_blank(df, c)).alias(f"__b{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', `__b{i}`" for i, c in enumerate(cols))
    nulls = wide.selectExpr("__n", f"stack({len(cols)}, {stack}) AS (column, null_count)")
    if approx_unique:
        uniq = long_values(df).groupBy("column").agg(F.approx_count_distinct("value").alias("unique"))
    else:
        keyed = long_values(df).select("column", distinct_key(F.col("value"), hash_over).alias("k"))
        uniq = keyed.groupBy("column", "k").agg(F.count(F.lit(1)).alias("c")) \
            .groupBy("column").agg(F.count(F.lit(1)).alias("unique"))
    out = nulls.join(uniq, "column", "left")
    return out.select(
        "column",
        F.col("__n").cast("bigint").alias("count"),
        F.col("null_count").cast("bigint").alias("null_count"),
        F.when(F.col("__n") > 0, fround(F.col("null_count") / F.col("__n") * 100, 1)).otherwise(F.lit(0.0))
        .alias("null_pct"),
        F.coalesce(F.col("unique"), F.lit(0)).cast("bigint").alias("unique"),
        F.col("__n").cast("bigint").alias("row_count"),
        F.lit(len(cols)).cast("bigint").alias("col_count"))


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns whose every non-blank value reads as a float (one aggregate)."""
    cands = [f.name for f in df.schema.fields
             if is_numeric_type(f.dataType) or is_string_type(f.dataType) or isinstance(f.dataType, T.BooleanType)]
    strs = [c for c in cands if is_string_type(df.schema[c].dataType)]
    out = [c for c in cands if not is_string_type(df.schema[c].dataType)
           and not isinstance(df.schema[c].dataType, T.BooleanType)]
    if strs:
        row = df.agg(*[F.count_if(not_blank(df, c) & F.col(c).try_cast("double").isNull()).alias(c) for c in strs],
                     *[F.count_if(not_blank(df, c)).alias(f"__nb_{c}") for c in strs]).first()
        out += [c for c in strs if row[c] == 0 and row[f"__nb_{c}"] > 0]
    return [c for c in df.columns if c in out]


def numeric_profile(df: DataFrame, columns=None) -> DataFrame:
    """column, min, max, mean (4 dp), median (upper, exact)."""
    spark = df.sparkSession
    if columns is None:
        # candidates: numeric columns, and string columns whose every non-blank
        # value reads as a float - tested in the same aggregate as the stats
        cols = [f.name for f in df.schema.fields if is_numeric_type(f.dataType) or is_string_type(f.dataType)]
    else:
        cols = list(columns)
    aggs = []
    for i, c in enumerate(cols):
        x = _as_double(df, c)
        known = F.when(~F.isnan(x), x)
        aggs += [F.min(known).alias(f"min{i}"), F.max(known).alias(f"max{i}"), F.avg(known).alias(f"avg{i}"),
                 F.count(x).alias(f"n{i}"), F.count(known).alias(f"known{i}")]
        aggs += [a.alias(f"s{i}_{k}") for k, a in enumerate(rank_stats(x))]
        if is_string_type(df.schema[c].dataType):
            aggs.append(F.count_if(not_blank(df, c)).alias(f"nb{i}"))
    row = df.agg(*aggs).first() if cols else None
    # a string column is numeric if every non-blank value reads as a number; NaN values do not count
    place = {c: i for i, c in enumerate(cols) if row[f"known{i}"] and (
        columns is not None or not is_string_type(df.schema[c].dataType) or row[f"n{i}"] == row[f"nb{i}"])}
    # all medians in one second pass
    num = df.select(*[_as_double(df, c).alias(c) for c in place])
    meds = kth_smallest_many(num, {c: [row[f"known{i}"] // 2] for c, i in place.items()},
                             stats={c: [row[f"s{i}_{k}"] for k in range(6)] for c, i in place.items()}) if place else {}
    rows = [(c, float(row[f"min{i}"]), float(row[f"max{i}"]), float(row[f"avg{i}"]), float(meds[(c, row[f"known{i}"] // 2)]))
            for c, i in place.items()]
    schema = "column string, min double, max double, mean double, median double"
    out = spark.createDataFrame(rows, schema)  # one row per column: bounded by the schema width
    return out.withColumn("mean", fround("mean", 4))


def _as_double(df: DataFrame, c: str) -> Column:
    return F.col(c).try_cast("double") if is_string_type(df.schema[c].dataType) else F.col(c).cast("double")


def histograms(df: DataFrame, columns: list[str], max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """``column, bucket, label, count`` for several columns in two passes.

    Equal-width buckets: ``min(max_buckets, distinct)`` buckets, the last one
    closed; labels are left edges (2 dp); no rows for a column with one
    distinct value.  Null, NaN and infinite values do not count."""
    spark = df.sparkSession
    inf = float("inf")
    xs = {c: F.when(F.abs(_as_double(df, c)) < F.lit(inf), _as_double(df, c)) for c in columns}
    row = df.agg(*[a for i, x in enumerate(xs.values()) for a in (
        F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.approx_count_distinct(x).alias(f"nd{i}"))]).first()
    # the sketch settles all but columns with few values, which are cheap to count
    few = [i for i in range(len(columns)) if row[f"nd{i}"] <= 10 * max_buckets]
    exact = df.agg(*[F.count_distinct(list(xs.values())[i]).alias(f"d{i}") for i in few]).first() if few else None
    bounds = []
    for i, c in enumerate(columns):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        nb = min(max_buckets, exact[f"d{i}"]) if i in few else max_buckets
        if lo is not None and nb > 1 and hi / nb - lo / nb > 0:
            bounds.append((c, float(lo), (float(hi) - float(lo)) / nb, nb))
    if not bounds:
        return spark.createDataFrame([], "column string, bucket bigint, label double, count bigint")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.when(
        xs[c].isNotNull(), F.least(F.floor((xs[c] - F.lit(lo)) / F.lit(step)), F.lit(nb - 1))).cast("bigint").alias("bucket"))
        for c, lo, step, nb in bounds])
    counts = (df.select(F.explode(cells).alias("h")).where("h.bucket is not null")
              .groupBy("h.column", "h.bucket").agg(F.count(F.lit(1)).alias("count")))
    grid = spark.createDataFrame(bounds, "column string, lo double, step double, nb int") \
        .select("column", "lo", "step", F.explode(F.expr("sequence(0L, cast(nb - 1 as bigint))")).alias("bucket"))
    return (grid.join(counts, ["column", "bucket"], "left")
            .select("column", "bucket", fround(F.col("lo") + F.col("bucket") * F.col("step"), 2).alias("label"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def histogram(df: DataFrame, column: str, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """``bucket, label, count`` of one column (see ``histograms``)."""
    return histograms(df, [column], max_buckets).drop("column")


#: Values a frequent-items sketch tracks, and candidates it may name per column.
TRACKED, CANDIDATES = 10_000, 64
#: A value that the sketch does not name occurs in at most this part of the
#: rows: twice the sketch's error, 3.5 / (size of its hash table).
UNNAMED = 2 * 3.5 / 16_384


def frequent_values(df: DataFrame, columns: list[str], k: int, tracked: int = TRACKED, candidates: int = CANDIDATES,
                    unnamed: float = UNNAMED) -> tuple[list, list[str]]:
    """The ``k`` most frequent string forms of the columns where that can be
    proven without counting all values, as rows ``(column, value, count)``, and
    the columns where it cannot.

    One scan builds a mergeable frequent-items sketch per column over 64-bit
    hashes; a second one counts the values of the hashes it names, exactly.
    Any other value occurs no oftener than the sketch's error allows, nor than
    all of what the candidates leave over; the columns whose ``k``-th candidate
    lies above are settled.  Nothing but candidates is shuffled."""
    candidates = max(candidates, 2 * k)
    spark = df.sparkSession
    cells = {c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in columns}
    row = df.agg(*[a for i, v in enumerate(cells.values()) for a in (
        F.count(v).alias(f"n{i}"),
        F.call_function("approx_top_k", F.when(v.isNotNull(), F.xxhash64(v)), F.lit(candidates), F.lit(tracked)).alias(f"t{i}"))]).first()
    named, bound, total = [], {}, {}
    for i, c in enumerate(columns):
        top = [(x["item"], x["count"]) for x in row[f"t{i}"] or [] if x["item"] is not None]
        named += [(c, item) for item, _ in top]
        total[c] = row[f"n{i}"]
        bound[c] = max(unnamed * total[c], top[-1][1] if len(top) >= candidates - 1 else 0)
    of = F.broadcast(spark.createDataFrame(named, "column string, hash bigint"))  # at most ``candidates`` a column
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in cells.items()])
    found = df.select(F.inline(pairs)).where("value is not null").withColumn("hash", F.xxhash64("value")) \
        .join(of, ["column", "hash"]).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")).collect()
    proven, open_ = [], []
    for c in columns:
        rows = sorted(((r["column"], r["value"], r["count"]) for r in found if r["column"] == c), key=lambda r: (-r[2], r[1].encode()))
        rest = total[c] - sum(r[2] for r in rows)
        if rest == 0 or (len(rows) >= k and rows[k - 1][2] > min(rest, bound[c])):
            proven += rows[:k]
        else:
            open_.append(c)
    return proven, open_


def top_values(df: DataFrame, columns=None, k: int = TOP_K, **sketch) -> DataFrame:
    """column, value, count, rank: the ``k`` most frequent string forms per
    column (count desc, value asc).  Columns that ``frequent_values`` settles
    shuffle their candidates only; the others are counted in full."""
    cols = list(columns or df.columns)
    proven, rest = frequent_values(df, cols, k, **sketch)
    vc = df.sparkSession.createDataFrame(proven, "column string, value string, count bigint")
    if rest:
        vc = vc.unionByName(value_counts(df, rest))
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc())
    return (vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("column", "value", F.col("count").cast("bigint").alias("count"),
                    F.col("rank").cast("bigint").alias("rank")))


def text_lengths(df: DataFrame, columns=None) -> DataFrame:
    """column, avg_length (1 dp), max_length over non-blank string forms."""
    lv = long_values(df, columns)
    return lv.groupBy("column").agg(fround(F.avg(F.length("value")), 1).alias("avg_length"),
                                    F.max(F.length("value")).cast("bigint").alias("max_length"))


def categorical_columns(df: DataFrame) -> list[str]:
    num = set(numeric_columns(df))
    return [c for c in df.columns if c not in num]


def label_distribution(df: DataFrame, label: str = "label", fallback: str = "difficulty") -> DataFrame:
    """Samples per label; the key falls back to ``difficulty`` then "unknown"."""
    key = F.coalesce(*[F.col(c).cast("string") for c in (label, fallback) if c in df.columns], F.lit("unknown"))
    return df.groupBy(key.alias("label")).agg(F.count(F.lit(1)).cast("bigint").alias("count"))


def profile(df: DataFrame) -> dict:
    """Driver-side summary for pipeline stats: a fixed number of passes over
    the input, whatever its number of columns; all that comes back are
    aggregates.  Checkpoint an expensive computed input first."""
    counts = {r["column"]: r.asDict() for r in profile_counts(df).collect()}
    num = numeric_columns(df)
    out = {"columns": {}, "row_count": None, "col_count": len(df.columns)}
    for r in numeric_profile(df, num).collect():
        counts[r["column"]].update(type="numeric", min=r["min"], max=r["max"], mean=r["mean"], median=r["median"])
    for r in histograms(df, num).orderBy("column", "bucket").collect() if num else []:
        h = counts[r["column"]].setdefault("histogram", {"labels": [], "counts": []})
        h["labels"].append(r["label"])
        h["counts"].append(r["count"])
    cat = [c for c in df.columns if c not in num]
    if cat:
        for r in top_values(df, cat).orderBy("column", "rank").collect():
            counts[r["column"]].setdefault("top_values", []).append({"value": r["value"], "count": r["count"]})
        for r in text_lengths(df, cat).collect():
            counts[r["column"]].update(avg_length=r["avg_length"], max_length=r["max_length"])
    for c in df.columns:
        st = counts[c]
        if "type" not in st:
            st["type"] = "categorical" if st.get("null_count", 0) < st.get("count", 0) else "empty"
        out["row_count"] = st.get("row_count")
        out["columns"][c] = st
    return out
