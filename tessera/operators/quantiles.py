"""Exact order statistics without holding a column in one task.

``percentile_disc`` / ``mode`` keep a map of every distinct value of the
group in the final aggregation task, which does not survive a 100 TB column.
``kth_smallest_many`` reads the input twice, whatever the number of columns
and ranks.  The first pass builds a mergeable KLL sketch per column (a few KB,
merged like any partial aggregate), which brackets each rank.  The second pass
counts exactly what lies below a bracket and the distinct values inside it,
about a hundredth of the column.  Few of these are sorted on the driver; more
are written once, and equal-width bucket counts narrow that small table.  A
bracket that the counts prove wrong is widened to the whole range.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir

#: Size of the sketches; a rank's error is below ``rank_error`` of all values.
SKETCH_K = 2048
_STATS = 6


def rank_error(k: int) -> float:
    """Twice the 99 % bound of a KLL sketch's normalised rank error."""
    return 2 * 2.296 / k ** 0.9021


@dataclass
class _Target:
    col: int
    k: int  # rank among the finite values, then among those of the bracket
    n: int
    lo: float
    hi: float
    whole: bool = False
    value: float | None = None
    rest: int = 0  # rank left among the values from ``lo`` to ``hi``
    rows: int = 0

    def width(self, buckets: int, collect_limit: int) -> float:
        """Bucket width; 0: count distinct values."""
        w = self.hi / buckets - self.lo / buckets  # the difference itself may overflow
        return 0.0 if self.rows <= collect_limit or self.lo + w <= self.lo or self.hi - w >= self.hi else w


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def rank_stats(x: Column, sketch_k: int = SKETCH_K) -> list[Column]:
    """Aggregates that ``kth_smallest_many`` takes as ``stats`` of a double:
    finite count, least, greatest, the counts of both infinities, the sketch."""
    inf, real = float("inf"), _finite(x)
    return [F.count(real), F.min(real), F.max(real), F.count_if(x == F.lit(-inf)), F.count_if(x == F.lit(inf)),
            F.kll_sketch_agg_double(real, F.lit(sketch_k))]


def known_count(stats: list) -> int:
    """Values that are neither null nor NaN, from ``rank_stats``."""
    return (stats[0] or 0) + (stats[3] or 0) + (stats[4] or 0)


def _brackets(df: DataFrame, targets: list[_Target], sketches: dict[int, bytes], error: float) -> None:
    """Narrow every target's range to the sketch's quantiles around its rank."""
    if not targets:
        return
    row = df.sparkSession.createDataFrame([tuple(bytes(s) for s in sketches.values())],
                                          ", ".join(f"s{c} binary" for c in sketches))

    def quantile(t: _Target, rank: float) -> Column:
        return F.kll_sketch_get_quantile_double(F.col(f"s{t.col}"), F.lit(min(1.0, max(0.0, rank))).cast("double"))
    ends = row.select(*[quantile(t, (t.k + 0.5) / t.n + side).alias(f"q{i}_{j}") for i, t in enumerate(targets)
                        for j, side in enumerate((-error, error))]).first()
    for i, t in enumerate(targets):
        at = (t.k + 0.5) / t.n
        if at - error > 0:
            t.lo = max(t.lo, ends[f"q{i}_0"])
        if at + error < 1:
            t.hi = min(t.hi, ends[f"q{i}_1"])


def _counted(df: DataFrame, xs: list[Column], targets: list[_Target]) -> DataFrame:
    """``t, v, n``: how often each distinct value of a target's bracket occurs;
    a null ``v`` counts what lies below."""
    def hit(i: int, t: _Target) -> Column:
        x = _finite(xs[t.col])
        return F.when(x <= F.lit(t.hi), F.struct(F.lit(i).alias("t"), F.when(x >= F.lit(t.lo), x).alias("v")))
    return (df.select(F.inline(F.array(*[hit(i, t) for i, t in enumerate(targets)]))).where(F.col("t").isNotNull())
            .groupBy("t", "v").agg(F.count(F.lit(1)).alias("n")))


def _walk(rows: list, rank: int) -> float | None:
    """The value of that rank among ``(v, n)`` rows."""
    for v, n in sorted(rows):
        if rank < n:
            return v
        rank -= n
    return None


def _settle(targets: list[_Target], table: DataFrame, buckets: int, collect_limit: int) -> None:
    """Values of the targets from their distinct-value counts, by narrowing."""
    spark = table.sparkSession
    sizes = table.groupBy("t").agg(F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("below"),
                                   F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).alias("inside"), F.count("v").alias("rows"),
                                   F.min("v").alias("lo"), F.max("v").alias("hi"))
    live = []
    for r in sizes.collect():  # one row per target
        t = targets[r.t]
        t.rest, t.rows, t.lo, t.hi = t.k - (r.below or 0), r.rows, r.lo, r.hi
        if 0 <= t.rest < (r.inside or 0):
            live.append(r.t)
    while live:
        done = [i for i in live if targets[i].lo == targets[i].hi]
        for i in done:
            targets[i].value = targets[i].lo
        live = [i for i in live if i not in done]
        if not live:
            return
        spec = [(i, targets[i].lo, targets[i].hi, targets[i].width(buckets, collect_limit)) for i in live]
        part = table.join(F.broadcast(spark.createDataFrame(spec, "t int, lo double, hi double, w double")), "t") \
            .where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        bucket = F.when(F.col("w") == 0, F.col("v")).otherwise(
            F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")).cast("double"), F.lit(float(buckets - 1))))
        counts = part.groupBy("t", bucket.alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"),
                                                          F.min("v").alias("lo"), F.max("v").alias("hi"))
        per: dict[int, list] = {}
        for r in counts.collect():  # per target at most ``buckets`` rows, or ``collect_limit`` distinct values
            per.setdefault(r.t, []).append(r)
        for i in live:
            t = targets[i]
            for r in sorted(per[i], key=lambda r: r.lo):
                if t.rest < r.n:
                    t.lo, t.hi, t.rows = r.lo, r.hi, r.rows
                    break
                t.rest -= r.n


def kth_smallest_many(df: DataFrame, requests: dict, *, buckets: int = 4096, collect_limit: int = 50_000,
                      stats: dict | None = None, sketch_k: int = SKETCH_K, error: float | None = None) -> dict:
    """``requests``: {column name or Column: [0-based ranks]} over the values
    that are neither null nor NaN.  Returns {(column key, rank): value or
    None}.  ``stats`` ({column key: ``rank_stats`` values}) spares the first
    pass when the caller already has it."""
    keys = list(requests)
    xs = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in keys]
    if stats is None:
        row = df.agg(*[a.alias(f"s{i}_{j}") for i, x in enumerate(xs) for j, a in enumerate(rank_stats(x, sketch_k))]).first()
        stats = {key: [row[f"s{i}_{j}"] for j in range(_STATS)] for i, key in enumerate(keys)}
    error = rank_error(sketch_k) if error is None else error
    out: dict = {}
    targets: list[tuple[object, int, _Target]] = []
    for i, key in enumerate(keys):
        n, lo, hi, below, above, _ = stats[key]
        for k in requests[key]:
            if k < 0 or k >= n + below + above:
                out[(key, k)] = None
            elif k < below or k >= below + n:
                out[(key, k)] = -math.inf if k < below else math.inf
            else:
                targets.append((key, k, _Target(i, k - below, n, float(lo), float(hi))))
    whole = {id(t): (t.lo, t.hi) for _, _, t in targets}
    _brackets(df, [t for _, _, t in targets], {t.col: stats[key][5] for key, _, t in targets}, error)
    live = [t for _, _, t in targets]
    while live:
        counts = _counted(df, xs, live)
        if sum(t.n if t.whole else 2 * error * t.n for t in live) <= collect_limit:
            rows = counts.collect()  # about the expected number of rows
            for i, t in enumerate(live):
                t.rest = t.k - sum(r.n for r in rows if r.t == i and r.v is None)
                t.value = _walk([(r.v, r.n) for r in rows if r.t == i and r.v is not None], t.rest) if t.rest >= 0 else None
        else:
            checkpoint_dir(df.sparkSession)
            _settle(live, counts.checkpoint(), buckets, collect_limit)
        live = [t for t in live if t.value is None and not t.whole]
        for t in live:  # the sketch's bracket does not hold the rank
            t.whole = True
            t.lo, t.hi = whole[id(t)]
    out.update({(key, k): t.value for key, k, t in targets})
    return out


def kth_smallest(df: DataFrame, column: str | Column, ks: list[int], **kw) -> list:
    res = kth_smallest_many(df, {column: list(ks)}, **kw)
    return [res[(column, k)] for k in ks]


def upper_median(df: DataFrame, column: str, sketch_k: int = SKETCH_K, **kw):
    """``sorted(values)[n // 2]`` over the values that are neither null nor NaN."""
    stats = list(df.agg(*[a.alias(f"s{j}") for j, a in enumerate(rank_stats(F.col(column).cast("double"), sketch_k))]).first())
    n = known_count(stats)
    return kth_smallest(df, column, [n // 2], stats={column: stats}, sketch_k=sketch_k, **kw)[0] if n else None
