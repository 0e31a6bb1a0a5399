"""Training-run log analytics: rolling means, tails, down-sampling, shares,
throughput, epoch / run summaries, layer rules, latency summaries and
leaderboards.

Per-run sequences are cut into sorted cells (``operators.numbering``), so
one huge run is spread over many tasks; a lag or a trailing window runs inside
a cell, with the few rows before it carried or copied in.  A null run is a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import fround

from tessera.operators.numbering import lag_within, positions_within, prefix_sum, trailing_mean, with_keys
from tessera.operators.quantiles import kth_smallest, rank_stats

# Run-log rules and sizes, as in the reference.
DOWNSAMPLE_POINTS = 200          # curves keep every max(1, n // 200)-th point
PERPLEXITY_CAP = 1e6             # perplexity = min(exp(loss), 1e6)
TRAILING_WINDOW = 100            # mean reward over the last 100 episodes
TAIL_N = 100                     # per-layer history tail
SLOW_LAYER_PCT = 30              # slowest layer above 30 % of forward time ...
SLOW_LAYER_CRITICAL_PCT = 50     # ... critical from 50 %
MEMORY_HOG_PCT = 40              # largest layer above 40 % of parameter memory
VANISHING_GRAD = 1e-7            # 0 < grad norm < 1e-7
EXPLODING_GRAD = 100             # grad norm > 100
DEAD_NEURON_PCT = 50             # more than 50 % dead activations
GRAD_WEIGHT_RATIO = 1.0          # grad / weight norm above 1


def rolling_mean(df: DataFrame, run: str, order: list[str], value: str, window: int = TRAILING_WINDOW) -> DataFrame:
    """Adds episode (1-based), mean_<window> (trailing mean of ``value``
    over the last ``window`` rows, 4 dp) and pct (episode / total, 1 dp)."""
    p = trailing_mean(df, [run], order, value, window, out="__mean")
    return p.select(*df.columns, (F.col("pos") + 1).alias("episode"), fround("__mean", 4).alias(f"mean_{window}"),
                    fround((F.col("pos") + 1) / F.col("__total") * 100, 1).alias("pct"))


def tail_n(df: DataFrame, run: str, order_desc: list[str], n: int = TAIL_N) -> DataFrame:
    """Last ``n`` rows per run.  ``row_number() <= n`` is planned as a
    WindowGroupLimit: each map task keeps only its top ``n`` per run before
    the shuffle, so a hot run ships at most n rows per task."""
    w = Window.partitionBy(run).orderBy(*[F.col(c).desc() for c in order_desc])
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def downsample(df: DataFrame, run: str, order: list[str], points: int = DOWNSAMPLE_POINTS) -> DataFrame:
    """Keep every ``max(1, n // points)``-th row of each run (``[::step]``)."""
    p = positions_within(df, [run], order)
    tot = df.groupBy(run).agg(F.count(F.lit(1)).alias("__n"))
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / points))
    return with_keys(p, tot, [run]).where(F.col("pos") % step == 0).drop("__n")


def share_of_total(df: DataFrame, group: str, value: str, out: str = "share_pct", digits: int = 4) -> DataFrame:
    """value / group total * 100; a null group is a group.  The totals are a
    partial aggregate joined back (AQE broadcasts them when small) instead of
    a window that would put a hot group in one task."""
    tot = df.groupBy(group).agg(F.sum(value).alias("__t"))
    return with_keys(df, tot, [group]).withColumn(
        out, fround(F.when(F.col("__t") != 0, F.col(value) / F.col("__t") * 100), digits)).drop("__t")


def throughput(df: DataFrame, run: str, order: list[str], ts: str, tokens: str | None = None) -> DataFrame:
    """step_time_ms from the previous row of the run, steps_per_sec =
    1000 / ms, tokens_per_sec."""
    j = lag_within(df, [run], order, ts, out="__pts")
    us = F.timestamp_diff("MICROSECOND", F.col("__pts"), F.col(ts))
    ms = us / 1000.0
    return j.select(*df.columns, "pos", fround(ms, 3).alias("step_time_ms"),
                    fround(F.when(ms > 0, 1000.0 / ms), 4).alias("steps_per_sec"),
                    *([fround(F.when(ms > 0, F.col(tokens) / (ms / 1000.0)), 4).alias("tokens_per_sec")] if tokens else []))


def epoch_summary(df: DataFrame, run: str, epoch: Column, loss: str, kind: str) -> DataFrame:
    """Per (run, epoch): train loss (mean over batches), val loss (mean of
    validation rows), accuracy = correct / total (null if none), and the
    train perplexity ``min(exp(loss), 1e6)``.  ``kind`` labels a row train /
    val / correct / wrong."""
    k = F.col(kind)
    g = df.groupBy(run, epoch.alias("epoch")).agg(
        F.avg(F.when(k == "train", F.col(loss))).alias("train_loss"),
        F.avg(F.when(k == "val", F.col(loss))).alias("val_loss"),
        F.count_if(k == "correct").alias("__c"), F.count_if(k.isin("correct", "wrong")).alias("__t"))
    return g.select(run, "epoch", fround("train_loss", 6).alias("train_loss"), fround("val_loss", 6).alias("val_loss"),
                    fround(F.when(F.col("__t") > 0, F.col("__c") / F.col("__t")), 4).alias("accuracy"),
                    fround(F.least(F.exp("train_loss"), F.lit(PERPLEXITY_CAP)), 4).alias("train_perplexity"))


def run_summary(epochs: DataFrame, run: str) -> DataFrame:
    """final_* from the last epoch, best val loss (min) / accuracy (max)."""
    return epochs.groupBy(run).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_epochs"),
        F.max_by("train_loss", "epoch").alias("final_train_loss"),
        F.max_by("val_loss", "epoch").alias("final_val_loss"),
        F.max_by("accuracy", "epoch").alias("final_val_acc"),
        F.min("val_loss").alias("best_val_loss"),
        F.max("accuracy").alias("best_val_acc"))


def run_compare(summary: DataFrame, curve: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    """Run summaries with their down-sampled loss curves (a curve has at most
    ~2 x 200 points, so the per-run list is bounded)."""
    c = curve.groupBy(run).agg(F.sort_array(F.collect_list(F.struct(F.col(step).alias("s"), F.col(loss).alias("l"))))
                               .alias("__c"))
    c = c.select(run, F.size("__c").cast("bigint").alias("n_points"),
                 F.array_join(F.transform("__c", lambda x: F.concat(x["s"].cast("string"), F.lit(":"),
                                                                    F.format_string("%.4f", x["l"]))), ";").alias("loss_curve"))
    return with_keys(summary, c, [run], "left")


def layer_issues(cand: DataFrame, run: str, name: str, max_issues: int | None = None) -> DataFrame:
    """Bottleneck rules over per-layer candidates (forward_time_ms,
    memory_mb, grad_norm, dead_neuron_pct, grad_to_weight_ratio): slowest
    layer > 30 % (critical from 50 %), largest memory > 40 %, vanishing
    (0 < g < 1e-7) / exploding (> 100) gradients, > 50 % dead, ratio > 1; in
    rule order, layers in name order (the first ``max_issues`` per run, if given)."""
    def first_by(c: str):
        return F.min_by(name, F.when(F.col(c) > 0, F.struct(-F.col(c), F.col(name))))
    # one aggregate names each run's slowest and largest layer; no window sees all of a run's layers
    tot = cand.groupBy(run).agg(F.sum("forward_time_ms").alias("__tt"), F.sum("memory_mb").alias("__tm"),
                                first_by("forward_time_ms").alias("__slowest"), first_by("memory_mb").alias("__largest"))
    c = with_keys(cand, tot, [run])
    tpct = F.col("forward_time_ms") / F.col("__tt") * 100
    mpct = F.col("memory_mb") / F.col("__tm") * 100

    def issue(cond, group, typ, sev, pct=None):
        return F.when(cond, F.struct(F.lit(group).alias("g"), F.lit(typ).alias("type"),
                                     sev.alias("severity") if not isinstance(sev, str) else F.lit(sev).alias("severity"),
                                     (fround(pct, 1) if pct is not None else F.lit(None).cast("double")).alias("pct")))
    g = F.col("grad_norm")
    rules = F.array(
        issue((F.col(name) == F.col("__slowest")) & (F.col("forward_time_ms") > 0) & (F.col("__tt") > 0) & (tpct > SLOW_LAYER_PCT), 0,
              "slow_layer", F.when(tpct < SLOW_LAYER_CRITICAL_PCT, "warning").otherwise("critical"), tpct),
        issue((F.col(name) == F.col("__largest")) & (F.col("memory_mb") > 0) & (F.col("__tm") > 0) & (mpct > MEMORY_HOG_PCT), 1,
              "memory_hog", "info", mpct),
        issue((g > 0) & (g < VANISHING_GRAD), 2, "vanishing_gradient", "critical"),
        issue(~((g > 0) & (g < VANISHING_GRAD)) & (g > EXPLODING_GRAD), 2, "exploding_gradient", "critical"),
        issue(F.col("dead_neuron_pct") > DEAD_NEURON_PCT, 3, "dead_neurons", "warning"),
        issue(F.col("grad_to_weight_ratio") > GRAD_WEIGHT_RATIO, 4, "high_grad_ratio", "warning"))
    ex = c.select(run, F.col(name).alias("layer"), F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("i"))
    w = Window.partitionBy(run).orderBy("i.g", "layer")
    ranked = ex.withColumn("issue_rank", F.row_number().over(w))
    return ((ranked if max_issues is None else ranked.where(F.col("issue_rank") <= max_issues))
            .select(run, F.col("issue_rank").cast("bigint").alias("issue_rank"), F.col("i.type").alias("type"),
                    F.col("i.severity").alias("severity"), "layer", F.col("i.pct").alias("pct")))


def layer_profile(df: DataFrame, layer: str, time_ms: str) -> DataFrame:
    """name, avg_time_ms (3 dp), calls, time_pct (share of the summed
    averages, 1 dp) - slowest first."""
    g = df.groupBy(layer).agg(F.avg(time_ms).alias("__a"), F.count(F.lit(1)).alias("calls"))
    total = F.lit(g.agg(F.sum("__a")).first()[0])  # one small action
    return (g.select(F.col(layer).alias("name"), fround("__a", 3).alias("avg_time_ms"),
                     F.col("calls").cast("bigint").alias("calls"),
                     fround(F.when(total > 0, F.col("__a") / total * 100).otherwise(F.lit(0.0)), 1).alias("time_pct"))
            .orderBy(F.col("avg_time_ms").desc(), "name"))


def latency_summary(df: DataFrame, value: str) -> DataFrame:
    """mean, median t[n//2], p95 t[int(.95 n)], p99 t[int(.99 n)], min, max
    (3 dp), throughput_per_sec = 1000 / mean (1 dp), n.  Order statistics
    are exact, from two scans."""
    x = F.col(value).cast("double")
    known = F.when(~F.isnan(x), x)
    agg = df.agg(F.count(known).alias("n"), F.avg(known).alias("mean"), F.min(known).alias("mn"),
                 F.max(known).alias("mx"), *[a.alias(f"s{j}") for j, a in enumerate(rank_stats(x))]).first()
    n = agg["n"]
    ks = [n // 2, int(n * 0.95), int(n * 0.99)] if n else []
    stats = {value: [agg[f"s{j}"] for j in range(6)]}
    med, p95, p99 = kth_smallest(df, value, ks, stats=stats) if n else (None, None, None)
    spark = df.sparkSession
    row = [(float(agg["mean"]) if n else None, med, p95, p99,
            float(agg["mn"]) if n else None, float(agg["mx"]) if n else None, int(n))]
    out = spark.createDataFrame(row, "mean double, median double, p95 double, p99 double, mn double, mx double, n bigint")
    return out.select(fround("mean", 3).alias("mean_ms"), fround("median", 3).alias("median_ms"),
                      fround("p95", 3).alias("p95_ms"), fround("p99", 3).alias("p99_ms"),
                      fround("mn", 3).alias("min_ms"), fround("mx", 3).alias("max_ms"),
                      fround(F.when(F.col("mean") > 0, 1000 / F.col("mean")), 1).alias("throughput_per_sec"),
                      F.col("n").alias("n_runs"))


def leaderboard(trials: DataFrame, trial: str, score: str) -> DataFrame:
    """Trials by score desc (trial asc on ties; null and NaN scores last) with
    a global 1-based rank from sorted cells (no single-partition window); the
    best trial is the first best."""
    known = F.when(~F.isnan(F.col(score).cast("double")), F.col(score))
    r = prefix_sum(trials.withColumn("__k", known), [F.col("__k").desc_nulls_last(), F.col(trial).asc()], out="__pos")
    return r.select(trial, score, (F.col("__pos") + 1).cast("bigint").alias("rank"),
                    ((F.col("__pos") == 0) & F.col("__k").isNotNull()).alias("is_best"))


def design_ranking(designs: DataFrame, name: str) -> DataFrame:
    """Designs with status ok ranked by loss_reduction desc (name asc), the
    failed ones after; plus flags for best efficiency, fastest, smallest."""
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    loss = F.when(ok & ~F.isnan(F.col("loss_reduction").cast("double")), F.col("loss_reduction"))
    d = designs.withColumn("__k", loss).withColumn("__g", F.when(ok, 0).otherwise(1))
    r = prefix_sum(d, [F.col("__g").asc(), F.col("__k").desc_nulls_last(), F.col(name).asc()], out="__pos")
    best_eff = designs.where(ok).orderBy(F.col("efficiency").desc(), name).limit(1).select(name).scalar()
    fastest = designs.where(ok).orderBy(F.col("time_seconds").asc(), name).limit(1).select(name).scalar()
    smallest = designs.where(ok).orderBy(F.col("params").asc(), name).limit(1).select(name).scalar()
    return r.select(*designs.columns, (F.col("__pos") + 1).cast("bigint").alias("rank"),
                    (F.col(name) == best_eff).alias("best_efficiency"),
                    (F.col(name) == fastest).alias("fastest"), (F.col(name) == smallest).alias("smallest"))
