"""Registered queries: run-log analytics over ``events`` read as a step log
(run = user_id, step order = (ts, event_id), metric = value)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numeric import fround

from tessera.operators import runlog as rl
from tessera.plans.registry import query
from tessera.sources.files import table

_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")


query("rolling_mean_100", f"""SELECT event_id, user_id, value, CAST(row_number() OVER {_W} AS BIGINT) AS episode,
 round(CAST(sum(CAST(value AS DECIMAL(18, 2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS DOUBLE)
   / count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 4) AS mean_100,
 round(row_number() OVER {_W} / count(*) OVER (PARTITION BY user_id) * 100, 1) AS pct FROM events""")(
    lambda spark, d: rl.rolling_mean(_events(spark, d).select("event_id", "user_id", "ts", "value"), "user_id",
                                     ["ts", "event_id"], "value", 100).drop("ts"))

query("tail_n", """SELECT event_id, user_id, value, rn FROM (SELECT event_id, user_id, value,
 CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rn FROM events) t WHERE rn <= 100""")(
    lambda spark, d: rl.tail_n(_events(spark, d), "user_id", ["ts", "event_id"], 100).select("event_id", "user_id", "value", "rn"))

query("downsample_curve", f"""SELECT event_id, user_id, pos FROM (SELECT event_id, user_id,
 CAST(row_number() OVER {_W} - 1 AS BIGINT) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events) t
WHERE pos % greatest(1, n // 200) = 0""")(
    lambda spark, d: rl.downsample(_events(spark, d), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "pos"))

query("share_of_total", """SELECT l_orderkey, l_linenumber, l_returnflag,
 round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_returnflag) * 100, 4) AS share_pct FROM lineitem""")(
    lambda spark, d: rl.share_of_total(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag",
                                                                          "l_extendedprice"), "l_returnflag", "l_extendedprice")
    .drop("l_extendedprice"))

query("throughput", f"""SELECT event_id, user_id, CAST(row_number() OVER {_W} - 1 AS BIGINT) AS pos,
 round((epoch_us(ts) - epoch_us(lag(ts) OVER {_W})) / 1000.0, 3) AS step_time_ms,
 round(CASE WHEN (epoch_us(ts) - epoch_us(lag(ts) OVER {_W})) / 1000.0 > 0
   THEN 1000.0 / ((epoch_us(ts) - epoch_us(lag(ts) OVER {_W})) / 1000.0) END, 4) AS steps_per_sec,
 round(CASE WHEN (epoch_us(ts) - epoch_us(lag(ts) OVER {_W})) / 1000.0 > 0
   THEN value / ((epoch_us(ts) - epoch_us(lag(ts) OVER {_W})) / 1000.0 / 1000.0) END, 4) AS tokens_per_sec FROM events""")(
    lambda spark, d: rl.throughput(_events(spark, d), "user_id", ["ts", "event_id"], "ts", tokens="value")
    .select("event_id", "user_id", "pos", "step_time_ms", "steps_per_sec", "tokens_per_sec"))

# epochs: day of the step; kind: click/view train, purchase val, signup correct, error wrong; loss = value / 100
_KIND_SQL = """CASE WHEN event_type IN ('click', 'view') THEN 'train' WHEN event_type = 'purchase' THEN 'val'
 WHEN event_type = 'signup' THEN 'correct' ELSE 'wrong' END"""
_EPOCHS_SQL = f"""ep AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS epoch,
  round(avg(CASE WHEN k = 'train' THEN loss END), 6) AS train_loss,
  round(avg(CASE WHEN k = 'val' THEN loss END), 6) AS val_loss,
  round(CASE WHEN count(*) FILTER (WHERE k IN ('correct', 'wrong')) > 0
    THEN count(*) FILTER (WHERE k = 'correct') / count(*) FILTER (WHERE k IN ('correct', 'wrong')) END, 4) AS accuracy,
  round(least(exp(avg(CASE WHEN k = 'train' THEN loss END)), 1e6), 4) AS train_perplexity
  FROM (SELECT user_id, ts, value / 100.0 AS loss, {_KIND_SQL} AS k FROM events) e GROUP BY 1, 2)"""


def _epochs(spark, d):
    ev = _events(spark, d)
    kind = (F.when(F.col("event_type").isin("click", "view"), "train").when(F.col("event_type") == "purchase", "val")
            .when(F.col("event_type") == "signup", "correct").otherwise("wrong"))
    e = ev.select("user_id", "ts", (F.col("value") / 100.0).alias("loss"), kind.alias("kind"))
    return rl.epoch_summary(e, "user_id", F.to_date("ts").cast("string"), "loss", "kind")


query("epoch_summary", f"WITH {_EPOCHS_SQL} SELECT * FROM ep")(_epochs)
query("perplexity", """SELECT user_id, round(least(exp(avg(value / 100.0)), 1e6), 4) AS perplexity FROM events GROUP BY 1""")(
    lambda spark, d: _events(spark, d).groupBy("user_id").agg(
        fround(F.least(F.exp(F.avg(F.col("value") / 100.0)), F.lit(rl.PERPLEXITY_CAP)), 4).alias("perplexity")))

_RUN_SUMMARY_SQL = f"""WITH {_EPOCHS_SQL}
SELECT user_id, CAST(count(*) AS BIGINT) AS n_epochs, arg_max_null(train_loss, epoch) AS final_train_loss,
 arg_max_null(val_loss, epoch) AS final_val_loss, arg_max_null(accuracy, epoch) AS final_val_acc,
 min(val_loss) AS best_val_loss, max(accuracy) AS best_val_acc FROM ep GROUP BY user_id"""

query("run_summary", _RUN_SUMMARY_SQL)(lambda spark, d: rl.run_summary(_epochs(spark, d), "user_id"))


def _run_compare(spark, d):
    summ = rl.run_summary(_epochs(spark, d), "user_id").select("user_id", "best_val_loss", "best_val_acc")
    curve = rl.downsample(_events(spark, d), "user_id", ["ts", "event_id"]) \
        .select("user_id", "pos", (F.col("value") / 100.0).alias("loss"))
    out = rl.run_compare(summ, curve, "user_id", "pos", "loss")
    return out


query("run_compare", f"""WITH s AS ({_RUN_SUMMARY_SQL}),
p AS (SELECT user_id, value / 100.0 AS loss, row_number() OVER {_W} - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
c AS (SELECT user_id, CAST(count(*) AS BIGINT) AS n_points,
  string_agg(CAST(pos AS VARCHAR) || ':' || printf('%.4f', loss), ';' ORDER BY pos) AS loss_curve
  FROM p WHERE pos % greatest(1, n // 200) = 0 GROUP BY user_id)
SELECT s.user_id, s.best_val_loss, s.best_val_acc, c.n_points, c.loss_curve FROM s LEFT JOIN c USING (user_id)""")(_run_compare)


def _candidates(spark, d):
    ev = _events(spark, d)
    return ev.groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("name")).agg(
        F.avg("value").alias("forward_time_ms"), F.max("value").alias("memory_mb"),
        F.stddev_pop("value").alias("grad_norm"), (F.avg((F.col("value") < 10).cast("double")) * 100).alias("dead_neuron_pct"),
        (F.stddev_pop("value") / F.avg("value")).alias("grad_to_weight_ratio"))


_CAND_SQL = """cand AS (SELECT user_id AS run, event_type AS name, avg(value) AS forward_time_ms, max(value) AS memory_mb,
  stddev_pop(value) AS grad_norm, avg(CASE WHEN value < 10 THEN 1.0 ELSE 0.0 END) * 100 AS dead_neuron_pct,
  stddev_pop(value) / avg(value) AS grad_to_weight_ratio FROM events GROUP BY 1, 2),
c AS (SELECT *, sum(forward_time_ms) OVER (PARTITION BY run) AS tt, sum(memory_mb) OVER (PARTITION BY run) AS tm,
  row_number() OVER (PARTITION BY run ORDER BY forward_time_ms DESC, name) AS rt,
  row_number() OVER (PARTITION BY run ORDER BY memory_mb DESC, name) AS rm,
  dense_rank() OVER (PARTITION BY run ORDER BY name) AS o FROM cand)"""

query("layer_issues", f"""WITH {_CAND_SQL},
i AS (
 SELECT run, name, 0 AS g, o, 'slow_layer' AS type,
   CASE WHEN forward_time_ms / tt * 100 < 50 THEN 'warning' ELSE 'critical' END AS severity,
   round(forward_time_ms / tt * 100, 1) AS pct FROM c
   WHERE rt = 1 AND forward_time_ms > 0 AND tt > 0 AND forward_time_ms / tt * 100 > 30
 UNION ALL SELECT run, name, 1, o, 'memory_hog', 'info', round(memory_mb / tm * 100, 1) FROM c
   WHERE rm = 1 AND memory_mb > 0 AND tm > 0 AND memory_mb / tm * 100 > 40
 UNION ALL SELECT run, name, 2, o, 'vanishing_gradient', 'critical', NULL FROM c WHERE grad_norm > 0 AND grad_norm < 1e-7
 UNION ALL SELECT run, name, 2, o, 'exploding_gradient', 'critical', NULL FROM c
   WHERE NOT (grad_norm > 0 AND grad_norm < 1e-7) AND grad_norm > 100
 UNION ALL SELECT run, name, 3, o, 'dead_neurons', 'warning', NULL FROM c WHERE dead_neuron_pct > 50
 UNION ALL SELECT run, name, 4, o, 'high_grad_ratio', 'warning', NULL FROM c WHERE grad_to_weight_ratio > 1.0)
SELECT run, issue_rank, type, severity, layer, pct FROM (
 SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY g, o) AS BIGINT) AS issue_rank, type, severity,
   name AS layer, CAST(pct AS DOUBLE) AS pct FROM i) t""")(
    lambda spark, d: rl.layer_issues(_candidates(spark, d), "run", "name"))

query("layer_profile", """WITH g AS (SELECT event_type AS name, avg(value) AS a, count(*) AS calls FROM events GROUP BY 1)
SELECT name, round(a, 3) AS avg_time_ms, CAST(calls AS BIGINT) AS calls,
 round(CASE WHEN (SELECT sum(a) FROM g) > 0 THEN a / (SELECT sum(a) FROM g) * 100 ELSE 0.0 END, 1) AS time_pct FROM g""")(
    lambda spark, d: rl.layer_profile(_events(spark, d), "event_type", "value"))

query("latency_summary", """WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS rn, count(*) OVER () AS n
  FROM events WHERE value IS NOT NULL)
SELECT round(avg(value), 3) AS mean_ms, round(max(CASE WHEN rn = n // 2 THEN value END), 3) AS median_ms,
 round(max(CASE WHEN rn = CAST(floor(n * 0.95) AS BIGINT) THEN value END), 3) AS p95_ms,
 round(max(CASE WHEN rn = CAST(floor(n * 0.99) AS BIGINT) THEN value END), 3) AS p99_ms,
 round(min(value), 3) AS min_ms, round(max(value), 3) AS max_ms, round(CASE WHEN avg(value) > 0 THEN 1000 / avg(value) END, 1) AS throughput_per_sec,
 CAST(count(*) AS BIGINT) AS n_runs FROM v""")(
    lambda spark, d: rl.latency_summary(_events(spark, d), "value"))


def _trials(spark, d):
    return _events(spark, d).groupBy(F.col("user_id").alias("trial")).agg(fround(F.sum("value"), 2).alias("score"))


query("leaderboard", """WITH t AS (SELECT user_id AS trial, round(sum(value), 2) AS score FROM events GROUP BY 1)
SELECT trial, score, CAST(row_number() OVER (ORDER BY score DESC, trial) AS BIGINT) AS rank,
 row_number() OVER (ORDER BY score DESC, trial) = 1 AS is_best FROM t""")(
    lambda spark, d: rl.leaderboard(_trials(spark, d), "trial", "score"))


def _designs(spark, d):
    ev = _events(spark, d)
    o = F.struct("ts", "event_id")
    g = ev.groupBy(F.col("user_id").alias("design")).agg(
        F.min_by("value", o).alias("initial_loss"), F.max_by("value", o).alias("final_loss"),
        (F.count(F.lit(1)) * 1000).cast("bigint").alias("params"),
        (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1e6).alias("secs"),
        F.count(F.lit(1)).alias("steps"), F.max_by("event_type", o).alias("last_type"))
    red = fround(F.col("initial_loss") - F.col("final_loss"), 4)
    return g.select("design", F.when(F.col("last_type") == "error", "error").otherwise("ok").alias("status"),
                    red.alias("loss_reduction"), "params", fround("secs", 2).alias("time_seconds"),
                    fround(F.when(F.col("secs") > 0, F.col("steps") / F.col("secs")), 6).alias("steps_per_sec"),
                    fround(red / (F.col("params") / 1e6), 4).alias("efficiency"))


query("design_ranking", """WITH g AS (SELECT user_id AS design, arg_min(value, (ts, event_id)) AS initial_loss,
  arg_max(value, (ts, event_id)) AS final_loss, CAST(count(*) * 1000 AS BIGINT) AS params,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS secs, count(*) AS steps,
  arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1),
d AS (SELECT design, CASE WHEN last_type = 'error' THEN 'error' ELSE 'ok' END AS status,
  round(initial_loss - final_loss, 4) AS loss_reduction, params, round(secs, 2) AS time_seconds,
  round(CASE WHEN secs > 0 THEN steps / secs END, 6) AS steps_per_sec, round(round(initial_loss - final_loss, 4) / (params / 1e6), 4) AS efficiency FROM g)
SELECT *, CAST(row_number() OVER (ORDER BY CASE WHEN status = 'ok' THEN 0 ELSE 1 END,
   CASE WHEN status = 'ok' THEN -loss_reduction ELSE 'inf'::DOUBLE END, design) AS BIGINT) AS rank,
 design = (SELECT design FROM d WHERE status = 'ok' ORDER BY efficiency DESC, design LIMIT 1) AS best_efficiency,
 design = (SELECT design FROM d WHERE status = 'ok' ORDER BY time_seconds, design LIMIT 1) AS fastest,
 design = (SELECT design FROM d WHERE status = 'ok' ORDER BY params, design LIMIT 1) AS smallest FROM d""")(
    lambda spark, d: rl.design_ranking(_designs(spark, d), "design"))

# --------------------------------------------------------------------------- named formula (x = value / 100)
from tessera.functions.formulas import apply_formula  # noqa: E402

query("formula", """SELECT event_id, round(least(greatest(value / 100.0 * 0.5 + 0.5, 0), 1), 6) AS y FROM events""")(
    lambda spark, d: _events(spark, d).select("event_id", (F.col("value") / 100.0).alias("x"))
    .select("event_id", fround(apply_formula("clamp_half", "x"), 6).alias("y")))

# --------------------------------------------------------------------------- bill of materials
# robots = orders; components = lineitems: catalogue entry l_partkey mod 27,
# quantity floor(l_quantity) mod 4 + 1, duty cycle = l_discount * 10
from tessera.operators import bom  # noqa: E402


def _components(spark, d):
    li = table(spark, d, "lineitem")
    cat = bom.catalog(spark).select("cat_idx", "type")
    c = li.select(F.col("l_orderkey").alias("robot_id"),
                  F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"),
                  (F.col("l_partkey") % len(bom.CATALOG)).cast("int").alias("cat_idx"),
                  (F.floor("l_quantity").cast("bigint") % 4 + 1).alias("quantity"),
                  (F.col("l_discount") * 10).alias("duty_cycle"))
    return c.join(F.broadcast(cat), "cat_idx").drop("cat_idx")


def _sql_num(v):
    return "NULL" if v is None else repr(float(v))


_CAT_SQL = ",\n".join(f"({i}, '{r[0]}', '{r[1]}', " + ", ".join(_sql_num(x) for x in r[2:]) + ")"
                      for i, r in enumerate(bom.CATALOG))
_IDLE = "coalesce(current_idle_ma, current_ma, 0.0)"
query("bom_rollup", f"""WITH cat(idx, type, category, weight_g, voltage_nominal, current_idle_ma, current_stall_ma, current_ma,
  current_max_a, voltage, capacity_mah, max_discharge_c) AS (VALUES {_CAT_SQL}),
comp AS (SELECT l_orderkey AS robot_id, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p, l_partkey % {len(bom.CATALOG)} AS idx,
  CAST(floor(l_quantity) AS BIGINT) % 4 + 1 AS q, l_discount * 10 AS duty FROM lineitem),
j AS (SELECT comp.robot_id, comp.p, comp.q, comp.duty, cat.* FROM comp JOIN cat USING (idx)),
l AS (SELECT robot_id, p, type, category, capacity_mah, capacity_mah * max_discharge_c / 1000 AS max_a,
  weight_g * q AS w,
  (CASE WHEN category = 'actuator' THEN {_IDLE} WHEN category = 'power' THEN 0.0 ELSE coalesce(current_ma, 0.0) END) * q AS idle,
  (CASE WHEN category = 'actuator' THEN {_IDLE} + (coalesce(current_stall_ma, coalesce(current_max_a, 0.0) * 1000) - {_IDLE}) * duty * 0.3
   WHEN category = 'power' THEN 0.0 ELSE coalesce(current_ma, 0.0) END) * q AS avg,
  coalesce(voltage_nominal, voltage, 0.0) AS v FROM j),
l2 AS (SELECT *, round(v * avg / 1000, 3) AS power_w FROM l),
rv AS (SELECT robot_id, v, string_agg(type, ',' ORDER BY p) AS ts, min(p) AS first FROM l2
  WHERE v > 0 AND category <> 'power' GROUP BY robot_id, v),
rails AS (SELECT robot_id, string_agg(CAST(v AS VARCHAR) || '=' || ts, ';' ORDER BY first) AS rails FROM rv GROUP BY robot_id),
g AS (SELECT robot_id, sum(CAST(w AS DECIMAL(24, 6))) AS weight, sum(CAST(idle AS DECIMAL(24, 6))) AS idle,
  sum(CAST(avg AS DECIMAL(24, 6))) AS active, sum(CAST(power_w AS DECIMAL(24, 6))) AS power,
  arg_min(type, p) FILTER (WHERE category = 'power') AS battery,
  arg_min(capacity_mah, p) FILTER (WHERE category = 'power') AS cap,
  arg_min(max_a, p) FILTER (WHERE category = 'power') AS max_a FROM l2 GROUP BY robot_id)
SELECT g.robot_id, CAST(round(weight, 1) AS DOUBLE) AS total_weight_g, CAST(round(idle, 0) AS BIGINT) AS total_current_idle_ma,
 CAST(round(active, 0) AS BIGINT) AS total_current_active_ma, CAST(round(power, 2) AS DOUBLE) AS total_power_w,
 coalesce(rails.rails, '') AS voltage_rails, battery,
 CASE WHEN battery IS NOT NULL AND CAST(active AS DOUBLE) > 0 THEN round(cap / CAST(active AS DOUBLE) * 60, 1) END AS battery_life_minutes,
 NOT coalesce(battery IS NOT NULL AND CAST(active AS DOUBLE) / 1000 > max_a, false) AS current_within_limits
FROM g LEFT JOIN rails USING (robot_id)""")(lambda spark, d: bom.bom_rollup(_components(spark, d)))
