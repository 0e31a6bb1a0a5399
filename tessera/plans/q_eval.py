"""Registered queries: classification, regression and generation metrics,
automatic task choice and QA scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evaluate as ev
from tessera.plans.registry import query
from tessera.sources.files import table

# labels table: quality = truth, toxic = prediction
_LAB = """lab AS (SELECT label FROM (SELECT CAST(quality AS VARCHAR) AS label FROM labels
  UNION SELECT CAST(toxic AS VARCHAR) FROM labels) WHERE label IS NOT NULL),
pc AS (SELECT CAST(quality AS VARCHAR) AS t, CAST(toxic AS VARCHAR) AS p, count(*) AS n FROM labels GROUP BY 1, 2)"""

_PER_CLASS = f"""WITH {_LAB},
s AS (SELECT label, (SELECT coalesce(sum(n), 0) FROM pc WHERE t = label) AS support,
  (SELECT coalesce(sum(n), 0) FROM pc WHERE p = label) AS pred_n,
  (SELECT coalesce(sum(n), 0) FROM pc WHERE t = label AND p = label) AS tp FROM lab),
m AS (SELECT label, support, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS p,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM s)
SELECT label, round(p, 4) AS precision, round(r, 4) AS recall,
 round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1, CAST(support AS BIGINT) AS support FROM m"""

_MACRO = f"""SELECT round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall,
 round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / greatest(sum(support), 1), 4) AS weighted_f1
FROM ({_PER_CLASS}) pcm"""

_ACC = """SELECT round(count(*) FILTER (WHERE CAST(quality AS VARCHAR) = CAST(toxic AS VARCHAR)) / count(*), 4) AS accuracy,
 CAST(count(*) FILTER (WHERE CAST(quality AS VARCHAR) = CAST(toxic AS VARCHAR)) AS BIGINT) AS correct,
 CAST(count(*) AS BIGINT) AS total_samples FROM labels"""

query("confusion_matrix", f"""WITH {_LAB}
SELECT a.label AS true_label, b.label AS pred_label, CAST(coalesce(pc.n, 0) AS BIGINT) AS count
FROM lab a CROSS JOIN lab b LEFT JOIN pc ON pc.t = a.label AND pc.p = b.label""")(
    lambda spark, d: ev.confusion_matrix(table(spark, d, "labels"), "quality", "toxic"))
query("accuracy", _ACC)(lambda spark, d: ev.accuracy(table(spark, d, "labels"), "quality", "toxic"))
query("per_class_metrics", _PER_CLASS)(lambda spark, d: ev.per_class_metrics(table(spark, d, "labels"), "quality", "toxic"))
query("macro_metrics", _MACRO)(lambda spark, d: ev.macro_metrics(table(spark, d, "labels"), "quality", "toxic"))

_AUTO_METRICS = ("macro_precision", "macro_recall", "macro_f1", "weighted_f1")
query("auto_eval", f"""WITH a AS ({_ACC}), m AS ({_MACRO})
SELECT 'classification' AS task, 'accuracy' AS metric, CAST(accuracy AS DOUBLE) AS value FROM a
""" + "".join(f"UNION ALL SELECT 'classification', '{c}', CAST({c} AS DOUBLE) FROM m\n" for c in _AUTO_METRICS))(
    lambda spark, d: ev.auto_eval(table(spark, d, "labels"), "quality", "toxic"))


def _pred_prices(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return li.join(part, "l_partkey").select("l_extendedprice",
                                             (F.col("l_quantity") * F.col("p_retailprice")).alias("pred"))


query("regression_metrics", """WITH x AS (SELECT l_extendedprice AS t, l_quantity * p_retailprice AS p
  FROM lineitem JOIN part ON l_partkey = p_partkey),
a AS (SELECT count(*) AS n, sum((t - p) * (t - p)) AS sse, sum(abs(t - p)) AS sae, var_pop(t) AS vt,
  sum(abs(t - p) / greatest(abs(t), 1e-8)) AS ape, min(t - p) AS emin, max(t - p) AS emax, avg(t - p) AS emean FROM x)
SELECT round(sse / n, 6) AS mse, round(sqrt(sse / n), 6) AS rmse, round(sae / n, 6) AS mae,
 round(CASE WHEN vt * n > 0 THEN 1 - sse / (vt * n) ELSE 0.0 END, 6) AS r2, round(ape / n * 100, 2) AS mape,
 CAST(n AS BIGINT) AS total_samples, round(emin, 4) AS residual_min, round(emax, 4) AS residual_max,
 round(emean, 4) AS residual_mean FROM a""")(
    lambda spark, d: ev.regression_metrics(_pred_prices(spark, d), "l_extendedprice", "pred"))

# --------------------------------------------------------------------------- generation pairs

_PAIRS = """pairs AS (SELECT u.conv_id * 1000 + u.turn AS pair_id, u.text AS ref, a.text AS pred,
  CASE WHEN u.turn < 2 THEN 'opening' ELSE 'follow_up' END AS category
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


def conversation_pairs(spark, d):
    c = table(spark, d, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("ref"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("pred"))
    return u.join(a, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "ref", "pred",
        F.when(F.col("turn") < 2, "opening").otherwise("follow_up").alias("category"))


_TOK = """tok AS (SELECT pair_id, list_filter(string_split_regex(lower(ref), '\\s+'), lambda x: x <> '') AS rt,
  list_filter(string_split_regex(lower(pred), '\\s+'), lambda x: x <> '') AS pt FROM pairs)"""


def _grams(side: str, n: int, r: int, p: int) -> str:
    return (f"SELECT pair_id, {n} AS n, g, {r} AS r, {p} AS p FROM tok, LATERAL (SELECT unnest(list_transform("
            f"range(0, len({side}) - {n} + 1), lambda i: array_to_string({side}[i + 1 : i + {n}], chr(1)))) AS g) x")


_GRAMS = "g AS (" + "\nUNION ALL\n".join(_grams(s, n, int(s == "rt"), int(s == "pt"))
                                         for n in (1, 2, 3, 4) for s in ("rt", "pt")) + ")"
_BASE = f"""WITH {_PAIRS}, {_TOK}, {_GRAMS},
pg AS (SELECT pair_id, n, g, sum(r) AS rc, sum(p) AS pc FROM g GROUP BY ALL),
m AS (SELECT pair_id, n, sum(least(rc, pc)) AS matches FROM pg GROUP BY ALL),
base AS (SELECT t.pair_id, len(rt) AS lr, len(pt) AS lp,
  coalesce((SELECT matches FROM m WHERE m.pair_id = t.pair_id AND m.n = 1), 0) AS m1,
  coalesce((SELECT matches FROM m WHERE m.pair_id = t.pair_id AND m.n = 2), 0) AS m2,
  coalesce((SELECT matches FROM m WHERE m.pair_id = t.pair_id AND m.n = 3), 0) AS m3,
  coalesce((SELECT matches FROM m WHERE m.pair_id = t.pair_id AND m.n = 4), 0) AS m4 FROM tok t)"""

query("bleu_n", _BASE + "\nSELECT " + ", ".join(
    f"round(avg(CASE WHEN lp - {n} + 1 > 0 THEN m{n} / (lp - {n} + 1) ELSE 0.0 END), 4) AS bleu_{n}" for n in (1, 2, 3, 4))
    + " FROM base")(
    lambda spark, d: ev.bleu_n(conversation_pairs(spark, d), "ref", "pred", "pair_id"))


def _f1(m: str, lp: str, lr: str) -> str:
    pp = f"({m} / greatest({lp}, 1))"
    rr = f"({m} / greatest({lr}, 1))"
    return f"2 * {pp} * {rr} / greatest({pp} + {rr}, 1e-8)"


query("rouge_12", _BASE + f"""
SELECT round(avg({_f1('m1', 'lp', 'lr')}), 4) AS rouge_1,
 round(avg({_f1('m2', 'greatest(lp - 1, 0)', 'greatest(lr - 1, 0)')}), 4) AS rouge_2 FROM base""")(
    lambda spark, d: ev.rouge_12(conversation_pairs(spark, d), "ref", "pred", "pair_id"))

query("exact_match", f"""WITH {_PAIRS}
SELECT round(avg(CASE WHEN regexp_replace(ref, '^\\s+|\\s+$', '', 'g') = regexp_replace(pred, '^\\s+|\\s+$', '', 'g')
 THEN 1.0 ELSE 0.0 END), 4) AS exact_match, CAST(count(*) AS BIGINT) AS total_samples FROM pairs""")(
    lambda spark, d: ev.exact_match(conversation_pairs(spark, d), "ref", "pred"))

# the LCS row by row: one recursion step per reference token
query("rouge_l", f"""WITH RECURSIVE {_PAIRS}, {_TOK},
lcs(pair_id, i, row) AS (SELECT pair_id, 0, list_transform(pt, lambda x: 0) FROM tok
 UNION ALL SELECT pair_id, i + 1, list_transform(range(1, len(step) + 1), lambda j: list_max(step[1:j]))
 FROM (SELECT l.pair_id, l.i, list_transform(range(1, len(pt) + 1), lambda j: greatest(l.row[j],
     (CASE WHEN j > 1 THEN l.row[j - 1] ELSE 0 END) + (CASE WHEN pt[j] = rt[l.i + 1] THEN 1 ELSE 0 END))) AS step
   FROM lcs l JOIN tok t ON t.pair_id = l.pair_id WHERE l.i < len(rt)) s),
n AS (SELECT t.pair_id, coalesce(list_max(l.row), 0) AS n, len(rt) AS lr, len(pt) AS lp FROM tok t
  JOIN lcs l ON l.pair_id = t.pair_id AND l.i = len(rt))
SELECT round(avg({_f1('n', 'lp', 'lr')}), 4) AS rouge_l FROM n""")(
    lambda spark, d: ev.rouge_l(conversation_pairs(spark, d), "ref", "pred"))


def _qa_input(spark, d):
    p = conversation_pairs(spark, d)
    return p.select("category", F.col("pred").alias("generated"),
                    F.regexp_extract("ref", r"(\w+)\W*$", 1).alias("expected"),
                    (F.length("pred") / 10.0).alias("latency_ms"))


_QA_OK = """(contains(lower(regexp_replace(pred, '^\\s+|\\s+$', '', 'g')), lower(regexp_replace(exp, '^\\s+|\\s+$', '', 'g')))
 OR len(list_filter(regexp_extract_all(lower(regexp_replace(pred, '^\\s+|\\s+$', '', 'g')), '-?\\d+\\.?\\d*'),
   lambda x: (CASE WHEN contains(x, '.') THEN regexp_replace(regexp_replace(x, '0+$', ''), '\\.$', '') ELSE x END)
     = lower(regexp_replace(exp, '^\\s+|\\s+$', '', 'g')) OR x = lower(regexp_replace(exp, '^\\s+|\\s+$', '', 'g')))) > 0)"""

query("qa_scoring", f"""WITH {_PAIRS},
q AS (SELECT category, pred, regexp_extract(ref, '(\\w+)\\W*$', 1) AS exp, length(pred) / 10.0 AS lat FROM pairs),
s AS (SELECT category, {_QA_OK} AS ok, lat FROM q),
per AS (SELECT category, count(*) FILTER (WHERE ok) AS correct, count(*) AS total, avg(lat) AS lat FROM s GROUP BY 1
  UNION ALL SELECT '__overall__', count(*) FILTER (WHERE ok), count(*), avg(lat) FROM s)
SELECT category, CAST(correct AS BIGINT) AS correct, CAST(total AS BIGINT) AS total, round(correct / total, 4) AS score,
 round(lat, 2) AS avg_latency FROM per""")(
    lambda spark, d: ev.qa_scores(_qa_input(spark, d), "category", "generated", "expected", "latency_ms"))
