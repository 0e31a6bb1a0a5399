"""Profiling and evaluation fixtures (reference tests and quirks)."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate as ev
from tessera.operators import profile as pr
from tessera.operators.quantiles import kth_smallest_many


def test_numeric_and_categorical_profile(spark):
    df = spark.createDataFrame([(10,), (20,), (30,)], "val int")
    r = pr.numeric_profile(df).first()
    assert r.mean == 20.0 and r.median == 20.0
    cat = spark.createDataFrame([("a",), ("b",), ("a",)], "cat string")
    assert pr.top_values(cat).where("rank = 1").first().value == "a"
    nul = spark.createDataFrame([("1",), (None,), ("",)], "x string")
    assert pr.profile_counts(nul).first().null_count == 2


def test_upper_median_and_histogram(spark):
    four = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    assert pr.numeric_profile(four).first().median == 3.0
    h = pr.histogram(spark.createDataFrame([(float(v),) for v in range(5)], "v double"), "v").orderBy("bucket").collect()
    assert [r["count"] for r in h] == [1, 1, 1, 1, 1]
    assert [r.label for r in h] == [0.0, 0.8, 1.6, 2.4, 3.2]
    one = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert pr.histogram(one, "v").count() == 0


def test_profile_dict(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("", 3)], "s string, n int")
    p = pr.profile(df)
    assert p["columns"]["n"]["type"] == "numeric" and p["columns"]["s"]["type"] == "categorical"
    assert p["columns"]["s"]["null_count"] == 1 and p["row_count"] == 3


def test_kth_smallest_exact_with_narrowing(spark):
    random.seed(3)
    vals = [random.choice([random.random() * 100, 5.0, -1.0]) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals], "a double")
    ks = [0, 17, 2500, 4999]
    res = kth_smallest_many(df, {"a": ks}, buckets=8, collect_limit=50)
    s = sorted(vals)
    assert [res[("a", k)] for k in ks] == [s[k] for k in ks]


@pytest.mark.parametrize("sketch_k,error,limit", [(2048, None, 50_000), (8, 0.0, 50_000), (8, 0.0, 20), (64, None, 10), (2048, None, 10)])
def test_kth_smallest_whatever_the_sketch_says(spark, sketch_k, error, limit):
    """Exact with brackets that hold, that are too narrow, and in many rounds."""
    rng = random.Random(8)
    a = [rng.gauss(0, 1) if rng.random() < 0.7 else float(rng.randrange(5)) for _ in range(6000)]
    b = [None if i % 9 == 0 else float("nan") if i % 11 == 0 else 10.0 ** rng.uniform(-300, 300) for i in range(6000)]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double").repartition(5)
    known = {"a": sorted(a), "b": sorted(x for x in b if x is not None and x == x)}
    want = {(c, k): known[c][k] for c in known for k in (0, 1, 700, len(known[c]) // 2, len(known[c]) - 1)}
    got = kth_smallest_many(df, {c: [k for d, k in want if d == c] for c in known}, buckets=16, collect_limit=limit,
                            sketch_k=sketch_k, error=error)
    assert got == want


def test_long_value_hashes_differ_from_the_first_byte(spark):
    """Both hashes of a long value start from another seed: neither is a function of the other."""
    df = spark.createDataFrame([("x" * 40,), ("y" * 40,)], "v string")
    key = pr.distinct_key(F.col("v"))
    chained = [F.xxhash64(F.xxhash64("v"), F.lit(i)) for i in (1, 2)]
    for r in df.select(key.alias("k"), *chained).collect():
        assert r.k.h1 != r.k.h2 and r.k.v is None and r.k.n == 40
    rows = df.select(F.xxhash64(F.lit(1), F.col("v")).alias("a"), key.h1.alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_classification(spark):
    t = [0, 1, 1, 0, 1, 0, 1, 0]
    p = [0, 1, 0, 0, 1, 1, 1, 0]
    df = spark.createDataFrame(list(zip(t, p)), "t int, p int")
    assert ev.accuracy(df, "t", "p").first().accuracy == 0.75
    cm = {(r.true_label, r.pred_label): r["count"] for r in ev.confusion_matrix(df, "t", "p").collect()}
    assert cm == {("0", "0"): 3, ("0", "1"): 1, ("1", "0"): 1, ("1", "1"): 3}
    df3 = spark.createDataFrame(list(zip([0, 1, 2, 0, 1, 2], [0, 2, 1, 0, 1, 2])), "t int, p int")
    assert ev.accuracy(df3, "t", "p").first().accuracy == 0.6667
    m = ev.macro_metrics(df, "t", "p").first()
    assert m.macro_f1 == 0.75


def test_regression(spark):
    df = spark.createDataFrame(list(zip([1.0, 2.0, 3.0, 4.0, 5.0], [1.1, 2.2, 2.8, 4.1, 5.3])), "t double, p double")
    r = ev.regression_metrics(df, "t", "p").first()
    assert r.mse == pytest.approx(0.038) and r.mae == pytest.approx(0.18) and r.r2 == pytest.approx(0.981)
    const = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "t double, p double")
    assert ev.regression_metrics(const, "t", "p").first().r2 == 0.0


def test_generation_metrics(spark):
    df = spark.createDataFrame([(1, "The cat sat on the mat", "A cat was sitting on the mat")], "id int, r string, p string")
    assert ev.bleu_n(df, "r", "p", "id").first().bleu_1 == 0.5714
    assert ev.rouge_12(df, "r", "p", "id").first().rouge_1 == 0.6154


def _lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            cur[j] = prev[j - 1] + 1 if x == y else max(prev[j], cur[j - 1])
        prev = cur
    return prev[-1]


def test_lcs_of_many_pairs_matches_dp():
    import numpy as np
    random.seed(5)
    pairs = [([random.randrange(4) for _ in range(random.randint(0, 30))],
              [random.randrange(4) for _ in range(random.randint(0, 30))]) for _ in range(300)]
    want = [_lcs_dp(a, b) for a, b in pairs]
    assert ev.lcs_lengths([np.array(a, int) for a, _ in pairs], [np.array(b, int) for _, b in pairs]).tolist() == want


def test_lcs_of_very_long_texts():
    import time
    rng = random.Random(1)
    a = [rng.randrange(3000) if i % 3 else i for i in range(100_000)]
    b = [x for i, x in enumerate(a) if i % 10]
    b[::7] = ["x"] * len(b[::7])
    began = time.process_time()
    assert ev.lcs_length_of(a, [x for i, x in enumerate(a) if i % 10]) == 90_000
    assert ev.lcs_length_of(a, b) == sum(x != "x" for x in b)
    assert time.process_time() - began < 20
    # beyond the length whose masks are all kept, against the plain rows
    c, d = ([rng.randrange(40) for _ in range(n)] for n in (4300, 300))
    assert ev.lcs_length_of(c, d) == _lcs_dp(c, d)


def test_rouge_l_against_brute_force(spark):
    pairs = [(i, " ".join(random.choice(["a", "b", "c", "d"]) for _ in range(12)),
              " ".join(random.choice(["a", "b", "c", "e"]) for _ in range(9))) for i in range(40)]
    df = spark.createDataFrame(pairs, "id int, r string, p string")
    fs = []
    for _, r, p in pairs:
        rt, pt = r.lower().split(), p.lower().split()
        lcs = _lcs_dp(rt, pt)
        pp, rr = lcs / max(len(pt), 1), lcs / max(len(rt), 1)
        fs.append(2 * pp * rr / max(pp + rr, 1e-8))
    assert ev.rouge_l(df, "r", "p").first().rouge_l == pytest.approx(round(sum(fs) / len(fs), 4), abs=1e-4)


def test_answer_check_and_qa(spark):
    from pyspark.sql import functions as F
    from tessera.functions.text import answer_matches
    df = spark.createDataFrame([("The answer is 36.0", "36"), ("17", "7"), ("no", "yes")], "g string, e string")
    assert [r.ok for r in df.select(answer_matches(F.col("g"), F.col("e")).alias("ok")).collect()] == [True, True, False]
    q = ev.qa_scores(df.withColumn("cat", F.lit("math")), "cat", "g", "e").where("category = 'math'").first()
    assert q.correct == 2 and q.total == 3


def test_auto_eval_picks_task(spark):
    cls = spark.createDataFrame([(0, 0), (1, 1)], "t int, p int")
    assert ev.auto_eval(cls, "t", "p").first().task == "classification"
    reg = spark.createDataFrame([(float(i), float(i)) for i in range(60)], "t double, p double")
    assert ev.auto_eval(reg, "t", "p").first().task == "regression"


def test_approximate_options(spark):
    from tessera.operators import transforms as tf
    df = spark.createDataFrame([(float(v),) for v in range(101)] + [(None,)], "v double")
    exact = tf.fill_nulls(df, "v", "median").where("v = 50").count()
    approx = tf.fill_nulls(df, "v", "median", approx_accuracy=10000).where("v = 50").count()
    assert exact == 2 and approx == 2
    assert pr.profile_counts(df, approx_unique=True).first().unique == 101


def test_pair_overlaps_match_spark_native_counts(spark):
    from pyspark.sql import functions as F
    random.seed(11)
    voc = ["a", "b", "c", "d", "é", "a b"]
    rows = [(i, " ".join(random.choice(voc) for _ in range(random.randint(0, 25))),
             " ".join(random.choice(voc) for _ in range(random.randint(0, 25)))) for i in range(60)]
    df = spark.createDataFrame(rows, "pair_id long, r string, p string")
    pairs = df.select("pair_id", ev.tokens(F.col("r")).alias("rt"), ev.tokens(F.col("p")).alias("pt"))
    fast = {(r.pair_id, n): r[f"m{n}"] for r in ev.pair_overlaps(pairs).collect() for n in (1, 2, 3, 4)}
    slow = {(r.pair_id, r.n): r.m for r in ev.gram_counts(pairs).groupBy("pair_id", "n")
            .agg(F.sum(F.least("rc", "pc")).alias("m")).collect()}
    for (pid, n), m in fast.items():
        assert m == slow.get((pid, n), 0)


def test_quantiles_of_infinities_neighbours_and_nan(spark):
    import math
    from tessera.operators.quantiles import kth_smallest, upper_median
    near = [1.0, math.nextafter(1.0, 2), math.nextafter(math.nextafter(1.0, 2), 2)]
    vals = [float("-inf")] * 3 + near * 400 + [1e308, -1e308, float("inf"), float("nan"), None] + [float(i) for i in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    known = sorted(v for v in vals if v is not None and not math.isnan(v))
    ks = [0, 2, 3, 4, 500, 900, 1300, len(known) - 2, len(known) - 1]
    got = kth_smallest(df, "x", ks, collect_limit=10, buckets=16)
    assert got == [known[k] for k in ks]
    assert kth_smallest(df, "x", [len(known)]) == [None]
    assert upper_median(df, "x", collect_limit=10) == known[len(known) // 2]


def test_profile_of_nan_and_infinity(spark):
    df = spark.createDataFrame([(float(i % 40), float("nan") if i % 2 else float(i)) for i in range(200)] + [(float("inf"), None)],
                               "a double, b double")
    rows = {r.column: r for r in pr.numeric_profile(df).collect()}
    assert rows["b"].max == 198.0 and rows["b"].median == 100.0 and rows["a"].max == float("inf")
    h = pr.histogram(df, "a").collect()
    assert len(h) == 20 and sum(r["count"] for r in h) == 200
    p = pr.profile(df)
    assert sum(p["columns"]["b"]["histogram"]["counts"]) == 100


def test_fround_keeps_large_values(spark):
    from pyspark.sql import functions as F
    from tessera.functions.numeric import fround
    vals = [5.0e13, 1e300, float("inf"), -2.5e15, 1.23456789]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "x double").select(fround(F.col("x"), 6)).collect()]
    assert got == vals[:4] + [1.234568]


def test_cosine_topk_in_query_blocks(spark):
    import numpy as np
    from tessera.operators import vectors as vx
    rng = np.random.default_rng(3)
    m = rng.normal(size=(200, 8))
    m[50:60] = m[0]  # ties: by id
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    queries = corpus.where("vec_id < 40").withColumnRenamed("vec_id", "query_id")
    u = m / np.linalg.norm(m, axis=1)[:, None]
    for block in (7, 1000):
        got = {}
        for r in vx.cosine_topk(corpus.repartition(3), queries, 5, block=block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        for q in range(40):
            s = np.round(u @ u[q], 9)
            assert [v for _, v in sorted(got[q])] == sorted(range(200), key=lambda i: (-s[i], i))[:5]


def test_confusion_pairs_without_the_grid(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a")], "t string, p string")
    got = sorted(tuple(r) for r in ev.confusion_matrix(df, "t", "p", zeros=False).collect())
    assert got == [("a", "a", 1), ("a", "b", 1)]


def test_frequent_values_are_proven_or_counted_in_full(spark):
    rng = random.Random(2)
    n = 20_000
    hot = [f"h{int(rng.paretovariate(1.1))}" for _ in range(n)]
    rows = [(h, rng.choice("abc"), str(i), None if i % 3 else "", f"t{i % 700}") for i, h in enumerate(hot)]
    df = spark.createDataFrame(rows, "hot string, few string, one string, blank string, flat string").repartition(7)
    proven, rest = pr.frequent_values(df, df.columns, 20)
    assert {c for c, _, _ in proven} >= {"hot", "few"} and "one" in rest
    for options in ({}, {"tracked": 50, "candidates": 45, "unnamed": 1.0}):
        got = {}
        for r in pr.top_values(df, **options).collect():
            got.setdefault(r.column, {})[r.rank] = (r.value, r["count"])
        for i, c in enumerate(df.columns):
            counts = {}
            for row in rows:
                if row[i]:
                    counts[row[i]] = counts.get(row[i], 0) + 1
            want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:20]
            assert [got.get(c, {}).get(k + 1) for k in range(len(want))] == want and len(got.get(c, {})) == len(want)
    assert pr.top_values(df.limit(0)).count() == 0
