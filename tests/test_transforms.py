"""Pipeline transforms on the reference's own small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import transforms as tf
from tessera.plans.pipeline import Pipeline, PipelineError, REGISTRY

A1 = [("Alice", "30", "NYC", "85"), ("Bob", "25", "LA", "92"), ("Charlie", "", "NYC", "78"), ("Diana", "28", "SF", "")]


@pytest.fixture
def people(spark):
    return spark.createDataFrame(A1, "name string, age string, city string, score string")


def test_registry_has_17_ops():
    assert len(REGISTRY) == 17


def test_select_drop_rename(people, spark):
    assert tf.select_columns(people, "name, zz").columns == ["name", "zz"]
    assert tf.drop_columns(people, "age,score,nope").columns == ["name", "city"]
    df = spark.createDataFrame([(1,)], "old_name int")
    assert tf.rename_columns(df, '{"old_name": "new_name"}').columns == ["new_name"]


def test_filters(people):
    assert tf.filter_rows(people, "city", "==", "NYC").count() == 2
    assert tf.filter_rows(people, "name", "contains", "li").count() == 2
    assert tf.drop_nulls(people, "age").count() == 3
    assert tf.filter_rows(people, "age", ">", "26").count() == 2  # string column compared as numbers
    assert tf.filter_rows(people, "score", "is_null").count() == 1


def test_regex_and_not_contains(spark):
    df = spark.createDataFrame([("abc",), ("xbc",), (None,)], "s string")
    assert tf.filter_rows(df, "s", "regex", "^a").count() == 1
    df2 = spark.createDataFrame([(None,), ("",), ("Hello",)], "s string")
    out = tf.filter_rows(df2, "s", "not_contains", "he").collect()
    assert [r.s for r in out] == [""]


def test_typed_equality_keeps_python_string_semantics(spark):
    df = spark.createDataFrame([(5, 5.0)], "i bigint, d double")
    assert tf.filter_rows(df, "i", "==", "5").count() == 1
    assert tf.filter_rows(df, "i", "==", "5.0").count() == 0
    assert tf.filter_rows(df, "d", "==", "5.0").count() == 1
    assert tf.filter_rows(df, "d", "==", "5").count() == 0


def test_fill_and_cast(people, spark):
    filled = tf.fill_nulls(people, "score", "value", "0").where("name = 'Diana'").first()
    assert filled.score == "0"
    df = spark.createDataFrame([("3.9",), ("x",), ("",), (None,)], "v string")
    assert [r.v for r in tf.cast_type(df, "v", "int").collect()] == [3, None, None, None]
    b = spark.createDataFrame([("yes",), ("1",), ("no",)], "v string")
    assert [r.v for r in tf.cast_type(b, "v", "bool").collect()] == [True, True, False]


def test_fill_statistics(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (None,), (30.0,)], "v double")
    assert tf.fill_nulls(df, "v", "mean").where("v = 20").count() == 2
    df4 = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double")
    assert sorted(r.v for r in tf.fill_nulls(df4, "v", "median").collect()) == [1, 2, 3, 3, 4]
    m = spark.createDataFrame([("a",), ("b",), ("a",), ("",)], "v string")
    assert [r.v for r in tf.fill_nulls(m, "v", "mode").collect()].count("a") == 3


def test_ffill_bfill(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, None), (1, 3, 3.0), (2, 1, None)], "k int, t int, v double")
    f = {(r.k, r.t): r.v for r in tf.fill_nulls(df, "v", "ffill", order_by="t", partition_by="k").collect()}
    assert f[(1, 2)] == 1.0 and f[(2, 1)] is None
    b = {(r.k, r.t): r.v for r in tf.fill_nulls(df, "v", "bfill", order_by="t", partition_by="k").collect()}
    assert b[(1, 2)] == 3.0


def test_sort_limit_dedup_add(people, spark):
    assert tf.sort(people, "name", True).first().name == "Diana"
    assert tf.limit(people, 2).count() == 2
    d = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "a int, b int")
    assert tf.deduplicate(d).count() == 2
    assert tf.deduplicate(d, "a").count() == 2
    s = spark.createDataFrame([(10, 20)], "a int, b int")
    assert tf.add_column(s, "c", "a + b").first().c == 30


def test_sample_is_exact_and_reproducible(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = [r.k for r in tf.sample(df, 100, 7, "k").collect()]
    b = [r.k for r in tf.sample(df.repartition(13), 100, 7, "k").collect()]
    assert len(a) == 100 and sorted(a) == sorted(b)


def test_text_clean_and_split(spark):
    df = spark.createDataFrame([("  Hello WORLD <b>html</b> https://url.com  ",)], "text string")
    out = tf.text_clean(df, "text", remove_html=True, remove_urls=True).first().text
    assert "hello world" in out and "<b>" not in out and "https" not in out
    words = spark.createDataFrame([(" ".join(["word"] * 100),)], "text string")
    starts = [r._chunk_idx for r in tf.text_split(words, "text", 20, 5).collect()]
    assert starts == [0, 15, 30, 45, 60, 75, 90]
    b7 = spark.createDataFrame([("a b c d e",), ("   ",)], "text string")
    rows = tf.text_split(b7, "text", 3, 1).orderBy("_chunk_idx").collect()
    assert [(r._chunk_idx, r.text) for r in rows] == [(0, "a b c"), (2, "c d e"), (4, "e")]
    with pytest.raises(ValueError):
        tf.text_split(b7, "text", 3, 3)


def test_flatten_json(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":{"c":2}}'), (2, "bad"), (3, "[1]"), (4, None)], "id int, j string")
    out = {r.id: r for r in tf.flatten_json(df, "j").collect()}
    assert len(out) == 4
    assert out[1].j_a == 1 and out[1].j_b == '{"c":2}'
    assert out[2].j_a is None and out[3].j_a is None


def test_merge_null_keys_and_collisions(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x", 10), (1, "y", 11), (3, "z", 12), (None, "n", 13)], "k int, v string, w int")
    assert tf.merge(left, right, "k", "inner").count() == 3
    assert tf.merge(left, right, "k", "left").count() == 4
    assert tf.merge(left, right, "k", "right").count() == 4
    outer = tf.merge(left, right, "k", "outer")
    assert outer.count() == 5 and outer.columns == ["k", "v", "v_right", "w"]
    with pytest.raises(ValueError):
        tf.merge(left, right, "k", "cross")


def test_concat_ragged(spark):
    a = spark.createDataFrame([(1,)], "a int")
    b = spark.createDataFrame([(2,)], "b int")
    out = tf.concat(a, b)
    assert out.columns == ["a", "b"] and out.count() == 2


def test_pipeline_csv_cast_filter(spark, tmp_path):
    p = tmp_path / "people.csv"
    p.write_text("name,age\nAlice,30\nBob,25\nCharlie,35\n")
    pipe = Pipeline("t", spark).add_source("src", {"connector_type": "csv_file", "params": {"path": str(p)}})
    pipe.add_step("cast_type", {"column": "age", "dtype": "int"})
    pipe.add_step("filter_rows", {"column": "age", "operator": ">", "value": "26"})
    assert pipe.run()["count"] == 2
    rows = [(f"person_{i}", str(20 + i), str(50 + 2.5 * i)) for i in range(20)]
    q = tmp_path / "p20.csv"
    q.write_text("name,age,score\n" + "\n".join(",".join(r) for r in rows) + "\n")
    pipe2 = Pipeline("t2", spark).add_source("s", {"connector_type": "csv_file", "params": {"path": str(q)}})
    pipe2.add_step("filter_rows", {"column": "age", "operator": ">", "value": "25"})
    assert pipe2.build().count() == 14


def test_pipeline_errors_name_the_step(spark):
    df = spark.createDataFrame([(1,)], "a int")
    pipe = Pipeline("e", spark).add_source("s", df)
    with pytest.raises(ValueError):
        pipe.add_step("filter", {})
    pipe.add_step("filter_rows", {"column": "zz", "operator": "==", "value": "1"}, step_id="bad1")
    with pytest.raises(PipelineError, match="bad1"):
        pipe.build()
    pipe.set_enabled("bad1", False)
    assert pipe.build().count() == 1


def test_pipeline_from_spec(spark, tmp_path):
    p = tmp_path / "people.csv"
    p.write_text("name,age\nAlice,30\nBob,25\nCharlie,35\n")
    spec = {"name": "spec", "sources": {"people": {"connector_type": "csv_file", "params": {"path": str(p)}}},
            "transforms": [{"id": "c", "op": "cast_type", "params": {"column": "age", "dtype": "int"}},
                           {"id": "f", "op": "filter_rows", "params": {"column": "age", "operator": ">", "value": "26"}},
                           {"id": "x", "op": "limit", "params": {"n": 1}, "enabled": False}]}
    pipe = Pipeline.from_spec(spark, spec)
    assert pipe.run()["count"] == 2
    assert [t["id"] for t in pipe.to_spec()["transforms"]] == ["c", "f", "x"]
    from tessera.sources.inventory import summarize_file
    s = summarize_file(spark, str(p))
    assert s["n_rows"] == 3 and s["columns"] == ["name", "age"] and len(s["preview"]) == 3


def test_pipeline_write_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "a int, b string")
    pipe = Pipeline("w", spark).add_source("s", df)
    pipe.write({"connector_type": "parquet", "params": {"path": str(tmp_path / "p")}})
    pipe.write({"connector_type": "csv", "params": {"path": str(tmp_path / "c")}})
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    with pytest.raises(ValueError):
        pipe.write({"connector_type": "redis", "params": {}})


def test_ffill_with_string_order_column(spark):
    rows = [("u", f"k{i:03d}", float(i) if i % 5 == 0 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, o string, v double")
    got = {r.o: r.v for r in tf.fill_nulls(df, "v", "ffill", order_by="o", partition_by="g").collect()}
    assert all(got[f"k{i:03d}"] == float(i - i % 5) for i in range(60))


def test_sample_is_the_smallest_hashes(spark):
    import hashlib
    df = spark.range(5000).withColumnRenamed("id", "k")
    got = sorted(r.k for r in tf.sample(df, 700, 9, "k").collect())
    want = sorted(range(5000), key=lambda k: hashlib.md5(f"{k}|9".encode()).hexdigest())[:700]
    assert got == sorted(want)
    assert tf.sample(df, 9000, 9, "k").count() == 5000 and tf.sample(df, 0, 9, "k").count() == 0
    assert 2 <= tf.sample_fraction(spark.range(1_000_000).withColumnRenamed("id", "k"), 1e-5, 1, "k").count() <= 30


def test_deep_page_matches_top_n_path(spark):
    df = spark.range(3000).selectExpr("id", "cast(id % 97 as bigint) as g")
    a = [tuple(r) for r in tf.page(df, 1200, 50, "g,id").collect()]
    b = [tuple(r) for r in tf.page(df, 1200, 50, "g,id", shallow=10).collect()]
    assert a == b and len(a) == 50


def test_deep_page_orders_nulls_as_the_shallow_one(spark):
    df = spark.range(900).selectExpr("id", "case when id % 3 > 0 then 'https://example.com/a/b/c/' || (id % 50) end as u")
    for offset in (0, 290, 700):
        a = [tuple(r) for r in tf.page(df, offset, 40, "u").collect()]
        assert a == [tuple(r) for r in tf.page(df, offset, 40, "u", shallow=1).collect()] and len(a) == 40


def test_sort_ranked_of_any_type(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("c",)], "s string")
    assert [(r.s, r["rank"]) for r in tf.sort_ranked(df, "s").collect()] == [(None, 1), ("a", 2), ("b", 3), ("c", 4)]
    assert [(r.s, r["rank"]) for r in tf.sort_ranked(df, "s", descending=True).collect()] == [("c", 1), ("b", 2), ("a", 3), (None, 4)]


def test_fill_median_with_infinities_and_nan(spark):
    import math
    vals = [float("-inf"), float("inf"), float("nan")] + [float(i) for i in range(101)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, v double")
    got = {r.i: r.v for r in tf.fill_nulls(df, "v", "median").collect()}
    assert got[len(vals) - 1] == 51.0 or math.isnan(got[2])


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_split_merge_is_the_plain_merge(spark, how, null_safe):
    """Keys that are hot on both sides, on one side only, and null."""
    rng = random.Random(6)
    keys = ["hot", "hot", "left", "right", None] + [f"k{i}" for i in range(30)]
    left = [(rng.choice(keys[:3] + keys[4:] + ["hot"] * 20 + [None] * 10), rng.randrange(9), i) for i in range(400)]
    right = [(rng.choice(keys[:2] + keys[3:] + ["hot"] * 8 + ["right"] * 20), rng.randrange(9), -i) for i in range(120)]
    l = spark.createDataFrame(left, "k string, v int, a int")
    r = spark.createDataFrame(right, "k string, v int, b int")
    plain = tf.merge(l, r, "k", how, null_safe=null_safe)
    split = tf.merge(l, r, "k", how, null_safe=null_safe, split_heavy=True, heavy_rows=15)
    assert split.columns == plain.columns and split.schema.simpleString() == plain.schema.simpleString()
    assert sorted(map(repr, split.collect())) == sorted(map(repr, plain.collect()))
    # other key names, two keys
    r2 = r.withColumnRenamed("k", "rk").withColumnRenamed("v", "rv")
    plain = tf.merge(l, r2, "k,v", how, right_on="rk,rv", null_safe=null_safe)
    split = tf.merge(l, r2, "k,v", how, right_on="rk,rv", null_safe=null_safe, split_heavy=True, share=0.01, heavy_rows=3)
    assert sorted(map(repr, split.collect())) == sorted(map(repr, plain.collect()))


def test_split_merge_spreads_a_hot_key(spark):
    """A key with a third of both sides: no task of the join has more than its part."""
    l = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    r = spark.range(600).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("b"))
    out = tf.merge(l, r, "k", "outer", split_heavy=True, heavy_rows=50)
    assert out.where("k = -1").count() == 1000 * 200 and out.count() == tf.merge(l, r, "k", "outer").count()
    heavy = tf.heavy_keys(l, ["k"])
    assert heavy == [(-1,)] and tf.heavy_keys(l.limit(0), ["k"]) == []
    assert tf.merge(l.limit(0), r, "k", "outer", split_heavy=True).count() == 600


def test_heavy_keys_are_cut_by_the_pairs_they_make(spark, monkeypatch):
    """Few rows on each side, many pairs: no task makes more than about HEAVY_PAIRS of them."""
    monkeypatch.setattr(tf, "HEAVY_PAIRS", 1000)
    assert tf._cut(10, 20, 10**6) == (1, 1) and tf._cut(900, 20, 10**6) == (18, 1) and tf._cut(20, 900, 10**6) == (1, 18)
    assert tf._cut(620, 310, 10**6) == (20, 10) and tf._cut(50, 7, 10) == (5, 1)
    left = spark.createDataFrame([(None, i) for i in range(300)] + [(1, 300), (2, 301)], "k int, a int")
    right = spark.createDataFrame([(None, i) for i in range(70)] + [(1, 70), (3, 71)], "k int, b int")
    for how in ("inner", "left", "right", "outer"):
        plain = tf.merge(left, right, "k", how)
        split = tf.merge(left, right, "k", how, split_heavy=True)
        assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))
        sizes = [r["count"] for r in split.where("k is null").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 21000 and max(sizes) < 10000
