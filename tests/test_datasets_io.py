"""Dataset factory, converters, connectors, inventories and streaming."""

import os

import pytest
from pyspark.sql import functions as F

from tessera import streaming as st
from tessera.operators import datasets as ds
from tessera.sources import connectors as cx
from tessera.sources import inventory as inv


def test_templates():
    assert len(ds.TEMPLATES) == 21
    assert [f.name for f in ds.TEMPLATES["reasoning"] if f.required] == ["problem", "solution_steps", "answer"]


def test_template_and_preference_validation(spark):
    df = spark.createDataFrame([("hi", "pos"), ("  ", "neg"), ("x", None)], "text string, label string")
    v = [r.violations for r in ds.validate_template(df, "text_classification").collect()]
    assert v == [[], ["text"], ["label"]]
    r = spark.createDataFrame([("q", "", "no")], "prompt string, chosen string, rejected string")
    assert ds.validate_preference(r, "dpo").first().violations == ["chosen"]
    opt = spark.createDataFrame([("p", "s", "a", "extreme")], "problem string, solution_steps string, answer string, difficulty string")
    assert ds.validate_template(opt, "reasoning").first().violations == ["difficulty"]


def test_alpaca_sharegpt_round_trip(spark):
    a = spark.createDataFrame([("Do X", "context", "result"), ("Do Y", "", "answer")], "instruction string, input string, output string")
    sg = ds.alpaca_to_sharegpt(a)
    convs = [r.conversations for r in sg.collect()]
    assert convs[0][0].content == "Do X\n\ncontext" and convs[1][0].content == "Do Y"
    back = ds.sharegpt_to_alpaca(sg).collect()
    assert len(back) == 2 and back[0].output == "result" and back[0].input == ""


def test_sharegpt_to_alpaca_needs_two_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b"), (2, 1, "assistant", "c"), (2, 2, "user", "d"),
                                   (3, 0, "user", "e"), (3, 1, "assistant", "f"), (3, 2, "user", "g"), (3, 3, "assistant", "h")],
                                  "conv_id int, turn int, role string, text string")
    out = {r.conv_id: (r.instruction, r.output) for r in ds.first_two_turns_to_alpaca(turns).collect()}
    assert out == {2: ("b", "c"), 3: ("e", "f")}


def test_coco_yolo_boxes(spark):
    images = spark.createDataFrame([(1, "a/img1.jpg", 100, 200), (2, "img2.jpg", 0, 10), (3, "img3.png", 50, 50)],
                                   "id bigint, file_name string, width bigint, height bigint")
    anns = spark.createDataFrame([(7, 1, 2, 10.0, 20.0, 30.0, 40.0)],
                                 "id bigint, image_id bigint, category_id int, x double, y double, w double, h double")
    y = {r.file_name: r.content for r in ds.coco_to_yolo(images, anns).collect()}
    assert y == {"img1.txt": "2 0.250000 0.200000 0.300000 0.200000", "img3.txt": ""}
    labels = spark.createDataFrame([(1, y["img1.txt"])], "image_id bigint, content string")
    sizes = images.select(F.col("id").alias("image_id"), "width", "height")
    back = ds.yolo_to_coco(labels, sizes).first()
    assert (back.x, back.y, back.w, back.h, back.area) == (10.0, 20.0, 30.0, 40.0, 1200.0)


def test_export_coco_ids(spark):
    s = spark.createDataFrame([(5, "a.jpg", 10, 10, [(1, [1.0, 1.0, 2.0, 2.0], None)]), (9, "b.jpg", 10, 10, []),
                               (12, "c.jpg", 10, 10, [(0, [0.0, 0.0, 1.0, 1.0], 1.0), (3, None, None)])],
                              "k bigint, image_path string, width int, height int, "
                              "annotations array<struct<category_id:int,bbox:array<double>,area:double>>")
    images, anns, _ = ds.export_coco(s, "k")
    assert sorted(r.id for r in images.collect()) == [0, 1, 2]
    a = sorted((r.id, r.image_id, r.area) for r in anns.collect())
    assert a == [(0, 0, 0.0), (1, 2, 1.0), (2, 2, 0.0)]


def test_update_and_delete_samples(spark):
    d = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2")], "_id string, text string, label string")
    upd = ds.update_samples(d, spark.createDataFrame([("a", "z")], "_id string, text string")).orderBy("_id").collect()
    assert (upd[0].text, upd[0].label) == ("z", None) and upd[1].label == "2"
    assert ds.delete_samples(d, spark.createDataFrame([("b",)], "_id string")).count() == 1


def test_connector_options():
    o = cx.jdbc_options("postgresql", host="db", database="shop", query="select * from t", limit=5)
    assert o["url"] == "jdbc:postgresql://db:5432/shop" and o["query"].endswith("LIMIT 5")
    p = cx.jdbc_options("mysql", table="t", partition_column="id", lower_bound=0, upper_bound=100, num_partitions=4)
    assert p["numPartitions"] == "4" and p["dbtable"] == "t"
    with pytest.raises(ValueError):
        cx.jdbc_options("mysql", table="t", partition_column="id")
    assert cx.jdbc_options("clickhouse", table="t")["url"].endswith(":8123/")
    assert cx.kafka_options("b:9092", "events")["startingOffsets"] == "earliest"
    m = cx.mongo_options("mongodb://h", "db", "c", '{"a": 1}', 10)
    assert '"$match"' in m["aggregation.pipeline"] and '"$limit"' in m["aggregation.pipeline"]
    assert cx.elasticsearch_options("h", "idx", '{"query": {}}')["es.query"]
    assert cx.s3_path("bkt", "/a/b") == "s3a://bkt/a/b"




def test_kafka_value_decoding(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("5",), ('"s"',)], "value string")
    assert [r.json for r in cx.decode_kafka_json(df).collect()] == ['{"a": 1}', '{"value":5}', '{"value":"s"}']


def test_inventory_and_detection(spark, tmp_path):
    (tmp_path / "cats").mkdir()
    (tmp_path / "dogs").mkdir()
    for d in ("cats", "dogs"):
        (tmp_path / d / "x.jpg").write_bytes(b"123")
    (tmp_path / "a.jpg").write_bytes(b"1")
    (tmp_path / "t.csv").write_text("a\n1\n")
    prof = inv.dir_profile(inv.file_inventory(spark, str(tmp_path)), str(tmp_path)).first()
    assert prof.file_count == 2 and prof.subdirs == ["cats", "dogs"]
    t = inv.dir_profile(inv.file_inventory(spark, str(tmp_path)), str(tmp_path)) \
        .select(inv.detect_type(F.col("files_by_extension"), F.col("subdirs")).alias("t")).first().t
    assert t == "image_classification"
    labels = sorted(r.label for r in inv.folder_labels(inv.file_inventory(spark, str(tmp_path), glob="*.jpg")).collect())
    assert labels == ["cats", "dogs", tmp_path.name]


def test_stream_rules_and_raw_split(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"event_id": 1, "user_id": 2, "event_type": "view", "value": 1.0}\n{"event_id": 2,\n')
    from tessera.plans.q_stream import _READING
    lines = spark.readStream.text(str(src))
    with pytest.raises(ValueError):
        st.check_stream_step(lines, "sort")
    with pytest.raises(ValueError):
        st.check_stream_step(lines, "fill_nulls", {"strategy": "mean"})
    st.check_stream_step(lines, "filter_rows")
    parsed = st.parse_lines(lines, _READING)
    sink = str(tmp_path / "out")
    st.run_available_now(parsed, sink, str(tmp_path / "ck"))
    rows = spark.read.parquet(sink).collect()
    assert sum(r.event is not None for r in rows) == 1 and sum(r.raw is not None for r in rows) == 1


def test_stream_dedup_within_watermark(spark, tmp_path):
    from tessera.plans.pipeline import Pipeline
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"k": 1, "ts": "2024-01-01 00:00:00"}\n{"k": 1, "ts": "2024-01-01 00:00:01"}\n'
                                '{"k": 2, "ts": "2024-01-01 00:00:02"}\n')
    stream = spark.readStream.schema("k long, ts timestamp").json(str(src))
    p = Pipeline("d", spark).add_source("s", stream)
    p.add_step("deduplicate", {"columns": "k", "watermark": "ts", "delay": "1 hour"})
    out = p.build()
    sink = str(tmp_path / "out")
    st.run_available_now(out, sink, str(tmp_path / "ck"))
    assert sorted(r.k for r in spark.read.parquet(sink).collect()) == [1, 2]


def test_write_yolo_files(spark, tmp_path):
    labels = spark.createDataFrame([("a.txt", "0 0.5 0.5 0.1 0.1"), ("b.txt", "")], "file_name string, content string")
    ds.write_yolo_files(labels, str(tmp_path / "yolo"), ["cat", "dog"])
    assert (tmp_path / "yolo" / "labels" / "a.txt").read_text() == "0 0.5 0.5 0.1 0.1"
    assert (tmp_path / "yolo" / "labels" / "b.txt").read_text() == ""
    assert (tmp_path / "yolo" / "classes.txt").read_text() == "cat\ndog"


def test_detect_type_fixture(spark):
    rows = [({".jpg": 100}, ["cats", "dogs"]), ({".csv": 1}, []), ({".wav": 50}, []), ({".mp4": 20}, []),
            ({".jpg": 3, ".txt": 3}, []), ({".jsonl": 2}, []), ({".bin": 1}, [])]
    df = spark.createDataFrame(rows, "files map<string,bigint>, subdirs array<string>")
    got = [r.t for r in df.select(inv.detect_type(F.col("files"), F.col("subdirs")).alias("t")).collect()]
    assert got == ["image_classification", "tabular", "audio", "video", "object_detection", "text", "unknown"]


def test_label_distribution_paging_and_nested_export(spark, tmp_path):
    from tessera.operators import profile as pr
    from tessera.operators import transforms as tf
    lab = spark.createDataFrame([("a", "pos"), ("b", "neg"), ("c", "pos")], "text string, label string")
    assert {r.label: r["count"] for r in pr.label_distribution(lab).collect()} == {"pos": 2, "neg": 1}
    ten = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "i int, problem string")
    assert [r.i for r in tf.page(ten, 5, 3, "i").collect()] == [5, 6, 7]
    nested = spark.createDataFrame([("Weather?", [("get_weather",)], ("get_weather", '{"city": "London"}'))],
                                   "query string, tools array<struct<name:string>>, tool_call struct<name:string,args:string>")
    ds.export_csv(nested, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert back.tools == '[{"name":"get_weather"}]' and back.tool_call.startswith('{"name":"get_weather"')
    ds.export_jsonl(nested, str(tmp_path / "jsonl"))
    assert spark.read.json(str(tmp_path / "jsonl")).first().tools[0].name == "get_weather"


def test_folder_export_keeps_equal_names_apart_and_reports_missing(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    for d in "ab":
        (tmp_path / d / "x.txt").write_text(d)
    rows = [(f"{tmp_path}/a/x.txt", "l"), (f"{tmp_path}/b/x.txt", "l"), (f"{tmp_path}/c/x.txt", "l"), (f"{tmp_path}/a/x.txt", None)]
    m = ds.folder_manifest(spark.createDataFrame(rows, "image_path string, label string"))
    assert sorted(r.dst for r in m.collect()) == ["imagefolder/l/x-1.txt", "imagefolder/l/x-2.txt", "imagefolder/l/x.txt",
                                                  "imagefolder/unknown/x.txt"]
    got = {r.src[-7:]: r.status for r in ds.copy_manifest(m, str(tmp_path / "out")).collect()}
    assert got == {"a/x.txt": "copied", "b/x.txt": "copied", "c/x.txt": "missing"}
    assert (tmp_path / "out/imagefolder/l/x-1.txt").read_text() == "b"


def test_updates_with_repeated_ids_do_not_multiply_rows(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "_id string, v long")
    up = spark.createDataFrame([("a", 5), ("a", 7)], "_id string, v long")
    assert sorted(tuple(r) for r in ds.update_samples(base, up).collect()) == [("a", 7), ("b", 2)]
    new = spark.createDataFrame([(3,), (3,), (4,)], "v long")
    assert len({r._id for r in ds.append_samples(base, new).collect()}) == 5


def test_csv_round_trip_of_line_breaks(spark, tmp_path):
    from tessera.sources import sinks
    from tessera.sources.files import read_csv
    df = spark.createDataFrame([(1, 'a "quoted", text\nsecond line'), (2, "plain")], "i long, t string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sorted((int(r.i), r.t) for r in read_csv(spark, str(tmp_path / "c")).collect()) == sorted(tuple(r) for r in df.collect())


def test_connector_specs(spark):
    from tessera.sources import connectors as cx
    assert "FETCH FIRST 5 ROWS ONLY" in cx.jdbc_options("derby", query="select 1", limit=5)["query"]
    assert "LIMIT 5" in cx.jdbc_options("mysql", query="select 1", limit=5)["query"]
    df = spark.createDataFrame([('{"a": 1}',), ("{broken",), ("[1]",)], "value string")
    assert [r.json for r in cx.decode_kafka_json(df).collect()] == ['{"a": 1}', '{"value":"{broken"}', '{"value":[1]}']


def test_kafka_spec_with_schema(spark, monkeypatch):
    from tessera.sources import connectors as cx
    seen = {}
    monkeypatch.setattr(cx, "kafka_options", lambda **p: seen.update(p) or {})
    monkeypatch.setattr(cx, "decode_kafka_json", lambda values, schema: schema)

    class Reader:
        def format(self, _):
            return self

        def options(self, **_):
            return self

        def load(self):
            return spark.createDataFrame([("{}",)], "value string")

    class Session:
        read = Reader()
    assert cx.load(Session(), "kafka", {"bootstrap": "b:1", "topic": "t", "schema": "a long"}) == "a long"
    assert seen == {"bootstrap": "b:1", "topic": "t"}


# ------------------------------------------------- state, topics, named files

def _lines_stream(spark, folder, schema="k long, at long, v double"):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_latest_state_and_replayed_batches(spark, tmp_path):
    from tessera.streaming import state
    src = tmp_path / "src"
    src.mkdir()
    rows = [(1, 5, 0.5), (2, 1, None), (1, 3, 9.0), (3, None, 1.0), (2, 7, 2.0), (1, 9, 4.0), (4, 1, 1.5)]
    for i, (k, at, v) in enumerate(rows):
        (src / f"{i}.json").write_text('{"k": %d, "at": %s, "v": %s}' % (k, *("null" if x is None else x for x in (at, v))))
    changes = state.latest_rows(_lines_stream(spark, src), "k", "at", ["at", "v"])
    sink = state.KeyedSink(spark, str(tmp_path / "sink"), "k", changes.schema, gone="gone")
    assert sink.read().count() == 0
    batches = []

    def write(batch, number):
        batch = batch.persist()
        batches.append((batch.toPandas(), number))
        sink.write(batch, number)
        before = sorted(map(tuple, sink.read().collect()))
        sink.write(batch.limit(0), number)  # a replay of the batch, and of an earlier one
        sink.write(batch, max(0, number - 1))
        assert sorted(map(tuple, sink.read().collect())) == before
    st.run_foreach_batch(changes, write, str(tmp_path / "ck"))
    assert sorted(map(tuple, sink.read().collect())) == [(1, 9, 4.0), (2, 7, 2.0), (4, 1, 1.5)]
    changed = [tuple(r) for b, _ in batches for r in b[["k", "at"]].itertuples(index=False)]
    for k in (1, 2, 4):  # only changed keys: older readings (files come in any order) and the null order are silent
        at = [a for i, a in changed if i == k]
        assert at == sorted(set(at)) and at[-1] == max(a for i, a, _ in rows if i == k)
    assert 3 not in {i for i, _ in changed}


def test_state_expires_when_idle(spark, tmp_path):
    from tessera.sources import topics
    from tessera.streaming import state
    src = tmp_path / "src"
    src.mkdir()
    (src / "0.json").write_text('{"k": 1, "at": 5, "v": 0.5}')
    changes = state.latest_rows(_lines_stream(spark, src), "k", "at", ["at", "v"], idle_ms=1)
    sink = state.KeyedSink(spark, str(tmp_path / "sink"), "k", changes.schema, gone="gone")
    seen = []

    def write(batch, number):
        batch = batch.persist()
        seen.extend(batch.collect())
        sink.write(batch, number)
        if number == 0:
            (src / "1.json").write_text('{"k": 2, "at": 1, "v": 1.0}')
    topics.read_until_idle(changes, write, str(tmp_path / "ck"), idle_seconds=4.0, mode="update")
    assert (1, 5, 0.5, True) in [tuple(r) for r in seen]
    assert 1 not in {r.k for r in sink.read().collect()}


def test_summary_state_over_batches(spark, tmp_path):
    from tessera.streaming import state
    src = tmp_path / "src"
    src.mkdir()
    for i in range(6):
        (src / f"{i}.json").write_text("\n".join('{"k": %d, "at": %d, "v": %s}' % (j % 2, 10 * i + j, "null" if j == 3 else i + j)
                                                 for j in range(4)))
    changes = state.running_summary(_lines_stream(spark, src), "k", "at", "v")
    sink = state.KeyedSink(spark, str(tmp_path / "sink"), "k", changes.schema)
    st.run_foreach_batch(changes, sink.write, str(tmp_path / "ck"))
    got = {r.k: tuple(r)[1:] for r in sink.read().collect()}
    v = {k: [float(i + j) for i in range(6) for j in range(4) if j % 2 == k and j != 3] for k in (0, 1)}
    assert got == {k: (12, len(v[k]), sum(v[k]), min(v[k]), 52 + k) for k in (0, 1)}


def test_topic_offsets_restart_and_limits(spark, tmp_path):
    from tessera.sources import topics
    from tessera.streaming.state import AppendSink
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(i, i % 7, f"m{i} é") for i in range(200)], "i int, k int, v string")
    topics.write_topic(df, path, "k", "v", partitions=3, segment_rows=11, order=["i"])
    rows = topics.read_topic(spark, path).collect()
    assert sorted(r.value for r in rows) == sorted(f"m{i} é" for i in range(200))
    ends = topics.end_offsets(path)
    by = {}
    for r in rows:
        by.setdefault(str(r.partition), {})[r.offset] = r.value
    assert {p: sorted(o) for p, o in by.items()} == {p: list(range(n)) for p, n in ends.items()}
    for p, n in ends.items():  # within a partition in the order given
        numbers = [int(by[p][o][1:-2]) for o in range(n)]
        assert numbers == sorted(numbers)
    for cut in (0, 1, 10, 11, 12, 40):
        a = topics.read_topic(spark, path, ending={p: min(cut, n) for p, n in ends.items()}).collect()
        b = topics.read_topic(spark, path, starting={p: min(cut, n) for p, n in ends.items()}).collect()
        assert sorted(a + b) == sorted(rows) and len(a) == sum(min(cut, n) for n in ends.values())
    # a stream, stopped by its limit and by silence; the second run goes on from the checkpoint
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    stream = topics.topic_stream(spark, path, starting={"0": 2})
    assert topics.read_until_idle(stream, AppendSink(out).write, ck, idle_seconds=60, max_rows=1) == 200 - (2 if "0" in ends else 0)
    more = spark.createDataFrame([(0, 0, "late")], "i int, k int, v string")
    part = next(p for p in ends if any(v.startswith("m0 ") for v in by[p].values()))
    folder = tmp_path / "log" / f"partition={part}" / f"segment={ends[part]}"
    folder.mkdir()
    (folder / "part-x.txt").write_bytes(b"late\nnot yet whole")
    assert more.count() == 1 and topics.end_offsets(path)[part] == ends[part] + 1
    assert topics.read_until_idle(topics.topic_stream(spark, path, starting={"0": 2}), AppendSink(out).write, ck, idle_seconds=3) == 1
    got = [r.value for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted([r.value for r in rows if not (r.partition == 0 and r.offset < 2)] + ["late"])


def test_named_files_survive_killed_and_repeated_tasks(tmp_path):
    from pyspark.sql import Row
    from tessera.sources.named_files import NamedFilesWriter
    out = tmp_path / "out"
    out.mkdir()
    w = NamedFilesWriter({"path": str(out), "job": "j"})
    rows = [Row(name=f"d/{i}.txt", content=f"c{i}") for i in range(4)]

    def dying():
        yield from rows[:2]
        raise RuntimeError("killed")
    with pytest.raises(RuntimeError):
        w.write(dying())
    assert not (out / "d").exists()  # a killed task leaves no file
    first, again = w.write(iter(rows[:2])), w.write(iter(rows[:2]))  # a task that ran twice
    w.write(iter(rows[2:]))
    w.commit([first, again])
    assert sorted(p.name for p in (out / "d").iterdir()) == ["0.txt", "1.txt", "2.txt", "3.txt"]
    assert (out / "d" / "1.txt").read_text() == "c1" and sorted(p.name for p in out.iterdir()) == ["_SUCCESS", "d"]
    other = NamedFilesWriter({"path": str(out), "job": "k"})
    done = other.write(iter([Row(name="e.txt", content=b"\x00")]))
    with pytest.raises(RuntimeError):
        other.write(dying())
    other.abort([done, None])  # the job failed: what its tasks had published goes
    assert sorted(p.name for p in out.iterdir()) == ["_SUCCESS", "d"]
    with pytest.raises(ValueError):
        other.target("../x")


def test_named_files_of_a_failing_job_are_gone(spark, tmp_path):
    from tessera.sources.named_files import write_named_files
    out = str(tmp_path / "out")
    df = spark.range(20).repartition(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"),
                                               F.when(F.col("id") == 13, F.raise_error(F.lit("boom"))).otherwise(F.lit("x")).alias("content"))
    with pytest.raises(Exception, match="boom"):
        write_named_files(df, out)
    import os
    assert [f for f in os.listdir(out) if not f.startswith(".staging")] == []
    write_named_files(df.where("id <> 13"), out)
    assert len([f for f in os.listdir(out) if f.startswith("f")]) == 19


# --------------------------------------------------------------- CSV in ranges

def _same_as_whole(spark, path, sep=",", schema=None):
    from tessera.sources.files import read_csv
    want = read_csv(spark, path, sep, whole_files=True, schema=schema)
    got = read_csv(spark, path, sep, schema=schema)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    return got


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "40")
    spark.conf.set(names[1], "0")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_csv_ranges_with_quoted_line_breaks(spark, tmp_path, small_ranges):
    import csv
    import random
    rng = random.Random(5)
    parts = ["a", "bb", '"', ",", "\n", "\n\n", " ", "é", "x" * 30, '""', "\r\n", "'"]
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(3):
        with open(folder / f"{i}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, quoting=csv.QUOTE_ALL if i == 1 else csv.QUOTE_MINIMAL, lineterminator="\r\n" if i == 2 else "\n")
            w.writerow(["id", "text", "more"])
            for j in range(40):
                w.writerow([i * 100 + j, "".join(rng.choices(parts, k=rng.randrange(0, 9))), "".join(rng.choices(parts, k=3))])
    from tessera.sources.files import read_csv
    rows = read_csv(spark, str(folder)).collect()
    want = []
    for i in range(3):
        with open(folder / f"{i}.csv", newline="", encoding="utf-8") as f:
            want += [tuple(x or None for x in r) for r in list(csv.reader(f))[1:]]
    key = lambda r: int(r[0])
    assert [tuple(x or None for x in r) for r in sorted(map(tuple, rows), key=key)] == sorted(want, key=key)
    # a whole-file read turns quoted CRLF into LF where lines end in CRLF
    whole = read_csv(spark, str(folder), whole_files=True).collect()
    assert sorted(repr(r).replace("\\r\\n", "\\n") for r in rows) == sorted(repr(r).replace("\\r\\n", "\\n") for r in whole)


@pytest.mark.parametrize("text", [
    'a,b\n1,x\n2,"y\nz"\n3,5" pipe\n4,"q"\n', 'a,b\n"1\n\n\n\n' + "z" * 200 + '\n2\n",x\n5,y', 'a,b\n', 'a,b\n\n1,2\n\n3,4\n',
    'a,b\n1\n2,3,4\n"",""\n', '"a\nc",b\n"1\n2",3\n', 'a,b\n1,"x"y\n2,z\n', 'a,b\n1,""""\n2,"""\n"""\n3,z\n'], ids=range(8))
def test_csv_ranges_on_odd_texts(spark, tmp_path, small_ranges, text):
    path = tmp_path / "x.csv"
    path.write_bytes(text.encode())
    _same_as_whole(spark, str(path))


def test_csv_ranges_with_separator_and_schema(spark, tmp_path, small_ranges):
    path = tmp_path / "x.csv"
    path.write_text('k;v;t\n1;2.5;"a;b\n""c"\n2;;plain\n3;x;"\n\n"\n')
    _same_as_whole(spark, str(path), ";")
    _same_as_whole(spark, str(path), ";", "k int, v double, t string")


def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path):
    from tessera.sources.files import read_csv
    path = tmp_path / "big.csv"
    with open(path, "w") as f:
        f.write("id,text\n")
        for i in range(30_000):
            f.write(f'{i},"line one of {i}\nline, ""two"" {"y" * 40}"\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
    try:
        df = read_csv(spark, str(path))
        assert df.select(F.spark_partition_id()).distinct().count() >= 8
        row = df.agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("s"), F.count_if(F.col("text").contains("\n")).alias("b")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tuple(row) == (30_000, sum(range(30_000)), 30_000)


def test_json_array_files(spark, tmp_path):
    import json
    from tessera.sources import sinks
    from tessera.sources.files import read_json
    path = tmp_path / "a"
    df = spark.createDataFrame([(i, None if i % 3 else f'é"{i}\n') for i in range(7)], "`a.b` int, t string").repartition(9)
    sinks.write_json_array(df, str(path))
    arrays = [json.loads(p.read_text()) for p in path.iterdir() if p.name.startswith("part-")]
    assert [] in arrays and sorted(r["a.b"] for a in arrays for r in a) == list(range(7))
    back = read_json(spark, str(path), lines=False, schema=df.schema)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_functions_by_name(spark):
    from tessera.functions import formulas
    from tessera.operators import transforms as tf
    df = spark.createDataFrame([(2.0,), (None,)], "x double")
    formulas.register_function(spark, "twice_of", "v double", "double", "2 * v")
    assert [r.y for r in tf.add_column(df, "y", "twice_of(x) + 1").collect()] == [5.0, None]
    formulas.register_function(spark, "twice_of", "v double", "double", "20 * v")
    assert tf.add_column(df, "y", "twice_of(x)").first().y == 40.0
    with pytest.raises(ValueError):
        formulas.register_function(spark, "a b", "v double", "double", "v")


def test_named_files_are_read_without_a_list_of_them(spark, tmp_path):
    from tessera.sources.named_files import read_named_files, write_named_files
    rows = [(f"l/a {i}+é%20.txt", f"é{i}" * i) for i in range(60)]
    write_named_files(spark.createDataFrame(rows, "name string, content string"), str(tmp_path))
    found = read_named_files(spark, str(tmp_path / "l"), tasks=7)
    assert sorted(tuple(r) for r in found.select(F.concat(F.lit("l/"), "name"), F.col("content").cast("string")).collect()) == sorted(rows)
    assert found.rdd.getNumPartitions() == 7 and not found.inputFiles()  # no file index on the driver


def test_json_array_files_are_bounded(spark, tmp_path):
    import json
    from tessera.sources import sinks
    sinks.write_json_array(spark.range(0, 1000, 1, 1), str(tmp_path / "a"), files=3, max_rows=100)
    sizes = [len(json.loads(p.read_text())) for p in (tmp_path / "a").iterdir() if p.name.startswith("part-")]
    assert sum(sizes) == 1000 and len(sizes) == 10 and max(sizes) <= 110


def test_summaries_cost_few_batches_and_no_python_per_key(spark, tmp_path):
    from tessera.streaming import state
    src = tmp_path / "src"
    spark.range(0, 400, 1, 40).selectExpr("id % 9 AS k", "id AS at", "double(id) AS v").write.json(str(src))
    assert st.files_a_batch(spark, str(src), 2) == 5 and st.files_a_batch(spark, str(src), 20) == 20
    stream = st.json_stream(spark, str(src), spark.read.json(str(src)).schema, max_files=st.files_a_batch(spark, str(src), 2))
    changes = state.running_summary(stream, "k", "at", "v")
    assert "TransformWithState" not in changes._jdf.queryExecution().logical().toString()
    sink, batches = state.KeyedSink(spark, str(tmp_path / "sink"), "k", changes.schema), []
    st.run_foreach_batch(changes, lambda b, n: (batches.append(n), sink.write(b, n)), str(tmp_path / "ck"))
    assert len(batches) == 8
    want = {k: (len(v), len(v), float(sum(v)), float(min(v)), max(v)) for k in range(9) if (v := [i for i in range(400) if i % 9 == k])}
    assert {r.k: tuple(r)[1:] for r in sink.read().collect()} == want


def test_idle_time_starts_with_the_first_look():
    """A stream that takes longer to start than ``idle_seconds`` is still read."""
    import time
    from tessera.sources import topics

    class Query:
        isActive, begun = True, time.monotonic()

        def at(self, starting, running, waiting):
            s = time.monotonic() - self.begun
            return starting if s < 0.6 else running if s < 1.2 else waiting
        status = property(lambda q: q.at({"message": "Initializing sources", "isTriggerActive": False, "isDataAvailable": False},
                                         {"message": "Getting offsets", "isTriggerActive": True, "isDataAvailable": False},
                                         {"message": "Waiting for data to arrive", "isTriggerActive": False, "isDataAvailable": False}))
        recentProgress = property(lambda q: q.at([], [], [{"numInputRows": 5, "batchId": 0}]))

        def exception(self):
            return None

        def stop(self):
            pass

    class Stream:
        def __getattr__(self, name):
            return lambda *a, **b: Query() if name == "start" else self
    stream = Stream()
    stream.writeStream = stream
    assert topics.read_until_idle(stream, None, "unused", idle_seconds=0.3) == 5
