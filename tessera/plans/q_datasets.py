"""Registered queries: template / preference validation, sample edits,
exporters and converters, splits, batches, label encoding, synthetic tables
and augmentation.  Image-style datasets are derived from the order tables
(orders = images, lineitems = boxes) so their size follows the inputs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessera.operators import datasets as ds
from tessera.operators import prep
from tessera.plans.registry import query
from tessera.session import checkpoint_dir
from tessera.sources.files import table
from tessera.sources.named_files import read_named_files

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _blank(x: str) -> str:
    return f"({x} IS NULL OR {_STRIP.format(x=x)} = '')"


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "exports", f"{name}-{uuid.uuid4().hex[:12]}")


# --------------------------------------------------------------------------- validation

def _labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    lab = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good")
                                           .when(F.col("quality") == 0, "poor").alias("label"))
    return docs.join(lab, "doc_id", "left")


query("validate_template", f"""SELECT doc_id, len(v) = 0 AS valid, array_to_string(v, ',') AS violations FROM (
 SELECT d.doc_id, list_filter([CASE WHEN {_blank('d.text')} THEN 'text' END,
   CASE WHEN {_blank("CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END")} THEN 'label' END], lambda x: x IS NOT NULL) AS v
 FROM documents d LEFT JOIN labels l USING (doc_id)) t""")(
    lambda spark, d: ds.validate_template(_labelled(spark, d), "text_classification")
    .select("doc_id", "valid", F.array_join("violations", ",").alias("violations")))

_DPO_SQL = """SELECT u.conv_id * 1000 + u.turn AS pair_id, u.text AS prompt, a.text AS chosen, r.text AS rejected
 FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
 LEFT JOIN conversations r ON r.conv_id = u.conv_id AND r.turn = u.turn + 3 AND r.role = 'assistant'
 WHERE u.role = 'user'"""


def _dpo(spark, d):
    c = table(spark, d, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("chosen"))
    r = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 3).alias("turn"), F.col("text").alias("rejected"))
    return u.join(a, ["conv_id", "turn"], "left").join(r, ["conv_id", "turn"], "left").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "prompt", "chosen", "rejected")


query("validate_preference", f"""SELECT pair_id, len(v) = 0 AS valid, array_to_string(v, ',') AS violations FROM (
 SELECT pair_id, list_filter([CASE WHEN {_blank('prompt')} THEN 'prompt' END, CASE WHEN {_blank('chosen')} THEN 'chosen' END,
   CASE WHEN {_blank('rejected')} THEN 'rejected' END], lambda x: x IS NOT NULL) AS v FROM ({_DPO_SQL}) p) t""")(
    lambda spark, d: ds.validate_preference(_dpo(spark, d), "dpo")
    .select("pair_id", "valid", F.array_join("violations", ",").alias("violations")))

# --------------------------------------------------------------------------- samples


def _dataset(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return docs.withColumn("_id", ds.sample_id(docs, ["doc_id"], "d"))


def _append_samples(spark, d):
    base = _dataset(spark, d).select("_id", "source", F.length("text").cast("bigint").alias("n_chars"))
    bench = table(spark, d, "benchmark")
    new = bench.select(ds.sample_id(bench, ["item_id"], "b").alias("_id"), F.lit("benchmark").alias("source"),
                       F.length("text").cast("bigint").alias("n_chars"))
    return base.unionByName(new)


query("append_samples", """SELECT md5(concat_ws('|', 'd', CAST(doc_id AS VARCHAR))) AS _id, source, n_chars
 FROM documents
UNION ALL SELECT md5(concat_ws('|', 'b', CAST(item_id AS VARCHAR))), 'benchmark', CAST(length(text) AS BIGINT)
 FROM benchmark""")(_append_samples)

# ids from the content alone: copies of a text are told apart by a number
query("append_copies", """SELECT md5(concat_ws('|', '', lang, text)) || CASE WHEN k > 0 THEN '-' || k ELSE '' END AS _id, count(*) AS n
FROM (SELECT lang, text, row_number() OVER (PARTITION BY md5(concat_ws('|', '', lang, text)) ORDER BY doc_id) - 1 AS k FROM documents)
GROUP BY 1""")(
    lambda spark, d: ds.append_samples(
        spark.createDataFrame([], "_id string"), table(spark, d, "documents").select("lang", "text"))
    .groupBy("_id").agg(F.count(F.lit(1)).alias("n")))


query("delete_samples", """SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")(
    lambda spark, d: ds.delete_samples(table(spark, d, "documents").select("doc_id", "source"),
                                       table(spark, d, "labels").where(F.col("toxic") == 1), "doc_id"))

query("update_samples", """SELECT d.doc_id, CASE WHEN u.doc_id IS NOT NULL THEN 'redacted' ELSE d.text END AS text,
 CASE WHEN u.doc_id IS NOT NULL THEN NULL ELSE d.lang END AS lang,
 CASE WHEN u.doc_id IS NOT NULL THEN NULL ELSE d.source END AS source
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) u USING (doc_id)""")(
    lambda spark, d: ds.update_samples(table(spark, d, "documents").select("doc_id", "text", "lang", "source"),
                                       table(spark, d, "labels").where(F.col("quality") == 0)
                                       .select("doc_id", F.lit("redacted").alias("text")), "doc_id"))

# --------------------------------------------------------------------------- exporters


def _export_jsonl(spark, d):
    path = scratch(spark, "jsonl")
    ds.export_jsonl(table(spark, d, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("_n")), path)
    return spark.read.schema("doc_id bigint, lang string, source string").json(path)


query("export_jsonl", "SELECT doc_id, lang, source FROM documents")(_export_jsonl)

_SHAREGPT_SQL = """SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS conversations
 FROM conversations GROUP BY conv_id"""


def _sharegpt(spark, d):
    return ds.sharegpt_rows(table(spark, d, "conversations"))


def _export_csv(spark, d):
    path = scratch(spark, "csv")
    ds.export_csv(_sharegpt(spark, d), path)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"') \
        .schema("conv_id bigint, conversations string").csv(path)


query("export_csv", f"SELECT conv_id, CAST(to_json(conversations) AS VARCHAR) AS conversations FROM ({_SHAREGPT_SQL}) s")(
    _export_csv)


def _export_columnar(spark, d):
    path = scratch(spark, "parquet")
    ds.export_columnar(_sharegpt(spark, d), path)
    return spark.read.parquet(path)


query("export_columnar", f"SELECT conv_id, CAST(to_json(conversations) AS VARCHAR) AS conversations FROM ({_SHAREGPT_SQL}) s")(
    _export_columnar)
query("export_sharegpt", f"""SELECT conv_id, CAST(to_json({{'conversations': conversations}}) AS VARCHAR) AS json
 FROM ({_SHAREGPT_SQL}) s""")(
    lambda spark, d: _sharegpt(spark, d).select("conv_id", F.to_json(F.struct("conversations")).alias("json")))

_PAIRS_SQL = """SELECT u.conv_id * 1000 + u.turn AS pair_id, u.text AS instruction,
  CASE WHEN u.turn = 0 THEN '' ELSE 'turn ' || u.turn END AS input, a.text AS output
 FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
 WHERE u.role = 'user'"""


def _alpaca_src(spark, d):
    c = table(spark, d, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("instruction"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return u.join(a, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "instruction",
        F.when(F.col("turn") == 0, "").otherwise(F.concat(F.lit("turn "), F.col("turn").cast("string"))).alias("input"),
        "output")


query("export_alpaca", f"""SELECT pair_id, coalesce(instruction, '') AS instruction, coalesce(input, '') AS input,
 coalesce(output, '') AS output FROM ({_PAIRS_SQL}) p""")(
    lambda spark, d: _alpaca_src(spark, d).select("pair_id", *[F.coalesce(c, F.lit("")).alias(c)
                                                               for c in ("instruction", "input", "output")]))
query("alpaca_to_sharegpt", f"""SELECT pair_id, CAST(to_json([
  {{'role': 'user', 'content': CASE WHEN coalesce(input, '') <> '' THEN coalesce(instruction, '') || chr(10) || chr(10) || input
     ELSE coalesce(instruction, '') END}},
  {{'role': 'assistant', 'content': coalesce(output, '')}}]) AS VARCHAR) AS conversations FROM ({_PAIRS_SQL}) p""")(
    lambda spark, d: ds.alpaca_to_sharegpt(_alpaca_src(spark, d))
    .select("pair_id", F.to_json("conversations").alias("conversations")))
query("sharegpt_to_alpaca", """SELECT conv_id, coalesce(max(CASE WHEN rn = 1 THEN text END), '') AS instruction, '' AS input,
 coalesce(max(CASE WHEN rn = 2 THEN text END), '') AS output FROM (
 SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) t
WHERE rn <= 2 GROUP BY conv_id HAVING count(*) >= 2""")(
    lambda spark, d: ds.first_two_turns_to_alpaca(table(spark, d, "conversations")))

# --------------------------------------------------------------------------- boxes

_IMAGES_SQL = """SELECT o_orderkey AS id, 'images/' || o_orderkey || '.jpg' AS file_name,
 CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 320 + CAST(floor(o_totalprice) AS BIGINT) % 640 END AS width, 480 AS height FROM orders"""
_ANNS_SQL = """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS image_id, l_linenumber - 1 AS category_id,
 l_quantity AS x, l_discount * 1000 AS y, l_quantity * 2 AS w, l_tax * 1000 + 1 AS h FROM lineitem"""


def coco_images(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"),
                    F.concat(F.lit("images/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"),
                    F.when(F.col("o_orderstatus") == "P", F.lit(0).cast("bigint"))
                    .otherwise(F.lit(320) + F.floor("o_totalprice").cast("bigint") % 640).alias("width"),
                    F.lit(480).alias("height"))


def coco_annotations(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("image_id"),
                     (F.col("l_linenumber") - 1).alias("category_id"), F.col("l_quantity").alias("x"),
                     (F.col("l_discount") * 1000).alias("y"), (F.col("l_quantity") * 2).alias("w"),
                     (F.col("l_tax") * 1000 + 1).alias("h"))


_YOLO_SQL = f"""WITH i AS ({_IMAGES_SQL}), a AS ({_ANNS_SQL}),
lines AS (SELECT i.id AS image_id, i.file_name, a.id AS aid,
  printf('%d %.6f %.6f %.6f %.6f', a.category_id, round((a.x + a.w / 2) / i.width, 6), round((a.y + a.h / 2) / i.height, 6),
         round(a.w / i.width, 6), round(a.h / i.height, 6)) AS line
  FROM i LEFT JOIN a ON a.image_id = i.id WHERE i.width <> 0 AND i.height <> 0)
SELECT image_id, regexp_replace(regexp_extract(file_name, '([^/]*)$', 1), '\\.[^.]*$', '') || '.txt' AS file_name,
 CAST(count(aid) AS BIGINT) AS n_lines, coalesce(string_agg(CASE WHEN aid IS NOT NULL THEN line END, chr(10) ORDER BY aid, line), '') AS content
FROM lines GROUP BY image_id, file_name"""


def yolo_labels(spark, d):
    return ds.coco_to_yolo(coco_images(spark, d), coco_annotations(spark, d))


query("coco_to_yolo", _YOLO_SQL)(yolo_labels)

query("yolo_to_coco", f"""WITH y AS ({_YOLO_SQL}), i AS ({_IMAGES_SQL}),
l AS (SELECT image_id, unnest(s) AS line, generate_subscripts(s, 1) AS line_no
  FROM (SELECT image_id, string_split(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), chr(10)) AS s FROM y) t),
p AS (SELECT image_id, line_no, string_split(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), ' ') AS p FROM l),
b AS (SELECT p.image_id, line_no, CAST(p[1] AS INTEGER) AS category_id,
  (CAST(p[2] AS DOUBLE) - CAST(p[4] AS DOUBLE) / 2) * i.width AS x, (CAST(p[3] AS DOUBLE) - CAST(p[5] AS DOUBLE) / 2) * i.height AS y,
  CAST(p[4] AS DOUBLE) * i.width AS w, CAST(p[5] AS DOUBLE) * i.height AS h FROM p JOIN i ON i.id = p.image_id WHERE len(p) >= 5)
SELECT CAST(row_number() OVER (ORDER BY image_id, line_no) - 1 AS BIGINT) AS id, image_id, category_id,
 round(x, 1) AS x, round(y, 1) AS y, round(w, 1) AS w, round(h, 1) AS h, round(w * h, 1) AS area FROM b""")(
    lambda spark, d: ds.yolo_to_coco(yolo_labels(spark, d).select("image_id", "content"),
                                     coco_images(spark, d).select(F.col("id").alias("image_id"), "width", "height")))


def _coco_samples(spark, d):
    imgs = coco_images(spark, d)
    anns = coco_annotations(spark, d).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("id").alias("k"), F.col("category_id").alias("category_id"),
        F.array("x", "y", "w", "h").alias("bbox"), (F.col("w") * F.col("h")).alias("area")))).alias("a"))
    anns = anns.select("image_id", F.transform("a", lambda x: F.struct(x["category_id"].alias("category_id"),
                                                                      x["bbox"].alias("bbox"), x["area"].alias("area")))
                       .alias("annotations"))
    return imgs.join(anns, imgs.id == anns.image_id, "left").select(
        F.col("id").alias("order_key"), F.col("file_name").alias("image_path"), "width", "height", "annotations")


def _export_coco(spark, d):
    _, anns, _ = ds.export_coco(_coco_samples(spark, d), "order_key")
    return anns.select("id", "image_id", F.col("category_id").cast("bigint").alias("category_id"),
                       F.array_join(F.transform("bbox", lambda v: F.format_string("%.4f", v)), ",").alias("bbox"),
                       F.format_string("%.4f", "area").alias("area"), F.col("iscrowd").cast("bigint").alias("iscrowd"))


query("export_coco", f"""WITH i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS img_pos FROM ({_IMAGES_SQL}) t),
a AS ({_ANNS_SQL})
SELECT CAST(row_number() OVER (ORDER BY i.img_pos, a.id, a.category_id, x, y, w, h) - 1 AS BIGINT) AS id, CAST(i.img_pos AS BIGINT) AS image_id,
 CAST(a.category_id AS BIGINT) AS category_id,
 printf('%.4f', x) || ',' || printf('%.4f', y) || ',' || printf('%.4f', w) || ',' || printf('%.4f', h) AS bbox,
 printf('%.4f', w * h) AS area, CAST(0 AS BIGINT) AS iscrowd FROM a JOIN i ON a.image_id = i.id""")(_export_coco)


def _export_yolo(spark, d):
    """Labels written and read back, with the lines of each file."""
    path = scratch(spark, "yolo")
    yolo_labels(spark, d).select("file_name", "content").write.mode("overwrite").parquet(path)
    lines = F.size(F.filter(F.split("content", "\n"), lambda x: x != "")).cast("bigint")
    return spark.read.parquet(path).select("file_name", lines.alias("lines"), F.md5("content").alias("md5"))


query("export_yolo", f"""SELECT file_name, CAST(len(list_filter(string_split(content, chr(10)), lambda x: x <> '')) AS BIGINT) AS lines,
 md5(content) AS md5 FROM ({_YOLO_SQL}) y""")(_export_yolo)



def _export_yolo_files(spark, d):
    """The label files themselves, written by name and read back from the folder."""
    path = scratch(spark, "yolo-files")
    ds.write_yolo_files(yolo_labels(spark, d), path[len("file:"):] if path.startswith("file:") else path, ["box"])
    return read_named_files(spark, f"{path}/labels").select(F.col("name").alias("file_name"), F.md5("content").alias("md5"))


query("export_yolo_files", f"SELECT file_name, md5(content) AS md5 FROM ({_YOLO_SQL}) y WHERE content <> ''")(
    lambda spark, d: _export_yolo_files(spark, d).where(F.col("md5") != F.md5(F.lit(""))))


def _yolo_samples(spark, d):
    li = table(spark, d, "lineitem")
    box = F.struct(F.when(F.col("l_returnflag") != "R", F.col("l_linenumber")).alias("class_id"), F.col("l_partkey").alias("x_center"),
                   F.col("l_suppkey").alias("y_center"), F.col("l_linenumber").alias("width"), F.col("l_linenumber").alias("height"))
    boxes = li.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", box.alias("b")))),
                                                     lambda x: x["b"]).alias("annotations"))
    images = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("_id"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(
            F.lit("img/o."), F.col("o_orderkey").cast("string"), F.lit(".jpg"))).alias("image_path"))
    return images.join(boxes, F.col("_id") == F.col("l_orderkey"), "left")


query("export_yolo_samples", """WITH a AS (SELECT l_orderkey, string_agg(concat_ws(' ', l_linenumber, l_partkey, l_suppkey, l_linenumber,
  l_linenumber) || chr(10), '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS content FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT CASE WHEN o_orderkey % 3 > 0 THEN 'o.' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END || '.txt' AS file_name,
 coalesce(content, '') AS content FROM orders LEFT JOIN a ON o_orderkey = l_orderkey""")(
    lambda spark, d: ds.yolo_from_samples(_yolo_samples(spark, d)).drop("src"))

query("folder_manifest", """SELECT 'docs/' || doc_id || '.txt' AS src,
 'imagefolder/' || coalesce(lang, 'unknown') || '/' || doc_id || '.txt' AS dst FROM documents""")(
    lambda spark, d: ds.folder_manifest(table(spark, d, "documents").select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("image_path"),
        F.col("lang").alias("label"))))

# --------------------------------------------------------------------------- format round trips


def _csv_to_jsonl(spark, d):
    src, dst = scratch(spark, "csvsrc"), scratch(spark, "jsonl")
    table(spark, d, "customer").write.mode("overwrite").option("header", True).csv(src)
    from tessera.sources.files import read_csv
    ds.export_jsonl(read_csv(spark, src), dst)
    return spark.read.json(dst)


query("csv_to_jsonl", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
 CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer""")(_csv_to_jsonl)


def _jsonl_to_csv(spark, d):
    src, dst = scratch(spark, "jsonsrc"), scratch(spark, "csv")
    table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props").write.mode("overwrite").json(src)
    from tessera.sources.files import read_csv, read_json
    ds.export_csv(read_json(spark, src), dst)
    return read_csv(spark, dst)


query("jsonl_to_csv", """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, props, CAST(user_id AS VARCHAR) AS user_id,
 CAST(value AS VARCHAR) AS value FROM events""")(_jsonl_to_csv)

# --------------------------------------------------------------------------- splits / batches / labels

query("split_random", """SELECT doc_id, CASE WHEN substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 13) < 'ccccccccccccd'
 THEN 'train' ELSE 'validation' END AS split FROM documents""")(
    lambda spark, d: prep.random_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.8, 42))
query("split_sizes", """SELECT CASE WHEN substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 13) < 'ccccccccccccd'
 THEN 'train' ELSE 'validation' END AS split, CAST(count(*) AS BIGINT) AS n_samples FROM documents GROUP BY 1""")(
    lambda spark, d: prep.split_sizes(prep.random_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.8, 42)))
query("label_encode", """WITH l AS (SELECT o_orderpriority AS label, row_number() OVER (ORDER BY o_orderpriority) - 1 AS class_id
  FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL) t)
SELECT o_orderkey, o_orderpriority, CAST(class_id AS BIGINT) AS class_id, CAST((SELECT count(*) FROM l) AS BIGINT) AS n_classes
FROM orders LEFT JOIN l ON o_orderpriority = l.label""")(
    lambda spark, d: prep.label_encode(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority"))
query("batch_ids", """SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id) - 1) / 32)
 AS BIGINT) AS batch_id FROM documents""")(
    lambda spark, d: prep.batch_ids(table(spark, d, "documents").select("doc_id"), "doc_id", 32, 7))

# --------------------------------------------------------------------------- synthetic / augmentation


def _keys(spark, d):
    return table(spark, d, "embeddings").select("vec_id")


def _u(key: str, seed: int, salt) -> str:
    """The uniform of ``prep.uniform`` in SQL."""
    return (f"(CAST(CAST('0x' || substr(md5(concat_ws(':', CAST({key} AS VARCHAR), '{seed}', CAST({salt} AS VARCHAR))), 1, 13)"
            f" AS UBIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE)")


def _n(key: str, seed: int, salt) -> str:
    return f"(sqrt(-2.0 * ln(greatest({_u(key, seed, salt)}, 1e-300))) * cos(2 * pi() * {_u(key, seed + 7919, salt)}))"


def _lin(a: float, b: float) -> str:
    return f"({a}::DOUBLE + ({b}::DOUBLE - {a}::DOUBLE) * i / greatest(half - 1, 1))"


_LAYOUT_SQL = """WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings),
l AS (SELECT vec_id, pos, n, n // 2 AS half, CASE WHEN pos >= n // 2 THEN 1 ELSE 0 END AS cls,
  CASE WHEN pos >= n // 2 THEN pos - n // 2 ELSE pos END AS i, least(pos // greatest(n // 4, 1), 3) AS blob FROM p)"""
_NX, _NY = f"{_n('vec_id', 11, 0)} * 0.1", f"{_n('vec_id', 11, 1)} * 0.1"


def _xy(x: str, y: str, label: str) -> str:
    return (f"{_LAYOUT_SQL} SELECT vec_id, printf('%.6f', {x}) || ',' || printf('%.6f', {y}) AS x, CAST({label} AS DOUBLE) AS y FROM l")


_SYNTH_SQL = {
    "random": f"""SELECT vec_id, array_to_string(list_transform(range(16), lambda j: printf('%.6f', {_n('vec_id', 11, 'j')})), ',') AS x,
 CAST(floor({_u('vec_id', 11, -1)} * 10) AS DOUBLE) AS y FROM embeddings""",
    "xor": _xy(_n("vec_id", 11, 0), _n("vec_id", 11, 1),
               f"CASE WHEN ({_n('vec_id', 11, 0)} > 0) <> ({_n('vec_id', 11, 1)} > 0) THEN 1 ELSE 0 END"),
    "checkerboard": _xy(f"{_u('vec_id', 11, 0)} * 4", f"{_u('vec_id', 11, 1)} * 4",
                        f"(floor({_u('vec_id', 11, 0)} * 4) + floor({_u('vec_id', 11, 1)} * 4)) % 2"),
    "spiral": _xy(f"{_lin(0.5, 2.0)} * cos({_lin(0.0, 4 * prep.PI)} + cls * {prep.PI}) + {_NX}",
                  f"{_lin(0.5, 2.0)} * sin({_lin(0.0, 4 * prep.PI)} + cls * {prep.PI}) + {_NY}", "cls"),
    "circles": _xy(f"cos({_lin(0.0, 2 * prep.PI)}) * (1.0 + cls) + {_NX}", f"sin({_lin(0.0, 2 * prep.PI)}) * (1.0 + cls) + {_NY}", "cls"),
    "moons": _xy(f"CASE WHEN cls = 0 THEN cos({_lin(0.0, prep.PI)}) ELSE 1 - cos({_lin(0.0, prep.PI)}) END + {_NX}",
                 f"CASE WHEN cls = 0 THEN sin({_lin(0.0, prep.PI)}) ELSE 1 - sin({_lin(0.0, prep.PI)}) - 0.5 END + {_NY}", "cls"),
    "blobs": _xy(f"([0.0, 3.0, 0.0, 3.0])[blob + 1]::DOUBLE + {_n('vec_id', 11, 0)} * 0.5",
                 f"([0.0, 3.0, 3.0, 0.0])[blob + 1]::DOUBLE + {_n('vec_id', 11, 1)} * 0.5", "blob"),
    "regression_sin": f"""{_LAYOUT_SQL} SELECT vec_id, printf('%.6f', -3.0::DOUBLE + 6.0::DOUBLE * pos / greatest(n - 1, 1)) AS x,
 sin((-3.0::DOUBLE + 6.0::DOUBLE * pos / greatest(n - 1, 1)) * 2) + {_NX} AS y FROM l""",
}


for _kind in prep.SYNTHETIC:
    def _mk(kind):
        def run(spark, d):
            out = prep.synthetic(_keys(spark, d), "vec_id", kind, noise=0.1, seed=11, dim=16, classes=10)
            return out.select("vec_id", F.array_join(F.transform("x", lambda v: F.format_string("%.6f", v)), ",").alias("x"),
                              F.col("y").cast("double").alias("y"))
        return run
    query(f"synth_{_kind}", _SYNTH_SQL[_kind])(_mk(_kind))

query("synth_spiral_exact", """WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n
  FROM embeddings),
q AS (SELECT vec_id, CASE WHEN pos >= n // 2 THEN 1 ELSE 0 END AS cls, CASE WHEN pos >= n // 2 THEN pos - n // 2 ELSE pos END AS i,
  n // 2 AS half FROM p),
r AS (SELECT vec_id, cls, 0.0 + 12.56636 * i / greatest(half - 1, 1) + cls * 3.14159 AS th, 0.5 + 1.5 * i / greatest(half - 1, 1) AS rad FROM q)
SELECT vec_id, printf('%.6f', rad * cos(th)) || ',' || printf('%.6f', rad * sin(th)) AS x, CAST(cls AS DOUBLE) AS y FROM r""")(
    lambda spark, d: prep.synthetic(_keys(spark, d), "vec_id", "spiral", noise=0.0).select(
        "vec_id", F.array_join(F.transform("x", lambda v: F.format_string("%.6f", v)), ",").alias("x"),
        F.col("y").cast("double").alias("y")))


def _vecs(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _fmt(c):
    return F.array_join(F.transform(c, lambda v: F.format_string("%.6f", v)), ",")


query("augment_flip", """SELECT vec_id, array_to_string(list_transform(range(64),
  lambda i: printf('%.6f', CAST(embedding[(i - i % 8) + (7 - i % 8) + 1] AS DOUBLE))), ',') AS x FROM embeddings""")(
    lambda spark, d: _vecs(spark, d).select("vec_id", _fmt(prep.flip_horizontal(F.col("x"), 1, 8, 8)).alias("x")))
query("augment_cutout", """SELECT vec_id, array_to_string(list_transform(range(64), lambda i:
  printf('%.6f', CASE WHEN i // 8 >= 2 AND i // 8 < 6 AND i % 8 >= 2 AND i % 8 < 6 THEN 0.0
    ELSE CAST(embedding[i + 1] AS DOUBLE) END)), ',') AS x FROM embeddings""")(
    lambda spark, d: _vecs(spark, d).select("vec_id", _fmt(prep.cutout(F.col("x"), 1, 8, 8, 4, F.lit(4), F.lit(4))).alias("x")))
def _per_element(expr: str) -> str:
    """``expr`` of ``v`` (the element) and ``j`` (its place) over each embedding."""
    return f"""SELECT vec_id, array_to_string(list_transform(range(len(embedding)), lambda j: printf('%.6f',
  {expr.replace('@v', 'CAST(embedding[j + 1] AS DOUBLE)')})), ',') AS x FROM embeddings"""


query("augment_gaussian_noise", _per_element(f"@v + {_n('vec_id', 3, 'j')} * 0.1"))(
    lambda spark, d: _vecs(spark, d).select("vec_id", _fmt(prep.gaussian_noise(F.col("x"), F.col("vec_id"), 0.1, 3)).alias("x")))
query("augment_dropout_noise", _per_element(f"CASE WHEN {_u('vec_id', 3, 'j')} < 0.1 THEN 0.0 ELSE @v END"))(
    lambda spark, d: _vecs(spark, d).select("vec_id", _fmt(prep.dropout_noise(F.col("x"), F.col("vec_id"), 0.1, 3)).alias("x")))
query("augment_scaling", _per_element(f"@v * (0.9::DOUBLE + {_u('vec_id', 3, -1)} * (1.1::DOUBLE - 0.9::DOUBLE))"))(
    lambda spark, d: _vecs(spark, d).select("vec_id", _fmt(prep.scaling(F.col("x"), F.col("vec_id"), 0.9, 1.1, 3)).alias("x")))


def _mixup(spark, d):
    b = prep.batch_ids(_vecs(spark, d), "vec_id", 32, 5)
    return prep.mixup(b, "vec_id", "x", "batch_id", 0.2, 5).select("vec_id", "batch_id", _fmt(F.col("x")).alias("x"))


query("augment_mixup", f"""WITH b AS (SELECT vec_id, embedding, CAST(floor((row_number() OVER (
   ORDER BY md5(CAST(vec_id AS VARCHAR) || ':5'), vec_id) - 1) / 32) AS BIGINT) AS batch_id FROM embeddings),
p AS (SELECT *, coalesce(lead(embedding) OVER w, first(embedding) OVER (PARTITION BY batch_id
   ORDER BY md5(CAST(vec_id AS VARCHAR) || ':5'), vec_id)) AS other FROM b
  WINDOW w AS (PARTITION BY batch_id ORDER BY md5(CAST(vec_id AS VARCHAR) || ':5'), vec_id)),
t AS (SELECT batch_id, list_filter(list_transform(range(32), lambda i: {{'x': pow({_u('batch_id', 5, 'i * 2')}, 5.0),
   'y': pow({_u('batch_id', 5, 'i * 2 + 1')}, 5.0)}}), lambda q: q.x + q.y <= 1 AND q.x + q.y > 0)[1] AS g
  FROM (SELECT DISTINCT batch_id FROM b)),
m AS (SELECT batch_id, coalesce(g.x / (g.x + g.y), 0.5) AS lam FROM t)
SELECT vec_id, p.batch_id, array_to_string(list_transform(range(len(embedding)), lambda j: printf('%.6f',
  lam * CAST(embedding[j + 1] AS DOUBLE) + (1 - lam) * CAST(other[j + 1] AS DOUBLE))), ',') AS x
FROM p JOIN m ON p.batch_id = m.batch_id""")(_mixup)
