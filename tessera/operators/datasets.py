"""Dataset factory: template schemas and validation, sample append /
delete / update, exporters (JSONL, CSV, Alpaca, ShareGPT, YOLO, COCO,
image/audio folder manifests, columnar) and format converters.

Everything is a DataFrame job: global ids come from bucketed prefix sums,
per-image annotation lists are grouped by image (bounded by the annotations
of one image), conversations are turned into ShareGPT documents one
conversation per row.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.numeric import fround
from tessera.operators.numbering import offsets_by_key
from tessera.session import checkpoint_dir


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool
    options: tuple = ()


# The 21 dataset templates (name -> fields), as in the reference.
TEMPLATES: dict[str, tuple[Field, ...]] = {
    "text_classification": (Field("text", "textarea", True), Field("label", "select", True)),
    "text_generation": (Field("instruction", "textarea", True), Field("input", "textarea", False),
                        Field("output", "textarea", True)),
    "conversation": (Field("conversations", "chat", True),),
    "tool_calling": (Field("query", "textarea", True), Field("tools", "json", True), Field("tool_call", "json", True),
                     Field("tool_result", "textarea", False), Field("final_answer", "textarea", False)),
    "reasoning": (Field("problem", "textarea", True), Field("solution_steps", "textarea", True),
                  Field("answer", "text", True), Field("difficulty", "select", False, ("easy", "medium", "hard"))),
    "qa": (Field("context", "textarea", True), Field("question", "textarea", True), Field("answer", "textarea", True)),
    "ner": (Field("text", "textarea", True), Field("entities", "json", True)),
    "summarization": (Field("document", "textarea", True), Field("summary", "textarea", True)),
    "image_classification": (Field("image_path", "file", True), Field("label", "select", True)),
    "object_detection_yolo": (Field("image_path", "file", True), Field("annotations", "bbox", True)),
    "object_detection_coco": (Field("image_path", "file", True), Field("annotations", "bbox", True)),
    "image_segmentation": (Field("image_path", "file", True), Field("mask_path", "file", True)),
    "image_text_pairs": (Field("image_path", "file", True), Field("caption", "textarea", True),
                         Field("negative_prompt", "textarea", False)),
    "dreambooth": (Field("image_path", "file", True), Field("prompt", "textarea", True)),
    "audio_classification": (Field("audio_path", "file", True), Field("label", "select", True)),
    "speech_to_text": (Field("audio_path", "file", True), Field("transcription", "textarea", True),
                       Field("language", "text", False)),
    "text_to_speech": (Field("text", "textarea", True), Field("audio_path", "file", True),
                       Field("speaker_id", "text", False)),
    "video_classification": (Field("video_path", "file", True), Field("label", "select", True)),
    "video_captioning": (Field("video_path", "file", True), Field("caption", "textarea", True),
                         Field("timestamps", "json", False)),
    "visual_qa": (Field("image_path", "file", True), Field("question", "textarea", True),
                  Field("answer", "textarea", True)),
    "multimodal_chat": (Field("conversations", "chat_multimodal", True),),
}

CHAT_TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
_SPARK_TYPES = {"chat": T.ArrayType(CHAT_TURN), "chat_multimodal": T.ArrayType(CHAT_TURN)}


def template_schema(template: str) -> T.StructType:
    """StructType for a template (json / bbox fields are JSON text)."""
    fields = TEMPLATES[template]
    return T.StructType([T.StructField(f.name, _SPARK_TYPES.get(f.type, T.StringType()), not f.required)
                         for f in fields])


def _missing(df: DataFrame, f: Field) -> Column:
    if f.name not in df.columns:
        return F.lit(True)
    dt = df.schema[f.name].dataType
    c = F.col(f.name)
    if isinstance(dt, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    if isinstance(dt, T.StringType):
        return c.isNull() | (F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "") == "")
    return c.isNull()


def validate(df: DataFrame, fields) -> DataFrame:
    """Adds ``valid`` and ``violations`` (names of required fields that are
    blank, or select fields outside their options), one pass, no shuffle."""
    checks = []
    for f in fields:
        bad = _missing(df, f) if f.required else F.lit(False)
        if f.options and f.name in df.columns:
            bad = bad | (F.col(f.name).isNotNull() & ~F.col(f.name).isin(*f.options))
        checks.append(F.when(bad, F.lit(f.name)))
    viol = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return df.withColumn("violations", viol).withColumn("valid", F.size("violations") == 0)


def validate_template(df: DataFrame, template: str) -> DataFrame:
    return validate(df, TEMPLATES[template])


# Preference / SFT dataset contracts per training method.
PREFERENCE_FIELDS = {
    "sft_instruction": ("instruction", "output"),
    "sft_chat": ("conversations",),
    "dpo": ("prompt", "chosen", "rejected"),
    "orpo": ("prompt", "chosen", "rejected"),
    "reward": ("prompt", "chosen", "rejected"),
    "kto": ("prompt", "completion", "label"),
}


def validate_preference(df: DataFrame, method: str) -> DataFrame:
    return validate(df, [Field(n, "text", True) for n in PREFERENCE_FIELDS[method]])


# --------------------------------------------------------------------------- samples


def sample_id(df: DataFrame, cols=None, salt: str = "") -> Column:
    """Deterministic id from the row content: its md5 (stable under retries
    and re-partitioning, unlike a random uuid).  Equal rows share it."""
    cols = cols or [c for c in df.columns if not c.startswith("_")]
    return F.md5(F.concat_ws("|", F.lit(salt), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def append_samples(dataset: DataFrame, new: DataFrame, id_cols=None) -> DataFrame:
    """``new`` appended with ids of its own: the content's digest, and ``-k``
    for the k-th further copy of the same content."""
    from tessera.operators.numbering import positions_within
    n = positions_within(new.withColumn("_id", sample_id(new, id_cols)), ["_id"], ["_id"], out="__copy")
    copy = F.when(F.col("__copy") > 0, F.concat(F.lit("-"), F.col("__copy").cast("string"))).otherwise("")
    n = n.withColumn("_id", F.concat("_id", copy)).drop("__copy")
    return dataset.unionByName(n, allowMissingColumns=True)


def delete_samples(dataset: DataFrame, ids: DataFrame, key: str = "_id") -> DataFrame:
    return dataset.join(ids.select(key).distinct(), key, "left_anti")


def update_samples(dataset: DataFrame, updates: DataFrame, key: str = "_id") -> DataFrame:
    """Whole-row replacement by id: fields absent from ``updates`` become
    null, as in the reference.  Of several updates of one id the greatest
    counts (columns in order), so rows never multiply."""
    u = updates.groupBy(key).agg(F.max(F.struct(*[F.col(c) for c in updates.columns if c != key])).alias("__u"))
    j = dataset.join(u, key, "left")
    out = []
    for c in dataset.columns:
        if c == key:
            out.append(F.col(key))
        elif c in updates.columns:
            out.append(F.when(F.col("__u").isNotNull(), F.col(f"__u.{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("__u").isNotNull(), F.lit(None)).otherwise(F.col(c)).alias(c))
    return j.select(*out)


# --------------------------------------------------------------------------- exporters


def public_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def json_encode_nested(df: DataFrame) -> DataFrame:
    """Complex columns become JSON text (CSV / columnar export rule)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def export_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(*public_columns(df)).write.mode(mode).json(path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    json_encode_nested(df.select(*public_columns(df))).write.mode(mode).option("header", True) \
        .option("escape", '"').csv(path)


def export_columnar(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    json_encode_nested(df.select(*public_columns(df))).write.mode(mode).parquet(path)


def alpaca_rows(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c).cast("string") if c in df.columns else F.lit(None), F.lit("")).alias(c)
                       for c in ("instruction", "input", "output")])


def sharegpt_rows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """conv_id, conversations ARRAY<STRUCT<role, content>> in turn order (one
    row per conversation - the output unit of the format)."""
    g = turns.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"),
                                                                      F.col(text).alias("content")))).alias("s"))
    return g.select(conv, F.transform("s", lambda x: F.struct(x["role"].alias("role"),
                                                             x["content"].alias("content"))).alias("conversations"))


def alpaca_to_sharegpt(df: DataFrame) -> DataFrame:
    """user = instruction (+ blank line + input when non-empty), assistant = output."""
    inp = F.coalesce(F.col("input"), F.lit(""))
    user = F.when(inp != "", F.concat(F.coalesce(F.col("instruction"), F.lit("")), F.lit("\n\n"), inp)) \
        .otherwise(F.coalesce(F.col("instruction"), F.lit("")))
    conv = F.array(F.struct(F.lit("user").alias("role"), user.alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.coalesce(F.col("output"), F.lit("")).alias("content")))
    keep = [c for c in df.columns if c not in ("instruction", "input", "output")]
    return df.select(*keep, conv.alias("conversations"))


def sharegpt_to_alpaca(df: DataFrame, conversations: str = "conversations") -> DataFrame:
    """Only conversations with >= 2 turns; turns 0 and 1; input is empty."""
    c = F.col(conversations)
    keep = [x for x in df.columns if x != conversations]
    return df.where(F.size(c) >= 2).select(
        *keep, F.coalesce(F.get(c, 0)["content"], F.lit("")).alias("instruction"), F.lit("").alias("input"),
        F.coalesce(F.get(c, 1)["content"], F.lit("")).alias("output"))


def first_two_turns_to_alpaca(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                              text: str = "text") -> DataFrame:
    """ShareGPT -> Alpaca straight from a turn table: the two first turns of
    every conversation with at least two turns, without assembling whole
    conversations (``row_number() <= 2`` is a pre-shuffle group limit)."""
    w = Window.partitionBy(conv).orderBy(turn)
    first = turns.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= 2)
    g = first.groupBy(conv).agg(F.max(F.when(F.col("__rn") == 1, F.col(text))).alias("instruction"),
                                F.max(F.when(F.col("__rn") == 2, F.col(text))).alias("output"),
                                F.count(F.lit(1)).alias("__n"))
    return g.where(F.col("__n") >= 2).select(conv, F.coalesce("instruction", F.lit("")).alias("instruction"),
                                             F.lit("").alias("input"), F.coalesce("output", F.lit("")).alias("output"))


# --------------------------------------------------------------------------- boxes

def coco_to_yolo(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """file_name (stem + .txt), n_lines, content: one YOLO label text per
    image with non-zero size; images without annotations get empty text.

    images: id, file_name, width, height; annotations: id, image_id,
    category_id, x, y, w, h (pixels)."""
    img = images.where((F.col("width") != 0) & (F.col("height") != 0))
    # boxes are grouped first, so that one row per image meets its boxes; the number of tasks is set, as
    # formatting the lines costs more than the bytes that a re-plan would merge tasks by
    parts = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    boxes = annotations.repartition(parts, "image_id").groupBy(F.col("image_id").alias("__of")).agg(F.collect_list(F.struct(
        "id", "category_id", "x", "y", "w", "h")).alias("boxes"))
    W, H = F.col("width").cast("double"), F.col("height").cast("double")
    lines = F.array_sort(F.transform(F.coalesce("boxes", F.array()), lambda a: F.struct(a["id"].alias("k"), F.format_string(
        "%d %.6f %.6f %.6f %.6f", a["category_id"].cast("int"), fround((a["x"] + a["w"] / 2) / W, 6),
        fround((a["y"] + a["h"] / 2) / H, 6), fround(a["w"] / W, 6), fround(a["h"] / H, 6)).alias("l")))).getField("l")
    stem = F.regexp_replace(F.regexp_extract("file_name", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return (img.join(boxes, F.col("id") == F.col("__of"), "left").withColumn("lines", lines)
            .select(F.col("id").alias("image_id"), F.concat(stem, F.lit(".txt")).alias("file_name"),
                    F.size("lines").cast("bigint").alias("n_lines"), F.array_join("lines", "\n").alias("content")))


def yolo_from_samples(samples: DataFrame, id_col: str = "_id") -> DataFrame:
    """(src, file_name, content): one label text per sample (image_path,
    annotations ARRAY<STRUCT<class_id, x_center, y_center, width, height>>).
    Only annotations with a class_id are written, a line each; the file has
    the image's name, or the sample's id if there is no image."""
    path = F.coalesce(F.col("image_path"), F.lit(""))
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    name = F.when(path != "", stem).otherwise(F.coalesce(F.col(id_col).cast("string"), F.lit("unknown")))
    lines = F.transform(F.filter(F.coalesce("annotations", F.array()), lambda a: a["class_id"].isNotNull()), lambda a: F.concat(
        F.concat_ws(" ", *[a[c].cast("string") for c in ("class_id", "x_center", "y_center", "width", "height")]), F.lit("\n")))
    return samples.select(F.col("image_path").alias("src"), F.concat(name, F.lit(".txt")).alias("file_name"),
                          F.array_join(lines, "").alias("content"))


# The characters of Unicode's White_Space property but the blank and the line break.
BLANKS = "\t\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def yolo_to_coco(labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Parse YOLO label texts (image_id, content) with image sizes
    (image_id, width, height) into COCO annotations: id (global, in image
    then line order), image_id, category_id, bbox x, y, w, h (1 dp), area.
    Labels are parsed once into a checkpointed table; of it only image ids and
    their numbers of boxes are numbered; a box adds its place."""
    checkpoint_dir(labels.sparkSession)
    # every blank but the line break becomes a plain one; blanks at either end of a line are empty words
    plain = F.translate("content", BLANKS, " " * len(BLANKS))
    words = F.transform(F.split(plain, "\n"), lambda x: F.filter(F.split(x, " "), lambda w: w != ""))
    boxes = F.transform(F.filter(words, lambda p: F.size(p) >= 5), lambda p: F.struct(
        F.get(p, 0).cast("int").alias("c"), *[F.get(p, i).cast("double").alias(f"b{i}") for i in (1, 2, 3, 4)]))
    images = labels.select("image_id", boxes.alias("boxes")).where(F.size("boxes") > 0).join(sizes, "image_id") \
        .select("image_id", "width", "height", "boxes").checkpoint()
    images = offsets_by_key(images, ["image_id"], F.size("boxes"), out="__first")
    j = images.select("image_id", "width", "height", "__first", F.posexplode("boxes").alias("__i", "p"))
    xc, yc, bw, bh = [F.col(f"p.b{i}") for i in (1, 2, 3, 4)]
    W, H = F.col("width").cast("double"), F.col("height").cast("double")
    box = j.select((F.col("__first") + F.col("__i")).cast("bigint").alias("id"), "image_id",
                   F.col("p.c").alias("category_id"),
                   ((xc - bw / 2) * W).alias("x"), ((yc - bh / 2) * H).alias("y"), (bw * W).alias("w"), (bh * H).alias("h"))
    return box.select("id", "image_id", "category_id", fround("x", 1).alias("x"),
                      fround("y", 1).alias("y"), fround("w", 1).alias("w"), fround("h", 1).alias("h"),
                      fround(F.col("w") * F.col("h"), 1).alias("area"))


def export_coco(samples: DataFrame, order_key: str, labels: list[str] | None = None):
    """COCO tables from samples (image_path, width, height, annotations
    ARRAY<STRUCT<category_id, bbox ARRAY<DOUBLE>, area>>): image ids by
    position in ``order_key`` order, annotation ids global, area default 0,
    iscrowd 0.  Returns (images, annotations, categories)."""
    # one numbering gives both: the image's place and the annotations before it
    n = F.greatest(F.coalesce(F.size("annotations"), F.lit(0)), F.lit(0))
    s = offsets_by_key(samples, [order_key], n, out="__a0", number="__img_id")
    images = s.select(F.col("__img_id").alias("id"),
                      F.coalesce(F.col("image_path"), F.concat(F.lit("img_"), F.col("__img_id").cast("string"))).alias("file_name"),
                      F.coalesce(F.col("width"), F.lit(0)).alias("width"), F.coalesce(F.col("height"), F.lit(0)).alias("height"))
    ex = s.select("__img_id", "__a0", F.posexplode("annotations").alias("__i", "ann"))
    anns = ex.select((F.col("__a0") + F.col("__i")).alias("id"), F.col("__img_id").alias("image_id"),
                     F.coalesce(F.col("ann.category_id"), F.lit(0)).alias("category_id"),
                     F.coalesce(F.col("ann.bbox"), F.array(*[F.lit(0.0)] * 4)).alias("bbox"),
                     F.coalesce(F.col("ann.area"), F.lit(0.0)).alias("area"), F.lit(0).alias("iscrowd"))
    spark = samples.sparkSession
    cats = spark.createDataFrame([(i, n) for i, n in enumerate(labels or [])], "id int, name string")
    return images, anns, cats


def folder_manifest(df: DataFrame, path_col: str = "image_path", label_col: str = "label",
                    root: str = "imagefolder") -> DataFrame:
    """(src, dst) pairs for image/audio folder export: ``root/label/name``.
    Files of one label that share a name get ``-1``, ``-2``, ... in path order."""
    from tessera.operators.numbering import positions_within
    name = F.regexp_extract(F.col(path_col), r"([^/]*)$", 1)
    m = df.where(F.col(path_col).isNotNull() & (F.col(path_col) != "")).select(
        F.col(path_col).alias("src"), F.concat_ws("/", F.lit(root), F.coalesce(F.col(label_col).cast("string"), F.lit("unknown")),
                                                  name).alias("dst"))
    ending = F.regexp_extract("dst", r"(\.[^./]*)$", 1)
    apart = F.concat(F.expr("substring(dst, 1, length(dst) - length(__end))"), F.lit("-"), F.col("pos").cast("string"), "__end")
    return (positions_within(m, ["dst"], ["src"]).withColumn("__end", ending)
            .select("src", F.when(F.col("pos") > 0, apart).otherwise(F.col("dst")).alias("dst")))


def copy_manifest(manifest: DataFrame, dest_root: str) -> DataFrame:
    """Copy every (src, dst) pair under ``dest_root`` and return (src, dst,
    status): ``copied`` or ``missing``.  The executors copy; a failed job
    leaves nothing, a task that runs again the same files.  Both ends must be
    folders that the driver and all executors see."""
    from tessera.sources.named_files import write_named_files
    pairs = manifest.select("src", "dst")
    write_named_files(pairs.select("src", F.col("dst").alias("name")), dest_root)

    @F.arrow_udf("string")
    def status(dst: pa.Array) -> pa.Array:
        return pa.array(["copied" if os.path.exists(os.path.join(dest_root, x)) else "missing" for x in dst.to_pylist()])
    return pairs.withColumn("status", status("dst"))


def write_yolo_files(labels: DataFrame, out_dir: str, classes: list[str] | None = None,
                     name_col: str = "file_name", content_col: str = "content") -> None:
    """One ``labels/<stem>.txt`` per image, written by the executors (nothing
    passes through the driver; all files or none), plus ``classes.txt``.
    ``out_dir`` must be a folder that the driver and all executors see."""
    from tessera.sources.named_files import write_named_files
    spark = labels.sparkSession
    files = labels.select(F.concat(F.lit("labels/"), F.col(name_col)).alias("name"), F.col(content_col).alias("content"))
    names = spark.createDataFrame([("classes.txt", "\n".join(classes or []))], "name string, content string")
    write_named_files(files.unionByName(names), out_dir)
