"""File inventories: listing, directory profiles, dataset-type detection,
folder labels and file summaries, all from ``binaryFile`` metadata (the
``content`` column is never selected, so file bytes are not read)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extension groups used by dataset-type detection.
IMAGE_EXTS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp", ".tiff")
AUDIO_EXTS = (".wav", ".mp3", ".flac", ".ogg", ".m4a")
VIDEO_EXTS = (".mp4", ".avi", ".mov", ".mkv", ".webm")
TEXT_EXTS = (".txt", ".csv", ".json", ".jsonl", ".tsv", ".parquet")


def file_inventory(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, size, modified - metadata only."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path)
    return df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def relative_parts(inv: DataFrame, root: str) -> DataFrame:
    root = root.rstrip("/")
    rel = F.regexp_replace(F.regexp_replace(F.col("path"), r"^file:", ""), "^" + _re_escape(root) + "/", "")
    return inv.withColumn("rel", rel).withColumn("depth", F.size(F.split("rel", "/")))


def _re_escape(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in s)


def dir_profile(inv: DataFrame, root: str) -> DataFrame:
    """One row per directory level-1 listing: file_count, total_size_mb (2
    dp), files_by_extension map, subdirs array (non-recursive, like the
    reference; deeper files only reveal their top sub-directory)."""
    r = relative_parts(inv, root)
    files = r.where(F.col("depth") == 1)
    by_ext = files.groupBy(extension(F.col("rel")).alias("ext")).agg(F.count(F.lit(1)).alias("n"),
                                                                     F.sum("size").alias("bytes"))
    subdirs = r.where(F.col("depth") > 1).select(F.split("rel", "/")[0].alias("d")).distinct()
    prof = by_ext.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("file_count"),
                      F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / (1024 * 1024), 2).alias("total_size_mb"),
                      F.map_from_entries(F.collect_list(F.struct("ext", F.col("n").cast("bigint")))).alias("files_by_extension"))
    sd = subdirs.agg(F.sort_array(F.collect_list("d")).alias("subdirs"))
    return prof.select("*", sd.select("subdirs").scalar().alias("subdirs"))


def detect_type(files_by_extension: Column, subdirs: Column) -> Column:
    """Precedence: image_classification (images + more than one sub-dir) ->
    object_detection (images + .txt/.json/.xml) -> images -> audio -> video
    -> tabular (.csv) -> text (.json/.jsonl) -> unknown."""
    keys = F.map_keys(files_by_extension)

    def count(exts):
        return F.aggregate(F.map_values(F.map_filter(files_by_extension, lambda k, v: k.isin(*exts))),
                           F.lit(0).cast("bigint"), lambda a, b: a + b)

    def has(*exts):
        return F.exists(keys, lambda k: k.isin(*exts))
    img = count(IMAGE_EXTS)
    return (F.when((img > 0) & (F.size(subdirs) > 1), "image_classification")
            .when((img > 0) & has(".txt", ".json", ".xml"), "object_detection")
            .when(img > 0, "images").when(count(AUDIO_EXTS) > 0, "audio").when(count(VIDEO_EXTS) > 0, "video")
            .when(has(".csv"), "tabular").when(has(".jsonl", ".json"), "text").otherwise("unknown"))


def folder_labels(inv: DataFrame) -> DataFrame:
    """Label = parent directory name (imagefolder / audiofolder layout)."""
    return inv.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("label"))


def file_summary(spark: SparkSession, path: str, fmt: str | None = None, preview: int = 5):
    """(columns, n_rows, preview rows) for CSV / JSON / JSONL; format
    guessed from the extension.  Counting is a distributed job; only the
    preview rows reach the driver."""
    from tessera.sources.files import read_csv, read_json
    fmt = fmt or path.rsplit(".", 1)[-1].lower()
    if fmt == "csv":
        df = read_csv(spark, path)
    elif fmt in ("jsonl", "ndjson"):
        df = read_json(spark, path, lines=True)
    elif fmt == "json":
        df = read_json(spark, path, lines=False)
    else:
        raise ValueError(f"unsupported file format {fmt!r}")
    return df


def summarize_file(spark: SparkSession, path: str, fmt: str | None = None, preview: int = 5) -> dict:
    """columns, n_rows (a distributed count) and the first ``preview`` rows."""
    df = file_summary(spark, path, fmt)
    return {"path": path, "format": fmt or path.rsplit(".", 1)[-1].lower(), "columns": df.columns,
            "n_rows": df.count(), "preview": [r.asDict(recursive=True) for r in df.limit(preview).collect()]}
