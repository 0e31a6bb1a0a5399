"""File scans (CSV, JSON / JSONL, Parquet) and the connector dispatch used
by pipelines.  Readers return lazy DataFrames; no row caps are applied
(``limit`` is an explicit, optional preview)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


SPREAD_MIN_BYTES = 4 * 1024 * 1024


def _row_groups(path: str) -> int | None:
    import pyarrow as pa
    import pyarrow.parquet as pq
    try:
        return pq.ParquetFile(path).metadata.num_row_groups  # footer only
    except (OSError, pa.ArrowInvalid):  # a folder, or a path that only Spark reads: no hint
        return None


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One of the driver's parquet tables.

    A Parquet file is split by row group, so a file with fewer row groups
    than the cluster has cores is scanned by that few tasks.  With ``spread``
    (used by CPU-heavy text steps) such an input - and only such an input,
    larger than 4 MB - is spread round-robin over the default parallelism; a
    real large table has far more row groups than cores and is read as is,
    with no shuffle."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    df = spark.read.parquet(path)
    if not spread:
        return df
    par = spark.sparkContext.defaultParallelism
    groups = _row_groups(path)
    try:
        size = os.path.getsize(path)
    except OSError:
        size = 0
    if groups is not None and groups * 2 < par and size > SPREAD_MIN_BYTES:
        return df.repartition(par)
    return df


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8",
             infer_schema: bool = False, schema=None, multi_line: bool = True, whole_files: bool = False) -> DataFrame:
    """Header row, every column a string unless a schema / inference is asked
    for (the reference never infers).  Quoted values may span lines; UTF-8
    files are cut into ranges all the same (``csv_records``), which reads them
    twice; ``multi_line=False`` reads files once whose values are known to hold
    no line breaks, ``whole_files`` each by one task, as another encoding or
    the inference of types do."""
    if multi_line and not whole_files and not infer_schema and encoding.lower().replace("-", "") == "utf8":
        from tessera.sources.csv_records import read_csv_records
        return read_csv_records(spark, path, delimiter, schema=schema)
    r = (spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding)
         .option("multiLine", multi_line).option("escape", '"').option("inferSchema", infer_schema))
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def read_json(spark: SparkSession, path: str, lines: bool = True, schema=None) -> DataFrame:
    r = spark.read.option("multiLine", not lines)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_source(spark: SparkSession, spec: dict) -> DataFrame:
    """Build a DataFrame from ``{connector_type, params}``."""
    kind = spec.get("connector_type") or spec.get("type")
    p = dict(spec.get("params", {}))
    from tessera.sources import connectors
    limit = p.pop("limit", None)
    if limit and kind in connectors.LIMIT_AT_SOURCE:
        p["limit"] = int(limit)  # the database applies it
    if kind in ("csv", "csv_file"):
        df = read_csv(spark, p["path"], p.get("delimiter", ","), p.get("encoding", "utf-8"),
                      multi_line=bool(p.get("multi_line", True)))
    elif kind in ("json", "json_file", "jsonl"):
        df = read_json(spark, p["path"], bool(p.get("lines", kind == "jsonl")))
    elif kind == "parquet":
        df = read_parquet(spark, p["path"])
    elif kind == "table":
        df = spark.table(p["name"])
    else:
        df = connectors.load(spark, kind, p)
    return df.limit(int(limit)) if limit else df
