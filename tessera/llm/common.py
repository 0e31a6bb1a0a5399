"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import checkpoint_dir, ship_package

#: ASCII white space, as in the regular expression class ``[\x20\x09-\x0D]``.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back:
    lineage is cut, a lost executor costs a re-read, and the planner knows
    the real size of the table."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tessera-llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str = "row") -> Column:
    """The whole input row as one struct, so that an operator's own columns
    cannot clash with the caller's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def unpacked(df: DataFrame, schema: T.StructType, row: str = "row", **extra: Column) -> DataFrame:
    """The columns of ``row`` again, then ``extra``; an extra column replaces a
    caller's column of the same name."""
    new = {name.lower() for name in extra}
    keep = [F.col(row).getField(f.name).alias(f.name) for f in schema.fields if f.name.lower() not in new]
    return df.select(*keep, *[c.alias(name) for name, c in extra.items()])


def row_hash(df: DataFrame, seed: int) -> Column:
    """64-bit hash of a whole row (every column that has a hash); rows with
    the same hash are interchangeable."""
    def hashable(t: T.DataType) -> bool:
        if isinstance(t, (T.MapType, T.VariantType)):
            return False
        if isinstance(t, T.ArrayType):
            return hashable(t.elementType)
        if isinstance(t, T.StructType):
            return all(hashable(f.dataType) for f in t.fields)
        return True
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if hashable(f.dataType)]
    # a null adds nothing to the hash, so its place is hashed too
    nulls = F.concat(*[F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")) for c in cols])
    return F.xxhash64(F.lit(seed), nulls, *cols)


__all__ = ["WORD", "checkpoint_dir", "materialise", "packed", "row_hash", "ship_package", "table", "unpacked"]
