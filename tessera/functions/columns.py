"""Null / blank handling and small schema helpers.

The reference treats ``None`` and the empty string alike in every null
test, so ``is_blank`` is the one place that rule lives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def as_names(names) -> list[str]:
    """Column names from a list, or from a text that separates them by commas."""
    parts = names if isinstance(names, (list, tuple)) else f"{'' if names is None else names}".split(",")
    return list(filter(None, map(str.strip, map(str, parts))))


def col_type(df: DataFrame, name: str) -> T.DataType:
    try:
        return df.schema[name].dataType
    except KeyError as exc:
        raise ValueError(f"unknown column {name!r}; columns are {df.columns}") from exc


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_string_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_blank(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if is_string_type(col_type(df, name)):
        return c.isNull() | (c == F.lit(""))
    return c.isNull()


def not_blank(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if is_string_type(col_type(df, name)):
        return c.isNotNull() & (c != F.lit(""))
    return c.isNotNull()


def blank_to_null(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if is_string_type(col_type(df, name)):
        return F.when(c == F.lit(""), F.lit(None)).otherwise(c)
    return c


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970-01-01 for a timestamp column, independent of
    the session time zone for TIMESTAMP_NTZ (wall-clock) values."""
    dt = col_type(df, name)
    c = F.col(name)
    if isinstance(dt, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("long") * 86_400_000_000
    return F.unix_micros(c)
