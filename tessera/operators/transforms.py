"""The pipeline transforms: projection, filters, null handling, casts,
expressions, dedup, sort / limit / sample / page, text cleaning and
splitting, JSON flattening, merge and concat.

Each function is ``DataFrame -> DataFrame`` and stays lazy; the only
eager steps are the documented ones (schema discovery for
``flatten_json`` and exact order statistics for ``fill_nulls``).
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import (
    blank_to_null, col_type, is_blank, is_numeric_type, is_string_type, not_blank, as_names,
)
from tessera.functions import text as textfn
from tessera.operators.quantiles import kth_smallest, upper_median

# --------------------------------------------------------------------------- projection


def select_columns(df: DataFrame, columns, strict: bool = False) -> DataFrame:
    cols = as_names(columns)
    exprs = []
    for c in cols:
        if c in df.columns:
            exprs.append(F.col(c))
        elif strict:
            raise ValueError(f"select_columns: unknown column {c!r}")
        else:  # the reference yields null for a column that is not there
            exprs.append(F.lit(None).cast("string").alias(c))
    return df.select(*exprs)


def drop_columns(df: DataFrame, columns) -> DataFrame:
    return df.drop(*as_names(columns))


def rename_columns(df: DataFrame, mapping) -> DataFrame:
    if isinstance(mapping, str):
        mapping = json.loads(mapping) if mapping.strip() else {}
    mapping = {k: v for k, v in (mapping or {}).items() if k in df.columns}
    return df.withColumnsRenamed(mapping) if mapping else df


# --------------------------------------------------------------------------- filters

_INT_RE = re.compile(r"^[+-]?\d+$")
COMPARISONS = ("==", "!=", ">", "<", ">=", "<=", "contains", "not_contains", "regex",
               "is_null", "not_null")


def _as_string(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    return c if is_string_type(col_type(df, column)) else c.cast("string")


def _typed_equal_literal(dt: T.DataType, val: str):
    """Literal of the column's own type when ``str(value) == val`` can be
    decided by a typed comparison (keeps parquet / JDBC pushdown)."""
    if is_string_type(dt):
        return F.lit(val)
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        if _INT_RE.match(val) and str(int(val)) == val:
            return F.lit(int(val))
        return None
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        try:
            f = float(val)
        except ValueError:
            return None
        return F.lit(f) if repr(f) == val else None
    if isinstance(dt, T.BooleanType):
        return {"True": F.lit(True), "False": F.lit(False)}.get(val)
    return None


def filter_predicate(df: DataFrame, column: str, operator: str, value="") -> Column:
    """Predicate with the reference's semantics (null never matches except
    ``is_null``; blank counts as null; comparisons are numeric)."""
    if operator == "is_null":
        return is_blank(df, column)
    if operator == "not_null":
        return not_blank(df, column)
    dt = col_type(df, column)
    c = F.col(column)
    val = "" if value is None else str(value)
    if operator in ("==", "!="):
        lit = _typed_equal_literal(dt, val)
        lhs = c
        if lit is None:
            lhs, lit = _as_string(df, column), F.lit(val)
        return (lhs == lit) if operator == "==" else (lhs != lit)
    if operator in ("contains", "not_contains"):
        hit = F.lower(_as_string(df, column)).contains(F.lit(val.lower()))
        return hit if operator == "contains" else (c.isNotNull() & ~hit)
    if operator == "regex":
        return _as_string(df, column).rlike(val)
    if operator in (">", "<", ">=", "<="):
        try:
            t = float(val)
        except ValueError:
            return F.lit(False)
        if is_numeric_type(dt):
            lhs = c
            rhs = F.lit(int(t)) if (t.is_integer() and not isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType))) else F.lit(t)
        elif is_string_type(dt):
            lhs, rhs = c.try_cast("double"), F.lit(t)
        elif isinstance(dt, T.BooleanType):
            lhs, rhs = c.cast("double"), F.lit(t)
        else:
            return F.lit(False)
        return {">": lhs > rhs, "<": lhs < rhs, ">=": lhs >= rhs, "<=": lhs <= rhs}[operator]
    raise ValueError(f"filter_rows: unknown operator {operator!r}; expected one of {COMPARISONS}")


def filter_rows(df: DataFrame, column: str, operator: str, value="") -> DataFrame:
    return df.where(filter_predicate(df, column, operator, value))


def drop_nulls(df: DataFrame, columns=None) -> DataFrame:
    cols = as_names(columns) or df.columns
    pred = F.lit(True)
    for c in cols:
        pred = pred & not_blank(df, c)
    return df.where(pred)


# --------------------------------------------------------------------------- fill


def _mode_scalar(df: DataFrame, column: str) -> Column:
    counts = df.where(not_blank(df, column)).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    return counts.orderBy(F.col("__n").desc(), F.col(column).asc()).limit(1).select(column).scalar()


def fill_nulls(df: DataFrame, column: str, strategy: str = "value", value="",
               order_by=None, partition_by=None, approx_accuracy: int | None = None) -> DataFrame:
    """Fill null / blank cells of one column.

    value  -> literal (cast to the column type)
    mean   -> mean of the non-blank values (0 when none); result is double
    median -> upper median ``sorted[n // 2]`` (0 when none); exact, found by
              distributed range narrowing rather than a one-task sort
    mode   -> most frequent value, smallest value wins ties
    ffill / bfill -> last / next non-blank value in ``order_by`` order within
              ``partition_by`` (the reference offers these but never fills)
    """
    dt = col_type(df, column)
    blank = is_blank(df, column)
    c = F.col(column)
    if strategy == "value":
        fill = F.lit(value).try_cast(dt) if not is_string_type(dt) else F.lit(str(value))
        return df.withColumn(column, F.when(blank, fill).otherwise(c))
    if strategy in ("mean", "median"):
        num = blank_to_null(df, column).cast("double") if is_numeric_type(dt) else \
            blank_to_null(df, column).try_cast("double")
        if strategy == "mean":
            fill = F.coalesce(df.select(F.avg(num)).scalar(), F.lit(0.0))
        elif approx_accuracy:
            # opt-in: one-pass sketch instead of the exact narrowing
            fill = F.coalesce(df.select(F.percentile_approx(num, 0.5, int(approx_accuracy))).scalar(), F.lit(0.0))
        else:
            med = upper_median(df.select(num.alias("__v")), "__v")
            fill = F.lit(float(med or 0.0))
        return df.withColumn(column, F.when(blank, fill).otherwise(num))
    if strategy == "mode":
        fill = _mode_scalar(df, column)
        return df.withColumn(column, F.when(blank, fill).otherwise(c))
    if strategy in ("ffill", "bfill"):
        order = as_names(order_by)
        if not order:
            raise ValueError("fill_nulls ffill/bfill needs order_by")
        # skew-safe: sorted cells split a hot partition key; a null key is a partition
        from tessera.operators.numbering import fill_forward_backward
        return fill_forward_backward(df.withColumn(column, blank_to_null(df, column)), as_names(partition_by), order, column,
                                     backward=(strategy == "bfill")).select(*df.columns)
    raise ValueError(f"fill_nulls: unknown strategy {strategy!r}")


# --------------------------------------------------------------------------- cast / expressions

# Strings that cast to boolean true (anything else is false).
_TRUE_WORDS = ("true", "1", "yes")


def cast_column(df: DataFrame, column: str, dtype: str) -> Column:
    dt = col_type(df, column)
    c = F.col(column)
    if dtype == "int":
        if is_numeric_type(dt):
            return c.try_cast("bigint")  # double -> bigint truncates toward zero
        return c.try_cast("double").try_cast("bigint")
    if dtype == "float":
        return c.try_cast("double")
    if dtype == "bool":
        if isinstance(dt, T.BooleanType):
            return c
        return F.lower(c.cast("string")).isin(*_TRUE_WORDS)
    if dtype == "str":
        return c.cast("string")
    raise ValueError(f"cast_type: unknown dtype {dtype!r}; expected str, int, float or bool")


def cast_type(df: DataFrame, column: str, dtype: str, keep_bad: bool = False) -> DataFrame:
    new = cast_column(df, column, dtype)
    if keep_bad:
        raw = F.col(column).cast("string")
        df = df.withColumn(f"{column}_bad", F.when(new.isNull() & F.col(column).isNotNull(), raw))
    return df.withColumn(column, new)


def add_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Spark SQL expression (use try_* functions for null-on-error)."""
    return df.withColumn(name, F.expr(expression))


# --------------------------------------------------------------------------- dedup / order


def deduplicate(df: DataFrame, columns=None, order_by=None) -> DataFrame:
    """Keep one row per key.  Without columns: exact duplicate rows removed
    (hash aggregate, partial on the map side).  With columns: the first row
    by ``order_by`` (default: all other columns) is kept via ``min_by``
    inside a partial aggregate, so a hot key never lands whole in one task.
    """
    keys = as_names(columns)
    if not keys:
        return df.dropDuplicates()
    order = as_names(order_by)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    tie = [c for c in rest if c not in order]
    ordering = F.struct(*[F.col(c) for c in order + tie])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), ordering).alias("__first"))
    return picked.select(*[F.col(c) for c in keys], *[F.col(f"__first.{c}").alias(c) for c in rest]) \
        .select(*df.columns)


def _order_cols(df: DataFrame, column, descending: bool, tie_break=None) -> list[Column]:
    """Sort keys in the requested direction; tie-break columns always
    ascending (a stable reverse sort keeps ties in input order)."""
    keys = as_names(column)
    out = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in keys]
    out += [F.col(c).asc_nulls_first() for c in as_names(tie_break) if c not in keys]
    return out


def sort(df: DataFrame, column, descending: bool = False, tie_break=None) -> DataFrame:
    return df.orderBy(*_order_cols(df, column, descending, tie_break))


def sort_ranked(df: DataFrame, column: str, descending: bool = False, tie_break=None,
                out: str = "rank") -> DataFrame:
    """Sorted rows plus their 1-based global position ``out`` in the order of
    ``sort``, for columns of any type, from sorted cells: no window ever holds
    the whole table."""
    from tessera.operators.numbering import prefix_sum
    order = _order_cols(df, column, descending, tie_break)
    ranked = prefix_sum(df, order, out="__pos")
    return ranked.withColumn(out, (F.col("__pos") + 1).cast("bigint")).drop("__pos").orderBy(*order)


def limit(df: DataFrame, n: int = 1000) -> DataFrame:
    return df.limit(int(n))


def sample_key(df: DataFrame, key=None, seed=0) -> Column:
    cols = as_names(key) or df.columns
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def sample(df: DataFrame, n: int = 100, seed=0, key=None) -> DataFrame:
    """Exactly ``min(n, count)`` rows without replacement, reproducible:
    the ``n`` smallest ``md5(key | seed)``.  The n-th smallest 52-bit hash is
    found by the exact distributed narrowing, rows below it are kept and the
    boundary ties are filled in key order - no task ever holds n rows."""
    n = int(n)
    keys = [F.col(c) for c in (as_names(key) or df.columns)]
    h = sample_key(df, key, seed)
    num = F.conv(F.substring(h, 1, 13), 16, 10).cast("long")  # 52 bits: exact in a double
    tagged = df.withColumn("__sh", num)
    cut = kth_smallest(tagged, "__sh", [n - 1])[0] if n > 0 else None
    if cut is None:  # fewer than n rows: all of them
        return df if n > 0 else df.limit(0)
    below = tagged.where(F.col("__sh") < F.lit(int(cut)))
    taken = below.count()
    tie = tagged.where(F.col("__sh") == F.lit(int(cut))).orderBy(h, *keys).limit(n - taken)
    return below.unionByName(tie).drop("__sh")


def sample_fraction(df: DataFrame, fraction: float, seed=0, key=None) -> DataFrame:
    """About ``fraction`` of the rows, chosen by a hash threshold on the key
    (no sort; reproducible; the cheap option when the exact count does not
    matter)."""
    from tessera.operators.prep import hex_threshold
    return df.where(F.substring(sample_key(df, key, seed), 1, 13) < F.lit(hex_threshold(fraction)))


#: Pages that end before this row are a distributed top-k; the rows are the
#: same, only the plan differs.
SHALLOW_PAGE = 100_000


def page(df: DataFrame, offset: int = 0, limit_n: int = 100, order_by=None, shallow: int = SHALLOW_PAGE) -> DataFrame:
    """Rows ``offset .. offset + limit_n - 1`` in ``order_by`` order (nulls
    first, ties by a hash of the row).  Early pages are a distributed
    top-(offset + n); deep pages take each row's global position from sorted
    cells and keep a range."""
    from tessera.operators.numbering import prefix_sum, row_tie
    order = as_names(order_by) or df.columns
    offset, limit_n = int(offset), int(limit_n)
    if offset + limit_n <= shallow:
        return df.orderBy(*order, row_tie(df)).offset(offset).limit(limit_n)
    pos = prefix_sum(df, order, out="__pos")
    return pos.where((F.col("__pos") >= offset) & (F.col("__pos") < offset + limit_n)) \
        .orderBy("__pos").drop("__pos")


# --------------------------------------------------------------------------- text


def text_clean(df: DataFrame, column: str, strip: bool = True, lowercase: bool = True,
               remove_html: bool = False, remove_urls: bool = False,
               remove_special: bool = False, unicode: bool = False) -> DataFrame:
    return df.withColumn(column, textfn.clean(F.col(column).cast("string"), strip=strip,
                                              lowercase=lowercase, remove_html=remove_html,
                                              remove_urls=remove_urls,
                                              remove_special=remove_special, unicode=unicode))


def text_split(df: DataFrame, column: str, max_length: int = 512, overlap: int = 50) -> DataFrame:
    """Word windows of ``max_length`` words advancing by ``max_length -
    overlap``; ``_chunk_idx`` is the start word offset; blank text gives no
    row.  Runs over whole texts with generators (no Python per row)."""
    max_length, overlap = int(max_length), int(overlap)
    if max_length <= 0:
        raise ValueError("text_split: max_length must be positive")
    if overlap >= max_length or overlap < 0:
        raise ValueError("text_split: overlap must be in [0, max_length)")
    step = max_length - overlap
    words = textfn.words(F.col(column).cast("string"))
    out_cols = [c for c in df.columns if c != column]
    with_words = df.select(*out_cols, words.alias("__w"))
    n = F.size("__w")
    # chunks are built inside one array expression and only the chunks are
    # exploded: no output row carries the document's whole word array, so a
    # long document costs O(words), not O(words x chunks)
    chunks = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)),
                         lambda s: F.struct(s.cast("bigint").alias("i"),
                                            F.array_join(F.slice(F.col("__w"), s + 1, F.lit(max_length)), " ").alias("t")))
    exploded = with_words.where(n > 0).select(*out_cols, F.inline(chunks))
    return exploded.select(*[F.col("t").alias(c) if c == column else F.col(c) for c in df.columns],
                           F.col("i").alias("_chunk_idx"))


def _variant_object_schema(df: DataFrame, column: str) -> T.StructType | None:
    v = F.try_parse_json(F.col(column).cast("string"))
    obj = F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    ddl = df.select(F.schema_of_variant_agg(obj)).first()[0]  # one aggregate pass
    if not ddl or not ddl.startswith("OBJECT"):
        return None
    from pyspark.sql.types import _parse_datatype_string
    return _parse_datatype_string("STRUCT" + ddl[len("OBJECT"):].replace("OBJECT<", "STRUCT<"))


def flatten_json(df: DataFrame, column: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Expand one level of a JSON object column into ``<column>_<key>``
    columns.  Keys are discovered with one ``schema_of_variant_agg`` pass
    unless ``schema`` is given (required for streams).  Bad JSON and
    non-object rows keep their row with null key columns; nested values
    come out as JSON text."""
    if isinstance(schema, str):
        from pyspark.sql.types import _parse_datatype_string
        schema = _parse_datatype_string(schema)
    dt = col_type(df, column)
    if isinstance(dt, (T.StructType, T.MapType)):
        src = F.to_json(F.col(column))
    else:
        src = F.col(column).cast("string")
    if schema is None:
        schema = _variant_object_schema(df.select(src.alias(column)), column)
    keep = [F.col(c) for c in df.columns if c != column]
    if schema is None or not schema.fields:
        return df.select(*keep)
    v = F.try_parse_json(src)
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    new = []
    for f in schema.fields:
        path = "$['" + f.name.replace("'", "\\'") + "']"
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            val = F.to_json(F.try_variant_get(v, path, "variant"))
        else:
            val = F.try_variant_get(v, path, f.dataType.simpleString())
        new.append(F.when(is_obj, val).alias(f"{column}_{f.name}"))
    return df.select(*keep, *new)


# --------------------------------------------------------------------------- joins / union

JOIN_TYPES = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full"}


#: A key is heavy if a side's sample has it in at least this part of its rows.
HEAVY_SHARE = 0.02
#: Rows of one side of a heavy key that a task of the join takes.
HEAVY_ROWS = 1_000_000
#: Pairs of rows of a heavy key that a task of the join makes.
HEAVY_PAIRS = 10_000_000


def heavy_keys(df: DataFrame, keys: list[str], share: float = HEAVY_SHARE, sample: float | None = None, seed: int = 7) -> list[tuple]:
    """Key values (nulls too) in at least ``share`` of a sample's rows: at
    most 1 / ``share`` of them.  ``sample``: the part of the rows looked at,
    by default about a million."""
    if sample is None:
        sample = min(1.0, 1_000_000 / max(1, df.count()))
    some = df.select(*keys) if sample >= 1 else df.select(*keys).sample(sample, seed)
    counts = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    n = some.count()
    return [tuple(r[k] for k in keys) for r in counts.where(F.col("__n") >= share * n).collect()] if n else []


def merge(df: DataFrame, right: DataFrame, on, how: str = "inner", right_on=None,
          null_safe: bool = True, suffix: str = "_right", split_heavy: bool = False, share: float = HEAVY_SHARE,
          heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Equi-join on one or more keys.  Null keys match each other by default
    (the reference's dict probe does).  Right columns that collide with a
    left name get ``suffix``.  With equal key names one key column is
    returned (coalesced for right / outer joins).  Catalyst chooses
    broadcast-hash (size-checked against the broadcast threshold) or
    sort-merge; AQE re-plans and splits skewed partitions at run time.

    ``split_heavy``: for what AQE cannot split (a full join, a key that is hot
    on both sides) or would see too late.  Keys that hold ``share`` of a
    sample of either side are joined by themselves: a key's rows are cut into
    salted parts of ``heavy_rows`` on both sides, smaller ones if two parts
    would make more than ``HEAVY_PAIRS`` rows; each part meets each of the
    other side's, and a key that one side lacks needs no join.  The result is
    the same; the inputs are read a few times more."""
    if how not in JOIN_TYPES:
        raise ValueError(f"merge: unknown join type {how!r}")
    lkeys = as_names(on)
    rkeys = as_names(right_on) or lkeys
    if len(lkeys) != len(rkeys) or not lkeys:
        raise ValueError("merge: on / right_on must name the same number of keys")
    if split_heavy:
        return _merge_split(df, right, lkeys, rkeys, JOIN_TYPES[how], null_safe, suffix, share, heavy_rows)
    return _merge(df, right, lkeys, rkeys, JOIN_TYPES[how], null_safe, suffix)


def _merge(df: DataFrame, right: DataFrame, lkeys: list[str], rkeys: list[str], how: str, null_safe: bool, suffix: str,
           also: list[str] = ()) -> DataFrame:
    """The plain join; ``also``: columns of both sides that agree where the keys do and must, left out of the result."""
    shared = [lk for lk, rk in zip(lkeys, rkeys) if lk == rk]
    tmp = {rk: f"__rk{i}" for i, rk in enumerate(rkeys) if rk in shared}
    rnames = {}
    for c in right.columns:
        if c in tmp:
            rnames[c] = tmp[c]
        elif c in df.columns:
            rnames[c] = f"{c}{suffix}"
        else:
            rnames[c] = c
    r = right.select(*[F.col(c).alias(rnames[c]) for c in right.columns])
    cond = None
    for lk, rk in zip(lkeys, rkeys) if not also else zip(also, also):
        lc, rc = df[lk], r[rnames[rk]]
        e = lc.eqNullSafe(rc) if null_safe and not also else (lc == rc)
        cond = e if cond is None else (cond & e)
    joined = df.join(r.hint("shuffle_hash") if also else r, cond, how)
    out = []
    for c in df.columns:
        if c in also:
            continue
        if c in shared and how in ("right", "full"):
            out.append(F.coalesce(df[c], r[tmp[c]]).alias(c) if how != "right" else r[tmp[c]].alias(c))
        else:
            out.append(df[c])
    out += [r[rnames[c]] for c in right.columns if c not in tmp and c not in also]
    return joined.select(*out)


def _cut(n: int, m: int, heavy_rows: int) -> tuple[int, int]:
    """Into how many parts the ``n`` left and ``m`` right rows of a key go."""
    side = min(heavy_rows, math.isqrt(HEAVY_PAIRS))
    if n * m <= HEAVY_PAIRS or min(n, m) <= side:  # the smaller side is whole, as far as heavy_rows lets it
        small, large = sorted((n, m))
        a = -(-small // heavy_rows)
        b = max(-(-large // heavy_rows), -(-(-(-small // a) * large) // HEAVY_PAIRS))
        return (a, b) if n <= m else (b, a)
    return -(-n // side), -(-m // side)


def _merge_split(df: DataFrame, right: DataFrame, lkeys: list[str], rkeys: list[str], how: str, null_safe: bool, suffix: str,
                 share: float, heavy_rows: int) -> DataFrame:
    from tessera.operators.numbering import row_tie
    spark = df.sparkSession
    found = {*heavy_keys(df, lkeys, share), *heavy_keys(right, rkeys, share)}
    if not null_safe:
        found = {k for k in found if all(v is not None for v in k)}
    if not found:
        return _merge(df, right, lkeys, rkeys, how, null_safe, suffix)
    names = [f"__k{i}" for i in range(len(lkeys))]
    kinds = [df.schema[k].dataType for k in lkeys]
    table = spark.createDataFrame([(*k, i) for i, k in enumerate(sorted(found, key=repr))], T.StructType(
        [T.StructField(n, t) for n, t in zip(names, kinds)] + [T.StructField("__heavy", T.IntegerType())]))

    def marked(side: DataFrame, keys: list[str]) -> DataFrame:
        cond = None
        for k, n in zip(keys, names):
            e = side[k].eqNullSafe(table[n])
            cond = e if cond is None else cond & e
        # at most 2 / share rows
        return side.join(F.broadcast(table), cond, "left").select(*[side[c] for c in side.columns], "__heavy")

    left, other = marked(df, lkeys), marked(right, rkeys)
    plain = _merge(left.where("__heavy is null").drop("__heavy"), other.where("__heavy is null").drop("__heavy"),
                   lkeys, rkeys, how, null_safe, suffix)
    counts = {}
    for which, side in enumerate((left, other)):
        for r in side.where("__heavy is not null").groupBy("__heavy").count().collect():
            counts.setdefault(r["__heavy"], [0, 0])[which] = r["count"]
    both, parts, pairs = [], 0, 0
    for h, (n, m) in counts.items():
        if n and m:
            cut = _cut(n, m, heavy_rows)
            both.append((h, *cut, parts))
            parts, pairs = parts + cut[0] * cut[1], pairs + n * m
    table = spark.createDataFrame(both, "__heavy int, __l int, __r int, __base long")
    # a number of tasks that Spark does not lower: a part's rows are few, what it makes is not
    tasks = max(min(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-pairs // HEAVY_PAIRS), 1)
    # part (a, b): the a-th part of the left rows and the b-th of the right ones
    here, there = F.pmod(row_tie(df), F.col("__l")), F.pmod(row_tie(right), F.col("__r"))
    l = left.join(F.broadcast(table), "__heavy").withColumn("__a", here) \
        .withColumn("__b", F.explode(F.sequence(F.lit(0), F.col("__r") - 1)))
    r = other.join(F.broadcast(table), "__heavy").withColumn("__b", there) \
        .withColumn("__a", F.explode(F.sequence(F.lit(0), F.col("__l") - 1)))
    l, r = (x.withColumn("__part", F.col("__base") + F.col("__a") * F.col("__r") + F.col("__b")).select(*side.columns, "__part")
            .repartition(tasks, "__part") for x, side in ((l, df), (r, right)))
    out = plain.unionByName(_merge(l, r, lkeys, rkeys, "inner", null_safe, suffix, also=["__part"]))
    alone = [[h for h, nm in counts.items() if nm[which] and not nm[1 - which]] for which in (0, 1)]
    for which, (side, kept) in enumerate(((left, ("left", "full")), (other, ("right", "full")))):
        if alone[which] and how in kept:  # no partner anywhere
            rows = side.where(F.col("__heavy").isin(alone[which])).drop("__heavy")
            pair = (rows, right.where(F.lit(False))) if which == 0 else (df.where(F.lit(False)), rows)
            out = out.unionByName(_merge(*pair, lkeys, rkeys, how, null_safe, suffix))
    return out


def concat(df: DataFrame, other: DataFrame) -> DataFrame:
    if other is None:
        raise ValueError("concat: source not found")
    return df.unionByName(other, allowMissingColumns=True)
