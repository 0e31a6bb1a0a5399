"""Training-data preparation: reproducible random splits, batch ids,
synthetic tables keyed on existing rows, and feature-array augmentation.

Randomness is hash-based (md5 / xxhash64 of key and seed), so a result does
not depend on partitioning or task retries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.numbering import prefix_sum

# Generator constants, as in the reference (its pi, blob centres).
PI = 3.14159
BLOB_CENTERS = [(0, 0), (3, 3), (0, 3), (3, 0)]


def hex_threshold(fraction: float) -> str:
    """13-hex-digit threshold t with P(md5 prefix < t) = fraction to 52 bits."""
    v = min(max(int(math.ceil(fraction * 16 ** 13)), 0), 16 ** 13)
    return "g" if v >= 16 ** 13 else f"{v:013x}"


def split_key(key: Column, seed) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(":"), F.lit(str(seed))))


def random_split(df: DataFrame, key: str, train_fraction: float = 0.8, seed=0,
                 names=("train", "validation")) -> DataFrame:
    """Adds ``split``: a row is train when the first 13 hex digits of
    ``md5(key:seed)`` fall under the fraction's threshold (stable under
    re-partitioning; the same test runs in any SQL engine with md5)."""
    h = F.substring(split_key(F.col(key), seed), 1, 13)
    return df.withColumn("split", F.when(h < F.lit(hex_threshold(train_fraction)), names[0]).otherwise(names[1]))


def split_sizes(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).cast("bigint").alias("n_samples"))


def label_encode(df: DataFrame, label: str, out: str = "class_id") -> DataFrame:
    """Class ids = position of the label in the sorted distinct labels;
    ``n_classes`` = distinct labels.  The label table is one row per class."""
    labels = df.select(F.col(label).alias("__l")).where(F.col("__l").isNotNull()).distinct()
    # numbered by a bucketed prefix count: no single-task window even for
    # a label set that turns out large
    numbered = prefix_sum(labels, ["__l"], out=out).select("__l", F.col(out).cast("bigint").alias(out))
    n = labels.agg(F.count(F.lit(1))).scalar()
    return df.join(numbered, df[label] == numbered["__l"], "left").drop("__l") \
        .withColumn("n_classes", n.cast("bigint"))


def batch_ids(df: DataFrame, key: str, batch_size: int = 32, seed=0, shuffle: bool = True) -> DataFrame:
    """Adds ``batch_id`` (bigint): rows in ``key`` order, or in the order of a
    seeded hash of the key when ``shuffle``, cut into batches of ``batch_size``;
    only the last batch can be short."""
    b = df.withColumn("__h", split_key(F.col(key), seed)) if shuffle else df
    numbered = prefix_sum(b, ["__h", key] if shuffle else [key], out="__pos")
    return numbered.withColumn("batch_id", F.floor(F.col("__pos") / batch_size).cast("bigint")).select(*df.columns, "batch_id")


# --------------------------------------------------------------------------- noise


def uniform(key: Column, seed: int, salt: int | Column = 0) -> Column:
    """Deterministic U[0, 1): the first 52 bits of ``md5(key:seed:salt)``, so
    that other SQL engines draw the same numbers."""
    parts = [key.cast("string"), F.lit(str(seed)), salt.cast("string") if isinstance(salt, Column) else F.lit(str(salt))]
    h = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return F.conv(h, 16, 10).cast("double") / F.lit(float(1 << 52))


def beta(key: Column, alpha: float, seed: int, tries: int = 32) -> Column:
    """One Beta(alpha, alpha) draw per key by Joehnk's method: the first of
    ``tries`` pairs of uniforms with u^(1/a) + v^(1/a) <= 1 (for alpha up to
    1 a pair is accepted at least every other time; 0.5 if none is)."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: F.struct(
        F.pow(uniform(key, seed, i * 2), F.lit(1 / alpha)).alias("x"),
        F.pow(uniform(key, seed, i * 2 + 1), F.lit(1 / alpha)).alias("y")))
    good = F.filter(pairs, lambda p: (p["x"] + p["y"] <= 1) & (p["x"] + p["y"] > 0))
    first = F.get(good, F.lit(0))
    return F.coalesce(first["x"] / (first["x"] + first["y"]), F.lit(0.5))


def normal(key: Column, seed: int, salt: int | Column = 0) -> Column:
    """Standard normal by Box-Muller over two hash uniforms."""
    u1 = F.greatest(uniform(key, seed, salt), F.lit(1e-300))
    u2 = uniform(key, seed + 7919, salt)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * math.pi * u2)


# --------------------------------------------------------------------------- synthetic tables

SYNTHETIC = ("random", "xor", "spiral", "circles", "moons", "blobs", "checkerboard", "regression_sin")


def synthetic(keys: DataFrame, key: str, kind: str, noise: float = 0.1, seed: int = 0,
              dim: int = 784, classes: int = 10) -> DataFrame:
    """One synthetic example per row of ``keys`` (so the table grows with the
    input): key, x ARRAY<DOUBLE>, y.  Curves are laid out by the row's
    position in ``key`` order, exactly as the reference's linspace layout."""
    k = F.col(key)
    if kind == "random":
        x = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: normal(k, seed, j))
        y = F.floor(uniform(k, seed, -1) * classes).cast("bigint")
        return keys.select(key, x.alias("x"), y.alias("y"))
    if kind in ("xor", "checkerboard"):
        if kind == "xor":
            a, b = normal(k, seed, 0), normal(k, seed, 1)
            y = ((a > 0) != (b > 0)).cast("bigint")
        else:
            a, b = uniform(k, seed, 0) * 4, uniform(k, seed, 1) * 4
            y = ((F.floor(a) + F.floor(b)) % 2).cast("bigint")
        return keys.select(key, F.array(a, b).alias("x"), y.alias("y"))
    p = prefix_sum(keys.select(key), [key], out="__p")
    n = F.lit(keys.count())  # the layout needs n in many expressions: one count, then a literal
    pos = F.col("__p")
    half = F.floor(n / 2)
    cls = F.least((pos >= half).cast("bigint"), F.lit(1))
    i = F.when(pos >= half, pos - half).otherwise(pos)

    def lin(a, b, m):
        return F.lit(a) + F.lit(b - a) * i / F.greatest(m - 1, F.lit(1))
    nx, ny = normal(k, seed, 0) * noise, normal(k, seed, 1) * noise
    if kind == "spiral":
        th = lin(0.0, 4 * PI, half) + cls * PI
        r = lin(0.5, 2.0, half)
        x0, x1, y = r * F.cos(th), r * F.sin(th), cls
    elif kind == "circles":
        th = lin(0.0, 2 * PI, half)
        rad = 1.0 + cls
        x0, x1, y = F.cos(th) * rad, F.sin(th) * rad, cls
    elif kind == "moons":
        th = lin(0.0, PI, half)
        x0 = F.when(cls == 0, F.cos(th)).otherwise(1 - F.cos(th))
        x1 = F.when(cls == 0, F.sin(th)).otherwise(1 - F.sin(th) - 0.5)
        y = cls
    elif kind == "blobs":
        per = F.greatest(F.floor(n / 4), F.lit(1))
        c = F.least(F.floor(pos / per), F.lit(3)).cast("bigint")
        cx = F.element_at(F.array(*[F.lit(float(a)) for a, _ in BLOB_CENTERS]), (c + 1).cast("int"))
        cy = F.element_at(F.array(*[F.lit(float(b)) for _, b in BLOB_CENTERS]), (c + 1).cast("int"))
        x0, x1, y = cx + normal(k, seed, 0) * 0.5 - nx, cy + normal(k, seed, 1) * 0.5 - ny, c
    elif kind == "regression_sin":
        xv = F.lit(-3.0) + F.lit(6.0) * pos / F.greatest(F.lit(n) - 1, F.lit(1))
        return p.select(key, F.array(xv).alias("x"), (F.sin(xv * 2) + nx).alias("y"))
    else:
        raise ValueError(f"unknown synthetic dataset {kind!r}; expected one of {SYNTHETIC}")
    return p.select(key, F.array(x0 + nx, x1 + ny).alias("x"), y.cast("bigint").alias("y"))


# --------------------------------------------------------------------------- augmentation


def gaussian_noise(x: Column, key: Column, sigma: float = 0.1, seed: int = 0) -> Column:
    return F.transform(x, lambda v, j: v + normal(key, seed, j) * sigma)


def dropout_noise(x: Column, key: Column, p: float = 0.1, seed: int = 0) -> Column:
    return F.transform(x, lambda v, j: F.when(uniform(key, seed, j) < p, F.lit(0.0)).otherwise(v))


def scaling(x: Column, key: Column, lo: float = 0.9, hi: float = 1.1, seed: int = 0) -> Column:
    s = F.lit(lo) + uniform(key, seed, -1) * (hi - lo)
    return F.transform(x, lambda v: v * s)


def flip_horizontal(x: Column, c: int, h: int, w: int) -> Column:
    """Mirror each row of a flattened (c, h, w) image."""
    return F.transform(F.sequence(F.lit(0), F.lit(c * h * w - 1)),
                       lambda i: F.get(x, (i - i % w) + (w - 1 - i % w)))


def cutout(x: Column, c: int, h: int, w: int, size: int, cy: Column, cx: Column) -> Column:
    """Zero the square [cy - size//2, cy + size//2) x [cx - size//2, cx + size//2)."""
    y1, y2 = F.greatest(cy - size // 2, F.lit(0)), F.least(cy + size // 2, F.lit(h))
    x1, x2 = F.greatest(cx - size // 2, F.lit(0)), F.least(cx + size // 2, F.lit(w))

    def f(v, i):
        r = (i % (h * w)) / w
        r = F.floor(r)
        col = i % w
        inside = (r >= y1) & (r < y2) & (col >= x1) & (col < x2)
        return F.when(inside, F.lit(0.0)).otherwise(v)
    return F.transform(x, f)


def mixup(df: DataFrame, key: str, x: str, batch: str, alpha: float = 0.2, seed: int = 0) -> DataFrame:
    """x' = lam * x + (1 - lam) * x[partner] inside each batch: the partner is
    the next row of a seeded shuffle of the batch (the last row's is the
    first); lam ~ Beta(alpha, alpha), drawn once per batch.  Labels are
    unchanged, as in the reference."""
    w = Window.partitionBy(batch).orderBy(split_key(F.col(key), seed), F.col(key))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = df.withColumn("__px", F.coalesce(F.lead(x).over(w), F.first(x).over(whole)))
    lam = df.select(F.col(batch).alias("__b")).distinct().withColumn("__lam", beta(F.col("__b"), alpha, seed))
    mixed = F.zip_with(F.col(x), F.col("__px"), lambda a, b: F.col("__lam") * a + (1 - F.col("__lam")) * b)
    return r.join(lam, F.col(batch).eqNullSafe(F.col("__b"))).withColumn(x, mixed).select(*df.columns)
