"""Whitening of embeddings by refined eigenvectors of their covariance.

Vectors are quantised to integers, so sums and products over the fit list are
exact and do not depend on how rows lie in tasks: every task multiplies its
rows, centred to the nearest integer mean, as one matrix product a block, Spark
adds the products, and the remaining fraction of the mean is taken off in
exact arithmetic.  The eigenvectors come from a float32 decomposition and are
corrected by Ogita-Aishima iterations, matrix products in extended precision.
Eigenvalues too close for their gap to be a divisor are a cluster: its
subspace is turned by the eigenvectors of the small projected matrix.

Only matrices of the dimension's size reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

SCALE, SHIFT = 64, 1_000_000
#: An entry must be below this in size once scaled, or its row is dropped.
LARGEST = 2.0 ** 60
#: Products of centred integers are exact in a float64 sum below this.
_EXACT = 2 ** 53
_BLOCK = 4096


# ------------------------------------------------------------------ eigenvectors

def _norm(a: np.ndarray) -> float:
    """Largest row sum: an upper bound of a symmetric matrix's 2-norm."""
    return float(np.abs(a).sum(1).max()) if a.size else 0.0


def _clusters(values: np.ndarray, gap: float) -> list[slice]:
    """Runs of two or more falling eigenvalues with neighbours within ``gap``."""
    cuts = np.flatnonzero(np.diff(-values) > gap) + 1
    edges = [0, *cuts.tolist(), values.size]
    return [slice(a, b) for a, b in zip(edges, edges[1:]) if b - a > 1]


def _corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One iteration: better vectors, eigenvalue estimates of the given ones,
    and the gap below which two of them were not told apart."""
    r = np.eye(len(x), dtype=x.dtype) - x.T @ x
    s = x.T @ a @ x
    values = np.diag(s) / (1 - np.diag(r))
    gap = 2 * (_norm(s - np.diag(values)) + _norm(a) * _norm(r))
    apart = values[None, :] - values[:, None]
    near = np.abs(apart) <= gap
    e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, apart))
    return x + x @ e, values, gap


def refined_eigenvectors(a: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric
    matrix to double precision, from a float32 decomposition.

    Each iteration squares the error of vectors whose eigenvalues lie apart.
    Within a cluster an iteration only makes the vectors orthonormal; then the
    matrix, shifted by the cluster's middle and projected on its subspace, is
    solved by itself and turns them.  Iteration ends when corrections stop
    shrinking."""
    if not len(a):
        return np.empty(0), np.empty((0, 0))
    a = np.asarray(a, np.longdouble)
    scale = np.abs(a).max() or np.longdouble(1)
    a = a / scale  # float32 keeps any size
    values, x = np.linalg.eigh(a.astype(np.float32))
    x = x[:, np.argsort(-values)].astype(np.longdouble)
    before = np.inf
    for _ in range(rounds):
        new, values, gap = _corrected(a, x)
        order = np.argsort(-values, kind="stable")
        new, values = new[:, order], values[order]
        for c in _clusters(values, gap):
            q = new[:, c]
            middle = values[c].mean()
            small = q.T @ (a @ q - middle * q)
            _, turn = np.linalg.eigh(((small + small.T) / 2 / (np.abs(small).max() or 1)).astype(np.float64))
            new[:, c] = q @ turn[:, ::-1].astype(np.longdouble)
        change = float(np.abs(new - x[:, order]).max())
        x = new
        if change < 1e-18 or (change < 1e-15 and change >= before):
            break
        before = change
    x = x + x @ (np.eye(len(x), dtype=x.dtype) - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(np.float64), x[:, order].astype(np.float64)


# ----------------------------------------------------------------- the fit list

class Model(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray     # all eigenvalues, falling
    vectors: np.ndarray    # columns
    trace: float


def quantised(vector: Column) -> Column:
    """``floor(64 c) + 1000000`` of each entry as BIGINT; null where the vector
    is null or holds a null, non-finite or unrepresentable entry."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    good = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < LARGEST, F.lit(False)))  # NaN is the largest value
    return F.when(good, scaled)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _products(batches: Iterator[pa.RecordBatch], centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Exact sums of products of the centred entries, upper triangle."""
    dim = centre.size
    i, j = np.triu_indices(dim)
    total = np.zeros((dim, dim), object)
    for batch in batches:
        rows = _matrix(batch.column(0), dim)
        for at in range(0, len(rows), _BLOCK):
            y = rows[at:at + _BLOCK] - centre
            largest = int(np.abs(y).max())
            if largest * largest * len(y) < _EXACT:
                y = y.astype(np.float64)
                total += (y.T @ y).astype(np.int64).astype(object)
            else:
                y = y.astype(object)
                total += y.T @ y
    if total.any():
        high, low = zip(*(divmod(int(v), 1 << 60) for v in total[i, j]))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                          pa.array(list(map(str, high))), pa.array(low, pa.int64())],
                                         names=["i", "j", "high", "low"])


def fit(vectors: DataFrame, dim: int, column: str = "x") -> Model:
    """The model of a table of distinct integer vectors of length ``dim``."""
    n, sums = 0, [0] * dim
    if dim:
        total = vectors.select(F.count("*"), *[F.sum(F.col(column)[k].cast("decimal(38,0)")) for k in range(dim)]).first()
        n, sums = total[0], [int(v or 0) for v in total[1:]]
    if not n:
        return Model(0, sums, np.zeros(dim), np.zeros((dim, dim)), 0.0)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    parts = vectors.select(column).mapInArrow(lambda it: _products(it, centre), "i int, j int, high string, low long")
    gram = np.zeros((dim, dim), object)
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    for r in parts.groupBy("i", "j").agg(*exact).toLocalIterator():
        gram[r.i, r.j] = gram[r.j, r.i] = (int(r.high) << 60) + int(r.low)
    rest = [s - n * int(c) for s, c in zip(sums, centre)]  # what the integer centre leaves
    cov = np.empty((dim, dim), np.longdouble)
    for i in range(dim):
        for j in range(i, dim):
            exact = Fraction(n * gram[i, j] - rest[i] * rest[j], n * n)
            high = float(exact)
            cov[i, j] = cov[j, i] = np.longdouble(high) + np.longdouble(float(exact - Fraction(high)))
    values, vecs = refined_eigenvectors(cov)
    sign = np.sign(vecs[np.abs(vecs).argmax(0), np.arange(dim)])
    return Model(n, sums, values, vecs * np.where(sign == 0, 1, sign), float(sum(cov.diagonal())))


def _numerators(rows: np.ndarray, model: Model) -> np.ndarray:
    """``n * x - S`` as integers; as Python's where a BIGINT could overflow."""
    if not rows.size:
        return rows
    if (int(np.abs(rows).max()) + max(map(abs, model.sums)) // model.n + 1) * model.n < 2 ** 62:
        return rows * np.int64(model.n) - np.array(model.sums, np.int64)
    return rows.astype(object) * model.n - np.array(model.sums, object)


def _deviation(top: np.ndarray) -> list:
    """Exact sum of squares by row; None where it is no BIGINT."""
    if top.dtype != object and top.size and int(np.abs(top).max()) ** 2 * top.shape[1] < 2 ** 63:
        return (top * top).sum(1).tolist()
    return [v if v < 2 ** 63 else None for v in (sum(int(x) ** 2 for x in row) for row in top)]


def _whitened(top: np.ndarray, model: Model, directions: np.ndarray) -> np.ndarray:
    return (top / model.n).astype(np.float64) @ directions if model.n else top.astype(np.float64) @ directions


def _directions(model: Model, components: int) -> tuple[np.ndarray, int]:
    """Eigenvectors over the root of their eigenvalue, as far as that is not
    nothing beside the largest."""
    k = min(components, len(model.values))
    usable = int((model.values[:k] > 1e-12 * max(model.values.max(initial=0), 1e-300)).sum()) if k else 0
    return model.vectors[:, :usable] / np.sqrt(model.values[:usable]), k


def identity_error(vectors: DataFrame, model: Model, components: int = 16, column: str = "x") -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    directions, _ = _directions(model, components)
    size = directions.shape[1]
    if not model.n or not size:
        return None
    dim = len(model.sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            rows = _matrix(batch.column(0), dim)
            for at in range(0, len(rows), _BLOCK):
                w = _whitened(_numerators(rows[at:at + _BLOCK], model), model, directions)
                total += w.T @ w
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                          pa.array(total[i, j])], names=["i", "j", "s"])

    error = F.abs(F.sum("s") / model.n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    per = vectors.select(column).mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(error.alias("e"))
    return per.agg(F.max("e")).first()[0]


# ------------------------------------------------------------------- the operator

def whiten(rows: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per usable input row and component (from 1, by falling
    eigenvalue, at most ``components`` and the dimension): the id,
    ``component``, ``n`` (size of the fit list, each distinct quantised vector
    once), ``deviation`` (exact, over all dimensions), ``whitened``,
    ``explained`` (share of the trace) and ``identity_error``.

    Rows whose vector is null, holds a null or non-finite entry, or an entry
    of 2 ** 60 / 64 or more are dropped; so are those of another length than the
    most frequent one (of equals the longer).  Repeated rows and null ids come
    back as they are.  A direction without variance has whitened null (all
    have, where every vector is equal; then explained and identity_error are
    null too); a deviation beyond a BIGINT is null.  An empty table, or one of
    empty vectors, gives no rows; further columns of ``rows`` are not read."""
    spark = rows.sparkSession
    good = materialise(rows.select(F.col(f"`{id_col}`").alias("id"), quantised(F.col(f"`{vector_col}`")).alias("x"))
                       .filter("x IS NOT NULL"), "vectors")
    lengths = good.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = lengths[0].dim if lengths else 0
    good = good.filter((F.size("x") == dim) & F.lit(dim > 0))
    distinct = materialise(good.select("x").distinct(), "fit-list")
    model = fit(distinct, dim)
    directions, k = _directions(model, components)
    error = identity_error(distinct, model, components)
    shared = spark.sparkContext.broadcast((model, directions))  # dim x components
    schema = pa.schema([("deviation", pa.int64()), ("w", pa.list_(pa.float64()))])

    @F.arrow_udf("deviation long, w array<double>")
    def project(x: pa.Array) -> pa.Array:
        model, directions = shared.value
        top = _numerators(_matrix(x, dim), model)
        w = _whitened(top, model, directions)
        w = np.concatenate([w, np.full((len(w), k - w.shape[1]), np.nan)], axis=1)
        flat = pa.array(w.ravel(), from_pandas=True)  # NaN: no direction, null
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), flat)
        return pa.StructArray.from_arrays([pa.array(_deviation(top), pa.int64()), lists], fields=list(schema))

    share = [float(v / model.trace) if model.trace else None for v in model.values[:k]]
    explained = F.array(*[F.lit(v).cast("double") for v in share]) if k else F.array().cast("array<double>")
    return (good.withColumn("p", project(F.col("x"))).select("id", "p.deviation", F.posexplode("p.w").alias("place", "whitened"))
            .select(F.col("id").alias(id_col), (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
                    "deviation", "whitened", explained[F.col("place")].alias("explained"),
                    F.lit(error).cast("double").alias("identity_error")))
