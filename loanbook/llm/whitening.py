"""Whitening of embeddings, with eigenvectors refined from single to extended precision.

Entries become integers, so that sums and products over all rows are exact and do not depend on their order: two passes
give the sums and, centred on the rounded means, the products of every pair of dimensions. The covariance (its size is
set by the dimensions alone) comes to the driver as exact fractions. Its eigenvectors are found in float32 and corrected
by the iterations of Ogita and Aishima, matrix products in extended precision that double the right digits each time.
Eigenvalues that lie too close together for a correction form a cluster, which is solved as a small problem of its own
inside the space its vectors span. The projection is a map over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanbook.llm.common import staged

SCALE, SHIFT = 1024, 100_000
# Entries from this size on could not be squared and summed exactly; they count as not finite.
LARGEST = float(1 << 40)
MOST_STEPS = 30
ROUNDING = 1e-18
LONG = 2**63 - 1


# -- eigenvectors -----------------------------------------------------------------------------------------------------


@dataclass
class Eigen:
    """Falling eigenvalues and their unit vectors, as columns, in extended precision."""

    values: np.ndarray
    vectors: np.ndarray
    steps: int


def eigenpairs(matrix: np.ndarray) -> Eigen:
    """All eigenpairs of a symmetric matrix, from its float32 eigenvectors."""
    size = len(matrix)
    scale = float(np.abs(matrix).max()) if size else 0.0
    if scale == 0.0:
        return Eigen(np.zeros(size, np.longdouble), np.eye(size, dtype=np.longdouble), 0)
    exact = matrix.astype(np.longdouble) / np.longdouble(scale)
    vectors = np.linalg.eigh(exact.astype(np.float32))[1].astype(np.longdouble)
    steps, last = 0, False
    while steps < MOST_STEPS and not last:
        steps += 1
        values, correction, near = refinement(exact, vectors)
        # Errors square in every step: after a correction this small, what is left lies below rounding.
        last = float(np.abs(correction).max()) < 1e-10
        vectors = vectors + vectors @ correction
        for group in clusters(values, near):
            vectors[:, group] = vectors[:, group] @ inside(exact, vectors[:, group])
    for _ in range(2):
        vectors = vectors + vectors @ (np.eye(size, dtype=np.longdouble) - vectors.T @ vectors) / 2
    values = np.einsum("ik,ij,jk->k", vectors, exact, vectors, optimize=True) / (vectors**2).sum(0)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order] / np.sqrt((vectors[:, order] ** 2).sum(0))
    return Eigen(values[order] * np.longdouble(scale), vectors, steps)


def refinement(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One iteration: eigenvalue estimates, the correction E of X + XE, and the distance below which two eigenvalues
    cannot be told apart yet."""
    residual = np.eye(len(matrix), dtype=np.longdouble) - vectors.T @ vectors
    seen = vectors.T @ (matrix @ vectors)
    seen = (seen + seen.T) / 2
    values = np.diagonal(seen) / (1 - np.diagonal(residual))
    off = seen - np.diag(values)
    norm = float(np.sqrt((matrix**2).sum()))
    near = 2 * (float(np.sqrt((off**2).sum())) + norm * float(np.sqrt((residual**2).sum()))) + len(matrix) * ROUNDING * norm
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > near
    correction = np.where(apart, (seen + values[None, :] * residual) / np.where(apart, gap, 1), residual / 2)
    return values, correction, near


def clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Groups of two or more eigenvalues, each within ``near`` of the next."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    return [group for group in np.split(order, cuts) if len(group) > 1]


def inside(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Rotation of the vectors of a cluster to the eigenvectors within the space they span: after taking the middle of
    the cluster away only its small differences are left, which double precision resolves."""
    gram = vectors.T @ vectors
    small = vectors.T @ (matrix @ vectors)
    small = small - np.trace(small) / np.trace(gram) * gram
    size = float(np.abs(small).max())
    if size == 0.0:
        return np.eye(len(small), dtype=np.longdouble)
    return np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))[1].astype(np.longdouble)


# -- exact sums over all rows -----------------------------------------------------------------------------------------


def whole_entries(vector: Column) -> Column:
    """The integer entries of a vector; null where an entry is null or not finite, or the vector null."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c) < LARGEST))
    return F.when(fine, F.transform(entries, lambda c: F.floor(c * SCALE) + SHIFT))


def matrix_of(column: pa.ListArray, size: int) -> np.ndarray:
    """Rows as a matrix; entries that a shorter vector lacks are those of a zero."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    lengths = np.diff(offsets)
    if (lengths == size).all():
        return values.reshape(-1, size)
    out = np.full((len(lengths), size), SHIFT, np.int64)
    out[np.arange(size) < lengths[:, None]] = values
    return out


def exact_products(rows: np.ndarray) -> np.ndarray:
    """Products of all pairs of columns, summed over the rows, as Python integers."""
    largest = int(np.abs(rows).max(initial=0))
    if largest**2 * max(len(rows), 1) < 1 << 53:
        held = rows.astype(np.float64)
        return (held.T @ held).astype(np.int64).astype(object)
    return rows.T.astype(object) @ rows.astype(object)


def column_sums(entries: DataFrame, size: int) -> list[int]:
    """The exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, object)
        for batch in batches:
            # Entries lie below 2^51, so 4,096 of them add up below 2^63.
            rows = matrix_of(batch.column(0), size)
            for at in range(0, len(rows), 4096):
                total = total + rows[at:at + 4096].sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(map(str, total), pa.string())], ["i", "part"])

    parts = entries.select("_x").mapInArrow(run, "i int, part string")
    found = dict(parts.groupBy("i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect())
    return [int(found[i]) for i in range(size)]


def covariance(entries: DataFrame, sums: list[int], n: int) -> np.ndarray:
    """Covariance with divisor n, every entry the double next to the exact value.

    Entries are centred on the rounded mean before they are multiplied; what rounding left is taken off exactly."""
    size = len(sums)
    middle = [(2 * s + n) // (2 * n) for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), object)
        for batch in batches:
            rows = matrix_of(batch.column(0), size) - np.array(middle, np.int64)
            for at in range(0, len(rows), 4096):
                total = total + exact_products(rows[at:at + 4096])
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(map(str, total[i, j]), pa.string())], ["i", "j", "part"])

    parts = entries.select("_x").mapInArrow(run, "i int, j int, part string")
    whole = parts.groupBy("i", "j").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    out = np.zeros((size, size))
    for i, j, s in whole.toLocalIterator():
        out[i, j] = out[j, i] = (n * int(s) - rest[i] * rest[j]) / (n * n)  # Python rounds once
    return out


# -- operator ---------------------------------------------------------------------------------------------------------


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row with a usable vector.

    Rows whose vector is null, or holds null entries or ones that are not finite (or at least 2^40 in size), are left
    out. A vector that is shorter than the longest one counts as followed by zeros. Repeated rows, and rows with a null
    key, are rows like others; other columns are not read, whatever their names. Without any usable row, or with empty
    vectors alone, there are no rows. A component whose eigenvalue is not above rounding (constant dimensions, fewer
    rows than components) has a null ``whitened`` and does not enter ``identity_error``, which is null if there is no
    other; ``explained`` is null if nothing varies. A deviation beyond the range of a long is null."""
    spark = rows.sparkSession
    entries = staged(rows.select(F.col(key).alias("_key"), whole_entries(F.col(vector)).alias("_x")).filter("_x IS NOT NULL"), "whiten-entries")
    count = entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("_x")), F.lit(0)).alias("size")).first()
    n, size = count["n"], count["size"]
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if n == 0 or size == 0:
        return spark.createDataFrame([], schema)
    sums = column_sums(entries, size)
    spread = covariance(entries, sums, n)
    eigen = eigenpairs(spread)
    kept = min(components, size)
    floor = float(np.trace(spread)) * size * 1e-15
    varies = [float(v) > floor for v in eigen.values[:kept]]
    axes = np.zeros((size, kept))
    for k in range(kept):
        if varies[k]:
            axes[:, k] = (eigen.vectors[:, k] / np.sqrt(eigen.values[k])).astype(np.float64)
    projected = staged(_projected(entries, sums, n, axes), "whiten-projected")

    total = float(np.trace(spread))
    explained = [float(v) / total if total > 0 else None for v in eigen.values[:kept]]
    error = identity_error(projected, [k for k in range(kept) if varies[k]])
    row = F.posexplode("_w").alias("_at", "_value")
    shares = F.array(*[F.lit(e).cast("double") for e in explained])
    live = F.array(*[F.lit(v) for v in varies])
    return projected.select("_key", "_deviation", row).select(
        F.col("_key").alias(key), (F.col("_at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
        F.col("_deviation").alias("deviation"), F.when(F.get(live, F.col("_at")), F.col("_value")).alias("whitened"),
        F.get(shares, F.col("_at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def _projected(entries: DataFrame, sums: list[int], n: int, axes: np.ndarray) -> DataFrame:
    """The deviation of every row from the mean, and its place on the axes."""
    size, kept = axes.shape
    largest = max(abs(s) for s in sums)
    key = entries.schema["_key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                rows = matrix_of(piece.column(1), size)
                if int(np.abs(rows).max(initial=0)) * n + largest < 1 << 62:
                    off = rows * n - np.array(sums, np.int64)
                else:
                    off = rows.astype(object) * n - np.array(sums, object)
                inexact = off.astype(np.float64)
                if float((inexact**2).sum(1).max(initial=0)) < 9e18 and off.dtype != object:
                    deviation = (off**2).sum(1).tolist()
                else:
                    deviation = [d if d <= LONG else None for d in (off.astype(object) ** 2).sum(1)]
                placed = (inexact / n) @ axes
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * kept), pa.array(placed.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(deviation, pa.int64()), lists], ["_key", "_deviation", "_w"])

    return entries.select("_key", "_x").mapInArrow(run, f"_key {key.simpleString()}, _deviation bigint, _w array<double>")


def identity_error(projected: DataFrame, live: list[int]) -> float | None:
    """The largest entry of the covariance of the whitened rows minus the identity, from the rows themselves."""
    if not live:
        return None
    place = lambda k: F.get("_w", F.lit(k))
    pairs = [(a, b) for a in live for b in live if a <= b]
    found = projected.agg(*[F.covar_pop(place(a), place(b)).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
