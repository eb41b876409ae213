"""Whitening of vectors: the leading eigenvectors of their covariance, scaled to unit variance.

Components become whole numbers, x = floor(scale * c) + offset. One pass sums them by dimension; a second one sums, in every
task, the products of the vectors less their rounded means. These are whole numbers as well, so the covariance is exact,
whatever the partitions, and reruns agree to the last bit. Sums leave the tasks by rows of the matrix and meet by row, so only
the finished matrix, of ``max_dims`` squared numbers at most, comes to the driver. There it is made tridiagonal by
Householder reflections, its leading eigenvalues are bisected by Sturm counts, and inverse iteration finds their
vectors, anew orthogonal within clusters. Sums, components and eigenvalues, a few numbers a dimension, are broadcast, and a
last pass projects every vector.

Vectors that are null or empty, or hold null, non-finite or too large components (beyond 2**40), take no part, nor do vectors
of another length than the commonest (the longer one of two as common). Components of no variance, eigenvalue below ``flat``
times the largest, are left out, so equal vectors give no rows. Among equal eigenvalues any orthogonal vectors will do;
a vector's largest entry, the first of equal ones, is positive. Null and repeated ids keep a row for each of their vectors;
further columns, whatever their names, do not matter; empty tables give empty results. ``deviation`` is a decimal, as no long
holds that of very large tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from courtside.llm._common import column

#: Components beyond this take no part: their whole numbers still fit a long beside the offset, whatever the scale of 1024.
LARGEST = float(1 << 40)
#: A float adds whole numbers exactly below this.
EXACT = 1 << 53


def usable(vector: Column) -> Column:
    """The vector as doubles; null for one that takes no part."""
    numbers = vector.cast("array<double>")
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return F.when(fine & (F.size(numbers) > 0), numbers)


def whole(numbers: np.ndarray, scale: int, offset: int) -> np.ndarray:
    return np.floor(numbers * float(scale)).astype(np.int64) + offset


def _matrices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length in a batch's column ``at``."""
    vectors = batch.column(at)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
    for size in np.unique(sizes).astype(int):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[starts[rows][:, None] + np.arange(size)]


def _sums(scale: int, offset: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each length of vector and place: count, sum, least and greatest."""
        held: dict[int, list] = {}
        for batch in batches:
            for _, numbers in _matrices(batch, 0):
                x = whole(numbers, scale, offset)
                # Halves of 26 bits keep the sums of a batch within 64 bits.
                low = [int(h) * (1 << 26) + int(l) for h, l in zip((x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0))]
                n, s, least, most = held.get(x.shape[1], (0, [0] * x.shape[1], None, None))
                held[x.shape[1]] = [n + len(x), [a + b for a, b in zip(s, low)], x.min(0) if least is None else np.minimum(least, x.min(0)), x.max(0) if most is None else np.maximum(most, x.max(0))]
        for size, (n, s, least, most) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(map(Decimal, s), pa.decimal128(38, 0)), pa.array(least), pa.array(most)], ["size", "at", "n", "s", "least", "most"])

    return run


def products(y: np.ndarray) -> np.ndarray:
    """y.T @ y of whole numbers, exactly: of 64-bit numbers as long as the result fits, else of Python's."""
    largest = int(np.abs(y).max(initial=0))
    if largest * largest * max(len(y), 1) < EXACT:
        return (y.T.astype(float) @ y.astype(float)).astype(np.int64)
    # Three digits of base 2**21, the last with the sign; products of such digits over 256 rows are exact in floats.
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for i in range(0, len(y), 256):
        part, digits = y[i : i + 256], []
        for _ in range(3):
            digits.append((part & ((1 << 21) - 1)).astype(float))
            part = part >> 21
        digits[-1] += part.astype(float) * (1 << 21)
        for a, x in enumerate(digits):
            for b, z in enumerate(digits):
                out += (x.T @ z).astype(np.int64).astype(object) * (1 << (21 * (a + b)))
    return out


def _gram(size: int, scale: int, offset: int, middle: np.ndarray, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sums of products, one row of the matrix a row."""
        total = np.zeros((size, size), object if wide else np.int64)
        for batch in batches:
            for _, numbers in _matrices(batch, 0):
                for i in range(0, len(numbers), 4096):
                    total += products(whole(numbers[i : i + 4096], scale, offset) - middle)
        kind = pa.list_(pa.string() if wide else pa.int64())
        rows = [[str(v) for v in r] for r in total] if wide else total.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(rows, kind)], ["at", "row"])

    return run


def _added(wide: bool):
    def run(rows: pa.Table) -> pa.Table:
        """One row of the matrix, over all tasks."""
        found = rows.column("row").to_pylist()
        total = [str(sum(map(int, column))) for column in zip(*found)] if wide else np.array(found, np.int64).sum(0).tolist()
        return pa.table({"at": rows.column("at").slice(0, 1), "row": pa.array([total], pa.list_(pa.string() if wide else pa.int64()))})

    return run


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the reflections of a symmetric matrix, by Householder."""
    a, reflections = matrix.astype(float).copy(), []
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        scale = np.abs(x[1:]).max(initial=0.0)
        if scale == 0.0:
            reflections.append(np.zeros(n - k - 1))
            continue
        v = x / max(scale, abs(x[0]))
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        reflections.append(v)
        block = a[k + 1 :, k + 1 :]
        p = 2.0 * (block @ v)
        w = p - (v @ p) * v
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2.0 * v * (v @ x)
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def below(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each point: the negative pivots of the shifted matrix (Sturm)."""
    tiny = np.finfo(float).tiny * 4 + np.finfo(float).eps * np.abs(off).max(initial=0.0) * 1e-3
    q = diagonal[0] - points
    count = (q < 0).astype(int)
    for d, e in zip(diagonal[1:], off):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d - points - e * e / q
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, bisected until no float lies between the bounds or 200 halvings are done."""
    radius = np.abs(np.append(off, 0.0)) + np.abs(np.insert(off, 0, 0.0))
    low, high = np.full(k, (diagonal - radius).min()), np.full(k, (diagonal + radius).max())
    slack = np.finfo(float).eps * max(np.abs(low).max(), np.abs(high).max(), np.finfo(float).tiny) * len(diagonal)
    low, high, wanted = low - slack, high + slack, len(diagonal) - np.arange(k)
    for _ in range(200):
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            break
        # The k-th largest lies below a point that has all but k - 1 values below it.
        under = below(diagonal, off, middle) >= wanted
        high, low = np.where(under, middle, high), np.where(under, low, middle)
    return low + (high - low) / 2


def solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """The solution of (T - shift) x = right, by elimination with row exchanges."""
    n = len(diagonal)
    d, up, up2, x = diagonal - shift, np.append(off, 0.0), np.zeros(n), right.copy()
    for i in range(n - 1):
        low = off[i]
        if abs(d[i]) < abs(low):  # the next row has the larger pivot
            factor = d[i] / low
            d[i], up[i], up2[i], d[i + 1], up[i + 1] = low, d[i + 1], up[i + 1], up[i] - factor * d[i + 1], -factor * up[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            factor = low / (d[i] if abs(d[i]) > tiny else np.copysign(tiny, d[i]))
            d[i + 1] -= factor * up[i]
            x[i + 1] -= factor * x[i]
    for i in range(n - 1, -1, -1):
        x[i] -= (up[i] * x[i + 1] if i + 1 < n else 0.0) + (up2[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] /= d[i] if abs(d[i]) > tiny else np.copysign(tiny, d[i])
        if abs(x[i]) > 1e100:
            x /= abs(x[i])
    return x / np.linalg.norm(x)


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """An eigenvector of the tridiagonal matrix for each value (falling), by inverse iteration; those of a cluster are made orthogonal in every step."""
    norm = max(np.abs(diagonal).max(initial=0.0) + 2 * np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    tiny, rng = np.finfo(float).eps * norm, np.random.default_rng(0)
    found: list[np.ndarray] = []
    cluster = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * norm:
            cluster = i
        # Values of a cluster are held apart a little, so that each solution grows along another vector.
        shift = value - (i - cluster) * 4 * tiny if i > cluster and values[i - 1] - value < 4 * tiny else value
        x = rng.standard_normal(len(diagonal))
        for _ in range(6):
            x = solve(diagonal, off, shift, x / np.linalg.norm(x), tiny)
            for _ in range(2):
                for other in found[cluster:i]:
                    x -= (other @ x) * other
            x /= np.linalg.norm(x)
        found.append(x)
    return np.array(found)


def eigen(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows, the largest entry positive."""
    k = min(k, len(matrix))
    if len(matrix) == 1 or not matrix.any():
        return matrix[0, 0].astype(float).repeat(k), np.eye(k, len(matrix))
    diagonal, off, reflections = tridiagonal(matrix)
    values = leading_values(diagonal, off, k)
    vectors = leading_vectors(diagonal, off, values)
    for i in range(len(reflections) - 1, -1, -1):
        v = reflections[i]
        vectors[:, i + 1 :] -= 2.0 * np.outer(vectors[:, i + 1 :] @ v, v)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    largest = vectors[np.arange(k), np.abs(vectors).argmax(1)]
    return values, vectors * np.sign(largest)[:, None]


@dataclass(frozen=True)
class Whitener:
    """What was fitted: numbers of each dimension, and of each component its vector and eigenvalue."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    scale: int
    offset: int

    @property
    def middle(self) -> np.ndarray:
        """The means, rounded down."""
        return np.array([s // self.n for s in self.sums], np.int64)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over the dimensions of (n x - S)^2, exactly."""
        rest = np.array([s % self.n for s in self.sums])
        y = x - self.middle
        bound = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if bound * bound * x.shape[1] < 1 << 63:
            z = y * self.n - rest.astype(np.int64)
        else:
            z = y.astype(object) * self.n - rest.astype(object)
        return (z * z).sum(1).tolist()

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Every vector's projections on the components, of variance 1."""
        rest = np.array([s % self.n / self.n for s in self.sums])
        return ((x - self.middle) - rest) @ (self.vectors / np.sqrt(self.values)[:, None]).T


def fit(rows: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, max_dims: int = 4096, flat: float = 1e-12) -> tuple[Whitener | None, int]:
    """The whitener of column v of rows, and the length of vectors that it takes."""
    parts = rows.select("v").mapInArrow(_sums(scale, offset), "size int, at int, n long, s decimal(38, 0), least long, most long")
    by_size = parts.groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("least").alias("least"), F.max("most").alias("most"))
    sizes = by_size.filter("at = 0").orderBy(F.desc("n"), F.desc("size")).first()
    if sizes is None:
        return None, 0
    size, n = sizes["size"], sizes["n"]
    if size > max_dims:
        raise ValueError(f"vectors of {size} components; max_dims is {max_dims}")
    found = sorted(by_size.filter(F.col("size") == size).collect())  # one row a dimension
    sums = [int(r["s"]) for r in found]
    middle = np.array([s // n for s in sums], np.int64)
    reach = max(max(r["most"] - m, m - r["least"]) for r, m in zip(found, middle.tolist()))
    wide = reach * reach * n >= 1 << 62
    kind = "at int, row array<" + ("string>" if wide else "bigint>")
    partial = rows.filter(F.size("v") == size).select("v").mapInArrow(_gram(size, scale, offset, middle, wide), kind)
    matrix = {r["at"]: [int(v) for v in r["row"]] for r in partial.groupBy("at").applyInArrow(_added(wide), kind).toLocalIterator()}
    # The means of what is left after the rounded ones: exact, in units of 1 / n.
    rest = [s - n * m for s, m in zip(sums, middle.tolist())]
    covariance = np.array([[(n * matrix[i][j] - rest[i] * rest[j]) / (n * n) for j in range(size)] for i in range(size)])
    values, vectors = eigen(covariance, components)
    kept = values > flat * max(values[0], 0.0)
    return Whitener(n, sums, covariance, values[kept], vectors[kept], scale, offset), size


def _moments(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sums of what is whitened and of its products."""
        model, k = shared.value, len(shared.value.values)
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, numbers in _matrices(batch, 0):
                w = model.whitened(whole(numbers, model.scale, model.offset))
                first += w.sum(0)
                second += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), k).astype(np.int32)), pa.array(np.tile(np.arange(k), k).astype(np.int32)), pa.array(np.repeat(first, k)), pa.array(second.ravel())], ["i", "j", "first", "second"])

    return run


def _projected(shared, size: int, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k, trace = len(model.values), float(np.trace(model.covariance))
        for batch in batches:
            for rows, numbers in _matrices(batch, 1):
                for i in range(0, len(rows) if k else 0, 4096):
                    x = whole(numbers[i : i + 4096], model.scale, model.offset)
                    m = len(x)
                    ids = batch.column(0).take(pa.array(np.repeat(rows[i : i + 4096], k)))
                    deviations = [Decimal(d) for d in model.deviations(x) for _ in range(k)]
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(np.tile(np.arange(1, k + 1), m).astype(np.int32)), pa.array(np.full(m * k, model.n, np.int64)), pa.array(deviations, pa.decimal128(38, 0)), pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.values / trace, m)), pa.array(np.full(m * k, error))],
                        ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return run


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, max_dims: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error of every usable vector and component."""
    rows = vectors.select(column(vectors, id_col).alias("id"), usable(column(vectors, vector_col)).alias("v")).filter("v is not null")
    spark = rows.sparkSession
    schema = StructType([StructField("id", rows.schema["id"].dataType), *StructType.fromDDL("component int, n long, deviation decimal(38, 0), whitened double, explained double, identity_error double").fields])
    model, size = fit(rows, components, scale, offset, max_dims)
    if model is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    # The driver alone keeps the matrix; tasks get a few numbers a dimension.
    shared = spark.sparkContext.broadcast(model)
    rows = rows.filter(F.size("v") == size)
    moments = rows.select("v").mapInArrow(_moments(shared), "i int, j int, first double, second double").groupBy("i", "j").agg(F.sum("first").alias("first"), F.sum("second").alias("second")).collect()  # k * k rows
    means = {r["i"]: r["first"] / model.n for r in moments}
    error = max((abs(r["second"] / model.n - means[r["i"]] * means[r["j"]] - (r["i"] == r["j"])) for r in moments), default=0.0)
    return rows.mapInArrow(_projected(shared, size, error), schema).withColumnRenamed("id", id_col)
