"""Embedding whitening: moments by Welford's updates, merged over partitions, and a symmetric QR eigen-solve.

Each task streams its vectors through rank-one updates of count, mean and centred products. The tasks' moments meet in
rounds of at most FAN, by the update formula for two sets of rows, so no task gathers those of all partitions. The
covariance is then brought to tridiagonal form by Householder reflections and diagonalised by implicitly shifted QR steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hold, trimmed, written

#: Fixed values of the contract: steps of a unit, offset, components.
STEPS, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Moments merged by one task of a round; lengths of vectors whose models are sent to the workers together; rows of an Arrow batch going out.
FAN, LENGTHS, ROWS = 8, 16, 1 << 14
#: Entries are held within this before they become whole numbers, so doubles hold them exactly; eigenvalues below this share of the trace count as zero.
WIDEST, NOTHING = 1 << 52, 1e-13
LONG = (1 << 63) - 1


class Moments:
    """Count, mean and sum of centred outer products of the rows seen, and their exact sum."""

    def __init__(self, d: int, n: int = 0, total: list[int] | None = None, mean: np.ndarray | None = None, products: np.ndarray | None = None):
        self.n, self.total = n, [0] * d if total is None else total
        self.mean = np.zeros(d) if mean is None else mean
        self.products = np.zeros((d, d)) if products is None else products
        self._outer = np.empty((d, d))

    def add(self, x: np.ndarray) -> None:
        """Welford's update by one row: one rank-one update of the products."""
        self.n += 1
        before = x - self.mean
        self.mean += before / self.n
        np.outer(before, x - self.mean, out=self._outer)
        self.products += self._outer

    def add_rows(self, rows: np.ndarray, whole: bool = True) -> None:
        """Rows one by one; their exact sum only if they are whole numbers."""
        for x in rows:
            self.add(x)
        if whole:
            small = np.abs(rows).max(initial=0) * len(rows) < LONG
            exact = rows.astype(np.int64) if small else rows.astype(np.int64).astype(object)
            self.total = [a + int(b) for a, b in zip(self.total, exact.sum(0), strict=True)]

    def merge(self, other: Moments) -> None:
        """The moments of both sets of rows, from their difference of means."""
        if not other.n:
            return
        n = self.n + other.n
        gap = other.mean - self.mean
        self.products += other.products + np.outer(gap, gap) * (self.n * other.n / n)
        self.mean += gap * (other.n / n)
        self.n, self.total = n, [a + b for a, b in zip(self.total, other.total, strict=True)]

    def covariance(self) -> np.ndarray:
        c = self.products / max(1, self.n)
        return (c + c.T) / 2


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with q.T @ a @ q tridiagonal, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            continue
        v = x.copy()
        v[0] += norm if x[0] >= 0 else -norm
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1, k] = a[k, k + 1] = -norm if x[0] >= 0 else norm
        a[k + 2 :, k] = a[k, k + 2 :] = 0
        q[:, k + 1 :] -= np.outer(q[:, k + 1 :] @ v, 2 * v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, by falling value; a vector's largest entry is positive.

    QR steps with Wilkinson's shift chase the bulge through each unreduced block; the rotations of a step are
    applied to the vectors' columns as they come."""
    n = len(a)
    scale = np.abs(a).max(initial=0)
    if n == 0 or scale == 0:
        return np.zeros(n), np.eye(n)
    diagonal, off, q = tridiagonal(a / scale)
    d, e, rows = diagonal.tolist(), off.tolist(), np.ascontiguousarray(q.T)
    eps = np.finfo(float).eps
    end = n - 1
    while end > 0:
        for k in range(end):
            if abs(e[k]) <= eps * (abs(d[k]) + abs(d[k + 1])):
                e[k] = 0.0
        if e[end - 1] == 0:
            end -= 1
            continue
        start = end - 1
        while start and e[start - 1]:
            start -= 1
        half, off = (d[end - 1] - d[end]) / 2, e[end - 1]
        shift = d[end] - off * off / (half + (np.hypot(half, off) if half >= 0 else -np.hypot(half, off)))
        x, z = d[start] - shift, e[start]
        for k in range(start, end):
            r = float(np.hypot(x, z))
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > start:
                e[k - 1] = r
            p, o, t = d[k], e[k], d[k + 1]
            d[k], d[k + 1] = c * c * p + 2 * c * s * o + s * s * t, s * s * p - 2 * c * s * o + c * c * t
            e[k] = c * s * (t - p) + (c * c - s * s) * o
            if k < end - 1:
                z = s * e[k + 1]
                e[k + 1] *= c
                x = e[k]
            top = c * rows[k] + s * rows[k + 1]
            rows[k + 1] = c * rows[k + 1] - s * rows[k]
            rows[k] = top
    values = np.array(d) * scale
    order = np.argsort(-values, kind="stable")
    vectors = rows[order]
    signs = np.sign(vectors[np.arange(n), np.abs(vectors).argmax(1)])
    return values[order], (vectors * signs[:, None]).T


def _finite(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def vectors_of(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, vector as doubles, d): the rows whose vector is neither null nor holds null or non-finite entries."""
    rows = table.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & _finite(F.col("vector"))).withColumn("d", F.size("vector"))


def scaled(column: pa.Array) -> tuple[dict[int, list[int]], np.ndarray, np.ndarray]:
    """Positions by length, and the offsets and entries of all vectors of a batch: floor(64 * entry) + 1000000, held within WIDEST, as doubles."""
    column = column.cast(pa.list_(pa.float64()))
    at = column.offsets.to_numpy()
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(STEPS * column.values.to_numpy(zero_copy_only=False)), -WIDEST, WIDEST) + OFFSET
    by: dict[int, list[int]] = {}
    for i, size in enumerate(np.diff(at).tolist()):
        by.setdefault(size, []).append(i)
    return by, at, x


def rows_of(at: np.ndarray, x: np.ndarray, which: list[int], d: int) -> np.ndarray:
    return x[at[which][:, None] + np.arange(d)] if d else np.zeros((len(which), 0))


_PART = pa.schema([pa.field("d", pa.int32()), pa.field("part", pa.int64()), pa.field("n", pa.int64()), pa.field("total", pa.list_(pa.string())), pa.field("mean", pa.binary()), pa.field("products", pa.binary())])
_PART_DDL = "d int, part bigint, n bigint, total array<string>, mean binary, products binary"


def _row(part: int, d: int, m: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((d, part, m.n, list(map(str, m.total)), m.mean.tobytes(), m.products.tobytes()), _PART, strict=True)], schema=_PART)


def _moments(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, Moments]]:
    for i in range(rows.num_rows):
        d, n, total, mean, products = (rows.column(c)[i].as_py() for c in ("d", "n", "total", "mean", "products"))
        mean = np.frombuffer(mean).copy()
        yield d, Moments(len(mean), n, list(map(int, total)), mean, np.frombuffer(products).reshape(len(mean), len(mean)).copy())


def moments(vectors: DataFrame, of: Callable[[int, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """One row (d, n, total, mean, products) for each length d of vectors_of() rows: the moments of their whole numbers, or of what of(d, rows) makes of them."""

    def streamed(batches):
        hold("whitening")
        held: dict[int, Moments] = {}
        for batch in batches:
            by, at, x = scaled(batch.column(0))
            for d, which in by.items():
                rows = rows_of(at, x, which, d)
                rows = of(d, rows) if of else rows
                held.setdefault(d, Moments(rows.shape[1])).add_rows(rows, not of)
        part = TaskContext.get().partitionId()
        for d, m in held.items():
            yield _row(part, d, m)

    def meet(key, rows):
        found = _moments(rows)
        d, out = next(found)
        for _, m in found:
            out.merge(m)
        return pa.Table.from_batches([_row(key[1].as_py(), d, out)])

    parts = written(vectors.select("vector").mapInArrow(trimmed(streamed), _PART_DDL), "moments")
    while parts.agg(F.max("part")).first()[0]:
        fewer = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        after = written(fewer.groupBy("d", "part").applyInArrow(meet, _PART_DDL), "moments")
        discard(parts)
        parts = after
    return parts


_FIT = pa.schema([_PART.field("d"), _PART.field("n"), _PART.field("total"), pa.field("values", pa.binary()), pa.field("axes", pa.binary()), pa.field("trace", pa.float64())])


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(d, n, total, values, axes, trace) for each length d of vectors_of() rows: axes are at most components rows of d doubles, values their eigenvalues, 0 where rounding alone made them."""

    def solve(batches):
        for batch in batches:
            for d, m in _moments(batch):
                v = m.covariance()
                values, axes = symmetric_eigen(v)
                k, trace = min(components, d), float(np.trace(v))
                values = np.where(values > NOTHING * trace, values, 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((d, m.n, list(map(str, m.total)), values[:k].tobytes(), np.ascontiguousarray(axes.T[:k]).tobytes(), trace), _FIT, strict=True)], schema=_FIT)

    parts = moments(vectors)
    out = written(parts.mapInArrow(trimmed(solve), "d int, n bigint, total array<string>, values binary, axes binary, trace double"), "whitening-models")
    discard(parts)
    return out


class Model:
    """One length's fit: whitened(rows) projects centred rows on the components and divides by their standard deviations."""

    def __init__(self, row):
        self.d, self.n, self.total, self.trace = row.d, row.n, list(map(int, row.total)), row.trace
        self.values = np.frombuffer(bytes(row["values"]))
        self.axes = np.frombuffer(bytes(row.axes)).reshape(len(self.values), self.d)
        self.explained = self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))
        with np.errstate(divide="ignore"):
            self.over = np.where(self.values > 0, 1 / np.sqrt(self.values), 0.0)
        # sums as whole parts and remainders, so that x - S / n keeps every digit
        self.whole = np.array([t // self.n for t in self.total], np.float64)
        self.part = np.array([t % self.n / self.n for t in self.total])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole - self.part) @ self.axes.T * self.over

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2, exact; beyond a long, the largest long."""
        widest = max((abs(t) for t in self.total), default=0) + self.n * int(np.abs(x).max(initial=0))
        if self.d * widest * widest < LONG:
            gap = x.astype(np.int64) * self.n - np.array(self.total, np.int64)
            return (gap * gap).sum(1).tolist()
        gap = x.astype(np.int64).astype(object) * self.n - np.array(self.total, object)
        return [min(LONG, int(v)) for v in (gap * gap).sum(1)] if self.d else [0] * len(x)


def identity_errors(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """For each length the largest absolute entry of the whitened rows' covariance minus the identity, from a pass over all rows; components without variance aside."""
    parts = moments(vectors, lambda d, rows: models[d].whitened(rows))
    out = {}
    for row in parts.toLocalIterator():
        k = len(row.mean) // 8
        gap = np.abs(np.frombuffer(bytes(row.products)).reshape(k, k) / row.n - np.eye(k))
        there = models[row.d].values > 0
        out[row.d] = float(gap[there][:, there].max(initial=0))
    discard(parts)
    return out


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each row of table with a finite vector and each of its components.

    Rows whose vector is null or holds null or non-finite entries go. Vectors of each length are a table of their own with
    n rows, and those of length 0 have no components. Entries become floor(64 * entry) + 1000000, held within 2^52. A
    component without variance (one row, equal rows, fewer rows than dimensions) has whitened 0 and explained 0, and no
    part in identity_error. A deviation beyond a long is the largest long. Repeated rows and rows of one key, or none, each count; other columns play no part."""
    spark = table.sparkSession
    vectors = vectors_of(table, key, vector)
    kind = table.schema[key].dataType.simpleString()
    ddl = f"key {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fits = fitted(vectors, components)
    lengths = [r.d for r in fits.where("d > 0").select("d").orderBy("d").collect()]
    outs = []
    for s in range(0, len(lengths), LENGTHS):  # so many models at a time go to the workers
        some = F.col("d").isin(lengths[s : s + LENGTHS])
        models = {r.d: Model(r) for r in fits.where(some).collect()}
        errors = identity_errors(vectors.where(some), models)

        def expanded(batches, models=models, errors=errors):
            hold("whitening")
            for batch in batches:
                by, at, x = scaled(batch.column(1))
                for d, which in by.items():
                    m = models[d]
                    k = len(m.values)
                    step = max(1, ROWS // k)
                    for t in range(0, len(which), step):
                        cut = which[t : t + step]
                        rows = rows_of(at, x, cut, d)
                        size = len(cut)
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).take(pa.array(np.repeat(cut, k))),
                                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                                pa.array(np.full(size * k, m.n, np.int64)),
                                pa.array(np.repeat(np.array(m.deviation(rows), np.int64), k)),
                                pa.array(m.whitened(rows).ravel()),
                                pa.array(np.tile(m.explained, size)),
                                pa.array(np.full(size * k, errors[d])),
                            ],
                            names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                        )

        outs.append(vectors.where(some).select("key", "vector").mapInArrow(trimmed(expanded), ddl))
    rows = reduce(DataFrame.unionByName, outs) if outs else spark.createDataFrame([], ddl)
    return rows.withColumnRenamed("key", key)
