"""Embedding whitening by principal components of exact integer vectors.

Vectors lie on a lattice: an entry c is floor(scale * c) + offset, so sums, means and distances from the
mean are whole numbers until they are divided. Every distinct vector counts once. The covariance is
summed over the partitions from centred vectors, and only it, as big as the dimension squared, comes to
the driver: Householder reflections make it tridiagonal, Sturm counts bisect the leading eigenvalues,
inverse iteration gives their vectors, orthogonalised anew inside a cluster of close eigenvalues. The
mean and the components are broadcast and every row is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitegauge.session import materialize

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Eigenvalues closer than this share of the largest are a cluster.
CLUSTER = 1e-3
#: Eigenvalues below this share of the trace are rounding: there is nothing to whiten by.
NOUGHT = 1e-13


@dataclass
class Whitening:
    """Number of distinct vectors, their sums, and of each component its eigenvector, eigenvalue and share of the variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean; the whole part is taken off exactly before anything is rounded."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        return (x - whole) - np.array([(s % self.n) / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Of each row, the sum over dimensions of (n*x - S)^2."""
        size = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if size < 2**62:
            away = x * self.n - np.array(self.sums, dtype=np.int64)
            if int(np.abs(away).max(initial=0)) ** 2 * max(x.shape[1], 1) < 2**62:
                return (away * away).sum(axis=1).tolist()
        return [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]


def lattice(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """The vector's entries as whole numbers; null if it is null or holds null, NaN or infinite entries."""
    entries = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + offset)
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return F.when(~F.exists(vector, bad), entries)


def usable(rows: DataFrame, vector: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """The rows with their vector replaced by its lattice vector; rows without one go.

    Where lengths differ, those of the commonest length stay (the longer of equally common ones).
    """
    kept = rows.withColumn(vector, lattice(F.col(vector), scale, offset)).where(F.col(vector).isNotNull())
    lengths = kept.groupBy(F.size(vector).alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).head(2)
    return kept.where(F.size(vector) == lengths[0]["length"]) if len(lengths) > 1 else kept


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


def _sums(distinct: DataFrame) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            part = _matrix(batch).sum(axis=0) if len(batch) else 0
            n, sums = n + len(batch), part if sums is None else sums + part
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([*range(len(sums)), -1], pa.int32()), pa.array([*map(int, sums), n], pa.int64())], ["place", "s"]
            )

    total = distinct.mapInArrow(run, "place int, s long").groupBy("place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    by_place = {r["place"]: int(r["s"]) for r in total.collect()}
    return by_place.pop(-1, 0), [by_place[k] for k in sorted(by_place)]


def _summed_rows(rows: DataFrame, run) -> np.ndarray:
    """Sum of the square matrices that ``run`` makes of each partition, row by row."""

    def add(key: tuple, part: pa.Table) -> pa.Table:
        total = np.sum([v.values.to_numpy() for v in part.column("v")], axis=0)
        return pa.table({"place": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total], pa.list_(pa.float64()))})

    made = rows.mapInArrow(run, "place int, v array<double>")
    got = made.groupBy("place").applyInArrow(add, "place int, v array<double>").toArrow()
    return np.array([got.column("v")[k].values.to_numpy() for k in np.argsort(got.column("place").to_numpy())])


def _products(rows: DataFrame, shared, project: bool) -> np.ndarray:
    """Sum of products of all entries of the centred rows, or of the whitened ones beside a one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch)
            part = np.column_stack([shared.value.project(x), np.ones(len(x))]) if project else shared.value.centred(x)
            total = part.T @ part if total is None else total + part.T @ part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["place", "v"])

    return _summed_rows(rows, run)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors of a symmetric matrix."""
    work, size, reflections = matrix.copy(), len(matrix), []
    for k in range(size - 2):
        v = work[k + 1 :, k].copy()
        # scaled first, so that squares of small entries do not vanish
        scale = np.abs(v).max()
        if scale == 0 or not v[1:].any():
            reflections.append(np.zeros(size - k - 1))
            continue
        v /= scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        rest = work[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        column = work[k + 1 :, k]
        column -= 2 * v * (v @ column)
        work[k, k + 1 :] = column
        reflections.append(v)
    return np.diag(work).copy(), np.diag(work, -1).copy(), reflections


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix are less than each of ``at``."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count = np.zeros(len(at), dtype=np.int64)
    pivot = np.ones(len(at))
    for k, d in enumerate(diagonal):
        pivot = d - at - (off[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, wanted: int) -> np.ndarray:
    """The largest eigenvalues, falling, bisected by Sturm counts until their bounds are neighbours."""
    reach = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    low = np.full(wanted, (diagonal - reach).min())
    high = np.full(wanted, (diagonal + reach).max())
    rank = len(diagonal) - 1 - np.arange(wanted)  # so many eigenvalues lie below the one sought
    for _ in range(200):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        above = below(diagonal, off, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return low + (high - low) / 2


def _solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solution of (T - shift) x = right by elimination with row exchange; a pivot of nought becomes ``least``."""
    size = len(diagonal)
    main, upper, second, x = diagonal - shift, np.append(off, 0.0), np.zeros(size), right.copy()
    lower = off.copy()
    for k in range(size - 1):
        if abs(lower[k]) > abs(main[k]):
            main[k], lower[k] = lower[k], main[k]
            upper[k], main[k + 1] = main[k + 1], upper[k]
            if k + 2 < size:
                second[k], upper[k + 1] = upper[k + 1], 0.0
            x[k], x[k + 1] = x[k + 1], x[k]
        if main[k] == 0:
            main[k] = least
        factor = lower[k] / main[k]
        main[k + 1] -= factor * upper[k]
        upper[k + 1] -= factor * second[k]
        x[k + 1] -= factor * x[k]
    for k in range(size - 1, -1, -1):
        if abs(main[k]) < least:
            main[k] = np.copysign(least, main[k])
        known = (upper[k] * x[k + 1] if k + 1 < size else 0.0) + (second[k] * x[k + 2] if k + 2 < size else 0.0)
        x[k] = (x[k] - known) / main[k]
    return x


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors in columns, by inverse iteration; those of a cluster are made orthogonal in each step."""
    size, norm = len(diagonal), max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0)) or 1.0
    least, rng = np.finfo(float).eps * norm, np.random.default_rng(0)
    found, first = np.zeros((size, len(values))), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        near = found[:, first:k]
        shift = value - (k - first) * 4 * least  # equal eigenvalues get shifts of their own
        v = rng.standard_normal(size)
        for _ in range(5):
            for _ in range(2):
                v = v - near @ (near.T @ v)
            v = _solve_shifted(diagonal, off, shift, v / np.linalg.norm(v), least)
            v /= np.abs(v).max()
        for _ in range(2):
            v = v - near @ (near.T @ v)
        found[:, k] = v / np.linalg.norm(v)
    return found


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors in columns."""
    if not len(matrix) or not wanted:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, reflections = tridiagonal(matrix)
    values = leading_values(diagonal, off, min(wanted, len(matrix)))
    vectors = leading_vectors(diagonal, off, values)
    for k in range(len(reflections) - 1, -1, -1):
        v, part = reflections[k], vectors[k + 1 :]
        part -= 2 * np.outer(v, v @ part)
    return values, vectors


def fit(rows: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening:
    """Components of the distinct lattice vectors in ``vector``, at most ``components`` and none of no variance.

    No rows, or copies of one vector only, give a model without components. ``identity_error`` is the
    largest absolute difference between the covariance of the whitened distinct vectors and the identity.
    """
    context = rows.sparkSession.sparkContext
    distinct = materialize(rows.select(F.col(vector).alias("x")).distinct())
    n, sums = _sums(distinct)
    model = Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), np.zeros(0))
    if n < 2:
        return model
    covariance = _products(distinct, context.broadcast(model), False) / n
    covariance = (covariance + covariance.T) / 2
    trace = float(np.trace(covariance))
    values, vectors = leading(covariance, components)
    real = values > NOUGHT * trace
    model = Whitening(n, sums, vectors[:, real], values[real], values[real] / trace)
    if real.any():
        total = _products(distinct, context.broadcast(model), True) / n
        mean = total[-1, :-1]
        model.identity_error = float(np.abs(total[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max())
    return model


def apply(rows: DataFrame, vector: str, model: Whitening) -> DataFrame:
    """The rows with deviation (decimal, exact) and whitened (an array, one number a component) in place of ``vector``.

    ``vector`` holds lattice vectors of the fitted length. Repeated rows stay repeated, nulls in
    other columns stay, an empty table gives an empty result; clashing names of other columns are the caller's to avoid.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in rows.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch)
            columns = [
                pa.array([Decimal(d) for d in shared.value.deviations(x)], pa.decimal128(38, 0)),
                pa.array(list(shared.value.project(x)), pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], schema.names)

    more = StructType.fromDDL("deviation decimal(38,0), whitened array<double>")
    schema = StructType([*(rows.schema[c] for c in carried), *more.fields])
    return rows.select(*carried, F.col(vector).alias("x")).mapInArrow(run, schema)
