"""Embedding whitening by two-pass covariance and principal components.

Entries become whole numbers on a grid (``floor(scale * c) + shift``). The first pass adds
them exactly, per dimension; the second centres each vector with that mean and adds the
outer products by one matrix product per batch. Each task gives one partial result, and
``treeAggregate`` merges them, so the driver gets one vector and one matrix, whatever the
number of rows. LAPACK's symmetric solver gives the components, which are broadcast, and
every vector is projected in its own task. A third pass adds the outer products of the
whitened vectors: how far their covariance is from the identity is measured, not assumed.

Sums of whole numbers are carried in two halves of 32 bits, so that no task overflows; a
vector is centred as ``(x - m) - f`` with the whole part ``m`` of the mean and the rest ``f``,
so that no digits are lost. Only matrices of dimension times dimension leave a task:
``MOST_DIMENSIONS`` bounds them.

Defined results: rows whose vector is null, empty, or has null, infinite or NaN entries
(or entries of 2^56 and more, which the grid does not hold) are left out of the fit and
of the result, and so are vectors of another length than the most frequent one (of equally
frequent ones the longest). Components whose eigenvalue is within rounding of zero are
not given: at most ``rank`` of them, none for a single vector or an empty table. Rows
that repeat an id are each fitted and returned; null ids are returned. ``deviation`` is
null where it is over a long. Extra columns are kept; those named like a result give way.
Components are numbered by falling eigenvalue; the sign makes the entry of largest size
positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, claim, trim

SCALE, SHIFT = 64, 1_000_000
#: A partial result is a matrix of this many squared doubles at most (128 MB).
MOST_DIMENSIONS = 4096
#: Vectors in one matrix product.
AT_ONCE = 1024
_LOW = (1 << 32) - 1


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives. ``axes`` has a column for each component."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace).tolist()

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n`` of whole numbers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.axes / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of ``(n x - S)^2``, null if no long holds it."""
        if not len(x):
            return []
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        y = x - whole
        most = self.n * (int(np.abs(y).max()) + 1)
        if most * most * x.shape[1] < 1 << 63:
            return ((self.n * y - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        found = ((self.n * y.astype(object) - np.array(rest, object)) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in found]


def usable(vector: str | Column) -> Column:
    """Whether a vector is there, with entries that are all there, finite and on the grid."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) >= float(1 << 56)))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


def _on_grid(batch: pa.RecordBatch, at: int, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """The vectors of a batch as whole numbers, some at a time, and where they begin."""
    entries = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    for k in range(0, len(entries), AT_ONCE):
        yield k, np.floor(entries[k : k + AT_ONCE] * SCALE).astype(np.int64) + SHIFT


def _merged(partial: DataFrame, shape: tuple[int, ...], kind: type) -> tuple[int, np.ndarray]:
    """The sums of ``partial(n, data)``, a row of a task."""

    def read(data: bytes) -> np.ndarray:
        return np.frombuffer(data, kind).reshape(shape)

    def add(a: tuple, row: T.Row) -> tuple:
        return a[0] + row[0], a[1] + read(row[1])

    n, data = partial.rdd.treeAggregate((0, np.zeros(shape, kind)), add, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return n, data


def _task_sums(df: DataFrame, dims: int, shape: tuple[int, ...], kind: type, of) -> DataFrame:
    """One row of a task: its vectors, and the sum of ``of(x)`` over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("whitening", lambda: None)
        n, total = 0, np.zeros(shape, kind)
        for batch in batches:
            for _, x in _on_grid(batch, 0, dims):
                n, total = n + len(x), total + of(x)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "data"])

    return arrow_map(df, run, "n long, data binary")


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.where(usable(vector)).select(F.col(vector).cast("array<double>").alias("v"))


def fit(df: DataFrame, vector: str = "embedding", most: int = 32) -> Whitening | None:
    """The whitening of all usable vectors of the most frequent length; None without any."""
    vectors = _vectors(df, vector)
    lengths = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    dims = lengths.d
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dims} entries: at most {MOST_DIMENSIONS}")
    vectors = vectors.where(F.size("v") == dims)

    def halves(x: np.ndarray) -> np.ndarray:
        return np.stack([(x >> 32).sum(axis=0), (x & _LOW).sum(axis=0)])

    n, sums = _merged(_task_sums(vectors, dims, (2, dims), np.int64, halves), (2, dims), np.int64)
    exact = tuple((int(h) << 32) + int(low) for h, low in sums.T)
    mean = Whitening(n, exact, np.zeros(0), np.zeros((dims, 0)), 0.0)

    def outer(x: np.ndarray) -> np.ndarray:
        c = mean.centred(x)
        return c.T @ c

    total = _merged(_task_sums(vectors, dims, (dims, dims), np.float64, outer), (dims, dims), np.float64)[1]
    covariance = (total + total.T) / (2 * n)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    known = values > max(values[0], 0) * dims * np.finfo(float).eps
    k = min(most, int(known.sum()))
    values, axes = values[:k], axes[:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    return Whitening(n, exact, values, axes, float(np.trace(covariance)))


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    dims, k = model.axes.shape
    if not k:
        return 0.0
    vectors = _vectors(df, vector).where(F.size("v") == dims)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def moments(x: np.ndarray) -> np.ndarray:
        w = sent.value.whitened(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    n, total = _merged(_task_sums(vectors, dims, (k + 1, k), np.float64, moments), (k + 1, k), np.float64)
    mean = total[k] / n
    return float(np.abs(total[:k] / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The usable rows of ``df`` with ``vector`` replaced by ``whitened`` (array of doubles,
    a place for each component) and ``deviation`` (long)."""
    dims = len(model.sums)
    df = df.where(usable(vector) & (F.size(vector) == dims)).withColumn(vector, F.col(vector).cast("array<double>")).drop(*({"whitened", "deviation"} - {vector}))
    at = df.columns.index(vector)
    fields = list(df.schema.fields)
    fields[at : at + 1] = [T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())]
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("whitening", lambda: None)
        for batch in batches:
            for k, x in _on_grid(batch, at, dims):
                part, w = batch.slice(k, len(x)), sent.value.whitened(x)
                arrays, names = list(part.columns), list(part.schema.names)
                places = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
                arrays[at : at + 1] = [pa.ListArray.from_arrays(places, pa.array(w.ravel())), pa.array(sent.value.deviation(x), pa.int64())]
                names[at : at + 1] = ["whitened", "deviation"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        trim()

    return arrow_map(df, run, T.StructType(fields))
