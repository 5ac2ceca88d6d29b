"""Embedding whitening by merged moments.

Entries become whole numbers x, and each distinct vector counts once. Every partition of the distinct vectors
computes count, local mean and centred scatter, block by block; two such states merge by Chan's formula
(scatters add, plus the outer product of the difference of means times n1 n2 / (n1 + n2)), first within a
partition, then between partitions in a treeReduce. The driver sees one state of the dimension's square; it
takes eigenvectors of the covariance there. A second pass whitens the distinct vectors, merges the moments of the
result in the same way, and reports how far their covariance is from the identity. Sums are also kept as
exact integers, for the exact deviation.

The distinct vectors are one shuffle with partial aggregation, so a vector that many rows share is one row a
task; they are written, and both passes and a lost executor's tasks read that table. Rows are whitened where they
are scanned.

Defined cases: null embeddings, and those with null or non-finite entries, are left out; shorter vectors
count as 0 in the dimensions they lack (an empty one is all 0); floors beyond a long are its bounds; a component
without variance (rank below it, one distinct vector) has whitened 0 and explained 0 and no part in the identity's error; a
deviation beyond a long is null; repeated rows and null ids each get their rows; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quiet, written
from .vectors import integral, matrix

#: Most entries of a vector: the driver holds the square of it.
MOST_DIMS = 4096
#: Share of the trace below which an eigenvalue counts as none.
NONE = 1e-12
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Moments:
    """Count, mean and centred scatter of some vectors."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        mean = rows.mean(0)
        off = rows - mean
        return cls(len(rows), mean, off.T @ off)

    def merged(self, other: Moments) -> Moments:
        """Chan, Golub and LeVeque's pairwise merge."""
        if not self.n or not other.n:
            return self if self.n else other
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))


def merged(a: tuple, b: tuple) -> tuple:
    """Of states (n, exact sums, mean, scatter)."""
    m = unpacked(a).merged(unpacked(b))
    return packed(m, [x + y for x, y in zip(a[1], b[1])])


def packed(m: Moments, sums: list[int]) -> tuple:
    return m.n, sums, m.mean.tobytes(), m.scatter.tobytes()


def unpacked(state: tuple) -> Moments:
    mean = np.frombuffer(bytes(state[2]))
    return Moments(state[0], mean, np.frombuffer(bytes(state[3])).reshape(len(mean), len(mean)))


def moments(fit: DataFrame, dims: int, project: np.ndarray | None = None, centre: np.ndarray | None = None) -> tuple[Moments, list[int]]:
    """Merged moments of x, or of (x - centre) @ project, over all rows of fit, and the exact sums of x."""
    width = dims if project is None else project.shape[1]

    @quiet
    def run(batches: Iterator[pa.RecordBatch]):
        state, sums = Moments(0, np.zeros(width), np.zeros((width, width))), [0] * dims
        for batch in batches:
            x = matrix(batch.column(0), dims)
            if not len(x):
                continue
            high, low = x >> 32, x & 0xFFFFFFFF  # each half's sum fits; a batch has few rows
            sums = [s + (int(h) << 32) + int(l) for s, h, l in zip(sums, high.sum(0), low.sum(0))]
            rows = x.astype(np.float64)
            state = state.merged(Moments.of(rows if project is None else (rows - centre) @ project))
        n, _, mean, scatter = packed(state, sums)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sums": pa.array([[str(s) for s in sums]], pa.list_(pa.string())), "mean": pa.array([mean], pa.binary()), "scatter": pa.array([scatter], pa.binary())})

    parts = fit.select("x").mapInArrow(run, "n long, sums array<string>, mean binary, scatter binary")
    total = parts.rdd.map(lambda r: (r.n, [int(s) for s in r.sums], bytes(r.mean), bytes(r.scatter))).treeReduce(merged)
    return unpacked(total), total[1]


def axes(m: Moments, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors of the covariance as columns, by falling eigenvalue; the eigenvalues; each one's share of the trace."""
    values, vectors = np.linalg.eigh(m.scatter / m.n)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(m.scatter / m.n))
    some = values > NONE * trace if trace > 0 else np.zeros(len(values), bool)
    return vectors[:, :most], np.where(some, values, 0.0)[:most], np.where(some, values / (trace or 1.0), 0.0)[:most]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2. In 64 bits arithmetic is modulo 2^64, so it is exact wherever the result fits."""
    rough = ((n * x.astype(np.float64) - np.array(sums, np.float64)) ** 2).sum(1)
    wrap = np.array([s & (1 << 64) - 1 for s in sums], np.uint64)
    with np.errstate(over="ignore"):
        off = x.astype(np.uint64) * np.uint64(n & (1 << 64) - 1) - wrap
        out = (off * off).sum(1).astype(np.int64).tolist()
    for k in np.flatnonzero(rough > 4e18):
        exact = sum((n * int(v) - s) ** 2 for v, s in zip(x[k], sums))
        out[k] = exact if exact < 1 << 63 else None
    return out


def whiten(rows: DataFrame, *, components: int = 4, scale: int = 256) -> DataFrame:
    """Whiten embeddings (vec_id, embedding): one row a vector and component, columns as in ``RESULT``."""
    spark = rows.sparkSession
    points = integral(rows, scale)
    least, dims = points.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if dims is None:
        return spark.createDataFrame([], RESULT)
    if dims > MOST_DIMS:
        raise ValueError(f"an embedding has {dims} entries, of {MOST_DIMS}")
    if least < dims or not dims:
        dims = max(dims, 1)
        points = points.select("vec_id", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))).alias("x"))
    fit, _ = written(points.select("x").distinct(), "whitening-fit")
    state, sums = moments(fit, dims)
    vectors, values, explained = axes(state, components)
    n, centre = state.n, np.array([s / state.n for s in sums])
    project = vectors / np.sqrt(np.where(values > 0, values, np.inf))
    live = int((values > 0).sum())
    error = 0.0
    if live:
        again, _ = moments(fit, dims, project[:, :live], centre)
        error = float(abs(again.scatter / again.n - np.eye(live)).max())
    width = project.shape[1]

    @quiet
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = matrix(batch.column(1), dims)
            if not len(x):
                continue
            white, deviation = (x - centre) @ project, deviations(x, n, sums)
            times = np.repeat(np.arange(len(x)), width)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column(0).take(pa.array(times)), "component": pa.array(np.tile(np.arange(1, width + 1), len(x)), pa.int32()), "n": pa.array(np.full(len(times), n), pa.int64()),
                    "deviation": pa.array(deviation, pa.int64()).take(pa.array(times)), "whitened": pa.array(white.reshape(-1)), "explained": pa.array(np.tile(explained, len(x))), "identity_error": pa.array(np.full(len(times), error)),
                }
            )

    return points.mapInArrow(run, RESULT)

