"""Exact nearest vectors of many targets, block against block.

Vectors and targets are packed into blocks, matrices of a few thousand rows, and every block of the one
meets every block of the other in a Cartesian product of partitions: no row is broadcast or sent to the
driver. A pair of blocks is a matrix product in single precision. Each product comes with a bound of
its own error, so it only tells which pairs cannot be among a target's k nearest so far; the others
are computed in doubles, entry by entry in order, as SQL does, and by these distances and ids the k nearest
are kept. Every pair is compared; nothing is sampled and no index is built.

Vectors with equal entries are one row of a block with up to 2k of their ids: of the ids other than a
target's own, the k smallest are among them, if each id comes k times at most.

Distances by SQL: null where an embedding is null, holds a null or differs in length, and such pairs come last,
by id; NaN where an entry is NaN or both are infinite alike, before nulls; infinite where one entry is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors of a block and its bytes at most; vectors that one task packs; vectors that one task compares with a block of targets, about.
BLOCK, BYTES, PACKED, SLICE = 16384, 4 << 20, 1 << 16, 1 << 20
#: Rows and columns of one matrix product, and the columns at a task's start, when all pairs still pass.
ROWS, COLUMNS, FIRST = 256, 2048, 16
#: Pairs computed in doubles at a time.
EXACT = 8192
#: Kinds of distance in their order; EMPTY is a place not yet taken.
NUMBER, NAN, NULL, EMPTY = range(4)
UNIQUE = pa.schema([("point", pa.binary()), ("ids", pa.list_(pa.int64()))])
FOUND = pa.schema([("target_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())])


def few(ids: np.ndarray, k: int) -> np.ndarray:
    """Of the ids, each k times at most, the 2k smallest."""
    ids = np.sort(ids)
    return ids[np.concatenate([np.ones(min(k, len(ids)), bool), ids[k:] != ids[:-k]])][: 2 * k]


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Rows of each length with their matrix; without one, the rows that are null or hold a null.

    Only what decides on distances is kept of vectors that are not finite: one NaN makes all entries NaN,
    and beside an infinite entry the finite ones are 0."""
    size, flat, void = lists.value_lengths().fill_null(0).to_numpy(), lists.flatten(), lists.is_null().to_numpy(zero_copy_only=False).copy()
    if flat.null_count:
        void[np.repeat(np.arange(len(size)), size)[flat.is_null().to_numpy(zero_copy_only=False)]] = True
        flat = flat.fill_null(0)
    values, starts = flat.to_numpy(zero_copy_only=False), np.cumsum(size) - size
    for dims in np.unique(size[~void]):
        rows = np.flatnonzero(~void & (size == dims))
        found = values[starts[rows][:, None] + np.arange(dims)]
        odd = np.flatnonzero(~np.isfinite(found).all(1))
        found[odd] = np.where(np.isnan(found[odd]).any(1)[:, None], np.nan, np.where(np.isinf(found[odd]), found[odd], 0))
        yield rows, found
    if void.any():
        yield np.flatnonzero(void), None


def grouped(points: pa.Array, ids: pa.Array, k: int) -> pa.RecordBatch:
    """Each different point once (null is one, too), with the ids that ``few`` leaves."""
    got = pa.table({"point": points, "id": ids}).group_by("point", use_threads=False).aggregate([("id", "list")]).combine_chunks()
    point, lists = (got.column(c).chunk(0) if got.num_rows else pa.array([], t) for c, t in (("point", pa.binary()), ("id_list", pa.list_(pa.int64()))))
    if len(long := np.flatnonzero(lists.value_lengths().to_numpy() > 2 * k)):
        kept = dict(zip(long.tolist(), (few(lists[i].values.to_numpy(), k) for i in long.tolist())))
        lists = pa.array([kept.get(i, x) for i, x in enumerate(np.split(lists.flatten().to_numpy(), lists.offsets.to_numpy()[1:-1]))], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([point, lists], schema=UNIQUE)


def unique(k: int) -> Callable:
    """Different vectors of each batch: how many equal ones there are no longer counts after it."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column(0)
            for rows, found in matrices(batch.column(1)):
                points = pa.nulls(len(rows), pa.binary())
                if found is not None:
                    width = found.shape[1] * found.itemsize
                    points = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(found))])
                yield grouped(points, ids.take(pa.array(rows)), k)

    return run


def fitting(block: int, width: int) -> int:
    """Rows of a block, if a row has so many bytes."""
    return max(1, min(block, BYTES // max(1, int(width))))


def packed(k: int, kind: str, block: int) -> Callable:
    """Blocks of the different vectors of a partition; equal ones have met there. In an order that has nothing to do with that of the table."""

    def run(batches: Iterator[pa.RecordBatch]):
        points, ids = [], []
        for batch in batches:
            points.append(batch.column(0).take(pc.list_parent_indices(batch.column(1))))
            ids.append(batch.column(1).flatten())
        if not points:
            return
        got = grouped(pa.concat_arrays(points), pa.concat_arrays(ids), k)
        width = pc.binary_length(got.column(0)).fill_null(-1).to_numpy()
        order = np.random.default_rng(0).permutation(len(width))
        for w in np.unique(width):
            rows = order[width[order] == w]
            for some in np.array_split(rows, -(-len(rows) // fitting(block, w))):
                part = got.take(pa.array(some))
                yield pa.RecordBatch.from_pydict({
                    "dims": pa.array([-1 if w < 0 else w // np.dtype(kind).itemsize], pa.int32()), "points": [b"".join(part.column(0).to_pylist()) if w > 0 else b""],
                    "counts": [part.column(1).value_lengths().to_numpy().astype("<i4").tobytes()], "ids": [part.column(1).flatten().to_numpy().astype("<i8").tobytes()],
                })

    return run


def dealt(block: int) -> Callable:
    """Blocks of targets, each with a number; targets are not put together."""

    def run(batches: Iterator[pa.RecordBatch]):
        number, held = TaskContext.get().partitionId() << 32, list(batches)
        if not held:
            return
        ids, lists = (pa.concat_arrays([batch.column(c) for batch in held]) for c in (0, 1))
        ids = ids.to_numpy()
        for rows, found in matrices(lists):
            width, dims = (0, -1) if found is None else (found.shape[1] * found.itemsize, found.shape[1])
            for some in np.array_split(np.arange(len(rows)), -(-len(rows) // fitting(block, width))):
                points = b"" if found is None else found[some].tobytes()
                yield pa.RecordBatch.from_pydict({"number": [number], "t_dims": pa.array([dims], pa.int32()), "t_points": [points], "t_ids": [ids[rows[some]].astype("<i8").tobytes()]})
                number += 1

    return run


class Targets:
    """A block of targets and the k nearest found so far of each: kind of distance, distance (0 if it is no number), id."""

    def __init__(self, ids: np.ndarray, points: np.ndarray | None, k: int):
        self.ids, self.k, self.seen = ids, k, 0
        self.kind, self.dist, self.near = np.full((len(ids), k), EMPTY, np.int8), np.zeros((len(ids), k)), np.zeros((len(ids), k), np.int64)
        self.dims = -1 if points is None else points.shape[1]
        if points is None:
            return
        self.points = points.astype(np.float64)
        whole = np.isfinite(self.points).all(1)
        self.plain, self.odd, self.nan = np.flatnonzero(whole), np.flatnonzero(~whole & ~np.isnan(self.points).any(1)), np.flatnonzero(np.isnan(self.points).any(1))
        with np.errstate(all="ignore"):
            self.centre = self.points[self.plain].mean(0) if len(self.plain) else np.zeros(self.dims)
            if not np.isfinite(self.centre).all():
                self.centre = np.zeros(self.dims)
            self.left, self.most = None, abs(self.points[self.plain] - self.centre).max(initial=0)

    def meet(self, points: np.ndarray | None, counts: np.ndarray, ids: np.ndarray) -> None:
        """Compare with a block of vectors; counts: how many of the ids are of each."""
        starts = np.cumsum(counts) - counts
        if points is None or points.shape[1] != self.dims:
            return self.same(np.arange(len(self.ids)), NULL, ids)
        if len(self.nan):
            self.same(self.nan, NAN, ids)
        points = points.astype(np.float64)
        nan = np.isnan(points).any(1)
        for v in np.flatnonzero(nan):
            self.same(np.concatenate([self.plain, self.odd]), NAN, ids[starts[v] : starts[v] + counts[v]])
        whole = np.isfinite(points).all(1)
        for t, v in ((self.odd, np.flatnonzero(~nan)), (self.plain, np.flatnonzero(~whole & ~nan))):
            for some in range(0, len(t) * len(v), 8 * EXACT):
                at = np.arange(some, min(some + 8 * EXACT, len(t) * len(v)))
                self.exact(t[at // len(v)], v[at % len(v)], points, starts, counts, ids)
        if len(self.plain) and whole.any():
            self.products(np.flatnonzero(whole), points, starts, counts, ids)

    def products(self, v: np.ndarray, points: np.ndarray, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """The plain targets against the finite vectors v.

        With t and v moved to the centre, d * d <= D * D if and only if t.v - v.v / 2 >= (t.t - D * D) / 2. The product
        holds the left side and, as two more columns, the most that rounding can take from it."""
        size, one = self.dims, np.float32
        with np.errstate(all="ignore"):
            b = points[v] - self.centre
            most = abs(b).max(initial=0)
            if not np.isfinite(most + self.most):  # beyond doubles: nothing can be left out
                for some in range(0, len(self.plain) * len(v), 8 * EXACT):
                    at = np.arange(some, min(some + 8 * EXACT, len(self.plain) * len(v)))
                    self.exact(self.plain[at // len(v)], v[at % len(v)], points, starts, counts, ids)
                return
        slack = (size + 12) * 2.0**-23
        if self.left is None or most > self.most:  # all is scaled to entries of 1 at most
            self.most = max(most, self.most)
            a = np.ldexp(self.points[self.plain] - self.centre, -int(np.frexp(self.most)[1]))
            self.aa = (a * a).sum(1)
            self.left = np.concatenate([a, np.ones((len(a), 1)), slack * np.sqrt(self.aa)[:, None]], 1).astype(one)
        down, left, aa = -int(np.frexp(self.most)[1]), self.left, self.aa
        np.ldexp(b, down, out=b)
        bb = np.einsum("ij,ij->i", b, b)
        right = np.empty((len(b), size + 2), one)
        right[:, :size], right[:, size], right[:, size + 1] = b, (slack - 1) * bb / 2, np.sqrt(bb)
        rest = slack * aa / 2 + size * 1e-30

        def bound(rows: np.ndarray) -> np.ndarray:
            """The least product that may still be among the nearest."""
            t = self.plain[rows]
            with np.errstate(all="ignore"):
                d = np.ldexp(self.dist[t, -1], down)
                least = (aa[rows] - d * d * (1 + slack)) / 2 - rest[rows] - size * np.ldexp(np.float64(1e-300), 2 * down)
                return np.where((self.kind[t, -1] == NUMBER) & ~np.isnan(least), np.nextafter(least.astype(one), one(-np.inf)), one(-np.inf)).astype(one)

        least = bound(np.arange(len(left)))
        out, at = np.empty((ROWS, COLUMNS), one), 0
        while at < len(v):
            step = min(max(FIRST, self.seen), COLUMNS, len(v) - at)
            some, hits, n = right[at : at + step].T, [], 0
            for r in range(0, len(left), ROWS):
                rows = min(ROWS, len(left) - r)
                got = np.matmul(left[r : r + rows], some, out=out[:rows, :step] if step == COLUMNS else None)
                full = np.flatnonzero(got.max(1) >= least[r : r + rows])
                if len(full):
                    hit = np.flatnonzero(got[full] >= least[r + full, None])
                    hits.append((r + full[hit // step], at + hit % step))
                    n += len(hit)
                if hits and (n >= 8 * EXACT or r + ROWS >= len(left)):
                    i, j = (np.concatenate(x) for x in zip(*hits))
                    self.exact(self.plain[i], v[j], points, starts, counts, ids)
                    changed = np.unique(i)
                    least[changed] = bound(changed)
                    hits, n = [], 0
            at += step
            self.seen += step

    def exact(self, t: np.ndarray, v: np.ndarray, points: np.ndarray, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Distances of pairs of finite or infinite vectors in doubles, summed in the order of the entries."""
        dist = np.zeros(len(t))
        with np.errstate(all="ignore"):
            for s in range(0, len(t) if self.dims else 0, EXACT):
                apart = self.points[t[s : s + EXACT]] - points[v[s : s + EXACT]]
                np.multiply(apart, apart, out=apart)
                dist[s : s + EXACT] = np.sqrt(np.cumsum(apart, axis=1, out=apart)[:, -1])
        n = counts[v]
        first = np.repeat(starts[v] - (np.cumsum(n) - n), n)
        self.keep(np.repeat(t, n), np.repeat(dist, n), ids[first + np.arange(len(first))])

    def same(self, t: np.ndarray, kind: int, ids: np.ndarray) -> None:
        """All these targets have the same kind of distance from all these ids, which is no number."""
        ids = few(ids, self.k)
        worst = self.kind[t, -1]
        t = t[(worst > kind) | (worst == kind) & (self.near[t, -1] > ids[0])]
        for s in range(0, len(t), EXACT):
            some = t[s : s + EXACT]
            self.keep(np.repeat(some, len(ids)), np.full(len(some) * len(ids), np.nan), np.tile(ids, len(some)), kind)

    def keep(self, t: np.ndarray, dist: np.ndarray, ids: np.ndarray, kind: int | None = None) -> None:
        """Of these pairs and those kept so far, keep the k nearest of each target, by kind, distance and id."""
        other = self.ids[t] != ids
        t, dist, ids = t[other], dist[other], ids[other]
        if not len(t):
            return
        kinds = np.where(np.isnan(dist), NAN, NUMBER).astype(np.int8) if kind is None else np.full(len(t), kind, np.int8)
        changed, k = np.unique(t), self.k
        all_t = np.concatenate([np.repeat(changed, k), t])
        all_kind, all_id = np.concatenate([self.kind[changed].ravel(), kinds]), np.concatenate([self.near[changed].ravel(), ids])
        all_dist = np.concatenate([self.dist[changed].ravel(), np.where(kinds == NUMBER, dist, 0)])
        order = np.lexsort((all_id, all_dist, all_kind, all_t))
        first = np.searchsorted(all_t[order], changed)
        best = order[first[:, None] + np.arange(k)]
        self.kind[changed], self.dist[changed], self.near[changed] = all_kind[best], all_dist[best], all_id[best]

    def found(self) -> pa.RecordBatch:
        t, place = np.nonzero(self.kind != EMPTY)
        kind, dist = self.kind[t, place], self.dist[t, place]
        dist[kind == NAN] = np.nan
        return pa.RecordBatch.from_arrays([pa.array(self.ids[t]), pa.array(self.near[t, place]), pa.array(dist, mask=kind == NULL)], schema=FOUND)


def compared(k: int, kind: str) -> Callable:
    """The k nearest of each target among the blocks that a task has."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[int, Targets] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                read = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)  # noqa: B023, E731
                shaped = lambda name, n, dims: None if dims < 0 else read(name, kind).reshape(n, dims)  # noqa: B023, E731
                number, ids, counts = batch.column("number")[i].as_py(), read("ids", "<i8"), read("counts", "<i4").astype(np.int64)
                if number not in held:
                    own = read("t_ids", "<i8").copy()
                    held[number] = Targets(own, shaped("t_points", len(own), batch.column("t_dims")[i].as_py()), k)
                held[number].meet(shaped("points", len(counts), batch.column("dims")[i].as_py()), counts, ids)
        for targets in held.values():
            yield targets.found()

    return run


def partial(vectors: DataFrame, targets: DataFrame, k: int, block_targets: int) -> DataFrame:
    """target_id, vec_id, distance: of each slice of the vectors the k nearest of each target, among them its k nearest of all."""
    entry = vectors.schema["embedding"].dataType.elementType
    single = isinstance(entry, T.FloatType) and targets.schema["embedding"].dataType.elementType == entry
    kind, lists = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    plain = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(lists).alias("embedding")).filter("vec_id IS NOT NULL")
    vectors, targets = plain(vectors), plain(targets)
    n, n_targets, cores = vectors.count(), targets.count(), vectors.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n_targets // block_targets))
    slices = max(1, -(-n // SLICE), min(-(-4 * cores // parts), -(-n // BLOCK)))
    different = vectors.mapInArrow(unique(k), "point binary, ids array<long>").repartition(max(cores, -(-n // PACKED)), "point")
    blocks = different.mapInArrow(packed(k, kind, BLOCK), "dims int, points binary, counts binary, ids binary").repartition(slices)
    asking = targets.repartition(parts).mapInArrow(dealt(block_targets), "number long, t_dims int, t_points binary, t_ids binary")
    return blocks.hint("shuffle_replicate_nl").crossJoin(asking).mapInArrow(compared(k, kind), "target_id long, vec_id long, distance double")
