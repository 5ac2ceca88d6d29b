"""Centroid clustering by ball-tree filtering, in exact integers.

Vectors become whole numbers. Each partition cuts its vectors into blocks and builds a metric tree
over each: a ball has an integer pivot, a radius, and the count and integer sum of its points; a ball
is split by the nearer of two far points until it holds few points or equal ones. The trees are
written once. A round sends the centroids (a few integers) to the tasks: from the roots down, a
centroid stays a candidate of a ball only while pivot distance less radius is within the least
pivot distance plus radius; a ball with one candidate is assigned whole, by its count and sum, any other
descends; leaves compare exact squared distances of their points, ties to the smaller number. A task
hands on one count and sum a centroid, Spark adds them up, and the driver divides: it sees centroids
alone, whatever the input.

Equal vectors, be they a third of all, are balls of radius 0: one comparison a block. No rows are
exchanged at all; a lost executor costs its tasks, since trees are a written table.

Defined cases: null embeddings, other lengths, null or non-finite entries are left out; a null
vec_id hashes as the empty text; of start vectors with equal hashes (repeated ids) the smaller
vector comes first; fewer vectors than centroids make fewer centroids; equal centroids leave the
later one empty, and empty ones stay; an empty table gives no rows; other columns are ignored. Components
beyond 2^27 count as 2^27 in size, so that squared distances fit a long; sums of distances beyond a long
are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, quiet, written
from .vectors import integral, matrix

#: Vectors of one tree, and points that a ball is not split below.
BLOCK, LEAF = 1024, 24
#: Largest size of a component.
MOST = 1 << 27
#: Sizes up to which sums of 64 products are exact in doubles.
EXACT = 1 << 22
#: Relative slack of distances computed as roots of exact squares.
SLACK = 1e-9
TREE = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), ("nodes", pa.binary()), ("radii", pa.binary()), ("pivots", pa.binary()), ("sums", pa.binary())])


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a from all rows of b."""
    kind = np.float64 if max(abs(a).max(initial=0), abs(b).max(initial=0)) <= EXACT else np.int64
    p, q = a.astype(kind), b.astype(kind)
    return ((p * p).sum(1)[:, None] - 2 * (p @ q.T) + (q * q).sum(1)[None, :]).astype(np.int64)


class Tree:
    """Balls over one block. Nodes are numbered so that children follow their parent; ``nodes`` holds start,
    end, left, right (-1 at a leaf) of each; points are in tree order, so a ball is a range of them."""

    def __init__(self, order, points, nodes, radii, pivots, sums):
        self.order, self.points, self.nodes, self.radii, self.pivots, self.sums = order, points, nodes, radii, pivots, sums

    @classmethod
    def built(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        order, nodes, radii, pivots, sums = np.arange(len(points)), [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            own = points[order[start:end]]
            total = own.sum(0)
            pivot = total // len(own)
            apart = squares(own, pivot[None])[:, 0]
            at = len(nodes)
            nodes.append([start, end, -1, -1])
            radii.append(np.sqrt(apart.max()) * (1 + SLACK))
            pivots.append(pivot)
            sums.append(total)
            if parent >= 0:
                nodes[parent][2 + side] = at
            if end - start <= leaf or (own == own[0]).all():
                continue
            far = own[apart.argmax()]
            other = own[squares(own, far[None])[:, 0].argmax()]
            near = squares(own, np.stack([far, other]))
            left = near[:, 0] < near[:, 1]  # the far point itself, and never the other
            order[start:end] = np.concatenate([order[start:end][left], order[start:end][~left]])
            middle = start + int(left.sum())
            todo += [(middle, end, at, 1), (start, middle, at, 0)]
        return cls(order, points[order], np.array(nodes, np.int32), np.array(radii), np.array(pivots), np.array(sums))

    def filtered(self, centroids: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
        """Whole balls as (nodes, their centroids) by level, then positions, centroids and squared distances
        of the points that exact leaves assigned."""
        k = len(centroids)
        distinct = np.array([not any((centroids[i] == c).all() for i in range(n)) for n, c in enumerate(centroids)])
        ball, may = np.array([0]), np.tile(distinct, (1, 1))
        wholes, spots, masks = [], [], []
        while len(ball):
            apart = np.sqrt(squares(self.pivots[ball], centroids).astype(np.float64))
            radius, slack = self.radii[ball][:, None], SLACK * apart.max(1, keepdims=True) + 1e-6
            most = np.where(may, apart + radius, np.inf).min(1, keepdims=True)
            may = may & (apart - radius <= most + slack)
            one = may.sum(1) == 1
            wholes.append((ball[one], may[one].argmax(1)))
            ball, may = ball[~one], may[~one]
            is_leaf = self.nodes[ball, 2] < 0
            for b, m in zip(self.nodes[ball[is_leaf]], may[is_leaf]):
                spots.append(np.arange(b[0], b[1]))
                masks.append(np.broadcast_to(m, (b[1] - b[0], k)))
            ball, may = ball[~is_leaf], may[~is_leaf]
            ball, may = np.concatenate([self.nodes[ball, 2], self.nodes[ball, 3]]), np.concatenate([may, may])
        if not spots:
            nothing = np.zeros(0, np.int64)
            return wholes, nothing, nothing, nothing
        spot, mask = np.concatenate(spots), np.concatenate(masks)
        apart = np.where(mask, squares(self.points[spot], centroids), np.iinfo(np.int64).max)
        nearest = apart.argmin(1)
        return wholes, spot, nearest, apart[np.arange(len(spot)), nearest]

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Count and sum of the points of each centroid; how many points were compared one by one."""
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        wholes, spot, nearest, _ = self.filtered(centroids)
        for balls, to in wholes:
            np.add.at(counts, to, self.nodes[balls, 1] - self.nodes[balls, 0])
            np.add.at(sums, to, self.sums[balls])
        np.add.at(counts, nearest, 1)
        np.add.at(sums, nearest, self.points[spot])
        return counts, sums, len(spot)

    def labels(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and exact squared distance of every point, in tree order."""
        label, apart = np.zeros(len(self.points), np.int64), np.zeros(len(self.points), np.int64)
        wholes, spot, nearest, near = self.filtered(centroids)
        for balls, to in wholes:
            for b, c in zip(self.nodes[balls], to):
                label[b[0] : b[1]] = c
                apart[b[0] : b[1]] = squares(self.points[b[0] : b[1]], centroids[c][None])[:, 0]
        label[spot], apart[spot] = nearest, near
        return label, apart


def stored(ids: list, tree: Tree) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"ids": [[ids[k] for k in tree.order]], "points": [tree.points.astype("<i4").tobytes()], "nodes": [tree.nodes.astype("<i4").tobytes()], "radii": [tree.radii.astype("<f8").tobytes()], "pivots": [tree.pivots.astype("<i4").tobytes()], "sums": [tree.sums.astype("<i8").tobytes()]}, schema=TREE
    )


def loaded(row: dict, dims: int) -> Tree:
    read = lambda name, kind, *shape: np.frombuffer(row[name], kind).astype(kind[1:] if kind == "<f8" else np.int64).reshape(*shape)
    return Tree(None, read("points", "<i4", -1, dims), read("nodes", "<i4", -1, 4), read("radii", "<f8", -1), read("pivots", "<i4", -1, dims), read("sums", "<i8", -1, dims))


def trees(points: DataFrame, dims: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """One row a tree (``TREE``), over blocks of each partition."""

    @quiet
    def run(batches: Iterator[pa.RecordBatch]):
        ids, held = [], []

        def made():
            tree = Tree.built(np.concatenate(held), leaf)
            out = stored(ids, tree)
            ids.clear()
            held.clear()
            return out

        for batch in batches:
            docs, rows = batch.column(0).to_pylist(), np.clip(matrix(batch.column(1), dims), -MOST, MOST)
            at = 0
            while at < len(docs):
                some = min(block - len(ids), len(docs) - at)
                ids += docs[at : at + some]
                held.append(rows[at : at + some])
                at += some
                if len(ids) == block:
                    yield made()
        if ids:
            yield made()

    return points.select("vec_id", "x").mapInArrow(run, "ids array<long>, points binary, nodes binary, radii binary, pivots binary, sums binary")


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of each one's mean, empty ones as they are."""
    k, dims = centroids.shape

    @quiet
    def run(batches: Iterator[pa.RecordBatch]):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                c, s, _ = loaded(row, dims).totals(centroids)
                counts += c
                sums += s
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(full, pa.int32()), "n": pa.array(counts[full], pa.int64()), "s": pa.array(sums[full].tolist(), pa.list_(pa.int64()))})

    parts = forest.drop("ids").mapInArrow(run, "cluster int, n long, s array<long>")
    # decimals, so that no sum is too large; k rows come back
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i].cast("decimal(38,0)")) for i in range(dims)]).alias("s")).collect()
    after = centroids.copy()
    for r in total:
        after[r.cluster] = [int(s) // r.n for s in r.s]
    return after


def assigned(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    dims = centroids.shape[1]

    @quiet
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                label, apart = loaded(row, dims).labels(centroids)
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array(row["ids"], pa.int64()), "cluster": pa.array(label, pa.int32()), "distance": pa.array(apart, pa.int64())})

    return forest.mapInArrow(run, "vec_id long, cluster int, distance long")


def starts(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id; k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = points.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    return np.clip(np.array([r.x for r in rows], np.int64), -MOST, MOST)


def cluster(rows: DataFrame, *, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Cluster embeddings (vec_id, embedding) around k centroids.

    Returns vec_id, cluster, distance, cluster_inertia, inertia, centroid (array<long>).
    """
    spark = rows.sparkSession
    points = integral(rows, scale, dims)
    centroids = starts(points, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    forest, path = written(trees(points, dims, block, leaf), "ball-trees")
    for _ in range(rounds):
        centroids = moved(forest, centroids)
    found, _ = written(assigned(forest, centroids), "clusters")
    dropped(spark, path)
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    table = [(c, fits(sums.get(c, 0)), fits(sum(sums.values())), centroids[c].tolist()) for c in range(len(centroids))]
    of = F.broadcast(spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<long>"))  # k rows
    return found.join(of, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: list[int]) -> str:
    """As the query shows a centroid."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
