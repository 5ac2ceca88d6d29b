"""Ball-tree clustering and whitening against brute force."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from tidemark.llm import ball_tree, queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, x int, distance string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, "c", 1, "d") for i, v in rows], SCHEMA).repartition(parts)


def some(n, dims=64, seed=3, centres=5):
    rnd = np.random.default_rng(seed)
    mid = rnd.normal(size=(centres, dims))
    return [(k, [float(x) for x in (mid[k % centres] + 0.3 * rnd.normal(size=dims)).astype(np.float32)]) for k in range(n)]


def lloyd(rows, k=16, rounds=3, dims=64, scale=64):
    """Plain Lloyd steps in Python's integers."""
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)[:k]
    mid = [x for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(mid))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        mid = [[sum(d) // own.count(j) for d in zip(*[x for o, (_, x) in zip(own, kept) if o == j])] if j in own else c for j, c in enumerate(mid)]
    last = [(i, nearest(x)) for i, x in kept]
    inertia = [sum(d for _, (d, c) in last if c == j) for j in range(len(mid))]
    return sorted((-1 if i is None else i, c, d, inertia[c], sum(inertia), mid[c]) for i, (d, c) in last)


def clustered(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in df.collect())


def test_clusters_equal_plain_lloyd(spark):
    rows = some(400)
    hot = rows[7][1]
    rows += [(k, hot) for k in range(1000, 1200)] + [(None, rows[0][1]), (3, rows[3][1]), (3, rows[9][1])]
    odd = [(5000, None), (5001, []), (5002, [1.0] * 63), (5003, [float("nan")] + [0.0] * 63), (5004, [float("inf")] + [0.0] * 63), (5005, [None] + [0.0] * 63)]
    want = lloyd(rows + odd)
    assert clustered(ball_tree.cluster(frame(spark, rows + odd), block=64, leaf=4)) == want
    assert clustered(ball_tree.cluster(frame(spark, rows + odd, 1))) == want


def test_ties_empty_clusters_and_small_tables(spark):
    same = [(k, [0.5] * 64) for k in range(40)]
    assert clustered(ball_tree.cluster(frame(spark, same))) == lloyd(same)  # fifteen centroids stay empty
    grid = [(k, [float((k >> b & 1) - 0.5) for b in range(4)] + [0.0] * 60) for k in range(64)]  # distances tie everywhere
    assert clustered(ball_tree.cluster(frame(spark, grid), block=16, leaf=2)) == lloyd(grid)
    few = some(3)
    assert clustered(ball_tree.cluster(frame(spark, few))) == lloyd(few)
    assert ball_tree.cluster(frame(spark, [])).collect() == []


def test_large_components_stay_exact(spark):
    rows = [(k, [1e5 * random.Random(k * 64 + d).uniform(-1, 1) for d in range(64)]) for k in range(60)]
    assert clustered(ball_tree.cluster(frame(spark, rows), leaf=4)) == lloyd(rows)
    beyond = ball_tree.cluster(frame(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)]), k=1, rounds=0).collect()
    assert sorted(r.distance for r in beyond) == [0, 64 * (2 * ball_tree.MOST) ** 2]


def test_whole_balls_are_assigned_without_their_points():
    rnd = np.random.default_rng(5)
    mid = rnd.integers(-3000, 3000, (4, 8))
    points = np.concatenate([m + rnd.integers(-20, 20, (200, 8)) for m in mid])
    tree = ball_tree.Tree.built(points, leaf=8)
    counts, sums, compared = tree.totals(mid)
    label = ball_tree.squares(points, mid).argmin(1)
    assert compared == 0 and counts.tolist() == [200] * 4
    assert (sums == [points[label == j].sum(0) for j in range(4)]).all()
    for node, radius, pivot, total in zip(tree.nodes, tree.radii, tree.pivots, tree.sums):
        inside = tree.points[node[0] : node[1]]
        assert (np.sqrt(ball_tree.squares(inside, pivot[None])) <= radius).all() and (inside.sum(0) == total).all()


@pytest.mark.parametrize("seed", range(4))
def test_filter_equals_brute_force(seed):
    rnd = np.random.default_rng(seed)
    points = rnd.integers(-6, 6, (300, 3)) if seed % 2 else rnd.integers(-60, 60, (300, 16))
    mid = points[rnd.integers(0, 300, 9)]
    tree = ball_tree.Tree.built(points, leaf=3)
    label, apart = tree.labels(mid)
    far = ball_tree.squares(tree.points, mid)
    assert (label == far.argmin(1)).all() and (apart == far.min(1)).all()


def test_op12_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = [(i, c, d, own, total, hashlib.sha256(",".join(map(str, m)).encode()).hexdigest()) for i, c, d, own, total, m in lloyd([(r.vec_id, r.embedding) for r in df.collect()])]
    got = sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in queries.op12_clustering(spark, sf).collect())
    assert got == want


def test_op12_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = sorted(tuple(r[n] for n in names) for r in queries.op12_clustering(spark, sf).collect())
    assert got == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL['op12_clustering']})").fetchall())


def brute(rows, most=4):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), np.float64)
    n, total = len(fit), [int(s) for s in np.array(sorted({tuple(x) for _, x in kept}), object).sum(0)]
    off = fit - fit.mean(0)
    values, vectors = np.linalg.eigh(off.T @ off / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for at, (i, x) in enumerate(kept):
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, total))
        for c in range(min(most, len(values))):
            out[at, c + 1] = (i, n, deviation, float((np.array(x) - fit.mean(0)) @ vectors[:, c] / np.sqrt(values[c])), values[c] / values.sum())
    return kept, out


def alike(got, rows):
    kept, want = brute(rows)
    assert len(got) == len(want)
    signs = {}
    exact = sorted((i, c, n, d) for (_, c), (i, n, d, *_) in want.items())
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in got) == exact
    whites = {}
    for (_, c), (i, _, d, w, e) in want.items():
        whites[i, c, d] = w, e
    for r in got:
        w, e = whites[r.vec_id, r.component, r.deviation]
        if abs(w) > 1e-3 and r.component not in signs:
            signs[r.component] = np.sign(w) * np.sign(r.whitened)
    for r in got:
        w, e = whites[r.vec_id, r.component, r.deviation]
        assert abs(signs[r.component] * r.whitened - w) < 1e-7 * (1 + abs(w)) and abs(r.explained - e) < 1e-9 and 0 <= r.identity_error < 1e-9


def test_whitening_equals_brute_force(spark):
    rows = some(300, 12)
    rows += [(k, rows[5][1]) for k in range(1000, 1150)]
    odd = [(5000, None), (5003, [float("nan")] + [0.0] * 11), (5004, [float("-inf")] + [0.0] * 11), (5005, [None] + [0.0] * 11)]
    alike(whitening.whiten(frame(spark, rows + odd)).collect(), rows + odd)
    alike(whitening.whiten(frame(spark, rows + odd, 7)).collect(), rows + odd)


def test_merging_equals_one_pass():
    rnd = np.random.default_rng(2)
    x = rnd.normal(1e6, 1, (500, 6))
    parts = [whitening.Moments.of(p) for p in np.split(x, [1, 40, 41, 300])]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merged(p)
    off = x - x.mean(0)
    assert whole.n == 500 and np.allclose(whole.mean, x.mean(0), rtol=1e-14) and np.allclose(whole.scatter, off.T @ off, atol=1e-5)
    none = whitening.Moments(0, np.zeros(6), np.zeros((6, 6)))
    assert none.merged(whole) is whole and whole.merged(none) is whole


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []
    one = whitening.whiten(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (None, [0.5, 1.0])])).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, 0.0, 0.0, 0.0)}
    flat = whitening.whiten(frame(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(20)])).collect()  # rank one
    assert {r.whitened for r in flat if r.component > 1} == {0.0} and max(r.identity_error for r in flat) < 1e-9
    short = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0]), (3, []), (4, [0.0, 0.0])])).collect()
    assert len(short) == 8 and {r.n for r in short} == {3}
    assert whitening.whiten(frame(spark, [(3, [])])).count() == 1


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 40, -(1 << 40)], [3, 4]])
    for n in (5, 1 << 22):
        sums = [n * 3, n * 4 - 1]
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
        assert whitening.deviations(x, n, sums) == [e if e < 1 << 63 else None for e in exact]


def test_op13_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    alike(queries.op13_whitening(spark, sf).collect(), rows)
