"""Nearest vectors, block against block."""

import math

import numpy as np
import pytest

from tidemark import queries
from tidemark.operators import analogs, neighbours


def joined(plan) -> list[int]:
    """Rows that each join of an executed plan made."""
    while (name := plan.nodeName()).startswith("AdaptiveSparkPlan") or name.endswith("QueryStage"):
        plan = plan.executedPlan() if name.startswith("AdaptiveSparkPlan") else plan.plan()
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in name or name == "CartesianProduct" else []
    return own + [n for i in range(plan.children().size()) for n in joined(plan.children().apply(i))]


def brute(rows: list[tuple], k: int) -> list[tuple]:
    near: dict[int, list] = {}
    for t, a in rows:
        for v, b in rows:
            if t % 20 or v == t:
                continue
            d = None
            if a is not None and b is not None and len(a) == len(b) and None not in a + b:
                d = 0.0
                for x, y in zip(a, b):
                    d += (x - y) * (x - y)
                d = math.sqrt(d)
            kind = 2 if d is None else 1 if math.isnan(d) else 0
            near.setdefault(t, []).append((kind, d if kind == 0 else 0.0, v))
    return [(t, v, (d, "NaN", None)[kind], n + 1) for t in sorted(near) for n, (kind, d, v) in enumerate(sorted(near[t])[:k])]


def nearest(spark, rows: list[tuple], k: int = 5) -> list[tuple]:
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = analogs.nearest_vectors(df, df.filter("vec_id % 20 = 0"), k).collect()
    return sorted(((r.target_id, r.vec_id, "NaN" if r.distance is not None and math.isnan(r.distance) else r.distance, r.rk) for r in got), key=lambda x: (x[0], x[3]))


def test_blocks_are_joined_and_not_pairs(spark, sf):
    df = queries.QUERIES["analogs_vectors"](spark, sf)
    assert len(df.collect()) == 125
    made = joined(df._jdf.queryExecution().executedPlan())
    assert made and max(made) <= 64  # of 12,475 pairs


def test_null_distances_come_last(spark):
    rows = [(0, [0.0, 0.0]), (1, None), (2, [3.0, 4.0]), (3, [1.0, None]), (4, [1.0, 0.0]), (20, None)]
    assert [r for r in nearest(spark, rows) if r[0] == 0] == [(0, 4, 1.0, 1), (0, 2, 5.0, 2), (0, 1, None, 3), (0, 3, None, 4), (0, 20, None, 5)]
    assert [r[1:] for r in nearest(spark, rows) if r[0] == 20] == [(0, None, 1), (1, None, 2), (2, None, 3), (3, None, 4), (4, None, 5)]


@pytest.mark.parametrize("small", [False, True])
def test_odd_vectors(spark, monkeypatch, small):
    rng = np.random.default_rng(3)
    vector = lambda d=6, off=0.0: [float(np.float32(x)) for x in rng.normal(size=d) + off]
    inf, nan = float("inf"), float("nan")
    same = vector()
    odd = [lambda: None, lambda: [], lambda: vector(5), lambda: [nan, *vector(5)], lambda: [inf, *vector(5)], lambda: [-inf, inf, *vector(4)], lambda: [None, *vector(5)], lambda: same, lambda: vector(6, 1e6), lambda: [x * 1e30 for x in vector()]]
    rows = [(int(i), (odd[int(rng.integers(len(odd)))] if rng.random() < 0.5 else vector)()) for i in rng.integers(-60, 300, 400)]  # ids recur
    rows = [(i, x if x is None else [y if y is None else float(np.float32(y)) for y in x]) for i, x in rows]
    if small:
        for name in ("BLOCK", "PACKED", "SLICE"):
            monkeypatch.setattr(neighbours, name, 40)
        monkeypatch.setattr(analogs, "BLOCK_TARGETS", 7)
    assert nearest(spark, rows) == brute(rows, 5)


def test_products_leave_nothing_out():
    """Small distances far from the origin and from each other: single precision alone would not tell them apart."""
    rng = np.random.default_rng(4)
    points = (1000 + rng.normal(size=(3000, 16)) * 1e-2 + 50 * rng.integers(0, 2, (3000, 1))).astype("<f4")
    ids, t = np.arange(3000), np.arange(0, 3000, 20)
    targets = neighbours.Targets(t, points[t], 4)
    for some in np.array_split(ids, 7):
        targets.meet(points[some], np.ones(len(some), np.int64), some)
    apart = np.sqrt(np.cumsum((points[t, None].astype(float) - points[None].astype(float)) ** 2, axis=2)[:, :, -1])
    apart[np.arange(len(t)), t] = np.inf
    want = np.array([np.lexsort((ids, row))[:4] for row in apart])
    assert (targets.near == want).all() and (targets.dist == np.take_along_axis(apart, want, 1)).all()
