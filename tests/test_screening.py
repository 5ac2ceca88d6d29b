"""Mutual information by neighbours, the screen, and permutation importance, against brute force."""

import math

import numpy as np
import pytest

from tidemark.operators import importance, screening, trees


def frame(spark, x, c, parts=5):
    names = [f"x{k}" for k in range(x.shape[1])]
    df = spark.createDataFrame([(None if t is None else int(t), *map(float, r)) for t, r in zip(c, x)], "y int, " + ", ".join(f"{n} double" for n in names))
    return df.repartition(parts), names


def brute(x, c, k=3):
    """Ross's estimator, row by row."""
    keep = [i for i, t in enumerate(c) if t is not None and sum(u == t for u in c) > 1]
    x, c = x[keep], [c[i] for i in keep]
    total = 0.0
    for i, v in enumerate(x):
        own = sorted(abs(x[j] - v) for j in range(len(x)) if c[j] == c[i] and j != i)
        kk = min(k, len(own))
        d = own[kk - 1]
        m = sum((abs(u - v) < d) if d > 0 else u == v for u in x)
        total += screening.psi(kk) - screening.psi(len(own) + 1) - screening.psi(m)
    return max(0.0, screening.psi(len(x)) + total / len(x))


@pytest.mark.parametrize("rows_", [10**9, 20])
def test_mutual_information(spark, monkeypatch, rows_):
    """In one bucket and in many; continuous, on a grid with ties, one hot value, and independent."""
    monkeypatch.setattr(screening, "BUCKET_ROWS", rows_)
    rnd = np.random.default_rng(4)
    c = [int(t) for t in rnd.integers(0, 3, 240)]
    x = np.stack([rnd.normal(size=240) + np.array(c), rnd.integers(0, 12, 240) + np.array(c) * 2.0, np.where(rnd.random(240) < 0.4, 1.5, rnd.normal(size=240)), rnd.normal(size=240), np.zeros(240)], 1)
    c[5], c[9] = 7, None  # a class of one row, and none
    df, names = frame(spark, x, c)
    got = {r.feature: r.mutual_information for r in screening.mutual_information(df, names, "y").collect()}
    for k, n in enumerate(names):
        assert abs(got[n] - brute(x[:, k], c)) < 1e-6, n


def test_digamma():
    assert abs(screening.psi(1) + 0.5772156649015329) < 1e-12 and abs(screening.psi(11) - (sum(1 / k for k in range(1, 11)) - 0.5772156649015329)) < 1e-12


def test_screen(spark):
    rnd = np.random.default_rng(1)
    y = rnd.integers(0, 2, 300)
    x = np.stack([y + 0.3 * rnd.normal(size=300), y + 0.8 * rnd.normal(size=300), rnd.normal(size=300), np.ones(300), np.where(rnd.random(300) < 0.6, np.nan, 1.0)], 1)
    x = np.concatenate([x, x[:, :1] * 2 + 1e-6 * rnd.normal(size=(300, 1))], 1)
    x[3, 0] = np.inf
    df, names = frame(spark, x, list(y))
    got = {r.feature: r for r in screening.screened(df, names, "y", most=2).collect()}
    assert got["x3"].reason == "variance" and got["x4"].reason == "missingness"
    twin = [got["x0"], got["x5"]]
    assert sorted(r.status for r in twin) == ["rejected", "selected"] and {r.reason for r in twin} == {"", "correlated_with_higher_ranked_feature"}
    assert got["x1"].status == "selected" and got["x2"].reason == "max_selected_features_reached"
    one = screening.screened(df.filter("y = 1"), names, "y").collect()
    assert {r.reason for r in one} <= {"mutual_information_score_unavailable", "variance", "missingness"}


@pytest.mark.parametrize("rows_", [10**9, 40])
def test_permutation_importance(spark, monkeypatch, rows_):
    monkeypatch.setattr(importance, "BUCKET_ROWS", rows_)
    rnd = np.random.default_rng(3)
    n = 300
    x = rnd.normal(size=(n, 3))
    y = (x[:, 0] > 0).astype(float)
    df = spark.createDataFrame([(int(k % 2), k, float(t), *map(float, r)) for k, (t, r) in enumerate(zip(y, x))], "unit int, id long, y double, a double, b double, c double").repartition(3)
    rows = trees.binned(df, ["a", "b", "c"], trees.cut_points(df, ["a", "b", "c"], 16), ["unit", "id", "y"]).persist()
    models = trees.boosted(rows, 3, 18, trees.Boosting(trees=3, leaves=4, least=5))
    moved = importance.permuted(rows, ["id"], 3, 11).toPandas().sort_values("id")
    old, new = (np.frombuffer(b"".join(map(bytes, moved[c])), np.uint8).reshape(-1, 3) for c in ("bins", "other"))
    for u in (0, 1):
        mine = (moved.unit == u).to_numpy()
        assert mine.sum() == 150 and (np.sort(old[mine], 0) == np.sort(new[mine], 0)).all() and (old[mine] != new[mine]).mean() > 0.5
    got = {(r.unit, r.feature): r for r in importance.importance(rows, models, ["a", "b", "c"], ["id"], 11).collect()}
    for u in (0, 1):
        mine = (moved.unit == u).to_numpy()
        t = moved.y.to_numpy()[mine]
        base = ((models[u].predicted(old[mine]) - t) ** 2).mean()
        for k, name in enumerate("abc"):
            changed = old[mine].copy()
            changed[:, k] = new[mine][:, k]
            want = ((models[u].predicted(changed) - t) ** 2).mean() - base
            assert math.isclose(got[u, name].delta, want, abs_tol=1e-12) and math.isclose(got[u, name].baseline, base, abs_tol=1e-12)
        assert got[u, "a"].delta > 0.05
    family = {(r.unit, r.family): r for r in importance.by_family(importance.importance(rows, models, ["a", "b", "c"], ["id"]), {"a": "one", "b": "two"}).collect()}
    assert family[0, "one"].top_feature == "a" and family[0, "unknown"].features == 1
