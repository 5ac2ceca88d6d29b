"""Trees against a builder that looks at rows."""

import numpy as np
import pytest

from tidemark.operators import trees
from tidemark.operators.trees import SCALE, Boosting, Randomised, Tree


def data(n=600, p=4, seed=0):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, p))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.5 * rnd.normal(size=n) > 0).astype(float)
    x[rnd.random((n, p)) < 0.05] = np.nan
    return x, y


def table(spark, x, y, unit, parts=4):
    names = [f"x{k}" for k in range(x.shape[1])]
    rows = [(int(u), float(t), *(None if np.isnan(v) else float(v) for v in r)) for u, t, r in zip(unit, y, x)]
    df = spark.createDataFrame(rows, "unit int, y double, " + ", ".join(f"{n} double" for n in names)).repartition(parts)
    cuts = trees.cut_points(df, names, 16)
    return trees.binned(df, names, cuts, ["unit", "y"]), cuts


def split_of(b, g, h, how):
    """Every split tried on the rows themselves."""
    best = None
    whole = g.sum() ** 2 / (h.sum() + how.l2)
    for f in range(b.shape[1]):
        for missing in (True, False):
            if not missing and not (b[:, f] == 0).any():
                continue
            for k in range(0 if missing else 1, 17):
                left = np.where(b[:, f] == 0, missing, b[:, f] <= k)
                if min(left.sum(), (~left).sum()) < how.least or min(h[left].sum(), h[~left].sum()) < trees.LEAST_HESSIAN:
                    continue
                gain = g[left].sum() ** 2 / (h[left].sum() + how.l2) + g[~left].sum() ** 2 / (h[~left].sum() + how.l2) - whole
                if gain > 1e-10 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, k, missing, left)
    return best


def brute(b, y, how):
    """Boosting by rows: best first, one leaf after the other."""
    m = y.mean()
    score = np.full(len(y), np.log(m / (1 - m)) if how.loss == "log_loss" else m)
    out = []
    for _ in range(how.trees):
        g, h = (v / SCALE for v in trees.derivatives(how.loss, y, score))
        tree, rows = Tree(), {0: np.arange(len(y))}
        splits = {0: split_of(b, g, h, how)}
        while len(splits) and any(splits.values()) and len(rows) < how.leaves:
            n = max((k for k in splits if splits[k]), key=lambda k: splits[k][0])
            _, f, k, missing, left = splits.pop(n)
            a, c = tree.split(n, f, k, missing)
            mine = rows.pop(n)
            rows[a], rows[c] = mine[left], mine[~left]
            for child in (a, c):
                splits[child] = split_of(b[rows[child]], g[rows[child]], h[rows[child]], how)
        for n, mine in rows.items():
            tree.value[n] = -how.rate * g[mine].sum() / (h[mine].sum() + how.l2)
            score[mine] += tree.value[n]
        out.append(tree)
    return out


def shape(t, n=0):
    if t.feature[n] < 0:
        return round(t.value[n], 9)
    return t.feature[n], t.bin[n], t.missing[n], shape(t, t.left[n]), shape(t, t.right[n])


@pytest.mark.parametrize("loss", ["log_loss", "squared_error"])
def test_boosting_equals_a_builder_by_rows(spark, loss, monkeypatch):
    monkeypatch.setattr(trees, "EVERY", 2)
    x, y = data()
    unit = np.arange(len(y)) % 2  # two models in the same jobs
    how = Boosting(loss, trees=3, leaves=6, least=20)
    rows, cuts = table(spark, x, y, unit)
    got = trees.boosted(rows, 4, 18, how)
    b = trees.bins_of(x, cuts)
    for u in (0, 1):
        assert [shape(t) for t in got[u].trees] == [shape(t) for t in brute(b[unit == u], y[unit == u], how)]
    again = trees.boosted(table(spark, x, y, unit, 1)[0], 4, 18, how)
    assert [shape(t) for t in again[0].trees] == [shape(t) for t in got[0].trees]


def test_randomised_trees(spark):
    x, y = data(800)
    unit = np.zeros(len(y), int)
    how = Randomised(trees=5, depth=4, least=30)
    rows, cuts = table(spark, x, y, unit)
    got = trees.randomised(rows, 4, 18, how)[0]
    b = trees.bins_of(x, cuts)
    assert len({str(shape(t)) for t in got.trees}) == 5
    for t in got.trees:
        at = t.nodes(b)
        for n in np.unique(at):
            assert (at == n).sum() >= 30 and abs(t.value[n] - y[at == n].mean()) < 1e-6
        parents = {c: n for n in range(len(t.feature)) if t.feature[n] >= 0 for c in (t.left[n], t.right[n])}
        depth = lambda n: 0 if n == 0 else 1 + depth(parents[n])  # noqa: E731, B023
        assert max(depth(n) for n in parents) <= 4
    again = trees.randomised(table(spark, x, y, unit, 2)[0], 4, 18, how)[0]
    assert [shape(t) for t in again.trees] == [shape(t) for t in got.trees]


def test_predictions_and_odd_tables(spark):
    x, y = data(500)
    rows, cuts = table(spark, x, y, np.arange(500) % 2)
    models = trees.boosted(rows, 4, 18, Boosting(trees=4, leaves=5))
    out = trees.predicted(rows.withColumn("unit", rows.unit * 7), models, 4, ["unit", "y"]).toPandas()
    assert out[out.unit == 7].prediction.isna().all() and out[out.unit == 0].prediction.between(0, 1).all()
    want = models[0].predicted(trees.bins_of(x[np.arange(500) % 2 == 0], cuts))
    assert np.allclose(np.sort(out[out.unit == 0].prediction), np.sort(want))
    assert ((out[out.unit == 0].prediction > 0.5) == out[out.unit == 0].y).mean() > 0.7
    assert trees.boosted(rows.limit(0), 4, 18, Boosting()) == {} == trees.randomised(rows.limit(0), 4, 18, Randomised())
    one = trees.boosted(rows.withColumn("y", rows.y * 0 + 1.0), 4, 18, Boosting(trees=1))
    assert all(len(m.trees[0].feature) == 1 for m in one.values())  # one class: no split
