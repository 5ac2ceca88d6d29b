"""The point-in-time join against a nested loop."""

import datetime as dt
import random

import pytest

from tidemark.operators import asof

START = dt.datetime(2024, 1, 1)


def tables(seed, n=150, m=400):
    r = random.Random(seed)
    stamp = lambda: START + dt.timedelta(hours=r.randrange(400))
    key = lambda: r.choice(["hot", "hot", "hot", "a", "b", None])
    day = lambda: (START + dt.timedelta(days=r.randrange(-3, 20))).date()
    decisions = [(k, key(), day(), stamp()) for k in range(n)] + [(n, "none", day(), stamp()), (n + 1, "a", None, stamp()), (n + 2, "a", day(), None)]
    evidence = [(key(), day(), stamp(), float(r.randrange(5))) for _ in range(m)]
    evidence += evidence[:20] + [("a", None, stamp(), 1.0), ("a", day(), None, 1.0), ("b", day(), START - dt.timedelta(days=9), None)]
    return decisions, evidence


def loop(decisions, evidence):
    out = []
    for i, k, s, t in decisions:
        seen = [(es, at, float("-inf") if v is None else v) for ek, es, at, v in evidence if None not in (k, s, t, ek, es, at) and ek == k and es <= s and at <= t]
        if seen:
            es, at, v = max(seen)
            out.append((i, es, at, None if v == float("-inf") else v))
    return sorted(out)


@pytest.mark.parametrize("seed, rows, days", [(1, 10**6, 512), (2, 60, 512), (3, 7, 4), (4, 3, 1)])
def test_equals_a_nested_loop(spark, monkeypatch, seed, rows, days):
    monkeypatch.setattr(asof, "BUCKET_DAYS", days)
    decisions, evidence = tables(seed)
    d = spark.createDataFrame(decisions, "id long, symbol string, session date, decided_at timestamp").repartition(3)
    e = spark.createDataFrame(evidence, "symbol string, session date, retrieved_at timestamp, value double").repartition(3)
    assert sorted(map(tuple, asof.latest(d, e, block_rows=rows).collect())) == loop(decisions, evidence)
    assert asof.latest(d.limit(0), e).count() == asof.latest(d, e.limit(0)).count() == 0
