"""Registered queries cover all of their input."""

from tidemark import queries
from tidemark.operators import analogs, backtest
from tidemark.sources import bars as source

def test_every_scored_date_is_a_snapshot(spark, sf):
    got = queries.QUERIES["events_created"](spark, sf).select("as_of").distinct().count()
    assert got == queries.scored_rows(spark, sf).select("Date").distinct().count() > 0


def test_portfolio_candidates_on_every_date(spark, sf):
    bars = source.from_trades(spark, sf)
    got = backtest.demo_candidates(spark, bars, source.universe(spark)).select("Date").distinct()
    want = spark.sql("SELECT DISTINCT Date FROM (SELECT Date, lag(Close, 20) OVER (PARTITION BY symbol ORDER BY Date) AS before FROM {b}) WHERE before <> 0", b=bars)
    assert got.count() > 0 and want.exceptAll(got).count() == got.exceptAll(want).count() == 0


def test_more_targets_than_a_block(spark, sf, monkeypatch):
    whole = sorted(queries.QUERIES["analogs_vectors"](spark, sf).collect())
    assert len({r.target_id for r in whole}) > 3
    monkeypatch.setattr(analogs, "BLOCK_TARGETS", 3, raising=False)
    monkeypatch.setattr(analogs, "MOST_TARGETS", 3, raising=False)
    assert sorted(queries.QUERIES["analogs_vectors"](spark, sf).collect()) == whole
