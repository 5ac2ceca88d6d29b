"""The forward log: batch form, stream form and replay."""

import datetime as dt

import pytest

from tidemark import queries
from tidemark.operators import forward
from tidemark.sources import bars as source
from tidemark.streaming import forward as stream

DAY = dt.date(2024, 1, 1)
BARS = "symbol string, Date date, Open double, High double, Low double, Close double, Volume double"
SCANS = "symbol string, as_of date, direction string, model_id string, snapshot string, status string, horizon int, expected_return double, expected_mfe double, expected_mae double"


def day(k):
    return DAY + dt.timedelta(days=k)


def bars(spark, *rows, symbol="A"):
    return spark.createDataFrame([(symbol, day(k), *map(float, r), 1.0) for k, r in enumerate(rows)], BARS)


def scan(k, side="Bullish", horizon=3, er=0.05, mae=-0.05, status="ACTIONABLE", symbol="A", snapshot="s"):
    return (symbol, day(k), side, "m", snapshot, status, horizon, er, 0.0, mae)


def scans(spark, *rows):
    return spark.createDataFrame(list(rows), SCANS)


FLAT = (100, 101, 99, 100)


def kinds(df):
    return sorted((r.as_of, r.event_type) for r in df.collect())


def test_fill_mark_and_time_exit(spark):
    got = forward.log(bars(spark, FLAT, (100, 101, 99, 100.5), FLAT, (100, 102, 99, 101.5), FLAT), scans(spark, scan(0)))
    rows = {(r.event_type, r.as_of): r for r in got.collect()}
    assert rows["ENTRY_FILLED", day(1)].price == 100 and rows["ENTRY_FILLED", day(1)].target_price == 105.0 and rows["STOP_UPDATED", day(1)].price == 95.0
    out = rows["EXIT_FILLED", day(3)]
    assert out.reason == "time_exit" and out.price == 101.5 and abs(out.gross_return - 0.015) < 1e-12 and abs(out.net_return - 0.0145) < 1e-12 and abs(out.mfe - 0.02) < 1e-12 and abs(out.mae + 0.01) < 1e-12
    assert sum(r.event_type == "POSITION_MARKED" for r in got.collect()) == 3


@pytest.mark.parametrize("side, bar, reason, price", [("Bullish", (100, 106, 99, 104), "target", 105.0), ("Bullish", (100, 101, 94, 96), "stop", 95.0), ("Bullish", (100, 107, 90, 99), "stop_intraday_ambiguous", 95.0), ("Bearish", (100, 101, 94, 95), "target", 95.0), ("Bearish", (100, 106, 99, 104), "stop", 105.0)])
def test_policy_exits(spark, side, bar, reason, price):
    b, s = bars(spark, FLAT, bar, FLAT, FLAT), scans(spark, scan(0, side))
    out = [r for r in forward.log(b, s).collect() if r.event_type == "EXIT_FILLED"]
    assert [(r.as_of, r.reason, round(r.price, 9)) for r in out] == [(day(1), reason, price)]


def test_positions_whose_sessions_have_not_come_stay_open(spark):
    b = bars(spark, FLAT, FLAT, FLAT)
    got = forward.log(b, scans(spark, scan(0), scan(2), scan(1, status="REJECTED"), scan(9)))
    assert not [k for k in kinds(got) if k[1] == "EXIT_FILLED"]
    assert (day(9), "SIGNAL_REFUSED") in kinds(got) and (day(1), "SIGNAL_REJECTED") in kinds(got)
    assert sorted((r.signal_date, r.status, r.n_marks) for r in forward.positions(got).collect()) == [(day(0), "ENTRY_FILLED", 2), (day(2), "ENTRY_PENDING", 0)]


def same(a, b):
    key = lambda r: r.unique_key
    return sorted(a.select(*forward.NAMES).collect(), key=key) == sorted(b.select(*forward.NAMES).collect(), key=key)


@pytest.fixture(scope="module")
def table(spark, sf):
    rows = source.from_trades(spark, sf).filter("symbol < 'S3'")
    return rows, forward.signals(queries.scored_rows(spark, sf).filter("symbol < 'S3'"))


def test_stream_equals_the_batch_log(spark, table):
    b, s = table
    want = forward.log(b, s)
    assert want.filter("event_type = 'EXIT_FILLED'").select("reason").distinct().count() >= 3
    got = stream.replayed(b, s, steps=2)
    assert same(got, want) and got.count() == got.select("unique_key").distinct().count()


def test_restart_late_and_backfilled(spark, tmp_path):
    """A stream that starts again adds nothing; sessions that come late or twice are refused and change nothing."""
    where = [str(tmp_path / n) for n in ("in", "log", "checkpoint")]
    b = bars(spark, FLAT, FLAT, (100, 106, 99, 104), FLAT, FLAT)
    s = scans(spark, scan(0), scan(3, "Bearish"))
    early, late = lambda df, c: df.filter(f"{c} < '{day(4)}' AND {c} <> '{day(1)}'"), lambda df, c: df.filter(f"{c} >= '{day(4)}' OR {c} = '{day(1)}'")
    stream.arrivals(early(b, "Date"), early(s, "as_of")).write.mode("append").parquet(where[0])
    stream.run(spark, *where)
    first = spark.read.parquet(where[1])
    assert same(first, forward.log(early(b, "Date"), early(s, "as_of")))
    stream.run(spark, *where)
    assert same(spark.read.parquet(where[1]), first)
    changed = bars(spark, FLAT, (1, 2, 0.5, 1), (1, 2, 0.5, 1), FLAT, FLAT)  # day 1 comes late, day 2 again with other prices
    again = changed.filter(f"Date >= '{day(1)}' AND Date <> '{day(3)}'")
    stream.arrivals(again, scans(spark, scan(1))).write.mode("append").parquet(where[0])
    stream.run(spark, *where)
    got = spark.read.parquet(where[1])
    refused = sorted((r.as_of, r.event_type, r.reason) for r in got.collect() if "REFUSED" in r.event_type)
    assert refused == [(day(1), "BAR_REFUSED", "late"), (day(1), "SIGNAL_REFUSED", "late"), (day(2), "BAR_REFUSED", "late")]
    assert same(got.filter("event_type NOT LIKE '%REFUSED'"), forward.log(b.filter(f"Date <> '{day(1)}'"), s))


def test_odd_rows(spark, tmp_path):
    """Null prices, repeated scanner rows and bars, null expectations."""
    b = bars(spark, FLAT, FLAT, FLAT).unionByName(spark.createDataFrame([("A", day(3), None, 1.0, 1.0, 1.0, 1.0), ("A", day(4), *map(float, FLAT), 1.0)], BARS))
    s = scans(spark, scan(0), scan(0), scan(0, er=0.2), ("A", day(1), "Bearish", "m", None, "ACTIONABLE", 2, None, None, None), scan(3))
    where = [str(tmp_path / n) for n in ("in", "log", "checkpoint")]
    stream.arrivals(b.unionByName(b.filter(f"Date = '{day(1)}'")), s).write.parquet(where[0])
    stream.run(spark, *where)
    got = spark.read.parquet(where[1])
    assert same(got.filter("event_type <> 'BAR_REFUSED'"), forward.log(b, s))
    assert sorted(r.as_of for r in got.collect() if r.event_type == "BAR_REFUSED") == [day(1), day(3)]
