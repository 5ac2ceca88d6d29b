import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import bars, providers, state

BODY = json.dumps({"historical": [{"date": f"2024-01-0{k}", "open": k, "high": k + 1, "low": k - 0.5, "close": k + 0.5, "volume": 10} for k in (3, 2, 4)]})


def test_provider(spark):
    body = BODY

    def answer(url):
        return (200, body) if "AAA" in url else (404, "")

    providers.register(spark, "canned", answer)
    got = providers.download(spark, "canned", ["AAA"], "https://x/{symbol}", "2024-01-02", "2024-01-03")
    assert [r.Date.day for r in got.orderBy("Date").collect()] == [2, 3]
    bars.validated(got)
    with pytest.raises(Exception, match="unknown symbol"):
        providers.download(spark, "canned", ["BBB"], "https://x/{symbol}", "2024", "2025").count()
    assert providers.rows_of(json.dumps([{"symbol": "A", "historical": [1]}])) == [1] and providers.rows_of("[1, 2]") == [1, 2]
    with pytest.raises(ValueError, match="no such key"):
        providers.rows_of(json.dumps({"Error Message": "no such key"}))


def test_fallback_and_history(spark, tmp_path):
    providers.register(spark, "broken", lambda url: (200, BODY) if "AAA" in url else (429, ""))
    providers.register(spark, "second", lambda url: (200, BODY) if "BBB" in url else (404, ""))
    path, ask = str(tmp_path / "history.parquet"), lambda: providers.update_history(spark, path, ["broken", "second"], ["AAA", "BBB", "CCC"], "https://x/{symbol}", "2024-01-01", "2024-01-09")
    for replaced, inserted in ((0, 3), (3, 0)):
        got = {r.symbol: r for r in ask().collect()}
        assert (got["AAA"].provider, got["BBB"].provider, got["AAA"].error) == ("broken", "second", None) and "unknown symbol" in got["CCC"].error
        assert (got["BBB"].replaced, got["BBB"].inserted, got["CCC"].inserted) == (replaced, inserted, 0)
    assert bars.load(spark, path).count() == 6


def test_errors_are_rows_of_one_job(spark):
    """10,000 symbols, many failing in every way: one job, a plan of one scan, every symbol settled once."""

    def first(url):
        n = int(url.rsplit("/", 1)[1])
        if n % 7 == 0:
            raise ConnectionError("reset")
        return {1: (429, ""), 2: (404, ""), 3: (200, "{"), 4: (200, json.dumps({"message": "no plan"})), 5: (503, "")}.get(n % 7, (200, BODY))

    def second(url):
        n = int(url.rsplit("/", 1)[1])
        return (200, BODY) if n % 2 else (403, "")

    providers.register(spark, "first", first)
    providers.register(spark, "second", second)
    names, context = [str(n) for n in range(10_000)], spark.sparkContext
    context.setJobGroup("one-download", "")
    got, status = providers.download_any(spark, ["first", "second"], [*names, "0", "1"], "https://x/{symbol}", "2024-01-01", "2024-01-03", attempts=2, wait=0.0)
    assert len(context.statusTracker().getJobIdsForGroup("one-download")) == 1
    context.setJobGroup("later", "")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    kept = {r.symbol: r for r in status.collect()}
    assert len(kept) == status.count() == 10_000
    for name in names:
        n, row = int(name), kept[name]
        want = ("first", True) if n % 7 == 6 else ("second", n % 2 == 1)
        assert (row.provider, row.error is None) == want
    assert "lacks access" in kept["0"].error
    bars.validated(got)
    assert got.count() == 2 * sum(r.error is None for r in kept.values())


def test_tries_of_one_symbol(spark):
    """Busy and broken providers are asked again; those that refuse, or whose answer makes no sense, are not."""
    for name, answer in (("busy", (429, "")), ("refuses", (401, "")), ("senseless", (200, "[1]")), ("good", (200, BODY))):
        providers.register(spark, name, lambda url, a=answer: a)
    order = ["busy", "refuses", "senseless", "good"]
    rows = providers.answers(spark, order, ["A"], "{symbol}", "2024-01-01", "2024-01-09", attempts=3, wait=0.0).collect()
    tries = [(r.provider, r.attempt, r.last) for r in rows if r.Date is None]
    assert tries == [("busy", 1, False), ("busy", 2, False), ("busy", 3, False), ("refuses", 1, False), ("senseless", 1, False), ("good", 1, True)]
    assert [r.Date.day for r in rows if r.Date] == [2, 3, 4]
    rows = providers.answers(spark, order[:1], ["A"], "{symbol}", "2024-01-01", "2024-01-09", attempts=2, wait=0.0).collect()
    assert [(r.attempt, r.last) for r in rows] == [(1, False), (2, True)]
    assert providers.answers(spark, order, [], "{symbol}", "2024", "2025").count() == 0


def test_sample_bars(spark):
    got = providers.sample_bars(spark, ["A", "B"], rows=50)
    assert bars.validated(got).count() == 100
    assert state.fingerprint(got) == state.fingerprint(providers.sample_bars(spark, ["A", "B"], rows=50))


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    assert state.fingerprint(df) == state.fingerprint(df.select("x", "id").orderBy(F.rand()).repartition(7)) != state.fingerprint(df.filter("id > 0"))


def test_generations(spark, tmp_path):
    root = str(tmp_path)
    state.write_generation({"a": spark.range(3), "b": spark.range(2)}, root, "g1")
    state.write_generation({"a": spark.range(5)}, root, "g2")
    got = state.read_generation(spark, root)
    assert set(got) == {"a"} and got["a"].count() == 5


def test_state_tables(spark, tmp_path):
    root = str(tmp_path)
    assert state.table(spark, root, "holdout_models").count() == 0
    new = spark.createDataFrame([("r", "m1", "h"), ("r", "m2", "h"), ("r", "m1", "h")], state.TABLES["holdout_models"])
    assert [state.append(spark, root, "holdout_models", new, "model_id") for _ in range(2)] == [2, 0]
    ran = []
    assert [state.cycle_once(spark, root, "2024-01-02", lambda: ran.append(1)) for _ in range(2)] == ["DONE", "ALREADY_DONE"] and ran == [1]
    def fails():
        raise RuntimeError("work failed")

    with pytest.raises(RuntimeError):
        state.cycle_once(spark, root, "2024-01-03", fails)
    inner = []
    assert state.cycle_once(spark, root, "2024-01-03", lambda: inner.append(state.cycle_once(spark, root, "2024-01-03", lambda: ran.append(2)))) == "DONE"
    assert inner == ["RUNNING"] and ran == [1]
    with pytest.raises(ValueError):
        state.journal(new, new, ["model_id"])


def test_regime_cache(spark, tmp_path):
    root, calls = str(tmp_path), []
    market = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(k), float(k)) for k in range(10)], "Date date, x double")

    def compute(m, first):
        calls.append(first)
        return m.filter(F.lit(True) if first is None else F.col("Date") >= F.lit(first)).select("Date", F.col("x").cast("long").alias("cluster"))

    short = market.filter("x < 8")
    assert [state.regimes_cached(spark, root, m, ["x"], compute)[1] for m in (short, short, market)] == ["MISS", "HIT", "PARTIAL_APPEND"]
    got, status = state.regimes_cached(spark, root, market.withColumn("x", F.col("x") + 1), ["x"], compute)
    assert status == "INVALIDATED" and got.count() == 10
    assert calls == [None, dt.date(2024, 1, 9), None]


def test_universe(spark):
    df, mark = state.load_universe(spark, [{"symbol": "b"}, {"symbol": "A", "role": "x"}, {"symbol": "a", "role": "stock"}])
    assert [(r.symbol, r.role) for r in df.collect()] == [("A", "stock"), ("B", "stock")] and len(mark) == 20
    assert state.prefix(bars.normalized(spark.createDataFrame([(dt.date(2024, 1, 1), 1.0)], "DATE date, close double")), "2023-12-31").count() == 0
    assert state.Manifest(("a",), "p").id != state.Manifest(("b",), "p").id
