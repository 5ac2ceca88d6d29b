import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark import queries, streaming
from tidemark.operators import backtest, events, features, models, sequential
from tidemark.sources import bars as source


def make_bars(spark, rows, symbol="A"):
    start = dt.date(2024, 1, 1)
    return spark.createDataFrame([(symbol, start + dt.timedelta(k), *map(float, r)) for k, r in enumerate(rows)], "symbol string, Date date, Open double, High double, Low double, Close double, Volume double")


def test_rsi_closed_forms():
    assert sequential.rsi(np.arange(1.0, 40), 14)[14:].tolist() == [100.0] * 25
    assert sequential.rsi(np.arange(40.0, 1, -1), 14)[14:].tolist() == [0.0] * 25
    assert sequential.rsi(np.full(40, 7.0), 14)[14:].tolist() == [50.0] * 26
    assert np.isnan(sequential.rsi(np.arange(10.0), 14)).all()


def test_wilder_keeps_state_over_gaps():
    x = np.array([np.nan, 1, 2, 3, np.nan, 5])
    assert np.allclose(sequential.wilder(x, 3), [np.nan, np.nan, np.nan, 2, np.nan, 3], equal_nan=True)
    assert np.isnan(sequential.wilder(np.array([1, np.nan, 3.0, 4]), 2)).all()


def test_one_exchange_for_a_family(spark, sf):
    plan = features.TREND.apply(make_bars(spark, [(1, 2, 0.5, 1, 1)] * 3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("+- Sort") <= 1


def test_features_do_not_see_the_future(spark):
    rng = np.random.default_rng(3)
    close = 100 + rng.normal(size=80).cumsum()
    rows = [(c, c + 1, c - 1, c + 0.2, 1000 + k) for k, c in enumerate(close)]
    later = rows[:70] + [(1, 2, 0.5, 1, 5)] * 10
    for family in (features.TREND, features.VOLUME, features.CANDLES):
        a, b = (family.rounded(make_bars(spark, r)).filter(F.col("Date") < dt.date(2024, 1, 1) + dt.timedelta(70)).orderBy("Date").collect() for r in (rows, later))
        assert a == b


def test_trades_do_not_overlap():
    n = 8
    bars = {"Open": np.arange(10.0, 18), "High": np.arange(11.0, 19), "Low": np.arange(9.0, 17), "Close": np.arange(10.5, 18), "Volume": np.ones(n)}
    fired = np.zeros(n, bool)
    fired[[1, 3, 4]] = True
    got = backtest.trades(bars, np.arange(n), fired, backtest.Rule(holding=3, cost_bps=0))
    assert [t[0] for t in got] == [1, 4]  # the second signal comes before the first exit
    assert got[0][3:5] == (12.0, 14.5)


def brute_exit(high, low, close, entry, bullish, c):
    """Bar by bar, as the rule reads."""
    sign, peak, trough = (1 if bullish else -1), entry, entry
    for k in range(len(close)):
        peak, trough = max(peak, high[k]), min(trough, low[k])
        levels = {}
        if c.stop is not None and (low[k] <= entry * (1 - c.stop) if bullish else high[k] >= entry * (1 + c.stop)):
            levels["stop"] = entry * (1 - sign * c.stop)
        if c.trailing is not None and (low[k] <= peak * (1 - c.trailing) if bullish else high[k] >= trough * (1 + c.trailing)):
            levels["trailing_stop"] = peak * (1 - c.trailing) if bullish else trough * (1 + c.trailing)
        if c.target is not None and (high[k] >= entry * (1 + c.target) if bullish else low[k] <= entry * (1 - c.target)):
            levels["target"] = entry * (1 + sign * c.target)
        if levels:
            name = next(iter(levels))
            return k, "stop_intraday_ambiguous" if len(levels) > 1 else name, levels[name]
    return len(close) - 1, "time_exit", close[-1]


def test_exits_by_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(600):
        n = int(rng.integers(1, 12))
        mid = 100 + rng.normal(0, 3, n).cumsum()
        high, low = mid + rng.uniform(0, 4, n), mid - rng.uniform(0, 4, n)
        pick = lambda *xs: xs[int(rng.integers(len(xs)))]
        c = backtest.Portfolio(target=pick(None, 0.03, 0.06), stop=pick(None, 0.02, 0.05), trailing=pick(None, 0.03))
        bullish = bool(rng.integers(2))
        got, want = backtest.first_exit(high, low, mid, 100.0, bullish, c), brute_exit(high, low, mid, 100.0, bullish, c)
        assert got[:2] == want[:2] and abs(got[2] - want[2]) < 1e-9


def test_stop_wins_ties():
    c = backtest.Portfolio(target=0.1, stop=0.1)
    one = lambda *x: backtest.first_exit(*map(np.array, x), 100.0, True, c)
    assert one([115.0], [85.0], [100.0])[:2] == (0, "stop_intraday_ambiguous")
    assert one([105.0, 112.0], [99.0, 100.0], [100.0, 111.0])[:2] == (1, "target")
    assert one([105.0], [99.0], [103.0]) == (0, "time_exit", 103.0)


def test_every_candidate_is_audited(spark):
    bars = make_bars(spark, [(100, 101, 99, 100, 1.0)] * 30)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    rows = [("A", day(0), "Bullish", 1.0), ("A", day(0), "Bearish", 1.0), ("A", day(29), "Bullish", 1.0), ("A", day(28), "Bullish", 2.0), ("A", day(90), "Bullish", 1.0), ("Z", day(1), "Bullish", 3.0)]
    candidates = spark.createDataFrame([(*r, "tech", "m") for r in rows], "symbol string, Date date, direction string, score double, sector string, model_id string")
    config = backtest.Portfolio(target=None, stop=None, sector_fraction=1.0)
    got = {(r.symbol, r.Date, r.direction): r.audit_reason for r in backtest.admitted(backtest.planned_trades(bars, candidates, config), config).collect()}
    assert got == {
        ("A", day(0), "Bearish"): "included", ("A", day(0), "Bullish"): "max_position_per_symbol", ("A", day(29), "Bullish"): "no_future_entry_or_exit_bar",
        ("A", day(28), "Bullish"): "no_future_entry_or_exit_bar", ("A", day(90), "Bullish"): "signal_date_not_in_frame", ("Z", day(1), "Bullish"): "signal_date_not_in_frame",
    }
    wild = make_bars(spark, [(100, 130, 80, 100 + 20 * (k % 2), 1.0) for k in range(30)])
    one = backtest.planned_trades(wild, candidates.limit(1), backtest.Portfolio(volatility_weights=True)).first()
    assert 0 < one.planned_weight < 0.02


def test_walk_forward_plan():
    folds = backtest.expanding_plan(2514, 5, 10)
    assert folds[0] == (0, 418, 429, 845) and folds[-1][3] == 2513


def test_validation_and_upsert(spark):
    good = make_bars(spark, [(1, 2, 0.5, 1, 1), (1, 2, 0.5, 1.5, 1)])
    assert source.validated(good).count() == 2
    with pytest.raises(ValueError):
        source.validated(make_bars(spark, [(1, 0.4, 0.5, 1, 1)]))
    with pytest.raises(ValueError):
        source.validated(good.unionByName(good))
    new = good.withColumn("Close", F.lit(1.9)).filter("Date = date'2024-01-02'")
    assert sorted(r.Close for r in source.upserted(good, new).collect()) == [1.0, 1.9]


def test_csv_round_trip(spark, tmp_path):
    bars = make_bars(spark, [(1, 2, 0.5, 1, 1)] * 3)
    source.save(bars.withColumnRenamed("Open", "OPEN"), f"{tmp_path}/x.csv")
    assert source.load(spark, f"{tmp_path}/x.csv").count() == 3
    assert source.in_window(bars, "2024-01-02", "2024-01-02").count() == 1


def test_append_is_idempotent(spark):
    log = spark.createDataFrame([("k1", 1)], "unique_key string, v int")
    new = spark.createDataFrame([("k1", 2), ("k2", 3), ("k2", 3)], "unique_key string, v int")
    once = events.appended(log, new)
    assert sorted(r.v for r in once.collect()) == [1, 3]
    assert events.appended(once, new).count() == 2


def test_stream_converges(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = streaming.tumbling(streaming.read(spark, str(tmp_path / "in"), schema), late="60 days")
    q = stream.writeStream.outputMode("update").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT window_start, event_type, max(n) AS n FROM tumbled GROUP BY 1, 2").agg(F.sum("n")).first()[0]
    assert got == spark.read.parquet(f"{sf}/events.parquet").count()


def test_models(spark, sf):
    with pytest.raises(ValueError):
        models.reject_leakage(["x", "label_bull_mfe_5"])
    rows = queries.scored_rows(spark, sf)
    assert models.prune_correlated(rows.withColumn("x3", F.col("x1") * 2), ["x1", "x3", "x2"]) == ["x1", "x2"]
    got = {r.feature: r for r in models.screen(rows.withColumn("none", F.lit(None).cast("double")), ["x1", "none"]).collect()}
    assert got["x1"].reason == "" and got["none"].reason == "missingness"
    scores = spark.createDataFrame([("isotonic", 2, 0.20, 0.01), ("sigmoid", 1, 0.205, 0.01), ("identity", 0, 0.25, 0.01)], "method string, complexity int, mean double, se double")
    assert models.choose_calibrator(scores).first().method == "sigmoid"


def test_regime_labels_do_not_change_with_later_rows():
    x = np.random.default_rng(1).normal(size=(200, 3))
    assert [models.kmeans_label(x[: k + 1]) for k in (150, 160)] == [models.kmeans_label(x[:151].copy()), models.kmeans_label(x[:161].copy())]


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(1).count() == 1
