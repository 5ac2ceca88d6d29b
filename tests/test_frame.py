"""The modeling frame, its hygiene, scans, and the discovery loop."""

import datetime as dt

import numpy as np
import pytest
from test_research import make_bars

from tidemark.operators import backtest, features, frame, labels, models, sequential
from tidemark.sources import bars as source


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(5)
    close = 100 * np.exp(rng.normal(0, 0.02, 400).cumsum())
    return make_bars(spark, [(c, c * 1.01, c * 0.99, c * 1.002, 1000.0 + k) for k, c in enumerate(close)])


def test_panel_has_one_exchange(walk):
    plan = frame.panel(walk, list(features.FAMILIES.values()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_panel_equals_its_families(walk):
    both = frame.panel(walk, list(features.FAMILIES.values()))
    for family in features.FAMILIES.values():
        alone = family.apply(walk).select("symbol", "Date", *family.keep)
        assert both.select("symbol", "Date", *family.keep).exceptAll(alone).count() == 0


def test_frame_is_one_to_one_and_does_not_look_ahead(walk):
    panel = frame.panel(walk, [features.RETURN])
    labelled = frame.label_panel(sequential.extended(walk, ["label_atr_14"]), (5,))
    out = frame.modeling_frame(panel, labelled)
    assert out.count() == 400 and {"return_20", "label_bull_forward_return_5", "label_bull_target_before_stop_5", "label_end_date_5"} <= set(out.columns)
    assert not any(c.startswith("label_") for c in frame.numeric_features(out))
    with pytest.raises(ValueError, match="more than once"):
        frame.modeling_frame(panel.unionByName(panel.limit(1)), labelled)
    with pytest.raises(ValueError, match="look ahead"):
        frame.modeling_frame(labelled, panel)


def test_hygiene(spark):
    rows = [("A", dt.date(2024, 1, k), x, 1.0) for k, x in enumerate([1.0, float("inf"), float("-inf"), 1.5e308, None, float("nan")], 1)]
    df = spark.createDataFrame(rows, "symbol string, Date date, return_5 double, rsi_14 double")
    clean = frame.sanitized(df, ["return_5", "rsi_14"])
    assert [r.return_5 for r in clean.orderBy("Date").collect()] == [1.0] + [None] * 5
    audit = {r.feature: r for r in frame.hygiene_audit(df, ["return_5", "rsi_14"]).collect()}
    assert (audit["return_5"].n, audit["return_5"].missing, audit["return_5"].replaced, audit["return_5"].first_replaced) == (6, 1, 4, dt.date(2024, 1, 2))
    assert audit["return_5"].family == "returns_momentum" and audit["rsi_14"].family == "rsi_family" and audit["rsi_14"].replaced == 0
    both = {r.feature: r for r in frame.audits_merged(frame.hygiene_audit(df, ["return_5"]), frame.hygiene_audit(df, ["return_5"])).collect()}
    assert both["return_5"].n == 12 and both["return_5"].replaced == 8
    frame.rejected_nonfinite(clean, ["return_5"])
    with pytest.raises(ValueError, match="not finite"):
        frame.rejected_nonfinite(df, ["return_5"])


def test_price_features_use_the_prior_window(spark):
    bars = make_bars(spark, [(10, 11, 9, 10, 100.0)] * 20 + [(10, 30, 8, 10.5, 100.0)])
    r = features.PRICE.apply(sequential.extended(bars, ["atr_14"])).orderBy("Date").collect()[-1]
    assert r.drawdown_from_high_20 == pytest.approx(10.5 / 11 - 1) and r.bounce_from_low_20 == pytest.approx(10.5 / 9 - 1) and r.failed_breakdown_20 == 1.0 and r.pullback_count_3 == 0


def test_label_range_is_exponential(spark):
    rows = [(10, 11 + k % 3, 9, 10, 1.0) for k in range(30)]
    got = [r.label_atr_14 for r in sequential.extended(make_bars(spark, rows), ["label_atr_14"]).orderBy("Date").collect()]
    state, want = None, []
    for k, (_, high, low, *_) in enumerate(rows):
        tr = high - low
        state = tr if state is None else state * 13 / 14 + tr / 14
        want.append(state if k >= 13 else None)
    assert got[:13] == [None] * 13 and np.allclose(got[13:], want[13:])


def test_policies_and_time_exits(spark):
    up = make_bars(spark, [(100, 101, 99, 100, 1.0)] * 20 + [(100 + k, 101 + k, 99 + k, 100 + k, 1.0) for k in range(30)])
    out = labels.policy_outcomes(sequential.extended(up, ["label_atr_14"]))
    row = out.filter("stop_multiple = 1.0").orderBy("Date").collect()[20]
    assert row.target_before_stop == 1.0 and row.time_to_target == 4.0 and row.time_to_stop is None and row.profitable_despite_failed_tbs == 0.0
    assert out.filter("forward_return IS NULL").count() == 4 * 20
    wide = frame.with_time_exits(up.select("symbol", "Date"), out)
    assert wide.count() == 50 and "label_utility_t2_s1p25" in wide.columns


def test_scan_of_the_last_bar(spark):
    rule = backtest.Rule(length=2, lower_level=40.0, slope_window=1)
    falling = [(c, c + 1, c - 1, c, 10.0) for c in (10.0, 9, 8, 7, 6, 5, 8)]
    assert backtest.latest_scan(make_bars(spark, falling), rule).collect()[0].close == 8.0
    assert backtest.latest_scan(make_bars(spark, falling[:-1]), rule).count() == 0


def test_discovery_loop(spark, walk):
    panel = frame.panel(walk, [features.RETURN])
    rows = frame.modeling_frame(panel, frame.label_panel(sequential.extended(walk, ["label_atr_14"]), (5,)))
    got = frame.discovered(rows, {"POOLED": ()}, (5,), ["return_5", "return_20"], "2024-10-01").collect()
    assert {(r.direction, r.family) for r in got} == {(d, f) for d in ("bull", "bear") for f in ("base_rate", "logistic")} and all(0 <= r.brier <= 1 for r in got)


def test_rsi_of_all_lengths_is_the_single_one():
    rng = np.random.default_rng(2)
    close = 50 + rng.normal(0, 1, 300).cumsum()
    close[40:44] = close[40]
    for k, n in enumerate((2, 14, 50)):
        assert np.array_equal(sequential.rsi_many(close, np.array([2, 14, 50]))[:, k], sequential.rsi(close, n), equal_nan=True)


def test_saved_tables_replace_whole(spark, tmp_path, walk):
    path = str(tmp_path / "bars.parquet")
    source.save(walk, path)
    source.save(walk.limit(5), path)
    assert source.load(spark, path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["bars.parquet"]
    with pytest.raises(ValueError, match="several columns for Date"):
        source.normalized(spark.createDataFrame([(1, 2)], "date int, timestamp int"))
    assert source.normalized(spark.createDataFrame([(1, 2)], " `Adjusted Close` int, `other ` int")).columns == ["Adj Close", "other"]


def test_calibration_slope(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.05, 0.95, 4000)
    rows = [("a", float(x), float(rng.uniform() < x)) for x in p] + [("b", float(x), float(rng.uniform() < 1 / (1 + np.exp(-2 * np.log(x / (1 - x)))))) for x in p] + [("c", 0.5, 1.0)]
    got = {r.scope: r for r in models.calibration_slope(spark.createDataFrame(rows, "scope string, p double, y double")).collect()}
    assert abs(got["a"].slope - 1) < 0.1 and abs(got["a"].intercept) < 0.1 and abs(got["b"].slope - 2) < 0.2 and got["c"].slope is None and got["POOLED"].n == 8001
