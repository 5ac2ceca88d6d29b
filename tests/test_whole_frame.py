"""The whole modeling frame: the market beside a symbol, what looks ahead, gaps and what is missing."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import whole

UNIVERSE = "symbol string, role string, sector string, sector_proxy string, benchmark boolean"


@pytest.fixture(scope="module")
def universe(spark):
    return spark.createDataFrame([("A", "broad_market_etf", None, None, True), ("B", "stock", "alpha", "P", False), ("P", "sector_etf", "alpha", None, False)], UNIVERSE)


def walks(spark, n, gap=()):
    """Bars of four symbols; B lacks some dates, Z is in no universe."""
    rng, rows = np.random.default_rng(3), []
    for s in "ABPZ":
        close = 50 * np.exp(rng.normal(0, 0.02, 160).cumsum())
        for k, c in enumerate(close[:n]):
            if not (s == "B" and k in gap):
                rows.append((s, dt.date(2024, 1, 1) + dt.timedelta(days=k), float(c * 1.001), float(c * 1.01), float(c * 0.99), float(c), 1000.0 + k))
    return spark.createDataFrame(rows, "symbol string, Date date, Open double, High double, Low double, Close double, Volume double")


def test_beta_and_correlation_with_gaps():
    rng = np.random.default_rng(1)
    x, b = rng.normal(size=(2, 200))
    x[rng.random(200) < 0.2], b[rng.random(200) < 0.1] = np.nan, np.nan
    beta, corr = whole.beta_and_corr(x, b)
    px, pb = pd.Series(np.where(np.isnan(b), np.nan, x)), pd.Series(np.where(np.isnan(x), np.nan, b))
    want = (px.rolling(63, min_periods=40).cov(pb) / pd.Series(b).rolling(63, min_periods=40).var()).to_numpy()
    known = ~np.isnan(want)
    assert known.sum() > 100 and np.allclose(beta[known], want[known], atol=1e-12)
    for k in range(200):
        both = [(u, v) for u, v in zip(x[max(0, k - 62) : k + 1], b[max(0, k - 62) : k + 1]) if not (np.isnan(u) or np.isnan(v))]
        assert (np.isnan(corr[k]) and len(both) < 40) or corr[k] == pytest.approx(np.corrcoef(np.array(both).T)[0, 1], abs=1e-12)


def test_a_constant_benchmark_has_no_beta():
    beta, corr = whole.beta_and_corr(np.arange(80.0), np.zeros(80))
    assert np.isnan(beta).all() and np.isnan(corr).all()
    assert [len(v) for v in whole.beta_and_corr(np.array([]), np.array([]))] == [0, 0]


def test_no_feature_looks_ahead(spark, universe):
    """Features of early dates are the same when later bars are not there; only the regime's label looks at all rows. Gaps count in the windows against a benchmark."""
    gap = {20, 21, 90}
    built = lambda n: whole.modeling_frame(walks(spark, n, gap), universe, (5,), ("A",), (("A", "P"),))
    full, part = (df.toPandas().sort_values(["symbol", "Date"]).reset_index(drop=True) for df in (built(160), built(120)))
    assert len(full) == 4 * 160 - 3 and not full.duplicated(["symbol", "Date"]).any()
    early = full[full["Date"] < dt.date(2024, 1, 1) + dt.timedelta(days=120)].reset_index(drop=True)
    plain = [c for c in part.columns if not c.startswith("label_") and c != "market_regime_label"]
    assert len(plain) > 400 and len(early) == len(part)
    for c in plain:
        x, y = early[c], part[c]
        same = np.isclose(x.astype(float), y.astype(float), rtol=1e-9, atol=1e-9, equal_nan=True) if x.dtype.kind == "f" else (x == y) | (x.isna() & y.isna())
        assert same.all(), c
    mine = full[full["symbol"] == "B"].set_index("Date")
    a, close = full[full["symbol"] == "A"].set_index("Date")["Close"], mine["Close"]
    assert np.allclose(mine["a_return_5"].dropna(), (a / a.shift(5) - 1).reindex(mine.index).dropna())
    p = full[full["symbol"] == "P"].set_index("Date")["Close"]
    assert np.allclose(mine["relative_return_vs_sector_20"].dropna(), ((close / close.shift(20) - 1) - (p / p.shift(20) - 1).reindex(mine.index)).dropna())
    b = close / close.shift(1) - 1
    m = a / a.shift(1) - 1
    pairs = pd.DataFrame({"b": b, "m": m}).reindex(a.index)
    last = pairs.iloc[-63:].dropna()
    assert mine["rolling_beta_vs_a_63"].iloc[-1] == pytest.approx(last.cov().iloc[0, 1] / pairs["m"].iloc[-63:].var())
    other = full[full["symbol"] == "Z"]
    assert other["role"].isna().all() and other["sector_return_20"].isna().all() and other["rolling_beta_vs_a_63"].notna().any()
    assert full["relationship_corr_a_p_63"].notna().any() and full["sector_momentum_mean_20"].notna().any()


def test_no_bars(spark, universe):
    out = whole.modeling_frame(walks(spark, 1).limit(0), universe, (5,), ("A",), ())
    assert out.count() == 0 and "rsi_14_percentile_252" in out.columns


def test_regime_without_a_benchmark(spark):
    rows = [("A", 0.1, None, None, 0.3, 0.2), ("B", -0.2, None, None, -0.3, 0.4), ("C", None, None, None, 0.3, 0.5), ("D", 0.4, None, None, None, None)]
    df = spark.createDataFrame(rows, "symbol string, return_20 double, market_regime_trend_score double, market_regime_volatility_score double, all_return_ double, all_deviation_ double")
    got = {r.symbol: r for r in whole.regimes(df, known=False).collect()}
    assert [got[s].market_regime_label for s in "ABCD"] == ["uptrend_low_vol", "mixed", "uptrend_high_vol", "mixed"]
    assert got["A"].regime_conditioned_return_20 == pytest.approx(0.03) and got["C"].regime_conditioned_return_20 is None and got["D"].regime_conditioned_return_20 == 0.0


def test_too_many_names(spark):
    with pytest.raises(ValueError, match="stand for the market"):
        whole.market(walks(spark, 2), {f"N{k}" for k in range(whole.MOST_NAMED + 1)})
