"""Cross-sectional features: ranks, breadth, sectors, benchmarks, relationships, regimes.

Each function gives a SQL query in a dialect over the queries for bars and universe. Dates hold few
symbols next to a symbol's history, so windows by date and joins by date are small; benchmark
windows run over the date spine, as a pivot of dates by symbols would.
"""

from __future__ import annotations

from tidemark.functions.dialect import Dialect, frame, lag
from tidemark.operators import features

BENCHMARK = "S0"


def pct_rank(x: str, by: str) -> str:
    """Average rank of equal values over the number of known values, ascending; null stays null."""
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / CAST(2 AS DOUBLE)) / count({x}) OVER (PARTITION BY {by}) END"


def base_features(d: Dialect, bars: str) -> str:
    """Bars with the returns and levels the cross-section needs."""
    q = features.RETURN.select(d, bars)
    q = f"SELECT *, CASE WHEN count(Close) OVER {frame(-49, 0)} >= 50 THEN avg(Close) OVER {frame(-49, 0)} END AS sma_50, CASE WHEN count(High) OVER {frame(-20, -1)} >= 20 THEN max(High) OVER {frame(-20, -1)} END AS h20, CASE WHEN count(Low) OVER {frame(-20, -1)} >= 20 THEN min(Low) OVER {frame(-20, -1)} END AS l20 FROM ({q}) q"
    return f"SELECT *, {d.div('Close', 'sma_50')} - 1 AS distance_sma_50, {d.div('Close', 'h20')} - 1 AS distance_prior_high_20, {d.div('Close', 'l20')} - 1 AS distance_prior_low_20 FROM ({q}) q"


def ranks_of(rows: str) -> str:
    """Ranks of returns among the symbols of a date; rows: a query with the returns."""
    return f"SELECT symbol, Date, {', '.join(f'round({pct_rank(f"return_{k}", "Date")}, 6) AS relative_strength_rank_{k}' for k in (5, 20, 63))} FROM ({rows}) f"


def strength_ranks(d: Dialect, bars: str, universe: str) -> str:
    return ranks_of(base_features(d, bars))


def share(test: str) -> str:
    return f"avg(CASE WHEN {test} THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END)"


def breadth_of(d: Dialect, rows: str) -> str:
    return f"""SELECT Date, round({share('return_1 > 0')}, 6) AS breadth_advance_pct, round({d.div('sum(CASE WHEN return_1 > 0 THEN Volume ELSE 0 END)', 'sum(Volume)')}, 6) AS breadth_up_volume_pct,
round({share('distance_sma_50 > 0')}, 6) AS breadth_above_sma_50_pct, round({share('distance_prior_high_20 >= 0')}, 6) AS breadth_high_20_pct, round({share('distance_prior_low_20 <= 0')}, 6) AS breadth_low_20_pct,
round(stddev_samp(return_20), 6) AS breadth_dispersion_20, round({d.adjusted_skew('return_20')}, 4) AS breadth_skew_20 FROM ({rows}) f GROUP BY Date"""


def breadth(d: Dialect, bars: str, universe: str) -> str:
    return breadth_of(d, base_features(d, bars))


def sectors_of(rows: str) -> str:
    """Momentum and participation of a sector; rows: a query with the features and the sector."""
    daily = f"SELECT Date, sector, {share('return_1 > 0')} AS advance, {share('distance_sma_50 > 0')} AS participation, avg(return_20) AS momentum FROM ({rows}) f WHERE sector IS NOT NULL GROUP BY Date, sector"
    return f"SELECT Date, sector, round(advance, 6) AS sector_breadth_advance_pct, round(participation, 6) AS sector_participation_sma50_pct, round(momentum, 6) AS sector_momentum_mean_20, round({pct_rank('momentum', 'Date')}, 6) AS sector_momentum_rank_20 FROM ({daily}) s"


def sectors(d: Dialect, bars: str, universe: str) -> str:
    return sectors_of(f"SELECT f.*, u.sector FROM ({base_features(d, bars)}) f JOIN ({universe}) u ON f.symbol = u.symbol")


def on_spine(d: Dialect, bars: str) -> str:
    """Close of every symbol on every date of the union calendar."""
    return f"SELECT c.Date, c.symbol, b.Close FROM (SELECT x.Date, y.symbol FROM (SELECT DISTINCT Date FROM ({bars}) a) x CROSS JOIN (SELECT DISTINCT symbol FROM ({bars}) b) y) c LEFT JOIN ({bars}) b ON b.Date = c.Date AND b.symbol = c.symbol"


def paired_corr(d: Dialect, x: str, y: str, window: str, least: int) -> str:
    """Correlation over the rows of a frame where both are known (``x`` and ``y`` are null together); null if either is constant."""
    return f"CASE WHEN count({x}) OVER {window} >= {least} THEN {d.div(f'covar_pop({x}, {y}) OVER {window}', f'(stddev_pop({x}) OVER {window} * stddev_pop({y}) OVER {window})')} END"


def benchmark(d: Dialect, bars: str, universe: str, symbol: str = BENCHMARK) -> str:
    """Returns relative to a benchmark, rolling beta and correlation, residual return, trend agreement."""
    w = frame(-62, 0)
    returns = f"SELECT *, {d.div('Close', lag('Close'))} - 1 AS r, {d.div('Close', lag('Close', 5))} - 1 AS w5, {d.div('Close', lag('Close', 20))} - 1 AS w20 FROM ({on_spine(d, bars)}) s"
    # returns of a symbol's own consecutive bars, put on the spine
    own = f"SELECT symbol, Date, return_1, return_5, return_20, distance_sma_50 FROM ({base_features(d, bars)}) f"
    pairs = f"""SELECT s.symbol, s.Date, o.return_1 AS x, m.return_1 AS b, z.w5 AS b5, z.w20 AS b20, o.return_5, o.return_20, o.distance_sma_50, m.distance_sma_50 AS b_trend, o.symbol AS known
FROM ({on_spine(d, bars)}) s LEFT JOIN ({own}) o ON o.symbol = s.symbol AND o.Date = s.Date LEFT JOIN ({own}) m ON m.symbol = '{symbol}' AND m.Date = s.Date LEFT JOIN ({returns}) z ON z.symbol = '{symbol}' AND z.Date = s.Date"""
    both = f"SELECT *, CASE WHEN b IS NOT NULL THEN x END AS px, CASE WHEN x IS NOT NULL THEN b END AS pb FROM ({pairs}) p"
    rolled = f"""SELECT *, CASE WHEN count(px) OVER {w} >= 40 AND count(b) OVER {w} >= 40 THEN {d.div(f'covar_samp(px, pb) OVER {w}', f'var_samp(b) OVER {w}')} END AS beta, {paired_corr(d, 'px', 'pb', w, 40)} AS corr FROM ({both}) q"""
    return f"""SELECT symbol, Date, round(b5, 6) AS bm_return_5, round(b20, 6) AS bm_return_20, round(return_5 - b5, 6) AS relative_return_5, round(return_20 - b20, 6) AS relative_return_20, round(beta, 5) AS rolling_beta_63, round(corr, 5) AS rolling_corr_63,
round(x - beta * coalesce(b5, 0.0) / 5.0, 6) AS residual_return_1, {d.sign('distance_sma_50')} * {d.sign('b_trend')} AS trend_agreement FROM ({rolled}) r WHERE known IS NOT NULL"""


def sector_relative(d: Dialect, bars: str, universe: str) -> str:
    proxy = f"SELECT symbol, Date, {d.div('Close', lag('Close', 20))} - 1 AS p20 FROM ({on_spine(d, bars)}) s"
    f = base_features(d, bars)
    return f"""SELECT f.symbol, f.Date, round(p.p20, 6) AS sector_return_20, round(f.return_20 - p.p20, 6) AS relative_return_vs_sector_20, {d.sign('f.distance_sma_50')} * {d.sign('t.distance_sma_50')} AS sector_trend_agreement
FROM ({f}) f JOIN ({universe}) u ON u.symbol = f.symbol LEFT JOIN ({proxy}) p ON p.symbol = u.sector_proxy AND p.Date = f.Date LEFT JOIN ({f}) t ON t.symbol = u.sector_proxy AND t.Date = f.Date WHERE u.sector_proxy IS NOT NULL"""


def relationships(d: Dialect, bars: str, universe: str, edges=(("S0", "S6"), ("S0", "S7"))) -> str:
    """Per directed edge and date: correlation, divergence, lead-lag, mutual information, confirmation, breakdown."""
    own = f"SELECT symbol, Date, return_1 FROM ({base_features(d, bars)}) f"
    w, w5 = "(PARTITION BY edge ORDER BY Date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)", "(PARTITION BY edge ORDER BY Date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    parts = [f"SELECT '{a}_{b}' AS edge, c.Date, s.return_1 AS x, r.return_1 AS y FROM (SELECT DISTINCT Date FROM ({bars}) q) c LEFT JOIN ({own}) s ON s.symbol = '{a}' AND s.Date = c.Date LEFT JOIN ({own}) r ON r.symbol = '{b}' AND r.Date = c.Date" for a, b in edges]
    lagged = f"SELECT *, lag(x) OVER (PARTITION BY edge ORDER BY Date) AS x1 FROM ({' UNION ALL '.join(parts)}) e"
    both = f"SELECT *, CASE WHEN y IS NOT NULL THEN x END AS px, CASE WHEN x IS NOT NULL THEN y END AS py, CASE WHEN y IS NOT NULL THEN x1 END AS lx, CASE WHEN x1 IS NOT NULL THEN y END AS ly FROM ({lagged}) l"
    rolled = f"SELECT edge, Date, {paired_corr(d, 'px', 'py', w, 40)} AS corr, CASE WHEN count(x) OVER {w5} >= 5 THEN sum(x) OVER {w5} END + CASE WHEN count(y) OVER {w5} >= 5 THEN sum(y) OVER {w5} END AS divergence, {paired_corr(d, 'lx', 'ly', w5, 5)} AS lead_lag FROM ({both}) b"
    return f"SELECT edge, Date, round(corr, 5) AS relationship_corr_63, round(divergence, 6) AS relationship_divergence_5, round(lead_lag, 4) AS relationship_lead_lag_5, round(-0.5 * ln(1 - power(greatest(least(corr, 0.999), -0.999), 2)), 5) AS relationship_mutual_info_63, round(abs(corr), 5) AS inverse_confirmation_63, CASE WHEN coalesce(abs(corr) < 0.4, false) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS relationship_breakdown_63 FROM ({rolled}) r"


def regimes(d: Dialect, bars: str, universe: str, symbol: str = BENCHMARK) -> str:
    """Trend and volatility of the benchmark per date and the regime label.

    The label compares with the median over all rows of the panel, later ones included."""
    w = frame(-19, 0)
    market = f"SELECT symbol, Date, {d.div('Close', lag('Close', 63))} - 1 AS trend, Close FROM ({on_spine(d, bars)}) s"
    vol = f"SELECT c.Date, CASE WHEN count(r) OVER (ORDER BY c.Date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20 THEN stddev_samp(r) OVER (ORDER BY c.Date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS vol FROM (SELECT DISTINCT Date FROM ({bars}) q) c LEFT JOIN (SELECT Date, return_1 AS r FROM ({base_features(d, bars)}) f WHERE symbol = '{symbol}') m ON m.Date = c.Date"
    rows = f"SELECT f.symbol, f.Date, f.return_20, t.trend, v.vol FROM ({base_features(d, bars)}) f LEFT JOIN ({market}) t ON t.symbol = '{symbol}' AND t.Date = f.Date LEFT JOIN ({vol}) v ON v.Date = f.Date"
    mid = f"SELECT {d.percentile('vol', 0.5)} AS med FROM ({rows}) x"
    return f"""SELECT symbol, Date, round(trend, 6) AS market_regime_trend_score, round(vol, 6) AS market_regime_volatility_score,
CASE WHEN trend > 0 AND vol <= med THEN 'uptrend_low_vol' WHEN trend > 0 THEN 'uptrend_high_vol' WHEN trend <= 0 AND vol > med THEN 'downtrend_high_vol' ELSE 'mixed' END AS market_regime_label,
round(return_20 * coalesce(trend, 0.0), 6) AS regime_conditioned_return_20 FROM ({rows}) r CROSS JOIN ({mid}) m"""


def label_ranks(d: Dialect, bars: str, universe: str, h: int = 5) -> str:
    """Rank of outcomes among all symbols of a date, and return over adverse excursion."""
    from tidemark.operators.labels import LABELS

    q = LABELS[h].select(d, bars)
    cols = ", ".join(f"round({pct_rank(f'label_{s}_forward_return_{h}', 'Date')}, 6) AS {s}_return_rank, round({d.div(f'label_{s}_forward_return_{h}', f'abs(label_{s}_mae_{h})')}, 5) AS {s}_utility" for s in ("bull", "bear"))
    return f"SELECT symbol, Date, {cols} FROM ({q}) l"


VIEWS = {f.__name__: f for f in (strength_ranks, breadth, sectors, benchmark, sector_relative, relationships, regimes, label_ranks)}
