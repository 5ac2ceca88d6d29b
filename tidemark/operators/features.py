"""Trailing features of one symbol's bars, in families that share one window."""

from __future__ import annotations

from tidemark.functions.dialect import Dialect, flag, frame, lag, rolling, rolling_percentile
from tidemark.plans.staged import Family

RETURNS = (1, 2, 3, 5, 10, 20, 40, 63, 126, 252)
PRIOR = (20, 63, 126, 252)
TRENDS = (10, 20, 50, 100, 200)


def change(d: Dialect, x: str, k: int) -> str:
    """x over its value k rows before, minus one."""
    return f"{d.div(x, lag(x, k))} - 1"


def share_at_most(d: Dialect, xs: str, x: str, width: int, least: int) -> str:
    """Share of the frame's rows whose value is at most the current one (a null current value: 0)."""
    w = frame(-(width - 1), 0)
    return f"CASE WHEN count({x}) OVER {w} >= {least} THEN CASE WHEN {x} IS NULL THEN CAST(0.0 AS DOUBLE) ELSE CAST({d.at_most(xs, x)} AS DOUBLE) / count(*) OVER {w} END END"


def _returns(d: Dialect) -> list[dict[str, str]]:
    one = {f"return_{k}": change(d, "Close", k) for k in RETURNS} | {f"log_return_{k}": f"ln({d.div('Close', lag('Close', k))})" for k in RETURNS}
    return [one]


RETURN = Family("returns", _returns, (*(f"return_{k}" for k in RETURNS), *(f"log_return_{k}" for k in RETURNS)))


def _momentum(d: Dialect) -> list[dict[str, str]]:
    return [
        {"return_5": change(d, "Close", 5), "return_20": change(d, "Close", 20), "up": flag(f"Close > {lag('Close')}"), "down": flag(f"Close < {lag('Close')}")},
        {
            "return_accel_5_20": "return_5 - return_20", "return_5_lag_1": lag("return_5"), "return_20_lag_1": lag("return_20"), "return_5_change_5": f"return_5 - {lag('return_5', 5)}",
            "mean_20": rolling("avg", "return_20", 252, 60, prior=True), "std_20": rolling("stddev_samp", "return_20", 252, 60, prior=True),
            "up_streak_5": f"sum(up) OVER {frame(-4, 0)}", "down_streak_5": f"sum(down) OVER {frame(-4, 0)}",
            "window_20": f"{d.collected('return_20')} OVER {frame(-251, 0)}",
        },
        {"return_20_zscore_252": d.div("return_20 - mean_20", "std_20"), "momentum_20_percentile_252": share_at_most(d, "window_20", "return_20", 252, 60)},
    ]


MOMENTUM = Family("momentum", _momentum, ("return_accel_5_20", "return_5_lag_1", "return_20_lag_1", "return_5_change_5", "return_20_zscore_252", "up_streak_5", "down_streak_5", "momentum_20_percentile_252"))


def _levels(d: Dialect) -> list[dict[str, str]]:
    first = {f"ph_{w}": rolling("max", "High", w, max(5, min(w, 20)), prior=True) for w in PRIOR} | {f"pl_{w}": rolling("min", "Low", w, max(5, min(w, 20)), prior=True) for w in PRIOR}
    second = {}
    for w in PRIOR:
        second |= {f"distance_prior_high_{w}": f"{d.div('Close', f'ph_{w}')} - 1", f"distance_prior_low_{w}": f"{d.div('Close', f'pl_{w}')} - 1", f"range_position_{w}": d.div(f"Close - pl_{w}", f"ph_{w} - pl_{w}")}
    return [first, second]


LEVELS = Family("levels", _levels, tuple(f"{n}_{w}" for w in PRIOR for n in ("distance_prior_high", "distance_prior_low", "range_position")))


def _trend(d: Dialect) -> list[dict[str, str]]:
    return [
        {f"sma_{w}": rolling("avg", "Close", w) for w in TRENDS} | {"h20": rolling("max", "High", 20, prior=True), "l20": rolling("min", "Low", 20, prior=True), "gap_pct": f"{d.div('Open', lag('Close'))} - 1"},
        {f"distance_sma_{w}": f"{d.div('Close', f'sma_{w}')} - 1" for w in TRENDS} | {f"sma_{w}_slope_5": change(d, f"sma_{w}", 5) for w in TRENDS} | {"above": flag("Close > sma_20")},
        {
            "trend_persistence_20": rolling("avg", "above", 20, 5), "pullback_depth_20": f"{d.div('Close', 'h20')} - 1", "recovery_pct_20": d.div("Close - l20", "h20 - l20"),
            "support_proximity_20": f"{d.div('Close', 'l20')} - 1", "resistance_proximity_20": f"{d.div('Close', 'h20')} - 1",
        },
    ]


TREND = Family("trend", _trend, (*(f"distance_sma_{w}" for w in TRENDS), *(f"sma_{w}_slope_5" for w in TRENDS), "trend_persistence_20", "pullback_depth_20", "recovery_pct_20", "gap_pct", "support_proximity_20", "resistance_proximity_20"))


def _volatility(d: Dialect) -> list[dict[str, str]]:
    return [
        {"r1": change(d, "Close", 1), "gap_pct": f"{d.div('Open', lag('Close'))} - 1", "range_pct": d.div("High - Low", "Close")},
        {
            **{f"realized_vol_{w}": rolling("stddev_samp", "r1", w) for w in (10, 20, 63)},
            "upside_vol_20": rolling("stddev_samp", "CASE WHEN r1 > 0 THEN r1 END", 20, 5), "downside_vol_20": rolling("stddev_samp", "CASE WHEN r1 < 0 THEN r1 END", 20, 5),
            "window_63": f"{d.collected('range_pct')} OVER {frame(-62, 0)}", "overnight_gap_vol_20": rolling("stddev_samp", "gap_pct", 20),
            "range_median": rolling_percentile(d, "range_pct", 0.5, 20, 10, prior=True),
        },
        {"vol_median": rolling_percentile(d, "realized_vol_63", 0.5, 100, 40), "range_percentile_63": share_at_most(d, "window_63", "range_pct", 63, 20), "volatility_expansion_20_63": d.div("realized_vol_20", "realized_vol_63"), "intraday_range_relative_20": d.div("range_pct", "range_median")},
        {"volatility_compression_20_100": d.div("realized_vol_20", "vol_median")},
    ]


VOLATILITY = Family("volatility", _volatility, ("realized_vol_10", "realized_vol_20", "realized_vol_63", "upside_vol_20", "downside_vol_20", "range_pct", "range_percentile_63", "volatility_compression_20_100", "volatility_expansion_20_63", "overnight_gap_vol_20", "intraday_range_relative_20"))


def _volume(d: Dialect) -> list[dict[str, str]]:
    return [
        {
            "pc": lag("Close"), "vm": rolling("avg", "Volume", 20, 10, prior=True), "vs": rolling("stddev_samp", "Volume", 20, 10, prior=True), "vma": rolling("avg", "Volume", 20),
            "return_5": change(d, "Close", 5), "return_20": change(d, "Close", 20), "dollar_volume": "Close * Volume",
        },
        {
            "relative_volume_20": d.div("Volume", "vm"), "volume_zscore_20": d.div("Volume - vm", "vs"), "volume_trend_20": change(d, "vma", 5),
            "uv": "CASE WHEN Close >= pc THEN Volume ELSE CAST(0.0 AS DOUBLE) END", "dv": "CASE WHEN Close < pc THEN Volume ELSE CAST(0.0 AS DOUBLE) END",
            "step": f"coalesce({d.sign('Close - pc')}, 0.0) * Volume",
        },
        {
            "up_volume_proxy_20": rolling("sum", "uv", 20, 5), "down_volume_proxy_20": rolling("sum", "dv", 20, 5),
            "price_volume_agreement_5": f"{d.sign('return_5')} * {d.sign('volume_trend_20')}", "return_volume_interaction_20": "return_20 * relative_volume_20",
            "obv": "sum(step) OVER (PARTITION BY symbol ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
            "relvol_median": rolling_percentile(d, "relative_volume_20", 0.5, 20, 10, prior=True),
        },
        {"obv_prior": lag("obv", 20), "volume_expansion_after_compression": d.div("relative_volume_20", "relvol_median")},
        {"obv_change_20": "CASE WHEN abs(obv_prior) > 1e-12 THEN " + d.div("obv - obv_prior", "obv_prior") + " END"},
    ]


VOLUME = Family("volume", _volume, ("relative_volume_20", "volume_zscore_20", "dollar_volume", "volume_trend_20", "up_volume_proxy_20", "down_volume_proxy_20", "price_volume_agreement_5", "return_volume_interaction_20", "obv_change_20", "volume_expansion_after_compression"))


def _candles(d: Dialect) -> list[dict[str, str]]:
    return [
        {"span": "nullif(High - Low, 0)", "range_pct": d.div("High - Low", "Close")},
        {
            "body_pct": d.div("abs(Close - Open)", "span"), "upper_wick_pct": d.div("High - greatest(Open, Close)", "span"), "lower_wick_pct": d.div("least(Open, Close) - Low", "span"), "close_position": d.div("Close - Low", "span"),
            "inside_bar": flag(f"High < {lag('High')} AND Low > {lag('Low')}"), "outside_bar": flag(f"High > {lag('High')} AND Low < {lag('Low')}"), "p80": rolling_percentile(d, "range_pct", 0.8, 20, 10, prior=True),
        },
        {"expansion_bar": flag("range_pct > p80"), "lower_rejection_bar": flag("lower_wick_pct > 0.45 AND close_position > 0.55")},
    ]


CANDLES = Family("candles", _candles, ("body_pct", "upper_wick_pct", "lower_wick_pct", "close_position", "inside_bar", "outside_bar", "expansion_bar", "lower_rejection_bar"))


def _oscillators(d: Dialect) -> list[dict[str, str]]:
    return [
        {
            "roc_10": change(d, "Close", 10), "l14": rolling("min", "Low", 14, prior=True), "h14": rolling("max", "High", 14, prior=True), "m20": rolling("avg", "Close", 20), "s20": rolling("stddev_samp", "Close", 20),
            "typical": "(High + Low + Close) / 3.0",
        },
        {
            "stochastic_14": d.div("Close - l14", "h14 - l14"), "bollinger_z_20": d.div("Close - m20", "s20"), "tm": rolling("avg", "typical", 20), "flow": "typical * Volume", "tp": lag("typical"),
        },
        {"off": "abs(typical - tm)", "pos": "CASE WHEN typical > tp THEN flow ELSE CAST(0.0 AS DOUBLE) END", "neg": "CASE WHEN typical < tp THEN flow ELSE CAST(0.0 AS DOUBLE) END"},
        {"md": rolling("avg", "off", 20), "pf": rolling("sum", "pos", 14), "nf": rolling("sum", "neg", 14)},
        {"cci_20": d.div("typical - tm", "0.015 * md"), "mfi_14": f"100.0 - 100.0 / (1.0 + {d.div('pf', 'nf')})"},
    ]


OSCILLATORS = Family("oscillators", _oscillators, ("roc_10", "stochastic_14", "bollinger_z_20", "cci_20", "mfi_14"))


def _price(d: Dialect) -> list[dict[str, str]]:
    """Over bars with ``atr_14``; highs and lows are those of the rows before."""
    spans = (20, 50, 252)
    return [
        {
            **{f"sma_{w}": rolling("avg", "Close", w) for w in (20, 50, 100, 200)},
            **{f"ph_{w}": rolling("max", "High", w, prior=True) for w in spans}, **{f"pl_{w}": rolling("min", "Low", w, prior=True) for w in spans},
            "pc": lag("Close"), "vm": rolling("avg", "Volume", 20, 10, prior=True), "atr_pct_14": d.div("atr_14", "Close"), "red": flag(f"Close < {lag('Close')}"),
        },
        {
            **{f"distance_sma_{w}": f"{d.div('Close', f'sma_{w}')} - 1" for w in (20, 50, 100, 200)}, **{f"sma_{w}_slope_5": change(d, f"sma_{w}", 5) for w in (20, 50, 100, 200)},
            **{f"drawdown_from_high_{w}": f"{d.div('Close', f'ph_{w}')} - 1" for w in spans}, **{f"bounce_from_low_{w}": f"{d.div('Close', f'pl_{w}')} - 1" for w in spans},
            "window_atr": f"{d.collected('atr_pct_14')} OVER {frame(-251, 0)}", "relative_volume_20": d.div("Volume", "vm"), "gap_pct": f"{d.div('Open', 'pc')} - 1", "return_1d": f"{d.div('Close', 'pc')} - 1", "red_day": "red",
            "close_position": "CASE WHEN High - Low > 0 THEN (Close - Low) / (High - Low) ELSE CAST(0.5 AS DOUBLE) END", "pullback_count_3": rolling("sum", "red", 3), "pullback_count_5": rolling("sum", "red", 5), "failed_breakdown_20": flag("Low < pl_20 AND Close > pl_20"),
        },
        {"atr_percentile_252": share_at_most(d, "window_atr", "atr_pct_14", 252, 60)},
    ]


PRICE = Family(
    "price_action", _price,
    (*(f"{n}{w}{e}" for w in (20, 50, 100, 200) for n, e in (("sma_", ""), ("distance_sma_", ""), ("sma_", "_slope_5"))), "atr_14", "atr_pct_14", "atr_percentile_252", "relative_volume_20", "close_position", "gap_pct", "return_1d", "red_day", "pullback_count_3", "pullback_count_5",
     *(f"{n}_{w}" for w in (20, 50, 252) for n in ("drawdown_from_high", "bounce_from_low")), "failed_breakdown_20"),
)

FAMILIES = {f.name: f for f in (RETURN, MOMENTUM, LEVELS, TREND, VOLATILITY, VOLUME, CANDLES, OSCILLATORS)}
