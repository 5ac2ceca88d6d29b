"""Forward-looking outcome labels of bars: returns, excursions, first touches, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions.dialect import Dialect, flag, frame, lag, lead
from tidemark.plans.staged import Family

HORIZONS = (3, 5, 10, 20, 40)


def _labels(h: int):
    def stages(d: Dialect) -> list[dict[str, str]]:
        return [
            {"entry": lead("Open"), "exit_close": lead("Close", h), "fh": f"max(High) OVER {frame(1, h)}", "fl": f"min(Low) OVER {frame(1, h)}", "chg": f"{d.div('Close', lag('Close', h))} - 1", "chg5": f"{d.div('Close', lag('Close', 5))} - 1", "label_end_date": lead("Date", h)},
            {"bull": f"{d.div('exit_close', 'entry')} - 1", "bear": f"{d.div('entry', 'exit_close')} - 1", "med": f"CASE WHEN count(chg) OVER {frame(-251, 0)} >= 60 THEN {d.percentile('chg', 0.5)} OVER {frame(-251, 0)} END"},
            {
                f"label_bull_forward_return_{h}": "bull", f"label_bear_forward_return_{h}": "bear", f"label_bull_positive_return_{h}": flag("bull > 0"), f"label_bear_positive_return_{h}": flag("bear > 0"),
                f"label_bull_mfe_{h}": f"{d.div('fh', 'entry')} - 1", f"label_bull_mae_{h}": f"{d.div('fl', 'entry')} - 1", f"label_bear_mfe_{h}": f"{d.div('entry', 'fl')} - 1", f"label_bear_mae_{h}": f"{d.div('entry', 'fh')} - 1",
                f"label_bull_continuation_{h}": flag("bull > med"), f"label_bear_continuation_{h}": flag("bear > -med"), f"label_bull_reversal_{h}": flag("chg5 < 0 AND bull > 0"), f"label_bear_reversal_{h}": flag("chg5 > 0 AND bear > 0"),
            },
        ]

    names = [f"label_{s}_{n}_{h}" for n in ("forward_return", "positive_return", "mfe", "mae", "continuation", "reversal") for s in ("bull", "bear")]
    return Family(f"labels_{h}", stages, tuple(names), ("symbol", "Date", "label_end_date"))


LABELS = {h: _labels(h) for h in HORIZONS}


def _touch(h: int, target: float = 2.0, stop: float = 1.0):
    """First touches of target and stop, given a column ``label_atr_14``; a bar that touches both counts as stop."""

    def stages(d: Dialect) -> list[dict[str, str]]:
        def hit(cond: str) -> str:
            return d.first_index("path", cond)

        def side(name: str, t: str, s: str) -> dict[str, str]:
            first = f"coalesce(least(coalesce({t}, {s}), coalesce({s}, {t})), 0)"
            return {
                f"{name}_target_before_stop": f"CASE WHEN whole THEN {flag(f'{t} IS NOT NULL AND ({s} IS NULL OR {t} < {s})')} END",
                f"{name}_stop_before_target": f"CASE WHEN whole THEN {flag(f'{s} IS NOT NULL AND ({t} IS NULL OR {s} <= {t})')} END",
                f"{name}_time_to_target": f"CASE WHEN whole AND {t} = {first} THEN CAST({t} AS DOUBLE) END",
                f"{name}_time_to_stop": f"CASE WHEN whole AND {s} = {first} THEN CAST({s} AS DOUBLE) END",
            }

        pair = "struct(High, Low)" if d.spark else "{'High': High, 'Low': Low}"
        return [
            {"opens": lead("Open"), "path": f"{d.collected(pair)} OVER {frame(1, h)}", "whole": f"{lead('Close', h)} IS NOT NULL"},
            {"bt": hit(f"e.High >= opens + {target} * label_atr_14"), "bs": hit(f"e.Low <= opens - {stop} * label_atr_14"), "rt": hit(f"e.Low <= opens - {target} * label_atr_14"), "rs": hit(f"e.High >= opens + {stop} * label_atr_14")},
            side("bull", "bt", "bs") | side("bear", "rt", "rs"),
        ]

    return Family(f"touch_{h}", stages, tuple(f"{s}_{n}" for s in ("bull", "bear") for n in ("target_before_stop", "stop_before_target", "time_to_target", "time_to_stop")))


TOUCH = {h: _touch(h) for h in HORIZONS}


def _legacy(h: int):
    """Labels masked unless the whole forward window exists; targets of 3 and 5 percent."""

    def stages(d: Dialect) -> list[dict[str, str]]:
        return [
            {"entry": lead("Open"), "exit_close": lead("Close", h), "fh": f"max(High) OVER {frame(1, h)}", "fl": f"min(Low) OVER {frame(1, h)}"},
            {"ret": "CASE WHEN exit_close IS NOT NULL THEN " + d.div("exit_close", "entry") + " - 1 END", "mfe": "CASE WHEN exit_close IS NOT NULL THEN " + d.div("fh", "entry") + " - 1 END", "mae": "CASE WHEN exit_close IS NOT NULL THEN " + d.div("fl", "entry") + " - 1 END"},
            {"positive": "CASE WHEN ret IS NOT NULL THEN CAST(ret > 0 AS INT) END", "hit_3pct": "CASE WHEN mfe IS NOT NULL THEN CAST(mfe >= 0.03 AS INT) END", "hit_5pct": "CASE WHEN mfe IS NOT NULL THEN CAST(mfe >= 0.05 AS INT) END"},
        ]

    return Family(f"legacy_labels_{h}", stages, ("ret", "mfe", "mae", "positive", "hit_3pct", "hit_5pct"))


LEGACY = {h: _legacy(h) for h in (5, 10)}


# Target and stop of each policy in multiples of the average range, its horizon, cost of a round trip.
POLICIES = ((2.0, 1.0), (2.0, 1.25), (2.0, 1.5), (2.0, 2.0))
POLICY_HORIZON, COST, LEAST_RANGE = 20, 0.0005, 1e-6


def policy_outcomes(bars: DataFrame, h: int = POLICY_HORIZON) -> DataFrame:
    """What each policy made of a purchase at the next open: a row for each policy and bar (with ``label_atr_14``).

    Where the horizon is not over, everything but the prices is null. Times count bars from 1."""
    w = frame(1, h)
    policies = ", ".join(f"struct(CAST({t} AS DOUBLE) AS target_multiple, CAST({s} AS DOUBLE) AS stop_multiple)" for t, s in POLICIES)
    paths = bars.selectExpr("symbol", "Date", "label_atr_14", f"{lead('Open')} AS entry_price", f"{lead('Close', h)} AS last_close", f"collect_list(High) OVER {w} AS highs", f"collect_list(Low) OVER {w} AS lows")
    rows = paths.selectExpr("*", f"inline(array({policies}))").selectExpr("*", "entry_price + target_multiple * label_atr_14 AS target_price", "entry_price - stop_multiple * label_atr_14 AS stop_price", "array_max(highs) AS top", "array_min(lows) AS bottom")
    rows = rows.selectExpr("*", "nullif(array_position(transform(highs, x -> x >= target_price), true), 0) AS t", "nullif(array_position(transform(lows, x -> x <= stop_price), true), 0) AS s", "try_divide(last_close, entry_price) - 1 AS forward_return")
    rows = rows.selectExpr("*", "t IS NOT NULL AND (s IS NULL OR t < s) AS hit", "s IS NOT NULL AND (t IS NULL OR s <= t) AS stopped")
    known = {
        "target_before_stop": "CAST(hit AS INT) * 1.0D", "stop_before_target": "CAST(stopped AS INT) * 1.0D", "unresolved": "CAST(NOT (hit OR stopped) AS INT) * 1.0D", "forward_return": "forward_return", "mfe": "try_divide(top, entry_price) - 1", "mae": "try_divide(bottom, entry_price) - 1",
        "time_to_target": "CASE WHEN s IS NULL OR t <= s THEN t END * 1.0D", "time_to_stop": "CASE WHEN t IS NULL OR s <= t THEN s END * 1.0D", "time_to_max_favorable": "array_position(highs, top) * 1.0D", "time_to_max_adverse": "array_position(lows, bottom) * 1.0D",
        "profitable_at_time_exit": "CAST(NOT (hit OR stopped) AND forward_return > 0 AS INT) * 1.0D", "profitable_despite_failed_tbs": "CAST(NOT hit AND forward_return > 0 AS INT) * 1.0D",
    }
    return rows.selectExpr("symbol", "Date", "target_multiple", "stop_multiple", "entry_price", "target_price", "stop_price", *(f"CASE WHEN last_close IS NOT NULL THEN {e} END AS {n}" for n, e in known.items()))


def time_exit_utility(outcomes: DataFrame) -> DataFrame:
    """Net return at the time exit over the larger of adverse excursion and average range, its quality, and
    whether a position that failed its target, or fell below its stop, was profitable after all."""
    from tidemark.operators.governance import exit_bucket

    rows = outcomes.selectExpr("*", f"forward_return - {COST} AS net_return", "try_divide(abs(entry_price - stop_price), entry_price) AS stop_distance_pct", "try_divide(try_divide(abs(entry_price - stop_price), stop_multiple), entry_price) AS atr_pct")
    return rows.selectExpr(
        "symbol", "Date", "target_multiple", "stop_multiple", "net_return", f"net_return / greatest(coalesce(abs(mae), 0), coalesce(atr_pct, 0), {LEAST_RANGE}) AS utility", f"{exit_bucket('net_return')} AS bucket", "CAST(coalesce(net_return > 0, false) AS INT) AS positive_after_cost",
        "CAST(coalesce(target_before_stop = 0 AND net_return > 0, false) AS INT) AS profitable_despite_failed_tbs", "CAST(coalesce(stop_distance_pct > 0 AND mae <= -stop_distance_pct AND net_return > 0, false) AS INT) AS early_adverse_recovery",
    ).filter("net_return IS NOT NULL")
