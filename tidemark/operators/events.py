"""The append-only event log of paper trading: creation, fills, exits, marks, positions.

Every step is a set operation over events and bars: keys that the log already has are dropped by an
anti join, so a step can run again, after a failure too, and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.dialect import Dialect, lag

KEY = ("event_type", "as_of", "symbol", "direction", "model_id", "snapshot", "suffix")


def scan_rows(d: Dialect, scored: str) -> str:
    """Scanner snapshots, one a date: rows with enough probability are actionable."""
    return f"""SELECT symbol, Date AS as_of, CASE WHEN x1 >= 0 THEN 'Bullish' ELSE 'Bearish' END AS direction, scope AS model_id, concat('scan-', CAST(Date AS VARCHAR(20))) AS snapshot, CASE WHEN p >= 0.55 THEN 'ACTIONABLE' ELSE 'REJECTED' END AS status,
round(r, 6) AS expected_return, round(mfe, 6) AS expected_mfe, round(mae, 6) AS expected_mae FROM ({scored}) s"""


def unique_key() -> str:
    """What tells events apart; the suffix is the horizon, so two horizons of a signal are two positions."""
    return "concat(event_type, '|', CAST(as_of AS VARCHAR(20)), '|', upper(symbol), '|', direction, '|', model_id, '|', coalesce(snapshot, ''), '|', suffix)"


def created(d: Dialect, scored: str, horizon: int = 5) -> str:
    """Rejected rows give one event, actionable ones a signal and a pending entry with planned target and stop."""
    kinds = "SELECT 'SIGNAL_REJECTED' AS event_type, 'REJECTED' AS of_status UNION ALL SELECT 'SIGNAL_CREATED' AS event_type, 'ACTIONABLE' AS of_status UNION ALL SELECT 'ENTRY_PENDING' AS event_type, 'ACTIONABLE' AS of_status"
    return f"""SELECT event_type, symbol, as_of, direction, model_id, snapshot, {d.sha(unique_key())} AS unique_key, CASE WHEN status = 'ACTIONABLE' THEN round(greatest(expected_return, greatest(expected_mfe, 0) * 0.5, 0.005), 7) END AS planned_target, CASE WHEN status = 'ACTIONABLE' THEN round(greatest(abs(expected_mae), 0.005), 7) END AS planned_stop
FROM (SELECT *, 'h{horizon}' AS suffix FROM ({scan_rows(d, scored)}) c) s JOIN ({kinds}) k ON k.of_status = s.status"""


def fills(d: Dialect, scored: str, bars: str) -> str:
    """Pending entries filled at the open of the next session of their symbol."""
    nxt = f"SELECT symbol, Date, lead(Date) OVER (PARTITION BY symbol ORDER BY Date) AS fill_date, lead(Open) OVER (PARTITION BY symbol ORDER BY Date) AS fill_price FROM ({bars}) b"
    return f"""SELECT p.symbol, p.as_of, p.direction, p.model_id, p.unique_key AS source_key, fill_date, fill_price, CASE WHEN direction = 'Bullish' THEN fill_price * (1 + planned_target) ELSE fill_price * (1 - planned_target) END AS target_price,
CASE WHEN direction = 'Bullish' THEN fill_price * (1 - planned_stop) ELSE fill_price * (1 + planned_stop) END AS stop_price FROM ({created(d, scored)}) p JOIN ({nxt}) n ON n.symbol = p.symbol AND n.Date = p.as_of WHERE event_type = 'ENTRY_PENDING' AND fill_date IS NOT NULL"""


def exits(d: Dialect, scored: str, bars: str, horizon: int = 5) -> str:
    """The first bar that touches stop or target within the horizon, stop first; else the last close."""
    numbered = f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY Date) AS rn FROM ({bars}) b"
    held = f"""SELECT f.*, b.Date AS d, b.rn - e.rn AS k, b.Close AS c, CASE WHEN direction = 'Bullish' THEN b.Low <= stop_price ELSE b.High >= stop_price END AS at_stop, CASE WHEN direction = 'Bullish' THEN b.High >= target_price ELSE b.Low <= target_price END AS at_target
FROM ({fills(d, scored, bars)}) f JOIN ({numbered}) e ON e.symbol = f.symbol AND e.Date = f.fill_date JOIN ({numbered}) b ON b.symbol = f.symbol AND b.rn BETWEEN e.rn AND e.rn + {horizon} - 1"""
    ranked = f"SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY CASE WHEN at_stop OR at_target THEN 0 ELSE 1 END, CASE WHEN at_stop OR at_target THEN k ELSE -k END) AS pick FROM ({held}) h"
    price = "CASE WHEN at_stop THEN stop_price WHEN at_target THEN target_price ELSE c END"
    return f"""SELECT symbol, as_of, direction, source_key, fill_date, d AS exit_date, CASE WHEN at_stop AND at_target THEN 'stop_intraday_ambiguous' WHEN at_stop THEN 'stop' WHEN at_target THEN 'target' ELSE 'time_exit' END AS reason, round({price}, 3) AS exit_price,
round(CASE WHEN direction = 'Bullish' THEN {price} / fill_price - 1 ELSE fill_price / ({price}) - 1 END, 8) AS gross_return, round(CASE WHEN direction = 'Bullish' THEN {price} / fill_price - 1 ELSE fill_price / ({price}) - 1 END - 0.0005, 8) AS net_return FROM ({ranked}) r WHERE pick = 1"""


def marks(d: Dialect, scored: str, bars: str, horizon: int = 5) -> str:
    """Daily marks of filled positions with running excursions."""
    numbered = f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY Date) AS rn FROM ({bars}) b"
    run = "OVER (PARTITION BY source_key ORDER BY b.rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""SELECT f.symbol, f.source_key, b.Date AS mark_date, round(CASE WHEN direction = 'Bullish' THEN b.Close / fill_price - 1 ELSE fill_price / b.Close - 1 END, 6) AS mark_return, round(CASE WHEN direction = 'Bullish' THEN max(b.High) {run} / fill_price - 1 ELSE fill_price / min(b.Low) {run} - 1 END, 6) AS mfe,
round(CASE WHEN direction = 'Bullish' THEN min(b.Low) {run} / fill_price - 1 ELSE fill_price / max(b.High) {run} - 1 END, 6) AS mae FROM ({fills(d, scored, bars)}) f JOIN ({numbered}) e ON e.symbol = f.symbol AND e.Date = f.fill_date JOIN ({numbered}) b ON b.symbol = f.symbol AND b.rn BETWEEN e.rn AND e.rn + {horizon} - 1"""


def counts(d: Dialect, scored: str, bars: str) -> str:
    return f"SELECT event_type, count(*) AS n, count(DISTINCT symbol) AS n_symbols, count(DISTINCT {d.ym('as_of')}) AS n_months FROM ({created(d, scored)}) c GROUP BY event_type"


def sample_state(d: Dialect, scored: str, bars: str) -> str:
    """How large the matured sample is, and whether it suffices."""
    q = f"SELECT count(*) AS matured, count(DISTINCT as_of) AS dates, count(DISTINCT {d.ym('as_of')}) AS months, count(CASE WHEN net_return > 0 THEN 1 END) AS wins FROM ({exits(d, scored, bars)}) e"
    p = f"SELECT count(*) AS pending FROM ({created(d, scored)}) c WHERE event_type = 'ENTRY_PENDING'"
    return f"SELECT matured, dates, months, wins, pending - matured AS open_or_blocked, CASE WHEN matured >= 100 AND dates >= 40 AND months >= 6 AND wins >= 20 AND matured - wins >= 20 THEN 'SUFFICIENT' ELSE 'INSUFFICIENT' END AS state FROM ({q}) q CROSS JOIN ({p}) p"


VIEWS = {"created": lambda d, s, b: created(d, s), "fills": lambda d, s, b: f"SELECT symbol, as_of, direction, source_key, fill_date, round(fill_price, 8) AS fill_price, round(target_price, 2) AS target_price, round(stop_price, 2) AS stop_price FROM ({fills(d, s, b)}) f", "exits": exits, "marks": marks, "counts": counts, "sample_state": sample_state}


def appended(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with those new events whose key it lacks; of equal new keys one stays."""
    fresh = new.join(log.select("unique_key"), "unique_key", "left_anti")
    first = Window.partitionBy("unique_key").orderBy(*log.columns)  # of equal keys the smallest row, whatever the order they come in
    fresh = fresh.withColumn("rk_", F.row_number().over(first)).filter("rk_ = 1")
    return log.unionByName(fresh.select(*log.columns))


def positions(log: DataFrame) -> DataFrame:
    """Current state of each position by replay: the last event wins (time, then key)."""
    last = F.struct("event_time", "unique_key")
    return log.groupBy("position_id").agg(F.max_by("event_type", last).alias("state"), F.max("event_time").alias("since"), F.count("*").alias("n_events"))
