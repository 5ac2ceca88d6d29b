"""Oracles written by hand for DuckDB: they share no text with what Spark runs, and use other constructions
where there are any (joins of numbered bars in place of frames, recursive queries in place of grouped functions)."""

from __future__ import annotations

from tidemark.sources.bars import oracle_bars

BARS = f"bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY Date) AS rn FROM ({oracle_bars()}))"
#: True ranges, and their exponential mean that begins with the first one.
RANGES = f"""{BARS}, tr AS (SELECT b.*, p.Close AS pc, greatest(b.High - b.Low, coalesce(abs(b.High - p.Close), 0), coalesce(abs(b.Low - p.Close), 0)) AS tr FROM bars b LEFT JOIN bars p ON p.symbol = b.symbol AND p.rn = b.rn - 1),
ew AS (SELECT symbol, rn, tr AS state FROM tr WHERE rn = 1 UNION ALL SELECT e.symbol, t.rn, e.state * 13.0 / 14 + t.tr / 14 FROM ew e JOIN tr t ON t.symbol = e.symbol AND t.rn = e.rn + 1),
ranged AS (SELECT t.*, CASE WHEN t.rn >= 14 THEN state END AS atr FROM tr t JOIN ew USING (symbol, rn))"""
#: Wilder's mean of true ranges over 14 bars: the mean of the first 14, then recursive.
WILDER = """wi AS (SELECT symbol, 14::BIGINT AS rn, avg(tr) AS state FROM tr WHERE rn <= 14 GROUP BY symbol HAVING count(*) = 14
UNION ALL SELECT w.symbol, t.rn, (w.state * 13 + t.tr) / 14 FROM wi w JOIN tr t ON t.symbol = w.symbol AND t.rn = w.rn + 1)"""


def price_action() -> str:
    sma = ", ".join(f"CASE WHEN rn >= {w} THEN avg(Close) OVER (win ROWS {w - 1} PRECEDING) END AS sma_{w}" for w in (20, 50, 100, 200))
    prior = ", ".join(f"CASE WHEN rn > {w} THEN max(High) OVER (win ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) END AS ph_{w}, CASE WHEN rn > {w} THEN min(Low) OVER (win ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) END AS pl_{w}" for w in (20, 50, 252))
    late = ", ".join(f"round(sma_{w}, 6) AS sma_{w}, round(Close / sma_{w} - 1, 6) AS distance_sma_{w}, round(sma_{w} / lag(sma_{w}, 5) OVER win - 1, 6) AS sma_{w}_slope_5" for w in (20, 50, 100, 200))
    ends = ", ".join(f"round(Close / ph_{w} - 1, 6) AS drawdown_from_high_{w}, round(Close / pl_{w} - 1, 6) AS bounce_from_low_{w}" for w in (20, 50, 252))
    return f"""WITH RECURSIVE {RANGES}, {WILDER},
x AS (SELECT t.*, wi.state AS atr_14, wi.state / t.Close AS atr_pct_14, (coalesce(t.Close < pc, false))::INT::DOUBLE AS red, {sma}, {prior}, CASE WHEN rn > 10 THEN avg(Volume) OVER (win ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS vm FROM tr t LEFT JOIN wi USING (symbol, rn) WINDOW win AS (PARTITION BY symbol ORDER BY rn)),
shares AS (SELECT a.symbol, a.rn, count(b.atr_pct_14) AS known, count(*) AS n, count(*) FILTER (WHERE b.atr_pct_14 <= a.atr_pct_14) AS below FROM x a JOIN x b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - 251 AND a.rn GROUP BY a.symbol, a.rn)
SELECT symbol, Date, {late}, round(atr_14, 6) AS atr_14, round(atr_pct_14, 6) AS atr_pct_14, CASE WHEN known >= 60 THEN round(below / n, 6) END AS atr_percentile_252, round(Volume / vm, 6) AS relative_volume_20, round(CASE WHEN High > Low THEN (Close - Low) / (High - Low) ELSE 0.5::DOUBLE END, 6) AS close_position,
round(Open / pc - 1, 6) AS gap_pct, round(Close / pc - 1, 6) AS return_1d, red AS red_day, CASE WHEN rn >= 3 THEN sum(red) OVER (win ROWS 2 PRECEDING) END AS pullback_count_3, CASE WHEN rn >= 5 THEN sum(red) OVER (win ROWS 4 PRECEDING) END AS pullback_count_5, {ends}, coalesce(Low < pl_20 AND Close > pl_20, false)::INT::DOUBLE AS failed_breakdown_20
FROM x JOIN shares USING (symbol, rn) WINDOW win AS (PARTITION BY symbol ORDER BY rn)"""


def first_touch(h: int) -> str:
    def side(name: str, sign: int) -> str:
        up, down = ("f.High", "f.Low") if sign > 0 else ("f.Low", "f.High")
        more, less = (">=", "<=") if sign > 0 else ("<=", ">=")
        return f"min(f.rn - b.rn) FILTER (WHERE {up} {more} n.Open + {2 * sign} * b.atr) AS {name}_t, min(f.rn - b.rn) FILTER (WHERE {down} {less} n.Open - {sign} * b.atr) AS {name}_s"

    def out(s: str) -> str:
        return f"CASE WHEN whole THEN coalesce({s}_t < coalesce({s}_s, 999), false)::INT::DOUBLE END AS {s}_target_before_stop, CASE WHEN whole THEN coalesce({s}_s <= coalesce({s}_t, 999), false)::INT::DOUBLE END AS {s}_stop_before_target, CASE WHEN whole AND {s}_t <= coalesce({s}_s, 999) THEN {s}_t::DOUBLE END AS {s}_time_to_target, CASE WHEN whole AND {s}_s <= coalesce({s}_t, 999) THEN {s}_s::DOUBLE END AS {s}_time_to_stop"

    return f"""WITH RECURSIVE {RANGES}, hit AS (SELECT b.symbol, b.Date, count(f.rn) = {h} AS whole, {side('bull', 1)}, {side('bear', -1)} FROM ranged b LEFT JOIN bars n ON n.symbol = b.symbol AND n.rn = b.rn + 1 LEFT JOIN bars f ON f.symbol = b.symbol AND f.rn BETWEEN b.rn + 1 AND b.rn + {h} GROUP BY b.symbol, b.Date)
SELECT symbol, Date, {out('bull')}, {out('bear')} FROM hit"""


def labels(h: int) -> str:
    return f"""WITH {BARS}, past AS (SELECT b.*, b.Close / p.Close - 1 AS chg, b.Close / q.Close - 1 AS chg5 FROM bars b LEFT JOIN bars p ON p.symbol = b.symbol AND p.rn = b.rn - {h} LEFT JOIN bars q ON q.symbol = b.symbol AND q.rn = b.rn - 5),
mid AS (SELECT a.symbol, a.rn, CASE WHEN count(b.chg) >= 60 THEN quantile_cont(b.chg, 0.5) END AS med FROM past a JOIN past b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - 251 AND a.rn GROUP BY a.symbol, a.rn),
path AS (SELECT b.symbol, b.rn, max(f.High) AS top, min(f.Low) AS bottom FROM bars b LEFT JOIN bars f ON f.symbol = b.symbol AND f.rn > b.rn AND f.rn <= b.rn + {h} GROUP BY b.symbol, b.rn),
r AS (SELECT p.*, e.Date AS label_end_date, e.Close / n.Open - 1 AS bull, n.Open / e.Close - 1 AS bear, top, bottom, n.Open AS entry, med FROM past p JOIN mid USING (symbol, rn) JOIN path USING (symbol, rn) LEFT JOIN bars n ON n.symbol = p.symbol AND n.rn = p.rn + 1 LEFT JOIN bars e ON e.symbol = p.symbol AND e.rn = p.rn + {h})
SELECT symbol, Date, label_end_date, round(bull, 6) AS label_bull_forward_return_{h}, round(bear, 6) AS label_bear_forward_return_{h}, coalesce(bull > 0, false)::INT::DOUBLE AS label_bull_positive_return_{h}, coalesce(bear > 0, false)::INT::DOUBLE AS label_bear_positive_return_{h},
round(top / entry - 1, 6) AS label_bull_mfe_{h}, round(entry / bottom - 1, 6) AS label_bear_mfe_{h}, round(bottom / entry - 1, 6) AS label_bull_mae_{h}, round(entry / top - 1, 6) AS label_bear_mae_{h}, coalesce(bull > med, false)::INT::DOUBLE AS label_bull_continuation_{h}, coalesce(bear > -med, false)::INT::DOUBLE AS label_bear_continuation_{h},
coalesce(chg5 < 0 AND bull > 0, false)::INT::DOUBLE AS label_bull_reversal_{h}, coalesce(chg5 > 0 AND bear > 0, false)::INT::DOUBLE AS label_bear_reversal_{h} FROM r"""


def _outcomes(h: int = 20) -> str:
    return f"""WITH RECURSIVE {RANGES}, policies AS (SELECT * FROM (VALUES (2.0::DOUBLE, 1.0::DOUBLE), (2.0, 1.25), (2.0, 1.5), (2.0, 2.0)) v(target_multiple, stop_multiple)),
p AS (SELECT b.symbol, b.Date, b.rn, target_multiple, stop_multiple, n.Open AS entry_price, n.Open + target_multiple * b.atr AS target_price, n.Open - stop_multiple * b.atr AS stop_price, e.Close / n.Open - 1 AS forward_return, e.rn IS NOT NULL AS whole FROM ranged b CROSS JOIN policies LEFT JOIN bars n ON n.symbol = b.symbol AND n.rn = b.rn + 1 LEFT JOIN bars e ON e.symbol = b.symbol AND e.rn = b.rn + {h}),
t AS (SELECT p.symbol, p.Date, target_multiple, stop_multiple, min(f.rn - p.rn) FILTER (WHERE f.High >= target_price) AS t, min(f.rn - p.rn) FILTER (WHERE f.Low <= stop_price) AS s, max(f.High) AS top, min(f.Low) AS bottom, arg_max(f.rn - p.rn, (f.High, -f.rn)) AS peak, arg_min(f.rn - p.rn, (f.Low, f.rn)) AS trough FROM p JOIN bars f ON f.symbol = p.symbol AND f.rn BETWEEN p.rn + 1 AND p.rn + {h} WHERE whole GROUP BY ALL),
o AS (SELECT p.*, t.* EXCLUDE (symbol, Date, target_multiple, stop_multiple), coalesce(t < coalesce(s, 999), false) AS hit, coalesce(s <= coalesce(t, 999), false) AS stopped FROM p LEFT JOIN t USING (symbol, Date, target_multiple, stop_multiple))"""


def policy_outcomes() -> str:
    return f"""{_outcomes()} SELECT symbol, Date, target_multiple, stop_multiple, round(entry_price, 8) AS entry_price, round(target_price, 2) AS target_price, round(stop_price, 2) AS stop_price, CASE WHEN whole THEN hit::INT::DOUBLE END AS target_before_stop, CASE WHEN whole THEN stopped::INT::DOUBLE END AS stop_before_target, CASE WHEN whole THEN (NOT hit AND NOT stopped)::INT::DOUBLE END AS unresolved,
round(forward_return, 6) AS forward_return, round(top / entry_price - 1, 6) AS mfe, round(bottom / entry_price - 1, 6) AS mae, CASE WHEN t <= coalesce(s, 999) THEN t::DOUBLE END AS time_to_target, CASE WHEN s <= coalesce(t, 999) THEN s::DOUBLE END AS time_to_stop, peak::DOUBLE AS time_to_max_favorable, trough::DOUBLE AS time_to_max_adverse,
CASE WHEN whole THEN (NOT hit AND NOT stopped AND forward_return > 0)::INT::DOUBLE END AS profitable_at_time_exit, CASE WHEN whole THEN (NOT hit AND forward_return > 0)::INT::DOUBLE END AS profitable_despite_failed_tbs FROM o"""


def exit_utility() -> str:
    return f"""{_outcomes()}, u AS (SELECT *, forward_return - 0.0005 AS net_return, (entry_price - stop_price) / entry_price AS distance, bottom / entry_price - 1 AS mae FROM o WHERE whole)
SELECT symbol, Date, target_multiple, stop_multiple, round(net_return, 6) AS net_return, round(net_return / greatest(abs(mae), coalesce(distance / stop_multiple, 0), 1e-6), 4) AS utility,
CASE WHEN net_return >= 0.02 THEN 'STRONG_POSITIVE_TIME_EXIT' WHEN net_return > 0 THEN 'MODEST_POSITIVE_TIME_EXIT' WHEN net_return >= -0.002 THEN 'FLAT_TIME_EXIT' WHEN net_return > -0.05 THEN 'NEGATIVE_TIME_EXIT' ELSE 'SEVERE_NEGATIVE_TIME_EXIT' END AS bucket, (net_return > 0)::INT AS positive_after_cost,
(NOT hit AND net_return > 0)::INT AS profitable_despite_failed_tbs, coalesce(distance > 0 AND mae <= -distance AND net_return > 0, false)::INT AS early_adverse_recovery FROM u"""


def returns() -> str:
    ks = (1, 2, 3, 5, 10, 20, 40, 63, 126, 252)
    joins = " ".join(f"LEFT JOIN bars b{k} ON b{k}.symbol = b.symbol AND b{k}.rn = b.rn - {k}" for k in ks)
    return f"WITH {BARS} SELECT b.symbol, b.Date, {', '.join(f'round(b.Close / b{k}.Close - 1, 6) AS return_{k}, round(ln(b.Close / b{k}.Close), 6) AS log_return_{k}' for k in ks)} FROM bars b {joins}"


def trend() -> str:
    ws = (10, 20, 50, 100, 200)
    frames = " ".join(f"LEFT JOIN LATERAL (SELECT avg(f.Close) AS m FROM bars f WHERE f.symbol = b.symbol AND f.rn > b.rn - {w} AND f.rn <= b.rn) m{w} ON b.rn >= {w}" for w in ws)
    return f"""WITH {BARS}, m AS (SELECT b.*, {', '.join(f'm{w}.m AS m{w}' for w in ws)}, p.h, p.l FROM bars b {frames} LEFT JOIN LATERAL (SELECT max(f.High) AS h, min(f.Low) AS l FROM bars f WHERE f.symbol = b.symbol AND f.rn >= b.rn - 20 AND f.rn < b.rn) p ON b.rn > 20)
SELECT a.symbol, a.Date, {', '.join(f'round(a.Close / a.m{w} - 1, 6) AS distance_sma_{w}, round(a.m{w} / z.m{w} - 1, 6) AS sma_{w}_slope_5' for w in ws)}, CASE WHEN a.rn >= 5 THEN round(k.up, 6) END AS trend_persistence_20, round(a.Close / a.h - 1, 6) AS pullback_depth_20, round((a.Close - a.l) / nullif(a.h - a.l, 0), 6) AS recovery_pct_20,
round(a.Open / y.Close - 1, 6) AS gap_pct, round(a.Close / a.l - 1, 6) AS support_proximity_20, round(a.Close / a.h - 1, 6) AS resistance_proximity_20 FROM m a LEFT JOIN m z ON z.symbol = a.symbol AND z.rn = a.rn - 5 LEFT JOIN bars y ON y.symbol = a.symbol AND y.rn = a.rn - 1
LEFT JOIN LATERAL (SELECT avg(coalesce(f.Close > f.m20, false)::INT) AS up FROM m f WHERE f.symbol = a.symbol AND f.rn > a.rn - 20 AND f.rn <= a.rn) k ON true"""


def candles() -> str:
    return f"""WITH {BARS}, s AS (SELECT b.*, p.High AS ph, p.Low AS pl, (b.High - b.Low) / b.Close AS span FROM bars b LEFT JOIN bars p ON p.symbol = b.symbol AND p.rn = b.rn - 1),
q AS (SELECT a.symbol, a.rn, CASE WHEN count(*) >= 10 THEN quantile_cont(f.span, 0.8) END AS p80 FROM s a JOIN s f ON f.symbol = a.symbol AND f.rn BETWEEN a.rn - 20 AND a.rn - 1 GROUP BY a.symbol, a.rn)
SELECT symbol, Date, round(abs(Close - Open) / nullif(High - Low, 0), 6) AS body_pct, round((High - greatest(Open, Close)) / nullif(High - Low, 0), 6) AS upper_wick_pct, round((least(Open, Close) - Low) / nullif(High - Low, 0), 6) AS lower_wick_pct, round((Close - Low) / nullif(High - Low, 0), 6) AS close_position,
coalesce(High < ph AND Low > pl, false)::INT::DOUBLE AS inside_bar, coalesce(High > ph AND Low < pl, false)::INT::DOUBLE AS outside_bar, coalesce(span > p80, false)::INT::DOUBLE AS expansion_bar, coalesce((least(Open, Close) - Low) / nullif(High - Low, 0) > 0.45 AND (Close - Low) / nullif(High - Low, 0) > 0.55, false)::INT::DOUBLE AS lower_rejection_bar FROM s LEFT JOIN q USING (symbol, rn)"""


#: Bars with the returns, the mean and the prior extremes that the cross-section looks at, by joins.
CROSS = f"""{BARS}, cs AS (SELECT b.symbol, b.Date, b.Volume, b.Close / p1.Close - 1 AS r1, b.Close / p5.Close - 1 AS r5, b.Close / p20.Close - 1 AS r20, b.Close / p63.Close - 1 AS r63, CASE WHEN b.rn >= 50 THEN b.Close > m.mean END AS above, CASE WHEN b.rn > 20 THEN b.Close >= x.top END AS at_high, CASE WHEN b.rn > 20 THEN b.Close <= x.bottom END AS at_low
FROM bars b {' '.join(f'LEFT JOIN bars p{k} ON p{k}.symbol = b.symbol AND p{k}.rn = b.rn - {k}' for k in (1, 5, 20, 63))} LEFT JOIN LATERAL (SELECT avg(f.Close) AS mean FROM bars f WHERE f.symbol = b.symbol AND f.rn > b.rn - 50 AND f.rn <= b.rn) m ON true LEFT JOIN LATERAL (SELECT max(f.High) AS top, min(f.Low) AS bottom FROM bars f WHERE f.symbol = b.symbol AND f.rn >= b.rn - 20 AND f.rn < b.rn) x ON true)"""


def part(test: str) -> str:
    """Share of rows where a test holds; where it is unknown it does not."""
    return f"avg(coalesce({test}, false)::INT)"


def place(table: str, value: str, keys: str, name: str) -> str:
    """Average place of a value among those of its group, over their number, by counting smaller and equal ones."""
    return f"{name} AS (SELECT {', '.join(f'a.{k}' for k in keys.split())}, (count(*) FILTER (WHERE b.{value} < a.{value}) + (count(*) FILTER (WHERE b.{value} = a.{value}) + 1) / 2.0) / count(b.{value})::DOUBLE AS v FROM {table} a JOIN {table} b ON b.Date = a.Date WHERE a.{value} IS NOT NULL GROUP BY {', '.join(f'a.{k}' for k in keys.split())})"


def strength_ranks() -> str:
    ks = (5, 20, 63)
    return f"WITH {CROSS}, {', '.join(place('cs', f'r{k}', 'symbol Date', f'k{k}') for k in ks)} SELECT symbol, Date, {', '.join(f'round(k{k}.v, 6) AS relative_strength_rank_{k}' for k in ks)} FROM cs {' '.join(f'LEFT JOIN k{k} USING (symbol, Date)' for k in ks)}"


def breadth() -> str:
    return f"""WITH {CROSS} SELECT Date, round({part('r1 > 0')}, 6) AS breadth_advance_pct, round(coalesce(sum(Volume) FILTER (WHERE r1 > 0), 0) / sum(Volume), 6) AS breadth_up_volume_pct, round({part('above')}, 6) AS breadth_above_sma_50_pct, round({part('at_high')}, 6) AS breadth_high_20_pct, round({part('at_low')}, 6) AS breadth_low_20_pct,
round(stddev_samp(r20), 6) AS breadth_dispersion_20, round(skewness(r20), 4) AS breadth_skew_20 FROM cs GROUP BY Date"""


def sectors(universe: str) -> str:
    return f"""WITH {CROSS}, sd AS (SELECT Date, sector, {part('r1 > 0')} AS advance, {part('above')} AS participation, avg(r20) AS momentum FROM cs JOIN ({universe}) u USING (symbol) WHERE sector IS NOT NULL GROUP BY Date, sector), {place('sd', 'momentum', 'Date sector', 'k')}
SELECT Date, sector, round(advance, 6) AS sector_breadth_advance_pct, round(participation, 6) AS sector_participation_sma50_pct, round(momentum, 6) AS sector_momentum_mean_20, round(k.v, 6) AS sector_momentum_rank_20 FROM sd LEFT JOIN k USING (Date, sector)"""


def forward_log(prefix: str = "", sessions: str | None = None, bars: str = "plain") -> str:
    """Tables sig, path, pos and events of the forward log, over scored and plain: joins of numbered bars."""
    only = f"WHERE s.Date IN ({sessions})" if sessions else ""
    sha = lambda kind, when, suffix: f"sha256(concat_ws('|', '{prefix}{kind}', CAST({when} AS VARCHAR), upper(symbol), direction, model_id, snapshot, {suffix}))"
    row = lambda kind, when, suffix, source="NULL::VARCHAR", price="NULL::DOUBLE", tp="NULL::DOUBLE", sp="NULL::DOUBLE", mark="NULL::DOUBLE", mfe="NULL::DOUBLE", mae="NULL::DOUBLE", why="NULL::VARCHAR", gross="NULL::DOUBLE", net="NULL::DOUBLE": f"SELECT '{prefix}{kind}' AS event_type, {when} AS as_of, symbol, direction, model_id, snapshot, {sha(kind, when, suffix)} AS unique_key, {source} AS source_key, 5 AS horizon, {price} AS price, {tp} AS target_price, {sp} AS stop_price, {mark} AS mark_return, {mfe} AS mfe, {mae} AS mae, {why} AS reason, {gross} AS gross_return, {net} AS net_return"
    return f"""nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY Date) AS rn FROM {bars}),
sig AS (SELECT s.symbol, s.Date AS sd, CASE WHEN x1 >= 0 THEN 'Bullish' ELSE 'Bearish' END AS direction, CASE WHEN x1 >= 0 THEN 1 ELSE -1 END AS side, scope AS model_id, 'scan-' || CAST(s.Date AS VARCHAR) AS snapshot, (CASE WHEN x1 >= 0 THEN p ELSE 1 - p END) >= 0.55 AS live,
greatest(er, greatest(emfe, 0) * 0.5, 0.005) AS up, greatest(abs(emae), 0.005) AS down, b.rn FROM scored s JOIN nb b ON b.symbol = s.symbol AND b.Date = s.Date {only}),
pos AS (SELECT *, {sha("ENTRY_PENDING", "sd", "'h5'")} AS id FROM (SELECT g.*, e.Date AS ed, e.Open AS entry, e.Open * (1 + side * up) AS tp, e.Open * (1 - side * down) AS sp FROM sig g LEFT JOIN nb e ON e.symbol = g.symbol AND e.rn = g.rn + 1 WHERE live)),
held AS (SELECT p.*, b.rn - p.rn AS k, b.Date AS bd, b.High AS hi, b.Low AS lo, b.Close AS c, CASE WHEN side > 0 THEN b.Low <= sp ELSE b.High >= sp END AS at_s, CASE WHEN side > 0 THEN b.High >= tp ELSE b.Low <= tp END AS at_t FROM pos p JOIN nb b ON b.symbol = p.symbol AND b.rn BETWEEN p.rn + 1 AND p.rn + 5),
ends AS (SELECT id, min(k) FILTER (WHERE at_s OR at_t) AS hit, max(k) AS n FROM held GROUP BY id),
kept AS (SELECT h.*, coalesce(hit, n) AS last, hit IS NOT NULL OR n = 5 AS done, max(hi) OVER w AS h_, min(lo) OVER w AS l_ FROM held h JOIN ends USING (id) WHERE k <= coalesce(hit, n) WINDOW w AS (PARTITION BY id ORDER BY k)),
marks AS (SELECT *, CASE WHEN side > 0 THEN c / entry - 1 ELSE entry / c - 1 END AS mr, CASE WHEN side > 0 THEN h_ / entry - 1 ELSE entry / l_ - 1 END AS best, CASE WHEN side > 0 THEN l_ / entry - 1 ELSE entry / h_ - 1 END AS worst FROM kept),
outs AS (SELECT *, CASE WHEN side > 0 THEN px / entry - 1 ELSE entry / px - 1 END AS gross FROM (SELECT *, CASE WHEN at_s THEN sp WHEN at_t THEN tp ELSE c END AS px, CASE WHEN at_s AND at_t THEN 'stop_intraday_ambiguous' WHEN at_s THEN 'stop' WHEN at_t THEN 'target' ELSE 'time_exit' END AS why FROM marks WHERE k = last AND done)),
events AS ({row("SIGNAL_REJECTED", "sd", "'h5'")} FROM sig WHERE NOT live UNION ALL {row("SIGNAL_CREATED", "sd", "'h5'")} FROM sig WHERE live UNION ALL {row("ENTRY_PENDING", "sd", "'h5'")} FROM sig WHERE live
UNION ALL {row("ENTRY_FILLED", "ed", "id, 'h5'", "id", "entry", "tp", "sp")} FROM pos WHERE ed IS NOT NULL UNION ALL {row("TARGET_UPDATED", "ed", "id, 'TARGET_UPDATED'", "id", "tp")} FROM pos WHERE ed IS NOT NULL UNION ALL {row("STOP_UPDATED", "ed", "id, 'STOP_UPDATED'", "id", "sp")} FROM pos WHERE ed IS NOT NULL
UNION ALL {row("POSITION_MARKED", "bd", "id, CAST(bd AS VARCHAR)", "id", "c", mark="mr", mfe="best", mae="worst")} FROM marks
UNION ALL {row("EXIT_FILLED", "bd", "id", "id", "px", mark="mr", mfe="best", mae="worst", why="why", gross="gross", net="gross - 0.0005")} FROM outs)"""


LOG_ROW = "event_type, as_of, symbol, direction, model_id, snapshot, unique_key, source_key, horizon, round(price + 1.23e-7, 4) AS price, round(target_price + 1.23e-7, 4) AS target_price, round(stop_price + 1.23e-7, 4) AS stop_price, round(mark_return, 8) AS mark_return, round(mfe, 8) AS mfe, round(mae, 8) AS mae, reason, round(gross_return, 8) AS gross_return, round(net_return, 8) AS net_return"


def forward_positions() -> str:
    return """SELECT id AS position, symbol, direction, model_id, sd AS signal_date, ed AS entry_date, round(entry + 1.23e-7, 4) AS entry_price, o.bd AS exit_date, round(o.px + 1.23e-7, 4) AS exit_price, o.why AS exit_reason, round(o.gross - 0.0005, 8) AS net_return, coalesce(m.n, 0) AS n_marks,
CASE WHEN o.bd IS NOT NULL THEN 'EXIT_FILLED' WHEN ed IS NOT NULL THEN 'ENTRY_FILLED' ELSE 'ENTRY_PENDING' END AS status FROM pos LEFT JOIN (SELECT id, bd, px, why, gross FROM outs) o USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM marks GROUP BY id) m USING (id)"""


def holdout(received: str, baseline: str, created: str, least: dict[str, int]) -> dict[str, str]:
    """Sessions, log, states, gates and evaluation of a holdout run named ``run``."""
    found = f"""got AS (SELECT Date, count(*) AS n_rows, bool_or(available_at IS NULL) AS unknown, min(available_at) AS first_at FROM ({received}) r WHERE Date > DATE '{baseline}' GROUP BY Date),
ses AS (SELECT Date, n_rows, NOT unknown AND first_at > TIMESTAMP '{created}' AS available, CASE WHEN unknown THEN 'FINAL_HOLDOUT_BACKFILL_BLOCKED: incomplete ingestion provenance' WHEN first_at <= TIMESTAMP '{created}' THEN 'FINAL_HOLDOUT_BACKFILL_BLOCKED: session was locally available before run creation' ELSE 'ok' END AS reason FROM got),
seen AS (SELECT * FROM plain WHERE Date <= (SELECT max(Date) FROM ses WHERE available)), {forward_log("FINAL_HOLDOUT_", "SELECT Date FROM ses WHERE available", "seen")}"""
    short = {"calendar_months": "calendar_months", "matured": "matured_outcomes", "negative": "negative_outcomes", "observation_sessions": "observation_sessions", "positive": "positive_outcomes", "signal_dates": "distinct_signal_dates"}
    enough = " AND ".join(f"{c} >= {least[c]}" for c in short.values()) + " AND blocked_backfills = 0"
    rest = ", ".join(f"CASE WHEN {c} < {least[c]} THEN '{n}:' || CAST({least[c]} - {c} AS VARCHAR) END" for n, c in short.items())
    state = f"""{found}, mods AS (SELECT DISTINCT model_id FROM sig), agg AS (SELECT model_id, count(*) AS matured_outcomes, count(DISTINCT sd) AS distinct_signal_dates, count(DISTINCT strftime(bd, '%Y-%m')) AS calendar_months, count(*) FILTER (WHERE why = 'target') AS positive_outcomes, count(*) FILTER (WHERE why <> 'target') AS negative_outcomes, avg(gross - 0.0005) AS mean_net_return FROM outs GROUP BY model_id),
open_ AS (SELECT model_id, count(*) FILTER (WHERE ed IS NULL) AS pending_entries, count(*) FILTER (WHERE ed IS NOT NULL AND id NOT IN (SELECT id FROM outs)) AS open_positions FROM pos GROUP BY model_id),
st0 AS (SELECT 'run' AS run_id, model_id, coalesce(matured_outcomes, 0) AS matured_outcomes, coalesce(distinct_signal_dates, 0) AS distinct_signal_dates, coalesce(calendar_months, 0) AS calendar_months, coalesce(positive_outcomes, 0) AS positive_outcomes, coalesce(negative_outcomes, 0) AS negative_outcomes, coalesce(pending_entries, 0) AS pending_entries, coalesce(open_positions, 0) AS open_positions, mean_net_return,
(SELECT count(*) FILTER (WHERE available) FROM ses) AS observation_sessions, (SELECT count(*) FILTER (WHERE NOT available) FROM ses) AS blocked_backfills FROM mods LEFT JOIN agg USING (model_id) LEFT JOIN open_ USING (model_id)),
st AS (SELECT *, blocked_backfills AS invalidated_outcomes, {enough} AS sample_sufficient, matured_outcomes >= {least["early_matured_outcomes"]} AND distinct_signal_dates >= {least["early_distinct_signal_dates"]} AS early_diagnostic_available, concat_ws('; ', {rest}) AS rest FROM st0)"""
    out = "SELECT run_id, model_id, matured_outcomes, distinct_signal_dates, calendar_months, positive_outcomes, negative_outcomes, pending_entries, open_positions, round(mean_net_return, 6) AS mean_net_return, observation_sessions, blocked_backfills, invalidated_outcomes, sample_sufficient, early_diagnostic_available, CASE WHEN sample_sufficient THEN 'READY_FOR_EVALUATION' WHEN early_diagnostic_available THEN 'EARLY_DIAGNOSTIC_AVAILABLE' ELSE 'COLLECTING' END AS status, CASE WHEN rest = '' THEN 'ready' ELSE rest END AS remaining FROM st"
    names = [("matured_outcomes", "matured_outcomes_min_100"), ("distinct_signal_dates", "distinct_signal_dates_min_60"), ("observation_sessions", "observation_sessions_min_126"), ("calendar_months", "calendar_months_min_4"), ("positive_outcomes", "positive_class_min_20"), ("negative_outcomes", "negative_class_min_20")]
    each = [f"SELECT run_id, model_id, 'final_holdout_{g}' AS gate_id, '{m}' AS metric, '>=' AS comparator, {least[m]}::BIGINT AS threshold, {m}::BIGINT AS actual, CASE WHEN {m} >= {least[m]} THEN 'PASS' ELSE 'FAIL' END AS status FROM st" for m, g in names]
    each += [f"SELECT run_id, model_id, 'final_holdout_{g}', '{m}', '==', 0, {m}, CASE WHEN {m} = 0 THEN 'PASS' ELSE 'FAIL' END FROM st" for g, m in (("backfill_absent", "blocked_backfills"), ("data_integrity_valid", "invalidated_outcomes"))]
    each += ["SELECT run_id, model_id, 'final_holdout_sample_sufficient', 'sample_sufficient', 'is true', 1, sample_sufficient::INT, CASE WHEN sample_sufficient THEN 'PASS' ELSE 'FAIL' END FROM st"]
    blocked = "SELECT 'FINAL_HOLDOUT_DATA_INVALIDATED' AS event_type, Date AS as_of, 'RUN' AS symbol, 'n/a' AS direction, 'run' AS model_id, NULL AS snapshot, sha256('FINAL_HOLDOUT_DATA_INVALIDATED|' || CAST(Date AS VARCHAR) || '|RUN|n/a|run||run|' || CAST(Date AS VARCHAR)) AS unique_key, NULL AS source_key, NULL AS horizon, NULL AS price, NULL AS target_price, NULL AS stop_price, NULL AS mark_return, NULL AS mfe, NULL AS mae, reason, NULL AS gross_return, NULL AS net_return FROM ses WHERE NOT available"
    return {
        "sessions": f", {found} SELECT Date, n_rows, available, reason FROM ses", "log": f", {found} SELECT {LOG_ROW} FROM events UNION ALL {blocked}", "states": f", {state} {out}", "gates": f", {state} " + " UNION ALL ".join(each),
        "evaluation": f", {state}, able AS (SELECT bool_or(early_diagnostic_available OR sample_sufficient) AS a FROM st) SELECT run_id, model_id, matured_outcomes, CASE WHEN a THEN round(mean_net_return, 6) END AS mean_net_return, false AS promotable, CASE WHEN NOT a THEN 'EVALUATION_BLOCKED' WHEN sample_sufficient THEN 'READY_FOR_EVALUATION' WHEN early_diagnostic_available THEN 'EARLY_DIAGNOSTIC_AVAILABLE' ELSE 'COLLECTING' END AS status FROM st, able",
    }

