"""Nearest historical analogs of target rows, and what they say together.

Targets are few by construction (the latest rows, or blocked ones chosen by rank); history is all
earlier rows. The join is a broadcast of the targets against one scan of history, so it costs
targets times history and no shuffle of history; top-k keeps k rows a target in each task first.
Nearest vectors have as many targets as one row in twenty, and are found block against block (``neighbours``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.dialect import Dialect
from tidemark.operators import neighbours

#: Targets of one block of nearest_vectors.
BLOCK_TARGETS = 16384


def nearest(d: Dialect, scored: str, k: int = 25) -> str:
    """Of each symbol's latest row the k nearest earlier rows by features scaled to unit deviation; equal
    distances: later date, then symbol. Rows of the target's scope come first."""
    scale = f"SELECT nullif(stddev_pop(x1), 0) AS s1, nullif(stddev_pop(x2), 0) AS s2 FROM ({scored}) s"
    last = f"SELECT symbol AS t_symbol, Date AS t_date, scope AS t_scope, x1 AS t1, x2 AS t2 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY Date DESC) AS rn FROM ({scored}) s) x WHERE rn = 1"
    pairs = f"SELECT t_symbol, t_date, h.symbol, h.Date, h.r, h.y, h.tbs, h.mfe, h.mae, CASE WHEN h.scope = t_scope THEN 1 ELSE 0 END AS same_scope, round(sqrt(power((h.x1 - t1) / s1, 2) + power((h.x2 - t2) / s2, 2)), 9) AS distance FROM ({scored}) h JOIN ({last}) t ON h.Date < t.t_date CROSS JOIN ({scale}) c"
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t_symbol ORDER BY same_scope DESC, distance, Date DESC, symbol) AS rk FROM ({pairs}) p) q WHERE rk <= {k}"


def listed(d: Dialect, scored: str) -> str:
    return f"SELECT t_symbol, symbol, Date, same_scope, round(distance, 5) AS distance, CAST(rk AS INT) AS rk FROM ({nearest(d, scored)}) n"


DEPTHS = (10, 25, 50)


def depths(d: Dialect, scored: str) -> str:
    """What the nearest 10, 25 and 50 analogs say together: shares, rates, returns, dispersion, and a label."""
    grid = " UNION ALL ".join(f"SELECT {k} AS depth" for k in DEPTHS)
    rows = f"SELECT *, year(Date) AS yr FROM ({nearest(d, scored, 50)}) n CROSS JOIN ({grid}) g WHERE rk <= depth"
    most = lambda key: f"SELECT t_symbol, depth, max(c) AS most_{key} FROM (SELECT t_symbol, depth, {key}, count(*) AS c FROM ({rows}) r GROUP BY t_symbol, depth, {key}) x GROUP BY t_symbol, depth"
    one = "CASE WHEN {} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    by = f"SELECT t_symbol, depth, count(*) AS n, avg({one.format('r > 0')}) AS win, avg(tbs) AS tbs_rate, avg(r) AS mean_r, stddev_pop(r) AS std_r, min(mae) AS worst_mae, max(mfe) AS best_mfe, avg({one.format('symbol = t_symbol')}) AS same_symbol, avg(CAST(same_scope AS DOUBLE)) AS same_scope, max(distance) AS farthest, min(Date) AS first_date, max(Date) AS last_date FROM ({rows}) r GROUP BY t_symbol, depth"
    return f"""SELECT b.t_symbol, b.depth, n, round(win, 6) AS win_rate, round(tbs_rate, 6) AS target_first_rate, round(mean_r, 6) AS mean_return, round(std_r, 6) AS return_std, round(std_r / greatest(abs(mean_r), 0.01), 5) AS dispersion_score, round(worst_mae, 6) AS worst_mae, round(best_mfe, 6) AS best_mfe, round(same_symbol, 6) AS same_symbol_share, round(same_scope, 6) AS same_scope_share,
round(CAST(most_yr AS DOUBLE) / n, 6) AS same_year_share, round(farthest, 5) AS farthest, {d.days('last_date', 'first_date')} AS span_days, CASE WHEN n < 3 THEN 'INSUFFICIENT_ANALOGS' WHEN mean_r > 0 AND win >= 0.55 AND tbs_rate >= 0.50 THEN 'SUPPORTIVE' WHEN mean_r <= 0 AND win < 0.45 AND tbs_rate < 0.45 THEN 'WEAK' ELSE 'MIXED' END AS label
FROM ({by}) b JOIN ({most('yr')}) y ON y.t_symbol = b.t_symbol AND y.depth = b.depth"""


def robustness(d: Dialect, scored: str) -> str:
    """Flags of each target over its three depths, and the label of its support."""
    at = lambda k, c: f"max(CASE WHEN depth = {k} THEN {c} END)"
    good = lambda k: f"max(CASE WHEN depth = {k} AND label = 'SUPPORTIVE' THEN 1 ELSE 0 END)"
    by = f"""SELECT t_symbol, {at(10, 'n')} AS n10, {at(10, 'label')} AS label10, {good(10)} AS g10, {good(25)} AS g25, {good(50)} AS g50, max(same_symbol_share) AS sym, max(same_year_share) AS yr, min(same_scope_share) AS scope_share, max(return_std) AS std, max(dispersion_score) AS disp, min(worst_mae) AS mae,
min(CASE WHEN n < depth THEN 0 ELSE 1 END) AS full_depths, min(CASE WHEN n >= depth AND label <> 'SUPPORTIVE' THEN 0 ELSE 1 END) AS all_good, {at(10, 'target_first_rate')} AS t10, {at(25, 'target_first_rate')} AS t25, {at(50, 'target_first_rate')} AS t50, {at(10, 'same_symbol_share')} AS sym10, {at(10, 'same_year_share')} AS yr10, {at(10, 'span_days')} AS span10 FROM ({depths(d, scored)}) x GROUP BY t_symbol"""
    flags = {
        "same_symbol_concentration": "sym >= 0.70", "same_year_concentration": "yr >= 0.70", "same_scope_scarcity": "scope_share < 0.80", "low_analog_count": "full_depths = 0", "high_return_dispersion": "std >= 0.25 OR disp >= 1.50", "high_mae_tail_risk": "mae <= -0.20",
        "tbs_support_decay": "t10 - t25 >= 0.15 OR t10 - t50 >= 0.15", "support_decays_top25": "g10 = 1 AND g25 = 0", "support_decays_top50": "g10 = 1 AND g50 = 0", "analogs_mostly_same_event_cluster": "n10 >= 3 AND sym10 >= 0.80 AND yr10 >= 0.80 AND span10 <= 45",
    }
    q = f"SELECT *, {', '.join(f'CASE WHEN {w} THEN 1 ELSE 0 END AS {n}' for n, w in flags.items())} FROM ({by}) b"
    q = f"SELECT *, greatest(same_symbol_concentration, same_year_concentration, analogs_mostly_same_event_cluster) AS narrow, greatest(support_decays_top25, support_decays_top50, tbs_support_decay) AS decays, greatest(high_return_dispersion, high_mae_tail_risk) AS risky FROM ({q}) f"
    label = "CASE WHEN n10 < 10 THEN 'INSUFFICIENT_ANALOGS' WHEN g10 = 1 AND narrow = 1 AND decays = 1 THEN 'CONCENTRATION_ARTIFACT' WHEN g10 = 1 AND decays = 1 THEN 'DECAYS_WITH_DEPTH' WHEN g10 = 1 AND all_good = 1 THEN CASE WHEN risky = 1 THEN 'MIXED_SUPPORT' WHEN narrow = 1 THEN 'SUPPORTIVE_BUT_CONCENTRATED' ELSE 'ROBUST_SUPPORT' END WHEN label10 = 'WEAK' THEN 'WEAK_SUPPORT' ELSE 'MIXED_SUPPORT' END"
    return f"SELECT t_symbol, {', '.join(flags)}, {label} AS support FROM ({q}) g"


VIEWS = {"listed": listed, "depths": depths, "robustness": robustness}


def nearest_vectors(vectors: DataFrame, targets: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest vectors (vec_id, embedding) of each target by Euclidean distance, then id, itself left out.
    Distances that are null come last."""
    w = Window.partitionBy("target_id").orderBy(F.asc_nulls_last("distance"), "vec_id")
    return neighbours.partial(vectors, targets, k, BLOCK_TARGETS).withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


VECTORS_SQL = """SELECT target_id, vec_id, round(distance, 4) AS distance, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY distance, vec_id) AS rk FROM (
SELECT t.vec_id AS target_id, v.vec_id, list_distance(v.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS distance FROM embeddings v JOIN embeddings t ON t.vec_id % 20 = 0 AND v.vec_id <> t.vec_id)) WHERE rk <= 5"""
