"""Eligibility chains, integrity, registries, holdout and diagnostic states, evidence, as SQL over scored rows."""

from __future__ import annotations

from tidemark.functions.dialect import Dialect, lag
from tidemark.operators import analogs, cross_section, events, metrics

ONE, ZERO = "CAST(1 AS DOUBLE)", "CAST(0 AS DOUBLE)"


def share(test: str) -> str:
    return f"avg(CASE WHEN {test} THEN {ONE} ELSE {ZERO} END)"


def exit_bucket(x: str) -> str:
    """Quality of a time exit by its net return (fixed names and bounds)."""
    return f"CASE WHEN {x} IS NULL THEN '' WHEN {x} >= 0.02 THEN 'STRONG_POSITIVE_TIME_EXIT' WHEN {x} > 0 THEN 'MODEST_POSITIVE_TIME_EXIT' WHEN {x} >= -0.002 THEN 'FLAT_TIME_EXIT' WHEN {x} <= -0.05 THEN 'SEVERE_NEGATIVE_TIME_EXIT' ELSE 'NEGATIVE_TIME_EXIT' END"


def effective_policy(d: Dialect, t: str, bars: str) -> str:
    """A policy with a run's settings on top: minimums can only rise, caps only fall; a missing setting changes nothing."""
    rows = " UNION ALL ".join(f"SELECT '{n}' AS setting, '{k}' AS kind, CAST({a} AS DOUBLE) AS base, CAST({b} AS DOUBLE) AS runtime" for n, k, a, b in (("probability", "minimum", 0.55, 0.6), ("expected_return", "minimum", 0.01, 0.0), ("liquidity", "minimum", 0.5, "NULL"), ("per_date", "cap", 5, 3), ("total", "cap", 50, 80)))
    return f"SELECT setting, kind, CASE WHEN kind = 'minimum' THEN greatest(base, coalesce(runtime, base)) ELSE least(base, coalesce(runtime, base)) END AS effective FROM ({rows}) r"


def eligibility(d: Dialect, t: str, bars: str) -> str:
    """Status of each row and its reasons: scope, promotion, gates, policy; then integrity reasons are added."""
    gate = f"SELECT scope, decision FROM ({metrics.promotion(d, t)}) p"
    integrity = "CASE WHEN p < 0 OR p > 1 THEN 'probability_outside_unit' END, CASE WHEN mfe < 0 THEN 'negative_favourable_path' END, CASE WHEN mae > 0 THEN 'positive_adverse_path' END"
    first = "CASE WHEN s.scope NOT IN ('stock', 'sector_etf', 'broad_market_etf') THEN 'scope_mismatch' WHEN g.decision IS NULL THEN 'not_promoted' WHEN g.decision = 'BLOCKED' THEN 'gates_failed' WHEN p < 0.55 THEN 'probability_below_minimum' END"
    q = f"SELECT s.symbol, s.Date, concat_ws(';', {first}, {integrity}) AS reasons FROM ({t}) s LEFT JOIN ({gate}) g ON g.scope = s.scope"
    return f"SELECT symbol, Date, reasons, CASE WHEN reasons = '' THEN 'ACTIONABLE_PAPER_CANDIDATE' ELSE 'REJECTED' END AS status FROM ({q}) q"


def integrity(d: Dialect, t: str, bars: str) -> str:
    """Rows that break the contract of predictions."""
    return f"SELECT scope, count(*) AS n, count(CASE WHEN p IS NULL THEN 1 END) AS p_missing, count(CASE WHEN p < 0 OR p > 1 THEN 1 END) AS p_outside, count(CASE WHEN mfe < 0 THEN 1 END) AS mfe_negative, count(CASE WHEN mae > 0 THEN 1 END) AS mae_positive FROM ({t}) s GROUP BY scope"


# Feature families and what puts a feature into them; the first rule that fits decides.
FAMILY_RULES = (
    ("trend_structure", "is", ("Open", "High", "Low", "Close")),
    ("volume_participation", "is", ("Volume",)),
    ("returns_momentum", "begins", ("return_", "log_return_", "momentum_", "up_streak", "down_streak")),
    ("trend_structure", "begins", ("distance_sma", "sma_", "trend_", "pullback", "recovery", "gap_", "support", "resistance", "range_position", "distance_prior")),
    ("volatility_range", "begins", ("atr_", "atr_pct", "realized_vol", "upside_vol", "downside_vol", "range_pct", "range_percentile", "volatility", "overnight")),
    ("volume_participation", "contains", ("volume",)),
    ("volume_participation", "begins", ("obv", "price_volume")),
    ("candle_geometry", "begins", ("body", "upper_wick", "lower_wick", "close_position", "inside_bar", "outside_bar", "expansion_bar", "lower_rejection")),
    ("rsi_family", "begins", ("rsi_",)),
    ("technical_primitives", "begins", ("roc_", "stochastic", "macd", "bollinger", "keltner", "cci", "mfi", "adx_", "plus_di_", "minus_di_")),
    ("market_relative", "begins", ("relative_return_vs_spy", "relative_return_vs_qqq", "relative_return_vs_iwm", "relative_return_vs_dia", "rolling_beta", "rolling_corr", "residual_return")),
    ("sector_relative", "contains", ("sector",)),
    ("inverse_leveraged", "begins", ("inverse_",)),
    ("relationship_graph", "begins", ("relationship_",)),
    ("breadth", "begins", ("breadth_",)),
    ("regime", "begins", ("market_regime",)),
)
OTHER = "technical_primitives"


def family_of(feature: str) -> str:
    fits = {"is": feature.__eq__, "begins": feature.startswith, "contains": feature.__contains__}
    return next((family for family, how, words in FAMILY_RULES if any(map(fits[how], words))), OTHER)


def families(d: Dialect, t: str, bars: str) -> str:
    """Every feature's family."""
    from tidemark.operators.features import FAMILIES

    names = sorted({k for f in FAMILIES.values() for k in f.keep} | {"rsi_14", "breadth_up_volume_pct", "market_regime_label", "relative_return_vs_sector_20", "spy_return_5", "inverse_confirmation_63", "adx_14", "rolling_beta_vs_spy_63"})
    test = {"is": lambda w: f"feature = '{w}'", "begins": lambda w: d.begins("feature", w), "contains": lambda w: f"contains(feature, '{w}')"}
    case = " ".join(f"WHEN {' OR '.join(map(test[how], words))} THEN '{family}'" for family, how, words in FAMILY_RULES)
    rows = " UNION ALL ".join(f"SELECT '{n}' AS feature" for n in names)
    return f"SELECT feature, CASE {case} ELSE '{OTHER}' END AS family FROM ({rows}) n"


def fold_aggregate(d: Dialect, t: str, bars: str) -> str:
    """Over yearly folds: weighted win rate and mean, median fold, share of positive folds."""
    folds = f"SELECT scope, year(Date) AS yr, count(*) AS n, avg(r) AS m, {share('r > 0')} AS win FROM ({t}) s WHERE p >= 0.55 GROUP BY scope, year(Date)"
    return f"SELECT scope, count(*) AS folds, round(sum(n * win) / sum(n), 6) AS win_rate, round(sum(n * m) / sum(n), 6) AS mean_return, round({d.percentile('m', 0.5)}, 6) AS median_fold, round({share('m > 0')}, 6) AS positive_folds FROM ({folds}) f GROUP BY scope"


def policy_comparison(d: Dialect, t: str, bars: str) -> str:
    grid = " UNION ALL ".join(f"SELECT '{n}' AS policy, CAST({p} AS DOUBLE) AS least_p, CAST({x} AS DOUBLE) AS most_span" for n, p, x in (("loose", 0.5, 10), ("base", 0.55, 1), ("strict", 0.65, 0.5)))
    return f"SELECT policy, count(CASE WHEN p >= least_p AND x2 <= most_span THEN 1 END) AS selected, round(avg(CASE WHEN p >= least_p AND x2 <= most_span THEN r END), 6) AS mean_return, round(avg(CASE WHEN p >= least_p AND x2 <= most_span THEN y END), 6) AS hit_rate FROM ({t}) s CROSS JOIN ({grid}) g GROUP BY policy"


def generation_summary(d: Dialect, t: str, bars: str) -> str:
    """Counts of a run and its best scopes by mean return of selected rows."""
    by = f"SELECT scope, count(*) AS n, avg(r) AS m FROM ({t}) s WHERE p >= 0.55 GROUP BY scope"
    return f"SELECT scope, n, round(m, 6) AS mean_return, CAST(row_number() OVER (ORDER BY m DESC, scope) AS INT) AS rk, round(CAST(n AS DOUBLE) / sum(n) OVER (), 6) AS share FROM ({by}) b"


def robustness(d: Dialect, t: str, bars: str) -> str:
    """How many targets have each label of support."""
    return f"SELECT support AS label, count(*) AS n FROM ({analogs.robustness(d, t)}) x GROUP BY support"


def split_distributions(d: Dialect, t: str, bars: str) -> str:
    part = f"SELECT *, CASE WHEN year(Date) < 1995 THEN 'train' WHEN year(Date) < 1997 THEN 'calibration' ELSE 'holdout' END AS part FROM ({t}) s"
    return f"SELECT scope, part, count(*) AS n, round(avg(y), 6) AS class_balance, round(avg(x1), 6) AS mean_x1, round(stddev_samp(x1), 6) AS std_x1, round(min(x1), 6) AS least_x1, round(max(x1), 6) AS most_x1, round(avg(r), 6) AS mean_r FROM ({part}) p GROUP BY scope, part"


def holdout_metrics(d: Dialect, t: str, bars: str) -> str:
    """Of the last rows: size, class balance, scores over the base rate, returns, status."""
    last = f"SELECT * FROM ({t}) s WHERE year(Date) >= 1997"
    by = f"SELECT scope, count(*) AS n, count(DISTINCT Date) AS dates, sum(y) AS positives, avg((p - y) * (p - y)) AS brier, avg(y * y) - avg(y) * avg(y) AS naive, avg(CASE WHEN p >= 0.55 THEN r END) AS selected_return, count(CASE WHEN p >= 0.55 THEN 1 END) AS selected FROM ({last}) l GROUP BY scope"
    return f"SELECT scope, n, dates, positives, round(brier, 6) AS brier, round(1 - {d.div('brier', 'naive')}, 6) AS skill, selected, round(selected_return, 6) AS selected_return, CASE WHEN n < 100 THEN 'INSUFFICIENT' WHEN brier < naive THEN 'SKILL' ELSE 'NO_SKILL' END AS status FROM ({by}) b"


def product_classes(d: Dialect, t: str, bars: str) -> str:
    """One row: counts by product class, and the base rate weighted by rows."""
    kinds = ("stock", "sector_etf", "broad_market_etf", "inverse_etf", "leveraged_inverse_etf")
    cols = ", ".join(f"sum(CASE WHEN scope = '{k}' THEN n ELSE 0 END) AS n_{k}" for k in kinds)
    by = f"SELECT scope, count(*) AS n, avg(y) AS rate FROM ({t}) s GROUP BY scope"
    return f"SELECT {', '.join(f'CAST(n_{k} AS BIGINT) AS n_{k}' for k in kinds)}, round(base_rate, 6) AS base_rate FROM (SELECT {cols}, sum(rate * n) / sum(n) AS base_rate FROM ({by}) b) c"


def scopes(d: Dialect, t: str, bars: str) -> str:
    return f"SELECT scope, count(DISTINCT symbol) AS n_symbols, min(symbol) AS first_symbol, max(symbol) AS last_symbol, min(Date) AS first_date, max(Date) AS last_date FROM ({t}) s GROUP BY scope"


def history_percentile(d: Dialect, t: str, bars: str) -> str:
    """Where each symbol's latest value stands among its earlier ones."""
    last = f"SELECT symbol, max(Date) AS at FROM ({t}) s GROUP BY symbol"
    now = f"SELECT s.symbol, s.Date, x1 FROM ({t}) s JOIN ({last}) l ON l.symbol = s.symbol AND l.at = s.Date"
    return f"SELECT n.symbol, round(avg(CASE WHEN h.x1 <= n.x1 THEN {ONE} ELSE {ZERO} END), 6) AS percentile, count(*) AS history FROM ({now}) n JOIN ({t}) h ON h.symbol = n.symbol AND h.Date < n.Date GROUP BY n.symbol"


def position_sizes(d: Dialect, t: str, bars: str) -> str:
    """Equal weight, or less where the last 20 days' deviation is above the daily target of 1.5 %."""
    moves = f"SELECT symbol, Date, {d.div('Close', lag('Close'))} - 1 AS m, row_number() OVER (PARTITION BY symbol ORDER BY Date DESC) AS back FROM ({bars}) b"
    vol = f"SELECT symbol, CASE WHEN count(m) >= 10 THEN stddev_samp(m) END AS v FROM ({moves}) x WHERE back <= 20 GROUP BY symbol"
    return f"SELECT symbol, round(v, 6) AS volatility, round(CASE WHEN v > 0 THEN least(0.2, 0.015 / v / 5) ELSE 0.2 END, 6) AS weight FROM ({vol}) v"


def registry(d: Dialect, t: str, bars: str) -> str:
    """Model states by replay of registrations, promotions and retirements: the last event wins."""
    base = f"SELECT scope, min(Date) AS a, max(Date) AS z FROM ({t}) s GROUP BY scope"
    ok = f"SELECT scope FROM ({metrics.promotion(d, t)}) p WHERE decision = 'ELIGIBLE'"
    log = f"SELECT scope AS model_id, a AS moment, 1 AS k, 'REGISTERED' AS state FROM ({base}) b UNION ALL SELECT b.scope AS model_id, z AS moment, 2 AS k, 'PROMOTED' AS state FROM ({base}) b JOIN ({ok}) o ON o.scope = b.scope UNION ALL SELECT scope AS model_id, z AS moment, 3 AS k, 'RETIRED' AS state FROM ({base}) b WHERE scope LIKE '%inverse%'"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY moment DESC, k DESC) AS rk, count(*) OVER (PARTITION BY model_id) AS n_events FROM ({log}) l"
    return f"SELECT model_id, state, moment AS since, n_events FROM ({ranked}) r WHERE rk = 1"


def evidence(d: Dialect, t: str, bars: str) -> str:
    """Relationship evidence of the latest date: which measures reach their thresholds."""
    q = cross_section.relationships(d, bars, "")
    last = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY Date DESC) AS rk FROM ({q}) q WHERE relationship_corr_63 IS NOT NULL) r WHERE rk = 1"
    parts = (("correlation", "relationship_corr_63", "abs(relationship_corr_63) >= 0.4"), ("divergence", "relationship_divergence_5", "abs(relationship_divergence_5) >= 0.03"), ("confirmation", "inverse_confirmation_63", "inverse_confirmation_63 >= 0.6"), ("breakdown", "relationship_breakdown_63", "relationship_breakdown_63 > 0.5"))
    return " UNION ALL ".join(f"SELECT edge, '{n}' AS kind, {c} AS v, CASE WHEN {w} THEN 'EVIDENCE' ELSE 'NONE' END AS finding FROM ({last}) l{k}" for k, (n, c, w) in enumerate(parts))


def support(d: Dialect, t: str, bars: str) -> str:
    """Features of each symbol's latest row by distance from the scope's mean in deviations."""
    stats = f"SELECT scope, avg(x1) AS a1, stddev_pop(x1) AS s1, avg(x2) AS a2, stddev_pop(x2) AS s2 FROM ({t}) s GROUP BY scope"
    latest = f"SELECT symbol, max(Date) AS at FROM ({t}) s GROUP BY symbol"
    last = f"SELECT s.symbol, x1, x2, a1, s1, a2, s2 FROM ({t}) s JOIN ({latest}) l ON l.symbol = s.symbol AND l.at = s.Date JOIN ({stats}) m ON m.scope = s.scope"
    long = f"SELECT symbol, 'x1' AS feature, {d.div('x1 - a1', 's1')} AS z FROM ({last}) a UNION ALL SELECT symbol, 'x2' AS feature, {d.div('x2 - a2', 's2')} AS z FROM ({last}) b"
    return f"SELECT symbol, feature, round(z, 5) AS z, CASE WHEN z > 0 THEN 'support' ELSE 'conflict' END AS side, CAST(row_number() OVER (PARTITION BY symbol ORDER BY abs(z) DESC, feature) AS INT) AS rk FROM ({long}) l"


def probability_audit(d: Dialect, t: str, bars: str) -> str:
    """Rows with their chronological fold and probability step; steps are numbered among distinct ones."""
    folds = f"SELECT Date, ntile(4) OVER (ORDER BY Date) AS fold FROM (SELECT DISTINCT Date FROM ({t}) s) x"
    ranges = f"SELECT fold, min(Date) AS a, max(Date) AS z FROM ({folds}) f GROUP BY fold"
    steps = f"SELECT scope, step, row_number() OVER (PARTITION BY scope ORDER BY step) AS step_id FROM (SELECT DISTINCT scope, round(p, 2) AS step FROM ({t}) s) u"
    return f"SELECT s.symbol, s.Date, fold, step_id FROM ({t}) s JOIN ({ranges}) r ON s.Date BETWEEN r.a AND r.z JOIN ({steps}) k ON k.scope = s.scope AND k.step = round(s.p, 2)"


def outcome_ranks(d: Dialect, t: str, bars: str) -> str:
    """Mean rank of outcomes among all symbols of the date, of selected rows and of the rest."""
    q = f"SELECT *, {cross_section.pct_rank('r', 'Date')} AS rk FROM ({t}) s"
    return f"SELECT scope, CASE WHEN p >= 0.55 THEN 'selected' ELSE 'rest' END AS kind, count(*) AS n, round(avg(rk), 6) AS mean_rank FROM ({q}) q GROUP BY scope, CASE WHEN p >= 0.55 THEN 'selected' ELSE 'rest' END"


def beats_benchmark(d: Dialect, t: str, bars: str) -> str:
    """Share of rows whose outcome is above the benchmark's on that date."""
    return f"SELECT s.scope, count(*) AS n, round(avg(CASE WHEN s.r > b.r THEN {ONE} ELSE {ZERO} END), 6) AS beats FROM ({t}) s JOIN ({t}) b ON b.Date = s.Date AND b.symbol = 'S0' WHERE s.symbol <> 'S0' GROUP BY s.scope"


def positions(d: Dialect, t: str, bars: str) -> str:
    """State of each position by replay of its events."""
    log = f"SELECT unique_key AS position_id, as_of AS moment, 1 AS k, 'PENDING' AS state FROM ({events.created(d, t)}) c WHERE event_type = 'ENTRY_PENDING' UNION ALL SELECT source_key AS position_id, fill_date AS moment, 2 AS k, 'OPEN' AS state FROM ({events.fills(d, t, bars)}) f UNION ALL SELECT source_key AS position_id, exit_date AS moment, 3 AS k, 'CLOSED' AS state FROM ({events.exits(d, t, bars)}) e"
    return f"SELECT state, count(*) AS n, min(moment) AS earliest, max(moment) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY position_id ORDER BY moment DESC, k DESC) AS rk FROM ({log}) l) r WHERE rk = 1 GROUP BY state"


def lineage(d: Dialect, t: str, bars: str) -> str:
    """Pending entries with their fill and exit; what is missing on the way."""
    return f"""SELECT c.symbol, count(*) AS pending, count(f.source_key) AS filled, count(e.source_key) AS closed, count(CASE WHEN f.source_key IS NULL THEN 1 END) AS unfilled, round(sum(e.net_return), 4) AS net_sum
FROM ({events.created(d, t)}) c LEFT JOIN ({events.fills(d, t, bars)}) f ON f.source_key = c.unique_key LEFT JOIN ({events.exits(d, t, bars)}) e ON e.source_key = c.unique_key WHERE c.event_type = 'ENTRY_PENDING' GROUP BY c.symbol"""


def diagnostic_state(d: Dialect, t: str, bars: str) -> str:
    """Matured rows, span in months and status of a prospective diagnostic."""
    q = f"SELECT count(*) AS matured, count(DISTINCT {d.ym('exit_date')}) AS months, min(exit_date) AS first_exit, max(exit_date) AS last_exit FROM ({events.exits(d, t, bars)}) e"
    return f"SELECT matured, months, {d.days('last_exit', 'first_exit')} AS span_days, CASE WHEN matured = 0 THEN 'NO_MATURED_ROWS' WHEN matured < 50 OR months < 3 THEN 'COLLECTING' ELSE 'READY_FOR_REVIEW' END AS status FROM ({q}) q"


def exit_calibration(d: Dialect, t: str, bars: str) -> str:
    """Per split and exit bucket: rows, mean probability and return."""
    part = f"SELECT *, CASE WHEN year(Date) < 1995 THEN 'train' WHEN year(Date) < 1997 THEN 'calibration' ELSE 'holdout' END AS part, {exit_bucket('r')} AS bucket FROM ({t}) s"
    return f"SELECT part, bucket, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(r), 6) AS mean_r, round(avg(mae), 6) AS mean_mae FROM ({part}) p GROUP BY part, bucket"


VIEWS = {f.__name__: f for f in (effective_policy, eligibility, integrity, families, fold_aggregate, policy_comparison, generation_summary, robustness, split_distributions, holdout_metrics, product_classes, scopes, history_percentile, position_sizes, registry, evidence, support, probability_audit, outcome_ranks, beats_benchmark, positions, lineage, diagnostic_state, exit_calibration)}
