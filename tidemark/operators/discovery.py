"""Signal discovery over scored rows: score, decision, blockers, selections, drift and bounds, as SQL.

A row's direction is the sign of its trend feature; probabilities of a sale are those of the fall.
"""

from __future__ import annotations

from tidemark.functions.dialect import Dialect
from tidemark.operators import metrics

ONE, ZERO = "CAST(1 AS DOUBLE)", "CAST(0 AS DOUBLE)"
# Thresholds of the decision ladder, cost of a round trip, cap of a hypothesis.
PROBABILITY, TARGET_FIRST, VALUE, SCORE, OUT_OF_BOUNDS, COST, CAP = 0.55, 0.50, 0.001, 0.55, 0.20, 0.0005, 12
# Blocker families, found in a reason in this order.
FAMILIES = (("target_before_stop", ("target_before_stop",)), ("direction_probability", ("probability",)), ("expected_value", ("expected_value", "expected_return")), ("signal_score", ("signal_score",)), ("ood", ("ood",)), ("candidate_cap", ("cap",)), ("conflict", ("conflict",)))
FEATURES = ("x1", "x2")
TRAIN = "year(Date) < 1995"


def unit(x: str) -> str:
    return f"greatest({ZERO}, least({ONE}, {x}))"


def bounds(d: Dialect, t: str) -> str:
    """One row: the 1 % and 99 % quantiles of each feature in training rows."""
    return f"SELECT {', '.join(f'{d.percentile(x, q)} AS {x}_{n}' for x in FEATURES for n, q in (('lo', 0.01), ('hi', 0.99)))} FROM ({t}) b WHERE {TRAIN}"


def components(d: Dialect, t: str) -> str:
    """Rows with the parts of their score (fixed weights and scales)."""
    rate = " + ".join(f"CASE WHEN {x} < {x}_lo OR {x} > {x}_hi THEN {ONE} ELSE {ZERO} END" for x in FEATURES)
    q = f"""SELECT s.*, CASE WHEN x1 >= 0 THEN 'BUY' ELSE 'SELL_SHORT' END AS direction, CASE WHEN x1 >= 0 THEN p ELSE 1 - p END AS dp, CASE WHEN x1 >= 0 THEN q ELSE 1 - q END AS tp, abs(er) - {COST} AS value, ({rate}) / {len(FEATURES)} AS ood_rate, {unit("log10(greatest(dollar_volume, 1)) / 9")} AS liquidity FROM ({t}) s CROSS JOIN ({bounds(d, t)}) b"""
    parts = f"SELECT *, {unit('(value + 0.02) / 0.07')} AS value_score, {unit('emfe / 0.10')} AS mfe_score, {unit('1 - abs(emae) / 0.10')} AS mae_score FROM ({q}) q"
    return f"""SELECT *, {unit('0.35 * dp + 0.20 * tp + 0.20 * value_score + 0.10 * mfe_score + 0.08 * mae_score + 0.07 * liquidity - 0.10 * ood_rate')} AS score, {unit('0.35 * dp + 0.25 * tp + 0.20 * value_score + 0.10 * mfe_score + 0.10 * mae_score')} AS footprint,
value + greatest(emfe, 0) * 0.25 - abs(emae) * 0.35 AS risk_adjusted FROM ({parts}) p"""


def decided(d: Dialect, t: str) -> str:
    """Rows with the decision ladder's reason and decision, and the status that follows."""
    reason = f"""CASE WHEN ood_rate > {OUT_OF_BOUNDS} THEN 'ood_feature_rate_above_limit' WHEN dp < {PROBABILITY} THEN 'probability_below_threshold' WHEN tp < {TARGET_FIRST} THEN 'target_before_stop_probability_below_threshold'
WHEN value < {VALUE} THEN 'expected_value_insufficient_after_cost' WHEN score < {SCORE} THEN 'signal_score_below_threshold' ELSE 'model_not_promoted_final_holdout_missing' END"""
    q = f"SELECT *, {reason} AS reason FROM ({components(d, t)}) c"
    q = f"SELECT *, CASE reason WHEN 'ood_feature_rate_above_limit' THEN 'REJECTED_BY_OOD' WHEN 'model_not_promoted_final_holdout_missing' THEN concat(direction, '_CANDIDATE') ELSE 'NO_SIGNAL' END AS decision FROM ({q}) r"
    return f"SELECT *, CASE decision WHEN 'NO_SIGNAL' THEN 'RESEARCH_ONLY' WHEN 'REJECTED_BY_OOD' THEN decision ELSE 'SHADOW_ONLY' END AS status FROM ({q}) e"


def decisions(d: Dialect, t: str) -> str:
    return f"SELECT symbol, Date, scope, direction, decision, reason, status, round(score, 10) AS signal_score, round(footprint, 10) AS footprint_score, round(risk_adjusted, 10) AS risk_adjusted_utility, round(dp * er, 12) AS composite_utility, round(ood_rate, 6) AS ood_feature_rate, round(liquidity, 10) AS liquidity_score FROM ({decided(d, t)}) x"


def blocked(d: Dialect, t: str) -> str:
    family = " ".join(f"WHEN {' OR '.join(f'''contains(reason, '{w}')''' for w in words)} THEN '{name}'" for name, words in FAMILIES)
    return f"SELECT *, CASE {family} ELSE 'other' END AS family FROM ({decided(d, t)}) x WHERE decision = 'NO_SIGNAL' OR decision = 'REJECTED_BY_OOD'"


def blockers(d: Dialect, t: str) -> str:
    """Blocked rows by family, reason, scope, direction and symbol: five groupings in one pass."""
    keys = ("family", "reason", "scope", "direction", "symbol")
    named = " ".join(f"WHEN grouping({k}) = 0 THEN '{k}'" for k in keys)
    return f"""SELECT CASE {named} END AS grouped_by, coalesce({', '.join(keys)}) AS value, count(*) AS n_rows, count(DISTINCT ticker) AS n_symbols, round(avg(score), 6) AS average_score, round(max(score), 6) AS best_score, round(avg(value), 6) AS average_value, round(avg(tp), 6) AS average_target_first
FROM (SELECT *, symbol AS ticker FROM ({blocked(d, t)}) b) c GROUP BY GROUPING SETS ({', '.join(f'({k})' for k in keys)})"""


def blocker_report(d: Dialect, t: str) -> str:
    """One row for each grouping: how many values, and the one with most rows."""
    ranked = f"SELECT *, row_number() OVER (PARTITION BY grouped_by ORDER BY n_rows DESC, value) AS rk FROM ({blockers(d, t)}) b"
    return f"SELECT grouped_by, count(*) AS n_values, CAST(sum(n_rows) AS BIGINT) AS n_rows, max(CASE WHEN rk = 1 THEN value END) AS top_value, CAST(max(n_rows) AS BIGINT) AS top_rows FROM ({ranked}) r GROUP BY grouped_by"


def top_of(keys: str, order: str, k: int, t: str, name: str = "rk") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS {name} FROM ({t}) t) r WHERE {name} <= {k}"


def top_by_direction(d: Dialect, t: str, k: int = 20) -> str:
    """The best rows of each direction."""
    top = top_of("direction", "score DESC, symbol, Date", k, decided(d, t))
    return f"SELECT direction, CAST(rk AS INT) AS rk, symbol, Date, round(score, 10) AS signal_score, decision FROM ({top}) x"


def hypothesis_caps(d: Dialect, t: str, k: int = CAP) -> str:
    """Candidates of a hypothesis (scope and direction; ``t`` is a snapshot) beyond its cap stay, as rejected by policy. Missing scores come last, as -1."""
    q = f"SELECT symbol, Date, scope, direction, decision, status, coalesce(score, -1) AS score FROM ({decided(d, t)}) x WHERE decision = 'BUY_CANDIDATE' OR decision = 'SELL_SHORT_CANDIDATE'"
    kept = f"SELECT symbol AS k_symbol, Date AS k_date, scope AS k_scope FROM ({top_of('scope, direction', 'score DESC, symbol, Date', k, q)}) z"
    over = "k_symbol IS NULL"
    return f"""SELECT symbol, Date, scope, direction, CASE WHEN {over} THEN 'REJECTED_BY_POLICY' ELSE decision END AS decision, CASE WHEN {over} THEN 'REJECTED_BY_POLICY' ELSE status END AS status, CASE WHEN {over} THEN 'candidate_cap_per_hypothesis' ELSE '' END AS rejection_reason
FROM ({q}) q LEFT JOIN ({kept}) c ON k_symbol = symbol AND k_date = Date AND k_scope = scope"""


def blocked_targets(d: Dialect, t: str) -> str:
    """Blocked rows worth a look: five of each direction, three of each of three reasons; a row counts once."""
    b = blocked(d, t)
    reasons = "'probability_below_threshold', 'target_before_stop_probability_below_threshold', 'ood_feature_rate_above_limit'"
    one = f"SELECT symbol, Date, scope, direction, reason, score, concat('top_', direction) AS why, 1 AS k FROM ({top_of('direction', 'score DESC, symbol, scope, Date', 5, b)}) x"
    two = f"SELECT symbol, Date, scope, direction, reason, score, concat('top_', reason) AS why, 2 AS k FROM ({top_of('reason', 'score DESC, symbol, scope, Date', 3, b)}) y WHERE reason IN ({reasons})"
    once = top_of("symbol, Date, scope", "k", 1, f"{one} UNION ALL {two}", "nth")
    return f"SELECT symbol, Date, scope, direction, reason, round(score, 10) AS signal_score, why FROM ({once}) o"


def best_family(d: Dialect, t: str) -> str:
    """Of the model families of a scope (here: the probability, and the one of the target) the best by net utility, then skill."""
    both = " UNION ALL ".join(f"SELECT scope, '{n}' AS family, avg(CASE WHEN {c} >= {PROBABILITY} THEN r - {COST} END) AS net_utility, 1 - {d.div(f'avg(({c} - y) * ({c} - y))', 'avg(y * y) - avg(y) * avg(y)')} AS skill FROM ({t}) {n}_t GROUP BY scope" for n, c in (("direction", "p"), ("target", "q")))
    rk = f"SELECT *, row_number() OVER (PARTITION BY scope ORDER BY coalesce(net_utility, -1) DESC, skill DESC, family) AS rk FROM ({both}) b"
    return f"SELECT scope, family, round(net_utility, 6) AS net_utility, round(skill, 6) AS skill FROM ({rk}) r WHERE rk = 1"


def drift(d: Dialect, t: str) -> str:
    """Features, probabilities, returns and calibration of recent rows against training rows, each with its limit."""
    both = lambda x, f="avg": tuple(f"{f}(CASE WHEN {w} THEN {x} END)" for w in (TRAIN, f"NOT ({TRAIN})"))
    shift = " + ".join(f"coalesce(abs({b} - {a}) / nullif(stddev_pop(CASE WHEN {TRAIN} THEN {x} END), 0), 0)" for x in FEATURES for a, b in (both(x),))
    varied = " + ".join(f"CASE WHEN stddev_pop(CASE WHEN {TRAIN} THEN {x} END) > 0 THEN 1 ELSE 0 END" for x in FEATURES)  # a feature that does not vary says nothing
    (pa, pb), (ra, rb), (ba, bb) = both("p"), both("r"), both("(p - y) * (p - y)")
    one = f"SELECT ({shift}) / nullif({varied}, 0) AS feature_distribution_mean_abs_z, abs({pb} - {pa}) AS prediction_probability_mean_shift, abs({rb} - {ra}) AS realized_performance_mean_return_shift, {bb} - {ba} AS calibration_brier_deterioration FROM ({t}) s"
    limits = (("feature_distribution_mean_abs_z", 2.5), ("prediction_probability_mean_shift", 0.20), ("realized_performance_mean_return_shift", 0.02), ("calibration_brier_deterioration", 0.05))
    return " UNION ALL ".join(f"SELECT '{n}' AS metric, round({n}, 6) AS v, CAST({x} AS DOUBLE) AS threshold, CASE WHEN {n} > {x} THEN 1 ELSE 0 END AS alert FROM ({one}) o{k}" for k, (n, x) in enumerate(limits))


def live_bounds(d: Dialect, t: str) -> str:
    """Each symbol's latest row against frozen bounds of the predictions: severity of what lies outside."""
    heads = ("p", "er", "emfe", "emae")
    frozen = f"SELECT {', '.join(f'{d.percentile(h, q)} AS {h}_{n}' for h in heads for n, q in (('lo', 0.01), ('hi', 0.99)))} FROM ({t}) b WHERE {TRAIN}"
    last = top_of("symbol", "Date DESC", 1, t)
    over = lambda h: f"greatest({ZERO}, {h}_lo - {h}, {h} - {h}_hi) / greatest({h}_hi - {h}_lo, 1e-12)"
    return " UNION ALL ".join(f"SELECT symbol, Date, '{h}' AS head, round({h}, 6) AS v, round({h}_lo, 6) AS lower_bound, round({h}_hi, 6) AS upper_bound, round({over(h)}, 5) AS severity, CASE WHEN {over(h)} > 0 THEN 1 ELSE 0 END AS is_ood FROM ({last}) l{k} CROSS JOIN ({frozen}) f{k}" for k, h in enumerate(heads))


def contract(d: Dialect, t: str) -> str:
    """Predictions that break their contract: probabilities in [0, 1], favourable paths not negative, adverse ones not positive."""
    return f"SELECT scope, count(*) AS n, count(CASE WHEN p IS NULL OR p < 0 OR p > 1 OR q IS NULL OR q < 0 OR q > 1 THEN 1 END) AS bad_probability, count(CASE WHEN emfe < 0 THEN 1 END) AS negative_favourable, count(CASE WHEN emae > 0 THEN 1 END) AS positive_adverse, min(CASE WHEN p BETWEEN 0 AND 1 AND q BETWEEN 0 AND 1 AND emfe >= 0 AND emae <= 0 THEN 1 ELSE 0 END) AS valid FROM ({t}) s GROUP BY scope"


def path_targets(d: Dialect, t: str) -> str:
    """Excursions in units of the day's range, as learned (log1p of what cannot be negative) and back; rows outside the domain are counted."""
    q = f"SELECT *, {d.div('mfe', 'x2')} AS up, {d.div('abs(mae)', 'x2')} AS down FROM ({t}) s"
    q = f"SELECT *, CASE WHEN up >= 0 THEN ln(1 + up) END AS up_target, CASE WHEN mae <= 0 THEN ln(1 + down) END AS down_target FROM ({q}) q"
    return f"SELECT scope, count(*) AS n, count(up_target) AS up_known, count(down_target) AS down_known, count(CASE WHEN up < 0 THEN 1 END) AS up_outside, count(CASE WHEN mae > 0 THEN 1 END) AS down_outside, round(avg(up_target), 6) AS mean_up_target, round(avg(down_target), 6) AS mean_down_target, round(avg(abs((exp(up_target) - 1) * x2 - mfe)), 6) AS back_error FROM ({q}) r GROUP BY scope"


def contradictions(d: Dialect, t: str) -> str:
    """Gates whose status does not follow from value, comparator and threshold: five checks, each with count and an example."""
    g = metrics.gates(d, t)
    reach = "CASE WHEN comparator = '>=' THEN v >= threshold - 1e-9 * abs(threshold) ELSE v <= threshold + 1e-9 * abs(threshold) END"
    tests = (("unavailable evidence marked PASS", "status = 'PASS' AND v IS NULL"), ("comparator/status contradictions", f"v IS NOT NULL AND (status = 'PASS') <> ({reach})"), ("status/reason contradictions", "status NOT IN ('PASS', 'FAIL')"), ("missing mandatory evidence", "v IS NULL"), ("invalid infinity/unavailable representation", "abs(v) > 1e308"))
    return " UNION ALL ".join(f"SELECT '{n}' AS check_name, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS n, coalesce(min(scope), '') AS example FROM ({g}) g{k} WHERE {w}" for k, (n, w) in enumerate(tests))


def edge_label() -> str:
    """What a model may be called (fixed labels), from promoted_at, state, eligible, holdout_status and run_status."""
    return """CASE WHEN state IS NULL THEN 'RESEARCH ONLY' WHEN promoted_at IS NOT NULL OR (state = 'CHAMPION' AND eligible AND holdout_status = 'FINAL_HOLDOUT') THEN 'PROMOTED' WHEN holdout_status = 'FINAL_HOLDOUT' AND eligible THEN 'FINAL-HOLDOUT QUALIFIED'
WHEN run_status IS NOT NULL AND NOT (run_status = 'INVALIDATED' OR run_status = 'CLOSED') THEN 'SHADOW VALIDATION' WHEN state = 'CANDIDATE' OR state = 'CHALLENGER' THEN 'DEVELOPMENT CANDIDATE' ELSE 'RESEARCH ONLY' END"""


def edge_status(d: Dialect, t: str) -> str:
    """A scope's model by its gates: eligible ones are challengers; a scope with rows from 1997 on has a holdout run, which is evaluated from 120 dates on."""
    held = f"SELECT scope, count(DISTINCT Date) AS dates FROM ({t}) h WHERE year(Date) >= 1997 GROUP BY scope"
    q = f"""SELECT p.scope, p.decision, coalesce(dates, 0) AS dates, p.decision = 'ELIGIBLE' AS eligible, CASE WHEN p.decision = 'ELIGIBLE' THEN 'CHALLENGER' ELSE 'CANDIDATE' END AS state, CAST(NULL AS TIMESTAMP) AS promoted_at,
CASE WHEN dates >= 120 AND p.decision = 'ELIGIBLE' THEN 'FINAL_HOLDOUT' END AS holdout_status, CASE WHEN dates > 0 THEN 'COLLECTING' END AS run_status FROM ({metrics.promotion(d, t)}) p LEFT JOIN ({held}) h ON h.scope = p.scope"""
    return f"SELECT scope, decision, state, dates, {edge_label()} AS edge_status FROM ({q}) q"


VIEWS = {f.__name__: f for f in (decisions, blockers, blocker_report, top_by_direction, hypothesis_caps, blocked_targets, best_family, drift, live_bounds, contract, path_targets, contradictions, edge_status)}
