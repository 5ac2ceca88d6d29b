"""Metrics of predictions, trades and features, as SQL over a table of scored rows.

A scored row has symbol, Date, scope, sector, p (probability), q (probability that the target comes before
the stop), er, emfe, emae (expected return and excursions), y (outcome 0 or 1), tbs and sbt (target or stop
came first), r (return), mfe, mae, dollar_volume, x1, x2 (features). Each function gives a query in a
dialect. They are aggregations with map-side combining. A scope may hold any number of rows (POOLED holds
all), so none is ordered in one window: areas under curves come from distinct scores, ranks from buckets
between sampled quantiles whose counts are known (``ranked``).
"""

from __future__ import annotations

from tidemark.functions.dialect import Dialect, lag

D = "CAST({} AS DOUBLE)".format
GRID = [round(0.30 + 0.05 * k, 2) for k in range(7)]
UTILITY_GRID = [round(0.30 + 0.05 * k, 2) for k in range(9)]


def scored(d: Dialect, bars: str, universe: str, h: int = 5) -> str:
    """Scored rows made of bars with ``label_atr_14``: the probability follows the trailing 20-day return, the
    expectations the day's range, the outcomes are the h-day labels."""
    from tidemark.operators.labels import LABELS, TOUCH

    q = f"SELECT *, {d.div('Close', lag('Close', 20))} - 1 AS m20, {d.div('High - Low', 'Close')} AS span FROM ({TOUCH[h].select(d, LABELS[h].select(d, bars))}) l"
    return f"""SELECT q.symbol, q.Date, u.role AS scope, coalesce(u.sector, '') AS sector, label_end_date, round(1 / (1 + exp(-10 * m20)), 6) AS p, round(1 / (1 + exp(4 * span - 6 * m20)), 6) AS q, round(m20 / 4, 6) AS er, round(span * 1.5, 6) AS emfe, round(-span, 6) AS emae,
label_bull_positive_return_{h} AS y, bull_target_before_stop AS tbs, bull_stop_before_target AS sbt, label_bull_forward_return_{h} AS r, label_bull_mfe_{h} AS mfe, label_bull_mae_{h} AS mae, Close * Volume AS dollar_volume, m20 AS x1, span AS x2
FROM ({q}) q JOIN ({universe}) u ON u.symbol = q.symbol WHERE label_end_date IS NOT NULL AND m20 IS NOT NULL AND label_bull_forward_return_{h} IS NOT NULL"""


COLUMNS = "symbol, Date, sector, label_end_date, p, q, er, emfe, emae, y, tbs, sbt, r, mfe, mae, dollar_volume, x1, x2"


def pooled(d: Dialect, t: str) -> str:
    """Rows once for their scope and once for POOLED."""
    each = "explode" if d.spark else "unnest"
    both = d.lit_array("scope", "'POOLED'")
    return f"SELECT one AS scope, {COLUMNS} FROM (SELECT {each}({both}) AS one, {COLUMNS} FROM ({t}) a) b"


def ranked(d: Dialect, t: str, by: str, order: str) -> str:
    """Rows with ``rn``, their place in their scope by (by, order), and ``n``, the rows of the scope.

    In Spark rows are put between sampled quantiles of ``by`` (64 a scope); a row's place is what the buckets
    before hold and its place in its bucket, so no window holds a scope."""
    if not d.spark:
        return f"SELECT *, row_number() OVER (PARTITION BY scope ORDER BY {by}, {order}) AS rn, count(*) OVER (PARTITION BY scope) AS n FROM ({t}) t"
    value = f"CAST(unix_date({by}) AS DOUBLE)" if by == "Date" else by
    cuts = f"SELECT scope AS c_scope, percentile_approx({value}, array({', '.join(f'{k / 64}D' for k in range(1, 64))}), 1000) AS cuts FROM ({t}) t GROUP BY scope"
    rows = f"SELECT t.*, size(filter(cuts, c -> c < {value})) AS bucket FROM ({t}) t JOIN ({cuts}) c ON c_scope = scope"
    sizes = f"SELECT scope AS b_scope, bucket AS b, count(*) AS k FROM ({rows}) s GROUP BY scope, bucket"
    sums = f"SELECT *, sum(k) OVER (PARTITION BY b_scope ORDER BY b) - k AS before, sum(k) OVER (PARTITION BY b_scope) AS n FROM ({sizes}) z"
    return f"SELECT r.*, before + row_number() OVER (PARTITION BY scope, bucket ORDER BY {by}, {order}) AS rn, n FROM ({rows}) r JOIN ({sums}) b ON b_scope = scope AND b = bucket"


def deciles(d: Dialect, t: str) -> str:
    """Rows with ``bin``: ten bins of equal counts by the rank of p, ties broken by symbol and date."""
    rows = ranked(d, t, "p", "symbol, Date")
    if d.spark:  # the quantile k / 10 of the ranks 1 to n lies at 1 + (n - 1) k / 10
        return f"SELECT *, greatest(CAST(ceil(10.0D * (rn - 1) / greatest(n - 1, 1)) AS INT) - 1, 0) AS bin FROM ({rows}) r"
    qs = d.lit_array(*(f"{k / 10}" for k in range(1, 10)))
    return f"SELECT r.*, len(list_filter(edges, lambda v: round(v, 6) < rn)) AS bin FROM ({rows}) r JOIN (SELECT scope, quantile_cont(rn, {qs}) AS edges FROM ({rows}) e GROUP BY scope) e ON e.scope = r.scope"


def calibration_table(d: Dialect, t: str) -> str:
    return f"SELECT scope, bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS realized, round(abs(avg(p) - avg(y)), 6) AS gap, round(avg(r), 6) AS mean_r FROM ({deciles(d, t)}) b GROUP BY scope, bin"


def calibration_error(d: Dialect, t: str) -> str:
    table = f"SELECT scope, bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM ({deciles(d, t)}) b GROUP BY scope, bin"
    return f"SELECT scope, round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS max_gap FROM ({table}) g GROUP BY scope"


def width_error(d: Dialect, t: str) -> str:
    """Calibration error over ten buckets of equal width, the last one closed."""
    table = f"SELECT scope, CAST(least(floor(p * 10), 9) AS INT) AS b, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM ({pooled(d, t)}) s GROUP BY scope, CAST(least(floor(p * 10), 9) AS INT)"
    return f"SELECT scope, round(sum(n * gap) / sum(n), 6) AS ece_width FROM ({table}) g GROUP BY scope"


def buckets(d: Dialect, t: str) -> str:
    """Ten probability buckets for each scope, empty ones too."""
    rows = f"SELECT scope, CAST(least(floor(p * 10), 9) AS INT) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my, avg(r) AS mr, avg(mfe) AS mm, avg(mae) AS ma FROM ({pooled(d, t)}) s GROUP BY scope, CAST(least(floor(p * 10), 9) AS INT)"
    every = f"SELECT scope, b FROM (SELECT DISTINCT scope FROM ({pooled(d, t)}) x) s CROSS JOIN (SELECT {d.explode_range('0', '9')} AS b) k"
    return f"SELECT e.scope, CAST(e.b AS INT) AS bucket, coalesce(n, 0) AS n, round(mp, 6) AS mean_p, round(my, 6) AS realized, round(mr, 6) AS mean_r, round(mm, 6) AS mean_mfe, round(ma, 6) AS mean_mae FROM ({every}) e LEFT JOIN ({rows}) r ON r.scope = e.scope AND r.b = e.b"


def reached(d: Dialect, t: str, grid: list[float], sums: dict[str, str]) -> str:
    """Per scope and threshold of a grid, sums over the rows that reach it. In Spark rows are added up by how
    many thresholds they reach, and these few sums from the highest down; the oracle repeats rows."""
    named = ", ".join(f"{e} AS {n}" for n, e in sums.items())
    if not d.spark:
        steps = " UNION ALL ".join(f"SELECT {D(x)} AS threshold" for x in grid)
        return f"SELECT k.scope, threshold, {named} FROM (SELECT DISTINCT scope FROM ({t}) x) k CROSS JOIN ({steps}) g LEFT JOIN ({t}) s ON s.scope = k.scope AND p >= threshold GROUP BY k.scope, threshold"
    level = " + ".join(f"CAST(p >= {x}D AS INT)" for x in grid)
    by = f"SELECT scope, {level} AS reach, {named} FROM ({t}) s GROUP BY scope, {level}"
    steps = ", ".join(f"struct({x}D AS threshold, {k + 1} AS k)" for k, x in enumerate(grid))
    return f"SELECT scope, threshold, {', '.join(f'coalesce(sum(CASE WHEN reach >= k THEN {n} END), 0) AS {n}' for n in sums)} FROM (SELECT *, inline(array({steps})) FROM ({by}) b) g GROUP BY scope, threshold"


def crowded(d: Dialect, t: str, grid: list[float], keys: dict[str, str]) -> str:
    """Per scope and threshold that rows reach, how many of those rows share the commonest value of each key. In Spark
    rows are added up by scope, keys and how many thresholds they reach; the oracle counts the rows of each threshold."""
    if not d.spark:
        steps = " UNION ALL ".join(f"SELECT {D(x)} AS threshold" for x in grid)
        one = lambda n, e: f"SELECT scope, threshold, max(c) AS {n} FROM (SELECT scope, threshold, {e} AS v, count(*) AS c FROM ({t}) s JOIN ({steps}) g ON p >= threshold GROUP BY scope, threshold, {e}) {n}_c GROUP BY scope, threshold"
    else:
        level = " + ".join(f"CAST(p >= {x}D AS INT)" for x in grid)
        steps = ", ".join(f"struct({x}D AS threshold, {k + 1} AS k)" for k, x in enumerate(grid))
        by = f"SELECT scope, {', '.join(f'{e} AS {n}' for n, e in keys.items())}, {level} AS reach, count(*) AS c FROM ({t}) s WHERE p >= {grid[0]}D GROUP BY scope, {', '.join(keys.values())}, {level}"
        one = lambda n, e: f"SELECT scope, threshold, max(c) AS {n} FROM (SELECT scope, threshold, {n}, sum(c) AS c FROM (SELECT *, inline(array({steps})) FROM ({by}) b) g WHERE reach >= k GROUP BY scope, threshold, {n}) {n}_c GROUP BY scope, threshold"
    first, *more = keys
    joined = " ".join(f"JOIN ({one(n, keys[n])}) {n}_t ON {n}_t.scope = {first}_t.scope AND {n}_t.threshold = {first}_t.threshold" for n in more)
    return f"SELECT {first}_t.scope AS c_scope, {first}_t.threshold AS c_threshold, {', '.join(keys)} FROM ({one(first, keys[first])}) {first}_t {joined}"


def thresholds(d: Dialect, t: str) -> str:
    """Per threshold: rows that reach it, precision, recall, mean return and excursions, largest share of a symbol and of a year."""
    got = reached(d, pooled(d, t), GRID, {"n": "count(p)", "hits": "sum(y)", "returns": "sum(r)", "ups": "sum(mfe)", "downs": "sum(mae)"})
    most = crowded(d, pooled(d, t), GRID, {"of_symbol": "symbol", "of_year": "year(Date)"})
    all_ = f"SELECT scope AS a_scope, count(*) AS rows_in, sum(y) AS positives FROM ({pooled(d, t)}) a GROUP BY scope"
    return f"""SELECT scope, threshold, n AS qualifying, round(CAST(n AS DOUBLE) / rows_in, 6) AS rate, round({d.div('hits', 'n')}, 6) AS hit_rate, round({d.div('hits', 'positives')}, 6) AS recall, round({d.div('returns', 'n')}, 6) AS mean_r,
round({d.div('ups', 'n')}, 6) AS mean_mfe, round({d.div('downs', 'n')}, 6) AS mean_mae, round(CAST(of_symbol AS DOUBLE) / n, 6) AS symbol_concentration, round(CAST(of_year AS DOUBLE) / n, 6) AS year_concentration
FROM ({got}) g JOIN ({all_}) a ON a_scope = scope LEFT JOIN ({most}) m ON c_scope = scope AND c_threshold = threshold"""


def utility(d: Dialect, t: str) -> str:
    """Per threshold: payoff of target rate t and stop rate s as 2 t - s (in average ranges), less cost; largest share of a
    symbol and of a sector."""
    got = reached(d, t, UTILITY_GRID, {"n": "count(p)", "targets": "sum(tbs)", "stops": "sum(sbt)", "returns": "sum(r)"})
    most = crowded(d, t, UTILITY_GRID, {"of_symbol": "symbol", "of_sector": "sector"})
    rates = f"SELECT scope, threshold, n, {d.div('targets', 'n')} AS target, {d.div('stops', 'n')} AS stop, {d.div('returns', 'n')} AS mean_r FROM ({got}) g"
    return f"SELECT scope, threshold, n, round(target, 6) AS target_rate, round(stop, 6) AS stop_rate, round(greatest(0.0, 1 - target - stop), 6) AS unresolved_rate, round(2 * target - stop, 6) AS payoff, round(2 * target - stop - 0.0005, 6) AS payoff_after_cost, round(mean_r, 6) AS mean_return, round(CAST(of_symbol AS DOUBLE) / n, 6) AS symbol_concentration, round(CAST(of_sector AS DOUBLE) / n, 6) AS sector_concentration FROM ({rates}) q LEFT JOIN ({most}) m ON c_scope = scope AND c_threshold = threshold"


def summary(d: Dialect, t: str) -> str:
    """Brier score, skill over the base rate, error sizes, calibration line."""
    naive = "avg(y * y) - avg(y) * avg(y)" if d.spark else "avg((base - y) * (base - y))"
    rows = f"({pooled(d, t)})" if d.spark else f"(SELECT *, avg(y) OVER (PARTITION BY scope) AS base FROM ({pooled(d, t)}) s)"
    return f"""SELECT scope, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round({naive}, 6) AS naive_brier, round(1 - {d.div('avg((p - y) * (p - y))', naive)}, 6) AS skill, round(avg(abs(p - y)), 6) AS mae,
round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(regr_slope(y, p), 5) AS slope, round(regr_intercept(y, p), 5) AS intercept, count(DISTINCT round(p, 12)) AS unique_p FROM {rows} b GROUP BY scope"""


def roc_auc(d: Dialect, t: str) -> str:
    """Area under the ROC curve: positives above negatives, ties by half. Rows are added up by score first."""
    if not d.spark:
        rk = f"SELECT scope, y, rank() OVER (PARTITION BY scope ORDER BY p) + (count(*) OVER (PARTITION BY scope, p) - 1) / 2.0::DOUBLE AS rk FROM ({pooled(d, t)}) s"
        return f"SELECT scope, round({d.div('sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2', 'sum(y) * (count(*) - sum(y))')}, 6) AS roc_auc FROM ({rk}) r GROUP BY scope"
    by = f"SELECT scope, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM ({pooled(d, t)}) s GROUP BY scope, p"
    run = f"SELECT *, sum(neg) OVER (PARTITION BY scope ORDER BY p) - neg AS below FROM ({by}) b"
    return f"SELECT scope, round({d.div('sum(pos * (below + neg / 2))', 'sum(pos) * sum(neg)')}, 6) AS roc_auc FROM ({run}) r GROUP BY scope"


def pr_auc(d: Dialect, t: str) -> str:
    """Average precision: precision at each distinct score times the recall it adds."""
    by = f"SELECT scope, p, sum(y) AS pos, count(*) AS n FROM ({pooled(d, t)}) s GROUP BY scope, p"
    down = "OVER (PARTITION BY scope ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    run = f"SELECT scope, pos, sum(pos) {down} AS tp, sum(n) {down} AS seen, sum(pos) OVER (PARTITION BY scope) AS total FROM ({by}) b"
    return f"SELECT scope, round(sum({d.div('pos', 'total')} * tp / seen), 6) AS pr_auc FROM ({run}) r GROUP BY scope"


def spearman(d: Dialect, t: str) -> str:
    """Correlation of average ranks. Ties of equal values share the mean of their places."""
    if not d.spark:
        rk = "rank() OVER (PARTITION BY scope ORDER BY {0}) + (count(*) OVER (PARTITION BY scope, {0}) - 1) / CAST(2 AS DOUBLE)"
        return f"SELECT scope, round({d.div('covar_pop(a, b)', 'stddev_pop(a) * stddev_pop(b)')}, 6) AS rank_corr FROM (SELECT scope, {rk.format('p')} AS a, {rk.format('r')} AS b FROM ({pooled(d, t)}) s) q GROUP BY scope"
    first = f"SELECT scope, p, r, avg(rn) OVER (PARTITION BY scope, p) AS a FROM ({ranked(d, f'SELECT scope, p, r FROM ({pooled(d, t)}) s', 'p', 'r')}) x"
    second = f"SELECT scope, a, avg(rn) OVER (PARTITION BY scope, r) AS b FROM ({ranked(d, first, 'r', 'a')}) y"
    return f"SELECT scope, round({d.div('covar_pop(a, b)', 'stddev_pop(a) * stddev_pop(b)')}, 6) AS rank_corr FROM ({second}) z GROUP BY scope"


def plateaus(d: Dialect, t: str) -> str:
    """Distinct probabilities and the share of the most frequent one."""
    by = f"SELECT scope, round(p, 12) AS v, count(*) AS n FROM ({t}) s GROUP BY scope, round(p, 12)"
    return f"SELECT scope, count(*) AS distinct_p, round({D('max(n)')} / sum(n), 6) AS plateau_share FROM ({by}) b GROUP BY scope"


def distribution(d: Dialect, t: str) -> str:
    qs = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    cols = ", ".join(f"round({d.percentile('p', q)}, 4) AS p{int(100 * q):02d}" for q in qs)
    reach = ", ".join(f"count(CASE WHEN p >= {x} THEN 1 END) AS ge_{int(100 * x)}" for x in GRID)
    return f"SELECT scope, count(*) AS n, round(min(p), 6) AS least, round(max(p), 6) AS most, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS std, round(stddev_pop(p), 6) AS std_pop, {cols}, {reach} FROM ({pooled(d, t)}) s GROUP BY scope"


def concentration(d: Dialect, t: str) -> str:
    """Largest share of a symbol, of a year, of a year's absolute return; share of years with a positive mean."""
    out = []
    for name, key in (("symbol", "symbol"), ("year", "CAST(year(Date) AS VARCHAR(10))")):
        by = f"SELECT scope, {key} AS k, count(*) AS n, sum(abs(r)) AS a, avg(r) AS m FROM ({t}) s GROUP BY scope, {key}"
        out.append(f"SELECT scope, '{name}' AS kind, round({D('max(n)')} / sum(n), 6) AS top_share, round({d.div('max(a)', 'sum(a)')}, 6) AS return_concentration, round(avg(CASE WHEN m > 0 THEN {D(1)} ELSE {D(0)} END), 6) AS positive_fraction FROM ({by}) b GROUP BY scope")
    return " UNION ALL ".join(out)


def fold_stability(d: Dialect, t: str) -> str:
    """Three chronological folds of near equal size per scope; the first ones hold one row more."""
    big = "n % 3 * (n DIV 3 + 1)" if d.spark else "n % 3 * (n // 3 + 1)"
    size = "(n DIV 3)" if d.spark else "(n // 3)"
    folds = f"SELECT *, CAST(CASE WHEN rn <= {big} THEN ceil(rn / CAST({size} + 1 AS DOUBLE)) ELSE n % 3 + ceil((rn - {big}) / CAST({size} AS DOUBLE)) END AS INT) AS fold FROM ({ranked(d, t, 'Date', 'symbol')}) s" if d.spark else f"SELECT *, ntile(3) OVER (PARTITION BY scope ORDER BY Date, symbol)::INT AS fold FROM ({t}) s"
    return f"SELECT scope, fold, count(*) AS n, round(avg(r), 6) AS mean_r, round(avg(y), 6) AS hit_rate, round(avg((p - y) * (p - y)), 6) AS brier, min(Date) AS first_date, max(Date) AS last_date FROM ({folds}) f GROUP BY scope, fold"


def profit_factors(d: Dialect, t: str) -> str:
    """Gains over losses with the state of the evidence."""
    q = f"SELECT scope, sum(CASE WHEN r > 0 THEN r ELSE 0 END) AS gains, sum(CASE WHEN r < 0 THEN -r ELSE 0 END) AS losses, count(*) AS n FROM ({t}) s GROUP BY scope"
    return f"SELECT scope, round(gains, 5) AS gains, round(losses, 5) AS losses, round({d.div('gains', 'losses')}, 6) AS profit_factor, CASE WHEN n = 0 THEN 'NOT_APPLICABLE' WHEN losses > 0 THEN 'AVAILABLE' WHEN gains > 0 THEN 'INFINITE' ELSE 'UNAVAILABLE' END AS evidence FROM ({q}) q"


def feature_shift(d: Dialect, t: str) -> str:
    """Mean shift of each feature between an earlier and a later half of the dates, in deviations of the earlier."""
    half = f"SELECT *, CASE WHEN year(Date) < 1995 THEN 'train' ELSE 'recent' END AS part FROM ({t}) s"
    long = f"SELECT part, 'x1' AS feature, x1 AS v FROM ({half}) a UNION ALL SELECT part, 'x2' AS feature, x2 AS v FROM ({half}) b UNION ALL SELECT part, 'p' AS feature, p AS v FROM ({half}) c"
    by = f"SELECT feature, avg(CASE WHEN part = 'train' THEN v END) AS a, avg(CASE WHEN part = 'recent' THEN v END) AS b, stddev_pop(CASE WHEN part = 'train' THEN v END) AS s FROM ({long}) l GROUP BY feature"
    return f"SELECT feature, round(a, 6) AS train_mean, round(b, 6) AS recent_mean, round({d.div('abs(b - a)', 's')}, 6) AS shift, CASE WHEN {d.div('abs(b - a)', 's')} > 2.5 THEN 'DRIFT' ELSE 'STABLE' END AS status FROM ({by}) q"


def ood(d: Dialect, t: str) -> str:
    """Share of rows outside the earlier rows' 1 % to 99 % bounds per scope, severity, and the Wilson upper bound of the rate."""
    bounds = f"SELECT {d.percentile('x1', 0.01)} AS lo, {d.percentile('x1', 0.99)} AS hi FROM ({t}) s WHERE year(Date) < 1995"
    rows = f"SELECT scope, greatest(0.0, {d.div('lo - x1', 'hi - lo')}, {d.div('x1 - hi', 'hi - lo')}) AS severity FROM ({t}) s CROSS JOIN ({bounds}) b WHERE year(Date) >= 1995"
    by = f"SELECT scope, count(*) AS n, avg(CASE WHEN severity > 0 THEN {D(1)} ELSE {D(0)} END) AS rate, max(severity) AS worst, {d.percentile('CASE WHEN severity > 0 THEN severity END', 0.99)} AS nonzero_q99 FROM ({rows}) r GROUP BY scope"
    z = 2.326347874
    wilson = f"(rate + {z * z} / (2 * n) + {z} * sqrt(rate * (1 - rate) / n + {z * z} / (4 * n * n))) / (1 + {z * z} / n)"
    return f"SELECT scope, n, round(rate, 6) AS ood_rate, round(worst, 6) AS worst, round(nonzero_q99, 6) AS nonzero_q99, round({wilson}, 6) AS rate_limit FROM ({by}) q"


def selection_density(d: Dialect, t: str) -> str:
    """How many rows qualify per date, and the most that are held at once."""
    chosen = f"SELECT * FROM ({t}) s WHERE p >= 0.6"
    per = f"SELECT Date, count(*) AS n FROM ({chosen}) c GROUP BY Date"
    events = f"SELECT Date AS moment, 0 AS o, 1 AS step FROM ({chosen}) a UNION ALL SELECT label_end_date AS moment, 1 AS o, -1 AS step FROM ({chosen}) b"
    daily = f"SELECT moment, o, sum(step) AS step FROM ({events}) e GROUP BY moment, o"
    sweep = f"SELECT max(held) AS most FROM (SELECT sum(step) OVER (ORDER BY moment, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM ({daily}) e) h"
    return f"SELECT count(*) AS dates, max(n) AS most_a_day, round({d.percentile('n', 0.5)}, 6) AS median_a_day, round({d.percentile('n', 0.9)}, 6) AS p90_a_day, max(most) AS most_held FROM ({per}) p CROSS JOIN ({sweep}) s"


def gates(d: Dialect, t: str) -> str:
    """Metrics against thresholds: a value near its threshold counts as reaching it; a missing value fails."""
    one = f"SELECT scope, {D('count(*)')} AS samples, avg((p - y) * (p - y)) AS brier, avg(r) AS mean_return, {d.div('sum(CASE WHEN r > 0 THEN r ELSE 0 END)', 'sum(CASE WHEN r < 0 THEN -r ELSE 0 END)')} AS profit_factor FROM ({t}) s GROUP BY scope"
    rules = [("samples", ">=", 200), ("brier", "<=", 0.25), ("mean_return", ">=", 0.0), ("profit_factor", ">=", 1.05)]
    long = " UNION ALL ".join(f"SELECT scope, '{n}' AS gate, {n} AS v, '{c}' AS comparator, {D(x)} AS threshold FROM ({one}) g" for n, c, x in rules)
    near = "abs(v - threshold) <= 1e-9 * greatest(abs(v), abs(threshold))"
    return f"SELECT scope, gate, round(v, 6) AS v, comparator, threshold, CASE WHEN v IS NULL THEN 'FAIL' WHEN {near} THEN 'PASS' WHEN comparator = '>=' AND v >= threshold THEN 'PASS' WHEN comparator = '<=' AND v <= threshold THEN 'PASS' ELSE 'FAIL' END AS status FROM ({long}) l"


def promotion(d: Dialect, t: str) -> str:
    return f"SELECT scope, count(CASE WHEN status = 'PASS' THEN 1 END) AS passed, count(CASE WHEN status <> 'PASS' THEN 1 END) AS failed, CASE WHEN count(CASE WHEN status <> 'PASS' THEN 1 END) = 0 THEN 'ELIGIBLE' ELSE 'BLOCKED' END AS decision FROM ({gates(d, t)}) g GROUP BY scope"


def isotonic_steps(d: Dialect, t: str) -> str:
    """Support of each distinct probability step."""
    by = f"SELECT scope, round(p, 2) AS step, count(*) AS n, avg(y) AS rate FROM ({t}) s GROUP BY scope, round(p, 2)"
    return f"SELECT scope, step, n, round(rate, 6) AS rate, row_number() OVER (PARTITION BY scope ORDER BY step) AS step_id FROM ({by}) b"


VIEWS = {f.__name__: f for f in (calibration_table, calibration_error, width_error, buckets, thresholds, utility, summary, roc_auc, pr_auc, spearman, plateaus, distribution, concentration, fold_stability, profit_factors, feature_shift, ood, selection_density, gates, promotion, isotonic_steps)}
