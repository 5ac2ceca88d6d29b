"""Eligibility, policies, caps, decisions and orders of candidates, as SQL over scored rows."""

from __future__ import annotations

from tidemark.functions.dialect import Dialect
from tidemark.operators.metrics import D

#: Minimums of the candidate policy.
POLICY = (("p", 0.55, "probability"), ("er", 0.0, "expected_return"), ("q", 0.5, "target_before_stop"), ("liquidity", 0.5, "liquidity"))
#: Score, symbol, direction, model: no two candidates of a date are equal in all of them.
ORDER = "p * er DESC NULLS LAST, symbol, CASE WHEN x1 >= 0 THEN 'Bullish' ELSE 'Bearish' END DESC, scope"


def policy(d: Dialect, t: str) -> str:
    """Each row's reasons against it: missing, not finite and below a minimum are different ones; equal passes."""
    reasons = ", ".join(f"CASE WHEN {c} IS NULL THEN '{n}_missing' WHEN isnan({c}) OR abs({c}) > 1e308 THEN '{n}_not_finite' WHEN {c} < {x} THEN '{n}_below_minimum' END" for c, x, n in POLICY)
    rows = f"SELECT *, least({D('1')}, log10(greatest(dollar_volume, 1)) / 9) AS liquidity FROM ({t}) s"
    return f"SELECT symbol, Date, concat_ws(';', {reasons}) AS reasons, CASE WHEN concat_ws(';', {reasons}) = '' THEN 'ELIGIBLE' ELSE 'REJECTED' END AS status FROM ({rows}) r"


def capped(d: Dialect, t: str, per_date: int = 2, total: int = 500) -> str:
    """At most so many a date, then so many in all, in the canonical order."""
    day = f"SELECT *, row_number() OVER (PARTITION BY Date ORDER BY {ORDER}) AS day_rank FROM ({t}) s"
    top = f"SELECT * FROM ({day}) d WHERE day_rank <= {per_date} ORDER BY p * er DESC, Date, symbol LIMIT {total}"
    return f"SELECT symbol, Date, round(p, 6) AS p, CAST(day_rank AS INT) AS day_rank, CAST(row_number() OVER (ORDER BY p * er DESC, Date, symbol) AS INT) AS overall_rank FROM ({top}) x"


def scanner_caps(d: Dialect, t: str, cap: int = 1) -> str:
    """Actionable rows beyond a scope's cap on a date stay, as rejected."""
    rk = f"SELECT *, row_number() OVER (PARTITION BY Date, scope ORDER BY {ORDER}) AS rk FROM ({t}) s WHERE p >= 0.55"
    return f"SELECT symbol, Date, scope, CASE WHEN rk <= {cap} THEN 'CANDIDATE' ELSE 'REJECTED' END AS status, CASE WHEN rk > {cap} THEN 'over_model_cap' ELSE '' END AS reason FROM ({rk}) r"


def common_session(d: Dialect, t: str) -> str:
    """Latest date on which every symbol has a row."""
    return f"SELECT max(Date) AS common_date FROM (SELECT Date FROM ({t}) s GROUP BY Date HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM ({t}) x)) c"


def research_window(d: Dialect, t: str, end: str = "1997-06-30") -> str:
    """Rows whose outcome was known by the end of research."""
    return f"SELECT symbol, Date, label_end_date, round(p, 6) AS p FROM ({t}) s WHERE Date <= DATE '{end}' AND label_end_date <= DATE '{end}' AND scope IN ('stock', 'sector_etf')"


def splits(d: Dialect, t: str, h: int = 5, embargo: int = 1) -> str:
    """Train, calibration and holdout by unique dates, purged of outcomes that reach the next part, with an embargo."""
    dates = f"SELECT Date, row_number() OVER (ORDER BY Date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT Date FROM ({t}) s) x"
    sizes = f"SELECT Date, k, n, greatest(CAST(floor(n * 0.2) AS INT), {h + 2}) AS part FROM ({dates}) y"
    cut = f"SELECT max(CASE WHEN k = n - 2 * part + 1 THEN Date END) AS calibration, max(CASE WHEN k = n - part + 1 THEN Date END) AS holdout, max(CASE WHEN k = n - 2 * part + 1 - {embargo} THEN Date END) AS calibration_embargo, max(CASE WHEN k = n - part + 1 - {embargo} THEN Date END) AS holdout_embargo FROM ({sizes}) z"
    return f"""SELECT symbol, Date, CASE WHEN Date >= holdout THEN 'holdout' WHEN Date >= calibration THEN CASE WHEN label_end_date < holdout AND Date < holdout_embargo THEN 'calibration' ELSE 'purged' END
WHEN label_end_date < calibration AND Date < calibration_embargo THEN 'train' ELSE 'purged' END AS part FROM ({t}) s CROSS JOIN ({cut}) c"""


def calibration_folds(d: Dialect, t: str) -> str:
    return f"SELECT Date, ntile(4) OVER (ORDER BY Date) AS fold FROM (SELECT DISTINCT Date FROM ({t}) s) x"


def peers(d: Dialect, t: str) -> str:
    """Rank among the rows of a scope on a date."""
    return f"SELECT symbol, Date, scope, CAST(row_number() OVER (PARTITION BY Date, scope ORDER BY r DESC, symbol) AS INT) AS peer_rank, CAST(count(*) OVER (PARTITION BY Date, scope) AS INT) AS n_peers FROM ({t}) s"


VIEWS = {f.__name__: f for f in (policy, capped, scanner_caps, common_session, research_window, splits, calibration_folds, peers)}
