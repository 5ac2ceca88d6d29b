"""Audits and maintenance of bar tables, as SQL over the query for bars."""

from __future__ import annotations

from tidemark.functions.dialect import Dialect, lag
from tidemark.sources.bars import checks_sql


def checks(d: Dialect, bars: str) -> str:
    return checks_sql(bars)


def inventory(d: Dialect, bars: str) -> str:
    """Rows and dates of each symbol, and how old its last bar is."""
    by = f"SELECT symbol, count(*) AS n, min(Date) AS first_date, max(Date) AS last_date FROM ({bars}) b GROUP BY symbol"
    age = d.days("(SELECT max(Date) FROM (" + bars + ") m)", "last_date")
    return f"SELECT symbol, n, first_date, last_date, CASE WHEN age <= 3 THEN 'FRESH' WHEN age <= 10 THEN 'STALE' ELSE 'VERY_STALE' END AS staleness FROM (SELECT *, {age} AS age FROM ({by}) s) a"


def structure(d: Dialect, bars: str) -> str:
    """Counts of oddities of each symbol."""
    q = f"SELECT *, {d.div('Close', lag('Close'))} - 1 AS move, {d.days('Date', lag('Date'))} AS gap FROM ({bars}) b"
    return f"""SELECT symbol, count(*) AS n, count(CASE WHEN Volume = 0 THEN 1 END) AS zero_volume, count(CASE WHEN High = Low THEN 1 END) AS flat, count(CASE WHEN High < Low THEN 1 END) AS invalid, round(max(abs(move)), 6) AS largest_move, max(gap) AS longest_gap FROM ({q}) q GROUP BY symbol"""


def largest_moves(d: Dialect, bars: str, k: int = 10) -> str:
    q = f"SELECT symbol, Date, {d.div('Close', lag('Close'))} - 1 AS move FROM ({bars}) b"
    return f"SELECT symbol, Date, round(move, 6) AS move, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(move) DESC NULLS LAST, Date) AS rk FROM ({q}) q) r WHERE rk <= {k}"


def merged(d: Dialect, bars: str) -> str:
    """History before 1996 with a download from 1995 on: replaced and inserted rows of each symbol."""
    old, new = f"SELECT * FROM ({bars}) b WHERE year(Date) <= 1995", f"SELECT symbol, Date, Open, High, Low, Close * 1.01 AS Close, Volume FROM ({bars}) b WHERE year(Date) >= 1995"
    return f"""SELECT n.symbol, count(o.symbol) AS replaced, count(*) - count(o.symbol) AS inserted, round(sum(n.Close), 2) AS close_sum FROM ({new}) n LEFT JOIN ({old}) o ON o.symbol = n.symbol AND o.Date = n.Date GROUP BY n.symbol"""


def hygiene(d: Dialect, bars: str) -> str:
    """Non-finite and huge values of derived columns become null; counts of each kind."""
    q = f"SELECT symbol, CAST({d.div('Close - Open', 'High - Low')} AS DOUBLE) AS x1, Close * CASE WHEN day(Date) = 1 THEN 8e304 ELSE 1e300 END AS x2 FROM ({bars}) b"
    return f"SELECT symbol, count(*) AS n, count(CASE WHEN x1 IS NULL THEN 1 END) AS x1_missing, count(CASE WHEN abs(x2) > 1e308 THEN 1 END) AS x2_replaced, count(CASE WHEN abs(x2) <= 1e308 THEN 1 END) AS x2_kept FROM ({q}) q GROUP BY symbol"


def yearly(d: Dialect, bars: str) -> str:
    """Counts and volume by (symbol, year), by year, and in all."""
    return f"SELECT coalesce(symbol, 'ALL') AS symbol, coalesce(CAST(yr AS VARCHAR(10)), 'ALL') AS yr, count(*) AS n, round(sum(Volume), 2) AS volume FROM (SELECT *, year(Date) AS yr FROM ({bars}) b) y GROUP BY GROUPING SETS ((symbol, yr), (yr), ())"


VIEWS = {f.__name__: f for f in (checks, inventory, structure, largest_moves, merged, hygiene, yearly)}
