"""Recursive indicators: Wilder's averages, RSI, exponential means, directional movement.

A recursion over one symbol's days is sequential by nature. Each symbol is one group of a grouped
function; a symbol's history is bounded by the calendar (a few ten thousand days), whatever the
number of symbols, so groups stay small while they spread over all executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

RSI_LENGTHS = tuple(range(2, 51))


def wilder(x: np.ndarray, length: int) -> np.ndarray:
    """Wilder's average: the mean of the first ``length`` values from the first known one on, then
    recursive. A missing value later gives a missing result and keeps the state."""
    out = np.full(len(x), np.nan)
    known = np.flatnonzero(~np.isnan(x))
    if not len(known):
        return out
    seed = x[known[0] : known[0] + length]
    if len(seed) < length or np.isnan(seed).any():
        return out
    at, state = known[0] + length - 1, float(seed.mean())
    out[at] = state
    for k in range(at + 1, len(x)):
        if not np.isnan(x[k]):
            state = (state * (length - 1) + x[k]) / length
            out[k] = state
    return out


def rsi(close: np.ndarray, length: int) -> np.ndarray:
    """Wilder's RSI: 50 without movement, 100 without losses, 0 without gains."""
    out = np.full(len(close), np.nan)
    if len(close) <= length:
        return out
    step = np.diff(close)
    gain, loss = wilder(np.maximum(step, 0.0), length), wilder(np.maximum(-step, 0.0), length)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = 100.0 - 100.0 / (1.0 + gain / loss)
    value = np.where(loss == 0, np.where(gain == 0, 50.0, 100.0), np.where(gain == 0, 0.0, value))
    out[1:] = np.where(np.isnan(gain), np.nan, value)
    return out


def ema(x: np.ndarray, alpha: float, least: int) -> np.ndarray:
    """Exponential mean that begins with the first value, missing for the first ``least`` - 1."""
    out = np.empty(len(x))
    state = np.nan
    for k, v in enumerate(x):
        state = v if k == 0 else (1 - alpha) * state + alpha * v
        out[k] = state if k + 1 >= least else np.nan
    return out


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate([[np.nan], close[:-1]])
    return np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, np.nan, a / b)


def later(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.full(min(k, len(x)), np.nan), x[: max(0, len(x) - k)]])


def ranges_of(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Average true ranges, their share of the price, directional movement and the label's exponential range."""
    high, low, close = g["High"], g["Low"], g["Close"]
    tr, out = true_range(high, low, close), {}
    for w in (5, 14, 20):
        out[f"atr_{w}"] = wilder(tr, w)
        out[f"atr_pct_{w}"] = ratio(out[f"atr_{w}"], close)
    up, down = high - later(high, 1), low - later(low, 1)
    plus = np.where((up > np.abs(down)) & (up > 0), up, 0.0)
    minus = np.where((np.abs(down) > up) & (down < 0), np.abs(down), 0.0)
    out["plus_di_14"] = 100.0 * ratio(wilder(plus, 14), out["atr_14"])
    out["minus_di_14"] = 100.0 * ratio(wilder(minus, 14), out["atr_14"])
    dx = 100.0 * ratio(np.abs(out["plus_di_14"] - out["minus_di_14"]), out["plus_di_14"] + out["minus_di_14"])
    out["adx_14"] = wilder(dx, 14)
    out["label_atr_14"] = ema(tr, 1 / 14, 14)
    mean = pd.Series(close).rolling(20).mean().to_numpy()
    out["keltner_distance_20"] = ratio(close - mean, out["atr_20"])
    return out


def macd_of(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    close = g["Close"]
    macd = ratio(ema(close, 2 / 13, 12) - ema(close, 2 / 27, 26), close)
    return {"macd_12_26": macd, "macd_12_26_slope_5": macd - later(macd, 5)}


def share_at_most(x: np.ndarray, width: int, least: int) -> np.ndarray:
    """Share of the trailing rows whose value is at most the current one; a missing current value counts as above all."""
    padded = np.concatenate([np.full(width - 1, np.nan), x])
    frames = np.lib.stride_tricks.sliding_window_view(padded, width)
    below = (frames <= x[:, None]).sum(axis=1)
    known = (~np.isnan(frames)).sum(axis=1)
    return np.where(known >= least, below / np.minimum(np.arange(1, len(x) + 1), width), np.nan)


def wilder_many(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``wilder`` for several lengths at once; a column for each."""
    out = np.full((len(x), len(lengths)), np.nan)
    known = np.flatnonzero(~np.isnan(x))
    if not len(known):
        return out
    first, state = known[0], np.full(len(lengths), np.nan)
    seeds = {first + n - 1: k for k, n in enumerate(lengths.tolist()) if first + n <= len(x) and not np.isnan(x[first : first + n]).any()}
    for k in range(first, len(x)):
        if not np.isnan(x[k]):
            state = (state * (lengths - 1) + x[k]) / lengths
        if k in seeds:
            state[seeds[k]] = x[first : k + 1].mean()
        if not np.isnan(x[k]):
            out[k] = state
    return out


def rsi_many(close: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    step = np.diff(close)
    gain, loss = wilder_many(np.maximum(step, 0.0), lengths), wilder_many(np.maximum(-step, 0.0), lengths)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = 100.0 - 100.0 / (1.0 + gain / loss)
    value = np.where(loss == 0, np.where(gain == 0, 50.0, 100.0), np.where(gain == 0, 0.0, value))
    return np.concatenate([np.full((1, len(lengths)), np.nan), np.where(np.isnan(gain), np.nan, value)])[: len(close)]


def rsi_of(lengths: tuple[int, ...], wide: bool = True):
    def run(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out, every = {}, rsi_many(g["Close"], np.array(lengths))
        for k, n in enumerate(lengths):
            x = every[:, k]
            slope = x - later(x, 3)
            out |= {f"rsi_{n}": x, f"rsi_{n}_slope_3": slope, f"rsi_{n}_accel": slope - later(slope, 3)}
            if wide:
                prior = pd.Series(x).shift(1).rolling(252, min_periods=60)
                out[f"rsi_{n}_percentile_252"] = share_at_most(x, 252, 60)
                out[f"rsi_{n}_distance_low_zone"] = x - prior.quantile(0.2).to_numpy()
                out[f"rsi_{n}_distance_high_zone"] = x - prior.quantile(0.8).to_numpy()
        return out

    return run


def extended(bars: DataFrame, names: list[str]) -> DataFrame:
    """The bars (symbol, Date, OHLCV) with some of the series of ``ranges_of`` beside them."""
    columns = ["Open", "High", "Low", "Close", "Volume"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("Date")
        got = ranges_of({c: pdf[c].to_numpy(dtype=float) for c in columns})
        return pdf.assign(**{n: got[n] for n in names})

    out = bars.select("symbol", "Date", *columns).groupBy("symbol").applyInPandas(run, "symbol string, Date date, " + ", ".join(f"{n} double" for n in (*columns, *names)))
    return out.selectExpr("symbol", "Date", *columns, *(f"nanvl({n}, NULL) AS {n}" for n in names))


def by_symbol(bars: DataFrame, names: list[str], compute, digits: int | None = None) -> DataFrame:
    """symbol, Date and the named series that ``compute`` makes of a symbol's sorted bars."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("Date")
        got = compute({c: pdf[c].to_numpy(dtype=float) for c in ("Open", "High", "Low", "Close", "Volume")})
        return pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "Date": pdf["Date"].to_numpy(), **{n: got[n] for n in names}})

    out = bars.groupBy("symbol").applyInPandas(run, "symbol string, Date date, " + ", ".join(f"{n} double" for n in names))
    exprs = (f"CASE WHEN isnan({n}) THEN NULL ELSE {n if digits is None else f'round({n}, {digits})'} END AS {n}" for n in names)
    return out.selectExpr("symbol", "Date", *exprs)


RANGE_NAMES = [*(f"{n}_{w}" for w in (5, 14, 20) for n in ("atr", "atr_pct")), "plus_di_14", "minus_di_14", "adx_14", "label_atr_14", "keltner_distance_20"]
MACD_NAMES = ["macd_12_26", "macd_12_26_slope_5"]


def rsi_names(lengths: tuple[int, ...], wide: bool = True) -> list[str]:
    ends = ("", "_slope_3", "_accel", *(("_percentile_252", "_distance_low_zone", "_distance_high_zone") if wide else ()))
    return [f"rsi_{n}{e}" for n in lengths for e in ends]


def ranges(bars: DataFrame, digits: int | None = None) -> DataFrame:
    return by_symbol(bars, RANGE_NAMES, ranges_of, digits)


def macd(bars: DataFrame, digits: int | None = None) -> DataFrame:
    return by_symbol(bars, MACD_NAMES, macd_of, digits)


def rsi_family(bars: DataFrame, lengths: tuple[int, ...] = RSI_LENGTHS, wide: bool = True, digits: int | None = None) -> DataFrame:
    return by_symbol(bars, rsi_names(lengths, wide), rsi_of(lengths, wide), digits)


# Oracles: the same recursions as recursive SQL queries.


def _numbered(base: str, exprs: dict[str, str]) -> str:
    return f"SELECT symbol, Date, row_number() OVER (PARTITION BY symbol ORDER BY Date) AS rn, {', '.join(f'{e} AS {n}' for n, e in exprs.items())} FROM ({base}) b"


def wilder_ctes(name: str, source: str, x: str, length: int) -> str:
    """CTEs ``name``(symbol, rn, state, value) over source(symbol, rn, x)."""
    return f"""{name}_f AS (SELECT symbol, min(rn) AS f FROM {source} WHERE {x} IS NOT NULL GROUP BY symbol),
{name}_s AS (SELECT s.symbol, f + {length} - 1 AS rn, avg({x}) AS state FROM {source} s JOIN {name}_f USING (symbol) WHERE rn BETWEEN f AND f + {length} - 1 GROUP BY s.symbol, f HAVING count({x}) = {length}),
{name} AS (SELECT symbol, rn, state, state AS value FROM {name}_s UNION ALL
SELECT p.symbol, s.rn, CASE WHEN s.{x} IS NULL THEN p.state ELSE (p.state * ({length} - 1) + s.{x}) / {length} END, CASE WHEN s.{x} IS NOT NULL THEN (p.state * ({length} - 1) + s.{x}) / {length} END
FROM {name} p JOIN {source} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"""


def ema_ctes(name: str, source: str, x: str, alpha: str) -> str:
    return f"""{name} AS (SELECT symbol, rn, {x} AS state FROM {source} WHERE rn = 1 UNION ALL
SELECT p.symbol, s.rn, (1 - {alpha}) * p.state + {alpha} * s.{x} FROM {name} p JOIN {source} s ON s.symbol = p.symbol AND s.rn = p.rn + 1)"""


_W = "OVER (PARTITION BY symbol ORDER BY Date)"


def ranges_sql(base: str) -> str:
    pc, up, down = f"lag(Close) {_W}", f"(High - lag(High) {_W})", f"(Low - lag(Low) {_W})"
    b = _numbered(base, {"Close": "Close", "tr": f"greatest(High - Low, abs(High - {pc}), abs(Low - {pc}))", "plus": f"CASE WHEN {up} > abs({down}) AND {up} > 0 THEN {up} ELSE 0.0 END", "minus": f"CASE WHEN abs({down}) > {up} AND {down} < 0 THEN abs({down}) ELSE 0.0 END", "m20": f"CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY Date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN avg(Close) OVER (PARTITION BY symbol ORDER BY Date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END"})
    ctes = [f"WITH RECURSIVE b AS ({b})", *(wilder_ctes(f"a{w}", "b", "tr", w) for w in (5, 14, 20)), wilder_ctes("p", "b", "plus", 14), wilder_ctes("m", "b", "minus", 14)]
    ctes += ["di AS (SELECT b.symbol, b.rn, 100 * p.value / nullif(a14.value, 0) AS pdi, 100 * m.value / nullif(a14.value, 0) AS mdi FROM b LEFT JOIN p USING (symbol, rn) LEFT JOIN m USING (symbol, rn) LEFT JOIN a14 USING (symbol, rn))"]
    ctes += ["dx AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM di)", wilder_ctes("adx", "dx", "dx", 14), ema_ctes("e", "b", "tr", "(1.0::DOUBLE / 14)")]
    cols = [*(f"round(a{w}.value, 6) AS atr_{w}, round(a{w}.value / nullif(Close, 0), 6) AS atr_pct_{w}" for w in (5, 14, 20)), "round(pdi, 6) AS plus_di_14", "round(mdi, 6) AS minus_di_14", "round(adx.value, 6) AS adx_14", "CASE WHEN b.rn >= 14 THEN round(e.state, 6) END AS label_atr_14", "round((Close - m20) / nullif(a20.value, 0), 6) AS keltner_distance_20"]
    joins = " ".join(f"LEFT JOIN {t} USING (symbol, rn)" for t in ("a5", "a14", "a20", "di", "adx", "e"))
    return f"{', '.join(ctes)} SELECT symbol, Date, {', '.join(cols)} FROM b {joins}"


def macd_sql(base: str) -> str:
    ctes = [f"WITH RECURSIVE b AS ({_numbered(base, {'Close': 'Close'})})", ema_ctes("e12", "b", "Close", "(2.0::DOUBLE / 13)"), ema_ctes("e26", "b", "Close", "(2.0::DOUBLE / 27)")]
    ctes += ["m AS (SELECT symbol, Date, CASE WHEN b.rn >= 26 THEN (e12.state - e26.state) / nullif(Close, 0) END AS macd FROM b JOIN e12 USING (symbol, rn) JOIN e26 USING (symbol, rn))"]
    return f"{', '.join(ctes)} SELECT symbol, Date, round(macd, 6) AS macd_12_26, round(macd - lag(macd, 5) {_W}, 6) AS macd_12_26_slope_5 FROM m"


def rsi_sql(base: str, lengths: tuple[int, ...]) -> str:
    """rsi, slope, acceleration, percentile and zone distances of some lengths."""
    b = _numbered(base, {"gain": f"greatest(Close - lag(Close) {_W}, 0)", "loss": f"greatest(lag(Close) {_W} - Close, 0)", "known": f"lag(Close) {_W}"})
    b = f"SELECT symbol, Date, rn, CASE WHEN known IS NOT NULL THEN gain END AS gain, CASE WHEN known IS NOT NULL THEN loss END AS loss FROM ({b})"
    ctes, selects = [f"WITH RECURSIVE b AS ({b})"], []
    for n in lengths:
        ctes += [wilder_ctes(f"g{n}", "b", "gain", n), wilder_ctes(f"l{n}", "b", "loss", n)]
        ctes += [f"r{n} AS (SELECT b.symbol, b.Date, b.rn, CASE WHEN l.value = 0 THEN CASE WHEN g.value = 0 THEN 50.0 ELSE 100.0 END WHEN g.value = 0 THEN 0.0 ELSE 100.0 - 100.0 / (1.0 + g.value / l.value) END AS x FROM b LEFT JOIN g{n} g USING (symbol, rn) LEFT JOIN l{n} l USING (symbol, rn))"]
        prior, own = "(PARTITION BY symbol ORDER BY Date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)", "(PARTITION BY symbol ORDER BY Date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
        ctes += [f"z{n} AS (SELECT *, x - lag(x, 3) {_W} AS slope, list(x) OVER {own} AS xs, count(x) OVER {own} AS known, count(*) OVER {own} AS n, CASE WHEN count(x) OVER {prior} >= 60 THEN quantile_cont(x, 0.2) OVER {prior} END AS low, CASE WHEN count(x) OVER {prior} >= 60 THEN quantile_cont(x, 0.8) OVER {prior} END AS high FROM r{n})"]
        ctes += [f"y{n} AS (SELECT symbol, Date, round(x, 6) AS rsi_{n}, round(slope, 6) AS rsi_{n}_slope_3, round(slope - lag(slope, 3) {_W}, 6) AS rsi_{n}_accel, CASE WHEN known >= 60 THEN round(CASE WHEN x IS NULL THEN 0.0 ELSE len(list_filter(xs, lambda v: v <= x))::DOUBLE / n END, 6) END AS rsi_{n}_percentile_252, round(x - low, 6) AS rsi_{n}_distance_low_zone, round(x - high, 6) AS rsi_{n}_distance_high_zone FROM z{n})"]
    first = lengths[0]
    return f"{', '.join(ctes)} SELECT * FROM y{first} " + " ".join(f"JOIN y{n} USING (symbol, Date)" for n in lengths[1:])


def rsi_all_sql(base: str, lengths: tuple[int, ...] = RSI_LENGTHS, digits: int = 4) -> str:
    """The same columns as ``rsi_sql`` for many lengths: one recursion whose state is an average gain and loss of each symbol and length."""
    own, prior = ("(PARTITION BY symbol, k ORDER BY rn ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)", "(PARTITION BY symbol, k ORDER BY rn ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)")
    lagged = "OVER (PARTITION BY symbol, k ORDER BY rn)"
    shown = {"": "x", "_slope_3": "slope", "_accel": "accel", "_percentile_252": "pct", "_distance_low_zone": "x - low", "_distance_high_zone": "x - high"}
    cols = ", ".join(f"round(max(CASE WHEN k = {n} THEN {e} END), {digits}) AS rsi_{n}{end}" for n in lengths for end, e in shown.items())
    return f"""WITH RECURSIVE b AS (SELECT symbol, Date, row_number() {_W} AS rn, Close - lag(Close) {_W} AS step FROM ({base}) b),
ks AS (SELECT CAST(unnest({list(lengths)}) AS BIGINT) AS k),
seed AS (SELECT symbol, k, k + 1 AS rn, avg(greatest(step, 0)) AS gain, avg(greatest(-step, 0)) AS loss FROM b JOIN ks ON rn BETWEEN 2 AND k + 1 GROUP BY symbol, k HAVING count(step) = k),
w AS (SELECT * FROM seed UNION ALL SELECT w.symbol, w.k, b.rn, (w.gain * (w.k - 1) + greatest(b.step, 0)) / w.k, (w.loss * (w.k - 1) + greatest(-b.step, 0)) / w.k FROM w JOIN b ON b.symbol = w.symbol AND b.rn = w.rn + 1),
r AS (SELECT b.symbol, b.Date, b.rn, ks.k, CASE WHEN loss = 0 THEN CASE WHEN gain = 0 THEN 50.0 ELSE 100.0 END WHEN gain = 0 THEN 0.0 ELSE 100.0 - 100.0 / (1.0 + gain / loss) END AS x FROM b CROSS JOIN ks LEFT JOIN w ON w.symbol = b.symbol AND w.rn = b.rn AND w.k = ks.k),
z AS (SELECT *, x - lag(x, 3) {lagged} AS slope, list(x) OVER {own} AS xs, count(x) OVER {own} AS known, count(*) OVER {own} AS n,
CASE WHEN count(x) OVER {prior} >= 60 THEN quantile_cont(x, 0.2) OVER {prior} END AS low, CASE WHEN count(x) OVER {prior} >= 60 THEN quantile_cont(x, 0.8) OVER {prior} END AS high FROM r),
y AS (SELECT symbol, Date, k, x, slope, slope - lag(slope, 3) {lagged} AS accel, low, high, CASE WHEN known >= 60 THEN CASE WHEN x IS NULL THEN 0.0 ELSE len(list_filter(xs, lambda v: v <= x))::DOUBLE / n END END AS pct FROM z)
SELECT symbol, Date, {cols} FROM y GROUP BY symbol, Date"""
