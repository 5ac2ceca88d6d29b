"""The whole modeling frame: every feature family, the market beside each symbol, and outcomes of all horizons.

Three steps. Windows of all families and horizons share one exchange and one sort by symbol. The grouped function that
follows needs no other exchange: it adds what recursion gives (RSI of all lengths, ranges, MACD) and what the market gives
(returns against each benchmark, beta, correlation, sector). The result is written once; ranks, breadth, sectors and the
regime are narrow scans of that table, joined by date.

A symbol's history is bounded by the calendar. So is the market table that every task gets: the named symbols (benchmarks,
sector proxies, ends of relationships; MOST_NAMED at most) on the dates of the calendar.

Defined cases: a symbol without a bar on a date has no row there, but the date counts in windows against a benchmark. A benchmark or
proxy without bars gives nulls. Without bars of the first benchmark the regime takes the mean return over 20 days and the deviation of daily
returns of all symbols. A symbol that is not in the universe has null role, sector and proxy. No bars give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dialect import SPARK
from tidemark.operators import cross_section, features, frame, labels, models, sequential
from tidemark.sources.shared import written

#: Symbols that benchmarks, proxies and relationships may name together.
MOST_NAMED = 64
#: Partitions by symbol for each core.
TASKS_A_CORE = 4
#: Rows of a window against a benchmark, and how many of them must be known (fixed values).
WIDTH, LEAST = 63, 40
BENCHMARKS = ("S0", "S1", "S2", "S6")
EDGES = (("S0", "S6"), ("S0", "S7"))
SERIES = [*sequential.RANGE_NAMES, *sequential.MACD_NAMES, *sequential.rsi_names(sequential.RSI_LENGTHS)]


@dataclass
class Market:
    """The calendar, and of each named symbol what a date holds (NaN where it has no bar)."""

    dates: np.ndarray
    close: dict[str, np.ndarray]
    step: dict[str, np.ndarray]  # return since the symbol's bar before
    trend: dict[str, np.ndarray]  # distance from the average of 50 bars

    def change(self, symbol: str, k: int) -> np.ndarray:
        """Return over k dates of the calendar."""
        if symbol not in self.close:
            return np.full(len(self.dates), np.nan)
        now = self.close[symbol]
        return sequential.ratio(now, sequential.later(now, k)) - 1.0

    def of(self, kind: dict[str, np.ndarray], symbol: str) -> np.ndarray:
        return kind.get(symbol, np.full(len(self.dates), np.nan))


def market(bars: DataFrame, names: set[str]) -> Market:
    if len(names) > MOST_NAMED:
        raise ValueError(f"{len(names)} symbols stand for the market, more than {MOST_NAMED}")
    dates = np.array(sorted(r.Date for r in bars.select("Date").distinct().collect()), "datetime64[D]")  # the calendar
    some = bars.filter(F.col("symbol").isin(*sorted(names)))
    rows = bars.sparkSession.sql(f"SELECT symbol, Date, Close, return_1, distance_sma_50 FROM ({cross_section.base_features(SPARK, 'SELECT * FROM {some}')}) f", some=some).toArrow()
    symbol, at = np.array(rows["symbol"].to_pylist(), object), np.searchsorted(dates, rows["Date"].to_numpy().astype("datetime64[D]"))
    out: list[dict[str, np.ndarray]] = [{}, {}, {}]
    for kind, column in zip(out, ("Close", "return_1", "distance_sma_50")):
        values = rows[column].to_numpy()
        for s in sorted(set(symbol)):
            kind[s] = np.full(len(dates), np.nan)
            kind[s][at[symbol == s]] = values[symbol == s]
    return Market(dates, *out)


def frames(x: np.ndarray, width: int) -> np.ndarray:
    """The trailing rows of each row."""
    return np.zeros((0, width)) if not len(x) else np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(width - 1, np.nan), x]), width)


def beta_and_corr(x: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each date, over dates where both are known: covariance over the benchmark's own variance, and correlation; null with
    fewer than LEAST pairs."""
    both = ~np.isnan(x) & ~np.isnan(b)
    fx, fb, own = (frames(v, WIDTH) for v in (np.where(both, x, np.nan), np.where(both, b, np.nan), b))
    n, m = (~np.isnan(fx)).sum(1), (~np.isnan(own)).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        dx, db, do = (f - (np.nansum(f, 1) / k)[:, None] for f, k in ((fx, n), (fb, n), (own, m)))
        cov, var = np.nansum(dx * db, 1) / (n - 1), np.nansum(do * do, 1) / (m - 1)
        beta = np.where((n >= LEAST) & (m >= LEAST), sequential.ratio(cov, var), np.nan)
        corr = np.where(n >= LEAST, sequential.ratio(np.nansum(dx * db, 1), np.sqrt(np.nansum(dx * dx, 1) * np.nansum(db * db, 1))), np.nan)
    return beta, corr


def against(m: Market, benchmarks: tuple[str, ...], proxy: str | None, at: np.ndarray, own: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A symbol's columns beside the market; at: places of its bars in the calendar, own: its returns and trend."""
    out = {}
    on_calendar = np.full(len(m.dates), np.nan)
    on_calendar[at] = own["return_1"]
    for s in benchmarks:
        name = s.lower()
        for k in (5, 20):
            out[f"{name}_return_{k}"] = m.change(s, k)[at]
            out[f"relative_return_vs_{name}_{k}"] = own[f"return_{k}"] - out[f"{name}_return_{k}"]
        beta, corr = (v[at] for v in beta_and_corr(on_calendar, m.of(m.step, s)))
        out[f"rolling_beta_vs_{name}_63"], out[f"rolling_corr_vs_{name}_63"] = beta, corr
        out[f"residual_return_vs_{name}_1"] = own["return_1"] - beta * np.nan_to_num(out[f"{name}_return_5"]) / 5.0
        out[f"benchmark_trend_agreement_vs_{name}"] = np.sign(own["distance_sma_50"]) * np.sign(m.of(m.trend, s)[at])
    moved = m.change(proxy, 20)[at] if proxy else np.full(len(at), np.nan)
    out["sector_return_20"] = moved
    out["relative_return_vs_sector_20"] = out["sector_divergence_20"] = own["return_20"] - moved
    out["sector_trend_agreement"] = np.sign(own["distance_sma_50"]) * np.sign(m.of(m.trend, proxy)[at]) if proxy else np.full(len(at), np.nan)
    first = benchmarks[0]
    vol = frames(m.of(m.step, first), 20)
    with np.errstate(invalid="ignore"):
        out["market_regime_trend_score"], out["market_regime_volatility_score"] = m.change(first, 63)[at], np.where((~np.isnan(vol)).all(1), vol.std(axis=1, ddof=1), np.nan)[at]
    return out


def market_names(benchmarks: tuple[str, ...]) -> list[str]:
    none = Market(np.array([], "datetime64[D]"), {}, {}, {})
    return list(against(none, benchmarks, None, np.array([], int), {c: np.array([]) for c in ("return_1", "return_5", "return_20", "distance_sma_50")}))


def with_series(panel: DataFrame, m: Market, benchmarks: tuple[str, ...]) -> DataFrame:
    """The panel with recursive series and the market beside it; as rows of a symbol lie together, nothing moves."""
    keep = [c for c in panel.columns if c not in SERIES]
    names = [*SERIES, *market_names(benchmarks)]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["Date"].to_numpy(), kind="stable")))
        g = {c: table[c].to_numpy().astype(float) for c in ("Open", "High", "Low", "Close", "Volume", "return_1", "return_5", "return_20", "distance_sma_50")}
        got = sequential.ranges_of(g) | sequential.macd_of(g) | sequential.rsi_of(sequential.RSI_LENGTHS)(g)
        at = np.searchsorted(m.dates, table["Date"].to_numpy().astype("datetime64[D]"))
        got |= against(m, benchmarks, table["sector_proxy"][0].as_py(), at, g)
        made = [pa.array(got[n].astype(float), pa.float64(), from_pandas=True) for n in names]
        return pa.table([*(table[c] for c in keep), *made], names=[*keep, *names])

    kinds = dict(panel.dtypes)
    return panel.groupBy("symbol").applyInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{n}` double" for n in names)]))


def feature_families() -> list:
    return [*features.FAMILIES.values(), replace(features.PRICE, keep=tuple(k for k in features.PRICE.keep if k not in SERIES))]


def label_families(horizons: tuple[int, ...]) -> list:
    return [x for h in horizons for x in (frame.renamed(labels.LABELS[h], h, "label_end_date"), frame.renamed(labels.TOUCH[h], h))]


def modeling_frame(bars: DataFrame, universe: DataFrame, horizons: tuple[int, ...] = labels.HORIZONS, benchmarks: tuple[str, ...] = BENCHMARKS, edges: tuple[tuple[str, str], ...] = EDGES) -> DataFrame:
    """One row a bar: all features, and outcomes of all horizons in columns that begin with label_. A key that is there twice is an error."""
    spark = bars.sparkSession
    proxies = {r.sector_proxy for r in universe.select("sector_proxy").distinct().limit(MOST_NAMED + 2).collect() if r.sector_proxy}
    m = market(bars, {*benchmarks, *proxies, *(s for e in edges for s in e)})
    ranged = sequential.extended(bars, ["atr_14", "label_atr_14"])
    # a bar is little to read and much work, so adaptive merging of small partitions, which goes by bytes, is kept off: a stated number of them
    spread = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    known = ranged.join(universe.select("symbol", "role", "sector", "sector_proxy"), "symbol", "left").repartition(spread, "symbol")
    panel = frame.panel(known, feature_families() + label_families(horizons), ("atr_14", "label_atr_14", "role", "sector", "sector_proxy"))
    table = written(with_series(panel, m, benchmarks), "frame")
    models.reject_leakage([c for c in table.columns if c not in frame.KEYS and not c.startswith("label_")])
    if table.groupBy(*frame.KEYS).count().filter("count > 1").limit(1).count():
        raise ValueError(f"a key of {frame.KEYS} is there more than once")
    rows = "SELECT * FROM {table}"
    daily = spark.sql(cross_section.breadth_of(SPARK, rows), table=table)
    by_date = spark.sql("SELECT Date, avg(return_20) AS all_return_, stddev_samp(return_1) AS all_deviation_ FROM {table} GROUP BY Date", table=table)
    out = table.join(spark.sql(cross_section.ranks_of(rows), table=table), frame.KEYS, "left").join(daily, "Date", "left").join(by_date, "Date", "left")
    out = out.join(spark.sql(cross_section.sectors_of(rows), table=table), ["Date", "sector"], "left")
    if edges:
        some = bars.filter(F.col("symbol").isin(*sorted({s for e in edges for s in e}))).select("symbol", "Date", *frame.BARS[2:])
        out = out.join(related(some, m, edges), "Date", "left")
    return regimes(out, benchmarks[0] in m.close)


def related(some: DataFrame, m: Market, edges: tuple[tuple[str, str], ...]) -> DataFrame:
    """A row a date: correlation, divergence, lead and lag of each edge."""
    spark = some.sparkSession
    dates = spark.createDataFrame([(d,) for d in m.dates.tolist()], "Date date")  # the calendar, with dates on which none of them has a bar
    whole = some.unionByName(dates.select(F.lit(None).cast("string").alias("symbol"), "Date", *(F.lit(None).cast("double").alias(c) for c in frame.BARS[2:])))
    long = spark.sql(cross_section.relationships(SPARK, "SELECT * FROM {whole}", "", edges), whole=whole)
    pick = []
    for a, b in edges:
        for c in long.columns[2:]:
            stem, width = c.rsplit("_", 1)
            pick.append(F.max(F.when(F.col("edge") == f"{a}_{b}", F.col(c))).alias(f"{stem}_{a.lower()}_{b.lower()}_{width}"))
    return long.groupBy("Date").agg(*pick)


def regimes(rows: DataFrame, known: bool) -> DataFrame:
    """Label of the regime and the return under it. The label compares with the median over all rows, later ones included."""
    trend, vol = F.col("market_regime_trend_score"), F.col("market_regime_volatility_score")
    if not known:
        rows = rows.withColumns({"market_regime_trend_score": F.col("all_return_"), "market_regime_volatility_score": F.col("all_deviation_")})
    rows = rows.drop("all_return_", "all_deviation_")
    middle = F.lit(rows.groupBy(vol.alias("v")).agg(F.count("*").alias("n")).agg(F.expr("percentile(v, 0.5, n)")).first()[0]).cast("double")
    label = F.when((trend > 0) & (vol <= middle), "uptrend_low_vol").when(trend > 0, "uptrend_high_vol").when((trend <= 0) & (vol > middle), "downtrend_high_vol").otherwise("mixed")
    return rows.withColumn("market_regime_label", label).withColumn("regime_conditioned_return_20", F.col("return_20") * F.coalesce(trend, F.lit(0.0)))
