"""Queries of the driver contract for the market-research operators, each with its oracle."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dialect import DUCK, SPARK
from tidemark import oracles, streaming
from tidemark.operators import analogs, asof, audit, backtest, cross_section, discovery, events, features, forward, frame, governance, holdout, importance, labels, metrics, models, screening, selection, sequential, trees, whole
from tidemark.sources import bars as source
from tidemark.sources import providers, shared
from tidemark.streaming import forward as forward_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def ranged(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Bars with average ranges beside them."""
    return sequential.extended(source.from_trades(spark, sf_dir), list(names))


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """All numbers to so many digits; some columns to others."""
    return df.select(*(F.round(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_BY_HAND = {"returns": oracles.returns, "trend": oracles.trend, "candles": oracles.candles}
for _f in features.FAMILIES.values():
    add(f"features_{_f.name}", lambda s, d, f=_f: f.rounded(source.from_trades(s, d)), _BY_HAND[_f.name]() if _f.name in _BY_HAND else _f.sql(source.oracle_bars()))
add("features_price_action", lambda s, d: features.PRICE.rounded(ranged(s, d, "atr_14")), oracles.price_action())
for _h in labels.HORIZONS:
    add(f"labels_{_h}", lambda s, d, f=labels.LABELS[_h]: f.rounded(source.from_trades(s, d)), oracles.labels(_h))
    add(f"first_touch_{_h}", lambda s, d, f=labels.TOUCH[_h]: f.rounded(ranged(s, d, "label_atr_14")), oracles.first_touch(_h))
for _h in (5, 10):
    add(f"legacy_labels_{_h}", lambda s, d, f=labels.LEGACY[_h]: f.rounded(source.from_trades(s, d)), labels.LEGACY[_h].sql(source.oracle_bars()))
add("audit_policy_outcomes", lambda s, d: rounded(labels.policy_outcomes(ranged(s, d, "label_atr_14")), entry_price=8, target_price=2, stop_price=2), oracles.policy_outcomes())
add("audit_exit_utility", lambda s, d: rounded(labels.time_exit_utility(labels.policy_outcomes(ranged(s, d, "label_atr_14"))), utility=4), oracles.exit_utility())

def downloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars fetched from two providers (staged answers: the first lacks S3 and S7, the
    second has S0 and S3, nobody knows S7 and S99): every symbol's provider, error, bars."""
    bars, path = source.from_trades(spark, sf_dir), shared.fresh(spark, "answers")
    providers.staged(bars.filter("symbol NOT IN ('S3', 'S7')"), f"{path}/first")
    providers.staged(bars.filter("symbol IN ('S0', 'S3')"), f"{path}/second")
    for name in ("first", "second"):
        providers.register(spark, f"staged-{name}", providers.staged_fetch(f"{path}/{name}"))
    names = [r.symbol for r in source.universe(spark).select("symbol").collect()]
    got, status = providers.download_any(spark, ["staged-first", "staged-second"], [*names, "S99"], "{symbol}", "1993-01-01", "1996-12-31", attempts=2)
    by = got.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("Date").alias("first"), F.max("Date").alias("last"), F.round(F.sum("Volume"), 4).alias("volume"), F.round(F.sum("Close"), 4).alias("closes"))
    return status.join(by, "symbol", "left").fillna(0, ["bars"])


add("sources_download", downloaded, f"""WITH t AS ({source.oracle_bars()}), wanted AS (SELECT unnest(['S0', 'S1', 'S2', 'S3', 'S4', 'S5', 'S6', 'S7', 'S99']) AS symbol),
held AS (SELECT symbol, count(*) FILTER (WHERE inside) AS bars, min(Date) FILTER (WHERE inside) AS first, max(Date) FILTER (WHERE inside) AS last, round(sum(Volume) FILTER (WHERE inside), 4) AS volume, round(sum(Close) FILTER (WHERE inside), 4) AS closes
FROM (SELECT *, Date BETWEEN DATE '1993-01-01' AND DATE '1996-12-31' AS inside FROM t) b WHERE symbol <> 'S7' GROUP BY symbol)
SELECT w.symbol, CASE WHEN w.symbol IN ('S3', 'S7', 'S99') OR h.symbol IS NULL THEN 'staged-second' ELSE 'staged-first' END AS provider, CASE WHEN h.symbol IS NULL THEN concat(w.symbol, ': unknown symbol') END AS error, coalesce(bars, 0) AS bars, first, last, volume, closes
FROM wanted w LEFT JOIN held h ON h.symbol = w.symbol""")
add("indicators_ranges", lambda s, d: sequential.ranges(source.from_trades(s, d), 6), sequential.ranges_sql(source.oracle_bars()))
add("indicators_macd", lambda s, d: sequential.macd(source.from_trades(s, d), 6), sequential.macd_sql(source.oracle_bars()))
add("indicators_rsi", lambda s, d: sequential.rsi_family(source.from_trades(s, d), (2, 14, 50), digits=6), sequential.rsi_sql(source.oracle_bars(), (2, 14, 50)))
add("indicators_rsi_all", lambda s, d: sequential.rsi_family(source.from_trades(s, d), digits=6), sequential.rsi_all_sql(source.oracle_bars(), digits=6))
_CROSS_BY_HAND = {"strength_ranks": oracles.strength_ranks(), "breadth": oracles.breadth(), "sectors": oracles.sectors(source.universe_sql())}
for _n, _v in cross_section.VIEWS.items():
    add(f"cross_{_n}", lambda s, d, v=_v: s.sql(v(SPARK, "SELECT * FROM {bars}", "SELECT * FROM {universe}"), bars=source.from_trades(s, d), universe=source.universe(s)), _CROSS_BY_HAND.get(_n) or _v(DUCK, source.oracle_bars(), source.universe_sql()))
_T, _B, _U = "SELECT * FROM {scored}", "SELECT * FROM {bars}", "SELECT * FROM {universe}"


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored table, kept like the bars it is made of."""
    return spark.sql(metrics.scored(SPARK, _B, _U), bars=ranged(spark, sf_dir, "label_atr_14").persist(), universe=source.universe(spark)).persist()


def over_scored(sql: str) -> str:
    """An oracle over the tables scored and plain (bars)."""
    made = metrics.scored(DUCK, "SELECT symbol, Date, Open, High, Low, Close, Volume, atr AS label_atr_14 FROM ranged", source.universe_sql())
    return f"WITH RECURSIVE {oracles.RANGES}, scored AS MATERIALIZED ({made}), plain AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM bars) {sql}"


def add_scored(name: str, view, *, bars: bool = False) -> None:
    """A query over scored rows, or over those and bars."""
    more, plain = ((_B,), ("SELECT * FROM plain",)) if bars else ((), ())
    add(name, lambda s, d: s.sql(view(SPARK, _T, *more), scored=scored_rows(s, d), **({"bars": source.from_trades(s, d)} if bars else {})), over_scored(view(DUCK, "SELECT * FROM scored", *plain)))


for _m, _p in ((metrics, "metric"), (selection, "select"), (discovery, "discover")):
    for _n, _v in _m.VIEWS.items():
        add_scored(f"{_p}_{_n}", _v)


RULE = backtest.Rule(length=5, lower_level=40.0)
for _n, _v in backtest.VIEWS.items():
    add(f"backtest_{_n}", lambda s, d, v=_v: s.sql(v(SPARK, "SELECT * FROM {t}"), t=backtest.ledgers(source.from_trades(s, d), [RULE])), _v(DUCK, backtest.ledger_sql(source.oracle_bars(), RULE)))
add("backtest_signals", lambda s, d: rounded(backtest.signal_table(source.from_trades(s, d), RULE), close=8), backtest.signals_sql(source.oracle_bars(), RULE))
add("backtest_latest_scan", lambda s, d: backtest.latest_scan(source.from_trades(s, d), RULE))
add("backtest_grid", lambda s, d: backtest.grid_search(source.from_trades(s, d), backtest.grid()), backtest.grid_sql(source.oracle_bars(), backtest.grid()))
add("backtest_walk_forward", lambda s, d: backtest.walk_forward(source.from_trades(s, d), backtest.grid()))


def portfolio(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = source.from_trades(spark, sf_dir)
    config = backtest.Portfolio()
    found = backtest.admitted(backtest.planned_trades(bars, backtest.demo_candidates(spark, bars, source.universe(spark)), config), config)
    return bars, found


def taken(df: DataFrame) -> DataFrame:
    return df.filter("audit_reason = 'included'").drop("audit_reason", "planned_weight", "known")


add("portfolio_admission", lambda s, d: portfolio(s, d)[1])
add("portfolio_equity", lambda s, d: (lambda b, f: backtest.daily_equity(b, taken(f)))(*portfolio(s, d)))
add("portfolio_metrics", lambda s, d: (lambda b, f: backtest.portfolio_metrics(backtest.daily_equity(b, taken(f)), taken(f)))(*portfolio(s, d)))
add("portfolio_by_sector", lambda s, d: backtest.group_returns(taken(portfolio(s, d)[1]), "sector"))
for _n, _v in analogs.VIEWS.items():
    add_scored(f"analogs_{_n}", _v)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return analogs.nearest_vectors(v, v.filter("vec_id % 20 = 0")).selectExpr("target_id", "vec_id", "round(distance, 4) AS distance", "rk")


add("analogs_vectors", vectors, analogs.VECTORS_SQL)
for _n, _v in events.VIEWS.items():
    add_scored(f"events_{_n}", _v, bars=True)


def shown(log: DataFrame) -> DataFrame:
    """Prices have few decimals, so many lie between two roundings: they are moved off by a little first. Returns have seven where a target or stop decides."""
    prices = [c for c in log.columns if c.endswith("price")]
    return rounded(log.withColumns({c: F.col(c) + 1.23e-7 for c in prices}), 8, **{c: 4 for c in prices})


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forward.signals(scored_rows(spark, sf_dir))


def kept_events(sql: str) -> str:
    """An oracle over the tables of the forward log."""
    return over_scored(f", {oracles.forward_log()} {sql}")


_LOG_SQL = kept_events(f"SELECT {oracles.LOG_ROW} FROM events")
add("forward_log", lambda s, d: shown(forward.log(source.from_trades(s, d), scans(s, d))), _LOG_SQL)
add("forward_stream", lambda s, d: shown(forward_stream.replayed(source.from_trades(s, d), scans(s, d))), _LOG_SQL)
add("forward_positions", lambda s, d: shown(forward.positions(forward.log(source.from_trades(s, d), scans(s, d)))), kept_events(oracles.forward_positions()))
RUN = holdout.Run("run", dt.datetime(1997, 1, 15), dt.date(1996, 12, 31))


def holdout_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holdout.log(source.from_trades(spark, sf_dir), scans(spark, sf_dir), source.received(spark, sf_dir), RUN)


def holdout_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(holdout.states(holdout_log(spark, sf_dir), source.received(spark, sf_dir), RUN))


_HOLDOUT_SQL = oracles.holdout(source.received_sql(DUCK), "1996-12-31", "1997-01-15 00:00:00", asdict(RUN.policy))
add("holdout_sessions", lambda s, d: holdout.sessions(source.received(s, d), RUN), over_scored(_HOLDOUT_SQL["sessions"]))
add("holdout_log", lambda s, d: shown(holdout_log(s, d)), over_scored(_HOLDOUT_SQL["log"]))
add("holdout_states", holdout_states, over_scored(_HOLDOUT_SQL["states"]))
add("holdout_gates", lambda s, d: holdout.gates(holdout_states(s, d), RUN), over_scored(_HOLDOUT_SQL["gates"]))
add("holdout_evaluation", lambda s, d: holdout.evaluated(holdout_states(s, d), RUN, diagnostic_only=True), over_scored(_HOLDOUT_SQL["evaluation"]))


def evidence_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every bar, decided on at the end of its session, the latest bar of its symbol whose trades had been received by then."""
    bars = source.from_trades(spark, sf_dir)
    decisions = bars.select(F.concat_ws("|", "symbol", F.col("Date").cast("string")).alias("id"), "symbol", F.col("Date").alias("session"), F.date_add("Date", 1).cast("timestamp").alias("decided_at"))
    evidence = source.received(spark, sf_dir).join(bars.select("symbol", "Date", "Close"), ["symbol", "Date"]).select("symbol", F.col("Date").alias("session"), F.col("available_at").alias("retrieved_at"), F.col("Close").alias("value"))
    return rounded(asof.latest(decisions, evidence), 8)


add("evidence_seen", evidence_seen, f"""WITH b AS ({source.oracle_bars()}), e AS (SELECT symbol, r.Date, available_at, Close FROM ({source.received_sql(DUCK)}) r JOIN b USING (symbol, Date)),
s AS (SELECT b.symbol, b.Date, max(row(e.Date, e.available_at, e.Close)) AS m FROM b JOIN e ON e.symbol = b.symbol AND e.Date <= b.Date AND e.available_at <= CAST(b.Date + 1 AS TIMESTAMP) GROUP BY 1, 2)
SELECT s.symbol || '|' || CAST(s.Date AS VARCHAR) AS id, e.Date AS session, e.available_at AS retrieved_at, round(e.Close, 8) AS value FROM s JOIN e ON e.symbol = s.symbol AND row(e.Date, e.available_at, e.Close) = s.m""")
for _n, _v in audit.VIEWS.items():
    add(f"audit_{_n}", lambda s, d, v=_v: s.sql(v(SPARK, _B), bars=source.from_trades(s, d)), _v(DUCK, source.oracle_bars()))
add("stream_deduplicated", lambda s, d: streaming.deduplicated(s.read.parquet(f"{d}/events.parquet").unionByName(s.read.parquet(f"{d}/events.parquet"))).select("event_id", "user_id", "event_type", F.round("value", 4).alias("value")), "SELECT DISTINCT event_id, user_id, event_type, round(value, 4) AS value FROM events")
for _n, _v in streaming.VIEWS.items():
    add(f"stream_{_n}", lambda s, d, v=_v: v(s.read.parquet(f"{d}/events.parquet")), streaming.ORACLES[_n])


def _predictions(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    rows = scored_rows(spark, sf_dir)
    return models.fit_predict(rows.filter("year(Date) < 1996"), rows.filter("year(Date) >= 1996"), ["x1", "x2"], family).select("symbol", "Date", "probability_up")


for _f in ("base_rate", "logistic", "boosting"):
    add(f"model_{_f}", lambda s, d, f=_f: _predictions(s, d, f))
for _f in ("identity", "sigmoid", "isotonic"):
    add(f"calibrate_{_f}", lambda s, d, f=_f: (lambda r: models.calibrated(r.filter("year(Date) < 1996"), r.filter("year(Date) >= 1996"), f).select("symbol", "Date", "calibrated"))(scored_rows(s, d)))
add("calibrate_slope", lambda s, d: models.calibration_slope(scored_rows(s, d)))
add("model_screen", lambda s, d: models.screen(scored_rows(s, d), ["x1", "x2"]))


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, universe = source.from_trades(spark, sf_dir), source.universe(spark)
    breadth = spark.sql(cross_section.breadth(SPARK, _B, _U), bars=bars, universe=universe)
    market = spark.sql(cross_section.regimes(SPARK, _B, _U), bars=bars, universe=universe).groupBy("Date").agg({"market_regime_trend_score": "max", "market_regime_volatility_score": "max"}).toDF("Date", "trend", "vol")
    return models.expanding_regimes(market.join(breadth, "Date").select("Date", "trend", "vol", "breadth_advance_pct", "breadth_dispersion_20"), ["trend", "vol", "breadth_advance_pct", "breadth_dispersion_20"])


add("model_regimes", regimes)


def whole_frame(spark: SparkSession, sf_dir: str, horizons: tuple[int, ...]) -> DataFrame:
    return frame.modeling_frame(frame.feature_panel(source.from_trades(spark, sf_dir), source.universe(spark)), frame.label_panel(ranged(spark, sf_dir, "label_atr_14"), horizons))


def modeling_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features made by windows, ranks, breadth and sectors with the outcomes of two horizons; ``modeling_frame_whole`` has all."""
    out = whole_frame(spark, sf_dir, (5, 20))
    return rounded(out.drop("Volume"), Close=8)


def modeling_frame_sql() -> str:
    """The oracles of the parts, joined."""
    parts = [f"({ORACLE_SQL[f'features_{n}']}) f_{n}" for n in features.FAMILIES]
    once: dict[str, str] = {}
    for name, family in features.FAMILIES.items():
        for k in family.keep:
            once.setdefault(k, f"f_{name}.{k}")
    ends = ("target_before_stop", "stop_before_target", "time_to_target", "time_to_stop")
    lab = ", ".join(f"l{h}.* EXCLUDE (symbol, Date, label_end_date), l{h}.label_end_date AS label_end_date_{h}, {', '.join(f't{h}.{x}_{e} AS label_{x}_{e}_{h}' for x in ('bull', 'bear') for e in ends)}" for h in (5, 20))
    first, *rest = parts
    joins = " ".join(f"JOIN {x} USING (symbol, Date)" for x in rest)
    labels_ = " ".join(f"JOIN ({ORACLE_SQL[f'labels_{h}']}) l{h} USING (symbol, Date) JOIN ({ORACLE_SQL[f'first_touch_{h}']}) t{h} USING (symbol, Date)" for h in (5, 20))
    return f"""SELECT symbol, Date, round(b.Close, 8) AS Close, role, u.sector, {', '.join(once.values())}, r.* EXCLUDE (symbol, Date), w.* EXCLUDE (Date), s.* EXCLUDE (Date, sector), {lab} FROM {first} {joins} JOIN ({source.oracle_bars()}) b USING (symbol, Date) LEFT JOIN ({ORACLE_SQL['cross_strength_ranks']}) r USING (symbol, Date)
LEFT JOIN ({ORACLE_SQL['cross_breadth']}) w USING (Date) LEFT JOIN ({source.universe_sql()}) u USING (symbol) LEFT JOIN ({ORACLE_SQL['cross_sectors']}) s ON s.Date = b.Date AND s.sector = u.sector {labels_}"""


add("modeling_frame", modeling_frame, modeling_frame_sql())


def modeling_frame_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature family, four benchmarks, all RSI lengths, the outcomes of five horizons; digits as the oracles of the parts have them."""
    out = whole.modeling_frame(source.from_trades(spark, sf_dir), source.universe(spark)).drop("Open", "High", "Low", "Volume", "sector_proxy")
    digits = {"Close": 8, "breadth_skew_20": 4} | {c: 4 for c in out.columns if c.startswith(("rsi_", "relationship_lead_lag"))} | {c: 5 for c in out.columns if c.startswith(("rolling_beta", "rolling_corr"))}
    return rounded(out, **digits)


def modeling_frame_whole_sql() -> str:
    """The oracles of the parts, joined."""
    bars, universe = source.oracle_bars(), source.universe_sql()
    named: dict[str, str] = {}  # of a name that several parts have the first counts
    parts = {**{f"f_{n}": ORACLE_SQL[f"features_{n}"] for n in features.FAMILIES}, "f_price": ORACLE_SQL["features_price_action"], "i_ranges": ORACLE_SQL["indicators_ranges"], "i_macd": ORACLE_SQL["indicators_macd"], "i_rsi": sequential.rsi_all_sql(bars), "c_ranks": ORACLE_SQL["cross_strength_ranks"], "c_regimes": ORACLE_SQL["cross_regimes"], "c_sector": cross_section.sector_relative(DUCK, bars, universe)}
    kept = {**{f"f_{n}": f.keep for n, f in features.FAMILIES.items()}, "f_price": features.PRICE.keep, "i_ranges": sequential.RANGE_NAMES, "i_macd": sequential.MACD_NAMES, "i_rsi": sequential.rsi_names(sequential.RSI_LENGTHS), "c_ranks": [f"relative_strength_rank_{k}" for k in (5, 20, 63)]}
    for part, names in kept.items():
        for n in names:
            named.setdefault(n, f"{part}.{n}")
    for n in ("trend_score", "volatility_score", "label"):
        named[f"market_regime_{n}"] = f"c_regimes.market_regime_{n}"
    named |= {"regime_conditioned_return_20": "c_regimes.regime_conditioned_return_20", "sector_return_20": "c_sector.sector_return_20", "relative_return_vs_sector_20": "c_sector.relative_return_vs_sector_20", "sector_divergence_20": "c_sector.relative_return_vs_sector_20", "sector_trend_agreement": "c_sector.sector_trend_agreement"}
    for b in whole.BENCHMARKS:
        part, s = f"m_{b}", b.lower()
        parts[part] = cross_section.benchmark(DUCK, bars, universe, b)
        for k in (5, 20):
            named |= {f"{s}_return_{k}": f"{part}.bm_return_{k}", f"relative_return_vs_{s}_{k}": f"{part}.relative_return_{k}"}
        named |= {f"rolling_beta_vs_{s}_63": f"{part}.rolling_beta_63", f"rolling_corr_vs_{s}_63": f"{part}.rolling_corr_63", f"residual_return_vs_{s}_1": f"{part}.residual_return_1", f"benchmark_trend_agreement_vs_{s}": f"{part}.trend_agreement"}
    for h in labels.HORIZONS:
        parts |= {f"l_{h}": ORACLE_SQL[f"labels_{h}"], f"t_{h}": ORACLE_SQL[f"first_touch_{h}"]}
        named |= {n: f"l_{h}.{n}" for n in labels.LABELS[h].keep} | {f"label_end_date_{h}": f"l_{h}.label_end_date"} | {f"label_{n}_{h}": f"t_{h}.{n}" for n in labels.TOUCH[h].keep}
    edge = "SELECT * FROM rel WHERE edge = '{}_{}'"
    for a, b in whole.EDGES:
        for stem, width in (("relationship_corr", 63), ("relationship_divergence", 5), ("relationship_lead_lag", 5), ("relationship_mutual_info", 63), ("inverse_confirmation", 63), ("relationship_breakdown", 63)):
            named[f"{stem}_{a.lower()}_{b.lower()}_{width}"] = f"e_{a}{b}.{stem}_{width}"
    joins = " ".join(f"LEFT JOIN ({q}) {n} ON {n}.symbol = b.symbol AND {n}.Date = b.Date" for n, q in parts.items())
    joins += " ".join(f" LEFT JOIN ({edge.format(a, b)}) e_{a}{b} ON e_{a}{b}.Date = b.Date" for a, b in whole.EDGES)
    joins += f" LEFT JOIN ({universe}) u ON u.symbol = b.symbol LEFT JOIN ({ORACLE_SQL['cross_breadth']}) w ON w.Date = b.Date LEFT JOIN ({ORACLE_SQL['cross_sectors']}) s ON s.Date = b.Date AND s.sector = u.sector"
    return f"""WITH rel AS ({cross_section.relationships(DUCK, bars, universe, whole.EDGES)})
SELECT b.symbol, b.Date, round(b.Close, 8) AS Close, role, u.sector, w.* EXCLUDE (Date), s.* EXCLUDE (Date, sector), {', '.join(f'{e} AS {n}' for n, e in named.items())} FROM ({bars}) b {joins}"""


add("modeling_frame_whole", modeling_frame_whole, modeling_frame_whole_sql())
add("modeling_time_exits", lambda s, d: rounded(frame.with_time_exits(source.from_trades(s, d).select("symbol", "Date"), labels.policy_outcomes(ranged(s, d, "label_atr_14"))), 4))
add("modeling_hygiene", lambda s, d: (lambda p: frame.hygiene_audit(p, frame.numeric_features(p)))(frame.feature_panel(source.from_trades(s, d), source.universe(s))))


def discovery_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame.sanitized(whole_frame(spark, sf_dir, (5,)), DISCOVERY_FEATURES).persist()
    return frame.discovered(rows, {"POOLED": (), "stock": ("stock",)}, (5,), DISCOVERY_FEATURES, "1996-01-01")


def learning(spark: SparkSession, sf_dir: str, of: list[str], feature_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from (outcome known before 1996) and to judge on, a unit a scope: 0 is POOLED, the others by role."""
    bars, universe = source.from_trades(spark, sf_dir), source.universe(spark)
    outcomes = labels.LABELS[5].rounded(bars).select("symbol", "Date", F.col("label_end_date").alias("end"), F.col("label_bull_positive_return_5").cast("double").alias("y"))
    rows = feature_rows.select("symbol", "Date", *of).join(outcomes, ["symbol", "Date"]).join(F.broadcast(universe.select("symbol", "role")), "symbol").filter("y IS NOT NULL")
    roles = [r.role for r in universe.select("role").distinct().orderBy("role").collect()]  # a few scopes
    own = F.element_at(F.create_map(*(F.lit(x) for k, r in enumerate(roles) for x in (r, k + 1))), F.col("role"))
    rows = rows.withColumn("unit", F.explode(F.array(F.lit(0), own)))
    return rows.filter("end < '1996-01-01'"), rows.filter("Date >= '1996-01-01'")


LEARNED_FROM = ("returns", "trend", "volatility")


def _learned(spark: SparkSession, sf_dir: str, fit) -> tuple[DataFrame, dict[int, trees.Model], list[str]]:
    """Holdout rows in bins, the models of all scopes, and the features."""
    bars = source.from_trades(spark, sf_dir)
    parts = [features.FAMILIES[n].rounded(bars) for n in LEARNED_FROM]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.join(more.select("symbol", "Date", *(c for c in more.columns if c not in whole.columns)), ["symbol", "Date"])
    of = frame.numeric_features(whole.drop("Close", "Volume"))
    train, test = learning(spark, sf_dir, of, whole)
    train = shared.written(train, "learning")
    cuts = trees.cut_points(train, of)
    models_ = fit(trees.binned(train, of, cuts, ["unit", "y"]), len(of), 66)
    return shared.written(trees.binned(test, of, cuts, ["unit", "symbol", "Date", "y"]), "judging"), models_, of


def _tree_predictions(spark: SparkSession, sf_dir: str, fit) -> DataFrame:
    rows, models_, of = _learned(spark, sf_dir, fit)
    return rounded(trees.predicted(rows, models_, len(of), ["unit", "symbol", "Date", "y"]))


_BOOST = lambda r, p, b: trees.boosted(r, p, b, trees.Boosting())
add("model_histogram_boosting", lambda s, d: _tree_predictions(s, d, _BOOST))
_FOREST = lambda r, p, b: trees.randomised(r, p, b, trees.Randomised())
add("model_randomised_trees", lambda s, d: _tree_predictions(s, d, _FOREST))


def _importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature with what its family adds up to beside it; of forests, which take a few jobs to grow."""
    rows, models_, of = _learned(spark, sf_dir, _FOREST)
    found = shared.written(importance.importance(rows, models_, of, ["symbol", "Date"]), "importance")
    family = {c: n for n in LEARNED_FROM for c in features.FAMILIES[n].keep}
    named = F.element_at(F.create_map(*(F.lit(x) for pair in family.items() for x in pair)), F.col("feature"))
    return found.withColumn("family", named).join(importance.by_family(found, family).select("unit", "family", "sum_delta", "positive_sum_delta", "top_feature"), ["unit", "family"])


add("model_importance", lambda s, d: rounded(_importance(s, d)))


def feature_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numeric features of the panel, on rows of all scopes whose outcome was known before 1996."""
    panel = frame.feature_panel(source.from_trades(spark, sf_dir), source.universe(spark))
    of = [c for c in frame.numeric_features(panel) if c not in ("Close", "Volume")]
    train, _ = learning(spark, sf_dir, of, panel)
    return rounded(screening.screened(shared.written(train.filter("unit = 0"), "screening"), of, "y"))


add("model_feature_screen", feature_screen)
DISCOVERY_FEATURES = ["return_5", "return_20", "distance_sma_20", "realized_vol_20", "relative_volume_20", "close_position"]
add("model_discovery", discovery_loop)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars, trailing returns and trend, rank of a date, forward return: the two strongest of each date."""
    return spark.sql(FLAGSHIP.format(bars="{bars}", d="try_divide"), bars=source.from_trades(spark, sf_dir, 4))


FLAGSHIP = """WITH f AS (SELECT symbol, Date, Close / lag(Close, 20) OVER w - 1 AS return_20, Close / lag(Close, 5) OVER w - 1 AS return_5, CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY Date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN Close / avg(Close) OVER (PARTITION BY symbol ORDER BY Date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - 1 END AS distance_sma_20,
lead(Close, 5) OVER w / lead(Open) OVER w - 1 AS forward_return_5 FROM {bars} b WINDOW w AS (PARTITION BY symbol ORDER BY Date)),
r AS (SELECT *, row_number() OVER (PARTITION BY Date ORDER BY return_20 DESC, symbol) AS rk FROM f WHERE return_20 IS NOT NULL)
SELECT symbol, Date, round(return_5, 6) AS return_5, round(return_20, 6) AS return_20, round(distance_sma_20, 6) AS distance_sma_20, round(forward_return_5, 6) AS forward_return_5, CAST(rk AS INT) AS rk FROM r WHERE rk <= 2"""
add("flagship", flagship, FLAGSHIP.format(bars=f"({source.oracle_bars(4)})", d=""))
for _n, _v in governance.VIEWS.items():
    add_scored(f"govern_{_n}", _v, bars=True)
