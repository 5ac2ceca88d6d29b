"""The forward event log as a stream with state: bars and scanner rows come in, events go out.

Arrivals are keyed by symbol. The state of a symbol is its last session and its pending and open positions, no more
than ``horizon`` sessions of signals hold at once. A micro-batch's arrivals of a symbol are taken session by session: first the
bar advances positions, then the session's scanner rows join them. A session that is not after the
last one came late or was filled in later: its rows are refused, and say so in the log, whatever they hold. So the
log never rests on data that was not there in its turn.

The sink appends events whose key the log lacks. A stream that starts again goes on from its checkpoint; a batch that runs twice adds nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.forward import COST, EVENT, LEAST_MOVE, NAMES, SIGNAL
from tidemark.sources.shared import fresh
from tidemark.streaming import append_new

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PRICES = ["Open", "High", "Low", "Close"]
ARRIVAL = "symbol string, session date, kind string, Open double, High double, Low double, Close double, direction string, model_id string, snapshot string, status string, horizon int, expected_return double, expected_mfe double, expected_mae double"


def arrivals(bars: DataFrame, scans: DataFrame) -> DataFrame:
    """Bars and scanner rows in one table."""
    empty = lambda names: [F.lit(None).cast(dict(f.split() for f in ARRIVAL.split(", "))[n]).alias(n) for n in names]
    rest = [n for n in SIGNAL if n not in ("symbol", "as_of")]
    b = bars.select("symbol", F.col("Date").alias("session"), F.lit("bar").alias("kind"), *PRICES, *empty(rest))
    return b.unionByName(scans.select("symbol", F.col("as_of").alias("session"), F.lit("scan").alias("kind"), *empty(PRICES), *rest))


def known(*xs) -> list[float]:
    return [x for x in xs if x is not None]


class Positions(StatefulProcessor):
    """Advances the positions of a symbol."""

    def __init__(self, prefix: str = ""):
        self.prefix = prefix

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("positions", "value string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get()
        held = json.loads(old[0]) if old else {"last": "", "open": []}
        found = pd.concat(list(rows))  # what one symbol sent since the last batch
        found = found.astype(object).where(found.notna(), None)
        out: list[dict] = []
        for session, group in sorted(found.groupby("session")):
            self.take(key[0], str(session)[:10], group.to_dict("records"), held, out)
        self.state.update((json.dumps(held),))
        yield pd.DataFrame([[e.get(n) for n in NAMES] for e in out], columns=NAMES).astype({"as_of": "object"})

    def take(self, symbol: str, session: str, rows: list[dict], held: dict, out: list[dict]) -> None:
        """All rows of one session."""
        bars = sorted((r for r in rows if r["kind"] == "bar"), key=lambda r: str([r[p] for p in PRICES]))
        scans = sorted((r for r in rows if r["kind"] != "bar"), key=lambda r: (r["status"], *(-1e300 if r[c] is None else r[c] for c in ("expected_return", "expected_mfe", "expected_mae"))))
        late = session <= held["last"]
        bars, bad = [b for b in bars if not late and all(b[p] is not None for p in PRICES)][:1], bars
        for b in bad[len(bars) :]:
            out.append(self.event("BAR_REFUSED", symbol, session, {"direction": "n/a", "model_id": "bar", "snapshot": None, "horizon": None}, "late" if late else "unusable", reason="late" if late else "unusable"))
        if bars:
            held["last"] = session
            held["open"] = [p for p in held["open"] if self.advance(symbol, session, bars[0], p, out)]
        ids = set()
        for s in scans:
            s["horizon"] = int(s["horizon"])  # a column with gaps comes as doubles
            own = f"h{s['horizon']}"
            pending = self.event("ENTRY_PENDING", symbol, session, s, own)
            if pending["unique_key"] in ids:
                continue
            ids.add(pending["unique_key"])
            if late or not bars:
                out.append(self.event("SIGNAL_REFUSED", symbol, session, s, own, reason="late" if late else "no bar"))
            elif s["status"] != "ACTIONABLE":
                out.append(self.event("SIGNAL_REJECTED", symbol, session, s, own))
            else:
                out += [self.event("SIGNAL_CREATED", symbol, session, s, own), pending]
                target = max(known(s["expected_return"], max(known(s["expected_mfe"], 0.0)) * 0.5, LEAST_MOVE))
                stop = max(known(None if s["expected_mae"] is None else abs(s["expected_mae"]), LEAST_MOVE))
                held["open"].append({"id": pending["unique_key"], "seen": 0, "target": target, "stop": stop, **{c: s[c] for c in ("direction", "model_id", "snapshot", "horizon")}})

    def advance(self, symbol: str, session: str, bar: dict, p: dict, out: list[dict]) -> bool:
        """Carry a position over one bar; whether it stays."""
        bull, own, source = p["direction"] == "Bullish", f"h{p['horizon']}", p["id"]
        if not p["seen"]:
            p["entry"] = entry = bar["Open"]
            p["target_price"] = entry * (1.0 + p["target"]) if bull else entry * (1.0 - p["target"])
            p["stop_price"] = entry * (1.0 - p["stop"]) if bull else entry * (1.0 + p["stop"])
            p["high"], p["low"] = bar["High"], bar["Low"]
            out.append(self.event("ENTRY_FILLED", symbol, session, p, f"{source}|{own}", source, price=entry, target_price=p["target_price"], stop_price=p["stop_price"]))
            out.append(self.event("TARGET_UPDATED", symbol, session, p, f"{source}|TARGET_UPDATED", source, price=p["target_price"]))
            out.append(self.event("STOP_UPDATED", symbol, session, p, f"{source}|STOP_UPDATED", source, price=p["stop_price"]))
        p["seen"] += 1
        p["high"], p["low"], entry, close = max(p["high"], bar["High"]), min(p["low"], bar["Low"]), p["entry"], bar["Close"]
        sides = {"mark_return": close / entry - 1.0 if bull else entry / close - 1.0, "mfe": p["high"] / entry - 1.0 if bull else entry / p["low"] - 1.0, "mae": p["low"] / entry - 1.0 if bull else entry / p["high"] - 1.0}
        out.append(self.event("POSITION_MARKED", symbol, session, p, f"{source}|{session}", source, price=close, **sides))
        stop = bar["Low"] <= p["stop_price"] if bull else bar["High"] >= p["stop_price"]
        target = bar["High"] >= p["target_price"] if bull else bar["Low"] <= p["target_price"]
        if not (stop or target or p["seen"] == p["horizon"]):
            return True
        price = p["stop_price"] if stop else p["target_price"] if target else close
        gross = price / entry - 1.0 if bull else entry / price - 1.0
        reason = "stop_intraday_ambiguous" if stop and target else "stop" if stop else "target" if target else "time_exit"
        out.append(self.event("EXIT_FILLED", symbol, session, p, source, source, price=price, reason=reason, gross_return=gross, net_return=gross - COST, **sides))
        return False

    def event(self, kind: str, symbol: str, session: str, of: dict, suffix: str, source: str | None = None, **more) -> dict:
        text = "|".join([self.prefix + kind, session, symbol.upper(), of["direction"], of["model_id"], of["snapshot"] or "", suffix])
        return {"event_type": self.prefix + kind, "as_of": pd.Timestamp(session).date(), "symbol": symbol, "direction": of["direction"], "model_id": of["model_id"], "snapshot": of["snapshot"], "horizon": of["horizon"], "unique_key": hashlib.sha256(text.encode()).hexdigest(), "source_key": source, **more}


def advanced(stream: DataFrame, prefix: str = "") -> DataFrame:
    """Events of a stream of arrivals."""
    return stream.groupBy("symbol").transformWithStateInPandas(Positions(prefix), EVENT, "append", "none")


def run(spark: SparkSession, path: str, log_path: str, checkpoint: str, prefix: str = "") -> None:
    """Take what arrived at ``path`` (Parquet) since the last run, and append its events to the log."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # the only store that keeps state of any shape
    try:
        stream = spark.readStream.schema(ARRIVAL).parquet(path)
        query = advanced(stream, prefix).writeStream.foreachBatch(append_new(log_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)


def replayed(bars: DataFrame, scans: DataFrame, steps: int = 2) -> DataFrame:
    """The log after all sessions came in ``steps`` deliveries, each taken by a stream that starts again."""
    spark = bars.sparkSession
    folder = fresh(spark, "forward")
    rows = arrivals(bars, scans)
    cuts = bars.select(F.percentile_approx(F.unix_date("Date"), [k / steps for k in range(1, steps)] or [1.0], 1000).alias("c")).first().c or []
    edges = [None, *sorted(set(cuts))[: steps - 1], None]
    for low, high in zip(edges, edges[1:]):
        part = rows
        if low is not None:
            part = part.filter(F.unix_date("session") > low)
        if high is not None:
            part = part.filter(F.unix_date("session") <= high)
        part.write.mode("append").parquet(f"{folder}/arrivals")
        run(spark, f"{folder}/arrivals", f"{folder}/log", f"{folder}/checkpoint")
    return spark.read.schema(EVENT).parquet(f"{folder}/log")
