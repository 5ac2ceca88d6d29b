"""The forward event log of paper positions, and its replay.

A scanner row that is not actionable gives SIGNAL_REJECTED; an actionable one SIGNAL_CREATED and ENTRY_PENDING. The entry
fills at the open of the symbol's next session (ENTRY_FILLED, with TARGET_UPDATED and STOP_UPDATED); each session from
there on gives POSITION_MARKED, up to the session that touches stop or target (both: the stop, as ambiguous) or
is the horizon-th after the signal, which also gives EXIT_FILLED. A position whose sessions have not all come yet stays
open. A signal of a session without a bar of its symbol is refused.

``log`` is the batch form: each bar gets the next bars of its symbol as an array (one window), signals join their bar by
key, and a position's sessions are exploded from that array; nothing joins by range. ``streaming.forward`` makes the same events
bar by bar. Both know an event by its ``unique_key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Round-trip cost of a paper trade, and the least planned target and stop.
COST = 5.0 / 10_000.0
LEAST_MOVE = 0.005
EVENT = "event_type string, as_of date, symbol string, direction string, model_id string, snapshot string, unique_key string, source_key string, horizon int, price double, target_price double, stop_price double, mark_return double, mfe double, mae double, reason string, gross_return double, net_return double"
NAMES = [f.split()[0] for f in EVENT.split(", ")]
SIGNAL = ["symbol", "as_of", "direction", "model_id", "snapshot", "status", "horizon", "expected_return", "expected_mfe", "expected_mae"]


def signals(scored: DataFrame, horizon: int = 5) -> DataFrame:
    """Scanner rows of every scored date: the side that the trailing return points to, actionable from a probability of 0.55 on."""
    up = F.col("x1") >= 0
    return scored.select(
        "symbol", F.col("Date").alias("as_of"), F.when(up, "Bullish").otherwise("Bearish").alias("direction"), F.col("scope").alias("model_id"), F.concat(F.lit("scan-"), F.col("Date").cast("string")).alias("snapshot"),
        F.when(F.when(up, F.col("p")).otherwise(1 - F.col("p")) >= 0.55, "ACTIONABLE").otherwise("REJECTED").alias("status"), F.lit(horizon).alias("horizon"), F.col("er").alias("expected_return"), F.col("emfe").alias("expected_mfe"), F.col("emae").alias("expected_mae"),
    )


def keyed(rows: DataFrame, prefix: str) -> DataFrame:
    """Events in ``EVENT``'s columns, from rows with kind, as_of, a key's suffix and whatever else they have; ``unique_key`` is what an event is known by."""
    kind = F.concat(F.lit(prefix), "kind")
    parts = [kind, F.col("as_of").cast("string"), F.upper("symbol"), F.col("direction"), F.col("model_id"), F.coalesce("snapshot", F.lit("")), F.col("suffix")]
    rows = rows.withColumn("event_type", kind).withColumn("unique_key", F.sha2(F.concat_ws("|", *parts), 256))
    return rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in (f.split() for f in EVENT.split(", "))))


def one_each(rows: DataFrame) -> DataFrame:
    """Of scanner rows with one key the smallest stays."""
    by = Window.partitionBy("symbol", "as_of", "direction", "model_id", "snapshot", "horizon").orderBy("status", "expected_return", "expected_mfe", "expected_mae")
    return rows.select(*SIGNAL).withColumn("rk_", F.row_number().over(by)).filter("rk_ = 1").drop("rk_")


def log(bars: DataFrame, scans: DataFrame, most: int = 40, prefix: str = "") -> DataFrame:
    """All events of scanner rows over the bars there are. ``most``: the largest horizon."""
    own = F.concat(F.lit("h"), F.col("horizon").cast("string"))
    ahead = Window.partitionBy("symbol").orderBy("Date").rowsBetween(1, most)
    valid = bars.filter("Open IS NOT NULL AND High IS NOT NULL AND Low IS NOT NULL AND Close IS NOT NULL")
    paths = valid.select("symbol", F.col("Date").alias("as_of"), F.collect_list(F.struct("Date", "Open", "High", "Low", "Close")).over(ahead).alias("path"))
    rows = one_each(scans).join(paths, ["symbol", "as_of"]).withColumn("path", F.slice("path", 1, F.col("horizon")))

    bull, up, down = F.col("direction") == "Bullish", F.col("planned_target"), F.col("planned_stop")
    entry = F.get("path", F.lit(0))["Open"]
    rows = rows.withColumn("planned_target", F.greatest("expected_return", F.greatest("expected_mfe", F.lit(0.0)) * 0.5, F.lit(LEAST_MOVE))).withColumn("planned_stop", F.greatest(F.abs("expected_mae"), F.lit(LEAST_MOVE))).withColumn("entry", entry)
    rows = rows.withColumn("target_price", F.when(bull, F.col("entry") * (1.0 + up)).otherwise(F.col("entry") * (1.0 - up))).withColumn("stop_price", F.when(bull, F.col("entry") * (1.0 - down)).otherwise(F.col("entry") * (1.0 + down)))
    at_stop = lambda b: F.when(bull, b["Low"] <= F.col("stop_price")).otherwise(b["High"] >= F.col("stop_price"))
    at_target = lambda b: F.when(bull, b["High"] >= F.col("target_price")).otherwise(b["Low"] <= F.col("target_price"))
    rows = rows.withColumn("hit", F.array_position(F.transform("path", lambda b: at_stop(b) | at_target(b)), True))
    rows = rows.withColumn("n", F.when(F.col("hit") > 0, F.col("hit")).otherwise(F.size("path")).cast("int")).withColumn("out", (F.col("hit") > 0) | (F.size("path") == F.col("horizon")))
    source = F.sha2(F.concat_ws("|", F.lit(prefix + "ENTRY_PENDING"), F.col("as_of").cast("string"), F.upper("symbol"), F.col("direction"), F.col("model_id"), F.coalesce("snapshot", F.lit("")), own), 256)
    until = lambda f, least: F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: (F.array_min if least else F.array_max)(F.transform(F.slice("path", 1, k), lambda b: b[f])))
    held = rows.filter((F.col("status") == "ACTIONABLE") & (F.col("n") > 0)).select("symbol", "direction", "model_id", "snapshot", "horizon", "entry", "target_price", "stop_price", "hit", "n", "out", source.alias("source_key"), F.slice("path", 1, F.col("n")).alias("path"), until("High", False).alias("highs"), until("Low", True).alias("lows"))
    one = held.select("*", F.posexplode(F.arrays_zip("path", "highs", "lows"))).drop("path", "highs", "lows").select("*", "col.path.*", F.col("col.highs").alias("most"), F.col("col.lows").alias("least")).drop("col")
    one = one.withColumn("last", F.col("pos") == F.col("n") - 1).withColumn("touched", F.col("last") & (F.col("hit") > 0)).withColumn("at_stop", F.col("touched") & at_stop(one)).withColumn("at_target", F.col("touched") & at_target(one))
    side = lambda up, down: F.when(bull, F.col(up) / F.col("entry") - 1.0).otherwise(F.col("entry") / F.col(down) - 1.0)
    one = one.withColumn("mark_return", side("Close", "Close")).withColumn("mfe", side("most", "least")).withColumn("mae", side("least", "most"))
    one = one.withColumn("out_price", F.when(F.col("at_stop"), F.col("stop_price")).when(F.col("touched"), F.col("target_price")).otherwise(F.col("Close"))).withColumn("gross", side("out_price", "out_price"))
    why = F.when(F.col("at_stop") & F.col("at_target"), "stop_intraday_ambiguous").when(F.col("at_stop"), "stop").when(F.col("touched"), "target").otherwise("time_exit")

    none, first, leaves = F.lit(None).cast("double"), F.col("pos") == 0, F.col("last") & F.col("out")
    fields = ("kind", "tail", "price", "goal", "guard", "mark", "best", "worst", "reason", "gross_return", "net_return")

    def made(when: Column, *values: Column) -> Column:
        return F.when(when, F.struct(*(v.alias(n) for n, v in zip(fields, values))))

    text, marks = F.lit(None).cast("string"), (F.col("mark_return"), F.col("mfe"), F.col("mae"))
    few = F.array(
        made(first, F.lit("ENTRY_FILLED"), F.concat(F.lit("|"), own), F.col("entry"), F.col("target_price"), F.col("stop_price"), none, none, none, text, none, none),
        made(first, F.lit("TARGET_UPDATED"), F.lit("|TARGET_UPDATED"), F.col("target_price"), none, none, none, none, none, text, none, none),
        made(first, F.lit("STOP_UPDATED"), F.lit("|STOP_UPDATED"), F.col("stop_price"), none, none, none, none, none, text, none, none),
        made(F.lit(True), F.lit("POSITION_MARKED"), F.concat(F.lit("|"), F.col("Date").cast("string")), F.col("Close"), none, none, *marks, text, none, none),
        made(leaves, F.lit("EXIT_FILLED"), F.lit(""), F.col("out_price"), none, none, *marks, why, F.col("gross"), F.col("gross") - COST),
    )
    moves = one.select("symbol", "direction", "model_id", "snapshot", "horizon", "source_key", F.col("Date").alias("as_of"), F.explode(F.filter(few, lambda e: e.isNotNull())).alias("e")).select("*", "e.*").drop("e")
    moves = moves.withColumn("suffix", F.concat("source_key", "tail")).withColumnsRenamed({"goal": "target_price", "guard": "stop_price", "mark": "mark_return", "best": "mfe", "worst": "mae"})

    known = one_each(scans).join(valid.select("symbol", F.col("Date").alias("as_of"), F.lit(True).alias("seen")).distinct(), ["symbol", "as_of"], "left")
    kinds = F.when(F.col("seen").isNull(), F.array(F.lit("SIGNAL_REFUSED"))).when(F.col("status") == "ACTIONABLE", F.array(F.lit("SIGNAL_CREATED"), F.lit("ENTRY_PENDING"))).otherwise(F.array(F.lit("SIGNAL_REJECTED")))
    begun = known.select("symbol", "as_of", "direction", "model_id", "snapshot", "horizon", own.alias("suffix"), F.when(F.col("seen").isNull(), "no bar").alias("reason"), F.explode(kinds).alias("kind"))
    return keyed(begun, prefix).unionByName(keyed(moves, prefix))


def positions(events: DataFrame, prefix: str = "") -> DataFrame:
    """Every position as the log leaves it: its last state, fill, exit and returns. One aggregation by position."""
    at = F.coalesce("source_key", F.when(F.col("event_type") == prefix + "ENTRY_PENDING", F.col("unique_key")))
    of = lambda kind, column: F.max(F.when(F.col("event_type") == prefix + kind, F.col(column)))
    got = events.withColumn("position", at).filter("position IS NOT NULL").groupBy("position").agg(
        F.first("symbol").alias("symbol"), F.first("direction").alias("direction"), F.first("model_id").alias("model_id"), of("ENTRY_PENDING", "as_of").alias("signal_date"), of("ENTRY_FILLED", "as_of").alias("entry_date"), of("ENTRY_FILLED", "price").alias("entry_price"),
        of("EXIT_FILLED", "as_of").alias("exit_date"), of("EXIT_FILLED", "price").alias("exit_price"), of("EXIT_FILLED", "reason").alias("exit_reason"), of("EXIT_FILLED", "net_return").alias("net_return"), F.count(F.when(F.col("event_type") == prefix + "POSITION_MARKED", 1)).alias("n_marks"),
    )
    state = F.when(F.col("exit_date").isNotNull(), "EXIT_FILLED").when(F.col("entry_date").isNotNull(), "ENTRY_FILLED").otherwise("ENTRY_PENDING")
    return got.withColumn("status", state)
