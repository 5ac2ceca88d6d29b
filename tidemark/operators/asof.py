"""Point-in-time join over two clocks: what a decision could know.

A decision (key, session, decided_at) sees evidence of its key whose session is not after its own and that was retrieved by the
time it was made; of that the latest session, then the latest retrieval, then the largest row. One clock would be a
last-known-value scan in order of session. For two, each key's rows are cut into blocks by the retrieval clock, and a
decision asks the blocks before its own, gathered to spans of 1, 2, 4, ... blocks, so it asks as many spans as its block's
number has binary ones; in a span all evidence came in time, so one clock is left. Within its own block rows are few and are taken in order of
retrieval. Spans of a hot key are long, so scans run in buckets of the session clock and what earlier buckets hold comes from a small table.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.shared import written

#: Rows of evidence in a block, on average over keys; and days of sessions in a bucket.
BLOCK_ROWS, BUCKET_DAYS, MOST_BLOCKS = 5_000, 512, 1024


def latest(decisions: DataFrame, evidence: DataFrame, key: str = "symbol", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """decisions: id (unique), key, session (date), decided_at (timestamp). evidence: key, session, retrieved_at, value (double).

    Returns id, session, retrieved_at, value of what each decision sees, for those that see something. A null key, session or time matches nothing.
    """
    d = decisions.select("id", F.col(key).alias("k"), "session", F.col("decided_at").cast("timestamp").alias("at")).dropna()
    e = evidence.select(F.col(key).alias("k"), "session", F.col("retrieved_at").cast("timestamp").alias("at"), F.col("value").cast("double").alias("value")).dropna(subset=["k", "session", "at"])
    e = written(e, "evidence")
    blocks = max(1, min(MOST_BLOCKS, e.count() // block_rows))
    probs = [j / blocks for j in range(1, blocks)]
    # cut points of the retrieval clock of all keys: a list of bounded length
    cuts = sorted(set(e.agg(F.percentile_approx(F.unix_micros("at"), probs or [1.0], 10_000).alias("c")).first().c or [])) if probs else []
    levels = max(1, len(cuts)).bit_length() + 1
    block = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<bigint>"), lambda c: c < F.unix_micros("at")))
    d, e = d.withColumn("b", block), e.withColumn("b", block)

    seen = F.struct("session", "at", "value").alias("seen")
    # a span of level l is 2^l blocks; a decision in block b asks span (b >> l) - 1 of every level where b >> l is odd
    asks = d.select("id", "k", "session", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("l"), "b").filter(F.expr("shiftright(b, l) % 2 = 1")).select("id", "k", "session", "l", F.expr("shiftright(b, l) - 1").alias("span"))
    holds = e.select("k", "session", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("l"), "b", seen).select("k", "session", "l", F.expr("shiftright(b, l)").alias("span"), "seen").filter("span % 2 = 0")
    spans = known(asks, holds, ["k", "l", "span"])
    own = within(d, e)
    best = spans.unionByName(own).groupBy("id").agg(F.max("seen").alias("seen"))
    return best.select("id", F.col("seen.session").alias("session"), F.col("seen.at").alias("retrieved_at"), F.col("seen.value").alias("value"))


def known(asks: DataFrame, holds: DataFrame, by: list[str]) -> DataFrame:
    """id and the greatest seen whose session is not after the asker's, in each group: a scan in buckets of sessions."""
    bucket: Column = F.floor(F.unix_date("session") / BUCKET_DAYS).cast("int")
    each = holds.groupBy(*by, "session").agg(F.max("seen").alias("seen")).withColumn("id", F.lit(None).cast(asks.schema["id"].dataType)).withColumn("asks", F.lit(0))
    rows = each.unionByName(asks.withColumn("seen", F.lit(None).cast(holds.schema["seen"].dataType)).withColumn("asks", F.lit(1))).withColumn("bucket", bucket)
    tops = rows.groupBy(*by, "bucket").agg(F.max("seen").alias("top"))
    before = tops.withColumn("before", F.max("top").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("top")  # a row a bucket
    inside = F.max("seen").over(Window.partitionBy(*by, "bucket").orderBy("session", "asks").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("inside", inside).filter("asks = 1").join(before, [*by, "bucket"])
    return found.select("id", F.greatest("inside", "before").alias("seen")).filter("seen IS NOT NULL")


def within(d: DataFrame, e: DataFrame) -> DataFrame:
    """The same in a decision's own block of its key, in order of retrieval."""
    kind = d.schema["id"].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["at", "session"])
        sessions, rows, out, at = [], [], [], 0  # evidence so far by session: the greatest of each
        come = list(zip(right["at"], right["session"], right["value"]))
        for t, s, id_ in sorted(zip(left["at"], left["session"], left["id"])):
            while at < len(come) and come[at][0] <= t:
                a, es, v = come[at]
                at += 1
                new = (es, a, float("-inf") if pd.isna(v) else v)
                k = bisect.bisect_left(sessions, es)
                if k < len(sessions) and sessions[k] == es:
                    rows[k] = max(rows[k], new)
                else:
                    sessions.insert(k, es)
                    rows.insert(k, new)
            k = bisect.bisect_right(sessions, s)
            if k:
                es, a, v = rows[k - 1]
                out.append((id_, es, a, None if v == float("-inf") else v))
        return pd.DataFrame(out, columns=["id", "session", "at", "value"])

    got = d.groupBy("k", "b").cogroup(e.groupBy("k", "b")).applyInPandas(run, f"id {kind}, session date, at timestamp, value double")
    return got.select("id", F.struct("session", "at", "value").alias("seen"))
