"""Structured Streaming forms of event operators, and the batch forms they converge to.

All take ``events`` (event_id, user_id, ts, event_type, value, props). ``ts`` comes without a time
zone; it is cast before a watermark is set on it. State is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "1 hour"


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = LATE) -> DataFrame:
    """Count and sum by window and type."""
    e = timed(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = LATE) -> DataFrame:
    e = timed(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"), F.max("value").alias("most")).select(F.col("window.start").alias("window_start"), "n", F.round("most", 4).alias("most"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = LATE) -> DataFrame:
    e = timed(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("session_start"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = LATE) -> DataFrame:
    """One event of each key: within the watermark in a stream."""
    e = timed(events)
    return e.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if e.isStreaming else e.dropDuplicates([key])


def bars(events: DataFrame, late: str = LATE) -> DataFrame:
    """Daily bars of the event values by type."""
    e = timed(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    at = F.struct("ts", "event_id")
    got = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.min_by("value", at).alias("Open"), F.max("value").alias("High"), F.min("value").alias("Low"), F.max_by("value", at).alias("Close"), F.count("*").cast("double").alias("Volume"))
    return got.select(F.col("event_type").alias("symbol"), F.to_date("window.start").alias("Date"), *(F.round(c, 4).alias(c) for c in ("Open", "High", "Low", "Close", "Volume")))


def append_new(log_path: str):
    """A foreachBatch function that appends events whose key the log (Parquet at ``log_path``) lacks.

    A batch that runs again finds its keys in the log and adds nothing."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["unique_key"])
        try:
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(log_path).select("unique_key"), "unique_key", "left_anti").select(*batch.columns)
        except Exception as e:  # the first batch finds no log
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(log_path)

    return run


ORACLES = {
    "tumbling": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sliding": "SELECT w AS window_start, count(*) AS n, round(max(value), 4) AS most FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w, value FROM events) GROUP BY w",
    "sessions": "SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s",
    "bars": "SELECT event_type AS symbol, CAST(ts AS DATE) AS Date, round(arg_min(value, row(ts, event_id)), 4) AS Open, round(max(value), 4) AS High, round(min(value), 4) AS Low, round(arg_max(value, row(ts, event_id)), 4) AS Close, CAST(count(*) AS DOUBLE) AS Volume FROM events GROUP BY 1, 2",
}
VIEWS = {"tumbling": tumbling, "sliding": sliding, "sessions": sessions, "bars": bars}
