"""State kept as Parquet: artifact generations, manifests, fingerprints, the regime cache, journals, run guards."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.bars import replaced

# Schemas of the state tables.
TABLES = {
    "models": "model_id string, registered_at timestamp, state string, horizon int, direction string, scope string, metadata_json string",
    "scanner_snapshots": "scan_id string, as_of date, identity_hash string, n_rows long, created_at timestamp",
    "scanner_candidates": "scan_id string, symbol string, direction string, model_id string, status string, reason string, score double",
    "forward_events": "event_id string, unique_key string, event_type string, event_time timestamp, as_of date, symbol string, direction string, model_id string, snapshot string, payload_json string",
    "holdout_runs": "run_id string, created_at timestamp, status string, thresholds_json string",
    "holdout_models": "run_id string, model_id string, frozen_hash string",
    "daily_cycles": "cycle_date date, started_at timestamp, status string",
    "diagnostic_signals": "signal_id string, as_of date, symbol string, payload_json string",
    "diagnostic_events": "event_id string, signal_id string, event_type string, event_time timestamp, payload_json string",
}


def fingerprint(df: DataFrame) -> str:
    """A hash of a table's rows whatever their order and partitioning (columns by name)."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    got = df.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("s")).first()
    return hashlib.sha256(json.dumps([sorted(df.columns), got.n, got.x, got.s]).encode()).hexdigest()[:24]


def write_generation(frames: dict[str, DataFrame], root: str, generation: str) -> None:
    """All frames under root/generation, then the pointer: readers see whole generations only. A generation is
    written once; its name cannot be used again."""
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        df.write.mode("error").parquet(f"{root}/{generation}/{name}")
    rows = [(generation, name, fingerprint(df)) for name, df in frames.items()]
    pointer = spark.createDataFrame(rows, "generation string, frame string, fingerprint string").coalesce(1)
    replaced(spark, f"{root}/_latest", pointer.write.parquet)


def read_generation(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The latest generation's frames (a few names, listed by the pointer)."""
    return {r.frame: spark.read.parquet(f"{root}/{r.generation}/{r.frame}") for r in spark.read.parquet(f"{root}/_latest").collect()}


@dataclass(frozen=True)
class Manifest:
    features: tuple[str, ...]
    parameters: str

    @property
    def id(self) -> str:
        return hashlib.sha256(json.dumps([self.features, self.parameters], sort_keys=True).encode()).hexdigest()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A state table, empty if nothing was written yet."""
    try:
        return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], TABLES[name])


def append(spark: SparkSession, root: str, name: str, new: DataFrame, key: str) -> int:
    """Rows of new whose key the table lacks, appended; how many they are. Running it again adds nothing."""
    fresh = new.dropDuplicates([key]).join(table(spark, root, name).select(key), key, "left_anti").select(*[c.split()[0] for c in TABLES[name].split(", ")]).persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(f"{root}/{name}")
    fresh.unpersist()
    return n


def journal(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A journal with new rows; a key that is there already is an error."""
    if existing.join(new, key, "left_semi").limit(1).count() or new.groupBy(*key).count().filter("count > 1").limit(1).count():
        raise ValueError("the journal has this entry already")
    return existing.unionByName(new)


def regimes_cached(spark: SparkSession, root: str, market: DataFrame, columns: list[str], compute) -> tuple[DataFrame, str]:
    """Labels of all dates, computed only for dates after the cached prefix; and how the cache served:
    HIT, PARTIAL_APPEND, INVALIDATED (a cached date's inputs changed) or MISS.

    ``compute(market, first)`` gives (Date, cluster) for dates from ``first`` on (all if None)."""
    inputs = market.select("Date", F.sha2(F.to_json(F.struct(*columns)), 256).alias("inputs"))
    try:
        cached, status = spark.read.schema("Date date, cluster long, inputs string").parquet(f"{root}/regimes"), "HIT"
        last = cached.agg(F.max("Date")).first()[0]
        old = inputs.filter(F.col("Date") <= F.lit(last))
        if old.count() != cached.count() or old.join(cached, ["Date", "inputs"], "left_anti").limit(1).count():
            cached, status = None, "INVALIDATED"
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cached, status = None, "MISS"
    if cached is None:
        out = compute(market, None).join(inputs, "Date").select("Date", "cluster", "inputs")
    else:
        newer = inputs.filter(F.col("Date") > F.lit(last))
        first = newer.agg(F.min("Date")).first()[0]
        if first is None:
            return cached.select("Date", "cluster"), status
        status = "PARTIAL_APPEND"
        out = compute(market, first).join(newer, "Date").select("Date", "cluster", "inputs")
    out.write.mode("append" if status == "PARTIAL_APPEND" else "overwrite").parquet(f"{root}/regimes")
    return spark.read.schema("Date date, cluster long, inputs string").parquet(f"{root}/regimes").select("Date", "cluster"), status


def cycle_once(spark: SparkSession, root: str, day: str, work) -> str:
    """Run a day's work unless its cycle was recorded; DONE, ALREADY_DONE, or RUNNING if another run holds the day.

    A run holds a day by making its lock file, which only one can; it is given back when the work fails, so the
    day can be tried again. A lock whose run was killed must be removed by hand: nobody can tell it from a slow run."""
    if table(spark, root, "daily_cycles").filter(F.col("cycle_date") == F.to_date(F.lit(day))).limit(1).count():
        return "ALREADY_DONE"
    lock = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_locks/{day}")
    fs = lock.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.createNewFile(lock):
        return "RUNNING"
    try:
        if table(spark, root, "daily_cycles").filter(F.col("cycle_date") == F.to_date(F.lit(day))).limit(1).count():
            return "ALREADY_DONE"
        work()
        row = spark.sql(f"SELECT DATE '{day}' AS cycle_date, current_timestamp() AS started_at, 'DONE' AS status")
        append(spark, root, "daily_cycles", row, "cycle_date")
        return "DONE"
    finally:
        fs.delete(lock, False)


def prefix(bars: DataFrame, day: str) -> DataFrame:
    """What was known at the close of a day."""
    return bars.filter(F.col("Date") <= F.to_date(F.lit(day)))


def load_universe(spark: SparkSession, rows: list[dict]) -> tuple[DataFrame, str]:
    """Universe rows (the last of equal symbols counts) sorted by symbol, and a hash of them."""
    last = {r["symbol"].strip().upper(): r for r in rows}
    got = [(s, bool(r.get("enabled", True)), r.get("role", "stock"), r.get("sector"), r.get("sector_proxy"), bool(r.get("benchmark", False))) for s, r in sorted(last.items())]
    df = spark.createDataFrame(got, "symbol string, enabled boolean, role string, sector string, sector_proxy string, benchmark boolean")
    return df, hashlib.sha256(json.dumps(got).encode()).hexdigest()[:20]
