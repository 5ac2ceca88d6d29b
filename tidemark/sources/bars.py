"""Daily bars: from trades, from CSV, checked, merged, audited.

A bar table has columns symbol, Date, Open, High, Low, Close, Volume; (symbol, Date) is its key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dialect import DUCK, SPARK, Dialect

FIELDS = ("Open", "High", "Low", "Close", "Volume")
SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("Date", T.DateType()), *(T.StructField(f, T.DoubleType()) for f in FIELDS)])
# Spellings of column names, in lower case and without blanks around them.
ALIASES = {"date": "Date", "datetime": "Date", "timestamp": "Date", "open": "Open", "high": "High", "low": "Low", "close": "Close", "adj close": "Adj Close", "adjusted close": "Adj Close", "adjusted_close": "Adj Close", "adj_close": "Adj Close", "adjclose": "Adj Close", "volume": "Volume", "symbol": "symbol", "ticker": "symbol"}
#: Relative tolerance of the bounds High >= Open, Close >= Low.
TOLERANCE = 1e-10


def trades_sql(d: Dialect, symbols: int = 8) -> str:
    """Bars of a trade table: a total order of the trades of a day decides its first and last price."""
    order = d.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return f"""SELECT symbol, Date, min_by(price, o) AS Open, max(price) AS High, min(price) AS Low, max_by(price, o) AS Close, sum(l_quantity) AS Volume
FROM (SELECT concat('S', CAST(l_suppkey % {symbols} AS VARCHAR(20))) AS symbol, CAST(l_shipdate AS DATE) AS Date, l_extendedprice / l_quantity AS price, {order} AS o, l_quantity FROM {d.table("lineitem")}) t
GROUP BY symbol, Date"""


def from_trades(spark: SparkSession, sf_dir: str, symbols: int = 8) -> DataFrame:
    """Bars of the lineitem table; one map-side combined aggregation, whatever the number of trades of a day.

    Queries name bars several times and follow one another, so they are kept (in memory, else on local
    disks; a lost executor's part is computed again). One row a symbol and session, they are small next to trades."""
    return spark.sql(trades_sql(SPARK, symbols), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet")).persist()


def received(spark: SparkSession, sf_dir: str, symbols: int = 8) -> DataFrame:
    """When the last trade of each bar of ``from_trades`` was received: symbol, Date, available_at. The trade table has no such
    time; orders stand in for it, each received up to 19 days after the trade."""
    return spark.sql(received_sql(SPARK, symbols), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def received_sql(d: Dialect, symbols: int = 8) -> str:
    return f"SELECT concat('S', CAST(l_suppkey % {symbols} AS VARCHAR(20))) AS symbol, CAST(l_shipdate AS DATE) AS Date, max(CAST(CAST(l_shipdate AS DATE) + CAST(l_orderkey % 20 AS INT) AS TIMESTAMP)) AS available_at FROM {d.table('lineitem')} GROUP BY 1, 2"


def oracle_bars(symbols: int = 8) -> str:
    return trades_sql(DUCK, symbols)


def normalized(df: DataFrame) -> DataFrame:
    """Known column names in their canonical spelling, whatever their case; blanks around names go. Two
    columns for one name are an error."""
    names = [ALIASES.get(c.strip().lower(), c.strip()) for c in df.columns]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"several columns for {', '.join(twice)}")
    return df.toDF(*names)


def read_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars of CSV files with a header; columns are found by name and cast, values that do not parse are null."""
    df = normalized(spark.read.option("header", True).csv(path))
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.lit(symbol) if symbol else F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^/.]*)?$", 1))
    return df.select("symbol", F.expr("try_cast(Date AS DATE)").alias("Date"), *(F.expr(f"try_cast({f} AS DOUBLE)").alias(f) for f in FIELDS))


def replaced(spark: SparkSession, path: str, write) -> None:
    """Write beside a path, then put the result in its place. A step that fails raises, and the old table is put back;
    the old one goes only once the new one is in place. A crash between the two renames leaves both tables beside the
    path, under names that end in .old- and .new-; ``mended`` puts the old one back."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, old, at = (hadoop(f"{path.rstrip('/')}{end}") for end in (f".new-{uuid.uuid4().hex}", f".old-{uuid.uuid4().hex}", ""))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(new.toString())
    except Exception:
        fs.delete(new, True)
        raise
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        fs.delete(new, True)
        raise OSError(f"cannot move {at.toString()} aside; it is as it was")
    if not fs.rename(new, at):
        if had and not fs.rename(old, at):
            raise OSError(f"cannot put {new.toString()} in place; the old table is {old.toString()}")
        fs.delete(new, True)
        raise OSError(f"cannot put a new table at {at.toString()}; it is as it was")
    fs.delete(old, True)


def mended(spark: SparkSession, path: str) -> bool:
    """After a crash between two renames: put the old table back where nothing is at the path. Whether that was so."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = hadoop(path.rstrip("/"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [] if fs.exists(at) else [s.getPath() for s in fs.globStatus(hadoop(f"{path.rstrip('/')}.old-*")) or []]
    return len(old) == 1 and bool(fs.rename(old[0], at))


def write_csv(df: DataFrame, path: str) -> None:
    replaced(df.sparkSession, path, lambda at: df.write.option("header", True).csv(at))


def save(df: DataFrame, path: str) -> None:
    """CSV or Parquet by the path's suffix."""
    write_csv(df, path) if path.endswith(".csv") else replaced(df.sparkSession, path, df.write.parquet)


def load(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def checks_sql(bars: str) -> str:
    """Number of bars that break each rule."""
    t = TOLERANCE
    positive = " OR ".join(f"{f} <= 0" for f in FIELDS[:4])
    missing = " OR ".join(f"{f} IS NULL" for f in FIELDS)
    return f"""SELECT count(*) AS n_rows, count(CASE WHEN {missing} THEN 1 END) AS n_missing, count(CASE WHEN {positive} THEN 1 END) AS n_nonpositive,
count(CASE WHEN Volume < 0 THEN 1 END) AS n_negative_volume, count(CASE WHEN High < Low THEN 1 END) AS n_high_below_low,
count(CASE WHEN greatest(Open, Close) > High * (1 + {t}) OR least(Open, Close) < Low * (1 - {t}) THEN 1 END) AS n_out_of_range,
count(*) - count(DISTINCT concat(symbol, '|', CAST(Date AS VARCHAR(20)))) AS n_duplicates FROM ({bars}) b"""


def validated(bars: DataFrame) -> DataFrame:
    """The bars, checked by one aggregation; raises if a rule is broken."""
    got = bars.sparkSession.sql(checks_sql("SELECT * FROM {bars}"), bars=bars).first().asDict()
    broken = {k: v for k, v in got.items() if k != "n_rows" and v}
    if broken or not got["n_rows"]:
        raise ValueError(f"bars are not valid: {broken or 'no rows'}")
    return bars


def upserted(existing: DataFrame, new: DataFrame) -> DataFrame:
    """History with new bars in place of old ones of the same key."""
    return existing.join(new.select("symbol", "Date").distinct(), ["symbol", "Date"], "left_anti").unionByName(new)


def upsert_counts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Per symbol: how many new bars take the place of old ones, and how many are added."""
    keys = new.select("symbol", "Date").distinct().join(existing.select("symbol", "Date").distinct().withColumn("old", F.lit(1)), ["symbol", "Date"], "left")
    return keys.groupBy("symbol").agg(F.count("old").alias("replaced"), F.count_if(F.col("old").isNull()).alias("inserted"))


def in_window(bars: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Bars from start to end, both included; the filter reaches the scan."""
    if start:
        bars = bars.filter(F.col("Date") >= F.to_date(F.lit(start)))
    return bars.filter(F.col("Date") <= F.to_date(F.lit(end))) if end else bars


def spine(bars: DataFrame) -> DataFrame:
    """Every symbol on every date of the union calendar; missing bars are null.

    Symbols and dates are both small next to bars (their product is what a pivot would hold)."""
    keys = bars.select("Date").distinct().crossJoin(F.broadcast(bars.select("symbol").distinct()))
    return keys.join(bars, ["symbol", "Date"], "left")


# The fixed universe over the eight symbols of trade bars.
UNIVERSE = [
    ("S0", "broad_market_etf", None, None, True), ("S1", "sector_etf", "alpha", None, False), ("S2", "sector_etf", "beta", None, False),
    ("S3", "stock", "alpha", "S1", False), ("S4", "stock", "alpha", "S1", False), ("S5", "stock", "beta", "S2", False),
    ("S6", "inverse_etf", None, None, False), ("S7", "leveraged_inverse_etf", None, None, False),
]
EDGES = [("S0", "S6"), ("S0", "S7")]


def universe(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNIVERSE, "symbol string, role string, sector string, sector_proxy string, benchmark boolean")


def universe_sql() -> str:
    def lit(x):
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"'{x}'"

    rows = " UNION ALL ".join(f"SELECT {lit(a)} AS symbol, {lit(b)} AS role, CAST({lit(c)} AS VARCHAR(20)) AS sector, CAST({lit(e)} AS VARCHAR(20)) AS sector_proxy, {lit(f)} AS benchmark" for a, b, c, e, f in UNIVERSE)
    return rows
