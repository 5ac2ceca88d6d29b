"""Price providers as a Spark data source over fetched JSON, provider dispatch, synthetic bars.

Fetching is a function (url -> status, body) given by the caller, so the source works with HTTP
clients, staged files and canned answers alike. The plain source (``download``) has one partition a
symbol and raises what a provider says. The source of answers (``answers``) serves any number of symbols
in one job: its readers ask providers in turn, try again where that may help, and give errors back as
rows beside the bars, so a failing symbol costs itself only.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.bars import ALIASES, FIELDS, SCHEMA, load, save, upsert_counts, upserted, validated
from tidemark.sources.shared import written

Fetch = Callable[[str], tuple[int, str]]
ERRORS = {401: "the key was refused", 403: "the key lacks access", 404: "unknown symbol", 429: "too many requests"}


def rows_of(body: str) -> list[dict]:
    """The list of bars in an answer: bare, or under ``historical`` or ``data`` (also inside a one-element list)."""
    got = json.loads(body)
    if isinstance(got, dict):
        for key in ("historical", "data"):
            if isinstance(got.get(key), list):
                return got[key]
        raise ValueError(got.get("Error Message") or got.get("message") or "the answer holds no bars")
    if len(got) == 1 and isinstance(got[0], dict) and "historical" in got[0]:
        return got[0]["historical"]
    return got


def bars_of(symbol: str, body: str, start: str, end: str) -> list[tuple]:
    """Bars between two ISO dates, sorted, the last of equal dates kept."""
    import datetime as dt

    out = {}
    for row in rows_of(body):
        named = {ALIASES.get(k.strip().lower(), k): v for k, v in row.items()}
        day = str(named["Date"])[:10]
        if start <= day <= end:
            out[day] = (symbol, dt.date.fromisoformat(day), *(float(named[f]) for f in FIELDS))
    return [out[d] for d in sorted(out)]


class Symbol(InputPartition):
    def __init__(self, symbol: str):
        self.symbol = symbol


class Reader(DataSourceReader):
    def __init__(self, options: dict, fetch: Fetch):
        self.options, self.fetch = options, fetch

    def partitions(self):
        return [Symbol(s) for s in self.options["symbols"].split(",") if s]

    def read(self, partition: Symbol) -> Iterator[tuple]:
        status, body = self.fetch(self.options["url"].format(symbol=partition.symbol))
        if status != 200:
            raise ValueError(f"{partition.symbol}: {ERRORS.get(status, f'status {status}')}")
        yield from bars_of(partition.symbol, body, self.options.get("start", "0000"), self.options.get("end", "9999"))


def register(spark: SparkSession, name: str, fetch: Fetch) -> None:
    """Make ``spark.read.format(name)`` read bars; options symbols (comma-separated), url (with {symbol}), start, end."""

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(dict(self.options), fetch)

    spark.dataSource.register(Source)
    FETCHERS[name] = fetch


#: What each registered provider is fetched with.
FETCHERS: dict[str, Fetch] = {}
#: A row for each try (no date; ``last`` on the one that settles a symbol), and the bars of the provider that had them.
ANSWERS = "symbol string, provider string, attempt int, error string, last boolean, Date date, Open double, High double, Low double, Close double, Volume double"


class Some(InputPartition):
    def __init__(self, symbols: list[str]):
        self.symbols = symbols


class Asker(DataSourceReader):
    """Asks for each symbol of a partition. Rows of a symbol leave once its answer has been read to its end, so there
    are no bars of half an answer; what goes wrong, whatever its kind, becomes the error of a row."""

    def __init__(self, fetchers: list[tuple[str, Fetch]], symbols: list[str], options: dict):
        self.fetchers, self.symbols, self.options = fetchers, symbols, options

    def partitions(self):
        size = self.options["each"]
        return [Some(self.symbols[k : k + size]) for k in range(0, len(self.symbols), size)] or [Some([])]

    def read(self, partition: Some) -> Iterator[tuple]:
        for symbol in partition.symbols:
            yield from self.asked(symbol)

    def asked(self, symbol: str) -> Iterator[tuple]:
        o, none = self.options, (None,) * (1 + len(FIELDS))
        for k, (provider, fetch) in enumerate(self.fetchers):
            for attempt in range(1, o["attempts"] + 1):
                bars, error, again = once(fetch, symbol, o["url"], o["start"], o["end"])
                again = again and attempt < o["attempts"]
                yield (symbol, provider, attempt, error, error is None or (not again and k + 1 == len(self.fetchers)), *none)
                if error is None:
                    yield from ((symbol, provider, attempt, None, None, *bar[1:]) for bar in bars)
                    return
                if not again:
                    break
                time.sleep(o["wait"] * 2 ** (attempt - 1))


def once(fetch: Fetch, symbol: str, url: str, start: str, end: str) -> tuple[list[tuple], str | None, bool]:
    """Bars, or what went wrong and whether asking again may help: it may if the connection failed, or the provider
    is busy or broken; not if it refuses, has no such symbol, or its answer makes no sense."""
    try:
        status, body = fetch(url.format(symbol=symbol))
    except Exception as e:  # whatever a client raises
        return [], reason(e), True
    if status != 200:
        return [], f"{symbol}: {ERRORS.get(status, f'status {status}')}", status == 429 or status >= 500
    try:
        return bars_of(symbol, body, start, end), None, False
    except Exception as e:
        return [], f"{symbol}: {type(e).__name__}: {reason(e)}"[:200], False


def answers(spark: SparkSession, providers: list[str], symbols: list[str], url: str, start: str, end: str, *, attempts: int = 1, wait: float = 1.0, each: int = 32) -> DataFrame:
    """Tries and bars of all symbols (``ANSWERS``) from registered providers, asked in their order. A symbol named twice is
    asked once. attempts: of one provider for one symbol; wait: seconds before the second, then doubled; each: symbols of a task."""
    fetchers, wanted = [(p, FETCHERS[p]) for p in providers], list(dict.fromkeys(symbols))
    options = {"url": url, "start": start, "end": end, "attempts": max(attempts, 1), "wait": wait, "each": max(each, 1)}

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "provider-answers"

        def schema(self):
            return ANSWERS

        def reader(self, schema):
            return Asker(fetchers, wanted, options)

    spark.dataSource.register(Source)
    return spark.read.format("provider-answers").load()


def download(spark: SparkSession, provider: str, symbols: list[str], url: str, start: str, end: str) -> DataFrame:
    return spark.read.format(provider).option("symbols", ",".join(symbols)).option("url", url).option("start", start).option("end", end).load()


def download_any(spark: SparkSession, providers: list[str], symbols: list[str], url: str, start: str, end: str, **how) -> tuple[DataFrame, DataFrame]:
    """Bars from the first provider that has a symbol's, and (symbol, provider, error) of every symbol: the one that had it, or
    the last one with its error. Errors are recorded, not raised. All symbols are fetched in one job, once: its table is
    written to the shared folder (``how``: attempts, wait, each of ``answers``)."""
    got = written(answers(spark, providers, symbols, url, start, end, **how), "downloads")
    return got.filter("Date IS NOT NULL").select(SCHEMA.names), got.filter("last").select("symbol", "provider", "error")


def reason(e: Exception) -> str:
    """The line of an error (which may hold a worker's whole traceback) that says what was wrong."""
    lines = [line.strip() for line in str(e).splitlines() if line.strip()] or [type(e).__name__]
    return next((line for line in reversed(lines) if "Error:" in line), lines[0])[:200]


def update_history(spark: SparkSession, path: str, providers: list[str], symbols: list[str], url: str, start: str, end: str) -> DataFrame:
    """Download, check, merge into the history at a path (new bars take the place of old ones), put it in its place.
    Returns a row for each symbol: provider, error, bars replaced and inserted. A symbol that fails keeps its history."""
    new, status = download_any(spark, providers, symbols, url, start, end)
    try:
        old = load(spark, path)
        old.limit(1).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = spark.createDataFrame([], SCHEMA)
    counts = upsert_counts(old, new).persist()
    counts.count()
    if new.limit(1).count():
        save(upserted(old, validated(new)), path)
    return status.join(counts, "symbol", "left").fillna(0, ["replaced", "inserted"])


def staged(bars: DataFrame, path: str) -> None:
    """Bars as provider answers: one folder a symbol, a line of JSON a bar."""
    line = F.to_json(F.struct(F.col("Date").cast("string").alias("date"), *(F.col(f).alias(f.lower()) for f in FIELDS)))
    bars.select("symbol", line.alias("value")).repartition("symbol").write.partitionBy("symbol").text(path)


def staged_fetch(path: str) -> Fetch:
    """Fetches what ``staged`` wrote at a path, of this or any file system that pyarrow knows; a url is a symbol's name."""

    def fetch(url: str) -> tuple[int, str]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        found = system.get_file_info(fs.FileSelector(f"{root}/symbol={url}", allow_not_found=True))
        files = sorted(f.path for f in found if f.base_name.startswith("part-"))
        if not files:
            return 404, ""
        lines = [line for f in files for line in system.open_input_stream(f).read().decode().splitlines() if line]
        return 200, f"[{','.join(lines)}]"

    return fetch


def sample_bars(spark: SparkSession, symbols: list[str], rows: int = 1200, seed: int = 7, start: str = "2018-01-02") -> DataFrame:
    """Made-up bars: seeded random walks on business days, one task a symbol."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for k, symbol in zip(pdf["k"], pdf["symbol"]):
                rng = np.random.default_rng(seed + int(k))
                drift = np.where(np.arange(rows) // 120 % 2 == 0, 4e-4, -2e-4)
                close = 100 * np.exp(np.cumsum(drift + rng.normal(0, 0.012, rows)))
                opened = np.concatenate([[100.0], close[:-1]]) * (1 + rng.normal(0, 0.002, rows))
                high, low = np.maximum(opened, close) * (1 + abs(rng.normal(0, 0.004, rows))), np.minimum(opened, close) * (1 - abs(rng.normal(0, 0.004, rows)))
                yield pd.DataFrame({"symbol": symbol, "Date": pd.bdate_range(start, periods=rows).date, "Open": opened, "High": high, "Low": low, "Close": close, "Volume": rng.integers(500_000, 2_000_000, rows).astype(float)})

    return spark.createDataFrame(list(enumerate(symbols)), "k int, symbol string").repartition(len(symbols)).mapInPandas(run, SCHEMA)
