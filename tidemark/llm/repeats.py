"""Suffix-array dedup: bytes covered by a long string that starts anywhere else are removed.

A string of ``length`` bytes repeats where two suffixes agree to that depth, that is where neighbours of a suffix array do
(``suffixes``: two-stage sorting). Suffixes are dealt so that equal strings meet:

1. Each string has an owner, the first of the least hashes of its k-byte pieces; equal strings own equal pieces at
   equal places. Starts with one owner form a run; a run is dealt by the hash of its owner. One scan
   gives the runs, without their bytes: about one for each 170 bytes.
2. Only runs whose owner's hash comes from two places go on. Copies of whole texts are told by their hash beforehand
   and count as one place; their text travels once.
3. The bytes of such runs (to ``length`` behind the last start) are cut from the texts; of runs with the same bytes, at most
   two a task travel. Tasks sort the suffixes of a few megabytes of runs, whole owners together,
   compare neighbours and hand back the repeated starts. An owner with more different bytes than a task should hold goes
   another way: digests of its strings are grouped by Spark.
4. Repeated starts go to every run with the same bytes, and then, as spans, to their text.

Keys that hold many rows (a copied text, a shared passage) are counted first; those above a
thousandth of all, of which there are a thousand at most, are joined by broadcast, and the rest by exchange. Nothing but
counts reaches the driver. Every step that others build on is a written table.

Defined cases: a null text counts as empty; texts shorter than ``length`` keep all; spans are bytes and may cut a
character; null and repeated doc_ids each get their row; a row that is repeated whole is a copy like any other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, narrow, quiet, released, sized, written
from .suffixes import FACTOR, Suffixes, laid

#: Bytes of one pass over texts, and of the runs whose suffixes are sorted together.
PASS_BYTES, LOT_BYTES = 1 << 20, 3 << 20
#: Most bytes of one owner's different runs that one task sorts.
WIDE_BYTES = 8 << 20
#: Keys with more than this share of all rows are joined by broadcast; so many there are at most.
HEAVY_SHARE = 1000
#: Different runs whose copies a cutting task remembers.
REMEMBERED = 400_000
PLACE_BITS = 24
MIX = np.uint64(0xFF51AFD7ED558CCD)


class Owners:
    """Runs of string starts by owner."""

    def __init__(self, length: int, piece: int):
        self.length, self.piece, self.window = length, piece, length - piece + 1
        self.powers, self.back = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def factors(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers) < n:
            for name, by in (("powers", FACTOR), ("back", pow(FACTOR, -1, 1 << 64))):
                p = np.full(n, np.uint64(by))
                p[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.multiply.accumulate(p))
        return self.powers[:n], self.back[:n]

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Of the piece at each position; it depends on the piece's bytes alone."""
        powers, back = self.factors(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data + np.uint64(1)) * powers[:-1], out=sums[1:])
            h = (sums[self.piece :] - sums[: -self.piece]) * back[: len(sums) - self.piece]
            h ^= h >> np.uint64(33)
            h *= MIX
            h ^= h >> np.uint64(29)
        return h

    def least(self, key: np.ndarray) -> np.ndarray:
        """The least key of each window: of the end of its block and the start of the next one."""
        w, n = self.window, len(key)
        m = -(-n // w)
        blocks = np.full(m * w, np.iinfo(np.uint64).max, np.uint64)
        blocks[:n] = key
        blocks = blocks.reshape(m, w)
        fore = np.minimum.accumulate(blocks, 1).reshape(-1)
        rear = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
        return np.minimum(rear[: n - w + 1], fore[w - 1 : n])

    def runs(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last start, and owner's hash, of each run in texts that lie side by side and end there."""
        if len(data) < self.length:
            nothing = np.zeros(0, np.int64)
            return nothing, nothing, nothing
        h = self.hashes(data)
        place = np.arange(len(h), dtype=np.uint64)
        owner = (self.least(h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | place) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        valid = np.ones(len(owner), np.int8)
        edge = np.zeros(len(owner) + 1, np.int64)
        np.add.at(edge, np.clip(ends - self.length + 1, 0, len(owner)), 1)  # strings that start here would cross the end of a text
        np.add.at(edge, np.clip(ends, 0, len(owner)), -1)
        short = np.diff(ends, prepend=0) < self.length
        starts = np.concatenate([[0], ends[:-1]])
        np.add.at(edge, np.clip(starts[short], 0, len(owner)), 1)
        np.add.at(edge, np.clip(ends[short], 0, len(owner)), -1)
        valid[np.cumsum(edge[:-1]) > 0] = 0
        change = np.flatnonzero((np.diff(owner) != 0) | (np.diff(valid) != 0)) + 1
        first = np.concatenate([[0], change])
        last = np.concatenate([change, [len(owner)]]) - 1
        some = valid[first] > 0
        first, last = first[some], last[some]
        return first, last, h[owner[first]].astype(np.int64)


def anchors(texts: DataFrame, length: int, piece: int) -> DataFrame:
    """key, h, first, last of every run in texts (key, text)."""
    schema = pa.schema([("key", pa.binary()), ("h", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
    own = Owners(length, piece)

    def found(keys: pa.Array, data: np.ndarray, offsets: np.ndarray):
        at = 0
        while at < len(keys):
            to = at + 1
            while to < len(keys) and offsets[to + 1] - offsets[at] <= PASS_BYTES:
                to += 1
            begin, end = int(offsets[at]), int(offsets[to])
            step = PASS_BYTES if to == at + 1 else end - begin  # a long text goes by in pieces, counted from its start
            for a in range(begin, max(begin + 1, end - length + 1), step):
                b = min(end, a + step + length - 1)
                ends = offsets[at + 1 : to + 1].astype(np.int64) - a if to > at + 1 else np.array([b - a], np.int64)
                first, last, h = own.runs(data[a:b], ends)
                doc = np.searchsorted(ends, first, side="right")
                base = np.concatenate([[0], ends[:-1]])[doc] if to > at + 1 else np.full(len(doc), begin - a)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc + at)), pa.array(h), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))], schema=schema)
            at = to

    @quiet
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            text = batch.column(1)
            if not len(text):
                continue
            text = text.cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            yield from found(batch.column(0), np.frombuffer(text.buffers()[2] or b"", np.uint8), offsets)

    return texts.select("key", "text").mapInArrow(run, "key binary, h long, first int, last int")


def cut(texts: DataFrame, length: int) -> DataFrame:
    """h, id (of the bytes), size and bytes (of two runs of an id a task; else 0 and null), key, first of each marked run of texts (key, text, runs)."""
    schema = pa.schema([("h", pa.int64()), ("id", pa.binary()), ("size", pa.int32()), ("bytes", pa.binary()), ("key", pa.binary()), ("first", pa.int32())])

    @quiet
    def run(batches: Iterator[pa.RecordBatch]):
        seen: dict[bytes, int] = {}

        def rows():
            for batch in batches:
                marks = batch.column(2)
                flat = marks.flatten()
                first, last, h = (flat.field(k).to_pylist() for k in range(3))
                ends = np.cumsum(marks.value_lengths().to_numpy(zero_copy_only=False)).tolist()
                keys, texts_, at = batch.column(0).to_pylist(), batch.column(1), 0
                for k, end in enumerate(ends):
                    text, key = texts_[k].as_py(), keys[k]
                    for a, b, g in zip(first[at:end], last[at:end], h[at:end]):
                        part = text[a : b + length]
                        id_ = hashlib.blake2b(part, digest_size=16).digest()
                        n = seen.get(id_, 0)
                        if n < 2:
                            if len(seen) >= REMEMBERED:
                                seen.clear()
                            seen[id_] = n + 1
                            yield (g, id_, len(part), part, key, a), len(part) + 60
                        else:
                            yield (g, id_, 0, None, key, a), 60
                    at = end

        yield from sized(rows(), schema)

    return texts.select("key", "text", "runs").mapInArrow(run, "h long, id binary, size int, bytes binary, key binary, first int")


def ranges(flags: np.ndarray) -> list[int]:
    """First and last of each run of flags, flat."""
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    edge[1::2] -= 1
    return edge.tolist()


def repeated_in(parts: list[bytes], length: int) -> list[np.ndarray]:
    """Which starts of each part begin a string of that length that begins in another place too."""
    text, starts = laid(parts)
    wanted = np.zeros(len(text), bool)
    for s, p in zip(starts.tolist(), parts):
        wanted[s : s + len(p) - length + 1] = True
    found = Suffixes(text, wanted, length).repeated()
    return [found[s : s + len(p) - length + 1] for s, p in zip(starts.tolist(), parts)]


def lots(rows: Iterable[tuple[int, bytes, bytes]], most: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """Rows (h, id, bytes) in order of h, cut into lists of whole owners; an id comes twice at most."""
    held: list[tuple[bytes, bytes]] = []
    size, now, count = 0, None, {}
    for h, id_, part in rows:
        if h != now:
            if size >= most:
                yield held
                held, size = [], 0
            now, count = h, {}
        count[id_] = count.get(id_, 0) + 1
        if count[id_] <= 2:
            held.append((id_, part))
            size += len(part)
    if held:
        yield held


def sorted_runs(parts: DataFrame, length: int) -> DataFrame:
    """id and repeated starts (first and last of each range, flat) of runs (h, id, bytes), by suffix arrays."""
    schema = pa.schema([("id", pa.binary()), ("starts", pa.list_(pa.int32()))])

    @quiet
    def run(batches: Iterator[pa.RecordBatch]):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))

        def found():
            for lot in lots(rows, LOT_BYTES):
                told = set()
                for (id_, _), flags in zip(lot, repeated_in([p for _, p in lot], length)):
                    if id_ not in told and flags.any():
                        told.add(id_)  # equal bytes, equal flags
                        yield (id_, spans := ranges(flags)), 8 * len(spans) + 40

        yield from sized(found(), schema)

    return parts.select("h", "id", "bytes").mapInArrow(run, "id binary, starts array<int>")


def grouped_runs(parts: DataFrame, length: int) -> DataFrame:
    """The same of runs whose owner has too many bytes for one task: digests of their strings, grouped by Spark."""
    schema = pa.schema([("id", pa.binary()), ("at", pa.int32()), ("digest", pa.binary())])

    @quiet
    def run(batches: Iterator[pa.RecordBatch]):
        def strings():
            for batch in batches:
                for id_, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for a in range(len(part) - length + 1):
                        yield (id_, a, hashlib.blake2b(part[a : a + length], digest_size=16).digest()), 48

        yield from sized(strings(), schema)

    each = parts.select("id", "bytes").mapInArrow(run, "id binary, at int, digest binary")
    often = each.groupBy("digest").count().filter("count > 1").select("digest")
    return each.join(often, "digest", "left_semi").groupBy("id").agg(F.flatten(F.collect_set(F.array("at", "at"))).alias("starts"))


def heavy(rows: DataFrame, key: str) -> DataFrame:
    """Keys of more than a ``HEAVY_SHARE``-th of the rows; so many at most."""
    return rows.groupBy(key).count().filter(F.col("count") > max(1, rows.count() // HEAVY_SHARE)).select(key)


def matched(rows: DataFrame, keyed: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join of rows with keyed, which has a row a key; hot keys (a bounded number) by broadcast."""
    few = F.broadcast(keyed.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(keyed, key))


def spans_of(texts: DataFrame, length: int) -> DataFrame:
    """key, spans, kept_sha256 of texts (key, text, starts: first and last of ranges of repeated starts)."""
    schema = pa.schema([("key", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept_sha256", pa.string())])

    @quiet
    def run(batches: Iterator[pa.RecordBatch]):
        def rows():
            for batch in batches:
                keys, starts = batch.column(0).to_pylist(), batch.column(2)
                for k, key in enumerate(keys):
                    text, pairs = batch.column(1)[k].as_py(), starts[k].as_py()
                    spans: list[list[int]] = []
                    for a, b in sorted(zip(pairs[::2], pairs[1::2])):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b + length)
                        else:
                            spans.append([a, b + length])
                    digest, at = hashlib.sha256(), 0
                    for a, b in spans:
                        digest.update(text[at:a])
                        at = b
                    digest.update(text[at:])
                    yield (key, spans, digest.hexdigest()), 200 + 16 * len(spans)

        yield from sized(rows(), schema)

    return texts.select("key", "text", "starts").mapInArrow(run, "key binary, spans array<array<long>>, kept_sha256 string")


def repeats(docs: DataFrame, *, length: int = 400, piece: int | None = None, wide_bytes: int = WIDE_BYTES) -> DataFrame:
    """The repeated bytes of documents (doc_id, text).

    Returns doc_id, n_bytes, spans (array of [start, end) in bytes, in order, apart from each other) and kept_sha256 (hex, of the bytes outside them).
    """
    spark = docs.sparkSession
    narrow(spark)
    piece = piece or max(1, min(64, length // 4))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    base = base.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    base = base.withColumn("key", F.unhex(F.substring("sha256", 1, 32)))
    rows, _ = written(base.drop("text"), "repeat-rows")
    long = base.filter(F.col("n_bytes") >= length)

    runs, runs_path = written(anchors(long, length, piece), "repeat-runs")
    place = F.xxhash64("key", "first")
    shared, shared_path = written(runs.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("h", "n"), "repeat-owners")
    hot = shared.filter(F.col("n") > max(1, runs.count() // HEAVY_SHARE)).select("h")
    marks = matched(runs, shared.select("h"), "h", hot).groupBy("key").agg(F.collect_set(F.struct("first", "last", "h")).alias("runs"))
    one = long.groupBy("key").agg(F.first("text").alias("text"))  # of a text's copies one a task travels
    texts, texts_path = written(one.join(marks, "key").select("key", "text", "runs"), "repeat-texts")
    dropped(spark, runs_path, shared_path)
    del runs, shared, hot, marks, one
    released(spark)

    parts, parts_path = written(cut(texts, length), "repeat-parts")
    sent = parts.filter(F.col("size") > 0)
    owners = sent.groupBy("h", "id").agg(F.max("size").alias("size")).groupBy("h").agg(F.sum("size").alias("size"))
    total, widest = owners.agg(F.sum("size"), F.max("size")).first()
    of = lambda some: some.select("h", "id", "bytes").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total or 0) // LOT_BYTES), "h").sortWithinPartitions("h")
    if (widest or 0) <= wide_bytes:
        found = sorted_runs(of(sent), length)
    else:
        wide = owners.filter(F.col("size") > wide_bytes).select("h")
        if wide.count() <= 100_000:
            wide = F.broadcast(wide)
        found = sorted_runs(of(sent.join(wide, "h", "left_anti")), length).unionByName(grouped_runs(sent.join(wide, "h", "left_semi").dropDuplicates(["key", "first"]), length))
    found, found_path = written(found, "repeat-starts")
    released(spark)

    uses = parts.select("id", "key", "first")
    shifted = F.transform("starts", lambda s: s + F.col("first"))
    starts = matched(uses, found, "id", heavy(uses, "id")).select("key", shifted.alias("starts")).groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    copies = rows.filter(F.col("n_bytes") >= length).groupBy("key").count().filter("count > 1")
    single = starts.join(copies, "key", "left_anti")
    cuts, _ = written(spans_of(texts.select("key", "text").join(single, "key"), length), "repeat-spans")
    dropped(spark, texts_path, parts_path, found_path)
    released(spark)

    nothing, whole = F.array().cast("array<array<long>>"), F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))
    short, rest = rows.filter(F.col("n_bytes") < length), rows.filter(F.col("n_bytes") >= length)
    kept = F.lit(hashlib.sha256().hexdigest())
    most = heavy(rest, "key")
    copied = rest.join(F.broadcast(most), "key").select("doc_id", "n_bytes", whole.alias("spans"), kept.alias("kept_sha256"))
    other = rest.join(F.broadcast(most), "key", "left_anti").join(copies.select("key", F.lit(True).alias("copied")), "key", "left").join(cuts, "key", "left")
    return (
        short.select("doc_id", "n_bytes", nothing.alias("spans"), F.col("sha256").alias("kept_sha256"))
        .unionByName(copied)
        .unionByName(other.select("doc_id", "n_bytes", F.when(F.col("copied"), whole).otherwise(F.coalesce("spans", nothing)).alias("spans"), F.when(F.col("copied"), kept).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256")))
    )
