"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every three neighbouring bytes (the text stands between two marks of two bytes, so short texts have
triplets too) are hashed into 128 buckets. Each bucket's count is coded by the quartile of all
counts it falls in (two bits), after a byte for the logarithm of the length. Two digests differ by
the sum of their buckets' distances (0, 1, 2, and 6 for opposite quartiles) and of their length
codes' distance (at most 12), bounded by what independent digests have on average (``FAR``);
likeness is 1 minus the difference over that bound.

``next_edits`` needs each document's successor. Documents are dealt by ranges of doc_id (the only
exchange of texts), sorted within partitions and read once with one document held back; the first
and last document of each partition are put aside with the results, and then meet by partition
number. So no task and no driver sees more than a partition, and the driver only partition numbers.

Defined cases: a null text is empty; equal texts have equal fingerprints; rows with equal or null
doc_id are ordered by text (nulls first); a table of one row is its own successor; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, quiet, sized, written

BUCKETS = 128
#: Average difference of independent quartile codes: 1.625 for a bucket.
FAR = 208
FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
STEP = np.array([0, 1, 2, 6])


class Digest:
    __slots__ = ("codes", "length")

    def __init__(self, text: bytes):
        b = np.frombuffer(b"\x00\x01" + text + b"\xfe\xff", np.uint8).astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        count = np.bincount(h >> np.uint32(25), minlength=BUCKETS)
        quartile = np.sort(count)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        self.codes = np.searchsorted(quartile, count)  # 0 where count <= the first, ... 3 above the third
        self.length = min(255, int(math.log(len(text) + 1) / math.log(1.1)))

    def hex(self) -> str:
        c = self.codes.reshape(-1, 4)
        return f"{self.length:02x}" + (c[:, 0] << 6 | c[:, 1] << 4 | c[:, 2] << 2 | c[:, 3]).astype(np.uint8).tobytes().hex()

    def likeness(self, other: Digest) -> float:
        apart = int(STEP[np.abs(self.codes - other.codes)].sum()) + min(12, abs(self.length - other.length))
        return 1 - min(apart, FAR) / FAR


def edited(text: str, following: str) -> str:
    """The last quarter of a text's code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def row(doc, text: str, own: Digest, following: str, theirs: Digest) -> tuple:
    new = edited(text, following).encode("utf-8", "surrogatepass")
    changed = Digest(new)
    return doc, len(text), hashlib.sha256(new).hexdigest(), own.hex(), changed.hex(), own.likeness(changed), own.likeness(theirs)


def of(text: str) -> Digest:
    return Digest(text.encode("utf-8", "surrogatepass"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""
    narrow(docs.sparkSession)
    schema = pa.schema([FIELDS[0], FIELDS[3]])

    def run(batches):
        for batch in batches:
            yield from sized(((((doc, of(t or "").hex())), 80) for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def next_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and likenesses (columns as in ``RESULT``)."""
    spark = docs.sparkSession
    narrow(spark)
    kinds = pa.schema([("kind", pa.string()), ("part", pa.int64()), ("text", pa.string()), *FIELDS])
    nothing = (None,) * (len(FIELDS) - 1)

    @quiet
    def run(batches: Iterator[pa.RecordBatch]):
        part, held = TaskContext.get().partitionId(), None

        def rows():
            nonlocal held
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    text = text or ""
                    own = of(text)
                    if held is None:
                        yield ("head", part, text, doc, *nothing), len(text)
                    else:
                        yield ("row", part, None, *row(*held, text, own)), 300
                    held = doc, text, own
            if held is not None:
                yield ("tail", part, held[1], held[0], *nothing), len(held[1])

        yield from sized(rows(), kinds)

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = base.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found, _ = written(ordered.mapInArrow(run, f"kind string, part long, text string, {RESULT}"), "fingerprints")
    parts = sorted(r.part for r in found.filter(F.col("kind") == "head").select("part").collect())  # one number a partition
    after = F.broadcast(spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, then long"))
    tails = found.filter(F.col("kind") == "tail").select("part", "doc_id", "text").join(after, "part")
    heads = found.filter(F.col("kind") == "head").select(F.col("part").alias("then"), F.col("text").alias("following"))

    def edge(batches):
        schema = pa.schema(FIELDS)
        for batch in batches:
            docs_, texts, following = (batch.column(k).to_pylist() for k in range(3))
            yield from sized(((row(d, t, of(t), f, of(f)), 300) for d, t, f in zip(docs_, texts, following)), schema)

    names = [n for n, _ in FIELDS]
    return found.filter(F.col("kind") == "row").select(*names).unionByName(tails.join(heads, "then").select("doc_id", "text", "following").mapInArrow(edge, RESULT))
