"""Sharding by histogram sort, with DataFrame functions alone.

Rows are ordered by a 64-bit key: the high bits are a hash of the text, so equal texts lie side by
side, the low bits a hash of the id, so a group of equal texts can be cut anywhere. Exact bytes
below candidate boundaries are counted over all partitions; the cells between two candidates that
hold a shard boundary, or more rows than one task should number, are probed again with finer
boundaries until every splitter is within tolerance. Then the rows are exchanged once, by cell, and
numbered inside their cell; a cell's first slot is known from the counts.

The driver sees counts of cells alone: at most ``2**bits`` for each cell probed again, of which
there are at most as many as shards and as total rows / ``cell_rows``.

Defined cases: a null text counts as empty (size 1, crc32 0); null ids sort first; repeated rows
each get a slot; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Key bits taken from the text's hash; the rest come from the id's.
TEXT_BITS = 40
KEY_BITS = 62


@dataclass(frozen=True)
class Cell:
    """Rows whose key's first ``bits`` bits are ``prefix``."""

    bits: int
    prefix: int
    size: int
    rows: int

    @property
    def first(self) -> int:
        return self.prefix << (KEY_BITS - self.bits)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = KEY_BITS - TEXT_BITS
    high = F.shiftrightunsigned(F.xxhash64(text), 64 - TEXT_BITS)
    key = F.shiftleft(high, low).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.lit(17), F.col("doc_id")), 64 - low))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"))


def prefix(bits: int) -> Column:
    return F.shiftright("key", KEY_BITS - bits)


def counted(rows: DataFrame, bits: int, within: list[Cell]) -> list[Cell]:
    """Exact bytes and rows of every cell of so many bits, in the given coarser cells (or all)."""
    if within:
        rows = rows.filter(prefix(within[0].bits).isin([c.prefix for c in within]))
    got = rows.groupBy(prefix(bits).alias("p")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return [Cell(bits, r.p, r.b, r.n) for r in got]


def cells(rows: DataFrame, shards: int, bits: int, tolerance: float, cell_rows: int) -> list[Cell]:
    """Cells in key order, fine enough that a shard boundary between two of them is within tolerance."""
    found = sorted(counted(rows, bits, []), key=lambda c: c.first)
    total = sum(c.size for c in found)
    while True:
        wide = unmet(found, total, shards, tolerance, cell_rows)
        if not wide:
            return found
        for level in sorted({c.bits for c in wide}):
            part = [c for c in wide if c.bits == level]
            finer = counted(rows, min(KEY_BITS, level + bits), part)
            gone = set(part)
            found = sorted([c for c in found if c not in gone] + finer, key=lambda c: c.first)


def unmet(found: list[Cell], total: int, shards: int, tolerance: float, cell_rows: int) -> list[Cell]:
    wide, at = [], 0
    for c in found:
        before, at = at, at + c.size
        crossed = before * shards // total != (at - 1) * shards // total
        if c.bits < KEY_BITS and c.rows > 1 and (c.rows > cell_rows or crossed and c.size > tolerance * total / shards):
            wide.append(c)
    return wide


def shard(docs: DataFrame, *, shards: int = 16, bits: int = 8, tolerance: float = 0.001, cell_rows: int | None = None) -> DataFrame:
    """Put documents (doc_id, text) into shards of near equal bytes.

    Returns doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard). A shard's bytes
    differ from an equal share by at most ``tolerance`` of it and two rows.
    """
    rows, _ = written(keyed(docs), "shard-keys")
    if cell_rows is None:
        cell_rows = max(512, rows.count() // 2048)
    found = cells(rows, shards, bits, tolerance, cell_rows)
    total, at, table, slots = sum(c.size for c in found), 0, [], [0] * shards
    for c in found:
        k = min(shards - 1, (at + c.size // 2) * shards // total)  # the nearer side of a boundary inside the cell
        table.append((c.bits, c.prefix, k, slots[k]))
        at, slots[k] = at + c.size, slots[k] + c.rows
    spark, out = docs.sparkSession, None
    levels = sorted({t[0] for t in table}) or [bits]
    for level in levels:  # a row's cell is the one of the few levels that has its prefix
        # the table's size is bounded by the counts above, whatever the input
        of = F.broadcast(spark.createDataFrame([t[1:] for t in table if t[0] == level] or [], "prefix long, shard int, first long"))
        part = rows.withColumn("prefix", prefix(level)).join(of, "prefix").withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
    inside = Window.partitionBy("level", "prefix").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.row_number().over(inside) - 1).alias("slot"))
