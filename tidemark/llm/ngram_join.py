"""N-gram Jaccard join: near-duplicate components of documents by exact similarity of shingle sets.

1. Sets. One pass over the texts gives each document its set of hashed shingles. Documents with
   equal sets form a class (number of shingles and a 64-bit digest of the set); the rest works on
   classes, so groups of exact copies cost one row per task.
2. Cells. Sets of similar size share a size range; within a range two sets that reach the threshold
   differ in at most D elements, so of any D + 1 slices of the hash space at least one is equal in
   both. The space is cut into about D / 5 slices more than that, so that thin slices can be left out
   (one shared passage could fill them): a set whose other slices are D + 1 or more uses those alone,
   another one uses all that are not empty, and if these are too few, one cell more, for such sets of
   its range. Each slice's content is a cell key: no pair above the threshold is lost. A set has cells
   in its own size range and the next; a cell counts if a set of the range itself is in it.
3. Signature trees. The classes of a group go to blocks of bounded size, and a tree is built over each
   block: a node holds the OR (and the AND) of the token bitmaps below it and their size range. Two trees
   (or one with itself) are traversed together; a pair of nodes is dropped when the largest overlap that
   bitmaps and sizes allow is below the threshold. Groups of several blocks: see ``linked``.
   First the groups are cells, and pairs that bitmaps allow make candidate clusters: in each cell all
   classes are tried with its first one, and trees are built where that leaves several components.
   Then the groups are clusters, and surviving pairs of sets are compared exactly, best bound first.
   Either time a pair is skipped if pairs found before already connect it, so only edges that join
   components are emitted, never all pairs of a group.
4. Components of these links give each class its smallest doc_id.

Shingles and sets are told apart by 64-bit hashes.

Defined cases: a null or wordless text has no shingles and is linked with nothing; fewer words than
a shingle's width make one shingle; a null doc_id takes part only through documents of an equal set,
and its component_id is null if there are none; repeated rows each get a row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, narrow, quiet, raw, released, sized, written
from .graph import components

SPARE = 3
#: Sets of a block: a bound on their number and on their shingles. Where only bitmaps meet: on their number.
BLOCK_SETS, BLOCK_SHINGLES, BLOCK_MARKS = 1024, 4_000_000, 4096
#: Ids up to which the wanted documents are sent to all executors instead of exchanging all texts.
SEND_IDS = 1_000_000
CACHE_WORDS = 400_000
BITS, MOST_BITS, FAN = 2048, 1 << 17, 16
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * M2
    x ^= x >> np.uint64(27)
    x *= M3
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingles(text: bytes | None, width: int, words: WordHash) -> np.ndarray:
    """The distinct shingles' hashes in order. Words are cut at ASCII white space, with A-Z in lower case."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(width, len(h))), np.uint64)
    for k in range(min(width, len(h))):
        out = mixed(out * M1 + h[k : k + n])
    return np.unique(out)


def digest(s: np.ndarray) -> int:
    return int(mixed(mixed(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0].view(np.int64))


class Ranges:
    """Size ranges: each begins where the one before, stretched by 1 / threshold, ends."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.ends = num, den, [1]

    def of(self, n: int) -> int:
        while self.ends[-1] < n:
            self.ends.append(max(self.ends[-1] + 1, (self.ends[-1] + 1) * self.den // self.num))
        return int(np.searchsorted(self.ends, n))

    def apart(self, k: int) -> int:
        """Elements in which two sets of ranges k - 1 and k differ at most."""
        while k >= len(self.ends):
            self.of(self.ends[-1] + 1)
        return 2 * self.ends[k] * (self.den - self.num) // (self.den + self.num)


@lru_cache(maxsize=4096)
def slices(k: int) -> np.ndarray:
    return np.array([-(-(j << 64) // k) for j in range(1, k)], dtype=np.uint64)


@lru_cache(maxsize=4096)
def thin(mean: float) -> int:
    """Elements up to which a slice is too thin to tell sets apart: few slices of this mean have so few."""
    c, term = 0, math.exp(-mean)
    below = term
    while c < 8:
        term *= mean / (c + 1)
        if below + term > 0.08:
            return c
        below, c = below + term, c + 1
    return c


def cell_keys(s: np.ndarray, ranges: Ranges) -> np.ndarray:
    """Keys of all cells of a set, in its own size range (lowest bit 1) and the next (lowest bit 0)."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(s + M1), out=sums[1:])
    out, own = [], ranges.of(n)
    for tag in (own, own + 1):
        apart = ranges.apart(tag)
        if not apart:
            continue  # only equal sets are similar here
        k = apart + 1 + max(SPARE, (apart + 1) // 5)
        at = np.zeros(k + 1, np.int64)
        at[1:-1] = np.searchsorted(s, slices(k))
        at[-1] = n
        count = np.diff(at)
        full = np.flatnonzero(count > thin(round(ranges.ends[tag - 1] / k, 2) if tag else 0.0))
        if len(full) <= apart:
            full = np.flatnonzero(count)
        key = mixed(sums[at[full + 1]] - sums[at[full]] + count[full].astype(np.uint64) * M2)
        keys = [mixed(key + full.astype(np.uint64) * M1 + np.array([tag], np.uint64) * M3)]
        if len(full) <= apart:
            keys.append(mixed(np.array([tag], np.uint64) * M1 + np.uint64(1)))
        out.append(np.concatenate(keys) & ~np.uint64(1) | np.uint64(tag == own))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def bits_of(n: int) -> int:
    """Bits of the bitmap of a set of n: a power of two, four for each element, within bounds."""
    return min(MOST_BITS, max(BITS, 1 << (4 * n - 1).bit_length()))


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, np.uint8)
    out[(s >> np.uint64(17)) & np.uint64(bits - 1)] = 1
    return np.packbits(out).view(np.uint64)


def folded(marks: list[bytes], size: int | None = None) -> np.ndarray:
    """Bitmaps as rows, all folded to the narrowest one's width (or to ``size`` bytes): the bitmap of fewer bits."""
    size = size or min(map(len, marks))
    rows = []
    for mark in marks:
        x = np.frombuffer(mark, np.uint64)
        while x.nbytes > size:
            x = x[: len(x) // 2] | x[len(x) // 2 :]
        rows.append(x)
    return np.array(rows).reshape(len(marks), -1)


class Tree:
    """Levels of nodes from the sets up to the root; a node stands over FAN nodes below it."""

    def __init__(self, low: np.ndarray, size: np.ndarray):
        self.levels = [(low, low, size, size)]
        while len(self.levels[-1][0]) > 1:
            some, every, least, most = self.levels[-1]
            at = np.arange(0, len(some), FAN)
            self.levels.append((np.bitwise_or.reduceat(some, at), np.bitwise_and.reduceat(every, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))


    @classmethod
    def of(cls, sets: list[np.ndarray], bits: int) -> Tree:
        return cls(np.array([bitmap(s, bits) for s in sets]).reshape(len(sets), bits // 64), np.array([len(s) for s in sets]))


def possible(a, i: np.ndarray, b, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of node pairs: the largest overlap that any pair of sets below them may have, and whether it may reach the threshold."""
    some_a, every_a, least_a, most_a = (x[i] for x in a)
    some_b, every_b, least_b, most_b = (x[j] for x in b)
    left = most_a - np.bitwise_count(every_a & ~some_b).sum(axis=1, dtype=np.int64)
    right = most_b - np.bitwise_count(every_b & ~some_a).sum(axis=1, dtype=np.int64)
    overlap = np.minimum(left, right)
    # overlap / (|a| + |b| - overlap) >= num / den for the smallest sizes there are
    fits = (overlap * (num + den) >= num * (least_a + least_b)) & (most_a * den >= num * least_b) & (most_b * den >= num * least_a)
    return overlap, fits


def traverse(a: Tree, b: Tree, same: bool, num: int, den: int, chunk: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of sets (and bounds of their overlaps) that no pair of nodes above them rules out."""
    top = max(len(a.levels), len(b.levels)) - 1
    todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, i, j = todo.pop()
        if len(i) > chunk:
            todo += [(level, i[k : k + chunk], j[k : k + chunk]) for k in range(0, len(i), chunk)]
            continue
        la, lb = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
        overlap, fits = possible(a.levels[la], i, b.levels[lb], j, num, den)
        if same:
            fits &= i <= j if level else i < j
        i, j, overlap = i[fits], j[fits], overlap[fits]
        if not len(i):
            continue
        if not level:
            yield i, j, overlap
            continue
        i, wide_a = below(i, la == level, len(a.levels[la - 1][0]) if la == level else 0)
        j, wide_b = below(j, lb == level, len(b.levels[lb - 1][0]) if lb == level else 0)
        pair = np.repeat(i, wide_b.shape[0], axis=1), np.tile(j, (1, wide_a.shape[0]))
        ok = (pair[0] >= 0) & (pair[1] >= 0)
        todo.append((level - 1, pair[0][ok], pair[1][ok]))


def below(i: np.ndarray, down: bool, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes, one row for each (-1: none)."""
    if not down:
        return i[:, None], np.arange(1)
    out = i[:, None] * FAN + np.arange(FAN)
    out[out >= n] = -1
    return out, np.arange(FAN)


class Union:
    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.find(x), self.find(y)
        self.root[x] = y
        return x != y


Set = tuple[int, int, np.ndarray]  # node, component so far, shingles
Mark = tuple[int, int, int, bytes]  # digest, component so far, elements, bitmap


def joined(left: list, right: list) -> Union:
    """Components of the members of both sides as far as they are known."""
    union, first = Union(len(left) + len(right)), {}
    for k, member in enumerate(left + right):
        union.join(k, first.setdefault(member[1], k))
    return union


def links(left: list[Set], right: list[Set] | None, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links (of nodes) that join components: among left, or between left and right."""
    order = lambda x: (int(x[2][0]), len(x[2]))
    left = sorted(left, key=order)
    same = right is None
    right = left if same else sorted(right, key=order)
    if not left or not right:
        return
    sets_a, sets_b = [s for *_, s in left], [s for *_, s in right]
    bits = bits_of(max(len(x) for x in sets_a + sets_b))
    tree, over, union = Tree.of(sets_a, bits), 0 if same else len(left), joined(left, [] if same else right)
    for i, j, bound in traverse(tree, tree if same else Tree.of(sets_b, bits), same, num, den):
        for k in np.argsort(-bound, kind="stable").tolist():
            p, q = int(i[k]), int(j[k])
            if union.find(p) == union.find(over + q):
                continue
            shared = len(np.intersect1d(sets_a[p], sets_b[q], assume_unique=True))
            if shared * (num + den) >= num * (len(sets_a[p]) + len(sets_b[q])):
                union.join(p, over + q)
                yield left[p][0], right[q][0]


def bridges(left: list[Mark], right: list[Mark] | None, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs whose bitmaps allow the threshold, as far as they join components of such pairs."""
    same = right is None
    right = left if same else right
    if not left or not right:
        return
    size = min(len(m[3]) for m in (*left, *right))
    trees = [Tree(folded([m[3] for m in side], size), np.array([m[2] for m in side])) for side in ((left,) if same else (left, right))]
    over, union = 0 if same else len(left), joined(left, [] if same else right)
    for i, j, _ in traverse(trees[0], trees[-1], same, num, den):
        for p, q in zip(i.tolist(), j.tolist()):
            if union.join(p, over + q):
                yield left[p][0], right[q][0]


def base(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def keyed(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, n, digest, and (only for the first document of a class in a task) keys and bitmap."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.int64()), ("keys", pa.list_(pa.int64())), ("bitmap", pa.binary())])

    @quiet
    def run(batches):
        words, ranges, seen = WordHash(), Ranges(num, den), set()

        def rows():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), raw(batch, "text")):
                    s = shingles(text, width, words)
                    d = digest(s)
                    new = doc is not None and d not in seen
                    keys = cell_keys(s, ranges) if new else ()
                    if len(seen) < CACHE_WORDS and doc is not None:
                        seen.add(d)
                    yield (doc, len(s), d, keys, bitmap(s, bits_of(len(s))).tobytes() if len(keys) else None), 8 * len(keys) + bits_of(len(s)) // 8

        yield from sized(rows(), schema)

    return base(docs).mapInArrow(run, "doc_id long, n long, digest long, keys array<long>, bitmap binary")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The wanted (cluster, digest, doc_id, blocks) as members of their clusters, with shingles (as bytes)."""
    schema = pa.schema([("cluster", pa.int64()), ("digest", pa.int64()), ("node", pa.int64()), ("part", pa.int64()), ("blocks", pa.int32()), ("shingles", pa.binary())])

    @quiet
    def run(batches):
        words = WordHash()

        def rows():
            for batch in batches:
                ids, texts, *rest = batch.column(0).to_pylist(), raw(batch, "text"), *(batch.column(k).to_pylist() for k in (2, 3, 4))
                for doc, text, cluster, d, blocks in zip(ids, texts, *rest):
                    s = shingles(text, width, words)
                    if digest(s) == d:
                        yield (cluster, d, doc, doc, blocks, s.tobytes()), 8 * len(s)

        yield from sized(rows(), schema)

    return base(docs).join(wanted, "doc_id").select("doc_id", "text", "cluster", "digest", "blocks").mapInArrow(run, "cluster long, digest long, node long, part long, blocks int, shingles binary")


def grouped(rows: DataFrame, keys: list[str], work, schema: pa.Schema, ddl: str) -> DataFrame:
    """``work`` over the rows of each group, one group at a time; a task streams through its sorted groups."""
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys)

    @quiet
    def run(batches):

        def groups():
            now, held = None, []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if row[: len(keys)] != now:
                        if held:
                            yield now, held
                        now, held = row[: len(keys)], []
                    held.append(row[len(keys) :])
            if held:
                yield now, held

        yield from sized(((out, 16) for key, held in groups() for out in work(key, held)), schema)

    return ordered.mapInArrow(run, ddl)


EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def dealt(rows: DataFrame, salt: int = 0) -> DataFrame:
    """Rows with the block of their group that they belong to."""
    return rows.withColumn("block", F.pmod(F.xxhash64(F.lit(salt), "node"), F.col("blocks")).cast("int"))


def once(held: list[tuple], make) -> list:
    """The members among a group's rows (side, digest, node, part, ...), each class once."""
    return [make(row) for row in {row[1]: row for row in held}.values()]


def inside(rows: DataFrame, group: str, columns: list[str], work, make) -> DataFrame:
    """Links (u, v) among the members of each block."""

    def run(_, held):
        return work(once(held, make), None) if len(held) > 1 else ()

    return grouped(rows.select(group, "block", F.lit(0).alias("side"), "digest", "node", "part", *columns), [group, "block"], run, EDGE, "u long, v long")


def across(left: DataFrame, right: DataFrame, group: str, columns: list[str], work, make) -> DataFrame:
    """Links (u, v) between members of left and right (group, i, j, ...) of the same group, i and j."""
    rows = [side.select(group, "i", "j", F.lit(k).alias("side"), "digest", "node", "part", *columns) for k, side in enumerate((left, right))]

    def run(_, held):
        sides = [once([row for row in held if row[0] == k], make) for k in (0, 1)]
        return work(*sides) if all(sides) else ()

    return grouped(rows[0].unionByName(rows[1]), [group, "i", "j"], run, EDGE, "u long, v long")


def linked(rows: DataFrame, wide: DataFrame | None, known: DataFrame | None, group: str, columns: list[str], work, make, name: str, most: int) -> tuple[DataFrame, list[str]]:
    """Links that join the components of each group's members, and tables to drop.

    rows: group, digest, node, part (component so far), blocks, columns; wide: those of groups of more
    than one block, if there are any; known: links known before. Members meet in their block first. In
    wide groups then one member of each component of a block stands for it; these meet in blocks, and so
    on until a group's are one block. What is in the group's largest component by then is done: only
    members outside it meet the group's other blocks. So a wide group that hangs together costs its size
    and not its square, and no pair of two components is left out."""
    spark = rows.sparkSession
    found, path = written(inside(dealt(rows), group, columns, work, make), name)
    paths = [path]
    if wide is None:
        return found, paths
    wide, path = written(dealt(wide), f"{name}-wide")
    paths.append(path)
    level, salt, before = wide, 0, None
    while True:
        salt += 1
        parts, path = components(found.unionByName(known) if known is not None else found, f"{name}-parts")
        chosen, chosen_path = written(with_part(level, parts).groupBy(group, "block", "part").agg(F.min("node").alias("node")), f"{name}-chosen")
        blocks = chosen.groupBy(group).agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
        widest, count = blocks.agg(F.max("blocks")).first()[0] or 1, chosen.count()
        members = wide.drop("blocks", "block").join(chosen.select(group, "node").distinct(), [group, "node"]).join(blocks, group)
        more, more_path = written(inside(dealt(with_part(members, parts), salt), group, columns, work, make), name)
        found = found.unionByName(more)
        paths.append(more_path)
        last, before = widest == 1 or count == before, count
        if not last:
            level = dealt(wide.drop("blocks", "block").join(chosen.select(group, "node").distinct(), [group, "node"]).join(blocks, group), salt)
            level, level_path = written(level, f"{name}-level")
            paths.append(level_path)
        dropped(spark, path, chosen_path)
        if last:
            break
    parts, path = components(found.unionByName(known) if known is not None else found, f"{name}-parts")
    tagged, tagged_path = written(with_part(wide, parts), f"{name}-tagged")
    sizes = tagged.groupBy(group, "part").agg(F.count("*").alias("n")).groupBy(group).agg(F.max_by("part", F.struct("n", "part")).alias("largest"))
    outside = tagged.join(sizes, group).filter("part <> largest").drop("largest")
    strays = outside.groupBy(group).agg(F.ceil(F.count("*") / most).cast("int").alias("strays"))
    left = outside.join(strays, group).withColumn("i", F.pmod(F.xxhash64(F.lit(-1), "node"), F.col("strays")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = tagged.join(strays, group).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("strays") - 1))).withColumn("j", F.col("block"))
    more, more_path = written(across(left, right, group, columns, work, make), name)
    dropped(spark, path, tagged_path)
    return found.unionByName(more), [*paths, more_path]


def with_part(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows with ``part`` as it is now: the component of their node among parts (u, v), else what it was."""
    return rows.join(parts.toDF("node", "now"), "node", "left").withColumn("part", F.coalesce("now", "part")).drop("now")


def allowed(edges: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """The edges (u, v) whose sets' bitmaps allow the threshold; marks: digest, n, bitmap."""
    both = edges.join(marks.toDF("u", "nu", "bu"), "u").join(marks.toDF("v", "nv", "bv"), "v").select("u", "v", "nu", "bu", "nv", "bv")

    def run(batches):
        for batch in batches:
            bu, nu, bv, nv = (batch.column(k).to_pylist() for k in (3, 2, 5, 4))
            for size in {min(len(x), len(y)) for x, y in zip(bu, bv)}:
                at = [k for k in range(len(bu)) if min(len(bu[k]), len(bv[k])) == size]
                sides = [(m, m, n, n) for m, n in ((folded([b[k] for k in at], size), np.array([n[k] for k in at])) for b, n in ((bu, nu), (bv, nv)))]
                one = np.arange(len(at))
                _, fits = possible(sides[0], one, sides[1], one, num, den)
                yield batch.select([0, 1]).take(pa.array(np.array(at)[fits], pa.int64()))

    return both.mapInArrow(run, "u long, v long")


def clustered(cells: DataFrame, marks: DataFrame, num: int, den: int) -> tuple[DataFrame, list[str]]:
    """Candidate clusters (u, v: smallest digest) of cells (cell, digest, first), and tables to drop.

    Clusters are the components of pairs that share a cell and whose bitmaps allow the threshold. In a
    first step only the pairs with a cell's first member are looked at. Most cells then lie in one
    component; in the others, trees of bitmaps find the pairs that join components."""
    stars, stars_path = components(allowed(cells.filter("digest <> first").select(F.col("digest").alias("u"), F.col("first").alias("v")).distinct(), marks, num, den), "join-stars")
    tagged = cells.join(stars.toDF("digest", "v"), "digest", "left").select("cell", "digest", F.coalesce("v", "digest").alias("part"))
    open_ = tagged.groupBy("cell").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count("*").alias("k")).filter("a <> b AND k > 2").select("cell")
    # a class has a row of a cell for each task that met it; those copies must neither count nor cancel out
    rows = tagged.join(open_, "cell").groupBy("cell", "digest").agg(F.first("part").alias("part"))
    same = ("k", "c", "d", "members", "again")
    kept = rows.groupBy("cell").agg(F.count("*").alias("k"), F.min("digest").alias("c"), F.max("digest").alias("d"), F.bit_xor(F.xxhash64("digest")).alias("members"), F.bit_xor(F.xxhash64(F.lit(7), "digest")).alias("again"))
    # cells of two classes are settled; of cells with the same members one is enough
    kept = kept.filter("k > 2").groupBy(*same).agg(F.min("cell").alias("cell")).select("cell", F.ceil(F.col("k") / BLOCK_MARKS).cast("int").alias("blocks"))
    kept, kept_path = written(kept, "join-open")
    rows = rows.join(kept, "cell").join(marks, "digest").withColumn("node", F.col("digest"))
    wide = rows.filter("blocks > 1") if kept.filter("blocks > 1").limit(1).count() else None
    more, paths = linked(rows, wide, stars, "cell", ["n", "bitmap"], partial(threshold, bridges, num, den), itemgetter(2, 3, 4, 5), "join-bridges", BLOCK_MARKS)
    out, path = components(stars.unionByName(more), "join-clusters")
    dropped(cells.sparkSession, kept_path, *paths)
    return out, [stars_path, path]


def threshold(work, num: int, den: int, left: list, right: list | None) -> Iterator[tuple[int, int]]:
    return work(left, right, num, den)


def as_set(row: tuple) -> Set:
    return row[2], row[3], np.frombuffer(row[4], np.uint64)


def near_duplicates(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; num / den is the least similarity of a link."""
    spark = docs.sparkSession
    narrow(spark)
    found_keys, keys_path = written(keyed(docs, width, num, den), "join-keys")
    keys = found_keys.select("digest", F.explode("keys").alias("key")).select("digest", F.shiftright("key", 1).alias("cell"), (F.col("key").bitwiseAND(F.lit(1)) == 1).alias("own"))
    w = Window.partitionBy("cell")
    shared = keys.withColumns({"first": F.min(F.when(F.col("own"), F.col("digest"))).over(w), "least": F.min("digest").over(w), "most": F.max("digest").over(w)})
    cells, cells_path = written(shared.filter("first IS NOT NULL AND least <> most").select("cell", "digest", "first"), "join-cells")
    marks, marks_path = written(found_keys.filter("bitmap IS NOT NULL").groupBy("digest").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap")), "join-marks")
    rows, _ = written(found_keys.select("doc_id", "n", "digest"), "join-sets")
    dropped(spark, keys_path)
    del found_keys, keys, shared
    released(spark)
    clusters, paths = clustered(cells, marks, num, den)
    members = clusters.select(F.col("u").alias("digest"), F.col("v").alias("cluster")).unionByName(clusters.select(F.col("v").alias("digest"), F.col("v").alias("cluster")).distinct())
    classes = rows.groupBy("n", "digest").agg(F.min("doc_id").alias("first"))
    chosen = members.join(classes, "digest").filter("first is not null")
    size = chosen.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    wanted, wanted_path = written(chosen.join(size, "cluster").select(F.col("first").alias("doc_id"), "cluster", "digest", "blocks"), "join-wanted")
    dropped(spark, cells_path, marks_path)
    released(spark)
    few = wanted.count() <= SEND_IDS
    some = wanted.filter("blocks > 1")
    sets, wide = (sets_of(docs, F.broadcast(x) if few else x, width) if x is not None else None for x in (wanted, some if some.limit(1).count() else None))
    edges, edge_paths = linked(sets, wide, None, "cluster", ["shingles"], partial(threshold, links, num, den), as_set, "join-edges", BLOCK_SETS)
    found, _ = components(edges, "join-links")
    dropped(spark, *paths, *edge_paths, wanted_path)
    label = classes.join(found.select(F.col("u").alias("first"), F.col("v").alias("component")), "first", "left").select("n", "digest", F.coalesce("component", "first").alias("component_id"))
    # a table of its own, so that Spark sees a plain join of two exchanges and can split a class of very many copies
    label, _ = written(label, "join-labels")
    out = rows.select("doc_id", "n", "digest").join(label, ["n", "digest"])
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents (all their columns) but those that are linked to one of smaller doc_id, directly or not.

    Rows with a null doc_id stay; of rows that repeat a doc_id one stays."""
    spark = docs.sparkSession
    found, path = written(near_duplicates(docs, width=width, num=num, den=den).select("doc_id", "component_id"), "join-found")
    gone, _ = written(found.filter("doc_id <> component_id").select("doc_id").distinct(), "join-gone")
    again = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    dropped(spark, path)
    out = docs.join(F.broadcast(gone) if gone.count() <= SEND_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
    return out.filter("doc_id is null").unionByName(out.filter("doc_id is not null").dropDuplicates(["doc_id"])) if again else out
