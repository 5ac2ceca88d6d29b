"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

Encoding. A sequence of tokens is what the merges give for its bytes exactly if every two
neighbours are what the merges give for their own bytes. So the encoding of each prefix of a piece
is the encoding of a shorter prefix and one more token, the only one that agrees with its left
neighbour. A nondeterministic transducer follows every prefix that a vocabulary token may still
start from, with its last token; the subset construction makes it deterministic. Its output at each
byte is the last token of the prefix read so far, and a token is settled, and emitted, once it lies
on the paths of all followed prefixes, which start at most the longest token's length before the
byte just read. States and transitions are built when a text first needs them and kept.

Decoding. Token bytes go through an incremental UTF-8 automaton, so text can be handed out in
complete code points at any time, though tokens cut code points.

Defined cases: null text counts as empty and gives no ids; nulls in ids stay as they are; special
tokens do not exist (their strings are ordinary text); repeated rows give equal results; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import OUT_BYTES, kept, narrow, quiet

#: Bounds of a worker's memory: matches in each of two generations (about 200 bytes a match), and their
#: characters and bytes of ids; states and pairs (about 600 and 150 bytes), which are emptied when full and built
#: again as needed. Matches of more than LONG characters are not remembered.
CACHE_WORDS, CACHE_BYTES, CACHE_STATES, CACHE_PAIRS, LONG = 350_000, 48 << 20, 120_000, 400_000, 1024
ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, ids array<int>, decoded binary"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class State(dict):
    """Byte -> (next state, last token of the prefix read so far); filled when first needed."""

    __slots__ = ("live", "machine")

    def __init__(self, live: tuple, machine: Transducer):
        self.live, self.machine = live, machine

    def __missing__(self, byte: int) -> tuple[State, int]:
        got = self[byte] = self.machine.step(self.live, byte)
        return got


class Transducer:
    """Bytes in, ids out. A state is a tuple of (trie node, last token): one for each prefix that a
    vocabulary token may still start from, with the token that ends there, the whole prefix last."""

    #: After every so many bytes the tokens that are settled by then are emitted.
    EMIT = 256

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes = ranks, {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.inner = bytearray(1)
        for word, rank in ranks.items():
            node = 0
            for byte in word:
                self.inner[node] = 1
                key = node << 8 | byte
                got = self.child.get(key)
                if got is None:
                    got = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(0)
                node = got
            self.token[node] = rank
        self.pairs: dict[int, bool] = {}  # two neighbours (the first in the high bits) -> whether they fit
        self.split: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.start = State(((0, -1),), self)
        self.states = {self.start.live: self.start}

    def merged(self, word: bytes, until: int = 1) -> list[int]:
        """The merges as defined: again and again the leftmost pair of lowest rank, until so many are left. For short inputs."""
        parts = [bytes([b]) for b in word]
        while len(parts) > until:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.split:
            word = self.bytes[token]
            self.split[token] = tuple(self.merged(word, 2)) if len(word) > 1 else None
        return self.split[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges of a's and b's bytes together give a and b again.

        The merges inside a and b are undone from the last on; a merge across the border must never
        have been due before the one undone."""
        got = self.pairs.get(a << 32 | b)
        if got is not None:
            return got
        left, right, due, got = a, b, 1 << 40, True
        while True:
            across = self.ranks.get(self.bytes[left] + self.bytes[right])
            if across is not None and across < due:
                got = False
                break
            if left > right and (parts := self.halves(left)):
                left, due = parts[1], left
            elif parts := self.halves(right):
                right, due = parts[0], right + 1
            elif parts := self.halves(left):
                left, due = parts[1], left
            else:
                break
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[a << 32 | b] = got
        return got

    def step(self, live: tuple, byte: int) -> tuple[State, int]:
        to, whole = [], -1
        child, token, inner, pairs = self.child, self.token, self.inner, self.pairs
        for node, last in live:
            got = child.get(node << 8 | byte)
            if got is None:
                continue
            if whole < 0 and (t := token[got]) >= 0:
                fits = last < 0 or pairs.get(last << 32 | t)
                if fits or fits is None and self.fits(last, t):
                    whole = t
            if inner[got]:
                to.append((got, last))
        if whole < 0:
            raise ValueError("the vocabulary lacks a byte")
        to.append((0, whole))
        key = tuple(to)
        if (state := self.states.get(key)) is None:
            if len(self.states) >= CACHE_STATES:
                self.reset()
            state = self.states[key] = State(key, self)
        return state, whole

    def settled(self, lasts: list[int]) -> int:
        """How many bytes end in tokens that no further byte can change: the latest boundary that
        lies on the path of every prefix a token may still start from."""
        size = self.size
        paths = []
        for end in range(max(0, len(lasts) - self.longest), len(lasts) + 1):
            at, path = end, {end}
            while at:
                at -= size[lasts[at - 1]]
                path.add(at)
            paths.append(path)
        return max(set.intersection(*paths))

    def path(self, lasts: list[int], end: int) -> list[int]:
        out, size = [], self.size
        while end:
            token = lasts[end - 1]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        state, lasts, out = self.start, [], []
        push = lasts.append
        for at in range(0, len(piece), self.EMIT):
            if lasts and (end := self.settled(lasts)):
                out += self.path(lasts, end)
                del lasts[:end]
            for byte in piece[at : at + self.EMIT]:
                state, last = state[byte]
                push(last)
        return out + self.path(lasts, len(lasts))


class Pieces(dict):
    """The ids of one match of the pattern as little-endian 32-bit integers, remembered in two generations:
    when the newer one is full it becomes the older one, and what is asked for again comes back."""

    def __init__(self, ranks: str):
        self.encode, self.old = Transducer(load_ranks(ranks)).encode, {}
        self.bytes = 0

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = array("i", self.encode(piece.encode())).tobytes()
        if len(piece) > LONG:
            return got
        self.bytes += len(piece) + len(got)
        if len(self) >= CACHE_WORDS or self.bytes >= CACHE_BYTES:
            self.old = dict(self)
            self.clear()
            self.bytes = len(piece) + len(got)
        self[piece] = got
        return got


class TextIds:
    """The ids of a text: those of each match of the pattern, one after the other."""

    def __init__(self, ranks: str, pattern: str):
        import regex

        self.get, self.find = Pieces(ranks).__getitem__, regex.compile(pattern).findall

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.get, self.find(text)))

    def __call__(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


# The UTF-8 automaton: state 0 is a boundary between code points, 8 is an error; others say what
# byte ranges may follow. Byte classes and transitions follow from the encoding's definition.
def _automaton() -> list[list[int]]:
    error, table = 8, [[8] * 256 for _ in range(9)]
    tail = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0xA0, 0xBF, 1), 4: (0x80, 0x9F, 1), 5: (0x90, 0xBF, 2), 6: (0x80, 0xBF, 2), 7: (0x80, 0x8F, 2)}
    for b in range(256):
        table[0][b] = 0 if b < 0x80 else 1 if 0xC2 <= b <= 0xDF else 3 if b == 0xE0 else 4 if b == 0xED else 2 if 0xE1 <= b <= 0xEF else 5 if b == 0xF0 else 6 if 0xF1 <= b <= 0xF3 else 7 if b == 0xF4 else error
    for state, (low, high, to) in tail.items():
        for b in range(low, high + 1):
            table[state][b] = to
    return table


AUTOMATON = _automaton()


class Decoder:
    """Text of ids that come one after another: ``feed`` gives the complete code points so far."""

    def __init__(self, table: list[bytes]):
        self.table, self.held, self.state = table, b"", 0

    def feed(self, ids: Iterable[int]) -> bytes:
        """Bytes of complete code points. Bytes that are no UTF-8 pass as they are."""
        new = self.held + b"".join(map(self.table.__getitem__, ids))
        # Only the last three bytes can belong to an open code point: find the last boundary there.
        at = max(0, len(new) - 3)
        while at < len(new) and new[at] & 0xC0 == 0x80:
            at += 1
        state, end = 0, at
        for k in range(at, len(new)):
            state = AUTOMATON[state][new[k]]
            if state == 8:
                state, end = 0, k + 1
            elif state == 0:
                end = k + 1
        self.held, self.state = new[end:], state
        return new[:end]

    def finish(self) -> bytes:
        rest, self.held, self.state = self.held, b"", 0
        return rest


def decoded(ids: list[int], table: list[bytes], step: int = 1 << 16) -> bytes:
    decoder = Decoder(table)
    return b"".join(chain((decoder.feed(ids[k : k + step]) for k in range(0, len(ids), step)), (decoder.finish(),)))


def text_ids(ranks: str, pattern: str) -> TextIds:
    """One transducer and its caches for all tasks of a worker process."""
    return kept(__name__, (ranks, pattern), lambda: TextIds(ranks, pattern))


def token_table(ranks: str) -> list[bytes]:
    def make() -> list[bytes]:
        back = {i: b for b, i in load_ranks(ranks).items()}
        return [back.get(i, b"") for i in range(max(back) + 1)]

    return kept(__name__, ranks, make)


IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
BOTH = IDS.append(pa.field("decoded", pa.binary()))


def base(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def id_batches(batches: Iterator[pa.RecordBatch], ids: TextIds, most: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
    """doc_id, ids of each batch of (doc_id, text), cut where the ids have some megabytes."""
    for batch in batches:
        docs, held, size = batch.column(0).cast(pa.int64()), [], 0
        first = 0
        for k, text in enumerate(batch.column(1).to_pylist()):
            held.append(ids.packed(text or ""))
            size += len(held[-1])
            if size >= most or k + 1 == len(docs):
                ends = np.cumsum([0, *map(len, held)], dtype=np.int64) // 4
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), size // 4, [None, pa.py_buffer(b"".join(held))]))
                yield pa.RecordBatch.from_arrays([docs.slice(first, len(held)), lists], schema=IDS)
                first, held, size = k + 1, [], 0


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Each document's ids: columns doc_id, ids."""
    narrow(docs.sparkSession)

    @quiet
    def run(batches: Iterator[pa.RecordBatch]):
        yield from id_batches(batches, text_ids(ranks, pattern))

    return base(docs).mapInArrow(run, ENCODED)


def restored(ids: pa.ListArray, table: list[bytes]) -> pa.Array:
    """The bytes that the ids of each row stand for."""
    values, ends = ids.flatten().to_numpy(zero_copy_only=False).tolist(), ids.offsets.to_pylist()
    return pa.array([decoded(values[a - ends[0] : b - ends[0]], table) for a, b in zip(ends, ends[1:])], pa.binary())


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Adds to (doc_id, ids) the bytes that the ids stand for."""
    narrow(encoded.sparkSession)

    @quiet
    def run(batches: Iterator[pa.RecordBatch]):
        table = token_table(ranks)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(BOTH.field(1).type), restored(batch.column(1), table)], schema=BOTH)

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``decode(encode(docs))`` in one pass of one worker: doc_id, ids, decoded."""
    narrow(docs.sparkSession)

    @quiet
    def run(batches: Iterator[pa.RecordBatch]):
        table = token_table(ranks)
        for out in id_batches(batches, text_ids(ranks, pattern), OUT_BYTES // 2):
            yield pa.RecordBatch.from_arrays([*out.columns, restored(out.column(1), table)], schema=BOTH)

    return base(docs).mapInArrow(run, DECODED)


def digest(ids: Iterable[int]) -> str:
    """sha256 of the decimal ids joined by one space (what the query makes with SQL functions)."""
    return hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
