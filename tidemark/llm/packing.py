"""Packing of tokenised documents into fixed windows by the sum-of-squares rule.

Each task reads its documents in order and keeps an array with the number of open windows at every
fill level. A document longer than a window first fills whole windows; the rest goes to the level
(an open one, or an empty window) whose choice makes the sum of squared counts smallest. Placement
is online: one pass, no shuffle, no sort, and work per document that depends on the occupied levels
alone. Open windows hold at most ``max_open_tokens``; beyond that, and at the end of a task, they
are drained: the fullest are topped up with tokens cut from the emptiest, and what is left over at
the very end (under one window) is cut at powers of two, which need no padding.

Defined cases: a null text counts as empty and gives the end id alone; a null id stays null;
repeated rows are packed as often as they occur; an empty table gives no rows; other columns of the
input are ignored. A lost executor's task is repeated with the same rows and gives the same windows,
because sequence ids are made of the task's partition number and a counter.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Callable, Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import kept, narrow, quiet, raw, sized

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64())])
#: Cached words of a worker in each of two generations (about 200 bytes a word), and bytes of words and ids there. Words
#: beyond LONG bytes are not remembered. Words, and bytes of texts, that are looked up before missing ones are learned.
CACHE_WORDS, CACHE_BYTES, LONG = 550_000, 96 << 20, 4096
HELD_WORDS, HELD_BYTES = 500_000, 16 << 20
Piece = tuple[int | None, int, int, bytes]  # doc_id, start, tokens of its document, little-endian ids


class WordTokens(dict):
    """The ids of one word as little-endian bytes, remembered in two generations.

    The tokenizer drops white space and never lets a token cross it, so a text's ids are those of
    its words (split at ASCII white space) one after the other. It also lower-cases, and cuts
    between a letter and the signs after it, so ``word`` and ``Word&&`` share their letters' ids."""

    SIGNS = b".,!?;:&$%#*|"
    MARK = b" \x01 "

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.batch = Tokenizer.from_file(path).encode_batch_fast
        (self.mark,) = self.batch([self.MARK.decode()], add_special_tokens=False)[0].ids
        self.old: dict[bytes, bytes] = {}
        self.bytes = 0  # of the words learned since the last generation, and of their ids

    def add(self, new: set[bytes]) -> None:
        """Learn words that are not known yet."""
        todo, joined, old = [], [], self.old.get
        for word in new:
            if (got := old(word)) is not None:
                self[word] = got
                continue
            body = word.rstrip(self.SIGNS)
            if body and body != word and (body[-1:].isalpha() if body.isascii() else normalize("NFC", body.decode()).lower()[-1].isalpha()):
                signs = word[len(body) :]
                joined.append((word, body, signs))
                todo += (x for x in (body, signs) if x not in self and x not in new)
            else:
                todo.append(word)
        self.encode(list(dict.fromkeys(todo)))
        for word, body, signs in joined:
            self[word] = self.known(body) + self.known(signs)

    def known(self, word: bytes) -> bytes:
        if word not in self:
            self.encode([word])
        return self[word]

    def encode(self, words: list[bytes]) -> None:
        """Many words go through the tokenizer as one text, with a mark between each two."""
        groups = [words[i : i + 128] for i in range(0, len(words), 128)]
        for i in range(0, len(groups), 32):
            part = groups[i : i + 32]
            texts = [self.MARK.join(g).decode() for g in part]
            for group, got in zip(part, self.batch(texts, add_special_tokens=False)):
                ids = np.array(got.ids, "<u4")
                ends = np.flatnonzero(ids == self.mark)
                if len(ends) == len(group) - 1:
                    ids, at = ids.tobytes(), 0
                    for word, end in zip(group, (4 * ends).tolist()):
                        self[word] = ids[at:end]
                        at = end + 4
                    self[group[-1]] = ids[at:]
                else:  # a word holds the mark
                    for word, one in zip(group, self.batch([w.decode() for w in group], add_special_tokens=False)):
                        self[word] = np.array(one.ids, "<u4").tobytes()

    def __call__(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """The ids of each text, as bytes. Each word is looked up once; words that were missing are
        learned many at a time and filled in."""
        held, todo, size, read = [], set(), 0, 0
        for text in texts:
            text = text or b""
            words = (text if b"<|" in text else text.lower()).split()  # case matters in the names of added tokens
            found = list(map(self.get, words))
            holes = [k for k, ids in enumerate(found) if ids is None]
            new = [words[k] for k in holes]
            todo.update(new)
            held.append((found, holes, new))
            size += len(words)
            read += len(text)
            if size > HELD_WORDS or read > HELD_BYTES:
                yield from self._filled(held, todo)
                held, todo, size, read = [], set(), 0, 0
        yield from self._filled(held, todo)

    def _filled(self, held: list[tuple[list, list[int], list[bytes]]], todo: set[bytes]) -> Iterator[bytes]:
        if len(self) + len(todo) > CACHE_WORDS or self.bytes > CACHE_BYTES:
            self.old = dict(self)
            self.clear()
            self.bytes = 0
        self.add(todo)
        for found, holes, new in held:
            for k, word in zip(holes, new):
                found[k] = self[word]
            yield b"".join(found)
        self.bytes += sum(map(len, todo)) + sum(len(self[word]) for word in todo)
        for word in todo:
            if len(word) > LONG:
                self.pop(word, None)
                self.pop(word.rstrip(self.SIGNS), None)


def word_tokens(path: str) -> WordTokens:
    """One cache for all packing tasks of a worker process."""
    return kept(__name__, path, lambda: WordTokens(path))


class Levels:
    """Open windows by fill level, and the count of each level."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)
        self.tokens = 0

    def best(self, size: int) -> int:
        """The level (0: an empty window) that makes the sum of squared counts smallest; of several, the fullest."""
        n, last = self.count, self.window - size
        levels = np.flatnonzero(n[1 : last + 1]) + 1
        fresh = 2 * n[size] + 1 if size < self.window else 0
        if not len(levels):
            return 0
        change = 1 - 2 * n[levels]
        after = levels + size
        change = change + np.where(after < self.window, 2 * n[after] + 1, 0)
        k = len(change) - 1 - int(np.argmin(change[::-1]))
        return int(levels[k]) if change[k] <= fresh else 0

    def place(self, piece: Piece, size: int) -> list[Piece] | None:
        """Put a piece; a window that becomes full is handed back."""
        at = self.best(size)
        if at:
            pieces = self.open[at].pop()
            self.count[at] -= 1
        else:
            pieces = []
        pieces.append(piece)
        if at + size == self.window:
            self.tokens -= at
            return pieces
        self.open[at + size].append(pieces)
        self.count[at + size] += 1
        self.tokens += size
        return None

    def drained(self) -> tuple[list[list[Piece]], list[Piece]]:
        """Full windows made of all open ones, and what is left (under one window)."""
        rest = [(level, pieces) for level in sorted(self.open) for pieces in self.open[level]]
        self.open.clear()
        self.count[:] = 0
        self.tokens = 0
        full, low = [], 0
        while low < len(rest):
            level, pieces = rest.pop()
            while level < self.window and low < len(rest):
                at, other = rest[low]
                room = self.window - level
                while room and other:
                    head, tail = cut(other.pop(), room)
                    pieces.append(head)
                    n = len(head[3]) // 4
                    room, at, level = room - n, at - n, level + n
                    if tail:
                        other.append(tail)
                rest[low] = (at, other)
                low += not other
            if level == self.window:
                full.append(pieces)
            else:
                return full, pieces
        return full, []


def cut(piece: Piece, most: int) -> tuple[Piece, Piece | None]:
    doc, start, total, ids = piece
    if len(ids) <= 4 * most:
        return piece, None
    return (doc, start, total, ids[: 4 * most]), (doc, start + most, total, ids[4 * most :])


def powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """Cut the pieces into sequences whose lengths are powers of two."""
    left = sum(len(p[3]) for p in pieces) // 4
    todo = pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        out = []
        while size:
            head, tail = cut(todo.pop(), size)
            out.append(head)
            size -= len(head[3]) // 4
            if tail:
                todo.append(tail)
        yield out


def windows(docs: Iterator[tuple[int | None, bytes]], window: int, max_open_tokens: int) -> Iterator[list[Piece]]:
    """Sequences of pieces, of documents given as (id, ids in bytes)."""
    levels = Levels(window)
    for doc, ids in docs:
        total, full = len(ids) // 4, len(ids) // 4 // window
        for k in range(full):
            yield [(doc, k * window, total, ids[4 * k * window : 4 * (k + 1) * window])]
        if rest := total - full * window:
            if done := levels.place((doc, full * window, total, ids[4 * full * window :]), rest):
                yield done
        if levels.tokens > max_open_tokens:
            done, left = levels.drained()
            yield from done
            if left:
                size = sum(len(p[3]) for p in left) // 4
                levels.open[size].append(left)
                levels.count[size] += 1
                levels.tokens += size
    done, left = levels.drained()
    yield from done
    yield from powers(left)


def pack(docs: DataFrame, tokenizer: str, *, window: int = 4096, end_id: int = 2, max_open_tokens: int = 1 << 21, encoder: Callable[[str], WordTokens] = word_tokens) -> DataFrame:
    """Pieces of all documents (columns doc_id, text) in sequences of at most ``window`` tokens.

    ids: the piece's token ids, unsigned 32-bit little-endian. sequence_length: tokens of its
    sequence; a sequence is to be padded to ``window`` unless that is a power of two.
    """
    narrow(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    @quiet
    def run(batches):
        base, encode = TaskContext.get().partitionId() << 36, None

        def ids():
            nonlocal encode
            for batch in batches:
                encode = encode or encoder(tokenizer)
                for doc, got in zip(batch.column(0).to_pylist(), encode(raw(batch, "text"))):
                    yield doc, got + end

        def rows():
            for k, pieces in enumerate(windows(ids(), window, max_open_tokens)):
                at, size = 0, sum(len(p[3]) for p in pieces) // 4
                for doc, start, total, got in pieces:
                    n = len(got) // 4
                    yield (doc, start, n, got, total, base + k, at, size), len(got)
                    at += n

        yield from sized(rows(), ARROW)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
