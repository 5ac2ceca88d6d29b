"""Quality rules: distribution divergence from language references.

A document's histogram of character classes, and its histogram of common words (each of a fixed
list, and all others together), are compared with each language's reference by the Jensen-Shannon
distance (the square root of the divergence in bits, 0 to 1). A reference is the sum of the
histograms of all documents of that language, gathered in one pass with counts added up in each
task first; so what meets on the driver is languages times classes. A document passes if some
language is near enough in both. Guards: the character test needs ``min_chars`` characters, the word
test ``min_words`` words; shorter texts pass it, since their histograms say too little. For the same
reason the word test's bound is ``max_word`` plus ``word_slack`` over the root of the word count.

Before that stand base rules: at least 20 words, and not over 30 % of the words in 8-word windows
that the text has twice or more.

Defined cases: a null text has no words and fails; rows with a null language feed no reference; with
no reference the divergence test passes everything; repeated rows get equal results; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, quiet, raw, sized

# Frequent function words of four languages.
COMMON = (
    "the of and to in a is that for it as was with be by on not he his are this or from at "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es "
    "le la les de et des du un une que en est qui dans par pour au sur pas plus ce il avec "
    "el los las y del se por con para no su al lo como más o"
).split()
WORDS = {w.encode(): k for k, w in enumerate(dict.fromkeys(COMMON))}
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "mark", "symbol", "letter2", "letter3", "other")
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, nearest string, kept boolean"
ARROW = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64()), ("nearest", pa.string()), ("kept", pa.bool_())])


def _classes() -> np.ndarray:
    """Class of each byte: of a code point beyond ASCII the first byte counts, the others do not (-1 as 255)."""
    table = np.full(256, CLASSES.index("other"), np.uint8)
    for b in range(128):
        c = chr(b)
        name = "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "line" if c == "\n" else "space" if c.isspace() else "symbol" if b in SYMBOLS else "stop" if c in ".,;:!?" else "mark" if c.isprintable() else "other"
        table[b] = CLASSES.index(name)
    table[0xC2:0xE0] = CLASSES.index("letter2")
    table[0xE0:0xF8] = CLASSES.index("letter3")
    table[0x80:0xC0] = len(CLASSES)  # continuation bytes
    return table


TABLE = _classes()


def histograms(text: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes, and of common words with all others last."""
    chars = np.bincount(TABLE[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]
    found, out = Counter(words), np.zeros(len(WORDS) + 1, np.int64)
    if len(found) < len(WORDS):
        for word, n in found.items():
            if (k := WORDS.get(word)) is not None:
                out[k] = n
    else:
        for word, k in WORDS.items():
            if n := found.get(word):
                out[k] = n
    out[-1] = len(words) - out.sum()
    return chars, out


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of one histogram to each reference (rows that sum to 1)."""
    p = counts / counts.sum()
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(reference > 0, reference * np.log2(reference / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def repeated(words: list[bytes], width: int = 8) -> int:
    """Words that lie in windows of so many words which the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled += h[k : k + n]
        rolled ^= rolled >> np.uint64(29)
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(rolled, twice))
    seen = Counter(windows := [tuple(words[i : i + width]) for i in at.tolist()])
    change = np.zeros(len(words) + 1, np.int64)
    for i, window in zip(at.tolist(), windows):
        if seen[window] > 1:
            change[i] += 1
            change[i + width] -= 1
    return int((np.cumsum(change) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def base(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int, bool]:
    n_words = len(words)
    # code points in words: bytes of words that do not continue a code point
    chars = sum(map(len, words)) - (0 if text.isascii() else len(text) - len(text.decode("utf-8", "surrogatepass")))
    again = repeated(words)
    return n_words, chars, sum(map(text.count, (bytes([b]) for b in SYMBOLS))), duplicate_lines(text), again, n_words < 20 or 100 * again > 30 * n_words


def references(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Per language the shares of character classes and of common words over all its documents."""
    narrow(docs.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("n", pa.int64())])

    @quiet
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), raw(batch, "text")):
                got = np.concatenate(histograms(text, text.lower().split()))
                if (of := sums.get(lang)) is None:
                    sums[lang] = got
                else:
                    of += got
        yield from sized((((lang, k, int(n)), 16) for lang, of in sums.items() for k, n in enumerate(of) if n), schema)

    text = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    got = text.mapInArrow(run, "lang string, k int, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in got})
    out = np.zeros((len(langs), len(CLASSES) + len(WORDS) + 1))
    for r in got:
        out[langs.index(r.lang), r.k] = r.n
    chars, words = out[:, : len(CLASSES)], out[:, len(CLASSES) :]
    full = (chars.sum(axis=1) > 0) & (words.sum(axis=1) > 0)
    chars, words = chars[full], words[full]
    return [x for x, ok in zip(langs, full) if ok], chars / chars.sum(axis=1, keepdims=True), words / words.sum(axis=1, keepdims=True)


def assess(docs: DataFrame, langs: list[str], chars: np.ndarray, words: np.ndarray, *, max_char: float = 0.27, max_word: float = 0.25, word_slack: float = 1.2, min_chars: int = 200, min_words: int = 50) -> DataFrame:
    """Base counts, distances to the nearest language and the verdict of every document (doc_id, text)."""
    narrow(docs.sparkSession)

    @quiet
    def run(batches):
        verdict = verdicts(langs, chars, words, max_char, max_word, word_slack, min_chars, min_words)
        for batch in batches:
            yield from sized((((doc, *verdict(text)), 64) for doc, text in zip(batch.column(0).to_pylist(), raw(batch, "text"))), ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BASE)


def verdicts(langs, chars, words, max_char: float = 0.27, max_word: float = 0.25, word_slack: float = 1.2, min_chars: int = 200, min_words: int = 50):
    """From a text to its base counts, distances, nearest language and verdict."""

    def verdict(text: bytes | None):
        text = text or b""
        split = text.split()
        counts = base(text, split)
        by_char, by_word, near, passed = None, None, None, True
        if langs and split:
            c, w = histograms(text, text.lower().split())
            dc, dw = distance(c, chars), distance(w, words)
            k, most = int(np.argmin(dc / max_char + dw / max_word)), max_word + word_slack / len(split) ** 0.5
            by_char, by_word, near = float(dc[k]), float(dw[k]), langs[k]
            ok_char = dc <= max_char if c.sum() >= min_chars else np.ones(len(langs), bool)
            ok_word = dw <= most if len(split) >= min_words else np.ones(len(langs), bool)
            passed = bool((ok_char & ok_word).any())
        return (*counts, by_char, by_word, near, passed and not counts[-1])

    return verdict


def judge(docs: DataFrame) -> DataFrame:
    """Gather the references from all documents (text, lang), then assess every one."""
    return assess(docs, *references(docs))


def filtered(docs: DataFrame) -> DataFrame:
    """The documents (all their columns) that pass; references come from all of them (text, lang)."""
    narrow(docs.sparkSession)
    known = references(docs)

    @quiet
    def run(batches):
        verdict = verdicts(*known)
        for batch in batches:
            yield batch.filter(pa.array([verdict(text)[-1] for text in raw(batch, "text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
