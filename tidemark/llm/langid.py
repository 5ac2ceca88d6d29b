"""Language identification by prediction by partial matching over the bytes of a text.

A text is a stream of symbols: its UTF-8 bytes as they are (white space, case and signs included) and
an end. For each language a tree of contexts of up to ``order`` symbols, across words, with a mark
before the first byte, holds how often each symbol followed. A symbol costs its share of its context's
counts; one that the context has not seen costs the context's escape probability (method C: distinct
followers over counts and followers together) and is looked up in the next shorter context, where
the followers of the longer one are excluded, down to a uniform choice of the symbols left. So the
probabilities of all symbols sum to one in every context, and the sum of the costs is the exact code
length of the text. Statistics are frozen after training. The shortest code wins.

The score is the winner's posterior under equal priors; the evidence of a text of more than
``EVIDENCE`` symbols counts as that of its average stretch of so many, or every page would score 1.

How it is computed: a symbol's cost depends on itself and the ``order`` before it alone. These are one
integer; the distinct ones of some megabytes of text are costed at a time, for each language by binary
searches in its sorted statistics, and a text's code length is the sum over its positions.

Training reads a sample: about ``docs_per_lang`` documents of each language (chosen by a hash of
their ids, at most ``max_bytes`` long each); both are parameters, so the model's size is bounded.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a null lang is never
learned; with nothing to learn from every text is ``und``; a very long text is read in pieces, with
the same result; languages with equal code lengths: the first in order of name; repeated rows get
equal results; an empty table gives no rows; other columns are ignored (``filtered`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, narrow, quiet, remainder, sized

SCHEMA = "doc_id long, lang_pred string, score double, bits double, chars long"
ARROW = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64()), ("chars", pa.int64())])
#: Symbols: 0 stands before a text, a byte b is b + 1, 257 is the end. What can be coded: 256 bytes and the end.
END, CODED, WIDTH = 257, 257, 9
#: Symbols costed at a time.
STRETCH = 1 << 21
EVIDENCE = 16
# When a text is in none of the learned languages. A language's own texts, coded by a model
# of its other texts, give a mean and a deviation of bits a symbol; texts above the mean by so many
# deviations (of so many bits at least) are rejected.
DEVIATIONS, LEAST_DEVIATION = 8.0, 0.15
#: Shorter texts (bytes) are not rejected: their code length says too little.
LEAST_BYTES = 100


def low(symbols: int) -> np.int64:
    """A mask of the last so many symbols of a gram."""
    return np.int64((1 << WIDTH * symbols) - 1)


def stretches(texts: Iterable[bytes], order: int, most: int = STRETCH) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Grams (the symbol of each position and the ``order`` before it) of some texts at a time, and the
    positions (text, from, to) that are theirs. A text longer than a stretch comes in several."""
    held: list[np.ndarray] = []
    spans: list[tuple[int, int, int]] = []
    size = 0

    def grams() -> np.ndarray:
        flat = np.concatenate(held).astype(np.int64)
        out = flat.copy()
        for k in range(1, order + 1):
            out[k:] |= flat[:-k] << WIDTH * k
        return out

    for number, text in enumerate(texts):
        for at in range(0, len(text) + 1, most):
            part = np.zeros(order + min(most, len(text) + 1 - at), np.uint16)
            if at:
                part[:order] = np.frombuffer(text[at - order : at], np.uint8).astype(np.uint16) + 1
            body = np.frombuffer(text[at : at + most], np.uint8)
            part[order : order + len(body)] = body.astype(np.uint16) + 1
            if at + most > len(text):
                part[-1] = END
            held.append(part)
            spans.append((number, size + order, size + len(part)))
            size += len(part)
            if size >= most:
                yield grams(), spans
                held, spans, size = [], [], 0
    if held:
        yield grams(), spans


@dataclass
class Level:
    """Contexts of one length, sorted: all counts, distinct followers, and what these followers count in
    the context shorter by one. Grams (context and follower), sorted, with counts."""

    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    below: np.ndarray
    grams: np.ndarray
    counts: np.ndarray


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted are among sorted keys, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def levels(grams: np.ndarray, order: int) -> list[Level]:
    """The context tree of all grams of a language's texts, by context length."""
    keys, counts = np.unique(grams, return_counts=True)
    out: list[Level] = []
    for k in range(order + 1):
        own, back = np.unique(keys & low(k + 1), return_inverse=True)
        n = np.bincount(back, counts).astype(np.int64)
        contexts, first = np.unique(own >> WIDTH, return_index=True)
        below = np.add.reduceat(out[-1].counts[found(out[-1].grams, own & low(k))[0]], first) if k else np.zeros(1, np.int64)
        out.append(Level(contexts, np.add.reduceat(n, first), np.diff(np.append(first, len(own))), below, own, n))
    return out


@dataclass
class Model:
    """Per language the levels of its context tree, and from how many bits a symbol a text is foreign to it."""

    order: int
    langs: list[str] = field(default_factory=list)
    trees: list[list[Level]] = field(default_factory=list)
    bounds: list[float] = field(default_factory=list)

    def learn(self, lang: str, texts: list[bytes]) -> None:
        got = [g[a:b] for g, spans in stretches(texts, self.order) for _, a, b in spans]
        if got:
            self.langs.append(lang)
            self.trees.append(levels(np.concatenate(got), self.order))
            self.bounds.append(np.inf)

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last symbol of each gram after the ones before it; a column for each language."""
        return np.stack([coded(tree, grams) for tree in self.trees], axis=1)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in bits; a column for each language."""
        out = np.zeros((len(texts), len(self.trees)))
        for grams, spans in stretches(texts, self.order):
            at, distinct = pd.factorize(grams)
            order = np.argsort(distinct)
            bits = np.empty((len(distinct), len(self.trees)))
            bits[order] = self.cost(distinct[order])
            which, first, last = (np.array(x) for x in zip(*spans))
            for k in range(len(self.trees)):
                sums = np.concatenate([[0.0], np.cumsum(bits[:, k][at])])
                np.add.at(out[:, k], which, sums[last] - sums[first])
        return out

    def bound(self, lang: str, texts: list[bytes]) -> float:
        """Mean and so many deviations of bits a symbol of a language's texts, each half coded by a model of the other."""
        texts = [t for t in texts if len(t) >= LEAST_BYTES]
        halves, rates = (texts[::2], texts[1::2]), []
        for half, other in (halves, halves[::-1]):
            model = Model(self.order)
            model.learn(lang, half)
            if model.trees and other:
                rates += (model.lengths(other)[:, 0] / np.array([len(t) + 1 for t in other])).tolist()
        return float(np.mean(rates) + DEVIATIONS * max(LEAST_DEVIATION, np.std(rates))) if len(rates) > 1 else np.inf


def coded(tree: list[Level], grams: np.ndarray) -> np.ndarray:
    """Bits of each gram's last symbol in one language's context tree."""
    bits = np.zeros(len(grams))
    at = np.arange(len(grams))  # grams whose symbol is not coded yet
    gone, out = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)  # excluded symbols, and their counts in the next context
    for k in range(len(tree) - 1, -1, -1):
        level, wanted = tree[k], grams[at] & low(k + 1)
        context, seen = found(level.contexts, wanted >> WIDTH)
        gram, hit = found(level.grams, wanted)
        total = np.where(seen, level.total[context] - out, 0)
        left = np.where(seen, level.distinct[context] - gone, 0)
        here = np.where(hit, level.counts[gram], left)
        coding = seen & (here > 0)
        bits[at[coding]] -= np.log2(here[coding] / (total + left)[coding])
        gone = np.where(seen, level.distinct[context], 0)[~hit]
        at, context, seen = at[~hit], context[~hit], seen[~hit]
        out = np.where(seen, level.below[context], 0) if k else out
    bits[at] += np.log2(CODED - gone)
    return bits


def has_letter(text: str) -> bool:
    return next(filter(str.isalpha, text), None) is not None


def train(docs: DataFrame, learn: Column, *, order: int = 4, docs_per_lang: int = 300, max_bytes: int = 20_000) -> Model:
    """A model of the rows where ``learn`` holds, from columns doc_id, text, lang.

    A language's share of the sample is set by its number of rows, so one pass over the ids and one
    over the texts suffice, and no group of rows meets in one task."""
    usable = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    counts = {r.lang: r.n for r in docs.filter(learn & F.col("lang").isNotNull()).groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(5), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.3 * docs_per_lang / n))).otherwise(share)
    model, by = Model(order), {}
    for r in usable.filter(hashed < share).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).toLocalIterator():
        if r.text:
            by.setdefault(r.lang, []).append(encoded(r.text))
    for lang in sorted(by):
        texts = sorted(by[lang])
        model.learn(lang, texts)
        model.bounds[-1] = model.bound(lang, texts)
    return model


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, bits (the winner's code length), chars of every document (doc_id, text)."""
    narrow(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample

    @quiet
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield from sized((((doc, *got[:3], len(text or "")), 24) for doc, text, got in zip(batch.column(0).to_pylist(), texts, verdicts(sent.value, texts))), ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def verdicts(model: Model, texts: list[str | None]) -> Iterator[tuple[str, float, float, bool]]:
    """Language, score, bits of each text, and whether its language knows it."""
    chosen = [k for k, t in enumerate(texts) if t and model.langs and has_letter(t)]
    raw = [encoded(texts[k]) for k in chosen]
    out: list[tuple[str, float, float, bool]] = [("und", 0.0, 0.0, False)] * len(texts)
    for k, text, bits in zip(chosen, raw, model.lengths(raw) if raw else ()):
        best, n = int(np.argmin(bits)), len(text) + 1
        more = (bits - bits[best]) * min(1.0, EVIDENCE / n)
        known = len(text) < LEAST_BYTES or bits[best] <= model.bounds[best] * n
        out[k] = (model.langs[best], float(1 / np.exp2(-np.minimum(more, 1000)).sum()), float(bits[best]), bool(known))
    yield from out


def filtered(docs: DataFrame) -> DataFrame:
    """The documents (all their columns) in a learned language; learned from those not held out.

    Texts that are ``und`` go, and those whose code in their predicted language is longer than that
    language's texts have (see ``Model.bound``). With nothing to learn from every document stays."""
    narrow(docs.sparkSession)
    model = train(docs, remainder("doc_id", 3) != 1)
    if not model.langs:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @quiet
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([known for *_, known in verdicts(sent.value, column(batch, "text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out (crc32(doc_id) mod 3 is not 1), then identify all."""
    held = remainder("doc_id", 3) == 1
    found_ = identify(docs, train(docs, ~held))
    return found_.select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits", "chars")
