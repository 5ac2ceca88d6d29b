"""Suffix sorting, and removal of repeated bytes, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import queries, repeats, suffixes

SCHEMA = "doc_id long, text string, key string, h long, first int, n_bytes string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "k", 1, 2, "n") for i, t in rows], SCHEMA).repartition(parts)


def brute(texts, length):
    """n_bytes, spans and hash of what is kept, of each text, by counting every string."""
    texts = [(t or "").encode() for t in texts]
    count = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans = []
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
        kept = bytearray(t)
        for a, b in reversed(spans):
            del kept[a:b]
        out.append((len(t), spans, hashlib.sha256(kept).hexdigest()))
    return out


def expected(rows, length):
    return sorted(((-1 if i is None else i), *found) for (i, _), found in zip(rows, brute([t for _, t in rows], length)))


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, [list(s) for s in r.spans], r.kept_sha256) for r in df.collect())


def texts(seed, n=60, long=900):
    """Random words, with passages shared within and between texts, near and exact copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9)))
    prose = lambda size: " ".join(word() for _ in range(size // 5))
    shared = [prose(r.randrange(30, 300)) for _ in range(6)]
    out = []
    for k in range(n):
        t = prose(r.randrange(long))
        for _ in range(r.randrange(3)):
            at = r.randrange(len(t) + 1)
            t = t[:at] + r.choice(shared) + t[at:]
        if out and r.random() < 0.2:
            t = r.choice(out)
            if r.random() < 0.7 and t:
                at = r.randrange(len(t))
                t = t[:at] + word() + t[at + 3 :]
        out.append(t)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_order_equals_plain_sorting(seed):
    r = random.Random(seed)
    letters = r.choice([b"a", b"ab", b"abcdef", bytes(range(245))])
    parts = [bytes(r.choice(letters) for _ in range(r.randrange(1, 120))) for _ in range(r.randrange(1, 6))]
    parts += [p[3:40] for p in parts if r.random() < 0.5]
    text, _ = suffixes.laid(parts)
    for by_digest in (True, False):
        s = suffixes.Suffixes(text, np.ones(len(text), bool), 2048)
        order = s.sorted(by_digest)
        read = [text[p : s.n].tobytes() + b"\0" * 3000 for p in range(s.n)]
        assert sorted(order.tolist()) == list(range(s.n)) and [read[p][:2048] for p in order] == sorted(x[:2048] for x in read)


def test_only_small_suffixes_are_sorted_directly():
    text, _ = suffixes.laid([b"mississippi", b"aab"])
    s = suffixes.Suffixes(text, np.ones(len(text), bool), 64)
    raw = text[: s.n].tobytes() + b"\0" * 64
    assert [bool(x) for x in s.small[:-1]] == [raw[p:] < raw[p + 1 :] for p in range(s.n - 1)]
    direct = s.direct(np.flatnonzero(s.small), True)
    assert len(direct) == int(s.small.sum()) < s.n == len(s.induced(direct))


@pytest.mark.parametrize("seed", range(40))
def test_repeated_starts(seed):
    r = random.Random(seed)
    length = r.choice([3, 8, 11, 32, 40])
    parts = [p for p in (t.encode()[: r.randrange(400)] for t in texts(seed, 8, 500)) if len(p) >= length]
    count = Counter(p[a : a + length] for p in parts for a in range(len(p) - length + 1))
    assert [f.tolist() for f in repeats.repeated_in(parts, length)] == [[count[p[a : a + length]] > 1 for a in range(len(p) - length + 1)] for p in parts] if parts else True


def test_long_runs_of_one_byte():
    parts = [b"a" * 200_000, b"b" + b"a" * 5000, b"ab" * 3000]
    assert [int(f.sum()) for f in repeats.repeated_in(parts, 400)] == [200_000 - 399, 5000 - 399, 6000 - 399]


def test_equal_digests_that_hide_a_difference(monkeypatch):
    """Were all digests equal, neighbours would be found to differ, and the sort done again."""
    monkeypatch.setattr(suffixes.Suffixes, "digests", lambda self, at: np.zeros(len(at), np.uint64))
    head = b"x" * 40
    parts = [head + b"one" * 20, head + b"two" * 20, head + b"one" * 20, head + b"six" * 20, head + b"two" * 20]
    assert [bool(f[0]) for f in repeats.repeated_in(parts, 100)] == [True, True, True, False, True]


def test_owner_of_equal_strings_is_equal():
    own = repeats.Owners(40, 10)
    rnd = np.random.default_rng(1)
    a, b, shared = (rnd.integers(97, 100, n).astype(np.uint8) for n in (300, 200, 90))
    one, two = np.concatenate([a, shared, b]), np.concatenate([b[:77], shared, a[:50]])

    def owner(data):
        first, last, h = own.runs(data, np.array([len(data)]))
        out = np.zeros(len(data), np.int64)
        for f, l, g in zip(first, last, h):
            out[f : l + 1] = g
        return out

    assert (owner(one)[300 : 300 + 51] == owner(two)[77 : 77 + 51]).all()
    first, last, _ = own.runs(np.concatenate([one, two]), np.array([len(one), len(one) + len(two)]))
    starts = {p for f, l in zip(first, last) for p in range(f, l + 1)}
    assert starts == set(range(len(one) - 39)) | set(range(len(one), len(one) + len(two) - 39))


@pytest.mark.parametrize("seed", range(3))
def test_removal_equals_brute_force(spark, seed):
    rows = list(enumerate(texts(seed)))
    rows += [(None, rows[3][1]), (None, None), (7, ""), (8, "é" * 70), (9, "short"), (9, "short"), (rows[5][0], rows[5][1])]
    assert got(repeats.repeats(frame(spark, rows), length=60)) == expected(rows, 60)


def test_wide_owners_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PASS_BYTES", 500)
    monkeypatch.setattr(repeats, "LOT_BYTES", 300)
    rows = list(enumerate(texts(11))) + [(900, "z" * 3000), (901, " ".join(texts(12)))]
    want = expected(rows, 60)
    assert got(repeats.repeats(frame(spark, rows), length=60)) == want
    assert got(repeats.repeats(frame(spark, rows), length=60, wide_bytes=300)) == want
    assert got(repeats.repeats(frame(spark, rows), length=60, wide_bytes=0)) == want


def test_hot_copies_and_passages(spark):
    hot, passage = texts(21, 1, 900)[0] + "x" * 100, "the same words in every one of these " * 4
    rows = [(k, hot if k % 3 == 0 else f"{k} {k * 7919 % 1000003} only here " * 3 + passage) for k in range(400)]
    assert got(repeats.repeats(frame(spark, rows, 8), length=60)) == expected(rows, 60)


def test_empty_tables(spark):
    assert repeats.repeats(frame(spark, [])).collect() == []
    assert got(repeats.repeats(frame(spark, [(1, None), (2, "a")]))) == expected([(1, None), (2, "a")], 400)


def test_op11_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, n, sum(b - a for a, b in spans), len(spans), sha) for i, n, spans, sha in expected(rows, 400))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op11_repeats(spark, sf).collect()) == want
