import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


TEXTS = ["", "Hello, WORLD!! it's 12x", "a　b  c\n\td", "İ$$ café#", "\x01 x \x01", "word&&& word***", "<|endoftext|> <|ENDOFTEXT|>", "é क़!", "x" * 3000]


def test_words_give_the_tokenizer_ids():
    tokens = packing.WordTokens(PATH)
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in tokens([t.encode() for t in TEXTS])]
        assert got == ids_of(TEXTS)


def test_long_distinct_words_stay_within_bytes(monkeypatch):
    """Texts of long distinct words: what a worker remembers is bounded by bytes, and ids are right."""
    for name, value in (("CACHE_BYTES", 100_000), ("LONG", 2000), ("HELD_BYTES", 20_000)):
        monkeypatch.setattr(packing, name, value)
    rnd, tokens = random.Random(3), packing.WordTokens(PATH)
    words = ["".join(rnd.choices("abcdefghij0123456789/", k=n)) + rnd.choice(["", "!", "&&"]) for n in [300] * 1500 + [5000] * 30]
    rnd.shuffle(words)
    texts = [" ".join(words[k : k + 10]) for k in range(0, len(words), 10)] + [" ".join(words[:10])] * 2
    most = 0
    got = []
    for ids in tokens([t.encode() for t in texts]):
        got.append(np.frombuffer(ids, "<u4").tolist())
        most = max(most, *(sum(len(w) + len(i) for w, i in one.items()) for one in (tokens, tokens.old)))
    assert got == ids_of(texts)
    assert most < 4 * 100_000 and max(map(len, tokens), default=0) <= 2000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab .,'İ́é&\n\t1", max_size=30), max_size=8))
def test_any_words(texts):
    got = [np.frombuffer(b, "<u4").tolist() for b in packing.word_tokens(PATH)([t.encode() for t in texts])]
    assert got == ids_of(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.sampled_from([8, 32]), st.sampled_from([16, 10_000]))
def test_windows_hold_every_id_once(sizes, window, most):
    docs = [(k, np.arange(k * 1000, k * 1000 + n, dtype="<u4").tobytes()) for k, n in enumerate(sizes)]
    seqs = list(packing.windows(iter(docs), window, most))
    seen = sorted((doc, start + i, v) for s in seqs for doc, start, total, ids in s for i, v in enumerate(np.frombuffer(ids, "<u4").tolist()))
    assert seen == sorted((k, i, k * 1000 + i) for k, n in enumerate(sizes) for i in range(n))
    lengths = [sum(len(p[3]) for p in s) // 4 for s in seqs]
    assert all(n == window or n & (n - 1) == 0 for n in lengths)  # nothing is padded
    assert all(total == sizes[doc] for s in seqs for doc, _, total, _ in s)


def test_sum_of_squares_choice():
    levels = packing.Levels(10)
    assert levels.place((0, 0, 4, b"x" * 16), 4) is None
    assert levels.best(6) == 4  # closes the open window
    assert levels.place((1, 0, 3, b"x" * 12), 3) is None
    brute = lambda size: min((sum(int(x) ** 2 for x in after(levels.count.copy(), h, size)), -h) for h in [0, *np.flatnonzero(levels.count)] if h + size <= 10)[1] * -1

    def after(count, h, size):
        if h:
            count[h] -= 1
        if h + size < 10:
            count[h + size] += 1
        return count

    for size in range(1, 10):
        assert levels.best(size) == brute(size)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, offset int, lang string")


def test_query_rows(spark):
    rows = [(1, None, "x", 1, "en"), (2, "", None, None, None), (3, "ab " * 9000, "x", 1, None), (None, "null id", "x", 1, "en"), (4, "same", "x", 1, "en"), (4, "same", "x", 1, "en")]
    got = packing.pack(frame(spark, rows), PATH).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.doc_tokens for r in by[1]] == [1] and [r.doc_tokens for r in by[2]] == [1] and len(by[4]) == 2
    whole = b"".join(bytes(r.ids) for r in sorted(by[3], key=lambda r: r.start))
    assert np.frombuffer(whole, "<u4").tolist() == ids_of(["ab " * 9000])[0] + [2]
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) >= 0
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_length))
    for parts in seqs.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == parts[0][2] <= 4096


def test_empty(spark):
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_missing_tokenizer(spark):
    with pytest.raises(Exception):
        packing.pack(frame(spark, [(1, "a", "", 1, "")]), "/nowhere.json").count()
