import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def library():
    return LIBRARY


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="thering on's \n\t.,&é　\U0001f600", max_size=80))
def test_ids(text):
    text = text.encode("utf-8", "ignore").decode()
    assert bpe.text_ids(PATH, PATTERN)(text) == LIBRARY.encode_ordinary(text)


def test_long_pieces(library):
    text = "ab" * 20_000 + "".join(chr(97 + k * k % 26) for k in range(9_000))
    assert bpe.text_ids(PATH, PATTERN)(text) == library.encode_ordinary(text)


def test_pairs_agree_with_merges():
    machine = bpe.Transducer(bpe.load_ranks(PATH))
    for a in range(300, 50_000, 997):
        for b in range(260, 50_000, 1999):
            assert machine.fits(a, b) == (machine.merged(machine.bytes[a] + machine.bytes[b]) == [a, b])


def test_long_distinct_matches_stay_within_bytes(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 50_000)
    rnd, ids = random.Random(5), bpe.TextIds(PATH, PATTERN)
    pieces = ids.get.__self__
    for n in (3, 40, 400, 3000):
        for _ in range(60):
            text = " ".join("".join(rnd.choices("abcdefgh", k=n)) for _ in range(4))
            assert ids(text) == library.encode_ordinary(text)
            assert max(sum(len(p) + len(i) for p, i in one.items()) for one in (pieces, pieces.old)) < 60_000
    assert max(map(len, pieces)) <= bpe.LONG


def test_small_caches_give_the_same(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe, "CACHE_STATES", 5)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 3)
    ids = bpe.TextIds(PATH, PATTERN)
    text = "The quick brown foxes, jumping over lazy dogs; thereafter nothing."
    assert ids(text) == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.integers(1, 5))
def test_decoder_hands_out_whole_code_points(data, step):
    table = [bytes([b]) for b in range(256)]
    decoder, out = bpe.Decoder(table), []
    for k in range(0, len(data), step):
        got = decoder.feed(list(data[k : k + step]))
        if data.decode("utf-8", "ignore").encode() == data:
            got.decode()  # complete
        out.append(got)
    assert b"".join(out) + decoder.finish() == data


def test_documents(spark, library):
    texts = [None, "", "Café <|endoftext|> x\n\n  y", "z" * 5000, "Café <|endoftext|> x\n\n  y"]
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)] + [(None, "null id", "c")], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH).collect()}
    for k, t in enumerate(texts):
        assert got[k].ids == library.encode_ordinary(t or "")
        assert bytes(got[k].decoded) == (t or "").encode()
    assert bpe.digest(got[2].ids) == hashlib.sha256(" ".join(map(str, got[2].ids)).encode()).hexdigest()
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0
