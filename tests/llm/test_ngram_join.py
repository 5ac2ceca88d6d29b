import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import graph, ngram_join

WORDS = [f"w{k}" for k in range(400)]


def brute(rows, width, num, den):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root, inv = {d: d for d in sets}, defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        seen = Counter(o for g in s for o in inv[g])
        for o, shared in seen.items():
            if shared * den >= num * (len(s) + len(sets[o]) - shared):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
        for g in s:
            inv[g].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def corpus(seed, n=150):
    rnd, rows, passage = random.Random(seed), [], " ".join(random.Random(9).choices(WORDS, k=50))
    for k in range(n):
        kind = rnd.random()
        if rows and kind < 0.55:
            words = rnd.choice(rows)[1].split()
            for _ in range(rnd.choice([0, 1, 1, 2, 4, 8])):
                if words:
                    words[rnd.randrange(len(words))] = rnd.choice(WORDS)
            if rnd.random() < 0.3:
                words = words[: -rnd.randrange(1, 6)] or words
        else:
            words = rnd.choices(WORDS, k=rnd.choice([1, 2, 3, 5, 12, 40, 120, 300]))
            if rnd.random() < 0.4:
                words = words + passage.split()
        rows.append((k * 3 % 997, " ".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "width", "num"), [(1, 3, 90), (2, 5, 80), (3, 3, 90), (4, 2, 60)])
def test_components(spark, seed, width, num):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, n int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, width=width, num=num, den=100).collect()}
    assert got == brute(rows, width, num, 100)


def test_many_blocks_and_shuffled_ids(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 7)
    monkeypatch.setattr(ngram_join, "SEND_IDS", 0)
    rows = corpus(5, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df, width=3, num=80, den=100).collect()}
    assert got == {d: c for d, (_, c) in brute(rows, 3, 80, 100).items()}


def test_a_wide_cluster_costs_its_size(spark, monkeypatch):
    """Hundreds of near copies of one text: members of the largest component do not meet other blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    rnd, base = random.Random(11), random.Random(10).choices(WORDS, k=150)
    rows = []
    for k in range(300):
        words = base[:]
        for _ in range(rnd.choice([1, 2, 3, 4] if k % 50 else [20])):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        rows.append((k, " ".join(words)))
    met, across = [], ngram_join.across
    monkeypatch.setattr(ngram_join, "across", lambda left, right, group, *rest: (met.append((left.count(), right.count(), right.select(group, "node").distinct().count())), across(left, right, group, *rest))[1])
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=80, den=100).collect()}
    assert got == {d: c for d, (_, c) in brute(rows, 3, 80, 100).items()}
    assert met[-1] == (0, 0, 0) and all(right == members for _, right, members in met), met  # a member is sent once, not once a block


def test_edge_rows(spark):
    text = " ".join(WORDS[:60])
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, text), (7, text + " extra"), (None, text), (8, "solo words here"), (8, "solo words here"), (9, "Été un"), (10, "été un"), (11, "x " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, width=3, num=90, den=100).collect()]
    assert len(got) == len(rows)
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 58, 6), (7, 59, 6), (None, 58, 6), (9, 1, 9), (10, 1, 10), (11, 1, 11)} <= set(got)
    assert got.count((8, 1, 8)) == 2
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


def test_representatives(spark):
    text = " ".join(WORDS[:80])
    df = spark.createDataFrame([(3, text, "a"), (1, text + " z", "b"), (2, "other words entirely in here", "c"), (2, "other words entirely in here", "c"), (None, text, "d")], "doc_id long, text string, component_id string")
    got = sorted((r.doc_id or 0, r.component_id) for r in ngram_join.representatives(df).collect())
    assert got == [(0, "d"), (1, "b"), (2, "c")]


def test_cells_lose_no_pair():
    rng, ranges = np.random.default_rng(0), ngram_join.Ranges(80, 100)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        most = int(len(a) * 0.11)
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[: len(a) - int(rng.integers(0, most + 1))]], rng.integers(0, 1 << 63, int(rng.integers(0, most + 1)), dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if shared * 100 >= 80 * (len(a) + len(b) - shared) and not np.array_equal(a, b):
            ka, kb = (ngram_join.cell_keys(x, ngram_join.Ranges(80, 100)) for x in (a, b))
            both = {k >> 1 for k in ka.tolist()} & {k >> 1 for k in kb.tolist()}
            own = {k >> 1 for k in [*ka.tolist(), *kb.tolist()] if k & 1}
            assert both & own


def test_tree_drops_no_pair():
    rnd = random.Random(4)
    base = [set(rnd.sample(range(1 << 40), 60)) for _ in range(4)]
    sets = []
    for k in range(90):
        s = set(rnd.choice(base))
        for _ in range(rnd.randrange(12)):
            s.discard(rnd.choice(sorted(s)))
            s.add(rnd.randrange(1 << 40))
        sets.append((k, np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        sets[-1][1].sort()
    tree = ngram_join.Tree.of([s for _, s in sets], 2048)
    found = {(int(i), int(j)) for a, b, _ in ngram_join.traverse(tree, tree, True, 80, 100) for i, j in zip(a, b)}
    for i in range(90):
        for j in range(i + 1, 90):
            shared = len(np.intersect1d(sets[i][1], sets[j][1]))
            if shared * 180 >= 80 * (len(sets[i][1]) + len(sets[j][1])):
                assert (i, j) in found


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r.u: r.v for r in graph.components(edges)[0].collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 501: 500}
    assert graph.components(edges.limit(0))[0].count() == 0


def test_folded_bitmaps():
    s = np.unique(np.random.default_rng(5).integers(0, 1 << 63, 3000, dtype=np.uint64))
    assert ngram_join.bits_of(3000) == 16384 and ngram_join.bits_of(5) == 2048
    wide, narrow = ngram_join.bitmap(s, 16384), ngram_join.bitmap(s, 2048)
    assert (ngram_join.folded([wide.tobytes(), narrow.tobytes()]) == narrow).all()


def test_long_documents(spark):
    rnd = random.Random(8)
    base = [rnd.choices(WORDS, k=6000) for _ in range(3)]
    rows = []
    for k in range(24):
        words = base[k % 3][:]
        for _ in range(rnd.choice([0, 20, 60, 250])):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        rows.append((k, " ".join(words[: len(words) - rnd.randrange(300)])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, num=90, den=100).collect()}
    assert got == brute(rows, 3, 90, 100)


def test_cells_that_copies_make_look_alike(spark):
    rng = np.random.default_rng(5)
    alone, near = (np.sort(rng.integers(0, 1 << 62, 60).astype(np.uint64)) for _ in range(2))
    x, z = near.copy(), near.copy()
    x[0], z[1] = 1, 2
    sets = {1: alone, 5: x, 6: z, 9: near}
    marks = spark.createDataFrame([(k, len(s), bytearray(ngram_join.bitmap(s, ngram_join.bits_of(len(s))).tobytes())) for k, s in sets.items()], "digest long, n long, bitmap binary")
    cells = spark.createDataFrame([(10, d, 1) for d in (1, 9, 5, 5)] + [(11, d, 1) for d in (1, 9, 6, 6)], "cell long, digest long, first long")
    found, _ = ngram_join.clustered(cells, marks, 80, 100)
    cluster = {r.u: r.v for r in found.collect()}
    assert cluster[9] == cluster[6] == 5
