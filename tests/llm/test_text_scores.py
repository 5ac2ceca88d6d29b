"""Language ID, toxicity, quality rules, fingerprints."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import fingerprint, langid, quality, toxicity


def brute_ppm(texts, order, text):
    """Bits of a text by the definition: dictionaries, one symbol at a time, exclusion by sets of symbols."""
    stream = lambda t: ["^"] * order + list(t) + ["$"]
    seen = {}
    for t in map(stream, texts):
        for at in range(order, len(t)):
            for k in range(order + 1):
                seen.setdefault(tuple(t[at - k : at]), Counter())[t[at]] += 1
    bits, t = [], stream(text)
    for at in range(order, len(t)):
        cost, out = 0.0, set()
        for k in range(order, -1, -1):
            here = {s: n for s, n in seen.get(tuple(t[at - k : at]), {}).items() if s not in out}
            every = sum(here.values()) + len(here)
            if t[at] in here:
                cost -= math.log2(here[t[at]] / every)
                break
            if here:
                cost -= math.log2(len(here) / every)
            out |= set(seen.get(tuple(t[at - k : at]), ()))
        else:
            cost += math.log2(257 - len(out))
        bits.append(cost)
    return sum(bits)


def test_ppm_code_lengths_by_brute_force(monkeypatch):
    rnd = random.Random(7)
    for order in (1, 2, 4):
        model, learned = langid.Model(order), {}
        for lang, letters in (("a", b"abc \n"), ("b", b"abx,"), ("c", bytes(range(256)))):
            learned[lang] = [bytes(rnd.choices(letters, k=rnd.randrange(60))) for _ in range(12)]
            model.learn(lang, learned[lang])
        texts = [b"", b"a", b"zzz", b"\x00\xff", "Ünï cödé".encode()] + [bytes(rnd.choices(b"abcx \n,", k=rnd.randrange(80))) for _ in range(20)]
        want = [[brute_ppm(learned[lang], order, t) for lang in "abc"] for t in texts]
        assert np.allclose(model.lengths(texts), want)
        monkeypatch.setattr(langid.stretches, "__defaults__", (7,))  # texts in pieces
        assert np.allclose(model.lengths(texts), want)
        monkeypatch.undo()


def test_ppm_probabilities_sum_to_one():
    model = langid.Model(3)
    model.learn("a", [b"banana bandana", b"nab", b"nana"])
    for context in ([0, 0, 0], [1 + x for x in b"ban"], [1 + x for x in b"qan"], [1 + x for x in b"xyz"]):
        grams = np.array([sum(c << 9 * (3 - k) for k, c in enumerate([*context, s])) for s in range(1, 258)], np.int64)
        assert math.isclose(np.exp2(-model.cost(grams)[:, 0]).sum(), 1)


def test_language_queries(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1, None, "en"), (-2, "123 !!", "en"), (-3, "", None), (None, "the of and", None)], docs.schema)
    got = {r.doc_id: r for r in langid.predict(docs.unionByName(more)).collect()}
    want = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d in want if got[d].held_out and got[d].chars > 40]
    assert sum(got[d].lang_pred == want[d] for d in held) / len(held) > 0.95
    assert [got[d].lang_pred for d in (-1, -2, -3)] == ["und"] * 3 and got[-1].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(docs.limit(0)).count() == 0
    assert langid.filtered(docs.unionByName(more)).filter("doc_id < 0").count() == 0
    # the query on whole tables against the operator's definition, text by text
    model = langid.train(docs.unionByName(more), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    some = [r for r in docs.collect() if r.text][::9]
    for r, bits in zip(some, model.lengths([langid.encoded(r.text) for r in some])):
        assert got[r.doc_id].lang_pred == model.langs[int(np.argmin(bits))] and math.isclose(got[r.doc_id].bits, bits.min(), rel_tol=1e-9)


def test_language_rows_of_any_kind(spark):
    row = ("the of and that this " * 9, "en", "clash", 7.0)
    rows = [(k, *row) for k in range(30)] + [(3, *row), (None, *row), (40, None, None, "x", 1.0), (41, "", "en", None, None), (42, "the of and " * 100_000, "en", "long", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.predict(docs).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} == {"en", "und"}
    kept = langid.filtered(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == sorted([*range(30), 3, -1, 42])
    assert langid.filtered(docs.limit(0)).count() == 0


def test_language_filter_rejects_unlearned_texts(spark):
    rnd = random.Random(4)
    words = {"en": ["".join(rnd.choices("etaoinsh", k=rnd.randrange(2, 8))) for _ in range(300)], "fr": ["".join(rnd.choices("éuraçlpm", k=rnd.randrange(2, 8))) for _ in range(300)], "xx": ["".join(rnd.choices("бгджзкфц", k=rnd.randrange(2, 8))) for _ in range(300)]}
    text = lambda lang, n=60: " ".join(rnd.choices(words[lang], k=n))
    # shorter than a verdict needs: kept
    rows = [(k, text(("en", "fr")[k % 2], 1500), ("en", "fr")[k % 2]) for k in range(160)]
    rows += [(1000 + k, text("xx"), None) for k in range(20)]
    rows += [(2000 + k, " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(60)), None) for k in range(20)]
    rows += [(3000 + k, text("en"), None) for k in range(20)] + [(4000, "zq xk", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in langid.filtered(docs).collect()}
    assert kept == set(range(160)) | set(range(3000, 3020)) | {4000}, (kept, langid.train(docs, F.lit(True)).bounds)
    assert langid.filtered(docs.withColumn("lang", F.lit(None).cast("string"))).count() == len(rows)


GRAMMAR = toxicity.Grammar(words={"idiot": 2.0}, stems={"lowei": 1.5}, threats={"kill": 1.0}, bias=-2.0, slope=3.0)


def test_clause_grammar():
    m = toxicity.Machine(GRAMMAR)
    weight = lambda t: sum(w for w, _ in m.clauses(t))
    near, negated, reported = toxicity.TARGETED, toxicity.NEGATED, toxicity.REPORTED
    assert weight("a plain sentence.") == 0
    assert weight("An idiot came.") == 2.0
    assert weight("You are an idiot.") == 2.0 + near and weight("an idiot, you") == 2.0 + near
    assert math.isclose(weight("he is not an idiot"), 2.0 + near + negated)
    assert math.isclose(weight("she said: an idiot"), 2.0) and math.isclose(weight("someone said an idiot came"), 2.0 + reported)
    assert weight("someone said not an idiot") == 0  # weaker than nothing: read as a plain word
    assert weight("kill the lights") == 0 and weight("i will kill you") == 1.0 + near and weight("you should not kill") == 1.0 + near + negated
    assert weight("idiotic idiots") == 0 and weight("der loweischaft da") == 1.5 and weight("floweisch") == 0
    assert len(m.clauses("idiot. fine. idiot!")) == 2
    assert m.score([]) < 0.5 < m.score(m.clauses("you idiot"))


def readings(machine, state, letters):
    """All paths of a transducer over letters: what is written, weight."""
    if not letters:
        return [("", 0.0)] if machine.final[state] else []
    out = []
    for written, weight, to in machine.arcs[state].get(letters[0], ()):
        out += [(written + rest, weight + more) for rest, more in readings(machine, to, letters[1:])]
    return out


def brute_best(words):
    """The cascade without composition: all readings of the lexicon go through one transducer after the other."""
    now = [("", 0.0)]
    for letters in words:
        now = [(text + letter, w + more) for text, w in now for letter, more in letters]
    for machine in (toxicity.insults(), toxicity.threats(), toxicity.targets(), toxicity.negations(), toxicity.speech()):
        now = [(written, w + more) for text, w in now for written, more in readings(machine, 0, text)]
    return max(w for _, w in now)


def by_rule(words):
    """The grammar's meaning, hit by hit."""
    letters, total, reach = [w[0][0] for w in words], 0.0, toxicity.REACH
    for k, ((letter, weight), *_) in enumerate(words):
        if letter in "IH":
            near = "T" in letters[max(0, k - reach) : k] + letters[k + 1 : k + 1 + reach]
            if letter == "H" and not near:
                continue
            total += max(0.0, weight + toxicity.TARGETED * near + toxicity.NEGATED * ("N" in letters[max(0, k - reach) : k]) + toxicity.REPORTED * ("S" in letters[:k]))
    return total


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="IHTNSwwww", min_size=1, max_size=9))
def test_composition_by_brute_force(letters):
    words = [[(c, 2.0), ("w", 0.0)] if c == "I" else [(c, 1.0), ("w", 0.0)] if c == "H" else [(c, 0.0)] for c in letters]
    best = toxicity.best_path(toxicity.cascade(), words)
    assert math.isclose(best, brute_best(words)) and math.isclose(best, by_rule(words))


def test_long_text_with_many_matches():
    m = toxicity.Machine(GRAMMAR)
    assert sum(w for w, _ in m.clauses("idiot " * 3000)) == 6000.0
    assert m.clauses("x" * 200_000) == []


def test_learning_finds_words_and_stems():
    rnd, samples = random.Random(0), []
    plain = [f"word{k}" for k in range(60)]
    for k in range(400):
        words = rnd.choices(plain, k=40)
        if k % 4 == 0:
            for _ in range(3):
                words.insert(rnd.randrange(40), rnd.choice(["blargh", "zorpet" + rnd.choice(["en", "ig", "lich", "haft"])]))
        samples.append((" ".join(words), int(k % 4 == 0)))
    g = toxicity.learned(samples)
    assert "blargh" in g.words and any("zorpet".startswith(s) or s.startswith("zorpe") for s in g.stems)
    m = toxicity.Machine(g)
    assert all((m.score(m.clauses(t)) >= 0.5) == bool(y) for t, y in samples)


def test_toxicity_query(spark, sf):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (None, "you idiot", 0.0), (4, "you idiot", 0.0), (4, "you idiot", 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.predict(docs, none).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.predict(docs.limit(0), none).count() == 0
    real, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert toxicity.predict(real, labels).count() == real.count()


def test_toxicity_of_held_out_rows(spark, sf):
    """The whole query against the operator's definition, clause by clause, and its verdicts on labels it has not seen."""
    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.predict(docs, labels).collect()}
    grammar = toxicity.train(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    lexicon, machine = toxicity.Lexicon(grammar), toxicity.cascade()
    for r in docs.collect()[::70]:
        clauses = [toxicity.best_path(machine, map(lexicon.read, toxicity.WORD.findall(c))) for c in toxicity.CLAUSE.split((r.text or "").lower())]
        z = grammar.bias + grammar.slope * math.log1p(sum(clauses))
        assert math.isclose(got[r.doc_id].score, 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), rel_tol=1e-9)
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out and r.toxic is not None]
    right = [p for p, y in held if y]
    assert sum(right) / len(right) > 0.75 and sum(p for p, y in held if not y) <= 0.03 * len(held)


def brute_repeats(words):
    at = {}
    for k in range(len(words) - 7):
        at.setdefault(tuple(words[k : k + 8]), []).append(k)
    return len({k + i for ks in at.values() if len(ks) > 1 for k in ks for i in range(8)})


def test_quality_counts():
    rnd = random.Random(2)
    for _ in range(200):
        words = [str(rnd.randrange(3)).encode() for _ in range(rnd.randrange(60))]
        assert quality.repeated(words) == brute_repeats(words)
    text = "Ünder a # b\n\nsame line\nsame line\n \n \n*$ %".encode()
    n, chars, symbols, lines, again, failed = quality.base(text, text.split())
    assert (n, chars, symbols, lines, again, failed) == (10, sum(len(w) for w in text.decode().split()), 4, 1, 0, True)


def test_distance():
    p = np.array([3, 1, 0])
    assert quality.distance(p, np.array([[0.75, 0.25, 0.0]]))[0] == 0
    assert math.isclose(quality.distance(np.array([1, 0]), np.array([[0.0, 1.0]]))[0], 1.0)


def test_quality_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "### $$$ %%% &&& " * 60 + " ".join(f"#{k}$" for k in range(90)), None), (-4, "word " * 500, "en")], docs.schema)
    got = {r.doc_id: r for r in quality.judge(docs.unionByName(more)).collect()}
    assert not any(got[k].kept for k in (-1, -2, -3, -4)) and got[-4].n_repeat_words == 500
    good = docs.join(spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select("doc_id"), "doc_id")
    kept = [got[r.doc_id].kept for r in good.collect() if not got[r.doc_id].base_failed]
    assert sum(kept) / len(kept) > 0.98
    assert quality.judge(docs.limit(0)).count() == 0
    alone = docs.withColumn("lang", F.lit(None).cast("string"))
    assert all(r.kept == (not r.base_failed) for r in quality.judge(alone).collect())
    assert quality.filtered(docs).columns == docs.columns


def brute_histograms(text):
    """Shares of character classes and of common words, character by character."""
    chars, words = Counter(), Counter()
    for c in text:
        n = len(c.encode("utf-8", "surrogatepass"))
        if n > 1:
            chars["letter2" if n == 2 and c >= "\x80" else "letter3"] += 1
        elif c == "\n":
            chars["line"] += 1
        else:
            chars["lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "space" if c.isspace() else "symbol" if c in "#*$%&|<>" else "stop" if c in ".,;:!?" else "mark" if c.isprintable() else "other"] += 1
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for w in re.findall(r"[^\x20\x09-\x0D]+", low):
        words[w if w in set(quality.COMMON) else ""] += 1
    return chars, words


def brute_distance(a, b):
    total_a, total_b, out = sum(a.values()), sum(b.values()), 0.0
    for k in set(a) | set(b):
        p, q = a[k] / total_a, b[k] / total_b
        m = (p + q) / 2
        out += (p * math.log2(p / m) if p else 0) / 2 + (q * math.log2(q / m) if q else 0) / 2
    return math.sqrt(min(1.0, max(0.0, out)))


def test_quality_verdicts_by_brute_force(spark, sf):
    """The whole query: references, distances and verdicts of all documents from dictionaries."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows, sums = docs.collect(), {}
    for r in rows:
        if r.lang is not None and r.text is not None:
            for total, one in zip(sums.setdefault(r.lang, (Counter(), Counter())), brute_histograms(r.text)):
                total.update(one)
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for r in rows:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        again = brute_repeats(words)
        failed = len(words) < 20 or 100 * again > 30 * len(words)
        mine = got[r.doc_id]
        assert (mine.n_words, mine.n_repeat_words, mine.base_failed) == (len(words), again, failed)
        if not words:
            assert not mine.kept
            continue
        chars, common = brute_histograms(text)
        apart = {lang: (brute_distance(chars, c), brute_distance(common, w)) for lang, (c, w) in sums.items()}
        bound = 0.25 + 1.2 / math.sqrt(len(words))
        ok = any((c <= 0.27 or sum(chars.values()) < 200) and (w <= bound or len(words) < 50) for c, w in apart.values())
        assert mine.kept == (ok and not failed)
        assert math.isclose(mine.char_distance, apart[mine.nearest][0], abs_tol=1e-6) and math.isclose(mine.word_distance, apart[mine.nearest][1], abs_tol=1e-6)


def brute_digest(text):
    b = b"\x00\x01" + text + b"\xfe\xff"
    count = [0] * 128
    for x, y, z in zip(b, b[1:], b[2:]):
        h = (x * 0x9E3779B1 ^ y * 0x85EBCA6B ^ z * 0xC2B2AE35) & 0xFFFFFFFF
        h ^= h >> 15
        count[(h * 0x2C1B3C6D & 0xFFFFFFFF) >> 25] += 1
    edges = [sorted(count)[k] for k in (31, 63, 95)]
    return [sum(c > e for e in edges) for c in count]


def test_digest():
    for text in (b"", b"a", b"the quick brown fox" * 9, bytes(range(256)) * 3):
        d = fingerprint.Digest(text)
        assert d.codes.tolist() == brute_digest(text) and len(d.hex()) == 66 and d.likeness(d) == 1
    a, b = (fingerprint.of(t) for t in ("some words that are here " * 30, "entirely other letters 12345 zzz " * 30))
    assert 0 <= a.likeness(b) < 0.7 and a.likeness(b) == b.likeness(a)


def test_next_edits(spark):
    rnd = random.Random(3)
    rows = [(k * 7 % 101, "".join(rnd.choices("abc dé ", k=rnd.randrange(90)))) for k in range(101)] + [(200, None), (201, ""), (None, "null id"), (150, "tie"), (150, "tie")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(5)
    got = fingerprint.next_edits(df).collect()
    assert len(got) == len(rows)
    order = sorted([(d, t or "") for d, t in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (d, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(t) // 4
        new = (t[: len(t) - n] + nxt[:n]).encode()
        want.append((d or -1, len(t), hashlib.sha256(new).hexdigest(), fingerprint.of(t).hex(), fingerprint.Digest(new).hex(), fingerprint.of(t).likeness(fingerprint.Digest(new)), fingerprint.of(t).likeness(fingerprint.of(nxt))))
    assert sorted((r.doc_id or -1, *r[1:]) if r.doc_id != 0 else (-1, *r[1:]) for r in got) == sorted(want)
    one = spark.createDataFrame([(5, "alone text")], "doc_id long, text string")
    assert fingerprint.next_edits(one).first().near_next == 1
    assert fingerprint.next_edits(one.limit(0)).count() == 0
    assert {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(one).collect()} == {5: fingerprint.of("alone text").hex()}
