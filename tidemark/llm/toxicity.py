"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause is read by a cascade of weighted transducers, each a small table of arcs over letters:

- the lexicon reads a word letter by letter (a trie; stems stand for all words that begin with them)
  and writes one letter for it: an insult or a threat with its weight, a target, a negation, a verb of
  speech, or a plain word. An insult or threat may also be read as a plain word;
- insults are hits; threats are hits only if a target is near;
- the target transducer adds ``TARGETED`` to a hit within ``REACH`` words after a target, or before one
  (it then promises a target, and a reading whose promise is not kept is none);
- the negation transducer adds ``NEGATED`` to a hit within ``REACH`` words after a negation;
- the speech transducer adds ``REPORTED`` to all hits after a verb of speech.

The transducers are composed once. A clause's score is the weight of its best path (weights along a
path add up, and the best of all paths counts), so a hit that the others weaken below zero is better
read as a plain word, and words of the closed lists never score by themselves. The document's score is
the logistic function of a bias and of its clauses' scores (summed with falling returns).

Learning. Insult words and stems and their weights come from labelled documents: patterns (words,
and prefixes of 5 to 8 letters) that occur in several positive documents after varied words (so that
copies of one passage do not count), and hardly in negative ones; a greedy cover keeps few. Bias
and slope are fitted on the same documents. Learning reads a sample of labelled documents: about
``positives`` and ``negatives`` of them (chosen by a hash of the id, at most ``max_bytes`` long
each); these bounds are parameters. Scoring reads whole texts of all documents, and nothing but the text.

Defined cases: a null or empty text has the score of a text without a match; with nothing to learn
from, the seed words alone are used; labels other than 0 and 1 are ignored; repeated labels count as
often; repeated rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, quiet, remainder, sized

SCHEMA = "doc_id long, score double, predicted int, clauses int, strongest string"
ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("clauses", pa.int32()), ("strongest", pa.string())])
# Closed word lists (English, French, German, Spanish).
SEED_INSULTS = "idiot idiots moron morons stupid imbecile scum bastard imbécile crétin dummkopf blödmann estúpido imbécil".split()
THREATS = "kill hurt destroy punish strangle tuer frapper détruire töten schlagen vernichten matar golpear destruir".split()
TARGETS = frozenset("you your yours you're he she they him her them his their this these tu vous toi votre ton ta il elle ils elles ce cette du dich dir ihr euch dein deine sie er diese dieser tú usted ustedes ti te él ella ellos ellas este esta".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't doesn't nobody pas jamais non ni nicht kein keine keinen nie niemals nunca jamás tampoco".split())
SPEECH = frozenset("said says say told tells quoted wrote writes called claimed reported according dit disent déclaré écrit selon sagte sagt sagen schrieb laut dijo dice dicen escribió según".split())
CLOSED = TARGETS | NEGATIONS | SPEECH
#: Different words before a pattern, and different words with a stem, that are enough.
MANY_BEFORE, MANY_FORMS = 32, 3
CLAUSE = re.compile(r"[.!?;:\n]")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
REACH = 4
#: Weights: a target near a hit, a negation before it, reported speech before it in the clause.
TARGETED, NEGATED, REPORTED = 0.75, -1.5, -1.0


@dataclass
class Grammar:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0
    slope: float = 2.0

    def patterns(self) -> list[str]:
        return [*self.words, *self.stems, *self.threats]


class Lexicon:
    """The transducer from words to letters: I insult, H threat, T target, N negation, S speech, w any other."""

    def __init__(self, grammar: Grammar):
        self.next: list[dict[str, int]] = [{}]
        self.whole: dict[int, tuple[str, float]] = {}  # state -> what a word writes that ends there
        self.begun: dict[int, tuple[str, float]] = {}  # state -> what any word writes that goes through it
        for letter, words in (("H", grammar.threats), ("I", grammar.words)):
            for word, weight in words.items():
                self.whole[self.state(word)] = (letter, weight)
        for stem, weight in grammar.stems.items():
            self.begun[self.state(stem)] = ("I", weight)
        for letter, closed in (("S", SPEECH), ("N", NEGATIONS), ("T", TARGETS)):
            for word in closed:
                self.whole[self.state(word)] = (letter, 0.0)

    def state(self, word: str) -> int:
        at = 0
        for char in word:
            if char not in self.next[at]:
                self.next[at][char] = len(self.next)
                self.next.append({})
            at = self.next[at][char]
        return at

    def read(self, word: str) -> list[tuple[str, float]]:
        """The readings of a word, each a letter and a weight."""
        at, best = 0, None
        for char in word:
            at = self.next[at].get(char, -1)
            if at < 0:
                break
            got = self.begun.get(at)
            if got and (best is None or got[1] > best[1]):
                best = got
        best = self.whole.get(at) or best
        return [("w", 0.0)] if best is None else [best] if best[0] in "TNS" else [best, ("w", 0.0)]


Arc = tuple[str, float, int]  # letter written, weight, next state


@dataclass
class Transducer:
    """arcs[state][letter read]: the arcs. State 0 is the first; a reading must end in a final state."""

    arcs: list[dict[str, list[Arc]]]
    final: list[bool]


def insults() -> Transducer:
    """I becomes a hit, x."""
    return Transducer([{"I": [("x", 0.0, 0)]} | {c: [(c, 0.0, 0)] for c in "wHTNS"}], [True])


def threats() -> Transducer:
    """H becomes h, a hit that needs a target."""
    return Transducer([{"H": [("h", 0.0, 0)]} | {c: [(c, 0.0, 0)] for c in "wxTNS"}], [True])


def targets(reach: int = REACH) -> Transducer:
    """Hits near a target become y. States: 0, words left of a target's reach (1 to reach), words left
    within which a promised target must come (reach + 1 to 2 reach)."""
    arcs: list[dict[str, list[Arc]]] = []
    for state in range(2 * reach + 1):
        promised = state - reach if state > reach else 0
        row: dict[str, list[Arc]] = {"T": [("w", 0.0, reach)]}
        if promised != 1:
            after = state - 1 if state else 0
            row |= {c: [(c, 0.0, after)] for c in "wNSx"}
            near = [("y", TARGETED, after if state else 2 * reach)]
            row["x"] = row["x"] + near
            row["h"] = near
        arcs.append(row)
    return Transducer(arcs, [state <= reach for state in range(2 * reach + 1)])


def negations(reach: int = REACH) -> Transducer:
    """Hits get weaker in the reach of a negation. States: words left of it."""
    arcs = []
    for state in range(reach + 1):
        after, weight = max(0, state - 1), NEGATED if state else 0.0
        arcs.append({"N": [("w", 0.0, reach)]} | {c: [(c, 0.0, after)] for c in "wS"} | {c: [(c, weight, after)] for c in "xy"})
    return Transducer(arcs, [True] * (reach + 1))


def speech() -> Transducer:
    """Hits get weaker after a verb of speech."""
    return Transducer([{"S": [("w", 0.0, 1)], "w": [("w", 0.0, state)]} | {c: [(c, REPORTED * state, state)] for c in "xy"} for state in (0, 1)], [True, True])


def composed(a: Transducer, b: Transducer) -> Transducer:
    """b after a: what a writes, b reads; weights add up. States are the pairs that can be reached."""
    at = {(0, 0): 0}
    pairs = [(0, 0)]
    arcs: list[dict[str, list[Arc]]] = []
    for p, q in pairs:  # grows
        row: dict[str, list[Arc]] = {}
        for letter, first in a.arcs[p].items():
            for written, weight, p2 in first:
                for out, more, q2 in b.arcs[q].get(written, ()):
                    if (p2, q2) not in at:
                        at[p2, q2] = len(pairs)
                        pairs.append((p2, q2))
                    row.setdefault(letter, []).append((out, weight + more, at[p2, q2]))
        arcs.append(row)
    return Transducer(arcs, [a.final[p] and b.final[q] for p, q in pairs])


def cascade() -> Transducer:
    return reduce(composed, (insults(), threats(), targets(), negations(), speech()))


def best_path(machine: Transducer, readings: Iterable[list[tuple[str, float]]]) -> float:
    """Weight of the best reading that ends in a final state (minus infinity if there is none)."""
    now = {0: 0.0}
    for letters in readings:
        then: dict[int, float] = {}
        for state, so_far in now.items():
            row = machine.arcs[state]
            for letter, weight in letters:
                for _, more, to in row.get(letter, ()):
                    got = so_far + weight + more
                    if got > then.get(to, -math.inf):
                        then[to] = got
        now = then
    return max((w for state, w in now.items() if machine.final[state]), default=-math.inf)


class Machine:
    """A grammar's lexicon and the composed transducers."""

    def __init__(self, grammar: Grammar):
        import ahocorasick

        self.grammar, self.lexicon, self.cascade, self.find = grammar, Lexicon(grammar), cascade(), None
        if patterns := grammar.patterns():
            self.find = ahocorasick.Automaton()
            for p in patterns:
                self.find.add_word(p, len(p))
            self.find.make_automaton()

    def clause(self, text: str) -> float:
        return best_path(self.cascade, map(self.lexicon.read, WORD.findall(text)))

    def clauses(self, text: str) -> list[tuple[float, str]]:
        """Score and text of each clause that scores. Clauses without an insult or threat weigh 0 on every
        path, so only those with a pattern in them are read."""
        if self.find is None or not text:
            return []
        low, out, done = text.lower(), [], -1
        for last, size in self.find.iter(low):
            first = last - size + 1
            if first < done or first and (low[first - 1].isalnum() or low[first - 1] == "_"):
                continue
            start = max(low.rfind(c, max(done, 0), first) for c in ".!?;:\n") + 1
            start = max(start, done, 0)
            m = CLAUSE.search(low, last)
            done = m.end() if m else len(low)
            if (got := self.clause(low[start:done])) > 0:
                out.append((got, low[start:done]))
        return out

    def total(self, found: list[tuple[float, str]]) -> float:
        return math.log1p(sum(w for w, _ in found))

    def score(self, found: list[tuple[float, str]]) -> float:
        z = self.grammar.bias + self.grammar.slope * self.total(found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learned(samples: list[tuple[str, int]]) -> Grammar:
    """Words, stems, weights, bias and slope from (text, label)."""
    pos = sum(label for _, label in samples)
    neg = len(samples) - pos
    grammar = Grammar(words={w: 1.0 for w in SEED_INSULTS}, threats={w: 1.0 for w in THREATS})
    least = max(3, pos // 200)
    if pos >= least and neg:
        grammar.words = cover(samples, pos, neg, least)
        grammar.stems = {w[:-1]: x for w, x in grammar.words.items() if w.endswith("*")}
        grammar.words = {w: x for w, x in grammar.words.items() if not w.endswith("*")}
        if not grammar.words and not grammar.stems:
            grammar.words = {w: 1.0 for w in SEED_INSULTS}
        seen = Counter()
        for text, label in samples:
            if not label:
                seen.update(set(WORD.findall(text.lower())) & set(THREATS))
        grammar.threats = {w: 1.0 for w in THREATS if seen[w] <= neg // 1000}
    fit(grammar, samples)
    return grammar


def cover(samples: list[tuple[str, int]], pos: int, neg: int, least: int) -> dict[str, float]:
    """Few patterns (a word, or ``stem*``) that together occur in most positive documents and hardly elsewhere."""
    where: dict[str, set[int]] = defaultdict(set)
    before: dict[str, set[str]] = defaultdict(set)
    forms: dict[str, set[str]] = defaultdict(set)
    for k, (text, label) in enumerate(samples):
        if not label:
            continue
        last = ""
        for word in WORD.findall(text.lower()):
            if word in CLOSED:
                last = word
                continue
            for p in (word, *(word[:n] + "*" for n in range(5, min(9, len(word) + 1)))):
                where[p].add(k)
                if len(before[p]) < MANY_BEFORE:  # more would not change the tests below
                    before[p].add(last)
                if p[-1] == "*" and len(forms[p]) < MANY_FORMS:
                    forms[p].add(word)
            last = word
    # as many different words before a pattern as half of its documents, or it is a passage that was copied
    good = {p for p, at in where.items() if len(at) >= least and len(before[p]) >= max(3, min(MANY_BEFORE, len(at) // 2)) and (p[-1] != "*" or len(forms[p]) >= MANY_FORMS)}
    clean: Counter = Counter()
    for text, label in samples:
        if not label:
            for word in set(WORD.findall(text.lower())):
                clean.update({p for p in (word, *(word[:n] + "*" for n in range(5, min(9, len(word) + 1)))) if p in good})
    odds = {p: math.log((len(where[p]) + 0.5) / (pos + 1) * (neg + 1) / (clean[p] + 0.5)) for p in good}
    good = {p for p in good if odds[p] >= 2.5 and clean[p] <= 0.02 * len(where[p]) * neg / pos}
    out: dict[str, float] = {}
    left = set().union(*(where[p] for p in good)) if good else set()
    # words that stand in the sample often enough are taken whatever else covers their documents
    for p in sorted(good, key=lambda p: (-len(where[p]), -len(p), p)):
        if p[-1] == "*" and any(q != p and q[-1] == "*" and (q.startswith(p[:-1]) or p.startswith(q[:-1])) and q in out for q in out):
            continue
        if p[-1] != "*" and any(q[-1] == "*" and p.startswith(q[:-1]) for q in out):
            continue
        if where[p] & left or len(where[p]) >= 4 * least:
            out[p] = min(3.0, odds[p] / 2.5)
            left -= where[p]
    return out


def fit(grammar: Grammar, samples: list[tuple[str, int]], rounds: int = 30) -> None:
    """Bias and slope by Newton steps on the logistic loss, with a weak pull towards the defaults."""
    machine = Machine(grammar)
    xs = [(machine.total(machine.clauses(text)), label) for text, label in samples]
    a, b, pull = grammar.bias, grammar.slope, 0.5
    for _ in range(rounds):
        ga, gb, haa, hab, hbb = pull * (a + 3), pull * (b - 2), pull, 0.0, pull
        for x, y in xs:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            d, w = p - y, p * (1 - p)
            ga, gb, haa, hab, hbb = ga + d, gb + d * x, haa + w, hab + w * x, hbb + w * x * x
        det = haa * hbb - hab * hab
        if det < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, max(0.05, b - db)
        if abs(da) + abs(db) < 1e-6:
            break
    grammar.bias, grammar.slope = a, b


def train(docs: DataFrame, labels: DataFrame, learn: Column, *, positives: int = 1500, negatives: int = 3000, max_bytes: int = 50_000) -> Grammar:
    """A grammar from docs (doc_id, text) and labels (doc_id, toxic); ``learn`` chooses rows of labels."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    counts = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(2), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    share = F.when(F.col("toxic") == 1, min(1.0, positives / max(1, counts.get(1, 0)))).otherwise(min(1.0, negatives / max(1, counts.get(0, 0))))
    chosen = usable.filter(hashed < share)  # about positives + negatives rows, whatever the input
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.octet_length("text") <= max_bytes)
    got = text.join(F.broadcast(chosen), "doc_id").select("text", "toxic").toLocalIterator()
    return learned(sorted((r.text, r.toxic) for r in got))


def assess(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score, predicted, number of scoring clauses and the strongest one, of every document."""
    narrow(docs.sparkSession)

    @quiet
    def run(batches):
        machine = Machine(grammar)

        def rows():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = machine.clauses(text or "")
                    score = machine.score(found)
                    best = max(found)[1].strip() if found else None
                    yield (doc, score, int(score >= 0.5), len(found), best), 64 + len(best or "")

        yield from sized(rows(), ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels that are not held out (crc32(doc_id) mod 5 is not 0), then score all documents."""
    held = remainder("doc_id", 5) == 0
    return assess(docs, train(docs, labels, ~held)).select("doc_id", held.alias("held_out"), "score", "predicted", "clauses", "strongest")
