"""Histogram gradient boosting and extremely randomised trees, for many models at once.

Rows belong to units (a scope, a head, a direction): each unit gets a model of its own, and all units grow in the same
jobs. Features are cut into bins once; a row is a byte a feature. Growing takes one aggregation a level: tasks send
each row down the trees made so far, add up counts, gradients and second derivatives by node, feature and bin, and
Spark sums those; the driver sees histograms, never rows. Sums are whole numbers (gradients in units of 2^-24), so
trees do not depend on how rows are dealt.

A boosted tree grows best first to a number of leaves: after each pass the order is played through as far as histograms are known,
and all leaves that may still split get theirs in the next pass. A randomised tree grows by depth; a node draws some features, and of
each one threshold between the least and the largest value it holds, and takes the best. Values missing are a bin of their
own that goes to the side where the gain is larger.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import written

SCALE = float(1 << 24)
#: Least sum of second derivatives on a side.
LEAST_HESSIAN = 1e-3
#: Rows of one task of a pass: passes are many, so small tables take few tasks.
TASK_ROWS = 50_000
#: Trees after which the scores so far are written.
EVERY = 12


@dataclass(frozen=True)
class Boosting:
    """48 trees of 15 leaves, rate 0.08, L2 0.01; 20 rows a leaf."""

    loss: str = "log_loss"  # or squared_error
    trees: int = 48
    leaves: int = 15
    rate: float = 0.08
    l2: float = 0.01
    least: int = 20


@dataclass(frozen=True)
class Randomised:
    """48 trees of depth 8, 30 rows a leaf."""

    trees: int = 48
    depth: int = 8
    least: int = 30
    seed: int = 7


@dataclass
class Tree:
    """Nodes by number: feature and largest bin that goes left (-1: a leaf), whether missing goes left, children, value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, at: int, feature: int, bin_: int, missing: bool) -> tuple[int, int]:
        self.feature[at], self.bin[at], self.missing[at] = feature, bin_, missing
        for side in (self.left, self.right):
            side[at] = len(self.feature)
            for column, x in ((self.feature, -1), (self.bin, 0), (self.missing, True), (self.left, -1), (self.right, -1), (self.value, 0.0)):
                column.append(x)
        return self.left[at], self.right[at]

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, bin_, missing, left, right = (np.array(c) for c in (self.feature, self.bin, self.missing, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        while True:
            live = np.flatnonzero(feature[at] >= 0)
            if not len(live):
                return at
            n = at[live]
            b = x[live, feature[n]]
            down = np.where(b == 0, missing[n], b <= bin_[n])
            at[live] = np.where(down, left[n], right[n])

    def values(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(x)]


@dataclass
class Model:
    base: float
    trees: list[Tree]
    loss: str

    def predicted(self, x: np.ndarray) -> np.ndarray:
        if self.loss == "mean":
            return np.mean([t.values(x) for t in self.trees], axis=0)
        score = self.base + np.sum([t.values(x) for t in self.trees], axis=0)
        return 1.0 / (1.0 + np.exp(-score)) if self.loss == "log_loss" else score


def cut_points(rows: DataFrame, features: list[str], bins: int = 64) -> list[list[float]]:
    """Values between bins, from quantiles of all rows: at most ``bins`` - 1 a feature, in one aggregation."""
    got = rows.agg(*(F.percentile_approx(F.col(c).cast("double"), [k / bins for k in range(1, bins)], 10_000).alias(f"q{k}") for k, c in enumerate(features))).first()
    return [sorted({float(v) for v in got[f"q{k}"] or [] if math.isfinite(v)}) for k in range(len(features))]


def bins_of(values: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Bins of a matrix: 0 where a value is missing, else 1 and how many cut points lie below it."""
    out = np.zeros(values.shape, np.uint8)
    for k, c in enumerate(cuts):
        v = values[:, k]
        out[:, k] = np.where(np.isnan(v), 0, 1 + np.searchsorted(np.array(c), v, side="left"))
    return out


def binned(rows: DataFrame, features: list[str], cuts: list[list[float]], keep: list[str]) -> DataFrame:
    """The columns to keep, and ``bins``: a byte a feature."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not len(batch):
                continue
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[len(keep) :]], 1)
            b = bins_of(values, cuts)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([r.tobytes() for r in b], pa.binary())], names=[*keep, "bins"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, *(F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(features))).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "bins binary"]))


def matrix(column: pa.Array, p: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, p)


def derivatives(loss: str, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives in whole numbers."""
    if loss == "log_loss":
        p = 1.0 / (1.0 + np.exp(-score))
        g, h = p - y, p * (1.0 - p)
    elif loss == "squared_error":
        g, h = score - y, np.ones(len(y))
    else:
        g, h = y, np.ones(len(y))
    return np.round(g * SCALE), np.round(h * SCALE)


@dataclass
class Wanted:
    """Histograms asked for: a unit's tree so far, and which of its nodes with which features."""

    unit: int
    tree: Tree
    nodes: dict[int, list[int]]


def histograms(rows: DataFrame, wanted: list[Wanted], recent: dict[int, list[Tree]], loss: str, p: int, bins: int) -> list[dict[int, np.ndarray]]:
    """For each entry of wanted, by node: counts, gradients and second derivatives [3, p, bins], over all rows. One aggregation."""
    slots, total = [], 0
    for w in wanted:
        slots.append({n: total + k for k, n in enumerate(w.nodes)})
        total += len(w.nodes)
    by_unit: dict[int, list[int]] = {}
    for k, w in enumerate(wanted):
        by_unit.setdefault(w.unit, []).append(k)

    def run(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}  # of a node: [3, p, bins]
        for batch in batches:
            unit, x = batch.column(0).to_numpy(zero_copy_only=False), None
            y, base = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            x = matrix(batch.column(3), p) if len(batch) else np.zeros((0, p), np.uint8)
            for u in np.unique(unit).tolist():
                if u not in by_unit:
                    continue
                rows_ = unit == u
                xu = x[rows_]
                score = base[rows_] + sum((t.values(xu) for t in recent.get(u, [])), np.zeros(len(xu)))
                g, h = derivatives(loss, y[rows_], score)
                for k in by_unit[u]:
                    at = wanted[k].tree.nodes(xu)
                    for node, some in wanted[k].nodes.items():
                        mine = np.flatnonzero(at == node)
                        if not len(mine):
                            continue
                        held = sums.setdefault(slots[k][node], np.zeros((3, p, bins)))
                        cell = (xu[np.ix_(mine, some)] + np.arange(len(some)) * bins).ravel()
                        for j, weight in enumerate((None, g[mine], h[mine])):
                            got = np.bincount(cell, None if weight is None else np.repeat(weight, len(some)), len(some) * bins)
                            held[j, some] += got.reshape(-1, bins)
        for slot, held in sums.items():
            cell = np.flatnonzero(held[0].reshape(-1))
            flat = held.reshape(3, -1)[:, cell].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot * p * bins + cell), *(pa.array(v) for v in flat)], names=["cell", "n", "g", "h"])

    got = rows.select("unit", "y", "score", "bins").mapInArrow(run, "cell long, n long, g long, h long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    table = np.zeros((3, total * p * bins), np.int64)
    cell = got.column("cell").to_numpy()
    for k, name in enumerate(("n", "g", "h")):
        table[k, cell] = got.column(name).to_numpy()
    table = table.reshape(3, total, p, bins)
    return [{n: table[:, s] for n, s in of.items()} for of in slots]


@dataclass(order=True)
class Split:
    gain: float
    feature: int
    bin: int
    missing: bool


def best_split(hist: np.ndarray, l2: float, least: int, features: list[int], some_bins: dict[int, list[int]] | None = None) -> Split | None:
    """The split of the largest gain; of equal ones the first feature, the smallest bin, missing to the left. some_bins: which bins may be
    the last of the left side."""
    n, g, h = hist[0][features], hist[1][features] / SCALE, hist[2][features] / SCALE
    total_n, total_g, total_h = (v.sum(1)[:, None, None] for v in (n, g, h))
    sides = []  # of each feature: missing to the left, to the right
    for v in (n, g, h):
        known = v.copy()
        known[:, 0] = 0
        sides.append(np.cumsum(np.stack([v, known], 1), 2))
    left_n, left_g, left_h = sides
    right_n, right_g, right_h = total_n - left_n, total_g - left_g, total_h - left_h
    ok = (left_n >= least) & (right_n >= least) & (left_h >= LEAST_HESSIAN) & (right_h >= LEAST_HESSIAN)
    ok[:, 1] &= n[:, :1] > 0
    ok[:, 1, 0] = False
    if some_bins is not None:
        may = np.zeros((len(features), 1, n.shape[1]), bool)
        for k, f in enumerate(features):
            may[k, 0, some_bins[f]] = True
        ok &= may
    if not ok.any():
        return None
    gain = np.where(ok, left_g**2 / np.where(ok, left_h + l2, 1) + right_g**2 / np.where(ok, right_h + l2, 1) - total_g**2 / np.maximum(total_h + l2, 1e-300), -np.inf)
    k, side, bin_ = np.unravel_index(int(gain.argmax()), gain.shape)
    return Split(float(gain[k, side, bin_]), features[k], int(bin_), side == 0) if gain[k, side, bin_] > 1e-10 else None


def sums_of(hist: np.ndarray) -> tuple[float, float]:
    f = int(hist[0].sum(1).argmax())
    return hist[1, f].sum() / SCALE, hist[2, f].sum() / SCALE


class Growing:
    """A tree that grows best first, as far as its histograms are known."""

    def __init__(self, how: Boosting, p: int):
        self.how, self.features, self.hist, self.done = how, list(range(p)), {}, False
        self.tree = Tree()  # with every split that may be needed
        self.best: dict[int, Split | None] = {}

    def wanted(self) -> dict[int, list[int]]:
        return {n: self.features for n in range(len(self.tree.feature)) if n not in self.hist}

    def take(self, hist: dict[int, np.ndarray]) -> None:
        for n, h in hist.items():
            self.hist[n] = h
            self.best[n] = best_split(h, self.how.l2, self.how.least, self.features)
        final, chosen, missing = Tree(), {0: 0}, []
        heap = [(-self.best[0].gain, 0)] if self.best[0] else []
        leaves = 1
        while heap and leaves < self.how.leaves:
            _, n = heapq.heappop(heap)
            s = self.best[n]
            if self.tree.feature[n] < 0:  # its children are unknown, and they may come next
                missing.append(n)
                missing += [m for _, m in heap if self.tree.feature[m] < 0][: self.how.leaves - leaves - 1]
                break
            a, b = final.split(chosen[n], s.feature, s.bin, s.missing)
            leaves += 1
            for child, to in ((self.tree.left[n], a), (self.tree.right[n], b)):
                chosen[child] = to
                if self.best[child]:
                    heapq.heappush(heap, (-self.best[child].gain, child))
        if missing:
            for n in missing:
                s = self.best[n]
                self.tree.split(n, s.feature, s.bin, s.missing)
            return
        for n, at in chosen.items():
            g, h = sums_of(self.hist[n])
            final.value[at] = -self.how.rate * g / (h + self.how.l2) if h + self.how.l2 > 0 else 0.0
        self.final, self.done = final, True


def boosted(rows: DataFrame, p: int, bins: int, how: Boosting) -> dict[int, Model]:
    """A boosted model of each unit. rows: unit (int), y (double), bins."""
    stats = {r.unit: (r.n, r.s) for r in rows.groupBy("unit").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()}  # a row a unit
    mean = {u: s / n for u, (n, s) in stats.items()}
    base = {u: (math.log(m / (1 - m)) if 0 < m < 1 else math.copysign(20.0, m - 0.5)) if how.loss == "log_loss" else m for u, m in mean.items()}
    models = {u: Model(base[u], [], how.loss) for u in stats}
    start = F.element_at(F.create_map(*(F.lit(x) for u in base for x in (int(u), float(base[u])))), F.col("unit")) if base else F.lit(0.0)
    tasks = -(-sum(n for n, _ in stats.values()) // TASK_ROWS) or 1
    table = written(rows.select("unit", "y", start.alias("score"), "bins").repartition(tasks), "boosting")
    recent: dict[int, list[Tree]] = {u: [] for u in stats}
    for k in range(how.trees if stats else 0):
        growing = {u: Growing(how, p) for u in sorted(stats)}
        while live := [u for u in growing if not growing[u].done]:
            found = histograms(table, [Wanted(u, growing[u].tree, growing[u].wanted()) for u in live], recent, how.loss, p, bins)
            for u, h in zip(live, found):
                growing[u].take(h)
        for u, g in growing.items():
            models[u].trees.append(g.final)
            recent[u].append(g.final)
        if (k + 1) % EVERY == 0 and k + 1 < how.trees:
            table = written(scored(table, recent, p), "boosting")
            recent = {u: [] for u in stats}
    return models


def scored(table: DataFrame, recent: dict[int, list[Tree]], p: int) -> DataFrame:
    """The rows with the values of recent trees in their score."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not len(batch):
                continue
            unit, score, x = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).copy(), matrix(batch.column(3), p)
            for u in np.unique(unit).tolist():
                for t in recent.get(u, []):
                    score[unit == u] += t.values(x[unit == u])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), batch.column(3)], names=["unit", "y", "score", "bins"])

    return table.mapInArrow(run, "unit int, y double, score double, bins binary")


def drawn(seed: int, *of) -> float:
    """A number in [0, 1) that depends on its arguments alone."""
    return int.from_bytes(hashlib.blake2b(repr((seed, *of)).encode(), digest_size=7).digest(), "big") / (1 << 56)


def some_features(seed: int, unit: int, tree: int, node: int, p: int) -> list[int]:
    k = max(1, int(math.sqrt(p)))
    return sorted(sorted(range(p), key=lambda f: drawn(seed, unit, tree, node, f))[:k])


def random_bins(hist: np.ndarray, features: list[int], seed: int, *of) -> dict[int, list[int]]:
    """Of each feature one bin, drawn evenly from those between the least and the largest that the node holds."""
    out = {}
    for f in features:
        held = np.flatnonzero(hist[0, f, 1:]) + 1
        out[f] = [int(held[0] + drawn(seed, *of, f, "bin") * (held[-1] - held[0]))] if len(held) > 1 else []
    return out


def randomised(rows: DataFrame, p: int, bins: int, how: Randomised) -> dict[int, Model]:
    """A forest of extremely randomised trees of each unit, all trees of all units a level at a time. Its prediction is the mean of leaves' means."""
    sizes = {r.unit: r["count"] for r in rows.groupBy("unit").count().collect()}  # a row a unit
    units, tasks = sorted(sizes), -(-sum(sizes.values()) // TASK_ROWS) or 1
    table = written(rows.select("unit", "y", F.lit(0.0).alias("score"), "bins").repartition(tasks), "randomised")
    forest = {(u, t): Tree() for u in units for t in range(how.trees)}
    frontier = {key: [0] for key in forest}
    for depth in range(how.depth + 1):
        keys = [k for k in sorted(forest) if frontier[k]]
        if not keys:
            break
        asked = {k: {n: some_features(how.seed, *k, n, p) if depth < how.depth else [0] for n in frontier[k]} for k in keys}
        found = histograms(table, [Wanted(k[0], forest[k], asked[k]) for k in keys], {}, "mean", p, bins)
        for k, hists in zip(keys, found):
            nxt = []
            for n, h in hists.items():
                g, w = sums_of(h)
                forest[k].value[n] = g / w if w else 0.0
                s = best_split(h, 0.0, how.least, asked[k][n], random_bins(h, asked[k][n], how.seed, *k, n)) if depth < how.depth else None
                if s:
                    nxt += forest[k].split(n, s.feature, s.bin, s.missing)
            frontier[k] = nxt
    return {u: Model(0.0, [forest[u, t] for t in range(how.trees)], "mean") for u in units}


def predicted(rows: DataFrame, models: dict[int, Model], p: int, keep: list[str]) -> DataFrame:
    """The columns to keep of rows (unit, bins, ...), and ``prediction`` by the unit's model (null without one)."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not len(batch):
                continue
            unit, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1), p)
            out = np.full(len(unit), np.nan)
            for u in np.unique(unit).tolist():
                if u in models:
                    out[unit == u] = models[u].predicted(x[unit == u])
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(out, from_pandas=True)], names=[*keep, "prediction"])

    return rows.select("unit", "bins", *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "prediction double"]))
