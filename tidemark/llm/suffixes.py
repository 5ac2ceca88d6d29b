"""A suffix array by two-stage sorting, over texts laid side by side.

Bytes are raised by one, so that 0 can end each text. A suffix smaller than its successor (type S) is
sorted directly; any other (type L) is induced: buckets of first bytes are scanned from the smallest up, and
each suffix met there puts its predecessor, where that starts with a larger byte, at the next place of
that byte's bucket. A bucket is complete when it is reached, so a scan is a few array operations. Predecessors
that start with the bucket's own byte form runs: of c..cX with X starting below c, shorter runs come
first, equal ones in the order of X.

Order is kept to a depth: suffixes that agree to it may come in any order. Of suffixes that still agree after a few
words, those with equal digests of the whole depth are sorted as one, then laid side by side.
``Suffixes.same`` compares neighbours byte for byte; should a digest ever have hidden a difference, the sort is
done again without digests.

Only the suffixes asked for, and their successors as far as the next of type S, are sorted.
"""

from __future__ import annotations

import numpy as np

#: Odd factor of the digests of words that sorting by digest rests on.
FACTOR = 0x9E3779B97F4A7C15 | 1
WORD = 8
#: Words compared before digests stand in for the rest.
PLAIN_WORDS = 3


def laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes raised by one with a 0 behind each text (and a word of 0 at the end), and where each text starts."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    out = np.frombuffer(b"\xff".join(texts) + b"\xff" * (WORD + 1), np.uint8) + np.uint8(1)  # 255, in no UTF-8, wraps to 0
    return out, starts


def running(flags: np.ndarray) -> np.ndarray:
    """For each position the first one at or after it that is flagged (or the size)."""
    at = np.where(flags, np.arange(len(flags)), len(flags))
    return np.minimum.accumulate(at[::-1])[::-1]


class Suffixes:
    def __init__(self, text: np.ndarray, wanted: np.ndarray, depth: int):
        """text: as from ``laid``; wanted: which suffixes are asked for; depth: to which order matters."""
        self.text, self.depth, self.n = text, depth, len(text) - WORD
        self.words = np.ndarray((self.n,), ">u8", text, 0, (1,)).astype(np.uint64)  # the eight bytes from each position on
        self.small = self.types()
        stop = running(self.small)
        self.needed = np.zeros(self.n, bool)
        at = np.flatnonzero(wanted[: self.n])
        edge = np.zeros(self.n + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(stop[at], self.n - 1) + 1, -1)
        self.needed = np.cumsum(edge[: self.n]) > 0
        self.wanted = wanted[: self.n]

    def types(self) -> np.ndarray:
        """Whether each suffix is smaller than its successor; equal bytes do as their successor does."""
        here, then = self.text[: self.n], self.text[1 : self.n + 1]
        decides = here != then
        decides[-1] = True
        at = running(decides)
        smaller = here < then
        smaller[-1] = True  # the last end mark
        return smaller[at]

    def sorted(self, by_digest: bool = True) -> np.ndarray:
        """The needed suffixes in order."""
        direct = self.direct(np.flatnonzero(self.needed & self.small), by_digest)
        return self.induced(direct)

    # stage one

    def direct(self, at: np.ndarray, by_digest: bool) -> np.ndarray:
        """Suffixes in order, word by word; only those that tie go on to the next word."""
        order = at[np.argsort(self.words[at], kind="stable")]
        group = self.parted(self.words[order], np.zeros(len(order), np.int64))
        for depth in range(WORD, self.depth, WORD):
            tied = self.tied(group)
            if not len(tied):
                break
            if by_digest and depth == PLAIN_WORDS * WORD:
                return self.by_leaders(order, group, tied, depth)
            self.refine(order, group, tied, depth)
        return order

    @staticmethod
    def tied(group: np.ndarray) -> np.ndarray:
        same = group[1:] == group[:-1]
        return np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))

    @staticmethod
    def parted(key: np.ndarray, group: np.ndarray, first: int = 0) -> np.ndarray:
        """Group numbers of a sorted run of (group, key)."""
        new = np.ones(len(key), np.int64)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        return first + np.cumsum(new)

    def word(self, at: np.ndarray, depth: int) -> np.ndarray:
        """The word so many bytes behind; past the end all is 0."""
        to = at + depth
        return np.where(to < self.n, self.words[np.minimum(to, self.n - 1)], 0)

    def refine(self, order: np.ndarray, group: np.ndarray, tied: np.ndarray, depth: int) -> None:
        """Sort tied suffixes by one more word within their groups, in place."""
        key = self.word(order[tied], depth)
        by = np.lexsort((key, group[tied]))
        order[tied] = order[tied][by]
        group[tied] = self.parted(key[by], group[tied][by], int(group.max()))  # fresh numbers, so no group meets an old one

    def by_leaders(self, order: np.ndarray, group: np.ndarray, tied: np.ndarray, depth: int) -> np.ndarray:
        """Go on with one suffix of each digest; its like follow it in the result."""
        at, own = order[tied], group[tied]
        digest = self.digests(at)
        by = np.lexsort((digest, own))
        tied_at, own, digest = at[by], own[by], digest[by]
        cls = self.parted(digest, own) - 1
        leads = np.flatnonzero(np.insert(cls[1:] != cls[:-1], 0, True))
        lead_order, lead_group = tied_at[leads].copy(), own[leads].copy()
        class_of = np.arange(len(leads))  # of each leader, carried along as it moves
        for d in range(depth, self.depth, WORD):
            rest = self.tied(lead_group)
            if not len(rest):
                break
            key = self.word(lead_order[rest], d)
            by = np.lexsort((key, lead_group[rest]))
            moved = rest[by]
            lead_order[rest], class_of[rest] = lead_order[moved], class_of[moved]
            lead_group[rest] = self.parted(key[by], lead_group[rest][by], int(lead_group.max()))
        place = np.empty(len(leads), np.int64)
        place[class_of] = np.arange(len(leads))
        order[tied] = tied_at[np.argsort(place[cls], kind="stable")]  # groups keep their places: leaders were sorted within them
        return order

    def digests(self, at: np.ndarray) -> np.ndarray:
        """A digest of the depth's bytes from each position on (of what is there, near the end)."""
        with np.errstate(over="ignore"):
            powers = np.full(self.n + 1, np.uint64(FACTOR))
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(self.text[: self.n] * powers[: self.n], out=sums[1:])
            end = np.minimum(at + self.depth, self.n)
            return (sums[end] - sums[at]) * powers[self.n - at]  # brought to a common power

    # stage two

    def induced(self, direct: np.ndarray) -> np.ndarray:
        """All needed suffixes in order, from those sorted directly."""
        text, large = self.text, self.needed & ~self.small
        run = self.runs(large)
        first = text[direct]
        ends = np.searchsorted(first, np.arange(257))
        queued: list[list[np.ndarray]] = [[] for _ in range(256)]
        out = []
        for byte in range(256):
            parts = []
            if queued[byte]:
                parts.append(self.spread(np.concatenate(queued[byte]), run))
            parts.append(direct[ends[byte] : ends[byte + 1]])
            bucket = np.concatenate(parts)
            if not len(bucket):
                continue
            out.append(bucket)
            before = bucket[bucket > 0] - 1
            before = before[large[before] & (text[before] > byte)]
            to = text[before]
            by = np.argsort(to, kind="stable")
            before, to = before[by], to[by]
            cuts = np.flatnonzero(to[1:] != to[:-1]) + 1
            if len(before):
                for part in np.split(before, cuts):
                    queued[text[part[0]]].append(part)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def runs(self, large: np.ndarray) -> np.ndarray:
        """How many needed large suffixes with one first byte end, without a gap, at each position."""
        text, n = self.text, self.n
        starts = np.ones(n, bool)
        starts[1:] = (text[1:n] != text[: n - 1]) | ~large[:-1]
        last = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        return np.arange(n) - last + 1

    @staticmethod
    def spread(incoming: np.ndarray, run: np.ndarray) -> np.ndarray:
        """The suffixes of a bucket that smaller buckets induce, with the runs before them."""
        long = run[incoming]
        if not len(long) or long.max() == 1:
            return incoming
        back = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
        return (np.repeat(incoming, long) - back)[np.argsort(back, kind="stable")]

    # common prefixes

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffixes at a and b agree to the depth, byte for byte (none may end before)."""
        alive = np.arange(len(a))
        for d in range(0, self.depth - WORD + 1, WORD):
            alive = alive[self.words[np.minimum(a[alive] + d, self.n - 1)] == self.words[np.minimum(b[alive] + d, self.n - 1)]]
        if self.depth % WORD:
            d = max(0, self.depth - WORD)
            if self.depth >= WORD:
                alive = alive[self.words[np.minimum(a[alive] + d, self.n - 1)] == self.words[np.minimum(b[alive] + d, self.n - 1)]]
            else:
                shift = np.uint64(8 * (WORD - self.depth))
                alive = alive[self.words[a[alive]] >> shift == self.words[b[alive]] >> shift]
        out = np.zeros(len(a), bool)
        out[alive] = True
        return out

    def repeated(self) -> np.ndarray:
        """Which of the wanted suffixes agree with another wanted one to the depth. Each must be that long."""
        order = self.sorted()
        order = order[self.wanted[order]]
        same = self.common(order[:-1], order[1:])
        if self.hidden(order, same):
            order = self.sorted(by_digest=False)
            order = order[self.wanted[order]]
            same = self.common(order[:-1], order[1:])
        out = np.zeros(self.n, bool)
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
        return out

    def hidden(self, order: np.ndarray, same: np.ndarray) -> bool:
        """Whether neighbours with equal digests differ."""
        apart = np.flatnonzero(~same)
        return bool((self.digests(order[apart]) == self.digests(order[apart + 1])).any())
