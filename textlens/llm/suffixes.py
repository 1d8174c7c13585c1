"""Suffix arrays by induced sorting, in numpy.

The steps are those of induced sorting (Nong, Zhang and Chan, 2009): suffixes
are classified as larger or smaller than their successor; the substrings
between leftmost smaller suffixes are sorted by inducing once and named; the
string of names is sorted recursively, the same way at every level; inducing
again from that order gives the array.

Inducing goes through the alphabet in ranges of symbols that hold about
equally many suffixes, so a pass takes as many array operations however large
the alphabet is. A suffix waits for its range, in the order in which its
successor was placed; one whose successor is in the same range is ordered by
its symbol and its successor's rank. Common prefixes are found in text order
(permuted), where most suffixes carry over the length of the one before them.
"""

from __future__ import annotations

import numpy as np

MOST_RANGES, RANGE_SIZE = 512, 512


def classify(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successor (and for the last one,
    a sentinel that is smaller than every other symbol)."""
    head = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
    smaller = np.ones(len(head), bool)
    smaller[:-1] = s[head[:-1]] < s[head[1:]]
    return np.repeat(smaller, np.diff(np.append(head, len(s))))


def _ranges(s: np.ndarray, sigma: int) -> np.ndarray:
    """First symbols of the ranges, and ``sigma``."""
    n = min(MOST_RANGES, len(s) // RANGE_SIZE + 1)
    if sigma <= n:
        return np.arange(sigma + 1)
    held = np.cumsum(np.bincount(s, minlength=sigma))
    cut = np.searchsorted(held, np.arange(1, n) * (held[-1] / n)) + 1
    return np.unique(np.concatenate([[0], cut[cut < sigma], [sigma]]))


class _Queues:
    """Suffixes that wait for their range, in order of arrival."""

    def __init__(self, s: np.ndarray, bounds: np.ndarray):
        self.s, self.parts = s, [[] for _ in range(len(bounds) - 1)]
        self.range_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def add(self, p: np.ndarray) -> None:
        if len(p):
            r = self.range_of[self.s[p]]
            o = np.argsort(r, kind="stable")
            p, r = p[o], r[o]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            at = 0
            for k, end in zip(r[np.concatenate([[0], cut])].tolist(), [*cut.tolist(), len(p)], strict=True):
                self.parts[k].append(p[at:end])
                at = end

    def take(self, k: int) -> np.ndarray:
        got, self.parts[k] = self.parts[k], None
        return np.concatenate(got) if got else np.zeros(0, np.int64)


def _refine(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each row of ``keys`` (the first decides first; equal rows share
    one), and how many ranks there are."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, int(new.sum())


def _place(s: np.ndarray, arrived: np.ndarray, others: np.ndarray, inside, sign: int, one: bool,
           slot: np.ndarray) -> np.ndarray:
    """The suffixes of one kind in a range, and ``others`` of the other kind,
    in order (``sign`` -1: from the largest). ``arrived`` have their successor
    in a range done before, ``inside`` gives the predecessors that are of the
    kind and range, ``one`` tells that the range has one symbol, ``slot`` is
    room for a number per suffix."""
    waves, last = [], np.concatenate([arrived, others])
    while len(last := inside(last)):
        waves.append(last)
    if one:
        return np.concatenate([arrived, *waves, others])
    p = np.concatenate([arrived, others, *waves])
    n, known = len(p), len(arrived) + len(others)
    slot[p] = np.arange(n)
    other = np.zeros(n, np.int64)
    other[len(arrived): known] = 1
    first = np.minimum(np.arange(n), known)  # those with the successor inside come behind, as equals
    rank, distinct = _refine(sign * s[p].astype(np.int64), other, first)
    jump = np.full(n, -1)
    jump[known:] = slot[p[known:] + 1]
    while distinct < n:  # each round doubles how far along the successors is compared
        rank, distinct = _refine(rank, np.where(jump >= 0, rank[jump], -1))
        jump = np.where(jump >= 0, jump[jump], -1)
    out = np.empty_like(p)
    out[rank] = p
    return out


def induce(s: np.ndarray, small: np.ndarray, leftmost: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, from the leftmost smaller ones in order."""
    bounds, slot = _ranges(s, sigma), np.empty(len(s), np.int64)

    def before(p, kind):
        p = p[p > 0] - 1
        return p[small[p] == kind]

    def inside(lo, hi, kind):
        def run(p):
            p = before(p, kind)
            return p[(s[p] >= lo) & (s[p] < hi)]
        return run

    ends = list(enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)))
    seeds, queues, larger = _Queues(s, bounds), _Queues(s, bounds), []
    seeds.add(leftmost)
    for k, (lo, hi) in ends:  # ascending: each suffix places its larger predecessor
        p = _place(s, queues.take(k), seeds.take(k), inside(lo, hi, False), 1, hi - lo == 1, slot)
        larger.append(p[~small[p]])
        p = before(p, False)
        queues.add(p[s[p] >= hi])
    queues, out = _Queues(s, bounds), []
    for k, (lo, hi) in reversed(ends):  # descending, from the end: the smaller ones
        p = _place(s, queues.take(k), larger[k][::-1], inside(lo, hi, True), -1, hi - lo == 1, slot)
        out.append(p)
        p = before(p, True)
        queues.add(p[s[p] < lo])
    return np.concatenate([*out, [len(s) - 1]])[::-1]


def _names(s: np.ndarray, ordered: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rank of each substring (start in ``ordered``, symbols in ``length``);
    equal neighbours share it."""
    a, b = ordered[:-1], ordered[1:]
    at = np.flatnonzero(length[1:] == length[:-1])
    same = np.zeros(len(ordered), bool)
    k = 0
    while len(at):
        at = at[s[a[at] + k] == s[b[at] + k]]
        k += 1
        over = length[at] <= k
        same[at[over] + 1] = True
        at = at[~over]
    return np.cumsum(~same) - 1


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Suffixes of ``s`` in order; the last symbol is 0 and occurs once."""
    if len(s) < 3:
        return np.arange(len(s))[::-1]
    small = classify(s)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(leftmost) < 2:
        return induce(s, small, leftmost, sigma)
    flag = np.zeros(len(s), bool)
    flag[leftmost] = True
    first = induce(s, small, leftmost, sigma)
    ordered = first[flag[first]]
    size = np.zeros(len(s), np.int64)
    size[leftmost] = np.append(np.diff(leftmost) + 1, 1)
    name = np.zeros(len(s), np.int64)
    name[ordered] = _names(s, ordered, size[ordered])
    top = int(name[ordered[-1]])
    if top + 1 < len(leftmost):  # the sentinel's name is 0 and occurs once
        ordered = leftmost[suffix_array(name[leftmost], top + 1)]
    return induce(s, small, ordered, sigma)


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position of ``s`` (16-bit symbols, as for ``suffix_array``), how
    many symbols its suffix shares with the one before it in ``order`` (0 for
    the first). If the symbols before the two are equal, those suffixes are
    neighbours as well and the length is the one found there less 1; only the
    others are compared, four symbols at a time."""
    n = len(s)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    carried = (here > 0) & (before > 0) & (s[here - 1] == s[np.maximum(before - 1, 0)])
    padded = np.concatenate([s, np.zeros(4, np.uint16)]).astype("<u2")
    four = np.ndarray((n,), "<u8", buffer=padded, strides=(2,))
    length = np.zeros(n, np.int64)
    i = np.flatnonzero(~carried & (before >= 0))
    k = 0
    while len(i):
        x = four[i + k] ^ four[before[i] + k]
        length[i] = k + sum(((x & np.uint64((1 << b) - 1)) == 0).astype(np.int64) for b in (16, 32, 48, 64))
        i = i[x == 0]
        k += 4
    last = np.maximum.accumulate(np.where(carried, 0, here))
    return length[last] - (here - last)
