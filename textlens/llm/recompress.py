"""Locally consistent naming of word runs and pairs (recompression).

A sequence of symbols is shortened in rounds. A run round names each maximal
run of 2 to ``RUN`` equal symbols. A pair round deals the symbols to a left
and a right side by a hash and names each pair of a left symbol followed by a
right one; such pairs can't overlap. A name depends on nothing but what it
stands for, so it is the same in every document of the corpus, and what a
symbol becomes depends on its direct neighbours only. Equal stretches of
words therefore get equal symbols inside, except near their ends: a run round
can spoil ``RUN`` symbols at either end and a pair round one more.

``Schedule`` follows from this: for windows of a given number of words it
gives the rounds, the words at either end that may differ (``margin``) and
the longest symbol; what is left between the margins always holds a whole
block, a symbol with its followers up to ``block`` words. The block of the
least hash that lies within a window's margins is the window's anchor: equal
windows have equal anchors at equal places.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from textlens.llm.words import Running, Words, mix

RUN = 2
_RUN, _PAIR = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


@dataclass(frozen=True)
class Schedule:
    window: int
    pairs: int
    runs: bool
    margin: int
    longest: int
    block: int


def schedule(window: int, most_pairs: int = 1) -> Schedule:
    """Rounds for a window: blocks take about a third of the words between
    the margins, and one fits there wherever symbols begin."""
    margin, longest, runs, pairs = 0, 1, False, 0

    def fits(margin, longest):
        return window - 2 * margin >= 3 * longest + (window // 4)

    if fits(RUN, RUN):
        margin, longest, runs = RUN, RUN, True
    while pairs < most_pairs and fits(margin + longest, 2 * longest):
        margin, longest, pairs = margin + longest, 2 * longest, pairs + 1
    block = max(1, (window - 2 * margin) // 3)
    while (longest - 1) + (block + longest - 1) > window - 2 * margin:
        block -= 1
    return Schedule(window, pairs, runs, margin, longest, block)


class Symbols:
    """Symbols of some rows of words: ``name``, ``start`` (word) and ``row``."""

    def __init__(self, name: np.ndarray, row: np.ndarray, plan: Schedule):
        self.words = len(name)
        self.name, self.row, self.start = name, row, np.arange(len(name))
        if plan.runs:
            self._runs()
        for _ in range(plan.pairs):
            self._pairs()
        self.end = np.append(self.start[1:], self.words)  # rows follow each other without gaps

    def _runs(self) -> None:
        n = len(self.name)
        if n < 2:
            return
        same = (self.name[1:] == self.name[:-1]) & (self.row[1:] == self.row[:-1])
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        size = np.diff(np.append(head, n))
        named = head[(size >= 2) & (size <= RUN)]
        size = size[(size >= 2) & (size <= RUN)]
        self.name = self.name.copy()
        self.name[named] = mix(self.name[named] ^ (_RUN * size.astype(np.uint64)))
        gone = np.zeros(n, bool)
        for k in range(1, RUN):
            gone[(named + k)[size > k]] = True
        self._keep(~gone)

    def _pairs(self) -> None:
        if len(self.name) < 2:
            return
        left = (mix(self.name ^ _PAIR) >> np.uint64(63)) == 0
        at = np.flatnonzero(left[:-1] & ~left[1:] & (self.row[1:] == self.row[:-1]))
        self.name = self.name.copy()
        self.name[at] = mix(self.name[at] * np.uint64(3) + mix(self.name[at + 1] ^ _PAIR))
        gone = np.zeros(len(self.name), bool)
        gone[at + 1] = True
        self._keep(~gone)

    def _keep(self, mask: np.ndarray) -> None:
        self.name, self.row, self.start = self.name[mask], self.row[mask], self.start[mask]


def anchors(w: Words, plan: Schedule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window: its first word, its anchor's name and the anchor's
    place (index of a symbol)."""
    n = np.diff(w.first)
    count = np.maximum(n - plan.window + 1, 0)
    start = np.repeat(w.first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    if not len(start):
        return start, np.zeros(0, np.uint64), start
    s = Symbols(w.hashes(), w.row, plan)
    m = len(s.name)
    last = np.searchsorted(s.end, s.start + plan.block)  # last symbol of the block that begins here
    last = np.minimum(last, m - 1)
    stop = s.end[last]
    whole = (s.row[last] == s.row) & (stop >= s.start + plan.block)
    name = np.where(whole, mix(Running(s.name).of(np.arange(m), last + 1)), np.uint64(2**64 - 1))
    stop = np.where(whole, stop, s.words + 1)
    # blocks that begin at or after the left margin and end by the right one
    owner = np.zeros(s.words + 1, np.int64)
    owner[s.start] = 1
    before = np.cumsum(owner)  # symbols that begin at or before a word
    lo = before[start + plan.margin] - (owner[start + plan.margin] == 1)
    hi = np.searchsorted(np.maximum.accumulate(np.where(whole, stop, 0)), start + plan.window - plan.margin, "right") - 1
    hi = np.maximum(hi, lo)
    # least name in each range, leftmost of ties: two overlapping power-of-two ranges
    width = hi - lo + 1
    level = np.frexp(width.astype(np.float64))[1] - 1
    best, table = np.arange(m), []
    for k in range(int(level.max()) + 1):
        table.append(best)
        far = best[np.minimum(np.arange(m) + (1 << k), m - 1)]
        best = np.where(name[far] < name[best], far, best)
    a, b = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
    for k in range(len(table)):
        at = np.flatnonzero(level == k)
        a[at] = table[k][lo[at]]
        b[at] = table[k][hi[at] - (1 << k) + 1]
    pick = np.where(name[b] < name[a], b, a)
    return start, name[pick], pick
