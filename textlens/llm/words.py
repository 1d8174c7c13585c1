"""Words of whole Arrow text batches as numpy arrays.

A batch is handled as one byte buffer: a table says which bytes belong to
words, word spans follow from where that changes, and every word gets a
64-bit polynomial hash from one running sum over the buffer. Nothing loops
over words in Python. Hashes only propose equalities; whoever needs exact
ones compares the bytes (``same``) or uses a digest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes of text that are worked on at once: some 60 bytes of memory for each.
CHUNK = 512 << 10


def byte_class(pattern: str) -> np.ndarray:
    """256 booleans for the bytes of words: ``blank`` splits at the blanks
    U+0020 and U+0009 to U+000D only; ``alnum`` keeps digits, lower-case
    ASCII letters and everything that isn't ASCII."""
    t = np.ones(256, bool)
    if pattern == "blank":
        t[[0x20, *range(0x09, 0x0E)]] = False
    elif pattern == "alnum":
        t[:0x80] = False
        t[0x30:0x3A] = t[0x61:0x7B] = True
    else:
        raise ValueError(pattern)
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@lru_cache(maxsize=1)
def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    up[0] = 1
    inverse = np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n``."""
    return _powers_to(max(2 * CHUNK, 1 << int(n).bit_length()))


class Running:
    """Hash of any slice of a sequence of 64-bit symbols in constant time."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * up[:n], out=self.sums[1:], dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (nulls as empty) and its row offsets."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]: offsets[-1]]
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about ``size`` bytes (a longer row alone)."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, min(end, n)
        row = end


class Words:
    """The words of rows ``lo`` to ``hi`` of a buffer: ``start`` and ``end``
    (bytes in ``data``), ``row`` (from 0), ``first`` (index of each row's
    first word, one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, table: np.ndarray, lower: bool):
        base = offsets[lo]
        self.data = data[base: offsets[hi]]
        if lower:
            self.data = LOWER[self.data]
        self.offsets = offsets[lo: hi + 1] - base
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = table[self.data]
        change = np.diff(inside)
        starts, ends = change == 1, change == -1
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(self.data))]
        split = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # a row ends inside a word
        starts[split] = ends[split] = True
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(hi - lo), np.diff(self.first))
        self.fresh = 0  # words that the piece before has too
        self.tail = 0  # words that the next piece has too
        self.before = 0  # words of the row before this piece

    def hashes(self, most: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first ``most`` bytes."""
        if not hasattr(self, "_running"):
            self._running = Running(_BYTE[self.data])
        end = self.end if most is None else np.minimum(self.end, self.start + most)
        return mix(self._running.of(self.start, end))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]: self.end[i]].tobytes()


def batch_words(texts: pa.Array, table: np.ndarray, lower: bool, size: int = CHUNK,
                overlap: int = 0) -> Iterator[tuple[int, int, Words]]:
    """Words of runs of rows. A row of more than twice ``size`` bytes comes in
    several pieces that share ``overlap`` words, so that memory stays bounded
    and every ``overlap`` + 1 consecutive words are in exactly one piece."""
    data, offsets = buffer_of(texts)
    for lo, hi in chunks(offsets, size):
        if offsets[hi] - offsets[lo] > 2 * size and hi - lo == 1:
            for w in _pieces(data, int(offsets[lo]), int(offsets[hi]), table, lower, size, overlap):
                yield lo, hi, w
        else:
            yield lo, hi, Words(data, offsets, lo, hi, table, lower)


def _pieces(data: np.ndarray, at: int, end: int, table: np.ndarray, lower: bool, size: int, overlap: int) -> Iterator[Words]:
    inside = table[LOWER] if lower else table
    fresh = before = 0
    while True:
        want = size
        while True:
            cut = min(at + want, end)
            while cut < end and inside[data[cut]]:  # to the end of the word
                ahead = np.flatnonzero(~inside[data[cut: min(cut + 4096, end)]])
                cut = cut + int(ahead[0]) if len(ahead) else min(cut + 4096, end)
            w = Words(data, np.array([at, cut]), 0, 1, table, lower)
            if cut == end or len(w.start) > overlap:
                break
            want *= 2  # of very long words a larger piece is needed
        w.fresh, w.before, w.tail = fresh, before, overlap if cut < end else 0
        yield w
        if cut == end:
            return
        n = len(w.start)
        at = at + int(w.start[n - overlap]) if overlap else cut
        before += n - overlap
        fresh = overlap


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def split_pieces(text: bytes, size: int = CHUNK) -> Iterator[list[bytes]]:
    """The blank-separated words of a text, some ``size`` bytes at a time."""
    at = 0
    while at < len(text):
        found = _BLANK.search(text, at + size) if len(text) - at > size else None
        cut = found.start() if found else len(text)
        yield text[at:cut].split()
        at = cut
