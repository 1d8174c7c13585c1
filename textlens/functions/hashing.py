"""Hashed terms of whole Arrow batches of texts: tokens, n-gram windows, bucket
hash and run lengths as in ``functions.text`` (``tokens``, ``ngrams``, ``bucket_of``,
``sorted_buckets``, ``run_lengths``), some megabytes of text at a time. As
expressions inside higher-order functions, which Spark interprets value by
value, the same terms took several times the CPU.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20  # text hashed at once
BLOCKS = 16384         # grams hashed at once: stay in the cache
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_SINES = [np.uint32(int(abs(np.sin(i + 1.0)) * 2**32)) for i in range(64)]
_TURNS = [[np.uint32(x) for x in r] for r in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))]
_KEPT = np.array([0, 0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)  # by bytes left, from -1 to 4
_END = np.array([0, 0x80, 0x8000, 0x800000, 0x80000000, 0], np.uint32)
_TERM = pa.struct([("bucket", pa.int64()), ("tf", pa.int64())])


def _slices(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``SLICE_BYTES``, one row at least."""
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
        yield lo, hi
        lo = hi


def _token_lists(text: pa.Array) -> pa.Array:
    """Java's ``split(" ")``: "" has one empty token, a text of spaces none."""
    words = pc.split_pattern(pc.utf8_rtrim(text, characters=" "), " ")
    none = pc.and_(pc.equal(pc.utf8_rtrim(text, characters=" "), ""), pc.not_equal(text, ""))
    return pc.if_else(none, pa.scalar([], words.type), words) if pc.any(none).as_py() else words


def _grams(words: pa.Array, n: int) -> tuple[np.ndarray, pa.Array]:
    """Row and text of each n-gram of lists of tokens."""
    size = np.nan_to_num(pc.list_value_length(words).to_numpy(zero_copy_only=False)).astype(np.int64)
    row, flat = np.repeat(np.arange(len(size)), size), words.flatten()
    if n == 1:
        return row, flat
    m = max(0, len(flat) - n + 1)
    joined = pc.binary_join_element_wise(*[flat.slice(k, m) for k in range(n)], "")
    inside = row[:m] == row[n - 1:] if m else np.zeros(0, bool)
    short = np.flatnonzero((size > 0) & (size < n))
    whole = pc.binary_join(words.take(pa.array(short)), "")
    return np.concatenate([row[:m][inside], short]), pa.concat_arrays([joined.filter(pa.array(inside)), whole])


def _one_block(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """First 32 bits of the MD5 of strings of up to 55 bytes (one MD5 block),
    all strings at once; ``data`` goes on for 64 bytes behind the last."""
    n, longest = len(size), int(size.max(initial=0))
    words = longest // 4 + 1
    taken = np.ndarray((len(data) - 63,), f"V{4 * words}", data, strides=(1,))[start].view("<u4").reshape(n, words)
    m = {14: (size * 8).astype(np.uint32)}
    for k in range(words):
        left = np.clip(size - 4 * k, -1, 4) + 1
        m[k] = (taken[:, k] & _KEPT[left]) | _END[left]
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _SINES[i]
        if g in m:  # the other words are 0
            f += m[g]
        turn = _TURNS[i // 16][i % 4]
        high = f << turn
        f >>= np.uint32(32) - turn
        high |= f
        high += b
        a, d, c, b = d, c, b, high
    return (a + _START[0]).byteswap()


def _hashes(grams: pa.Array) -> np.ndarray:
    """First 32 bits of each gram's MD5."""
    wide = pa.types.is_large_string(grams.type)
    _, ends, raw = grams.buffers()
    n = len(grams)
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[grams.offset:grams.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8)[:ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    data = np.concatenate([data, np.zeros(64, np.uint8)])
    start, size = ends[:-1], np.diff(ends)
    out = np.empty(n, np.int64)
    for lo in range(0, n, BLOCKS):
        part = slice(lo, lo + BLOCKS)
        fits = size[part] <= 55
        if fits.all():
            out[part] = _one_block(data, start[part], size[part])
            continue
        at = np.arange(lo, min(lo + BLOCKS, n))
        out[at[fits]] = _one_block(data, start[part][fits], size[part][fits])
        out[at[~fits]] = [int.from_bytes(md5(data[a:z], usedforsecurity=False).digest()[:4], "big")
                          for a, z in zip(start[part][~fits], ends[1:][part][~fits], strict=True)]
    return out


def _runs(row: np.ndarray, bucket: np.ndarray, n_rows: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each row, bucket, tf), buckets in order."""
    key, tf = np.unique(row * v + bucket, return_counts=True)
    return np.bincount(key // v, minlength=n_rows), key % v, tf


def term_lists(texts: pa.Array, spaces: list[tuple[tuple[int, ...], int]]) -> list[pa.Array]:
    """For each (n-gram orders, buckets) of ``spaces`` the terms of each row of
    ``texts``, strings or lists of tokens; null for null."""
    listed = not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type))
    size = pc.list_value_length(texts) if listed else pc.binary_length(texts)
    size = np.nan_to_num(size.to_numpy(zero_copy_only=False)).astype(np.int64) * (8 if listed else 1)
    orders, parts = sorted({n for ns, _ in spaces for n in ns}), [[] for _ in spaces]
    for lo, hi in _slices(size):
        words = texts.slice(lo, hi - lo)
        words = words if listed else _token_lists(words)
        hashed = {n: (row, _hashes(grams)) for n in orders for row, grams in [_grams(words, n)]}
        for (ns, v), out in zip(spaces, parts, strict=True):
            row, h = (np.concatenate(x) for x in zip(*[hashed[n] for n in ns], strict=True))
            out.append(_runs(row, h % v, hi - lo, v))
    gone = texts.is_null() if texts.null_count else None
    lists = []
    for out in parts:
        n, bucket, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        terms = pa.StructArray.from_arrays([pa.array(bucket, pa.int64()), pa.array(tf, pa.int64())], fields=list(_TERM))
        lists.append(pa.ListArray.from_arrays(ends, terms, mask=gone))
    return lists


def hashed_terms(text: Column, spaces: list[tuple[tuple[int, ...], int]]) -> Column:
    """Struct of ``t0``, ``t1``...: ``array<struct<bucket, tf>>`` of each (n-gram
    orders, buckets), of a text or an array of tokens, sorted by bucket."""
    names = [f"t{i}" for i in range(len(spaces))]
    kind = f"struct<{', '.join(f'{c}: array<struct<bucket: bigint, tf: bigint>>' for c in names)}>"

    def run(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(term_lists(texts, spaces), names)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)(text)
