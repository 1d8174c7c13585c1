"""The parts that the operators share."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlens.llm import common, recompress, suffixes, words
from textlens.llm.components import components


def test_ranked(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.choice([None, 1, 2, 3]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v long, i long").repartition(7)
    got = sorted(common.ranked(df, [F.col("g"), F.col("v").desc_nulls_last(), F.col("i")], sums=["v"]).collect(), key=lambda r: r["_rank"])
    want = sorted(rows, key=lambda r: (r[0], -(r[1] or 0), r[2]))
    assert [(r["g"], r["v"], r["i"]) for r in got] == want
    assert [r["_rank"] for r in got] == list(range(500))
    assert [r["_cum_v"] for r in got] == np.cumsum([r[1] or 0 for r in want]).tolist()


@pytest.mark.parametrize("n", [0, 1, 2, 30])
def test_ranked_small(spark, n):
    got = common.ranked(spark.range(n).select(F.lit(5).alias("v"), "id"), [F.col("v"), F.col("id")], sums=["v"]).collect()
    assert sorted((r["_rank"], r["_cum_v"]) for r in got) == [(i, 5 * i + 5) for i in range(n)]


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)]
    links += [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2300)] + [(-5, -5), (-7, 3000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    parent = {n: n for e in links for n in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {n: got.get(n, n) for n in parent} == {n: find(n) for n in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=120) | st.lists(st.integers(1, 40), max_size=200), st.sampled_from([1, 2, 7, 512]),
       st.sampled_from([1, 16, 512]))
def test_suffix_array(values, ranges, size):
    """Also with several symbols to a range, at each level."""
    s = np.array([*values, 0], np.uint16)
    old = suffixes.MOST_RANGES, suffixes.RANGE_SIZE
    suffixes.MOST_RANGES, suffixes.RANGE_SIZE = ranges, size
    try:
        got = suffixes.suffix_array(s, 42)
    finally:
        suffixes.MOST_RANGES, suffixes.RANGE_SIZE = old
    assert got.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    shared = suffixes.common_prefixes(s, got)
    for a, b in zip(got[:-1].tolist(), got[1:].tolist(), strict=True):
        k = 0
        while s[a + k] == s[b + k]:
            k += 1
        assert shared[b] == k
    assert shared[got[0]] == 0


@pytest.mark.parametrize("kind", ["text", "periods", "random"])
def test_suffix_array_recurses_at_every_size(kind, monkeypatch):
    """A shard of 300 KB: each level is sorted by the same function, down to
    one where all names differ, and neighbours are in order."""
    rng = np.random.default_rng(4)
    if kind == "text":
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(3000)]
        raw = " ".join(words[i] for i in rng.zipf(1.3, 60000) % 3000)[:300_000].encode()
    else:
        raw = (b"abcab" * 60_000 if kind == "periods" else rng.integers(0, 256, 300_000).astype(np.uint8).tobytes())
    s = np.append(np.frombuffer(raw, np.uint8).astype(np.uint16) + 2, 0).astype(np.uint16)
    levels, whole = [], suffixes.suffix_array

    def counted(x, sigma):
        levels.append((len(x), sigma))
        return whole(x, sigma)
    monkeypatch.setattr(suffixes, "suffix_array", counted)
    order = suffixes.suffix_array(s, 258)
    assert sorted(order.tolist()) == list(range(len(s)))
    shared = suffixes.common_prefixes(s, order)
    a, b = order[:-1], order[1:]
    k = shared[b]
    assert (s[a + k] < s[b + k]).all()  # the first symbol that differs decides
    for i in rng.integers(0, len(b), 2000).tolist():
        assert (s[a[i]: a[i] + k[i]] == s[b[i]: b[i] + k[i]]).all()
    if kind == "text":
        assert len(levels) > 3 and levels[1][1] > 2000  # more names than symbols, sorted the same way


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab é\t\nABz0_\x00", max_size=30) | st.none(), max_size=12), st.integers(1, 40))
def test_words(texts, size):
    for table, lower, want in (("blank", False, lambda t: t.split()), ("alnum", True, None)):
        got = [[] for _ in texts]
        hashes = {}
        for lo, hi, w in words.batch_words(pa.array(texts, pa.string()), words.byte_class(table), lower, size):
            assert len(w.first) == hi - lo + 1
            for i, h in enumerate(w.hashes().tolist()):
                got[lo + int(w.row[i])].append(w.word(i))
                assert hashes.setdefault(w.word(i), h) == h
        if want:
            assert got == [want((t or "").encode()) for t in texts]
        else:
            import re
            assert got == [re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower()) for t in texts]
        assert len(set(hashes.values())) == len(hashes)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 6))
def test_equal_windows_have_equal_anchors(seed, window, alphabet):
    """Also within runs and periods, and at both ends of a text."""
    rng = random.Random(seed)
    w = [rng.choice("abcdefgh"[:alphabet]) for _ in range(window)]
    if seed % 3 == 0:
        w = (w[:3] * window)[:window]
    pad = lambda: [rng.choice("abcdefgh"[:alphabet]) for _ in range(rng.randrange(30))]
    texts = [" ".join([*pad(), *w, *pad()]) for _ in range(6)] + [" ".join(w)]
    plan = recompress.schedule(window)
    names, found = {}, 0
    for _, _, x in words.batch_words(pa.array(texts), words.byte_class("blank"), False):
        start, name, _ = recompress.anchors(x, plan)
        assert len(start) == sum(max(0, len(t.split()) - window + 1) for t in texts)
        for s, n in zip(start.tolist(), name.tolist(), strict=True):
            key = tuple(x.word(i) for i in range(s, s + window))
            assert names.setdefault(key, n) == n
            found += key == tuple(v.encode() for v in w)
    assert found >= 7


@pytest.mark.parametrize("size", [60, 400, 5000])
@pytest.mark.parametrize("overlap", [0, 2, 34])
def test_words_of_long_texts(size, overlap):
    """Pieces share exactly the overlap and never cut a word or run into the next row."""
    rng = random.Random(size)
    long = " ".join(rng.choice(["a", "bb", "É", "x" * 50, "The"]) for _ in range(3000))
    texts = ["q", long, "z z", None, long[:700]]
    for table, lower in (("blank", False), ("alnum", True)):
        got = [[] for _ in texts]
        for lo, hi, w in words.batch_words(pa.array(texts), words.byte_class(table), lower, size, overlap):
            if w.before:
                assert hi - lo == 1 and w.before == len(got[lo]) - w.fresh and w.fresh == overlap
            for i in range(w.fresh, len(w.start)):
                got[lo + int(w.row[i])].append(w.word(i))
        assert got == [(t or "").encode().lower().split() if lower else (t or "").encode().split() for t in texts]


@pytest.mark.parametrize("size", [1, 7, 100, 10**6])
def test_split_pieces(size):
    rng = random.Random(size)
    text = b"".join(rng.choice([b"a", b"word", b" ", b"\n", b"\t ", b"x" * 30]) for _ in range(400))
    assert [w for p in words.split_pieces(text, size) for w in p] == text.split()
