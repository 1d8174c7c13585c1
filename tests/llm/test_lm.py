"""Language-model scores against plain recomputations."""

import math
import os
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from textlens.llm import lm  # noqa: E402
from textlens.llm.words import Running, _BYTE, mix  # noqa: E402

SMALL = 3000  # bytes of a block: many blocks


def tokens(text):
    return [*brute.BLANK_WORD.findall((text or "").translate(brute.LOWER)), None]


def learns(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 != 1


def counted(rows):
    c = Counter(t for r in rows if learns(r[0]) for t in tokens(r[1]))
    return c, sum(c.values()), len(c)


def word_hash(word):
    if word is None:
        return 0
    raw = np.frombuffer(word.encode(), np.uint8)
    h = int(mix(Running(_BYTE[raw]).of(np.array([0]), np.array([len(raw)])))[0])
    return h or 1


def word_class(word):
    raw = b"" if word is None else word.encode()
    return (raw[-1] * 131 + (raw[-2] if len(raw) > 1 else 0) * 29) % lm.CLASSES if raw else 0


@pytest.fixture(scope="module")
def fitted(docs):
    found, _ = lm.blocks(docs, "text", ~lm.held_out(F.col("doc_id")), SMALL)
    _, v = lm.count_words(found)
    return v, lm.train(found, v)


@pytest.fixture(scope="module")
def scored(docs):
    return lm.score_texts(docs, ~lm.held_out(F.col("doc_id")), block_bytes=SMALL)


def test_counts_and_base(rows, docs, scored):
    c, n, v = counted(rows)
    assert scored.columns == [*[x for x in docs.columns if x != "text"], *lm.RESULTS]
    want = []
    for r in rows:
        t = tokens(r[1])
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        want.append((str(r[0]), r[5], len(t), sum(c[x] > 0 for x in t), n, round(base, 5)))
    got = [(str(r["doc_id"]), r["_k"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in scored.collect()]
    assert sorted(got) == sorted(want)


def symbol(v, word):
    at = np.flatnonzero(v.top == np.uint64(word_hash(word)))
    return int(v.symbol[at[0]]) if len(at) else lm.TOP + word_class(word)


def plain_scores(m, syms):
    """Natural log of each symbol's probability, one token at a time."""
    out = []
    for t, s in enumerate(syms):
        before = [syms[t - j] if t >= j else lm.SYMBOLS for j in range(1, lm.NEAR + 1)]
        span = syms[max(0, t - lm.SPAN):t]
        vector = sum(m.inputs[x].astype(float) * w for x, w in zip(before, m.weights, strict=False))
        if span:
            vector = vector + m.inputs[span].astype(float).mean(0) * m.weights[lm.NEAR]
        scores = m.outputs.astype(float) @ vector + m.bias
        out.append(scores[s] - np.logaddexp.reduce(scores))
    return out


def test_scores(rows, scored, fitted):
    """The forward pass, text by text; the vocabulary recomputed."""
    v, m = fitted
    c, n, distinct = counted(rows)
    assert (v.tokens, v.distinct) == (n, distinct)
    top = sorted(c, key=lambda w: (-c[w], np.uint64(word_hash(w)).astype(np.int64)))[:lm.TOP]
    assert sorted(v.top.tolist()) == sorted(map(word_hash, top))
    mass = np.full(lm.CLASSES, 0.5)
    for w in set(c) - set(top):
        mass[word_class(w)] += c[w] + 0.5
    assert np.allclose(mass, v.mass)
    want = []
    for r in rows:
        t = tokens(r[1])
        if len(t) > 500:
            continue
        syms = [symbol(v, w) for w in t]
        inside = [0 if s < lm.TOP else math.log((c[w] + 0.5) / mass[s - lm.TOP]) for w, s in zip(t, syms, strict=True)]
        want.append((str(r[0]), len(t), (sum(plain_scores(m, syms)) + sum(inside)) / math.log(10)))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in scored.where("n_tokens <= 500").collect())
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-4, abs=1e-4)


def test_probabilities_add_up(rows, fitted):
    """All known words and the unknown word of each class, after some histories."""
    v, m = fitted
    c, _, _ = counted(rows)
    for text in ("", "the of w1 über", "x " * 50):
        history = [symbol(v, w) for w in tokens(text)[:-1]]
        total = 0.0
        p = np.exp([plain_scores(m, [*history, s])[-1] for s in range(lm.SYMBOLS)])
        for w in c:
            s = symbol(v, w)
            total += p[s] if s < lm.TOP else p[s] * (c[w] + 0.5) / v.mass[s - lm.TOP]
        total += (p[lm.TOP:] * 0.5 / v.mass).sum() + p[len(v.top):lm.TOP].sum()
        assert total == pytest.approx(1, abs=1e-6)


def test_batches_agree_with_one_pass(fitted):
    """Wherever batches begin, histories reach over the cut."""
    _, m = fitted
    rng = np.random.default_rng(0)
    counts = np.array([1, 3, 2 * lm.BATCH, 40, 1, 700])
    syms = rng.integers(0, lm.SYMBOLS, counts.sum())
    got = lm.log_probabilities(m, syms, lm._starts(counts))
    for n, end in zip(counts, np.cumsum(counts), strict=True):
        assert np.allclose(got[end - n:end][-60:], plain_scores(m, syms[end - n:end].tolist())[-60:], atol=1e-4)
    wild = lm.Model(*(x * 30 for x in lm._parts(m)))
    assert np.allclose(lm.log_probabilities(wild, syms[:50], lm._starts(np.array([50]))), plain_scores(wild, syms[:50].tolist()), rtol=1e-3, atol=0.05)


def test_gradient():
    """Against differences of the loss."""
    rng = np.random.default_rng(3)
    syms, start = rng.integers(0, 12, 120), lm._starts(np.array([50, 1, 69]))
    unigram = np.full(lm.SYMBOLS, 1 / lm.SYMBOLS)
    m = lm.Model.start(unigram)
    noise, log_noise = rng.integers(0, 12, lm.NOISE), np.log(lm.NOISE * unigram).astype(np.float32)
    g = lm.contrast(m, syms, start, 30, 115, noise, log_noise).flat()
    flat = m.flat().astype(np.float64)
    picked = np.concatenate([np.flatnonzero(g)[rng.integers(0, np.count_nonzero(g), 40)], [lm.SYMBOLS * lm.DIM + 1], np.arange(len(flat) - 80, len(flat), 9)])
    for i in picked:
        step = np.zeros(len(flat))
        step[i] = 0.02
        up, down = (lm.contrast_loss(m.like(flat + s), syms, start, 30, 115, noise, log_noise) for s in (step, -step))
        assert g[i] == pytest.approx((up - down) / 0.04, rel=0.03, abs=0.02)


def test_odd_tables(spark, empty):
    assert lm.score_texts(empty, F.lit(True)).count() == 0
    two = spark.createDataFrame([("a", "x y", 1.5), (None, None, None)], "doc_id string, text string, score double")
    got = {r["doc_id"]: tuple(r[c] for c in lm.RESULTS) for r in lm.score_texts(two, F.lit(False)).collect()}
    assert got == {"a": (3, 0, 0, 0.0, 0.0), None: (1, 0, 0, 0.0, 0.0)}


def test_learns(spark):
    """Held-out texts are more likely to the model than by frequencies alone."""
    out = lm.op13_lm_scores(spark, "/root/testdata/sf0.01").where("held_out")
    r = out.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (r["s"] - r["b"]) / r["n"] > 0.2
