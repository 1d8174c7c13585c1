"""Toxicity scores by a convolutional text classifier trained in numpy.

Words are hashed (whole word and its first bytes) to rows of small embedding
tables; filters of several widths run over the embedded words, their outputs
are pooled over the text by maximum (and by a damped sum, so that one chance
hit in a long text weighs less than many), and a small layer gives a logit.
Texts are scored whole, in flat numpy batches inside Arrow functions.

The model is fitted on a bounded sample (``MAX_ROWS`` labelled rows, texts of
up to ``MAX_TRAIN_BYTES`` bytes; the rows with the smallest hash of their id)
of the rows whose CRC-32 of the id modulo ``FOLDS`` isn't 0; features of the
sample are computed by Spark, only hashed ids reach the driver. A part of the
sample is set aside to calibrate one threshold per language. The language of
a text is guessed from its words alone, so score and verdict depend on
nothing but the text; the score is shifted so that 0.5 is that threshold.
Every language with ``LEAST_EACH`` rows in the sample is one to be guessed; the
others, and texts that look like none, are "other" and take the threshold of
the whole sample. Training starts from random weights.

Defined cases: null, empty and wordless texts are scored like any other (from
zero features); null labels and ids are not learnt from; a null language is a
language of its own; without rows of both labels every score is the share of
label 1 (0 without any row); repeated rows get equal scores; an empty table
gives no rows; ``score`` keeps further columns (``score`` is replaced).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.llm.common import fresh, read
from textlens.llm.words import batch_words, buffer_of, byte_class, chunks

FOLDS, MAX_ROWS, MAX_TRAIN_BYTES, CALIBRATE = 5, 10000, 32 << 10, 0.15
BUCKETS, PREFIXES, DIM, WIDTHS, FILTERS, HIDDEN = 1 << 15, (6,), 12, (1, 2, 3), 8, 12
EPOCHS, BATCH, RATE, SEED = 5, 16, 0.01, 7
LANG_BUCKETS, LANG_BLOCK, LEAST_EACH, LEAST_TEXTS = 1 << 12, 1 << 22, 8, 3
DECAY, SPREAD = 0.1, 0.3
_ALNUM = byte_class("alnum")


@dataclass
class Model:
    """Weights; ``tables`` are the embeddings, ``langs`` the word log-shares
    per language for the guess, ``shift`` the logit of each threshold."""

    tables: list = field(default_factory=list)
    filters: list = field(default_factory=list)
    layers: list = field(default_factory=list)
    langs: np.ndarray | None = None
    shift: np.ndarray | None = None
    prior: float = 0.0


def word_ids(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Runs of rows with the hashed ids of their words (one column per
    embedding table), the index of each row's first word, and how many words
    at the end come again: pieces of a long text share what a filter spans."""
    for lo, hi in chunks(buffer_of(texts)[1]):
        lower = pc.utf8_lower(texts.slice(lo, hi - lo).fill_null(""))
        for a, b, w in batch_words(lower, _ALNUM, True, overlap=max(WIDTHS) - 1):
            ids = [w.hashes(), *(w.hashes(p) for p in PREFIXES)]
            yield lo + a, lo + b, np.stack([(h >> np.uint64(49)).astype(np.uint16) for h in ids], 1), w.first, w.tail


def text_scores(m: Model, texts: pa.Array) -> np.ndarray:
    """Scores of whole texts; what was pooled from the pieces of a long one is
    pooled once more, so it counts as one text."""
    n = len(texts)
    if not m.tables:
        return np.full(n, 1 / (1 + np.exp(-m.prior)))
    most, total = np.zeros((n, FILTERS * len(WIDTHS)), np.float32), np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
    count, lang = np.zeros(n, np.int64), np.zeros((n, m.langs.shape[1]))
    for lo, hi, ids, first, tail in word_ids(texts):
        a, s, *_ = _pool(m, ids, first, tail)
        most[lo:hi] = np.maximum(most[lo:hi], a)
        total[lo:hi] += s
        own = np.minimum(first, len(ids) - tail)
        count[lo:hi] += np.diff(own)
        lang[lo:hi] += _lang_sums(m, ids, own)
    z = _dense(m, most, total, count)[0].astype(np.float64)
    if m.shift is not None:
        z = z - m.shift[np.argmax(lang, 1)]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _flat(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with ``max(WIDTHS) - 1`` pads after each row, the index of each
    row, and which entries are words."""
    pad, n = max(WIDTHS) - 1, len(first) - 1
    at = np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(first)) * pad
    out = np.zeros((len(ids) + n * pad, ids.shape[1]), np.int64)
    out[at] = ids
    real = np.zeros(len(out), bool)
    real[at] = True
    return out, first[:-1] + np.arange(n) * pad, real


def _pool(m: Model, ids: np.ndarray, first: np.ndarray, tail: int = 0):
    """Maximum and sum of every filter's outputs over each row; the last
    ``tail`` words are seen by the filters before them only."""
    flat, rows, real = _flat(ids, first)
    x = sum(t[flat[:, i]] for i, t in enumerate(m.tables)) * real[:, None]
    if tail:
        real[np.flatnonzero(real)[-tail:]] = False
    most, total, acts = [], [], []
    for k, (w, b) in zip(WIDTHS, m.filters, strict=True):
        z = x @ w[0]
        for j in range(1, k):
            z[:-j] += x[j:] @ w[j]
        a = np.maximum(z + b, 0) * real[:, None]
        acts.append(a)
        most.append(np.maximum.reduceat(a, rows))
        total.append(np.add.reduceat(a, rows))
    return np.concatenate(most, 1), np.concatenate(total, 1), flat, rows, real, x, acts


def _dense(m: Model, most: np.ndarray, total: np.ndarray, count: np.ndarray):
    """Logits from what was pooled and the number of words."""
    h0 = np.concatenate([most, np.log1p(total), np.log1p(count)[:, None] / 8], 1).astype(np.float32)
    (w1, b1), (w2, b2) = m.layers
    h1 = np.tanh(h0 @ w1 + b1)
    return h1 @ w2 + b2, h0, h1


def _forward(m: Model, ids: np.ndarray, first: np.ndarray):
    most, total, flat, rows, real, x, acts = _pool(m, ids, first)
    z, h0, h1 = _dense(m, most, total, np.diff(first))
    return z, (flat, rows, real, x, acts, h0, h1)


def _lang_sums(m: Model, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-likelihood of each row's words per language, a block of words at a time."""
    n, block = m.langs.shape[1], max(1, LANG_BLOCK // m.langs.shape[1])
    out = np.zeros((len(first) - 1, n))
    for a in range(0, int(first[-1]), block):
        here = m.langs[ids[a: min(a + block, int(first[-1])), 0] % LANG_BUCKETS]
        sums = np.zeros((len(here) + 1, n))
        np.cumsum(here, 0, out=sums[1:])
        at = np.clip(first - a, 0, len(here))
        out += sums[at[1:]] - sums[at[:-1]]
    return out


class _Adam:
    def __init__(self, params: list[np.ndarray]):
        self.params, self.t = params, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list, rate: float) -> None:
        """``grads``: an array like the parameter, or (rows, their gradient)."""
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            m[at] = 0.9 * m[at] + 0.1 * g
            v[at] = 0.99 * v[at] + 0.01 * g * g
            step = (m[at] / (1 - 0.9 ** self.t)) / (np.sqrt(v[at] / (1 - 0.99 ** self.t)) + 1e-7)
            p[at] -= rate * (step + DECAY * p[at])


def _backward(m: Model, kept, dz: np.ndarray, known: list[np.ndarray]) -> list:
    flat, rows, real, x, acts, h0, h1 = kept
    (w1, _), (w2, _) = m.layers
    dh1 = dz[:, None] * w2 * (1 - h1 * h1)
    layer = [h0.T @ dh1, dh1.sum(0), h1.T @ dz, dz.sum(keepdims=True)[0]]
    dh0 = dh1 @ w1.T
    owner = np.repeat(np.arange(len(rows)), np.diff(np.append(rows, len(flat))))
    dx, grads, at, sums = np.zeros_like(x), [], 0, FILTERS * len(WIDTHS)
    for k, (w, _), a in zip(WIDTHS, m.filters, acts, strict=True):
        here, there = slice(at, at + FILTERS), slice(sums + at, sums + at + FILTERS)
        top = (a == h0[:, here][owner]) & (a > 0)
        share = dh0[:, here] / np.maximum(np.add.reduceat(top, rows, dtype=np.float32), 1)
        da = top * share[owner] + (a > 0) * (dh0[:, there] * np.exp(-h0[:, there]))[owner]
        da = da.astype(np.float32)
        dw = np.stack([x[j:].T @ (da[:-j] if j else da) for j in range(k)])
        for j in range(k):
            dx[j:] += (da[:-j] if j else da) @ w[j].T
        grads += [dw, da.sum(0)]
        at += FILTERS
    tables = []
    live = np.flatnonzero(real & np.any(dx, 1))  # pads are no words
    for i in range(len(m.tables)):
        at = live[known[i][flat[live, i]]]
        ids, back = np.unique(flat[at, i], return_inverse=True)
        g = np.zeros((len(ids), DIM), np.float32)
        np.add.at(g, back, dx[at])
        tables.append((ids, g))
    return tables + grads + layer


def train(docs: list[tuple[np.ndarray, int, str]], seed: int = SEED) -> Model:
    """Fit on (word ids, label, language) of the sample."""
    rng = np.random.default_rng(seed)
    labels = np.array([d[1] for d in docs], np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(prior=30.0 if labels.any() else -30.0)
    often = Counter(d[2] for d in docs)
    names = {lang: i for i, lang in enumerate(sorted(x for x, n in often.items() if n >= LEAST_EACH))}
    other = len(names)
    counts = np.full((LANG_BUCKETS, other + 1), 0.05, np.float32)
    for ids, _, lang in docs:
        counts[:, names.get(lang, other)] += np.bincount(ids[:, 0] % LANG_BUCKETS, minlength=LANG_BUCKETS)
    normal = lambda *s: (rng.standard_normal(s) * (0.5 / np.sqrt(s[-2]))).astype(np.float32)
    width = 2 * FILTERS * len(WIDTHS) + 1
    m = Model(tables=[(rng.standard_normal((BUCKETS, DIM)) * SPREAD).astype(np.float32) for _ in range(1 + len(PREFIXES))],
              filters=[[normal(k, DIM, FILTERS) * 2, np.zeros(FILTERS, np.float32)] for k in WIDTHS],
              layers=[[normal(width, HIDDEN), np.zeros(HIDDEN, np.float32)],
                      [normal(HIDDEN, 1)[:, 0], np.zeros((), np.float32)]],
              langs=np.log(counts / counts.sum(0)))
    order = rng.permutation(len(docs))
    aside, fit = np.split(order, [int(len(docs) * CALIBRATE)])
    m.layers[1][1][...] = np.log(labels.mean() / (1 - labels.mean()))
    known = _known(m, docs, fit)
    params = [*m.tables, *[p for f in m.filters for p in f], *[p for la in m.layers for p in la]]
    adam = _Adam([p.reshape(-1) if p.ndim == 0 else p for p in params])
    m.layers[1][1] = adam.params[-1]
    heavy = np.clip((len(docs) - labels.sum()) / labels.sum(), 1, 3)
    # enough passes for a small sample, about the same work for any
    epochs = max(EPOCHS, min(40, 800 * BATCH // len(fit)))

    def batch(at):
        first = np.zeros(len(at) + 1, np.int64)
        np.cumsum([len(docs[i][0]) for i in at], out=first[1:])
        return np.concatenate([docs[i][0] for i in at]), first

    for e in range(epochs):
        rng.shuffle(fit)
        for i in range(0, len(fit), BATCH):
            at = fit[i: i + BATCH]
            z, kept = _forward(m, *batch(at))
            y = labels[at]
            dz = (1 / (1 + np.exp(-z)) - y) * np.where(y == 1, heavy, 1) / len(at)
            adam.step(_backward(m, kept, dz.astype(np.float32), known), RATE * (1 - e / epochs) + 1e-4)
    if len(aside):
        ids, first = zip(*(batch(aside[i: i + 256]) for i in range(0, len(aside), 256)), strict=True)
        z = np.concatenate([_forward(m, i, f)[0] for i, f in zip(ids, first, strict=True)])
        lang = np.concatenate([np.argmax(_lang_sums(m, i, f), 1) for i, f in zip(ids, first, strict=True)])
        whole = _threshold(z, labels[aside], 0.0)
        m.shift = np.array([*(_threshold(z[lang == i], labels[aside][lang == i], whole) for i in range(other)), whole])
    return m


def _known(m: Model, docs: list, fit: np.ndarray) -> list[np.ndarray]:
    """Which hashes of each table enough texts have to learn from; the
    embeddings of all others are 0 and stay it."""
    known = []
    for k, t in enumerate(m.tables):
        seen = np.bincount(np.concatenate([np.unique(docs[i][0][:, k]) for i in fit] or [np.zeros(0, int)]), minlength=BUCKETS)
        known.append(seen >= LEAST_TEXTS)
        t[~known[k]] = 0
    return known


def _threshold(z: np.ndarray, y: np.ndarray, else_: float) -> float:
    """A logit with the fewest errors on held-aside rows, give or take one: the
    one nearest ``else_``, a little inside; ``else_`` with few rows of a label."""
    if min(y.sum(), len(y) - y.sum()) < LEAST_EACH:
        return else_
    z, y = z[o := np.argsort(z, kind="stable")], y[o]
    errors = np.concatenate([[0], np.cumsum(y)]) + (len(y) - y.sum()) - np.concatenate([[0], np.cumsum(1 - y)])
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    best = np.flatnonzero(errors <= errors.min() + 1)
    inside = np.clip(else_, edges[best] + 0.25 * np.diff(edges)[best], edges[best + 1] - 0.25 * np.diff(edges)[best])
    return float(inside[np.argmin(np.abs(inside - else_))])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Train on the documents that ``labels`` marks, outside the held-out fold."""
    marked = labels.select("doc_id", F.col(label).cast("int").alias("_y")).where("doc_id is not null and _y is not null")
    rows = (docs.select("doc_id", F.col("text").alias("_text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"))
            .where(~held_out(F.col("doc_id")) & (F.octet_length("_text") <= MAX_TRAIN_BYTES)))
    ids = rows.join(marked, "doc_id").select("doc_id", "_y", "_lang")
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(max_rows)  # the bounded sample
    sample = rows.drop("_lang").join(F.broadcast(chosen), "doc_id").select("doc_id", "_y", "_lang", "_text")

    def features(batches):
        for b in batches:
            found = []
            for _, _, ids, first, _ in word_ids(b.column("_text")):  # short texts: each in one piece
                found += [ids[a:z].tobytes() for a, z in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.binary())],
                                             ["doc_id", "_y", "_lang", "ids"])

    got = sample.mapInArrow(features, "doc_id long, _y int, _lang string, ids binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["_y"], r["ids"]))
    return train([(np.frombuffer(r["ids"], np.uint16).reshape(-1, 1 + len(PREFIXES)), int(r["_y"] != 0), r["_lang"])
                  for r in got])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``: 0 to 1, 0.5 is the threshold."""
    keep = [c for c in docs.columns if c != out]
    here = keep.index(text) if text in keep and docs.schema[text].dataType == T.StringType() else None
    rows = docs.select(*keep, *([F.col(text).cast("string").alias(fresh(docs, "_scored"))] if here is None else []))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the tables' fixed shapes

    def run(batches):
        m = shared.value
        for b in batches:
            texts = b.columns[-1 if here is None else here]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(text_scores(m, texts))], [*keep, out])

    return rows.mapInArrow(run, T.StructType([*docs.select(*keep).schema.fields, T.StructField(out, T.DoubleType())]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from ``labels.toxic``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, read(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
