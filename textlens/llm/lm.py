"""Language-model scores by a log-bilinear model trained with noise contrast.

Tokens are words and one end per text. A word is predicted in two steps. The
``TOP`` most frequent words are symbols of their own, all others share
``CLASSES`` symbols by their last bytes; a log-bilinear model gives the symbol:
embeddings of the words before, each weighed by the diagonal matrix of its
distance, and the mean of the last ``SPAN`` add up to a predicted vector, whose
products with the output embeddings (plus biases) are the symbols' scores. A
class gives each of its words the share of its smoothed count, and a half
count to words that it does not know, so the probabilities of all known words
and of one unknown word per class add up to 1 after any history.

1. Texts become blocks (``BLOCK_BYTES`` of text): token numbers and the distinct
   words of the block, as 64-bit hashes. Texts are read once and never shuffled.
2. Each block sends its distinct words, with their counts in the texts to
   learn from, to buckets of about ``BUCKET_BYTES``; a bucket adds them up and
   answers each block with the counts in all texts. A word that every block
   has is one record per block.
3. Training sees every token to learn from once, in ``ROUNDS``: each task starts
   from the common model, takes its tokens in batches by noise-contrastive
   estimation (the noise is shared by a batch, so all steps are matrix
   products), and the tasks' models are averaged by tokens.
4. Scoring normalises over all symbols with batched matrix products.

What is gathered on the driver has fixed shapes: the model (some 70 KB), the
most frequent words, one sum per class.

Defined cases: null, empty and blank texts have one token, the end; repeated
rows count and are scored as often as they occur; null ids are learnt from
(``op13``); without tokens to learn from the unknown token is the only one, so
all scores are 0; an empty table gives no rows; texts of any length are
scored whole; other columns are kept, those named like a result are replaced.
Two words whose hashes are equal share a count (one pair is expected among
some 6e9 distinct words). Averaged models depend on how the input is split.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.llm.common import fresh, read, save
from textlens.llm.groups import by_bucket
from textlens.llm.words import batch_words, buffer_of, byte_class, chunks, mix

TOP, CLASSES, DIM, NEAR, SPAN = 128, 192, 16, 4, 32
BATCH, ROWS, NOISE, RATE, ROUNDS, SEED = 2048, 256, 64, 0.08, 2, 11
BLOCK_BYTES, BUCKET_BYTES, PIECE = 16 << 20, 8 << 20, 1024
SYMBOLS = TOP + CLASSES
RESULTS = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
_BLANK = byte_class("blank")
_END = np.uint64(0)
_ONES = np.ones(SYMBOLS, np.float32)
_FACT = np.dtype([("word", "<u8"), ("n", "<u4"), ("cls", "u1")])


@dataclass
class Vocabulary:
    """Counts of the tokens to learn from; ``mass`` is a class's sum of
    smoothed counts, with the half count of its unknown word."""

    tokens: int
    distinct: int
    top: np.ndarray  # hashes of the most frequent, sorted
    symbol: np.ndarray  # their symbols, in that order
    counts: np.ndarray
    mass: np.ndarray

    def unigram(self) -> np.ndarray:
        """Probability of each symbol without a history."""
        known = np.zeros(TOP)
        known[:len(self.counts)] = self.counts + 0.5
        p = np.concatenate([known, self.mass])
        return p / p.sum()

    def symbols(self, words: np.ndarray, cls: np.ndarray) -> np.ndarray:
        out = TOP + cls.astype(np.int64)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, words), len(self.top) - 1)
            hit = self.top[at] == words
            out[hit] = self.symbol[at[hit]]
        return out


@dataclass
class Model:
    inputs: np.ndarray  # SYMBOLS + 1 (before the text) x DIM
    outputs: np.ndarray  # SYMBOLS x DIM
    bias: np.ndarray
    weights: np.ndarray  # NEAR + 1 (the mean) x DIM

    @classmethod
    def start(cls, unigram: np.ndarray) -> Model:
        """Small noise around the unigram distribution."""
        rng = np.random.default_rng(SEED)
        small = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
        return cls(small(SYMBOLS + 1, DIM), small(SYMBOLS, DIM), np.log(np.maximum(unigram, 1e-12)).astype(np.float32),
                   1 + small(NEAR + 1, DIM))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.inputs, self.outputs, self.bias, self.weights)])

    def like(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for x in (self.inputs, self.outputs, self.bias, self.weights):
            out.append(flat[at: at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(*out)


class Histories:
    """Predicted vectors of tokens ``a`` to ``z`` of a run of texts: ``syms``
    and, for each token, where its text starts."""

    def __init__(self, m: Model, syms: np.ndarray, start: np.ndarray, a: int, z: int):
        self.m, at, begins = m, np.arange(a, z), start[a:z]
        base = max(0, a - SPAN)
        self.span = syms[base:z]
        seen = np.empty((NEAR + z - base, DIM), np.float32)
        seen[:NEAR] = m.inputs[SYMBOLS]
        seen[NEAR:] = m.inputs[self.span]
        self.near, self.outside = [], []
        for j in range(1, NEAR + 1):
            begin = NEAR + a - base - j
            words, before = seen[begin: begin + z - a].copy(), np.flatnonzero(at - j < begins)
            words[before] = m.inputs[SYMBOLS]
            self.near.append(words)
            self.outside.append(before)
        self.lo, self.hi = np.maximum(begins, at - SPAN) - base, at - base
        run = np.zeros((z - base + 1, DIM), np.float32)
        np.cumsum(seen[NEAR:], axis=0, out=run[1:])
        self.n = np.maximum(self.hi - self.lo, 1).astype(np.float32)[:, None]
        self.mean = run[self.hi]
        self.mean -= run[self.lo]
        self.mean /= self.n
        self.vector = self.mean * m.weights[NEAR]
        for words, w in zip(self.near, m.weights, strict=False):
            self.vector += words * w

    def gradients(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the inputs and the weights, from that of the vectors."""
        w = self.m.weights
        g_weights = np.stack([np.einsum("td,td->d", x, g) for x in (*self.near, self.mean)])
        share = g * w[NEAR] / self.n
        diff = np.zeros((len(self.span) + 1, DIM), np.float32)
        first = np.flatnonzero(np.concatenate([[True], self.lo[1:] != self.lo[:-1]]))  # lo never falls
        diff[self.lo[first]] += np.add.reduceat(share, first, axis=0)
        diff[self.hi] -= share
        each, unseen = np.zeros((NEAR + len(self.span), DIM), np.float32), np.zeros(DIM, np.float32)
        np.cumsum(diff[:-1], axis=0, out=each[NEAR:])
        for j, before in enumerate(self.outside, 1):
            back = g * w[j - 1]
            unseen += back[before].sum(0)
            back[before] = 0
            begin = NEAR + len(self.span) - len(g) - j
            each[begin: begin + len(g)] += back
        g_inputs = _by_symbol(self.span, each[NEAR:], SYMBOLS + 1)
        g_inputs[SYMBOLS] += unseen
        return g_inputs, g_weights


def _by_symbol(ids: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    place = (ids * DIM)[:, None] + np.arange(DIM)
    return np.bincount(place.ravel(), values.ravel(), n * DIM).reshape(n, DIM).astype(np.float32)


def contrast(m: Model, syms: np.ndarray, start: np.ndarray, a: int, z: int, noise: np.ndarray, log_noise: np.ndarray) -> Model:
    """Gradient of the noise-contrastive loss (``contrast_loss``) over tokens
    ``a`` to ``z`` against the shared ``noise`` symbols; ``log_noise`` is the log
    of the noise's size times each symbol's noise probability."""
    h, target = Histories(m, syms, start, a, z), syms[a:z]
    q, v, q_noise = m.outputs[target], h.vector, m.outputs[noise]
    d_real = np.einsum("td,td->t", v, q) + (m.bias - log_noise)[target]
    d_fake = v @ q_noise.T
    d_fake += (m.bias - log_noise)[noise]
    for x, sign in ((d_real, 1), (d_fake, -1)):  # in place: -1 / (1 + e^real), 1 / (1 + e^-fake)
        x *= sign
        np.minimum(x, 60, out=x)
        np.exp(x, out=x)
        x += 1
        np.divide(-sign, x, out=x)
    g_vector = d_fake @ q_noise
    g_vector += d_real[:, None] * q
    g_outputs = _by_symbol(target, d_real[:, None] * v, SYMBOLS)
    np.add.at(g_outputs, noise, d_fake.T @ v)
    g_bias = np.bincount(target, d_real, SYMBOLS).astype(np.float32)
    np.add.at(g_bias, noise, d_fake.sum(0))
    g_inputs, g_weights = h.gradients(g_vector)
    return Model(g_inputs, g_outputs, g_bias, g_weights)


def contrast_loss(m: Model, syms: np.ndarray, start: np.ndarray, a: int, z: int, noise: np.ndarray, log_noise: np.ndarray) -> float:
    """How badly the tokens are told from the noise."""
    v, target = Histories(m, syms, start, a, z).vector, syms[a:z]
    real = np.einsum("td,td->t", v, m.outputs[target]) + (m.bias - log_noise)[target]
    fake = v @ m.outputs[noise].T + (m.bias - log_noise)[noise]
    return float(np.logaddexp(0, -real).sum() + np.logaddexp(0, fake).sum())


def log_probabilities(m: Model, syms: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Natural log of each token's symbol probability after its history."""
    out, room = np.zeros(len(syms)), np.empty((ROWS, SYMBOLS), np.float32)
    outputs = np.concatenate([m.outputs, m.bias[:, None]], 1)
    across, most = np.ascontiguousarray(outputs.T), float(np.abs(outputs).max()) * (DIM + 1)
    vector = np.ones((BATCH, DIM + 1), np.float32)
    for a in range(0, len(syms), BATCH):
        z = min(a + BATCH, len(syms))
        vector[:z - a, :DIM] = Histories(m, syms, start, a, z).vector
        wild = float(np.abs(vector[:z - a]).max()) * most > 80  # e^80 is still a float
        of = np.einsum("td,td->t", vector[:z - a], outputs[syms[a:z]])
        total = np.empty(z - a, np.float32)
        for i in range(0, z - a, ROWS):  # in place, on what fits a processor's cache
            scores = np.matmul(vector[i: min(i + ROWS, z - a)], across, out=room[:min(ROWS, z - a - i)])
            if wild:
                top = scores.max(1)
                scores -= top[:, None]
                of[i:i + ROWS] -= top
            np.exp(scores, out=scores)
            total[i:i + ROWS] = scores @ _ONES
        out[a:z] = of - np.log(total)
    return out


def _starts(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.repeat(ends - counts, counts)


class _Trainer:
    """AdaGrad over batches of texts."""

    def __init__(self, m: Model, unigram: np.ndarray):
        self.m, self.seen, self.square = Model(*(x.copy() for x in _parts(m))), 0, [np.full_like(x, 1e-6) for x in _parts(m)]
        self.cum, self.log_noise = np.cumsum(unigram), np.log(np.maximum(NOISE * unigram, 1e-12)).astype(np.float32)

    def texts(self, syms: np.ndarray, counts: np.ndarray, turn: int, seed: int) -> None:
        """Every ``ROUNDS``-th batch, from ``turn`` on."""
        rng, start = np.random.default_rng([SEED, turn, seed]), _starts(counts)
        for a in range(BATCH * turn, len(syms), BATCH * ROUNDS):
            z = min(a + BATCH, len(syms))
            noise = np.minimum(np.searchsorted(self.cum, rng.random(NOISE) * self.cum[-1]), SYMBOLS - 1)
            g = contrast(self.m, syms, start, a, z, noise, self.log_noise)
            for x, dx, s in zip(_parts(self.m), _parts(g), self.square, strict=True):
                dx /= z - a
                s += dx * dx
                x -= RATE / (1 + turn) * dx / np.sqrt(s)
            self.seen += z - a


def _parts(m: Model) -> tuple[np.ndarray, ...]:
    return m.inputs, m.outputs, m.bias, m.weights


def _packed_ids(ids: np.ndarray) -> bytes:
    """Low and high halves apart: the high ones are nearly all 0."""
    return np.ascontiguousarray(ids.astype("<u4").view("<u2").reshape(-1, 2).T).tobytes()


def _unpacked_ids(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, "<u2").reshape(2, -1).T).view("<u4").ravel()


class _Block:
    """Rows that become one block."""

    def __init__(self, number: int):
        self.number, self.bytes, self.rows, self.counts, self.words, self.cls = number, 0, [], [], [], []

    def add(self, rows: pa.RecordBatch, texts: pa.Array) -> None:
        counts = np.zeros(len(texts), np.int64)
        for lo, hi, w in batch_words(texts, _BLANK, True):
            counts[lo:hi] += np.diff(w.first)
            h = w.hashes()
            h[h == _END] = 1
            self.words.append(h)
            last, short = w.data[w.end - 1].astype(np.int64), w.end - w.start < 2
            other = np.where(short, 0, w.data[w.end - 2 + short].astype(np.int64))
            self.cls.append(((last * 131 + other * 29) % CLASSES).astype(np.uint8))
        self.bytes += int(buffer_of(texts)[1][-1])
        self.rows.append(rows)
        self.counts.append(counts)

    def row(self, learn: str) -> tuple:
        counts = np.concatenate(self.counts)
        words = np.concatenate([np.zeros(0, np.uint64), *self.words])
        cls = np.concatenate([np.zeros(0, np.uint8), *self.cls])
        ends = np.cumsum(counts)
        words, cls = np.insert(words, ends, _END), np.insert(cls, ends, 0)
        counts += 1
        word, first, id_, n = np.unique(words, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(word), np.int64)
        rank[order] = np.arange(len(word))
        ids = rank[id_]
        table = pa.Table.from_batches(self.rows)
        learns = table.column(learn).to_numpy().astype(bool)
        train = np.bincount(ids[np.repeat(learns, counts)], minlength=len(word))
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        return (self.number, len(word), counts.astype("<u4").tobytes(), learns.astype(np.uint8).tobytes(), _packed_ids(ids),
                word[order].tobytes(), cls[first][order].tobytes(), train.astype("<u4").tobytes(), sink.getvalue())


_BLOCK = pa.schema([("block", pa.int64()), ("n_words", pa.int64()),
                    *[(c, pa.binary()) for c in ("counts", "learns", "ids", "words", "cls", "train", "other")]])
_BLOCK_SQL = "block long, n_words long, counts binary, learns binary, ids binary, words binary, cls binary, train binary, other binary"


def blocks(docs: DataFrame, text: str, learn: Column, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """The texts as blocks, written once, and the name of the learn column in ``other``."""
    learn_as = fresh(docs, "_learn")
    rows = docs.select(*[c for c in docs.columns if c != text], F.coalesce(learn, F.lit(False)).alias(learn_as),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias(fresh(docs, "_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        now = _Block(number)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(now.row(learn_as), _BLOCK, strict=True)],
                                              schema=_BLOCK)

        for b in batches:
            texts = b.column(b.num_columns - 1)
            for lo, hi in chunks(buffer_of(texts)[1], 1 << 20):
                now.add(b.select(list(range(b.num_columns - 1))).slice(lo, hi - lo), texts.slice(lo, hi - lo))
                if now.bytes >= block_bytes:
                    yield out()
                    number += 1
                    now = _Block(number)
        if now.rows:
            yield out()

    return save(rows.mapInArrow(run, _BLOCK_SQL), "blocks"), learn_as


def _dealt(words: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((mix(words) >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int32)


def count_words(found: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """(block, bucket, counts: of the block's words in that bucket, in the
    block's order), written once, and the vocabulary."""
    total = found.agg(F.sum("n_words")).first()[0] or 0
    n_buckets = max(1, -(-total * _FACT.itemsize // BUCKET_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, words, cls, train in zip(*[c.to_pylist() for c in b.columns], strict=True):
                facts = np.zeros(len(cls), _FACT)
                facts["word"], facts["n"] = np.frombuffer(words, "<u8"), np.frombuffer(train, "<u4")
                facts["cls"] = np.frombuffer(cls, "u1")
                rows = list(by_bucket(_dealt(facts["word"], n_buckets), facts))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()),
                                                  pa.array([r[1].tobytes() for r in rows], pa.binary())], ["bucket", "block", "facts"])

    def add_up(table: pa.Table) -> pa.Table:
        each = [np.frombuffer(x.as_buffer(), _FACT) for x in table.column("facts")]
        facts = np.concatenate(each)
        word, first, at = np.unique(facts["word"], return_index=True, return_inverse=True)
        n = np.zeros(len(word), np.int64)
        np.add.at(n, at, facts["n"].astype(np.int64))
        cls = facts["cls"][first].astype(np.int64)
        back = np.split(n[at], np.cumsum([len(x) for x in each])[:-1])
        best = np.lexsort((word.view(np.int64), -n))[:TOP]
        best = best[n[best] > 0]
        blocks = table.column("block").to_pylist()
        bucket = table.column("bucket")[0].as_py()
        known = n > 0
        rows = [(b, bucket, v.tobytes(), None, None, None, None) for b, v in zip(blocks, back, strict=True)]
        rows += [(None, bucket, None, int(word[i].view(np.int64)), int(n[i]), int(cls[i]), None) for i in best]
        per = [np.bincount(cls[known], weights, CLASSES) for weights in (n[known], None)]
        rows += [(None, bucket, None, None, int(per[0][c]), c, int(per[1][c])) for c in np.flatnonzero(per[1]).tolist()]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("word", pa.int64()),
                        ("n", pa.int64()), ("cls", pa.int32()), ("distinct", pa.int64())])
    facts = found.select("block", "words", "cls", "train").mapInArrow(send, "bucket int, block long, facts binary")
    answers = save(facts.groupBy("bucket").applyInArrow(
        add_up, "block long, bucket int, counts binary, word long, n long, cls int, distinct long"), "word-counts")
    top = answers.where("word is not null").orderBy(F.desc("n"), "word").limit(TOP).collect()
    sums = answers.where("distinct is not null").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("distinct").alias("d")).collect()
    mass = np.full(CLASSES, 0.5)
    for r in sums:
        mass[r["cls"]] += r["n"] + 0.5 * r["d"]
    for r in top:
        mass[r["cls"]] -= r["n"] + 0.5
    word = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(word)
    vocabulary = Vocabulary(sum(r["n"] for r in sums), sum(r["d"] for r in sums), word[order], order,
                            np.array([r["n"] for r in top], np.int64), mass)
    return answers.where("block is not null").select("block", "bucket", "counts"), vocabulary


def train(found: DataFrame, v: Vocabulary) -> Model:
    """The model of all tokens to learn from."""
    unigram = v.unigram()
    model = Model.start(unigram)
    for turn in range(ROUNDS if v.tokens else 0):
        def run(batches: Iterator[pa.RecordBatch], model=model, turn=turn) -> Iterator[pa.RecordBatch]:
            trainer = _Trainer(model, unigram)
            for b in batches:
                for block, counts, learns, ids, words, cls in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    n, use = np.frombuffer(counts, "<u4").astype(np.int64), np.frombuffer(learns, np.uint8) == 1
                    syms = v.symbols(np.frombuffer(words, "<u8"), np.frombuffer(cls, "u1"))[_unpacked_ids(ids)]
                    trainer.texts(syms[np.repeat(use, n)], n[use], turn, block)
            if trainer.seen:
                flat = trainer.m.flat().astype(np.float64) * trainer.seen
                cut = range(0, len(flat), PIECE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(cut)), pa.int32()), pa.array([trainer.seen] * len(cut), pa.int64()),
                     pa.array([TaskContext.get().partitionId() % 64] * len(cut), pa.int32()),
                     pa.array([flat[a: a + PIECE].tobytes() for a in cut], pa.binary())], ["piece", "seen", "part", "sums"])

        def add(table: pa.Table) -> pa.Table:
            sums = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("sums"))
            return pa.table({"piece": table.column("piece")[:1], "seen": pa.array([sum(table.column("seen").to_pylist())], pa.int64()),
                             "sums": pa.array([sums.tobytes()], pa.binary())})

        done = found.select("block", "counts", "learns", "ids", "words", "cls").mapInArrow(
            run, "piece int, seen long, part int, sums binary")
        some = done.groupBy("piece", "part").applyInArrow(add, "piece int, seen long, sums binary")
        got = some.groupBy("piece").applyInArrow(add, "piece int, seen long, sums binary").orderBy("piece").collect()
        if got:
            model = model.like(np.concatenate([np.frombuffer(r["sums"], np.float64) / r["seen"] for r in got]))
    return model


def score_texts(docs: DataFrame, learn: Column, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``n_known`` (tokens that
    occur in the texts to learn from), ``train_tokens``, ``base_score`` (log10 of
    smoothed relative frequencies) and ``score`` (log10 of the model's
    probability); the model learns from the rows where ``learn`` holds."""
    docs = docs.drop(*RESULTS) if text not in RESULTS else docs.drop(*[c for c in RESULTS if c != text])
    found, learn_as = blocks(docs, text, learn, block_bytes)
    answers, v = count_words(found)
    model = train(found, v)
    keep = [c for c in docs.columns if c != text]
    out = T.StructType([*docs.select(*keep).schema.fields, *[T.StructField(c, T.LongType()) for c in RESULTS[:3]],
                        *[T.StructField(c, T.DoubleType()) for c in RESULTS[3:]]])
    names = [f"c{i}" for i in range(len(keep))]  # clashing names don't matter inside

    def run(block: pa.Table, answer: pa.Table) -> pa.Table:
        row = {c: block.column(c)[0].as_py() for c in ("counts", "ids", "words", "cls", "other")}
        counts, words = np.frombuffer(row["counts"], "<u4").astype(np.int64), np.frombuffer(row["words"], "<u8")
        cls = np.frombuffer(row["cls"], "u1")
        n = np.zeros(len(words), np.int64)
        got = dict(zip(answer.column("bucket").to_pylist(), answer.column("counts"), strict=True))
        for bucket, at in by_bucket(_dealt(words, answer.column("n_buckets")[0].as_py()), np.arange(len(words))):
            n[at] = np.frombuffer(got[bucket].as_buffer(), "<i8")
        base = np.log10((n + 0.5) / (v.tokens + 0.5 * (v.distinct + 1)))
        sym = v.symbols(words, cls)
        inside = np.where(sym < TOP, 0, np.log(n + 0.5) - np.log(v.mass[np.maximum(sym - TOP, 0)]))
        ids = _unpacked_ids(row["ids"])
        first = np.cumsum(counts) - counts
        if v.tokens:
            each = (log_probabilities(model, sym[ids], _starts(counts)) + inside[ids]) / np.log(10)
        else:
            each = np.zeros(len(ids))
        table = pa.ipc.open_stream(row["other"]).read_all()
        cols = [table.column(i) for i in range(len(keep))]
        cols += [pa.array(counts), pa.array(np.add.reduceat(n[ids] > 0, first, dtype=np.int64)),
                 pa.array(np.full(len(counts), v.tokens)), pa.array(np.add.reduceat(base[ids], first)),
                 pa.array(np.add.reduceat(each, first))]
        return pa.Table.from_arrays(cols, [*names, *RESULTS])

    n_buckets = max(1, -(-(found.agg(F.sum("n_words")).first()[0] or 0) * _FACT.itemsize // BUCKET_BYTES))
    answers = answers.withColumn("n_buckets", F.lit(n_buckets))
    inner = T.StructType([T.StructField(x, f.dataType) for x, f in zip([*names, *RESULTS], out.fields, strict=True)])
    scored = found.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, inner)
    return scored.toDF(*out.names)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of four fifths of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, ~held_out(F.col("doc_id")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")
