"""L1 logistic regression by mini-batch proximal descent (M6 as a mini-batch learner).

A pass goes through the examples in mini-batches of ``batch_size``. Each
moves the weights against the mean gradient of the logistic loss with an
adaptive step, ``rate`` over the root of the summed squares of the weight's
gradients so far, and truncates: a weight moves towards 0 by that step times
``reg`` and stops there. The intercept is not truncated.

Every task runs the mini-batches of its own examples from the same weights.
After a pass the tasks' changes are averaged by their numbers of examples (one
aggregate keyed on the bucket; only changed buckets are sent), and a weight
that is 0 for at least half of the examples is 0. Passes end early when no
weight moved by more than ``tolerance``. In one task it is plain mini-batch
proximal descent (``descend``).

Between mini-batches weights that should be 0 swing a little around it, and
tasks drift apart. So the last ``whole`` passes take all examples as one
mini-batch: the tasks only add up gradients, and one move is made of the sum.

The mini-batches are cut once and written as rows of bytes, so a pass
neither hashes nor unpacks a document's terms again.

Weights and squares are dense (``MOST_WEIGHTS`` bounds buckets x models); beyond
that the online learner keeps sparse ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.operators.features import explode_terms, fit_idf, with_terms
from textlens.operators.linear import LinearModel
from textlens.operators.naive_bayes import known_labels, label_counts
from textlens.operators.util import materialize
from textlens.session import drop_paths

MOST_WEIGHTS = 1 << 20
PIECE = 4096  # entries of a packed row
_TINY = 1e-12


class Batch:
    """A mini-batch as sparse rows: ``row``, ``bucket``, ``value`` of each
    entry and a 0/1 target per row and model."""

    def __init__(self, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, target: np.ndarray):
        self.row, self.bucket, self.value, self.target = row, bucket, value, target

    def gradient(self, w: np.ndarray) -> np.ndarray:
        """Mean gradient of the logistic loss at ``w`` (the last row of ``w``
        holds the intercepts)."""
        n, out = len(self.target), np.zeros_like(w)
        for m in range(w.shape[1]):
            z = np.bincount(self.row, self.value * w[self.bucket, m], n) + w[-1, m]
            miss = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - self.target[:, m]
            out[:-1, m] = np.bincount(self.bucket, self.value * miss[self.row], len(w) - 1) / n
            out[-1, m] = miss.mean()
        return out


def step(w: np.ndarray, squares: np.ndarray, g: np.ndarray, rate: float, reg: float) -> None:
    """One proximal move of all weights, in place."""
    squares += g * g
    size = rate / (np.sqrt(squares) + _TINY)
    size[squares == 0] = 0
    w -= size * g
    w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - size[:-1] * reg, 0)


def descend(batches: list[Batch], w: np.ndarray, squares: np.ndarray, rate: float, reg: float, passes: int = 1) -> None:
    """``passes`` over the mini-batches, in place."""
    for _ in range(passes):
        for b in batches:
            step(w, squares, b.gradient(w), rate, reg)


def cut_batches(batches: Iterator[pa.RecordBatch], size: int, idf: np.ndarray, targets: list[float]) -> Iterator[Batch]:
    """Mini-batches of ``size`` rows (the last may be smaller) of (label, b, tf)."""
    def batch(t: pa.Table) -> Batch:
        label = t.column(0).to_numpy()
        buckets, tf = (t.column(i).combine_chunks() for i in (1, 2))
        n = np.nan_to_num(pc.list_value_length(buckets).to_numpy(zero_copy_only=False)).astype(np.int64)
        bucket = buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        value = tf.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * idf[bucket]
        return Batch(np.repeat(np.arange(len(n)), n), bucket, value, np.stack([label == l for l in targets], 1).astype(float))

    held, n = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, size - n)
            b, n = b.slice(part.num_rows), n + part.num_rows
            held.append(part)
            if n == size:
                yield batch(pa.Table.from_batches(held))
                held, n = [], 0
    if n:
        yield batch(pa.Table.from_batches(held))


_PACKED = "part int, batch int, size binary, bucket binary, tf binary, wide boolean, target binary"


def pack_batches(batches: Iterator[pa.RecordBatch], size: int, v: int, targets: list[float], part: int) -> Iterator[pa.RecordBatch]:
    """The mini-batches of one task, numbered, as rows of bytes that every pass reads
    as they are: pieces of about ``PIECE`` entries, so that a batch of
    rows has a bounded number of bytes."""
    kind = np.dtype("<u2" if v <= 1 << 16 else "<i4")
    for i, b in enumerate(cut_batches(batches, size, np.ones(v), targets)):
        n = np.bincount(b.row, minlength=len(b.target))
        ends, lo, out = np.cumsum(n), 0, []
        while lo < len(n):
            first = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, first + PIECE, "right")))
            tf = b.value[first:ends[hi - 1]]
            wide = bool(len(tf) and tf.max() > 255)
            out.append((part, i, n[lo:hi].astype("<i4").tobytes(), b.bucket[first:ends[hi - 1]].astype(kind).tobytes(),
                        tf.astype("<i8" if wide else "u1").tobytes(), wide, b.target[lo:hi].astype("u1").tobytes()))
            lo = hi
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                         ["part", "batch", "size", "bucket", "tf", "wide", "target"])


def read_batches(batches: Iterator[pa.RecordBatch], idf: np.ndarray, n_models: int) -> Iterator[tuple[int, Batch]]:
    """Packed mini-batches in order, each with the number of the task that cut it."""
    kind = np.dtype("<u2" if len(idf) <= 1 << 16 else "<i4")

    def batch(held: list[tuple]) -> Batch:
        n, bucket, tf, target = (np.concatenate(c) for c in zip(*held, strict=True))
        bucket = bucket.astype(np.int64)
        return Batch(np.repeat(np.arange(len(n)), n), bucket, tf * idf[bucket], target.reshape(-1, n_models).astype(float))

    now, held = None, []
    for b in batches:
        at = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for key, size, bucket, tf, wide, target in zip(at, *b.columns[2:], strict=True):
            if key != now and held:
                yield now[0], batch(held)
                held = []
            now = key
            held.append((np.frombuffer(size.as_buffer(), "<i4"), np.frombuffer(bucket.as_buffer(), kind),
                         np.frombuffer(tf.as_buffer(), "<i8" if wide.as_py() else "u1").astype(np.float64),
                         np.frombuffer(target.as_buffer(), "u1")))
    if held:
        yield now[0], batch(held)


def fit_minibatch_logistic(observations: DataFrame, n_gram: int, num_features: int, reg: float, batch_size: int = 1000,
                           rate: float = 0.1, passes: int = 250, whole: int = 10, tolerance: float = 1e-4) -> LinearModel:
    """Fit one model per label (of two labels the second is the first negated)
    on the TF-IDF of ``observations (doc_id, label, text, category)``."""
    if batch_size < 1:
        raise ValueError("a mini-batch needs one example at least")
    counts = label_counts(observations)
    labels = known_labels(counts)
    mirrored = len(labels) == 2
    targets = labels[1:] if mirrored else labels
    v, n_models = num_features, len(targets)
    if v * n_models > MOST_WEIGHTS:
        raise ValueError("too many weights for dense mini-batch descent: use fit_online_logistic")
    made: list[str] = []
    terms = materialize(with_terms(observations.select("doc_id", "label", "text"), n_gram, v, "text")
                        .select("doc_id", "label", "terms"), made)
    idf_table, idf_counts = fit_idf(explode_terms(terms, ["doc_id"]), terms)
    kept: list[str] = []
    idf_table, idf_counts = materialize(idf_table, kept), materialize(idf_counts, kept)
    idf = np.full(v, float(idf_counts.first()["idf_default"]))
    known = idf_table.select("bucket", "idf").toArrow()  # at most v rows
    idf[known.column("bucket").to_numpy()] = known.column("idf").to_numpy()
    rows = terms.select("label", F.col("terms")["bucket"].alias("b"), F.col("terms")["tf"].alias("tf"))
    rows = materialize(rows.mapInArrow(lambda it: pack_batches(it, batch_size, v, targets, TaskContext.get().partitionId()), _PACKED), made)

    def send(n: int, at: np.ndarray, arrays: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
        """Rows of ``at`` (bucket v: the intercepts) and one, -1, for the number of examples."""
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([np.zeros((1, n_models)), a[at]]).ravel()), n_models)
                 .cast(pa.list_(pa.float64())) for a in arrays]
        return pa.RecordBatch.from_arrays([pa.array(np.append(-1, at)), pa.array(np.full(len(at) + 1, n)), *lists], ["bucket", "n", *names])

    def gather(run, names: list[str]):
        """Sums over all tasks: examples, buckets, their examples, their arrays."""
        sent = rows.mapInArrow(run, ", ".join(["bucket bigint, n bigint", *(f"{c} array<double>" for c in names)]))
        sums = [F.array(*[F.sum(F.col(c)[i]) for i in range(n_models)]).alias(c) for c in names]
        got = sent.groupBy("bucket").agg(F.sum("n").alias("n"), *sums).toArrow()  # at most v + 2 rows
        at, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
        real = at >= 0
        return float(n[~real][0]), at[real], n[real], [
            got.column(c).combine_chunks().flatten().to_numpy().reshape(-1, n_models)[real] for c in names]

    def one_pass(w0: np.ndarray, squares0: np.ndarray):
        def run(batches):
            for _, own in groupby(read_batches(batches, idf, n_models), lambda e: e[0]):  # each cutting task by itself
                w, squares, n = w0.copy(), squares0.copy(), 0
                for _, b in own:
                    step(w, squares, b.gradient(w), rate, reg)
                    n += len(b.target)
                at = np.flatnonzero(np.any((w != w0) | (squares != squares0), 1))
                yield send(n, at, [(w - w0) * n, (squares - squares0) * n, (w != 0) * float(n)], ["w", "s", "some"])
        return run

    def add_up(w: np.ndarray):
        def run(batches):
            g, n = np.zeros_like(w), 0
            for _, b in read_batches(batches, idf, n_models):
                g += b.gradient(w) * len(b.target)
                n += len(b.target)
            if n:
                yield send(n, np.flatnonzero(np.any(g != 0, 1)), [g], ["g"])
        return run

    w, squares = np.zeros((v + 1, n_models)), np.zeros((v + 1, n_models))
    for _ in range(passes):
        total, at, n, (moved, more, some) = gather(one_pass(w, squares), ["w", "s", "some"])
        old = w.copy()
        some = some + (total - n)[:, None] * (old[at] != 0)
        w[at] += moved / total
        squares[at] += more / total
        none = np.zeros_like(w, bool)
        none[at] = 2 * some <= total
        none[-1] = False
        w[none] = 0
        if np.abs(w - old).max() <= tolerance:
            break
    for _ in range(whole):
        total, at, _, (g,) = gather(add_up(w), ["g"])
        mean = np.zeros_like(w)
        mean[at] = g / total
        step(w, squares, mean, rate, reg)
    drop_paths(observations.sparkSession, made)
    signed = [(labels[0], 0, -1.0), (labels[1], 0, 1.0)] if mirrored else [(l, i, 1.0) for i, l in enumerate(labels)]
    at = np.flatnonzero(np.any(w[:-1] != 0, 1))
    at = at if len(at) else np.zeros(1, np.int64)  # a table of weights is never empty
    spark = observations.sparkSession
    packed = spark.createDataFrame(pa.table({
        "bucket": np.concatenate([at] * len(signed)).astype(np.int64),
        "label": np.repeat([float(l) for l, _, _ in signed], len(at)),
        "weight": np.concatenate([s * w[at, i] for _, i, s in signed])}))
    bases = spark.createDataFrame([(float(l), float(s * w[-1, i])) for l, i, s in signed], "label double, intercept double")
    weights = materialize(packed, kept)
    classes = materialize(bases.join(counts.select("label", "category"), "label", "left"), kept)
    return LinearModel(n_gram, v, labels, weights, classes, idf_table, idf_counts, made=kept).with_gains()
