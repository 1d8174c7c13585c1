"""Mini-batch proximal descent: optimality, mini-batches, merge, scoring."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from textlens.operators.features import with_terms
from textlens.operators.minibatch import Batch, cut_batches, descend, fit_minibatch_logistic, step
from textlens.sources.tables import load_observations

SCHEMA = "doc_id long, label double, text string, category string"


def problem(n=400, v=30, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.poisson(0.4, (n, v)) * rng.uniform(0.2, 3, v)
    true = np.where(np.arange(v) < 5, 1.5, 0.0) * np.where(np.arange(v) % 2, 1, -1)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ true + 0.3)))).astype(float)
    return x, y


def batches_of(x, y, size):
    out = []
    for a in range(0, len(x), size):
        row, bucket = np.nonzero(x[a:a + size])
        out.append(Batch(row, bucket, x[a:a + size][row, bucket], y[a:a + size, None]))
    return out


def test_gradient():
    x, y = problem(50, 6)
    w = np.random.default_rng(1).standard_normal((7, 1))
    p = 1 / (1 + np.exp(-(x @ w[:-1, 0] + w[-1, 0])))
    got = batches_of(x, y, 50)[0].gradient(w)[:, 0]
    assert got == pytest.approx(np.append(x.T @ (p - y) / 50, (p - y).mean()))


@pytest.mark.parametrize(("size", "within"), [(400, 2e-3), (100, 5e-3), (7, 1e-2)])
def test_optimality(size, within):
    """|gradient| <= reg where w = 0, gradient = -reg sign(w) elsewhere."""
    x, y = problem()
    reg, w, squares = 0.03, np.zeros((31, 1)), np.zeros((31, 1))
    descend(batches_of(x, y, size), w, squares, 0.1, reg, 800)
    descend(batches_of(x, y, len(x)), w, squares, 0.1, reg, 2000)
    g = batches_of(x, y, len(x))[0].gradient(w)[:, 0]
    w = w[:, 0]
    at = w[:-1] != 0
    assert at.any() and not at.all()
    assert np.abs(g[:-1][~at]).max() <= reg + within
    assert np.abs(g[:-1][at] + reg * np.sign(w[:-1][at])).max() <= within
    assert abs(g[-1]) <= within


def test_weights_thin_out():
    x, y = problem()
    counts = []
    for reg in (1e-6, 0.01, 0.05, 10.0):
        w = np.zeros((31, 1))
        descend(batches_of(x, y, 100), w, np.zeros((31, 1)), 0.1, reg, 300)
        counts.append(int((w[:-1] != 0).sum()))
    assert counts[0] > counts[1] > counts[2] > counts[3] == 0


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_batches_have_their_size(size):
    rows = [(float(i % 2), list(range(i % 4)), [1] * (i % 4)) for i in range(10)]
    given = [pa.RecordBatch.from_pydict({"label": [r[0] for r in part], "b": pa.array([r[1] for r in part], pa.list_(pa.int32())),
                                         "tf": pa.array([r[2] for r in part], pa.list_(pa.int64()))}) for part in (rows[:4], [], rows[4:])]
    got = list(cut_batches(iter(given), size, np.arange(1.0, 5.0), [1.0]))
    assert [len(b.target) for b in got] == [size] * (10 // size) + ([10 % size] if 10 % size else [])
    dense = np.zeros((10, 4))
    for i, b in enumerate(got):
        dense[i * size + b.row, b.bucket] += b.value
    want = np.zeros((10, 4))
    for i, (_, at, _) in enumerate(rows):
        want[i, at] = np.arange(1.0, 5.0)[at]
    assert (dense == want).all() and np.concatenate([b.target[:, 0] for b in got]).tolist() == [r[0] for r in rows]


@pytest.fixture(scope="module")
def obs(spark):
    return load_observations(spark, SF_SMALL)


def points(obs, v):
    rows = with_terms(obs, 1, v).select("doc_id", "label", "terms").collect()
    x = np.zeros((len(rows), v))
    for i, r in enumerate(rows):
        for t in r["terms"] or []:
            x[i, t["bucket"]] = t["tf"]
    idf = np.log((len(rows) + 1) / ((x > 0).sum(0) + 1))
    return x * idf, np.array([r["label"] for r in rows]), [r["doc_id"] for r in rows]


def test_one_task_equals_plain_descent(spark, obs):
    one = spark.createDataFrame(obs.orderBy("doc_id").collect(), obs.schema).coalesce(1)
    m = fit_minibatch_logistic(one, 1, 64, 0.01, batch_size=30, passes=3, whole=2, tolerance=0)
    x, y, ids = points(one, 64)
    w, squares = np.zeros((65, 1)), np.zeros((65, 1))
    descend(batches_of(x, y, 30), w, squares, 0.1, 0.01, 3)
    descend(batches_of(x, y, len(x)), w, squares, 0.1, 0.01, 2)
    got = {r["bucket"]: r["weight"] for r in m.weights.where("label = 1").collect()}
    assert [got.get(b, 0.0) for b in range(64)] == pytest.approx(w[:-1, 0].tolist(), abs=1e-9)
    z = dict(zip(ids, x @ w[:-1, 0] + w[-1, 0], strict=True))
    for r in m.predict(obs).collect():
        assert r["margin"] == pytest.approx(abs(z[r["doc_id"]]), abs=1e-8)
        assert r["category"] == ("1" if z[r["doc_id"]] > 0 else "0")


def test_merge_of_tasks(spark):
    """Changes are averaged by examples; a weight that is 0 for half of them is 0."""
    rows = [(i, float(i % 2), "a b" if i % 2 else "c", str(i % 2)) for i in range(6)] + [(6, 1.0, "a a d", "1"), (7, 0.0, None, "0")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), SCHEMA)
    parts = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), SCHEMA)  # 4 and 4 rows
    m = fit_minibatch_logistic(parts, 1, 16, 0.05, passes=1, whole=0, tolerance=0)
    x, y, _ = points(df, 16)
    ends = []
    for at in (slice(0, 4), slice(4, 8)):
        w, s = np.zeros((17, 1)), np.zeros((17, 1))
        for b in batches_of(x[at], y[at], 4):
            step(w, s, b.gradient(w), 0.1, 0.05)
        ends.append(w[:, 0])
    want = np.mean(ends, 0)
    want[:-1][np.sum([e[:-1] != 0 for e in ends], 0) <= 1] = 0
    got = {r["bucket"]: r["weight"] for r in m.weights.where("label = 1").collect()}
    assert [got.get(b, 0.0) for b in range(16)] == pytest.approx(want[:-1].tolist(), abs=1e-12)
    assert m.classes.where("label = 1").first()["intercept"] == pytest.approx(want[-1], abs=1e-12)


def test_several_tasks_learn_as_one(spark, obs):
    """Four tasks move at once: a pass is worth a quarter of a pass of one task."""
    m = fit_minibatch_logistic(obs.repartition(4), 1, 40, 0.02, batch_size=20, passes=12, whole=8, tolerance=0)
    x, y, _ = points(obs, 40)
    w, squares = np.zeros((41, 1)), np.zeros((41, 1))
    for r in m.weights.where("label = 1").collect():
        w[r["bucket"]] = r["weight"]
    w[-1] = m.classes.where("label = 1").first()["intercept"]
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (x @ w[:-1, 0] + w[-1, 0])).mean() + 0.02 * np.abs(w[:-1]).sum()
    one = np.zeros((41, 1))
    descend(batches_of(x, y, 20), one, squares, 0.1, 0.02, 3)
    descend(batches_of(x, y, len(x)), one, squares, 0.1, 0.02, 8)
    assert loss(w) < np.log(2) and abs(loss(w) - loss(one)) < 0.15 * (np.log(2) - loss(one))


def test_labels_and_odd_rows(spark):
    three = spark.createDataFrame([(i, float(i % 3), ["x y", "y z", "q"][i % 3], str(i % 3)) for i in range(30)]
                                  + [(31, 2.0, None, "2"), (32, 2.0, "", "2")], SCHEMA)
    m = fit_minibatch_logistic(three, 1, 32, 1e-4, batch_size=8, passes=12)
    got = m.predict(three).join(three.select("doc_id", F.col("category").alias("actual")), "doc_id")
    assert got.where("category = actual").count() >= 30 and got.count() == 32
    none = fit_minibatch_logistic(three, 1, 32, 100.0, passes=2, whole=2)
    assert none.weights.where("weight <> 0").isEmpty() and none.predict(three).count() == 32
    with pytest.raises(ValueError):
        fit_minibatch_logistic(three.limit(0), 1, 32, 0.1)
    with pytest.raises(ValueError):
        fit_minibatch_logistic(three, 1, 1 << 25, 0.1)


def test_packed_batches_are_the_mini_batches(monkeypatch):
    """Every pass reads the mini-batches as they were cut, whatever the pieces;
    none of a pass interprets term arrays."""
    import pyarrow as pa

    from textlens.operators import minibatch as M
    given = pa.RecordBatch.from_arrays(
        [pa.array([1.0, 0.0, 1.0, 0.0, 1.0]), pa.array([[0, 2], [], None, [1], [0, 1, 3]], pa.list_(pa.int64())),
         pa.array([[1, 300], [], None, [2], [1, 1, 7]], pa.list_(pa.int64()))], ["label", "b", "tf"])
    idf = np.arange(1.0, 5.0)
    want = list(cut_batches(iter([given]), 2, idf, [1.0]))
    for piece in (1, 2, 4096):
        monkeypatch.setattr(M, "PIECE", piece)
        packed = list(M.pack_batches(iter([given]), 2, 4, [1.0], 7))
        got = list(M.read_batches(iter(packed), idf, 1))
        assert [p for p, _ in got] == [7] * len(want)
        for (_, g), w in zip(got, want, strict=True):
            for name in ("row", "bucket", "value", "target"):
                assert np.array_equal(getattr(g, name), getattr(w, name)), name
