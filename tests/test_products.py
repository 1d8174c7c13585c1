"""Gramians, sparse row sums and the fold-wise SPPMI evaluation."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textlens.operators import csr, gramian as G
from textlens.operators.cooccur import doc_sppmi_sum, fit_sppmi, presence_arrays, sppmi_rows
from textlens.operators.evaluate import assign_folds
from textlens.operators.features import with_terms
from textlens.operators.fold_sppmi import fit_fold_sppmi, kfold_sppmi_logistic
from textlens.operators.mlfit import add_margins, fit_labels
from textlens.operators.represent import _dense
from textlens.sources.tables import load_observations
from tests.conftest import SF_SMALL


def documents(v, n=80, seed=1):
    rng = random.Random(seed)
    docs = [sorted(rng.sample(range(v), min(v, rng.choice([0, 1, 3, 20])))) for _ in range(n)]
    docs += [sorted(set(range(0, v, max(1, v // 40)))), list(range(min(v, 60))), [], [v - 1], [0, v - 1]]
    return [(i, i % 3, b) for i, b in enumerate(docs)]


def counted(docs):
    c = Counter()
    for _, p, b in docs:
        for x, i in enumerate(b):
            for j in b[x:]:
                c[i, j, p] += 1
    return c


def table(spark, docs):
    return spark.createDataFrame(docs, "doc_id int, p int, b array<bigint>").repartition(4)


@pytest.mark.parametrize("v, strategy, salts", [(40, "dense", None), (700, "dense", None), (40, "tiled", 1), (1300, "tiled", 3),
                                                (5000, "tiled", None), (1 << 18, "tiled", 1), (1 << 18, "tiled", 2)])
def test_gramian(spark, v, strategy, salts):
    docs = documents(v)
    want = counted(docs)
    df = table(spark, docs)
    plain = G.gramian(df, v, strategy, salts=salts, pair_chunk=50)
    total = Counter()
    for (i, j, _), n in want.items():
        total[i, j] += n
    assert sorted(tuple(r) for r in plain.collect()) == sorted((i, j, n) for (i, j), n in total.items())
    planes = G.gramian(df, v, strategy, "p", 3, salts)
    got = {(r["i"], r["j"], p): n for r in planes.collect() for p, n in enumerate(r["c"]) if n}
    assert got == want


def test_wide_tiles_spill():
    """Sorted runs on disk give the counts of one table."""
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 900, 20_000)
    c = G._SortedCounts(held=100)
    for part in np.split(codes, 40):
        c.add(part)
    assert len(c.runs) > 5
    parts = list(c.sums(6))
    got = np.concatenate(parts, axis=1)
    want = np.unique(codes, return_counts=True)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert all((a[0, -1] // 6) < (b[0, 0] // 6) for a, b in zip(parts, parts[1:], strict=False))


def test_documents_travel_not_pairs(spark):
    """What a wide feature space sends to its tiles is less than 20 times the arrays."""
    v = 1 << 18
    docs = documents(v, 300)
    rows = table(spark, docs).select("p", "b")
    sent = rows.mapInArrow(G._to_tiles(G.tile_width(v), 1), G._TILE_ROWS)
    size = sent.agg(F.sum(sum(F.length(c) for c in ("plane", "nx", "bx", "ny", "by")))).first()[0]
    assert size < 20 * 8 * sum(len(b) + 1 for _, _, b in docs)


@pytest.mark.parametrize("limit", [1 << 20, 2000, 0])
def test_row_sums(spark, limit, monkeypatch):
    """Shared table or blocks, the same vectors; documents without entries stay."""
    v, rng = 60, random.Random(2)
    docs = documents(v)
    entries = {(i, j): rng.random() for i in range(0, v, 2) for j in rng.sample(range(v), 9)}
    monkeypatch.setattr(csr, "SALT_DOCS", 30)
    rows = spark.createDataFrame([(i, j, s) for (i, j), s in entries.items()], "i bigint, j bigint, s double")
    got = {r["doc_id"]: dict(zip(r["j"], r["x"], strict=True)) for r in csr.row_sums(table(spark, docs), rows, v, limit=limit).collect()}
    assert len(got) == len(docs)
    for d, _, b in docs:
        want = Counter()
        for i in b:
            for j in range(v):
                if (i, j) in entries:
                    want[j] += entries[i, j]
        assert sorted(got[d]) == sorted(want) and all(got[d][j] == pytest.approx(want[j]) for j in want)
    monkeypatch.setattr(csr, "CELLS", 100)  # few documents and buckets at a time
    long = doc_sppmi_sum(table(spark, docs), rows, v, outer=True)
    assert long.select("doc_id").distinct().count() == len(docs) and long.where("j is null").count() > 0


def test_no_row_per_document_and_bucket(spark):
    rows = spark.createDataFrame([(1, 2, 0.5)], "i bigint, j bigint, s double")
    plan = csr.row_sums(table(spark, documents(9)), rows, 9)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange hash" not in plan


@pytest.fixture(scope="module")
def observations(spark):
    return load_observations(spark, SF_SMALL, "toxic")


def test_fold_tables_equal_refits(spark, observations):
    """A downdated table is the one fitted on the training fold alone."""
    k, v, shift = 3, 300, 2.0
    m = fit_fold_sppmi(observations, k, 1, v, shift)
    folds = assign_folds(observations, k)
    for f in range(k):
        train = observations.join(folds.where(F.col("fold") != f).select("doc_id"), "doc_id")
        present = presence_arrays(with_terms(train.select("doc_id", "text"), 1, v))
        rows = sppmi_rows(fit_sppmi(present, train.count(), v, shift)[1])
        want = {(r["i"], r["j"]): r["s"] for r in rows.collect()}
        got = {(r["i"], r["j"]): r["s"][f] for r in m.rows.collect() if r["s"][f] is not None}
        assert got.keys() == want.keys() and len(got) > 50
        assert all(got[x] == pytest.approx(want[x]) for x in want)
    paths = m.made[:]
    m.drop()
    assert paths and not m.made


def test_logistic_on_sppmi_folds(spark, observations):
    """Scoring by gains equals fitting and scoring on the vectors themselves."""
    k, v, shift, reg = 3, 200, 1.0, 0.5
    m = fit_fold_sppmi(observations, k, 1, v, shift)
    got = {(r["fold"], r["doc_id"]): r for r in kfold_sppmi_logistic(m, [reg, 1.25], 10).where("reg = 0.5").collect()}
    assert len(got) == observations.count()
    f = 1
    rows = m.rows.select("i", "j", F.col("s")[f].alias("s")).where("s is not null")
    present = presence_arrays(with_terms(m.placed, 1, v), ["doc_id", "fold", "label"])
    vectors = csr.row_sums(present, rows, v, ["doc_id", "fold", "label"])
    points = vectors.select("doc_id", "fold", "label", array_to_vector(_dense(F.arrays_zip("j", "x"), v)).alias("features"))
    models = fit_labels(points.where(f"fold <> {f}"), m.labels, True, reg, 10, 0.0)
    z = add_margins(points.where(f"fold = {f}"), models, ["doc_id"], True).collect()
    assert len(z) > 10
    for r in z:
        p = 1 / (1 + np.exp(-max(r["z"])))
        assert got[f, r["doc_id"]]["confidence"] == pytest.approx(p, rel=1e-6)


def test_parts_of_row_sums_hold_their_entries(spark, monkeypatch):
    """Sparse rows are added up as many at a time as have ``CELLS`` entries: one
    sum of all cells for many buckets, not one for every few."""
    import numpy as np
    v, n = 50, 40
    monkeypatch.setattr(csr, "CELLS", 1000)
    part = csr.Rows(np.arange(v), np.arange(v), np.ones(v), 0, v)
    calls, count = [], np.bincount
    monkeypatch.setattr(csr.np, "bincount", lambda *a, **k: calls.append(1) or count(*a, **k))
    got = list(part.times(np.full(n, v), np.tile(np.arange(v), n), v))
    assert all((x == 1.0).all() for _, _, x in got) and sum(len(j) for _, j, _ in got) == n * v
    assert len(calls) <= 3 * len(got) + n * v // 1000


def test_packed_rows_of_tiles_are_bounded():
    """A packed row holds some documents, not a whole Arrow batch of them."""
    import pyarrow as pa

    from textlens.operators import gramian as G
    lists = pa.array([list(range(1000))] * 200, pa.list_(pa.int64()))
    cut = list(G._cut(pa.RecordBatch.from_arrays([pa.array([0] * 200, pa.int32()), lists], ["plane", "b"])))
    assert sum(b.num_rows for b in cut) == 200 and max(b.num_rows for b in cut) * 1000 <= G.SENT


@pytest.mark.parametrize("gain", [0, 10**9])
def test_tiles_by_products_and_by_pairs(spark, gain, monkeypatch):
    """Dense products and counted pairs give the same tiles, plane by plane."""
    import random

    import numpy as np

    from textlens.operators import gramian as G
    rng = random.Random(3)
    docs = [(rng.randrange(3), sorted(rng.sample(range(900), rng.randrange(0, 30)))) for _ in range(100)]
    monkeypatch.setattr(G, "DENSE_GAIN", gain)
    width, want, got = 512, {}, {}
    for p, b in docs:
        for a in range(len(b)):
            for z in range(a, len(b)):
                want.setdefault((b[a], b[z]), [0, 0, 0])[p] += 1
    for x in range(2):
        for y in range(x, 2):
            tile = G._Tile(x, y, width, 3, True)
            for p, b in docs:
                one, two = ([e - t * width for e in b if e // width == t] for t in (x, y))
                if one and two:
                    tile.receive((np.array([p]), np.array([len(one)]), np.array(one, "<u2"), np.array([len(two)]), np.array(two, "<u2")), 50)
            for out in tile.batches(50):
                got.update({(i, j): c for i, j, c in zip(*[c.to_pylist() for c in out.columns], strict=True)})
    assert got == want
