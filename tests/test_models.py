"""IDF, Naive Bayes, SPPMI, folds, serving and accuracy on hand-worked cases."""

import math

import pytest

from textlens.operators.cooccur import cooccurrence, sppmi
from textlens.operators.evaluate import kfold_roles, soft_accuracy
from textlens.operators.features import fit_idf
from textlens.operators.linear import binary_confidence
from textlens.operators.naive_bayes import nb_from_stats, nb_stats
from textlens.operators.rowindex import row_index
from textlens.operators.serve import serve_best


def test_idf(spark):
    # 5 documents; bucket 0 in 4 docs, bucket 1 in 2, bucket 2 in 3
    pres = {0: [0, 1, 2], 1: [0, 2], 2: [0, 1], 3: [0, 2], 4: []}
    tf = spark.createDataFrame([(d, b, 1) for d, bs in pres.items() for b in bs], "doc_id long, bucket long, tf long")
    docs = spark.createDataFrame([(d,) for d in pres], "doc_id long")
    table, counts = fit_idf(tf, docs)
    got = {r["bucket"]: r["idf"] for r in table.collect()}
    assert got[0] == pytest.approx(0.182322, abs=1e-6)
    assert got[1] == pytest.approx(0.693147, abs=1e-6)
    assert got[2] == pytest.approx(0.405465, abs=1e-6)
    assert counts.first()["idf_default"] == pytest.approx(math.log(6))


def test_naive_bayes_closed_form(spark):
    rows = [(1.0, [1, 2.5, 0]), (1.0, [0, 1, 1]), (0.0, [3, 0, 1]), (0.0, [1, 0, 0.5]), (0.0, [1, 0, 0])]
    pts = spark.createDataFrame([(d, lab, j, float(x)) for d, (lab, xs) in enumerate(rows)
                                 for j, x in enumerate(xs) if x], "doc_id long, label double, bucket long, x double")
    docs = spark.createDataFrame([(d, lab) for d, (lab, _) in enumerate(rows)], "doc_id long, label double")
    counts, sums = nb_stats(pts, docs)
    classes, theta = nb_from_stats(counts, sums, 0.25, 3)
    pi = {r["label"]: r["pi"] for r in classes.collect()}
    assert pi[0.0] == pytest.approx(-0.526093, abs=1e-6)
    assert pi[1.0] == pytest.approx(-0.893818, abs=1e-6)
    dflt = {r["label"]: r["default"] for r in classes.collect()}
    th = {(r["label"], r["bucket"]): r["theta"] for r in theta.collect()}
    full = {c: [th.get((c, j), dflt[c]) for j in range(3)] for c in (0.0, 1.0)}
    assert full[0.0] == pytest.approx([-0.322773, -3.367296, -1.421386], abs=1e-6)
    assert full[1.0] == pytest.approx([-1.609438, -0.510826, -1.609438], abs=1e-6)


@pytest.mark.parametrize("strategy", ["dense", "sparse"])
def test_sppmi(spark, strategy):
    # documents {a,b}, {a,b}, {c}, {c} with a=0, b=1, c=2
    pres = spark.createDataFrame([([0, 1],), ([0, 1],), ([2],), ([2],)], "b array<bigint>")
    co = cooccurrence(pres, 3, strategy)
    assert {(r["i"], r["j"]): r["c"] for r in co.collect()} == {(0, 0): 2, (0, 1): 2, (1, 1): 2, (2, 2): 2}
    s1 = {(r["i"], r["j"]): r["sppmi"] for r in sppmi(co, 4, 1).collect()}
    assert s1 == {(0, 0): 1.0, (0, 1): 1.0, (1, 1): 1.0, (2, 2): 1.0}
    assert sppmi(co, 4, 10).count() == 0


def test_dense_and_sparse_gramians_agree(spark):
    import random
    rnd = random.Random(7)
    rows = [(sorted(rnd.sample(range(50), rnd.randint(0, 20))),) for _ in range(300)]
    pres = spark.createDataFrame(rows, "b array<bigint>").repartition(3)
    a = cooccurrence(pres, 50, "dense")
    b = cooccurrence(pres, 50, "sparse")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("n_ranges", [None, 1, 13, 500])
def test_row_index_matches_rank(spark, n_ranges):
    ids = spark.createDataFrame([(i * 7 % 1003,) for i in range(1003)], "doc_id long")
    got = row_index(ids, "doc_id", n_ranges=n_ranges).orderBy("doc_id").collect()
    assert [r["idx"] for r in got] == list(range(1003))


def test_row_index_of_other_keys(spark):
    text = spark.createDataFrame([(f"k{i % 7}", i, None if i == 3 else "x") for i in range(100)], "a string, b long, c string")
    got = row_index(text, ["a", "b"], n_ranges=5).orderBy("a", "b").collect()
    assert [r["idx"] for r in got] == list(range(100)) and got[0].asDict().keys() == {"a", "b", "c", "idx"}
    got = row_index(text, "c", tie_breakers=["b"]).orderBy("idx").collect()
    assert [r["b"] for r in got][:3] == [3, 0, 1]
    empty = spark.createDataFrame([], "doc_id string")
    assert row_index(empty).collect() == [] and row_index(empty).columns == ["doc_id", "idx"]


def test_row_index_ranges_follow_the_parameter(spark):
    """A range is never much larger than its share, however many are asked for."""
    df = spark.range(200_000).withColumnRenamed("id", "doc_id")
    sizes = df.repartitionByRange(400, "doc_id").groupBy(__import__("pyspark").sql.functions.spark_partition_id()).count()
    assert sizes.count() > 350 and sizes.agg({"count": "max"}).first()[0] < 4 * 500


def test_kfold_of_nothing(spark):
    from textlens.operators.evaluate import kfold_naive_bayes
    empty = spark.createDataFrame([], "doc_id long, label double, text string, category string")
    with pytest.raises(ValueError):
        kfold_naive_bayes(empty, 3, 1, 50, [0.25])


def test_sppmi_of_many_documents(spark):
    """Counts whose products leave 64 bits: N = 4e9 and beyond."""
    n = 4_000_000_000
    co = spark.createDataFrame([(0, 0, n // 2), (0, 1, n // 4 + 1), (1, 1, n // 2), (0, 2, n // 4 - 1), (2, 2, n // 2)], "i long, j long, c long")
    got = {(r["i"], r["j"]): r["sppmi"] for r in sppmi(co, n, 1).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (0, 1)}  # (0, 2) is just below independence, (0, 1) just above
    assert got[0, 0] == pytest.approx(1.0) and 0 <= got[0, 1] < 1e-6
    assert sppmi(co.selectExpr("i", "j", "c * 1000 as c"), n * 1000, 2).count() == 0


def test_kfold_fixture(spark):
    folds = spark.createDataFrame([(i, i % 3) for i in range(7)], "doc_id long, fold int")
    roles = kfold_roles(folds, 3).where("role = 'test'").collect()
    by_fold = {}
    for r in roles:
        by_fold.setdefault(r["fold"], set()).add(r["doc_id"])
    assert by_fold == {0: {0, 3, 6}, 1: {1, 4}, 2: {2, 5}}


def test_serving_tie_goes_to_first(spark):
    preds = [spark.createDataFrame([(1, c, p)], "doc_id long, category string, confidence double")
             for c, p in [("0", 0.6), ("1", 0.9), ("0", 0.9)]]
    r = serve_best(preds).first()
    assert (r["category"], r["confidence"], r["algo"]) == ("1", 0.9, 1)


def test_folded_confidence(spark):
    df = spark.createDataFrame([(1, 0.8), (2, 0.5), (3, 0.1)], "doc_id long, p double")
    out = {r["doc_id"]: (r["category"], round(r["confidence"], 6)) for r in binary_confidence(df).collect()}
    assert out == {1: ("1", 0.8), 2: ("0", 0.5), 3: ("0", 0.9)}


def test_soft_accuracy(spark):
    probs = spark.createDataFrame([(1, 1.0, 0.8), (2, 1.0, 0.3)], "doc_id long, label double, score double")
    truth = spark.createDataFrame([(1, 1.0), (2, 0.0)], "doc_id long, label double")
    r = soft_accuracy(probs, truth).first()
    assert r["soft_accuracy"] == pytest.approx(0.75)


def test_sparse_gramian_long_document_in_chunks(spark):
    """A document longer than the pair chunk is split; counts are unchanged."""
    rows = [(list(range(0, 60, 2)),), (list(range(0, 30)),), ([5],)]
    pres = spark.createDataFrame(rows, "b array<bigint>").coalesce(1)
    got = {(r["i"], r["j"]): r["c"] for r in cooccurrence(pres, 64, "sparse", pair_chunk=50).collect()}
    want = {}
    for (b,) in rows:
        for x in range(len(b)):
            for y in range(x, len(b)):
                want[(b[x], b[y])] = want.get((b[x], b[y]), 0) + 1
    assert got == want
