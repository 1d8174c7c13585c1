"""Versioned models, the online learner, line numbers by two scans, large stop-word sets."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from textlens.operators import persist
from textlens.operators.evaluate import kfold_naive_bayes
from textlens.operators.features import MOST_LITERAL_WORDS, with_grams, without_words
from textlens.operators.naive_bayes import fit_naive_bayes
from textlens.operators.online import BIAS, fit_online_logistic, length_terms
from textlens.session import scratch_path
from textlens.sources.lines import read_labelled_lines
from textlens.sources.tables import load_observations


@pytest.fixture(scope="module")
def obs(spark):
    return load_observations(spark, SF_SMALL)


def test_a_failed_save_changes_nothing(spark, obs, monkeypatch):
    path = scratch_path(spark, "published")
    with pytest.raises(ValueError):
        persist.load_model(spark, path)
    first = fit_naive_bayes(obs, 1, 50, 0.25)
    persist.save_model(first, path)
    write = persist._write

    def broken(model, folder):
        write(model, folder)
        raise RuntimeError("lost")
    monkeypatch.setattr(persist, "_write", broken)
    with pytest.raises(RuntimeError):
        persist.save_model(fit_naive_bayes(obs, 1, 60, 0.25), path)
    monkeypatch.undo()
    assert persist.load_model(spark, path).num_features == 50
    held = persist.load_model(spark, path)  # a reader of the old version

    def while_saving(model, folder):
        assert persist.load_model(spark, path).num_features == 50
        write(model, folder)
        assert persist.load_model(spark, path).num_features == 50
    monkeypatch.setattr(persist, "_write", while_saving)
    persist.save_model(fit_naive_bayes(obs, 1, 70, 0.25), path)
    monkeypatch.undo()
    assert persist.load_model(spark, path).num_features == 70
    assert held.theta.count() > 0  # still there after one more save
    persist.save_model(fit_naive_bayes(obs, 1, 80, 0.25), path)
    assert persist._committed(spark, path) == [2, 3]
    assert persist.load_model(spark, path).num_features == 80


def test_savers_never_share_a_version(spark):
    path = scratch_path(spark, "claims")
    assert [persist._claim(spark, path) for _ in range(3)] == [0, 1, 2]
    numbers = persist._numbers
    stale = iter([[0], [0, 1, 2]])  # another saver came between listing and claiming
    persist._numbers = lambda *a, **k: next(stale)
    try:
        assert persist._claim(spark, path) == 3
    finally:
        persist._numbers = numbers


def plain_online(rows, v, step, reg, start=None):
    """Dense gradient descent, example by example."""
    w = np.zeros(v + 1) if start is None else start.copy()
    for t, (label, buckets, tf) in enumerate(rows, 1):
        x = np.zeros(v + 1)
        x[buckets] = tf / np.sqrt(np.sum(np.square(tf))) if len(tf) else []
        x[v] = 1
        rate = step / np.sqrt(t)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -60, 60))) - (label == 1.0)) * x
        w = w * (1 - rate * reg) - rate * g
    return w


def test_online_equals_plain_descent(spark, obs):
    one = spark.createDataFrame(obs.orderBy("doc_id").collect(), obs.schema).coalesce(1)
    m = fit_online_logistic(one, 2, 10, 5.0, 1e-3)
    rows = [(r["label"], [t["bucket"] for t in r["terms"]], np.array([t["tf"] for t in r["terms"]], float))
            for r in length_terms(one, 2, 1 << 10).collect()]
    want = plain_online(rows, 1 << 10, 5.0, 1e-3)
    got = {r["bucket"]: r["weight"] for r in m.weights.where("label = 1").collect()}
    assert all(got.get(b, 0.0) == pytest.approx(want[b], abs=1e-9) for b in range(1 << 10))
    assert m.classes.where("label = 1").first()["intercept"] == pytest.approx(want[1 << 10], abs=1e-9)
    pred = {r["doc_id"]: r["margin"] for r in m.predict(obs).collect()}
    for r in length_terms(one, 2, 1 << 10).collect()[:50]:
        tf = np.array([t["tf"] for t in r["terms"]], float)
        z = want[1 << 10] + want[[t["bucket"] for t in r["terms"]]] @ tf / r["length"]
        assert pred[r["doc_id"]] == pytest.approx(abs(z), abs=1e-9)


def test_online_merge_is_weighted_by_examples(spark):
    rows = [(1, 1.0, "a b", "1"), (2, 0.0, "b c", "0"), (3, 1.0, "a d", "1"), (4, 0.0, "c", "0"), (5, 1.0, None, "1")]
    schema = "doc_id long, label double, text string, category string"
    parts = [spark.createDataFrame(spark.sparkContext.parallelize(some, 1), schema) for some in (rows[:2], rows[2:])]
    alone = [fit_online_logistic(p, 1, 22) for p in parts]
    whole = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), schema)  # 2 and 3 rows
    both = fit_online_logistic(whole, 1, 22)
    w = {r["bucket"]: r["weight"] for r in both.weights.where("label = 1").collect()}
    singles = [{r["bucket"]: r["weight"] for r in m.weights.where("label = 1").collect()} for m in alone]
    n = [{b: sum(b in [t["bucket"] for t in r["terms"]] for r in length_terms(p, 1, 1 << 22).collect()) for b in s} for p, s in zip(parts, singles, strict=True)]
    for b, x in w.items():
        held = [(s[b], k[b]) for s, k in zip(singles, n, strict=True) if b in s]
        assert x == pytest.approx(sum(s * k for s, k in held) / sum(k for _, k in held))
    assert BIAS not in w and both.predict(parts[1]).count() == 3
    again = fit_online_logistic(whole, 1, 22, passes=3)
    assert again.predict(whole).count() == 5


def test_online_model_travels(spark, obs):
    m = fit_online_logistic(obs, 1, 22)
    path = persist.save_model(m, scratch_path(spark, "online"))
    again = persist.load_model(spark, path)
    a, b = ({r["doc_id"]: r["margin"] for r in x.predict(obs).collect()} for x in (m, again))
    assert a == pytest.approx(b)


def test_lines_do_not_move(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for k in range(3):
        with open(os.path.join(folder, f"part{k}.txt"), "w") as f:
            f.write("".join(f"{i % 2},line {k} {i}\n" for i in range(500)))
    got = read_labelled_lines(spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "Sort" not in plan
    rows = {r["doc_id"]: r["text"] for r in got.collect()}
    assert rows == {k * 500 + i: f"line {k} {i}" for k in range(3) for i in range(500)}
    with open(os.path.join(folder, "part1.txt"), "a") as f:  # after the first scan
        f.write("1,late\n" * 50)
    with pytest.raises(Exception, match="changed between"):
        spark.read.text(folder).count()
        read = got.select("doc_id", "text")
        read.sparkSession.catalog.refreshByPath(folder)
        read.collect()


@pytest.mark.parametrize("most", [MOST_LITERAL_WORDS, 1])
def test_stop_words_at_any_number(spark, most):
    rows = [(1, "the cat the  cat sat"), (1, "a the"), (None, "dog a the end"), (2, None), (3, ""), (4, "   "), (5, "the cat the  cat sat")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    stop = spark.createDataFrame([("the",), ("a",), ("cat",), (None,), ("the",)], "word string")
    d = with_grams(docs, 1, out_col="_tokens2").withColumn("_tokens", F.col("_tokens2")).drop("_tokens2")
    got = sorted((str(r["doc_id"]), str(r["text"]), r["_tokens"] or []) for r in without_words(d, stop, "text", most=most).collect())
    want = sorted((str(i), str(t), [w for w in (d or []) if w not in ("the", "a", "cat")]) for i, t, d in
                  [(r["doc_id"], r["text"], r["_tokens"]) for r in d.collect()])
    assert got == want


def test_a_million_stop_words(spark):
    docs = spark.createDataFrame([(i, f"w{i} keep w{i * 7} x{i} the") for i in range(200)], "doc_id bigint, text string")
    stop = spark.range(1_000_000).select(F.concat(F.lit("w"), F.col("id")).alias("word"))
    got = {r["doc_id"]: r["grams"] for r in with_grams(docs, 1, stop_words=stop).collect()}
    assert got == {i: ["keep", f"x{i}", "the"] for i in range(200)}


def test_fold_models_stay_out_of_joins(spark, obs):
    """Beyond a few numbers per fold nothing of the models is joined."""
    pred = kfold_naive_bayes(obs, 3, 1, 100, [0.25, 1.0])
    plan = pred._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and not any("_g0" in line for line in joins)
