"""The iterative fits: what must hold of their results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from textlens.operators.evaluate import accuracy, assign_folds
from textlens.operators.mlfit import fit_ovr_logistic, fold_logistic_predictions, gram_column, nonzero_weights
from textlens.plans import params as P
from textlens.plans.catalog import queries
from textlens.sources.tables import load_observations

BASE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def obs(spark):
    return load_observations(spark, SF_SMALL)


def _points(model, obs):
    rows = model.features_model.transform(gram_column(obs, model.n_gram, "text", model.upto, model.clean))
    got = rows.select("label", "features").collect()
    return np.array([r["features"].toArray() for r in got]), np.array([r["label"] for r in got])


def test_gradient_vanishes_at_convergence(spark, obs):
    """L2: the gradient of mean loss + reg/2 |w|^2 is 0 (raw features)."""
    reg = 0.1
    m = fit_ovr_logistic(obs, 1, 80, reg, max_iter=500, standardization=False)
    x, y = _points(m, obs)
    w, b = m.models[0].coefficients.toArray(), m.models[0].intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) / len(y) + reg * w).max() < 1e-4
    assert abs((p - y).mean()) < 1e-4


def test_l1_satisfies_its_conditions(spark, obs):
    """L1: |gradient| <= reg where w = 0, gradient = -reg sign(w) elsewhere."""
    reg = 0.02
    m = fit_ovr_logistic(obs, 1, 80, reg, max_iter=2000, elastic_net=1.0, standardization=False)
    x, y = _points(m, obs)
    w, b = m.models[0].coefficients.toArray(), m.models[0].intercept
    g = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
    assert (w != 0).any() and (w == 0).any()
    assert np.abs(g[w == 0]).max() <= reg + 1e-3
    assert np.abs(g[w != 0] + reg * np.sign(w[w != 0])).max() < 1e-3


def test_l1_weights_thin_out(spark, obs):
    counts = [sum(nonzero_weights(fit_ovr_logistic(obs, P.TF_NGRAM, 200, r, 100, elastic_net=1.0))) for r in (P.L1_REG, 0.01, 0.05, 10.0)]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] and counts[0] > counts[2] > counts[3] == 0


def test_mirrored_equals_two_fits(spark, obs):
    one = fit_ovr_logistic(obs, 1, 100, 0.5)
    three = fit_ovr_logistic(obs, 1, 100, 0.5, labels=[0.0, 1.0, 7.0])  # no shortcut with a third label
    a = {r["doc_id"]: r["p"] for r in one.probabilities(obs).collect()}
    for r in three.probabilities(obs).collect():
        assert r["p"][:2] == pytest.approx(a[r["doc_id"]], abs=1e-6) and r["p"][2] < 0.01


@pytest.mark.parametrize("name", ["lr_fit_predict", "l1lr_fit_predict"])
def test_registered_fits_beat_the_majority(spark, name):
    pred = queries()[name](spark, BASE)
    obs = load_observations(spark, BASE).select("doc_id", F.col("category").alias("actual"))
    acc = accuracy(pred.join(obs, "doc_id").withColumn("all", F.lit(1)), ["all"]).first()["accuracy"]
    top = max(r["count"] for r in obs.groupBy("actual").count().collect()) / obs.count()
    assert acc > top
    assert pred.select("category").distinct().count() == 2
    assert pred.where(~F.col("confidence").between(0.5, 1)).isEmpty()


def test_hashed_fit(spark, obs):
    """1..n-grams of cleaned text, no IDF: confidences folded, training beaten."""
    m = fit_ovr_logistic(obs, P.HASHED_LR_NGRAM, 1 << 12, P.HASHED_LR_REG, P.LR_MAX_ITER, upto=True, clean=True, idf=False)
    got = m.predict(obs).join(obs.select("doc_id", F.col("category").alias("actual")), "doc_id")
    top = max(r["count"] for r in obs.groupBy("category").count().collect()) / obs.count()
    assert got.where("category = actual").count() / obs.count() > top
    assert got.where(~F.col("confidence").between(0.5, 1)).isEmpty()


def test_grid_equals_separate_fits(spark, obs):
    """Shared featurisation changes no prediction."""
    folds = assign_folds(obs, 3)
    got = {(r["reg"], r["doc_id"]): r for r in fold_logistic_predictions(obs, folds, 3, 1, 100, [0.01, 0.5]).collect()}
    assert len(got) == 2 * obs.count()
    train, test = (obs.join(folds.select("doc_id", "fold"), "doc_id").where(c).drop("fold") for c in ("fold <> 1", "fold = 1"))
    for reg in (0.01, 0.5):
        for r in fit_ovr_logistic(train, 1, 100, reg).predict(test).collect():
            mine = got[reg, r["doc_id"]]
            assert mine["category"] == r["category"] and mine["confidence"] == pytest.approx(r["confidence"], abs=1e-6)


def test_empty_training(spark):
    empty = spark.createDataFrame([], "doc_id long, label double, text string, category string")
    for f in (lambda: fit_ovr_logistic(empty, 1, 50, 0.1),
              lambda: fold_logistic_predictions(empty, assign_folds(empty, 3), 3, 1, 50, [0.1])):
        with pytest.raises(ValueError):
            f()
