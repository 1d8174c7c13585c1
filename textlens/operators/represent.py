"""Representation switch (F3): document features as TF-IDF (F2) or as SPPMI
document vectors (F8, additive), behind one function, and Naive Bayes or
logistic regression on either.

With ``sppmi`` the vector of a text comes from the fitted rows: ``lookup``
takes the vector of the identical training text (F10; an unseen text has the
zero vector, so its score is the prior), ``sum`` adds the rows of the buckets
that the text has, whether it was seen or not; for a training text both are
the same vector.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from textlens.operators.cooccur import (doc_sppmi_sum, fit_sppmi, packed_vectors, presence_arrays, sppmi_rows,
                                       text_vector_lookup)
from textlens.operators.features import with_terms
from textlens.operators.linear import LinearModel
from textlens.operators.mlfit import fit_labels, fit_ovr_logistic
from textlens.operators.naive_bayes import fit_naive_bayes, known_labels, label_counts, nb_from_stats
from textlens.operators.scoring import sigmoid_best, softmax_best, vector_scores
from textlens.operators.util import materialize
from textlens.session import drop_paths

REPRESENTATIONS = ("tfidf", "sppmi")
LEARNERS = ("naive_bayes", "logistic")


@dataclass
class SppmiFeatures:
    """Fitted SPPMI representation: row vectors, training texts and their
    document vectors."""
    n_gram: int
    num_features: int
    texts: DataFrame     # (doc_id, text) of the training documents
    vectors: DataFrame   # (doc_id, j array, x array)
    rows: DataFrame      # (i, j, s)
    unseen: str = "lookup"

    def transform(self, docs: DataFrame, ids: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
        """``(ids..., bucket, x)``, with a null row for a zero vector."""
        ids = list(ids)
        out = self.vectors_of(docs, ids, text_col).select(*ids, F.explode_outer(F.arrays_zip("j", "x")).alias("_e"))
        return out.select(*ids, F.col("_e.j").alias("bucket"), "_e.x")

    def vectors_of(self, docs: DataFrame, ids: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
        """``(ids..., j array, x array)``, empty or null for a zero vector."""
        ids = list(ids)
        if self.unseen == "sum":
            terms = with_terms(docs.select(*ids, text_col), self.n_gram, self.num_features, text_col)
            return doc_sppmi_sum(presence_arrays(terms, ids), self.rows, self.num_features, ids, packed=True)
        return text_vector_lookup(docs, self.texts, self.vectors, ids=ids, text_col=text_col, outer=True, packed=True)


def fit_sppmi_features(observations: DataFrame, n_gram: int, num_features: int, k: float = 10.0,
                       unseen: str = "lookup") -> SppmiFeatures:
    terms = with_terms(observations.select("doc_id", "text"), n_gram, num_features)
    n = observations.select(F.count(F.lit(1))).scalar()
    present = materialize(presence_arrays(terms))  # read by the Gramian and for the vectors: texts are hashed once
    _, sp = fit_sppmi(present, n, num_features, k)
    rows = sppmi_rows(sp)
    return SppmiFeatures(n_gram, num_features, observations.select("doc_id", "text"),
                         doc_sppmi_sum(present, rows, num_features, packed=True), rows, unseen)


@dataclass
class SppmiNB:
    features: SppmiFeatures
    labels: list[float]
    classes: DataFrame
    theta: DataFrame

    def predict(self, docs: DataFrame, ids: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
        ids = list(ids)
        vectors = self.features.vectors_of(docs, ids, text_col)
        z = vector_scores(vectors, self.theta, self.classes, self.labels, self.features.num_features, ids=ids,
                          base_col="pi", slope_col="default", extra_class_cols=["category"])
        return softmax_best(z, self.labels, ids, categories_col="category").select(
            *ids, "category", "confidence", "label", "margin")


@dataclass
class SppmiLogistic:
    """One-vs-rest logistic regression on SPPMI document vectors: the fitted
    coefficients as the tables of a linear model."""
    features: SppmiFeatures
    linear: LinearModel

    def predict(self, docs: DataFrame, ids: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
        ids, m = list(ids), self.linear
        z = vector_scores(self.features.vectors_of(docs, ids, text_col), m.weights, m.classes, m.labels, m.num_features,
                          ids=ids, coef_col="weight", base_col="intercept", extra_class_cols=["category"])
        return sigmoid_best(z, m.labels, categories_col="category").select(
            *ids, "category", "confidence", "label", "margin")


def linear_tables(models: list, labels: list[float], mirrored: bool, categories: DataFrame,
                  num_features: int) -> LinearModel:
    """The coefficients of binary ``pyspark.ml`` fits (they live on the driver)
    as ``(label, bucket, weight)`` and ``(label, intercept, category)``."""
    spark = categories.sparkSession
    signed = [(labels[0], -1.0, models[0]), (labels[1], 1.0, models[0])] if mirrored else [
        (l, 1.0, m) for l, m in zip(labels, models, strict=True)]
    weights = [(float(l), int(j), sign * float(w)) for l, sign, m in signed
               for j, w in enumerate(m.coefficients.toArray()) if w]
    bases = spark.createDataFrame([(float(l), sign * float(m.intercept)) for l, sign, m in signed],
                                  "label double, intercept double")
    return LinearModel(0, num_features, labels, spark.createDataFrame(weights, "label double, bucket long, weight double"),
                       bases.join(categories, "label", "left"))


def _dense(entries: Column, n: int) -> Column:
    """An array of ``n`` doubles from sorted ``(j, x)`` entries: each entry with
    the zeros before it, then the zeros behind the last."""
    zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
    at = F.transform(entries, lambda e: e["j"])
    before = F.concat(F.array(F.lit(-1).cast("bigint")), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))))
    parts = F.zip_with(entries, F.slice(before, 1, F.size(at)),
                       lambda e, p: F.concat(zeros(e["j"] - p - 1), F.array(e["x"])))
    return F.concat(F.flatten(parts), zeros(F.lit(n - 1) - F.coalesce(F.try_element_at(at, F.lit(-1)), F.lit(-1))))


def sparse_points(vectors: DataFrame, n: int, made: list[str]) -> DataFrame:
    """``(label, features)`` of rows ``(label, j, x)`` with sorted entries, as sparse
    ``pyspark.ml`` vectors: written once as what such vectors are stored as, read
    by every fit (which caches its own blocks); nothing has ``n`` values a row."""
    kind = StructType([vectors.schema["label"], StructField("features", VectorUDT())])
    stored = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(n).alias("size"),
                      F.col("j").cast("array<int>").alias("indices"), F.col("x").alias("values"))
    plain = materialize(vectors.select("label", stored.alias("features")), made)
    return plain.sparkSession.read.schema(kind).parquet(made[-1])


def fit_sppmi_logistic(observations: DataFrame, feats: SppmiFeatures, reg: float, max_iter: int = 10,
                       elastic_net: float = 0.0) -> SppmiLogistic:
    """Logistic regression on the training documents' SPPMI vectors."""
    counts = label_counts(observations)
    labels = known_labels(counts)
    entries = packed_vectors(feats.vectors).select("doc_id", F.sort_array("_v").alias("v"))
    joined = observations.select("doc_id", "label").join(entries, "doc_id", "left").select(
        "label", F.coalesce("v", F.array().cast("array<struct<j:bigint,x:double>>")).alias("v"))
    made: list[str] = []
    points = sparse_points(joined.select("label", F.transform("v", lambda e: e["j"]).alias("j"),
                                         F.transform("v", lambda e: e["x"]).alias("x")), feats.num_features, made)
    try:
        mirrored = len(labels) == 2
        models = fit_labels(points, labels, mirrored, reg, max_iter, elastic_net)
    finally:
        drop_paths(points.sparkSession, made)
    return SppmiLogistic(feats, linear_tables(models, labels, mirrored, counts.select("label", "category"),
                                              feats.num_features))


def fit_classifier(observations: DataFrame, representation: str = "tfidf", n_gram: int = 1,
                   num_features: int = 5000, lam: float = 1.0, k: float = 10.0, learner: str = "naive_bayes",
                   reg: float = 0.5, max_iter: int = 10, unseen: str = "lookup"):
    """F3, the preparator's switch for every learner: ``naive_bayes`` or
    ``logistic`` on ``tfidf`` or ``sppmi`` features."""
    if representation not in REPRESENTATIONS or learner not in LEARNERS:
        raise ValueError(f"representation must be one of {REPRESENTATIONS}, learner one of {LEARNERS}")
    if representation == "tfidf" and learner == "naive_bayes":
        return fit_naive_bayes(observations, n_gram, num_features, lam)
    if representation == "tfidf":
        return fit_ovr_logistic(observations, n_gram, num_features, reg, max_iter)
    counts = label_counts(observations)
    labels = known_labels(counts)
    feats = fit_sppmi_features(observations, n_gram, num_features, k, unseen)
    if learner == "logistic":
        return fit_sppmi_logistic(observations, feats, reg, max_iter)
    seen = observations.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("_n"))
    points = feats.vectors.join(seen, "doc_id").select("label", "_n", F.explode_outer(F.arrays_zip("j", "x")).alias("_e"))
    points = points.where(F.col("_e").isNotNull())
    sums = materialize(points.groupBy("label", F.col("_e.j").alias("bucket")).agg(F.sum(F.col("_e.x") * F.col("_n")).alias("s")))
    classes, theta = nb_from_stats(counts.select("label", "n"), sums, lam, num_features,
                                   categories=counts.select("label", "category"))
    return SppmiNB(feats, labels, materialize(classes), materialize(theta))
