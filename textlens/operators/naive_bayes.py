"""Multinomial Naive Bayes (M1-M3) as relational aggregates.

Fit (same closed forms as Spark MLlib's multinomial Naive Bayes)::

    pi[c]       = ln(n_c + lambda) - ln(N + C * lambda)
    theta[c, j] = ln(S[c, j] + lambda) - ln(S[c] + V * lambda)

with ``n_c`` documents of class ``c`` (documents without any gram count
too), ``S[c, j]`` the summed feature value of bucket ``j`` in class ``c`` and
``V = num_features`` (not the vocabulary seen). A bucket never seen in class
``c`` has ``theta = ln(lambda) - ln(S[c] + V * lambda)``: the per-class
``default`` column, so the theta table stays sparse.

With TF-IDF features ``S[c, j] = idf_j * T[c, j]``, so one aggregate of the
term counts by (label, bucket), a table of at most classes x features rows,
holds document frequencies, IDF and sums: the corpus is read once and never
cached or joined.

Everything is keyed by optional ``keys`` (e.g. ``fold`` or ``lam``), so many
models (k folds x a parameter grid) fit in one job from one set of
sufficient statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.operators.features import hashed_tf, tfidf, with_terms
from textlens.operators.scoring import (class_params, class_scores, dense_gains, fits_a_row, pivot_coef, row_scores,
                                        softmax_best, softmax_probs)
from textlens.operators.util import attach, label_array, materialize
from textlens.session import drop_paths


def nb_stats(points: DataFrame, docs: DataFrame, keys: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Sufficient statistics: ``counts (keys..., label, n)`` from the documents
    and ``sums (keys..., label, bucket, s)`` from the long features."""
    keys = list(keys)
    counts = docs.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    sums = points.groupBy(*keys, "label", "bucket").agg(F.sum("x").alias("s"))
    return counts, sums


def nb_from_stats(counts: DataFrame, sums: DataFrame, lam: float | str, num_features: int,
                  keys: list[str] = (), categories: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Closed-form fit from the statistics. ``lam`` is a number or the name of
    a key column holding it (parameter grids).

    Returns ``classes (keys..., label, n, pi, s_c, default[, category])`` and
    ``theta (keys..., label, bucket, s, theta, coef)`` with ``coef = theta - default``.
    """
    keys = list(keys)
    lam_c: Column = F.col(lam) if isinstance(lam, str) else F.lit(float(lam))
    v = float(num_features)
    mass = sums.groupBy(*keys, "label").agg(F.sum("s").alias("s_c"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_N"), F.count(F.lit(1)).alias("_C"))
    classes = attach(counts.join(mass, keys + ["label"], "left"), totals, keys, ["_N", "_C"])
    classes = (classes.withColumn("s_c", F.coalesce(F.col("s_c"), F.lit(0.0)))
               .withColumn("pi", F.log(F.col("n") + lam_c) - F.log(F.col("_N") + F.col("_C") * lam_c))
               .withColumn("default", F.log(lam_c) - F.log(F.col("s_c") + v * lam_c))
               .drop("_N", "_C"))
    if categories is not None:
        classes = classes.join(categories, keys + ["label"], "left")
    theta = (sums.join(classes.select(*keys, "label", "s_c", "default"), keys + ["label"])
             .withColumn("theta", F.log(F.col("s") + lam_c) - F.log(F.col("s_c") + v * lam_c))
             .withColumn("coef", F.col("theta") - F.col("default"))
             .drop("s_c", "default"))
    return classes, theta


def nb_gains(classes: DataFrame, theta: DataFrame, idf_table: DataFrame, idf_counts: DataFrame,
             labels: list[float], num_features: int, keys: list[str] = ()) -> DataFrame:
    """What each bucket adds to each class (``scoring.dense_gains``): IDF times
    theta; an unseen bucket has the default IDF and the default theta."""
    keys, n = list(keys), len(labels)
    params = class_params(classes, labels, keys, ["default"])
    rows = idf_table.select(*keys, "bucket", "idf").join(pivot_coef(theta, labels, keys), [*keys, "bucket"], "left")
    rows = attach(attach(rows, params, keys, ["_default"]), idf_counts, keys, ["idf_default"])
    gains = rows.select(
        *keys, "bucket",
        F.array(*[F.col("idf") * (F.col("_default")[i] + F.coalesce(F.col("_w")[i], F.lit(0.0))) for i in range(n)]).alias("_g"),
        F.array(*[F.col("idf_default") * F.col("_default")[i] for i in range(n)]).alias("_d"))
    return dense_gains(gains, n, num_features, keys)


@dataclass
class NBModel:
    """A fitted text classifier: hashing + IDF parameters and NB tables."""
    n_gram: int
    num_features: int
    labels: list[float]
    classes: DataFrame
    theta: DataFrame
    idf_table: DataFrame
    idf_counts: DataFrame
    wide: DataFrame | None = None   # theta pivoted to one row per bucket
    gains: DataFrame | None = None  # one row: gains as arrays (models within the broadcast limit)
    made: list[str] = field(default_factory=list)  # scratch tables of this model

    def features(self, docs: DataFrame, ids: list[str] = ("doc_id",), text_col: str = "text",
                 outer: bool = False) -> DataFrame:
        """Text -> TF-IDF long form with this model's hashing and IDF."""
        tf = hashed_tf(docs, self.n_gram, self.num_features, ids=ids, text_col=text_col, outer=outer)
        return tfidf(tf, self.idf_table, self.idf_counts, self.num_features, ids=ids)

    def in_rows(self) -> bool:
        return self.gains is not None and fits_a_row(self.theta, len(self.labels), self.num_features)

    def bases(self) -> DataFrame:
        p = class_params(self.classes, self.labels, [], ["pi", "category"])
        return p.select(F.col("_pi").alias("_base"), F.col("_category").alias("category"))

    def scores(self, docs: DataFrame, ids: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
        """``(ids..., z array, category array)`` for every row of ``docs``."""
        ids = list(ids)
        if self.in_rows():
            terms = with_terms(docs.select(*ids, text_col), self.n_gram, self.num_features, text_col)
            return row_scores(terms, self.gains, self.bases(), len(self.labels), ids, extra=["category"])
        return class_scores(self.features(docs, ids, text_col, outer=True), self.theta, self.classes, self.labels,
                            self.num_features, ids=ids, base_col="pi", slope_col="default",
                            extra_class_cols=["category"], wide=self.wide)

    def predict(self, docs: DataFrame, ids: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
        """M3: ``(ids..., category, confidence, label, margin)``; category "" when
        the label has no category."""
        ids = list(ids)
        best = softmax_best(self.scores(docs, ids, text_col), self.labels, ids, categories_col="category")
        return best.select(*ids, "category", "confidence", "label", "margin")

    def probabilities(self, docs: DataFrame, ids: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
        """M2: ``(ids..., label, score)``, softmax over the classes."""
        return softmax_probs(self.scores(docs, ids, text_col), self.labels, list(ids))

    def drop(self) -> None:
        """Delete this model's scratch tables; nothing may read it any more."""
        drop_paths(self.theta.sparkSession, self.made)
        self.made = []


def label_counts(observations: DataFrame) -> DataFrame:
    """``(label, n, category)``: documents and one category (F12) per label."""
    return observations.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max_by("category", "doc_id").alias("category"))


def known_labels(counts: DataFrame) -> list[float]:
    """The label values; ``ValueError`` on an empty training set."""
    found = sorted(r[0] for r in counts.select("label").collect())  # a handful of classes
    if not found:
        raise ValueError("training observations are empty: check the source filters and label mapping")
    return found


def fit_naive_bayes(observations: DataFrame, n_gram: int = 1, num_features: int = 5000,
                    lam: float = 1.0, labels: list[float] | None = None,
                    materialized: bool = True) -> NBModel:
    """Fit IDF and Naive Bayes on ``observations (doc_id, label, text, category)``.

    The statistics (at most classes x features rows) and the gains that score
    texts are materialized once (``materialize``); every other model table is
    a small closed form of the statistics.
    Raises ``ValueError`` on an empty training set (S7).
    """
    return fit_naive_bayes_many(observations, n_gram, num_features, [lam], labels, materialized)[0]


def fit_naive_bayes_many(observations: DataFrame, n_gram: int, num_features: int, lams: list[float],
                         labels: list[float] | None = None, materialized: bool = True) -> list[NBModel]:
    """One model per smoothing value from ONE pass over the text: hashing,
    IDF and the sufficient statistics are shared; only the closed forms
    differ per ``lambda``. The models share scratch tables.

    The statistics are one row per bucket, document frequency and each class's
    term sum; per class there are a few numbers (documents, mass), which the
    plans below hold as literals, so every table of a model is a projection
    of the statistics, without a join."""
    made: list[str] = []
    keep = (lambda d: materialize(d, made)) if materialized else (lambda d: d)
    spark = observations.sparkSession
    per = {r["label"]: r for r in label_counts(observations).collect()}  # a handful of classes
    found = sorted(per)
    if not found:
        raise ValueError("training observations are empty: check the source filters and label mapping")
    labels = labels if labels is not None else found
    tf = hashed_tf(observations, n_gram, num_features, ids=["doc_id"], carry=["label"])
    stats = keep(tf.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("df"), F.array(*[F.sum(F.when(F.col("label") == F.lit(l), F.col("tf"))) for l in found]).alias("t")))
    m = sum(r["n"] for r in per.values())
    idf = F.log(F.lit(m + 1.0) / (F.col("df") + 1.0))
    idf_table = stats.select("bucket", "df", idf.alias("idf"))
    idf_counts = spark.createDataFrame([(m, math.log(m + 1.0))], "m bigint, idf_default double")
    mass = stats.agg(*[F.coalesce(F.sum(F.col("t")[i] * idf), F.lit(0.0)).alias(f"s{i}") for i in range(len(found))]).first()
    sums = stats.select("bucket", idf.alias("idf"), F.explode(F.array(*[
        F.struct(F.lit(l).alias("label"), (F.col("t")[i] * idf).alias("s")) for i, l in enumerate(found)])).alias("e"))
    sums = sums.select("e.label", "bucket", "e.s").where(F.col("s").isNotNull())
    models = []
    for lam in lams:
        norm = [math.log(x + num_features * lam) for x in mass]
        default = [math.log(lam) - x for x in norm]
        prior = [math.log(per[l]["n"] + lam) - math.log(m + len(found) * lam) for l in found]
        classes = spark.createDataFrame(
            [(l, per[l]["n"], float(mass[i]), prior[i], default[i], per[l]["category"]) for i, l in enumerate(found)],
            "label double, n bigint, s_c double, pi double, default double, category string")
        at = F.array_position(label_array(found), F.col("label")).cast("int")
        theta = sums.withColumn("theta", F.log(F.col("s") + F.lit(float(lam))) - F.element_at(label_array(norm), at))
        theta = theta.withColumn("coef", F.col("theta") - F.element_at(label_array(default), at))
        model = NBModel(n_gram, num_features, labels, classes, theta, idf_table, idf_counts, made=made)
        if not fits_a_row(theta, len(labels), num_features):
            model.wide = keep(pivot_coef(theta, labels))
        else:
            def gain(l, unseen, lam=lam, norm=norm, default=default):
                if l not in per:
                    return F.lit(None).cast("double")
                i = found.index(l)
                if unseen:
                    return F.lit(math.log(m + 1.0) * default[i])
                s = F.coalesce(F.col("t")[i] * idf, F.lit(0.0))
                return idf * (F.log(s + F.lit(float(lam))) - F.lit(norm[i]))
            rows = stats.select("bucket", F.array(*[gain(l, False) for l in labels]).alias("_g"),
                                F.array(*[gain(l, True) for l in labels]).alias("_d"))
            model.gains = keep(dense_gains(rows, len(labels), num_features))
        models.append(model)
    return models
