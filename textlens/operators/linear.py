"""One-vs-rest linear models (M4, M8, M9): weights per (label, bucket) and
an intercept per label, scored with the shared sparse scorer.

``p[c] = sigmoid(b[c] + w[c] . x)``; the prediction is the class with the
highest margin ``b + w . x``, so the highest probability, ties to the lower
label, and its confidence is that un-normalised probability (M4). The binary variant folds the
probability of class "1" into (category, confidence) (M8).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.functions.mathfn import sigmoid
from textlens.operators.features import hashed_tf, tfidf, with_grams, with_terms
from textlens.operators.naive_bayes import NBModel
from textlens.operators.scoring import (class_params, class_scores, dense_gains, fits_a_row, pivot_coef, row_scores,
                                        sigmoid_best)
from textlens.operators.util import attach, bounded_join, materialize
from textlens.functions.text import bucket_of
from textlens.session import drop_paths


@dataclass
class LinearModel:
    n_gram: int
    num_features: int
    labels: list[float]
    weights: DataFrame      # (label, bucket, weight)
    classes: DataFrame      # (label, intercept, category)
    idf_table: DataFrame | None = None
    idf_counts: DataFrame | None = None
    gains: DataFrame | None = None  # one row: gains as arrays (models within the broadcast limit)
    made: list[str] = field(default_factory=list)

    def with_gains(self) -> "LinearModel":
        """Precompute the gains of a model within the broadcast limit."""
        n = len(self.labels)
        if self.gains is None and fits_a_row(self.weights, n, self.num_features):
            rows = pivot_coef(self.weights, self.labels, coef_col="weight")
            idf = F.lit(1.0)
            if self.idf_table is not None:
                rows = rows.join(self.idf_table.select("bucket", "idf"), "bucket", "left")
                rows = attach(rows, self.idf_counts, [], ["idf_default"])
                idf = F.coalesce("idf", "idf_default")
            g = F.array(*[idf * F.coalesce(F.col("_w")[i], F.lit(0.0)) for i in range(n)])
            rows = rows.select("bucket", g.alias("_g"), F.array(*[F.lit(0.0)] * n).alias("_d"))
            self.gains = materialize(dense_gains(rows, n, self.num_features), self.made)
        return self

    def drop(self) -> None:
        """Delete this model's scratch tables; nothing may read it any more."""
        drop_paths(self.weights.sparkSession, self.made)
        self.made = []

    def in_rows(self) -> bool:
        return self.gains is not None and fits_a_row(self.weights, len(self.labels), self.num_features)

    def bases(self) -> DataFrame:
        p = class_params(self.classes, self.labels, [], ["intercept", "category"])
        return p.select(F.col("_intercept").alias("_base"), F.col("_category").alias("category"))

    def features(self, docs: DataFrame, ids: list[str] = ("doc_id",), text_col: str = "text",
                 outer: bool = False) -> DataFrame:
        tf = hashed_tf(docs, self.n_gram, self.num_features, ids=ids, text_col=text_col, outer=outer)
        if self.idf_table is None:
            return tf.withColumn("x", F.col("tf").cast("double"))
        return tfidf(tf, self.idf_table, self.idf_counts, self.num_features, ids=ids)

    def scores(self, docs: DataFrame, ids: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
        if self.in_rows():
            terms = with_terms(docs.select(*ids, text_col), self.n_gram, self.num_features, text_col)
            return row_scores(terms, self.gains, self.bases(), len(self.labels), list(ids), extra=["category"])
        return class_scores(self.features(docs, ids, text_col, outer=True), self.weights, self.classes, self.labels,
                            self.num_features, ids=ids, coef_col="weight", base_col="intercept",
                            extra_class_cols=["category"])

    def predict(self, docs: DataFrame, ids: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
        """M4: ``(ids..., category, confidence, label, margin)``."""
        ids = list(ids)
        best = sigmoid_best(self.scores(docs, ids, text_col), self.labels, categories_col="category")
        return best.select(*ids, "category", "confidence", "label", "margin")

    def probability(self, docs: DataFrame, label: float = 1.0, ids: list[str] = ("doc_id",),
                    text_col: str = "text") -> DataFrame:
        """``(ids..., p)``: sigmoid probability of one class."""
        i = self.labels.index(label)
        return self.scores(docs, ids, text_col).select(*ids, sigmoid(F.col("z")[i]).alias("p"))


def binary_confidence(prob: DataFrame, ids: list[str] = ("doc_id",), p_col: str = "p") -> DataFrame:
    """M8: category "1" when p > 0.5 else "0"; confidence p or 1 - p."""
    p = F.col(p_col)
    return prob.select(*ids, F.when(p > 0.5, "1").otherwise("0").alias("category"),
                       F.when(p > 0.5, p).otherwise(1 - p).alias("confidence"))


def nb_log_odds(nb: NBModel, positive: float = 1.0, negative: float = 0.0) -> LinearModel:
    """Deterministic binary weights from a Naive Bayes model: for the positive
    class ``w_j = theta_1j - theta_0j`` and ``b = pi_1 - pi_0`` (the negative
    class gets the opposite), over all ``num_features`` buckets. Within the
    broadcast limit its tables are projections of those of ``nb``."""
    spark = nb.theta.sparkSession
    th = nb.theta
    cls = nb.classes
    pos_c = cls.where(F.col("label") == positive).select(F.col("default").alias("d1"), F.col("pi").alias("p1"))
    neg_c = cls.where(F.col("label") == negative).select(F.col("default").alias("d0"), F.col("pi").alias("p0"))
    buckets = spark.range(nb.num_features).withColumnRenamed("id", "bucket")
    t1 = th.where(F.col("label") == positive).select("bucket", F.col("theta").alias("t1"))
    t0 = th.where(F.col("label") == negative).select("bucket", F.col("theta").alias("t0"))
    dense = buckets.join(t1, "bucket", "left").join(t0, "bucket", "left")
    dense = attach(attach(dense, pos_c, [], ["d1"]), neg_c, [], ["d0"])
    w = F.coalesce(F.col("t1"), F.col("d1")) - F.coalesce(F.col("t0"), F.col("d0"))
    weights = dense.select("bucket", w.alias("w")).select(
        "bucket", F.explode(F.array(F.struct(F.lit(positive).alias("label"), F.col("w").alias("weight")),
                                    F.struct(F.lit(negative).alias("label"), (-F.col("w")).alias("weight"))))
    ).select("bucket", F.col("col.label").alias("label"), F.col("col.weight").alias("weight"))
    b = attach(attach(cls.select("label", "category"), pos_c, [], ["p1"]), neg_c, [], ["p0"])
    classes = b.select("label", "category",
                       F.when(F.col("label") == positive, F.col("p1") - F.col("p0"))
                       .otherwise(F.col("p0") - F.col("p1")).alias("intercept"))
    if nb.in_rows():  # the difference of two classes' gains, bucket by bucket
        less = lambda a, b: F.zip_with(f"_g{nb.labels.index(a)}", f"_g{nb.labels.index(b)}", lambda x, y: x - y)
        gains = nb.gains.select(less(negative, positive).alias("_g0"), less(positive, negative).alias("_g1"))
        return LinearModel(nb.n_gram, nb.num_features, [negative, positive], weights, classes, nb.idf_table,
                           nb.idf_counts, gains)
    made: list[str] = []
    return LinearModel(nb.n_gram, nb.num_features, [negative, positive], materialize(weights, made),
                       materialize(classes, made), nb.idf_table, nb.idf_counts, made=made).with_gains()


def readable_weights(docs: DataFrame, model: LinearModel, label: float = 1.0, text_col: str = "text") -> DataFrame:
    """M9: ``(gram, bucket, weight)`` for every distinct gram of ``docs``: the
    invertible view of a hashed model."""
    grams = (with_grams(docs.select(text_col), model.n_gram, text_col)
             .select(F.explode_outer("grams").alias("gram")).where(F.col("gram").isNotNull()).distinct())
    w = model.weights.where(F.col("label") == label).select("bucket", "weight")
    grams = grams.withColumn("bucket", bucket_of(F.col("gram"), model.num_features))
    return bounded_join(grams, w, ["bucket"], "left", model.num_features, 24, salt_col="gram")
