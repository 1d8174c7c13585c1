"""Evaluation: k-fold split (E2), fold accuracy (E3/E4), parameter grid
(E5), training-set accuracy (E6) and expected (soft) accuracy (E7).

k-fold Naive Bayes in one job. With TF-IDF features the per-fold fit
factorises: ``S[f, c, j] = idf_f(j) * T[f, c, j]`` where ``T`` is the raw
term-frequency sum, and every training-fold statistic is the sum of the
statistics of the other folds. So the documents are aggregated once per
(test fold, label, bucket) — a table of at most ``k * C * V`` rows — and each
training fold is rebuilt by exploding that small table to the ``k - 1`` folds
it trains. Texts are hashed once; of the corpus the fold of each id and the term
arrays are written, which the statistics and the scoring read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.operators.features import explode_terms, with_terms
from textlens.operators.naive_bayes import known_labels, label_counts, nb_from_stats, nb_gains
from textlens.operators.rowindex import row_index
from textlens.operators.scoring import class_params, class_scores, fits_a_row, fold_scores, softmax_best
from textlens.operators.util import bounded_join, label_array, materialize


def assign_folds(observations: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """``(doc_id, label, category, idx, fold)``; ``fold = idx mod k``."""
    ids = observations.select(key, "label", "category")
    return row_index(ids, key).withColumn("fold", F.pmod(F.col("idx"), F.lit(k)).cast("int"))


def kfold_roles(folds: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """E2 long table ``(fold, doc_id, role)``: each document is 'test' in its
    own fold and 'train' in the other ``k - 1``."""
    return folds.select(
        key, F.col("fold").alias("_own"),
        F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold")).select(
        "fold", key, F.when(F.col("fold") == F.col("_own"), "test").otherwise("train").alias("role"))


def to_training_folds(df: DataFrame, k: int, fold_col: str = "fold") -> DataFrame:
    """Re-key rows of test fold ``g`` to every training fold ``f != g``."""
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col(fold_col))
    return df.withColumn(fold_col, F.explode(others))


def kfold_naive_bayes(observations: DataFrame, k: int, n_gram: int, num_features: int,
                      lams: list[float], key: str = "doc_id") -> DataFrame:
    """Predict every document with the models trained without its fold.

    Returns ``(lam, fold, doc_id, category, confidence, actual)``. The grid of
    smoothing values lies on the class axis: each test document is hashed,
    looked up and summed once for all of them.
    """
    # narrow (id, label, category, idx, fold), read by four consumers: the
    # row index runs once
    folds = materialize(assign_folds(observations, k, key))
    labels = known_labels(label_counts(folds.withColumnRenamed(key, "doc_id")))
    terms = with_terms(observations.select(key, "text"), n_gram, num_features).drop("text")
    # one row per document (its compact term array) travels to meet its fold
    # and is written there: statistics and scoring read it, texts are hashed once
    placed = materialize(terms.select(key, "terms").join(folds.select(key, "fold", "label"), key))

    # per test fold g: documents, (label, bucket) tf sums and document frequencies
    stats = materialize(explode_terms(placed, ["fold", "label"]).groupBy("fold", "label", "bucket").agg(
        F.sum("tf").alias("t"), F.count(F.lit(1)).alias("dfc")))
    docs_g = folds.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"),
                                                F.max(F.struct(key, "category")).alias("_last"))
    # training fold f = all folds but f
    counts = to_training_folds(docs_g, k).groupBy("fold", "label").agg(
        F.sum("n").alias("n"), F.max("_last").getField("category").alias("category"))
    t_sums = to_training_folds(stats, k).groupBy("fold", "label", "bucket").agg(
        F.sum("t").alias("t"), F.sum("dfc").alias("dfc"))
    t_sums = materialize(t_sums)
    m = counts.groupBy("fold").agg(F.sum("n").alias("m")).withColumn("idf_default", F.log(F.col("m") + 1.0))
    idf = materialize(t_sums.groupBy("fold", "bucket").agg(F.sum("dfc").alias("df"))
                      .join(F.broadcast(m), "fold")
                      .select("fold", "bucket", F.log((F.col("m") + 1.0) / (F.col("df") + 1.0)).alias("idf")))
    sums = (t_sums.join(idf, ["fold", "bucket"])
            .select("fold", "label", "bucket", (F.col("t") * F.col("idf")).alias("s")))

    # one class axis for all (smoothing value, label) pairs
    c, n_axis = len(labels), len(labels) * len(lams)
    parts = []
    for i, lam in enumerate(lams):
        classes, theta = nb_from_stats(counts.select("fold", "label", "n"), sums, lam, num_features, keys=["fold"],
                                       categories=counts.select("fold", "label", "category"))
        axis = (F.array_position(label_array(labels), F.col("label")) - 1 + i * c).cast("double")
        parts.append((classes.withColumn("label", axis), theta.withColumn("label", axis)))
    classes = materialize(reduce(DataFrame.unionByName, [p[0] for p in parts]))
    theta = materialize(reduce(DataFrame.unionByName, [p[1] for p in parts]))
    axis = [float(i) for i in range(n_axis)]

    if fits_a_row(theta, n_axis, num_features, k):
        gains = materialize(nb_gains(classes, theta, idf, m, axis, num_features, ["fold"]))
        bases = class_params(classes, axis, ["fold"], ["pi", "category"]).select(
            "fold", F.col("_pi").alias("_base"), F.col("_category").alias("category"))
        z = fold_scores(placed.select("fold", key, "terms"), gains, bases, n_axis, num_features, k, [key], ["category"])
    else:  # test documents with their own fold's IDF (unseen bucket: ln(m + 1))
        long = explode_terms(placed, ["fold", key], outer=True)
        test_x = (bounded_join(long, idf, ["fold", "bucket"], "left", k * num_features, 32, salt_col=key)
                  .join(F.broadcast(m), "fold")
                  .select("fold", key, "bucket", (F.col("tf") * F.coalesce("idf", "idf_default")).alias("x")))
        z = class_scores(test_x, theta, classes, axis, num_features, ids=[key], keys=["fold"], n_models=k,
                         base_col="pi", slope_col="default", extra_class_cols=["category"])
    grid = F.explode(F.array(*[F.struct(F.lit(float(lam)).alias("lam"), F.slice("z", i * c + 1, c).alias("z"),
                                        F.slice("category", i * c + 1, c).alias("category"))
                               for i, lam in enumerate(lams)]))
    each = z.select("fold", key, grid.alias("_m")).select("fold", key, "_m.*")
    best = softmax_best(each, labels, [key], categories_col="category")
    actual = folds.select(key, F.col("category").alias("actual"))
    return best.select("lam", "fold", key, "category", "confidence").join(actual, key)


def accuracy(pred: DataFrame, by: list[str], predicted: str = "category", actual: str = "actual") -> DataFrame:
    """``(by..., n_test, accuracy)``, the mean of predicted == actual."""
    return pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias("accuracy"))


def soft_accuracy(probs: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per class ``mean(p * y + (1 - p) * (1 - y))`` with ``y`` the 0/1
    indicator of that class; ``probs (key, label, score)``, ``truth (key, label)``."""
    y = (F.col("label") == F.col("_true")).cast("double")
    p = F.col("score")
    return (probs.join(truth.select(key, F.col("label").alias("_true")), key)
            .groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                  F.avg(p * y + (1 - p) * (1 - y)).alias("soft_accuracy")))
