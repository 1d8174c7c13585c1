"""Logistic-regression fits through ``pyspark.ml`` (M5, M6, M7, E5).

Features come from ``HashingTF`` + ``IDF`` stages (Spark's own hashing) on
the same n-gram arrays as the relational path. One binary model per label
(one-vs-rest, 0/1 label columns from F13), each fitted by Spark's
distributed L-BFGS (L2) or OWL-QN (L1); predictions follow the M4 rule on
the per-class margins. The fitted coefficients live in the model objects, as
in ``pyspark.ml``; scoring is a distributed ``transform``.

``LogisticRegression`` standardises features while fitting (its penalty then
applies to standardised coefficients); ``standardization`` is a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.functions.mathfn import sigmoid
from textlens.functions.text import clean_text
from textlens.operators.features import ovr_columns, with_grams
from textlens.operators.naive_bayes import known_labels, label_counts
from textlens.operators.scoring import class_params, sigmoid_best
from textlens.operators.util import attach, materialize
from textlens.session import drop_paths


def gram_column(docs: DataFrame, n_gram: int, text_col: str = "text", upto: bool = False,
                clean: bool = False) -> DataFrame:
    """Add ``grams``: exactly-n grams, or every order 1..n when ``upto``; a null
    text has none."""
    none = F.array().cast("array<string>")
    src = docs.withColumn("_text", clean_text(F.col(text_col)) if clean else F.col(text_col))
    if not upto:
        return with_grams(src, n_gram, "_text", "grams").withColumn("grams", F.coalesce("grams", none)).drop("_text")
    out = src
    for n in range(1, n_gram + 1):
        out = with_grams(out, n, "_text", f"_g{n}")
    return (out.withColumn("grams", F.coalesce(F.concat(*[F.col(f"_g{n}") for n in range(1, n_gram + 1)]), none))
            .drop("_text", *[f"_g{n}" for n in range(1, n_gram + 1)]))


def featurizer(num_features: int, idf: bool = True) -> Pipeline:
    stages = [HashingTF(inputCol="grams", outputCol="_tf" if idf else "features", numFeatures=num_features)]
    if idf:
        stages.append(IDF(inputCol="_tf", outputCol="features"))
    return Pipeline(stages=stages)


@dataclass
class OvrLogistic:
    n_gram: int
    num_features: int
    labels: list[float]
    features_model: PipelineModel
    models: list[LogisticRegressionModel]
    categories: DataFrame
    upto: bool = False
    clean: bool = False
    mirrored: bool = False  # two labels: one model for labels[1]; labels[0] gets the negated margin

    def margins(self, docs: DataFrame, ids: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
        """``(ids..., z array<double>)``: raw margins aligned with ``labels``."""
        ids = list(ids)
        feats = self.features_model.transform(
            gram_column(docs.select(*ids, text_col), self.n_gram, text_col, self.upto, self.clean))
        return add_margins(feats, self.models, ids, self.mirrored)

    def probabilities(self, docs: DataFrame, ids: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
        """``(ids..., p array<double>)`` aligned with ``labels``."""
        return self.margins(docs, ids, text_col).select(*ids, F.transform("z", sigmoid).alias("p"))

    def predict(self, docs: DataFrame, ids: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
        """M4 rule on the margins: ``(ids..., category, confidence, label, margin)``."""
        cats = class_params(self.categories, self.labels, [], ["category"])
        return best_of_margins(self.margins(docs, ids, text_col), cats, self.labels, list(ids))


def add_margins(feats: DataFrame, models: list[LogisticRegressionModel], ids: list[str], mirrored: bool) -> DataFrame:
    """``(ids..., z array)`` of rows with a ``features`` vector."""
    out = feats.select(*ids, "features")
    for i, m in enumerate(models):
        m = m.copy().setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_y{i}")
        out = m.transform(out).select(*ids, "features", *[f"_z{j}" for j in range(i)],
                                      vector_to_array(f"_r{i}")[1].alias(f"_z{i}"))
    z = [-F.col("_z0"), F.col("_z0")] if mirrored else [F.col(f"_z{i}") for i in range(len(models))]
    return out.select(*ids, F.array(*z).alias("z"))


def best_of_margins(margins: DataFrame, categories: DataFrame, labels: list[float], ids: list[str]) -> DataFrame:
    """M4 rule: ``(ids..., category, confidence, label, margin)``; ``categories``
    is one row with the array ``_category``."""
    best = sigmoid_best(attach(margins, categories, [], ["_category"]), labels, categories_col="_category")
    return best.select(*ids, "category", "confidence", "label", "margin")


def fit_labels(points: DataFrame, labels: list[float], mirrored: bool, reg: float, max_iter: int,
               elastic_net: float, standardization: bool = True) -> list[LogisticRegressionModel]:
    """One binary fit per label on ``points (label, features)``, or the one that
    serves both of two labels."""
    wanted = labels[1:] if mirrored else labels
    data, models = ovr_columns(points, wanted), []
    for l in wanted:
        lr = LogisticRegression(maxIter=max_iter, regParam=reg, elasticNetParam=elastic_net, threshold=0.5,
                                labelCol=str(int(l)), featuresCol="features", standardization=standardization)
        models.append(lr.fit(data.select(str(int(l)), "features")))
    return models


def fit_ovr_logistic(observations: DataFrame, n_gram: int, num_features: int, reg: float,
                     max_iter: int = 10, elastic_net: float = 0.0, upto: bool = False,
                     clean: bool = False, idf: bool = True, labels: list[float] | None = None,
                     standardization: bool = True) -> OvrLogistic:
    """M5 (L2, ``elastic_net=0``) / M6 (L1, ``elastic_net=1``): one binary
    logistic regression per label on 0/1 columns named by the integer label."""
    counts = label_counts(observations)
    found = known_labels(counts)
    labels = labels if labels is not None else found
    grams = gram_column(observations.select("doc_id", "label", "text", "category"), n_gram, "text", upto, clean)
    # hashed once: IDF and the fit (which caches its own blocks) read the term vectors
    made: list[str] = []
    tf, *weigh = featurizer(num_features, idf).getStages()
    hashed = materialize(tf.transform(grams).select("label", tf.getOutputCol()), made)
    fm = PipelineModel([tf, *(s.fit(hashed) for s in weigh)])
    # with two labels the two one-vs-rest problems are the same problem with
    # the 0/1 target flipped; the logistic loss and the penalties are symmetric
    # under that flip, so the second model is the first negated: fit one
    mirrored = len(labels) == 2
    data = PipelineModel(fm.stages[1:]).transform(hashed).select("label", "features")
    try:
        models = fit_labels(data, labels, mirrored, reg, max_iter, elastic_net, standardization)
    finally:
        drop_paths(data.sparkSession, made)
    return OvrLogistic(n_gram, num_features, labels, fm, models, counts.select("label", "category"), upto, clean,
                       mirrored)


def fold_logistic_predictions(observations: DataFrame, folds: DataFrame, k: int, n_gram: int,
                              num_features: int, regs: list[float], max_iter: int = 10,
                              parallelism: int = 4) -> DataFrame:
    """E5 for logistic regression: for every regParam and fold, features and
    models fitted on the training folds only, test fold predicted.
    ``(reg, fold, doc_id, category, confidence, actual)``.

    Texts are hashed once into cached term vectors with their fold; each fold
    fits one IDF, and all values of ``regs`` train on its cached vectors. The
    folds are independent distributed jobs; like
    ``CrossValidator(parallelism=...)`` up to ``parallelism`` of them are
    submitted at once so small fits share the cluster. The predictions, one
    narrow row per document and value, are written before the cache goes."""
    from concurrent.futures import ThreadPoolExecutor

    labels = known_labels(label_counts(observations))
    mirrored = len(labels) == 2
    grams = gram_column(observations.select("doc_id", "text", "label", "category"), n_gram)
    hashed = HashingTF(inputCol="grams", outputCol="_tf", numFeatures=num_features).transform(grams)
    data = (hashed.select("doc_id", "label", "category", "_tf")
            .join(folds.select("doc_id", "fold"), "doc_id").persist())

    def one(f):
        train, test = data.where(F.col("fold") != f), data.where(F.col("fold") == f)
        idf = IDF(inputCol="_tf", outputCol="features").fit(train)
        points = idf.transform(train).select("label", "features").persist()
        try:
            models = [fit_labels(points, labels, mirrored, reg, max_iter, 0.0) for reg in regs]
        finally:
            points.unpersist()
        cats = class_params(label_counts(train).select("label", "category"), labels, [], ["category"])
        feats = idf.transform(test)
        parts = [best_of_margins(add_margins(feats, m, ["doc_id", "category"], mirrored)
                                 .withColumnRenamed("category", "actual"), cats, labels, ["doc_id", "actual"])
                 .select(F.lit(float(reg)).alias("reg"), F.lit(f).alias("fold"), "doc_id", "category", "confidence",
                         "actual") for reg, m in zip(regs, models, strict=True)]
        return materialize(reduce(DataFrame.unionByName, parts))

    try:
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, k))) as pool:
            return reduce(DataFrame.unionByName, list(pool.map(one, range(k))))
    finally:
        data.unpersist()


def nonzero_weights(model: OvrLogistic) -> list[int]:
    """Number of non-zero coefficients of each class model (L1 sparsity)."""
    counts = [int(m.coefficients.numNonzeros()) for m in model.models]
    return counts * 2 if model.mirrored else counts
