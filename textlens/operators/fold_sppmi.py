"""k-fold evaluation on SPPMI document vectors (E5 at the reference's own
evaluation setting) from one Gramian pass.

Documents are counted in planes, one per (test fold, label). A training
fold's co-occurrence is the sum of all planes less its own test fold's, so k
SPPMI tables, their document numbers and the per-class document frequencies
all follow from the same table of at most V^2 / 2 pairs.

Vectors are additive (F8), ``x[d, j] = sum over the buckets i of d of s[i, j]``, so a
linear learner on them never needs the vectors of the documents it scores:

* Naive Bayes: ``S[c, j] = sum_i s[i, j] df[c, i]`` with ``df[c, i]`` the training
  documents of class c that have bucket i; the score of a document is the
  prior plus, for each of its buckets, ``gain[c, i] = sum_j s[i, j] theta[c, j]``.
* Logistic regression trains on the vectors (``csr.row_sums``), and scores with
  ``gain[c, i] = sum_j s[i, j] weight[c, j]``.

All folds are scored in one map-only pass: the gains of fold f and bucket i
stand at place f V + i of one array, a literal of the plan, no join. Texts that
training has not seen are scored from their own buckets.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.operators.cooccur import presence_arrays
from textlens.operators.csr import row_sums
from textlens.operators.evaluate import assign_folds
from textlens.operators.features import with_terms
from textlens.operators.gramian import gramian
from textlens.operators.mlfit import fit_labels
from textlens.operators.naive_bayes import known_labels, label_counts
from textlens.operators.represent import sparse_points
from textlens.operators.scoring import dense_gains, fits_a_row, row_scores, sigmoid_best, softmax_best
from textlens.operators.util import attach, bounded_join, broadcast_if_bounded, label_array, materialize
from textlens.session import drop_paths


@dataclass
class FoldSppmi:
    """What the one pass leaves: k SPPMI tables side by side."""
    k: int
    n_gram: int
    num_features: int
    labels: list[float]
    placed: DataFrame    # (doc_id, fold, label, category, text): every observation and its test fold
    present: DataFrame   # (doc_id, fold, label, category, b): the same with the buckets of the text, written once
    classes: DataFrame   # (fold, label, n, total, category): of each training fold
    rows: DataFrame      # (i, j, s array<k>): both triangles, null where not positive
    freq: DataFrame      # (bucket, df array): training documents, at fold * classes + class
    made: list[str] = field(default_factory=list)

    def drop(self) -> None:
        """Delete the scratch tables; nothing may read them any more."""
        drop_paths(self.rows.sparkSession, self.made)
        self.made = []


def _less_own(c: Column, k: int, n_labels: int) -> list[Column]:
    """Of an array of counts per (fold, label): each training fold's sum."""
    total = F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    own = [sum((c[f * n_labels + l] for l in range(1, n_labels)), c[f * n_labels]) for f in range(k)]
    return [total - x for x in own]


def fit_fold_sppmi(observations: DataFrame, k: int, n_gram: int, num_features: int, shift: float = 10.0,
                   key: str = "doc_id") -> FoldSppmi:
    """One pass over the text, which leaves the buckets of each document;
    everything else is of model size."""
    made: list[str] = []
    folds = materialize(assign_folds(observations, k, key), made)
    labels = known_labels(label_counts(folds.withColumnRenamed(key, "doc_id")))
    n_labels = len(labels)
    per = materialize(folds.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"),
                                                         F.max(F.struct(key, "category")).alias("_last")), made)
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("_own")))
    classes = (per.withColumnRenamed("fold", "_own").select(others.alias("fold"), "label", "n", "_last")
               .groupBy("fold", "label").agg(F.sum("n").alias("n"), F.max("_last")["category"].alias("category")))
    totals = classes.groupBy("fold").agg(F.sum("n").alias("total"))
    classes = materialize(classes.join(totals, "fold"), made)
    n = {r["fold"]: r["total"] for r in totals.collect()}  # k numbers

    placed = observations.select(key, "text").join(folds.select(key, "fold", "label", "category"), key)
    at = F.array_position(label_array(labels), F.col("label")) - 1
    # terms before the join: buckets travel to meet their fold, no text does
    terms = with_terms(observations.select(key, "text"), n_gram, num_features).select(key, "terms")
    present = terms.join(folds.select(key, "fold", "label", "category"), key)
    present = materialize(presence_arrays(present, [key, "fold", "label", "category"]), made)
    planes = present.select((F.col("fold") * n_labels + at).alias("_plane"), "b")
    pairs = materialize(gramian(planes, num_features, plane="_plane", n_planes=k * n_labels), made)

    counts = pairs.select("i", "j", F.array(*_less_own(F.col("c"), k, n_labels)).alias("c"), F.col("c").alias("_all"))
    diag = counts.where("i = j")
    df = [F.aggregate(F.array(*[F.col("_all")[g * n_labels + l] for g in range(k) if g != f] or [F.lit(0)]),
                      F.lit(0).cast("bigint"), lambda a, x: a + x) for f in range(k) for l in range(n_labels)]
    freq = materialize(diag.select(F.col("i").alias("bucket"), F.array(*df).alias("df")), made)
    side = lambda name, c: broadcast_if_bounded(diag.select(F.col("i").alias(name), F.col("c").alias(c)), num_features, 16 + 8 * k)
    x = counts.select("i", "j", "c").join(side("i", "cii"), "i").join(side("j", "cjj"), "j")
    wide = lambda c: c.cast("decimal(19,0)")
    values = []
    for f in range(k):
        c, cii, cjj = (F.col(a)[f] for a in ("c", "cii", "cjj"))
        positive = wide(c) * wide(F.lit(n.get(f, 0))) > F.lit(Decimal(str(shift))) * (wide(cii) * wide(cjj))
        value = F.log2(c) + F.log2(F.lit(float(n.get(f, 0)))) - F.log2(cii) - F.log2(cjj) - F.log2(F.lit(float(shift)))
        values.append(F.when(positive, value))
    upper = x.select("i", "j", F.array(*values).alias("s")).where(F.exists("s", lambda v: v.isNotNull()))
    upper = materialize(upper, made)
    rows = upper.unionByName(upper.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "s"))
    return FoldSppmi(k, n_gram, num_features, labels, placed, present, classes, rows, freq, made)


def _scored(m: FoldSppmi, gains: DataFrame, bases: DataFrame, n_axis: int, key: str) -> DataFrame:
    """``(fold, key, category, z)``: every document with the gains of its fold.
    ``gains (bucket, _g array of k * n_axis)``, ``bases (base array of k * n_axis)``."""
    v, spark = m.num_features, gains.sparkSession
    long = gains.select("bucket", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(m.k - 1)), lambda f: F.slice(
        "_g", f * n_axis + 1, n_axis))).alias("_f", "_g"))
    shifted = long.select((F.col("_f") * v + F.col("bucket")).alias("bucket"), "_g", F.array(*[F.lit(0.0)] * n_axis).alias("_d"))
    terms, ids = m.present, [key, "fold", "category"]
    if fits_a_row(gains, n_axis, v, m.k):
        terms = terms.withColumn("terms", F.transform("b", lambda b: F.struct(
            (F.col("fold") * v + b).alias("bucket"), F.lit(1).cast("bigint").alias("tf"))))
        zero = spark.range(1).select(F.array(*[F.lit(0.0)] * n_axis).alias("_base"))
        table = materialize(dense_gains(shifted, n_axis, v * m.k), m.made)
        z = row_scores(terms, table, zero, n_axis, ids)
    else:
        at = terms.select(*ids, F.explode_outer("b").alias("_b"))
        at = at.select(*ids, (F.col("fold") * v + F.col("_b")).alias("bucket"))
        got = bounded_join(at, shifted.drop("_d"), ["bucket"], "left", v * m.k, 16 + 8 * n_axis, salt_col=key)
        z = got.groupBy(*ids).agg(F.array(*[F.coalesce(F.sum(F.col("_g")[a]), F.lit(0.0)) for a in range(n_axis)]).alias("z"))
    z = attach(z, bases, [], ["base"]).withColumn("_mine", F.slice("base", F.col("fold") * n_axis + 1, n_axis))
    return z.select(*ids, F.zip_with("z", "_mine", lambda a, b: a + b).alias("z"))


def _grid(z: DataFrame, m: FoldSppmi, name: str, values: list[float], key: str) -> DataFrame:
    """``(value, fold, key, category array, z, actual)`` from one class axis for all values."""
    c = len(m.labels)
    each = F.explode(F.array(*[F.struct(F.lit(float(x)).alias(name), F.slice("z", i * c + 1, c).alias("z"))
                               for i, x in enumerate(values)]))
    out = z.select("fold", key, F.col("category").alias("actual"), each.alias("_m")).select("fold", key, "actual", "_m.*")
    names = m.classes.groupBy("fold").agg(F.array(*[F.max(F.when(F.col("label") == l, F.col("category"))) for l in m.labels]).alias("category"))
    return out.join(F.broadcast(names), "fold")  # k rows


def _per_class(m: FoldSppmi, column: Column) -> DataFrame:
    """One row: ``column`` of the training folds' classes, at fold * classes + class."""
    place = [(f, l) for f in range(m.k) for l in m.labels]
    return m.classes.agg(F.array(*[F.max(F.when((F.col("fold") == f) & (F.col("label") == l), column)) for f, l in place]).alias("_c"))


def kfold_sppmi_naive_bayes(m: FoldSppmi, lams: list[float], key: str = "doc_id") -> DataFrame:
    """``(lam, fold, key, category, confidence, actual)``: every document
    predicted by the Naive Bayes models trained without its fold."""
    v, c, k = float(m.num_features), len(m.labels), m.k
    n = k * c
    side = broadcast_if_bounded(m.freq.withColumnRenamed("bucket", "i"), m.num_features, 16 + 8 * n)
    sums = m.rows.join(side, "i").groupBy("j").agg(F.array(*[
        F.sum(F.col("s")[a // c] * F.col("df")[a]) for a in range(n)]).alias("_s"))
    sums = materialize(sums.select("j", F.transform("_s", lambda x: F.coalesce(x, F.lit(0.0))).alias("_s")), m.made)
    mass = sums.agg(F.array(*[F.coalesce(F.sum(F.col("_s")[a]), F.lit(0.0)) for a in range(n)]).alias("_m")).scalar()
    theta = sums.select("j", F.array(*[
        F.log(F.col("_s")[f * c + l] + lam) - F.log(mass[f * c + l] + v * lam)
        for f in range(k) for lam in lams for l in range(c)]).alias("_t"))
    theta = materialize(theta, m.made)
    axis = c * len(lams)
    gains = m.rows.join(broadcast_if_bounded(theta, m.num_features, 16 + 8 * k * axis), "j").groupBy(F.col("i").alias("bucket")).agg(
        F.array(*[F.coalesce(F.sum(F.col("s")[a // axis] * F.col("_t")[a]), F.lit(0.0)) for a in range(k * axis)]).alias("_g"))
    counted = _per_class(m, F.col("n")).select(F.struct("_c").alias("a")).scalar()["_c"]
    total = _per_class(m, F.col("total")).select(F.struct("_c").alias("a")).scalar()["_c"]
    known = [sum((F.when(counted[f * c + l].isNotNull(), 1).otherwise(0) for l in range(1, c)),
                 F.when(counted[f * c].isNotNull(), 1).otherwise(0)) for f in range(k)]
    prior = [F.log(counted[f * c + l] + lam) - F.log(total[f * c + l] + known[f] * lam)
             for f in range(k) for lam in lams for l in range(c)]
    bases = materialize(sums.sparkSession.range(1).select(F.array(*prior).alias("base")), m.made)
    z = _scored(m, materialize(gains, m.made), bases, axis, key)
    best = softmax_best(_grid(z, m, "lam", lams, key), m.labels, [key], categories_col="category")
    return best.select("lam", "fold", key, "category", "confidence", "actual")


def kfold_sppmi_logistic(m: FoldSppmi, regs: list[float], max_iter: int = 10, key: str = "doc_id",
                         parallelism: int = 4) -> DataFrame:
    """``(reg, fold, key, category, confidence, actual)``: the same for logistic
    regression; the folds' fits are independent jobs."""
    c, k, v = len(m.labels), m.k, m.num_features
    mirrored = c == 2

    def one(f: int) -> list[tuple]:
        rows = m.rows.select("i", "j", F.col("s")[f].alias("s")).where("s is not null")
        vectors = row_sums(m.present.where(F.col("fold") != f).select(key, "label", "b"), rows, v, [key, "label"])
        kept: list[str] = []
        points = sparse_points(vectors, v, kept)
        found = []
        try:
            for r, reg in enumerate(regs):
                models = fit_labels(points, m.labels, mirrored, reg, max_iter, 0.0)
                signed = [(0, -1.0, models[0]), (1, 1.0, models[0])] if mirrored else [(l, 1.0, x) for l, x in enumerate(models)]
                for l, sign, model in signed:
                    place = (f * len(regs) + r) * c + l
                    found.append((place, sign * float(model.intercept), (sign * model.coefficients.toArray()).tolist()))
        finally:
            drop_paths(points.sparkSession, kept)
        return found

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, k))) as pool:
        fits = sorted(x for some in pool.map(one, range(k)) for x in some)  # k x values x classes x V numbers
    spark, axis = m.rows.sparkSession, c * len(regs)
    weights = spark.createDataFrame([(j, [float(w[j]) for _, _, w in fits]) for j in range(v)], "j long, _t array<double>")
    weights = materialize(weights, m.made)
    gains = m.rows.join(broadcast_if_bounded(weights, v, 16 + 8 * k * axis), "j").groupBy(F.col("i").alias("bucket")).agg(
        F.array(*[F.coalesce(F.sum(F.col("s")[a // axis] * F.col("_t")[a]), F.lit(0.0)) for a in range(k * axis)]).alias("_g"))
    bases = spark.range(1).select(F.array(*[F.lit(b) for _, b, _ in fits]).alias("base"))
    z = _scored(m, materialize(gains, m.made), bases, axis, key)
    best = sigmoid_best(_grid(z, m, "reg", regs, key), m.labels, categories_col="category")
    return best.select("reg", "fold", key, "category", "confidence", "actual")
