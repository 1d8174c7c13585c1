"""Sparse linear class scores, shared by Naive Bayes (M2/M3) and the
one-vs-rest linear models (M4).

For every document and class ``c`` over its hashed terms ``j``::

    z[c] = base[c] + sum_j tf_j * gain[c, j]

A model's ``gain`` holds everything about a bucket (IDF, weight, the class
default of an unseen bucket). Two plans compute the same sums:

* ``row_scores``: while the gains of all models fit the broadcast limit they
  travel as one array per class, indexed by bucket, and the sum runs over the
  term array inside the row. Map-only: one scan, no join, no shuffle, so the
  same plan serves a batch and a stream.
* ``class_scores``: beyond it, long features (one row per document and
  bucket, one with null bucket for a document without any) are joined to
  one row per bucket with salts and summed with one ``groupBy(document)``.

Decisions compare raw margins, which stay apart where probabilities have
long saturated: the margin of a class is its log-odds against the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.functions.mathfn import sigmoid
from textlens.operators.util import attach, bounded_join, broadcast_limit, label_array


def pivot_coef(coef: DataFrame, labels: list[float], keys: list[str] = (), coef_col: str = "coef") -> DataFrame:
    """``(keys..., bucket, _w array<double>)``: one row per bucket, coefficients
    aligned with ``labels`` (null where a class has none)."""
    return coef.groupBy(*keys, "bucket").agg(
        F.array(*[F.sum(F.when(F.col("label") == F.lit(l), F.col(coef_col))) for l in labels]).alias("_w"))


def fits_a_row(df: DataFrame, n_classes: int, num_features: int, n_models: int = 1) -> bool:
    """Whether dense gains of all models are within the broadcast limit."""
    return n_models * n_classes * num_features * 8 <= broadcast_limit(df)


def dense_gains(gains: DataFrame, n_classes: int, num_features: int, keys: list[str] = ()) -> DataFrame:
    """``(keys..., _g0.., _g{n-1})``: one row per model, each class's gains as
    an array indexed by bucket. ``gains (keys..., bucket, _g array<double>)`` has
    every bucket that differs from ``_d``, a column of that row's defaults."""
    spark = gains.sparkSession
    keys = list(keys)
    models = gains.select(*keys, "_d").distinct() if keys else gains.select("_d").limit(1)
    every = models.crossJoin(F.broadcast(spark.range(num_features).withColumnRenamed("id", "bucket")))
    full = every.join(gains.select(*keys, "bucket", "_g"), [*keys, "bucket"], "left")
    full = full.select(*keys, F.struct("bucket", F.coalesce("_g", "_d").alias("g")).alias("_e"))
    rows = full.groupBy(*keys).agg(F.sort_array(F.collect_list("_e")).alias("_e"))  # at most the limit


    def of_class(i: int) -> Column:
        return F.transform("_e", lambda e: e["g"][i])

    return rows.select(*keys, *[of_class(i).alias(f"_g{i}") for i in range(n_classes)])


def row_scores(terms: DataFrame, gains: DataFrame, bases: DataFrame, n_classes: int, ids: list[str],
               keys: list[str] = (), extra: list[str] = ()) -> DataFrame:
    """``(keys..., ids..., z array, extra...)`` from rows ``(keys..., ids...,
    terms)``, ``dense_gains`` and ``bases (keys..., _base array, extra...)``."""
    ids, keys, extra = list(ids), list(keys), list(extra)
    ids_only = [c for c in ids if c not in keys]
    both = attach(attach(terms, gains, keys, [f"_g{i}" for i in range(n_classes)]), bases, keys, ["_base", *extra])
    return both.select(*keys, *ids_only, _sums("terms", n_classes).alias("z"), *extra)


def add_scores(rows: DataFrame, terms_col: str, gains: DataFrame, bases: DataFrame, n_classes: int, out: str,
               extra: list[str] = ()) -> DataFrame:
    """``rows``, every one of them and with all its columns, plus ``out`` (the array
    z of one model) and the columns ``extra`` of ``bases``."""
    kept = rows.columns
    both = attach(attach(rows, gains, [], [f"_g{i}" for i in range(n_classes)]), bases, [], ["_base", *extra])
    return both.select(*kept, _sums(terms_col, n_classes).alias(out), *extra)


def fold_scores(terms: DataFrame, gains: DataFrame, bases: DataFrame, n_classes: int, num_features: int, k: int,
                ids: list[str], extra: list[str] = ()) -> DataFrame:
    """``row_scores`` of rows that each have the model of their ``fold``: the gains
    of all folds are one literal array per class, fold f's bucket j at place
    f V + j, so no model goes through a join; ``bases``, a few numbers per
    fold, are attached."""
    spark, cols = gains.sparkSession, [f"_g{i}" for i in range(n_classes)]
    none = F.array_repeat(F.lit(0.0), num_features)
    every = spark.range(k).select(F.col("id").cast("int").alias("fold")).join(gains, "fold", "left")
    one = every.agg(F.sort_array(F.collect_list(F.struct("fold", *[F.coalesce(c, none).alias(c) for c in cols]))).alias("_all"))

    def of_class(c: str) -> Column:
        return F.flatten(F.transform("_all", lambda e: e[c])).alias(c)

    one = one.select(*[of_class(c) for c in cols])  # within the limit
    rows = attach(terms, bases, ["fold"], ["_base", *extra])
    shifted = F.transform("terms", lambda t: F.struct((F.col("fold") * num_features + t["bucket"]).alias("bucket"), t["tf"].alias("tf")))
    rows = attach(rows.withColumn("terms", shifted), one, [], cols)
    return rows.select("fold", *ids, _sums("terms", n_classes).alias("z"), *extra)


def _sums(terms_col: str, n_classes: int) -> Column:
    """Base plus tf times gain over the term array, for each class."""
    def add(acc, t):
        at = t["bucket"].cast("int")
        return F.struct(*[(acc[f"z{i}"] + t["tf"] * F.get(F.col(f"_g{i}"), at)).alias(f"z{i}") for i in range(n_classes)])

    zero = F.struct(*[F.lit(0.0).alias(f"z{i}") for i in range(n_classes)])
    none = F.array().cast("array<struct<bucket:bigint,tf:bigint>>")
    return F.aggregate(F.coalesce(F.col(terms_col), none), zero, add,
                       lambda acc: F.array(*[acc[f"z{i}"] + F.col("_base")[i] for i in range(n_classes)]))


def class_scores(features: DataFrame, coef: DataFrame, classes: DataFrame, labels: list[float], num_features: int,
                 ids: list[str] = ("doc_id",), keys: list[str] = (), n_models: int = 1, coef_col: str = "coef",
                 base_col: str = "base", slope_col: str | None = None, extra_class_cols: list[str] = (),
                 wide: DataFrame | None = None) -> DataFrame:
    """Return ``(keys..., ids..., z array<double>, extra...)``; ``z`` is aligned
    with ``labels`` and null where a class is absent from a model.

    features ``(keys..., ids..., bucket, x)``, with a row of null bucket for a
    document without any feature; coef ``(keys..., label, bucket, coef_col)``;
    classes ``(keys..., label, base_col, slope_col?, extra...)``: z[c] = base +
    sum_j x_j * (slope + coef_j); ``wide`` is ``pivot_coef(coef)`` when the
    caller already has it.
    """
    ids, keys = list(ids), list(keys)
    ids_only = [c for c in ids if c not in keys]
    n = len(labels)
    if wide is None:
        wide = pivot_coef(coef, labels, keys, coef_col)
    rows = bounded_join(features.select(*keys, *ids_only, "bucket", "x"), wide, keys + ["bucket"], "left",
                        n_models * num_features, 24 + 8 * n, salt_col=ids_only[0])
    agg = rows.groupBy(*keys, *ids_only).agg(
        F.coalesce(F.sum("x"), F.lit(0.0)).alias("_total"),
        *[F.coalesce(F.sum(F.col("x") * F.coalesce(F.col("_w")[i], F.lit(0.0))), F.lit(0.0)).alias(f"_d{i}")
          for i in range(n)])
    return _with_bases(agg, classes, labels, ids_only, keys, base_col, slope_col, extra_class_cols)


def vector_scores(vectors: DataFrame, coef: DataFrame, classes: DataFrame, labels: list[float], num_features: int,
                  ids: list[str] = ("doc_id",), coef_col: str = "coef", base_col: str = "base",
                  slope_col: str | None = None, extra_class_cols: list[str] = ()) -> DataFrame:
    """``class_scores`` of vectors held as arrays, ``(ids..., j, x)``, null ones too: while
    the coefficients fit the broadcast limit the sums run inside the row, and
    only those sums meet the other rows of the same ids."""
    ids, n = list(ids), len(labels)
    if not fits_a_row(vectors, n, num_features):
        long = vectors.select(*ids, F.explode_outer(F.arrays_zip("j", "x")).alias("_e")).select(*ids, F.col("_e.j").alias("bucket"), "_e.x")
        return class_scores(long, coef, classes, labels, num_features, ids=ids, coef_col=coef_col, base_col=base_col,
                            slope_col=slope_col, extra_class_cols=extra_class_cols)
    wide = pivot_coef(coef, labels, [], coef_col).select(
        "bucket", F.array(*[F.coalesce(F.col("_w")[i], F.lit(0.0)) for i in range(n)]).alias("_g"),
        F.array(*[F.lit(0.0)] * n).alias("_d"))
    rows = attach(vectors.select(*ids, "j", "x"), dense_gains(wide, n, num_features), [], [f"_g{i}" for i in range(n)])
    zero = F.struct(F.lit(0.0).alias("t"), *[F.lit(0.0).alias(f"d{i}") for i in range(n)])

    def add(acc, e):
        at = e["j"].cast("int")
        return F.struct((acc["t"] + e["x"]).alias("t"), *[
            (acc[f"d{i}"] + e["x"] * F.coalesce(F.get(F.col(f"_g{i}"), at), F.lit(0.0))).alias(f"d{i}") for i in range(n)])

    none = F.array().cast("array<struct<j:bigint,x:double>>")
    per = rows.select(*ids, F.aggregate(F.coalesce(F.arrays_zip("j", "x"), none), zero, add).alias("_s"))
    agg = per.groupBy(*ids).agg(F.sum("_s.t").alias("_total"), *[F.sum(f"_s.d{i}").alias(f"_d{i}") for i in range(n)])
    return _with_bases(agg, classes, labels, ids, [], base_col, slope_col, extra_class_cols)


def _with_bases(agg: DataFrame, classes: DataFrame, labels: list[float], ids: list[str], keys: list[str], base_col: str,
                slope_col: str | None, extra_class_cols: list[str]) -> DataFrame:
    """z of each class from the sums ``_total`` and ``_d0``, ``_d1``..."""
    params = class_params(classes, labels, keys, [base_col, *([slope_col] if slope_col else []), *extra_class_cols])
    scored = attach(agg, params, keys, [c for c in params.columns if c not in keys])
    z = []
    for i in range(len(labels)):
        term = F.col(f"_{base_col}")[i] + F.col(f"_d{i}")
        if slope_col:
            term = term + F.col(f"_{slope_col}")[i] * F.col("_total")
        z.append(term)
    return scored.select(*keys, *ids, F.array(*z).alias("z"),
                         *[F.col(f"_{c}").alias(c) for c in extra_class_cols])


def class_params(classes: DataFrame, labels: list[float], keys: list[str], cols: list[str]) -> DataFrame:
    """``(keys..., _col array...)``: one row per model, aligned with ``labels``."""
    return classes.groupBy(*keys).agg(*[
        F.array(*[F.max(F.when(F.col("label") == F.lit(l), F.col(c))) for l in labels]).alias(f"_{c}") for c in cols])


def log_odds(z: Column, pos: Column) -> Column:
    """Log-odds of the class at ``pos`` (1-based) of a softmax over ``z``;
    infinite if it is the only class."""
    rest = F.filter(z, lambda v, i: (i != pos - 1) & v.isNotNull())
    top = F.array_max(rest)
    mass = F.aggregate(rest, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return F.when(top.isNull(), F.lit(float("inf"))).otherwise(F.element_at(z, pos) - top - F.log(mass))


def softmax_best(scored: DataFrame, labels: list[float], ids: list[str], keys: list[str] = (),
                 categories_col: str | None = None) -> DataFrame:
    """M3 rule: arg-max of ``z`` (ties to the lower label), confidence = the
    softmax probability of that class, computed with max subtraction;
    ``margin`` is its log-odds."""
    zmax = F.array_max("z")
    pos = F.array_position(F.col("z"), zmax).cast("int")
    norm = F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.coalesce(F.exp(v - zmax), F.lit(0.0)))
    out = scored.select("*", F.element_at(label_array(labels), pos).alias("label"),
                        (F.lit(1.0) / norm).alias("confidence"), log_odds(F.col("z"), pos).alias("margin"),
                        pos.alias("_pos"))
    return _with_category(out, categories_col)


def sigmoid_best(scored: DataFrame, labels: list[float], categories_col: str | None = None) -> DataFrame:
    """M4 rule: the class of the highest ``z`` (so of the highest ``sigmoid(z)``,
    also where that is 1.0 to the last digit), ties to the lower label;
    confidence is its un-normalised probability, ``margin`` the ``z``."""
    zmax = F.array_max("z")
    pos = F.array_position(F.col("z"), zmax).cast("int")
    out = scored.select("*", F.element_at(label_array(labels), pos).alias("label"),
                        sigmoid(zmax).alias("confidence"), zmax.alias("margin"), pos.alias("_pos"))
    return _with_category(out, categories_col)


def _with_category(out: DataFrame, categories_col: str | None) -> DataFrame:
    if categories_col:
        out = out.withColumn("category", F.coalesce(F.element_at(F.col(categories_col), F.col("_pos")),
                                                    F.lit("")))
    return out.drop("_pos")


def softmax_probs(scored: DataFrame, labels: list[float], ids: list[str], keys: list[str] = ()) -> DataFrame:
    """M2 output in long form: ``(keys..., ids..., label, score)`` for every class present."""
    zmax = F.array_max("z")
    norm = F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.coalesce(F.exp(v - zmax), F.lit(0.0)))
    probs = F.transform("z", lambda v: F.exp(v - zmax) / norm)
    return (scored.select(*keys, *[c for c in ids if c not in keys],
                          F.arrays_zip(label_array(labels).alias("label"), probs.alias("score")).alias("_lz"))
            .select("*", F.inline_outer("_lz")).drop("_lz").where(F.col("score").isNotNull()))
