"""Serving (V1) and batch scoring (V2).

Best-of serving keeps, per query, the prediction with the highest
confidence among the algorithms; ties go to the algorithm listed first.
Confidences are compared by their log-odds (``margin``): two probabilities
that both round to 1.0 still differ there, and the order is the same.

``serve_models`` answers every row it is given, also those whose id is null or
repeated: each model adds its prediction to the row, nothing is joined on
ids. A text is tokenised once for all Naive Bayes and linear models, with one
term array per hash space; logistic models add theirs by row-wise transforms.
A model that can't score inside a row (SPPMI look-ups, models beyond the
broadcast limit) predicts each distinct text once, and the rows take the
prediction of their text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlens.functions.mathfn import sigmoid
from textlens.operators.features import with_term_spaces
from textlens.operators.linear import LinearModel
from textlens.operators.mlfit import OvrLogistic, add_margins, gram_column
from textlens.operators.naive_bayes import NBModel
from textlens.operators.scoring import add_scores, class_params, log_odds
from textlens.operators.util import attach

SALTS = 32


def _first_best(picks: list[Column]) -> Column:
    """The struct with the highest margin; the first of equal ones."""
    best = picks[0]
    for p in picks[1:]:
        best = F.when(p["margin"] > best["margin"], p).otherwise(best)
    return best


def serve_best(predictions: list[DataFrame], ids: list[str] = ("doc_id",)) -> DataFrame:
    """``predictions[i] (ids..., category, confidence[, margin])`` of the same
    queries -> ``(ids..., category, confidence, algo)`` with ``algo`` the index
    of the chosen algorithm, for predictions made elsewhere: joined on ``ids``,
    which have to name the rows (``serve_models`` needs no ids); without
    ``margin`` the raw confidences are compared."""
    ids = list(ids)
    margins = all("margin" in p.columns for p in predictions)
    tagged = [p.select(*ids, F.struct("category", "confidence", F.lit(i).alias("algo"),
                                      F.col("margin" if margins else "confidence").alias("margin")).alias(f"_a{i}"))
              for i, p in enumerate(predictions)]

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnsRenamed({c: f"_{c}_" for c in ids})
        on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in ids])
        return a.join(b, on).drop(*[f"_{c}_" for c in ids])

    joined = reduce(meet, tagged)
    best = _first_best([F.col(f"_a{i}") for i in range(len(tagged))])
    return joined.select(*ids, best.alias("b")).select(*ids, "b.category", "b.confidence", "b.algo")


def score_queries(model, queries: DataFrame, ids: list[str], text_col: str = "text") -> DataFrame:
    """V2: any fitted model (``predict``) applied to a whole query table."""
    return model.predict(queries.select(*ids, text_col), ids=ids, text_col=text_col)


def _prediction(category: Column, confidence: Column, margin: Column, algo: int) -> Column:
    return F.struct(F.coalesce(category, F.lit("")).alias("category"), confidence.alias("confidence"),
                    F.lit(algo).alias("algo"), margin.alias("margin")).alias(f"_a{algo}")


def _best_class(z: Column, categories: Column, softmax: bool, algo: int) -> Column:
    """A model's prediction from its margins; ties go to the lower label."""
    pos = F.array_position(z, F.array_max(z)).cast("int")
    margin = log_odds(z, pos) if softmax else F.array_max(z)
    return _prediction(F.element_at(categories, pos), sigmoid(margin), margin, algo)


def _by_text(rows: DataFrame, model, text_col: str, algo: int) -> DataFrame:
    """``rows`` with the prediction of each row's text, made once per distinct
    text; a text that many rows have is spread over ``SALTS`` tasks."""
    kept = rows.columns
    h = F.coalesce(F.sha2(F.col(text_col), 256), F.lit("null"))
    rows = rows.withColumn("_sha", h).withColumn("_spread", F.pmod(F.xxhash64(*kept), F.lit(SALTS)).cast("int"))
    texts = rows.groupBy("_sha").agg(F.any_value(text_col).alias("text"))
    found = model.predict(texts, ids=["_sha"]).select(
        "_sha", _prediction(F.col("category"), F.col("confidence"), F.col("margin"), algo),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_spread"))
    return rows.join(found, ["_sha", "_spread"], "left").select(*kept, f"_a{algo}")


def serve_models(models: list, docs: DataFrame, ids: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """V1: ``(ids..., category, confidence, algo)``, one row for each row of
    ``docs``, by fitted models of any kind and any featurizers."""
    ids = list(ids)
    inside = [isinstance(m, (NBModel, LinearModel)) and m.in_rows() for m in models]
    spaces = list(dict.fromkeys((m.n_gram, m.num_features) for m, row in zip(models, inside, strict=True) if row))
    rows = docs.select(*ids, F.col(text_col).alias("_query"))
    for algo, (m, row) in enumerate(zip(models, inside, strict=True)):
        if isinstance(m, OvrLogistic):
            kept = rows.columns
            feats = m.features_model.transform(gram_column(rows, m.n_gram, "_query", m.upto, m.clean))
            z = add_margins(feats, m.models, kept, m.mirrored)
            z = attach(z, class_params(m.categories, m.labels, [], ["category"]), [], ["_category"])
            rows = z.select(*kept, _best_class(F.col("z"), F.col("_category"), False, algo))
        elif not row:
            rows = _by_text(rows, m, "_query", algo)
    if spaces:
        rows = with_term_spaces(rows, spaces, "_query")
    for algo, (m, row) in enumerate(zip(models, inside, strict=True)):
        if row:
            kept = rows.columns
            at = spaces.index((m.n_gram, m.num_features))
            z = add_scores(rows, f"_t{at}", m.gains, m.bases(), len(m.labels), "_z", ["category"])
            rows = z.select(*kept, _best_class(F.col("_z"), F.col("category"), isinstance(m, NBModel), algo))
    best = _first_best([F.col(f"_a{i}") for i in range(len(models))])
    return rows.select(*ids, best.alias("_b")).select(*ids, "_b.category", "_b.confidence", "_b.algo")


def serve_best_shared(models: list, docs: DataFrame, ids: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``serve_models`` of models that share one featurizer: one hash per text."""
    first = models[0]
    if any((m.n_gram, m.num_features) != (first.n_gram, first.num_features) for m in models):
        raise ValueError("serve_best_shared needs models with one featurizer; use serve_models")
    return serve_models(models, docs, ids, text_col)
