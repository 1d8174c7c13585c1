"""Feature operators: hashed term frequency (T3), presence (T4), IDF (F1),
TF-IDF (F2), category map (F12), one-vs-rest label columns (F13) and the
labelled-point summary (F11).

Long form ``(ids..., bucket, value)`` is the working representation: it is
sparse, joins on ``bucket`` and aggregates with plain ``groupBy``. Term
counting happens next to the scan (``functions.hashing``), so a document's text
is never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.functions.hashing import hashed_terms
from textlens.functions.text import ngrams, tokens
from textlens.operators.util import attach, bounded_join

MOST_LITERAL_WORDS = 10_000  # stop words that travel inside the plan


def with_terms(docs: DataFrame, n_gram: int, num_features: int, text_col: str = "text",
               out_col: str = "terms", stop_words: DataFrame | None = None) -> DataFrame:
    """Add ``terms: array<struct<bucket, tf>>`` (sorted by bucket) to each row."""
    if n_gram < 1:
        raise ValueError("n must be >= 1")
    source = text_col
    if stop_words is not None:
        docs, source = without_words(docs.withColumn("_tokens", tokens(F.col(text_col))), stop_words, text_col), "_tokens"
    return (docs.withColumn("_hashed", hashed_terms(F.col(source), [((n_gram,), num_features)]))
            .withColumn(out_col, F.col("_hashed")["t0"]).drop("_hashed", "_tokens"))


def with_term_spaces(docs: DataFrame, spaces: list[tuple[int, int]], text_col: str = "text") -> DataFrame:
    """Add ``_t0``, ``_t1``...: the term array of each (n_gram, num_features) of
    ``spaces``. A text is tokenised once, each n-gram order joined once."""
    d = docs.withColumn("_hashed", hashed_terms(F.col(text_col), [((n,), v) for n, v in spaces]))
    return d.withColumns({f"_t{i}": F.col("_hashed")[f"t{i}"] for i in range(len(spaces))}).drop("_hashed")


def with_grams(docs: DataFrame, n_gram: int, text_col: str = "text", out_col: str = "grams",
               stop_words: DataFrame | None = None) -> DataFrame:
    """Add the n-gram array; ``stop_words (word)`` (S5) are taken out of the tokens
    first (each occurrence, other repeats stay). The token array is its own
    column first: the window lambda reads it once per gram, so it must not be
    recomputed."""
    d = docs.withColumn("_tokens", tokens(F.col(text_col)))
    if stop_words is not None:
        d = without_words(d, stop_words, text_col)
    return d.withColumn(out_col, ngrams(F.col("_tokens"), n_gram)).drop("_tokens")


def without_words(rows: DataFrame, words: DataFrame, text_col: str, most: int = MOST_LITERAL_WORDS, salts: int = 32) -> DataFrame:
    """``rows`` with the tokens of ``words (word)`` taken out of ``_tokens``, the
    others in their order.

    Up to ``most`` words are a hashed set inside the plan. More stay
    distributed: every distinct text sends its tokens with their places to
    the words (an anti-join, salted, so a word that every text has is spread),
    and what is left comes together again by text and place."""
    words = words.select("word").where(F.col("word").isNotNull()).distinct()
    some = [r[0] for r in words.limit(most + 1).collect()]  # bounded
    if len(some) <= most:
        return rows.withColumn("_tokens", F.filter("_tokens", lambda t: ~t.isin(some))) if some else rows
    kept = rows.columns
    h = F.coalesce(F.sha2(F.col(text_col), 256), F.lit("null"))
    rows = rows.withColumn("_sha", h)
    each = rows.groupBy("_sha").agg(F.any_value("_tokens").alias("_tokens")).select("_sha", F.posexplode_outer("_tokens").alias("_at", "word"))
    each = each.where(F.col("word").isNotNull()).withColumn("_salt", F.pmod(F.xxhash64("_sha", "_at"), F.lit(salts)).cast("int"))
    stop = words.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = each.join(stop, ["word", "_salt"], "left_anti").groupBy("_sha").agg(
        F.sort_array(F.collect_list(F.struct("_at", "word"))).alias("_left"))  # at most the text's tokens
    out = rows.drop("_tokens").join(left, "_sha", "left").withColumn(
        "_tokens", F.coalesce(F.transform("_left", lambda e: e["word"]), F.array().cast("array<string>")))
    return out.select(*kept)


def hashed_tf(docs: DataFrame, n_gram: int, num_features: int, ids: list[str] = ("doc_id",),
              text_col: str = "text", carry: list[str] = (), outer: bool = False) -> DataFrame:
    """``(ids..., carry..., bucket, tf)`` for every (document, bucket) with
    tf > 0 (``outer``: and a null row for a document without any)."""
    ids = list(ids)
    t = with_terms(docs.select(*ids, *carry, text_col), n_gram, num_features, text_col)
    return explode_terms(t, ids + list(carry), outer=outer)


def explode_terms(t: DataFrame, cols: list[str], terms_col: str = "terms", outer: bool = False) -> DataFrame:
    """Long form of a ``terms`` array (``outer``: with a null row for an empty
    one). ``inline_outer`` + an explicit filter: plain ``inline`` makes the
    optimizer infer a ``size(terms) > 0`` filter and push it under the
    projections, re-evaluating the whole term expression."""
    long = t.select(*cols, F.inline_outer(terms_col))
    return long if outer else long.where(F.col("bucket").isNotNull())


def presence(tf: DataFrame, ids: list[str] = ("doc_id",)) -> DataFrame:
    """T4: binarised TF, ``(ids..., bucket)``; rows only where tf > 0."""
    return tf.where(F.col("tf") > 0).select(*ids, "bucket")


def fit_idf(tf: DataFrame, docs: DataFrame, keys: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``idf = ln((m + 1) / (df + 1))`` per bucket, m = documents (with or
    without grams), no minimum document frequency.

    Returns ``(table, counts)``: table ``(keys..., bucket, df, idf)`` and
    counts ``(keys..., m, idf_default)`` where ``idf_default = ln(m + 1)`` is the
    weight of a bucket never seen in training.
    """
    keys = list(keys)
    counts = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    counts = counts.withColumn("idf_default", F.log(F.col("m") + 1.0))
    df = tf.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("df"))
    table = attach(df, counts, keys, ["m"])
    table = table.select(*keys, "bucket", "df",
                         F.log((F.col("m") + 1.0) / (F.col("df") + 1.0)).alias("idf"))
    return table, counts


def tfidf(tf: DataFrame, idf_table: DataFrame, idf_counts: DataFrame, num_features: int,
          ids: list[str] = ("doc_id",), keys: list[str] = (), n_models: int = 1,
          carry: list[str] = ()) -> DataFrame:
    """``x = tf * idf``; a bucket absent from the IDF table gets ``ln(m + 1)``.

    The IDF side has at most ``n_models * num_features`` rows, which is the
    bound checked before broadcasting it.
    """
    ids, keys = list(ids), list(keys)
    salt = [c for c in ids if c not in keys][0]
    joined = bounded_join(tf, idf_table.select(*keys, "bucket", "idf"), keys + ["bucket"], "left",
                          n_models * num_features, 32, salt_col=salt)
    joined = attach(joined, idf_counts, keys, ["idf_default"])
    return joined.select(*keys, *[c for c in ids if c not in keys], *carry, "bucket", "tf",
                         (F.col("tf") * F.coalesce(F.col("idf"), F.col("idf_default"))).alias("x"))


def category_map(observations: DataFrame, keys: list[str] = ()) -> DataFrame:
    """one category per label (the one of the highest ``doc_id``)."""
    keys = list(keys)
    return observations.groupBy(*keys, "label").agg(
        F.max_by("category", "doc_id").alias("category"))


def ovr_columns(points: DataFrame, labels: list[float], label_col: str = "label") -> DataFrame:
    """one 0/1 double column per label, named by the integer label."""
    return reduce(lambda d, l: d.withColumn(str(int(l)), (F.col(label_col) == F.lit(l)).cast("double")),
                  labels, points)


def distinct_labels(observations: DataFrame, label_col: str = "label") -> list[float]:
    """Sorted label values (a handful of classes; the only driver-side list)."""
    return sorted(r[0] for r in observations.select(label_col).distinct().collect())
