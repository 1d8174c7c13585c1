"""Quality rules with adaptive thresholds (DataFrame and SQL functions only).

Every document gets four rates: mean word length, symbols per word, share of
repeated lines, share of words in repeated 3-word windows. One aggregate
builds mergeable quantile sketches of each rate per language and source, and
per language; from their quartiles follow the fences

    below = q25 - width * spread,   above = q75 + width * spread,
    spread = max(q75 - q25, the rate's resolution)

A document is kept if it passes the base rules and all its rates lie within
the tighter, on each side, of the fences of its language and source and those
of its language. A source under ``min_group`` documents leaves it to the
language, a language under ``min_group`` to the fences of all documents. A source
of junk so can't widen its fences beyond those of its language; they give way
where more than a quarter of the source and of the language is junk. The
fences are joined to the documents; no cutoff is fixed.

All text work happens inside the row; arrays are computed once by passing
them through a generator, which the optimizer does not merge with the
expressions above it. Shuffled are only the sketches and the narrow join.

Defined cases: null, empty and blank texts have no words (all counts 0) and
fail the base rules; null languages and sources are groups of their own;
repeated rows are judged (and counted in the sketches) each; an empty table
gives no rows. Further columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.common import SPACE, read, save

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
WIDTH, MIN_GROUP, ACCURACY = 6.0, 50, 10000
#: Rates and their resolutions: the least spread that a fence is built on.
RATES = {"word_length": 0.1, "symbol_rate": 0.02, "dup_line_rate": 0.06, "repeat_rate": 0.05}
_BLANKS = " \t\n\x0b\x0c\r"


def _once(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with ``cols`` added, each computed once per row."""
    made = F.inline_outer(F.array(F.struct(*[c.alias(k) for k, c in cols.items()])))
    return df.select("*", made)


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             source: str = "source") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words for each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"),
                       F.coalesce(F.col(text), F.lit("")).alias("_text"))
    trimmed = F.btrim("_text", F.lit(_BLANKS))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    rows = _once(rows, _words=F.when(trimmed != "", F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>")),
                 _lines=lines)
    n = F.size("_words").cast("long")
    triples = F.arrays_zip(*[F.slice("_words", i, F.greatest(F.size("_words") - 2, F.lit(0))).alias(f"w{i}")
                             for i in (1, 2, 3)])
    rows = _once(rows.select(
        "doc_id", "lang", "source", n.alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(triples, lambda z: F.xxhash64(z["w1"], z["w2"], z["w3"])).alias("_made")),
        _grams=F.col("_made")).drop("_made")
    numbered = F.zip_with("_grams", F.sequence(F.lit(1), F.greatest(F.size("_grams"), F.lit(1))),
                          lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    rows = _once(rows, _sorted=F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"),
                                      F.sort_array(numbered)))
    m = F.size("_sorted") - 1
    pairs = F.zip_with(F.slice("_sorted", 1, m), F.slice("_sorted", 2, m),
                       lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    covered = F.aggregate(starts, F.struct(F.lit(-9).alias("at"), F.lit(0).alias("n")),
                          lambda acc, x: F.struct(x.alias("at"), (acc["n"] + F.least(F.lit(3), x - acc["at"])).alias("n")),
                          lambda acc: acc["n"])
    return rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                       F.when(F.col("_sorted").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def _rates(m: DataFrame) -> DataFrame:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return m.select("*", (F.col("word_chars") / words).alias("word_length"),
                    (F.col("n_symbols") / words).alias("symbol_rate"),
                    (F.col("n_dup_lines") / lines).alias("dup_line_rate"),
                    (F.col("n_repeat_words") / words).alias("repeat_rate"))


def fences(rated: DataFrame, by: list[str], width: float = WIDTH, min_group: int = MIN_GROUP) -> DataFrame:
    """Per group of ``by``: ``n`` and ``<rate>_below`` / ``<rate>_above``,
    from quantile sketches of the documents that have words."""
    quartiles = rated.where("n_words > 0").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.percentile_approx(r, [0.25, 0.75], ACCURACY).alias(r) for r in RATES]).where(F.col("n") >= min_group)
    out = [*by, "n"]
    for r, least in RATES.items():
        low, high = F.col(r)[0], F.col(r)[1]
        spread = F.greatest(high - low, F.lit(least)) * width
        out += [(low - spread).alias(f"{r}_below"), (high + spread).alias(f"{r}_above")]
    return quartiles.select(*out)


def judge(measured: DataFrame, width: float = WIDTH, min_group: int = MIN_GROUP) -> DataFrame:
    """``measured`` (see ``measures``) with ``base_failed`` and ``kept``."""
    rated = _rates(measured)
    near = fences(rated, ["lang", "source"], width, min_group)
    wide = fences(rated, ["lang"], width, min_group)
    every = fences(rated, [], width, min_group)
    limits = [f"{r}_{s}" for r in RATES for s in ("below", "above")]
    near = near.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *[F.col(c).alias(f"_n_{c}") for c in limits])
    wide = wide.select(F.col("lang").alias("_wl"), *[F.col(c).alias(f"_w_{c}") for c in limits])
    got = (rated.join(near, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
           .join(wide, F.col("lang").eqNullSafe(F.col("_wl")), "left"))
    all_ = every.select(F.struct(*limits).alias("_a")).scalar()  # one row, or none
    inside = F.lit(True)
    for r in RATES:
        low = F.greatest(f"_n_{r}_below", F.coalesce(f"_w_{r}_below", all_[f"{r}_below"]), F.lit(float("-inf")))
        high = F.least(f"_n_{r}_above", F.coalesce(f"_w_{r}_above", all_[f"{r}_above"]), F.lit(float("inf")))
        inside = inside & F.col(r).between(low, high)
    failed = ((F.col("n_words") < MIN_WORDS)
              | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT))
    return got.select(*measured.columns, failed.alias("base_failed"), (~failed & inside).alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(save(measures(docs), "measures")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_fences(name: str, by: str) -> str:
    cols = ", ".join(
        f"{q}_{r} - {sign} AS {r}_{side}" for r, least in RATES.items() for q, side, sign in
        (("lo", "below", f"greatest(hi_{r} - lo_{r}, {least}::DOUBLE) * {WIDTH}"),
         ("hi", "above", f"(-(greatest(hi_{r} - lo_{r}, {least}::DOUBLE) * {WIDTH}))")))
    quart = ", ".join(f"quantile_disc({r}, {p}) AS {q}_{r}" for r in RATES for q, p in (("lo", 0.25), ("hi", 0.75)))
    return (f"{name} AS (SELECT {by}, {cols} FROM (SELECT {by}, count(*) AS n, {quart} FROM rated WHERE n_words > 0 "
            f"GROUP BY {by} HAVING count(*) >= {MIN_GROUP}))")


_INSIDE = " AND ".join(
    f"{r} >= greatest(coalesce(g.{r}_below, '-inf'::DOUBLE), coalesce(w.{r}_below, a.{r}_below, '-inf'::DOUBLE)) AND "
    f"{r} <= least(coalesce(g.{r}_above, 'inf'::DOUBLE), coalesce(w.{r}_above, a.{r}_above, 'inf'::DOUBLE))" for r in RATES)
OP10_SQL = rf"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY doc_id
), measured AS (
  SELECT b.doc_id, lang, source, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id
), rated AS (
  SELECT *, 1 AS one, word_chars / greatest(n_words, 1) AS word_length, n_symbols / greatest(n_words, 1) AS symbol_rate,
         n_dup_lines / greatest(n_lines, 1) AS dup_line_rate, n_repeat_words / greatest(n_words, 1) AS repeat_rate,
         n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed
  FROM measured
), {_sql_fences("near", "lang, source")}, {_sql_fences("wide", "lang")}, {_sql_fences("every", "one")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_INSIDE} AS kept
FROM rated r LEFT JOIN near g ON r.lang IS NOT DISTINCT FROM g.lang AND r.source IS NOT DISTINCT FROM g.source
             LEFT JOIN wide w ON r.lang IS NOT DISTINCT FROM w.lang LEFT JOIN every a ON a.one = r.one
"""
