"""Hashed terms of Arrow batches against the same terms as expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textlens.functions import hashing
from textlens.functions.text import clean_text, ngrams, run_lengths, sorted_buckets, tokens
from textlens.operators.features import with_term_spaces, with_terms
from textlens.operators.online import length_terms

TEXTS = ["a b a", "", None, " ", "   ", " lead", "trail  ", "in  ner", "one", "é ü é ü é", "x\ny z", "a|b:c\r\nd a|b", "a b c d " * 40,
         " ".join("x" * n for n in range(50, 70)), "é" * 27 + " " + "é" * 28]


def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def plain(d, n, v):
    d = d.withColumn("_w", tokens(F.col("text"))).withColumn("_g", ngrams(F.col("_w"), n))
    return d.withColumn("_b", sorted_buckets(F.col("_g"), v)).select("doc_id", run_lengths(F.col("_b")).alias("terms"))


def rows(df):
    return sorted((r[0], None if r[1] is None else [tuple(t) for t in r[1]]) for r in df.collect())


@pytest.mark.parametrize(("n", "v"), [(1, 7), (2, 50), (3, 5000), (2, 1 << 22)])
@pytest.mark.parametrize("size", [1, 30, 4 << 20])
def test_terms_equal_expressions(n, v, size):
    import pyarrow as pa
    from hashlib import md5
    old, hashing.SLICE_BYTES = hashing.SLICE_BYTES, size
    try:
        got = hashing.term_lists(pa.array(TEXTS), [((n,), v)])[0].to_pylist()
    finally:
        hashing.SLICE_BYTES = old
    for text, terms in zip(TEXTS, got, strict=True):
        if text is None:
            assert terms is None
            continue
        words = [""] if text == "" else text.rstrip(" ").split(" ") if text.rstrip(" ") else []
        grams = ["".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
        want = {}
        for g in grams:
            b = int(md5(g.encode()).hexdigest()[:8], 16) % v
            want[b] = want.get(b, 0) + 1
        assert [(t["bucket"], t["tf"]) for t in terms] == sorted(want.items())


def test_terms_in_spark(spark):
    d = docs(spark)
    spaces = [(1, 500), (2, 5000)]
    both = with_term_spaces(d, spaces)
    for i, (n, v) in enumerate(spaces):
        assert rows(with_terms(d, n, v).select("doc_id", "terms")) == rows(plain(d, n, v)) == rows(both.select("doc_id", f"_t{i}"))


def test_terms_are_not_interpreted(spark):
    """The terms come from one Arrow pass, not from lambdas evaluated gram by gram."""
    plan = with_terms(docs(spark), 2, 5000).select("doc_id", "terms")._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" in plan and "lambda" not in plan


def test_length_terms_equal_expressions(spark):
    d = docs(spark)
    c = d.withColumn("_w", tokens(clean_text(F.col("text"))))
    none = F.array().cast("array<string>")
    c = c.withColumn("_g1", ngrams(F.col("_w"), 1)).withColumn("_g2", ngrams(F.col("_w"), 2))
    c = c.withColumn("_b", sorted_buckets(F.coalesce(F.concat("_g1", "_g2"), none), 1 << 22))
    got = length_terms(d, 2, 1 << 22)
    assert rows(got.select("doc_id", "terms")) == rows(c.select("doc_id", run_lengths(F.col("_b"))))
    for r in got.collect():
        assert r["length"] == pytest.approx(sum(t["tf"] ** 2 for t in r["terms"]) ** 0.5)
