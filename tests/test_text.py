"""Tokens, n-grams, cleaning and line parsing on the hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from textlens.functions.text import clean_text, ngrams, run_lengths, tokens
from textlens.sources.lines import parse_labelled_lines

CASES = [
    # text, tokens, n=2 grams
    ("a b c", ["a", "b", "c"], ["ab", "bc"]),
    ("a", ["a"], ["a"]),
    ("", [""], [""]),
    (" a", ["", "a"], ["a"]),
    ("a b  c ", ["a", "b", "", "c"], ["ab", "b", "c"]),
    ("   ", [], []),
    ("a\nb c", ["a\nb", "c"], ["a\nbc"]),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "id int, text string")
    df = df.withColumn("w", tokens(F.col("text")))
    df = df.withColumn("g1", ngrams(F.col("w"), 1)).withColumn("g2", ngrams(F.col("w"), 2))
    df = df.withColumn("g3", ngrams(F.col("w"), 3))
    return {r["id"]: r for r in df.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_tokens_and_grams(rows, i):
    text, toks, grams2 = CASES[i]
    r = rows[i]
    assert list(r["w"]) == toks
    assert list(r["g1"]) == toks
    assert list(r["g2"]) == grams2


def test_trigram_short_text(rows):
    assert list(rows[0]["g3"]) == ["abc"]
    assert list(rows[4]["g3"]) == ["ab", "bc"]


def test_run_lengths(spark):
    df = spark.createDataFrame([([1, 1, 2, 5, 5, 5],), ([],), ([7],)], "b array<bigint>")
    out = [[(t["bucket"], t["tf"]) for t in r[0]] for r in df.select(run_lengths(F.col("b"))).collect()]
    assert out == [[(1, 2), (2, 1), (5, 3)], [], [(7, 1)]]


def test_clean_text(spark):
    df = spark.createDataFrame([("a|b:c",), ("x\ny",)], "t string")
    assert [r[0] for r in df.select(clean_text(F.col("t"))).collect()] == ["a b c", "x y"]


def test_first_comma_split_and_binarise(spark):
    df = spark.createDataFrame([("1,hello, world\r\n",), ("0,x",), ("2,y",), ("x,z",), ("nocomma",)], "value string")
    out = parse_labelled_lines(df).collect()
    assert (out[0]["label_str"], out[0]["text"]) == ("1", "hello, world")
    assert [r["label_str"] for r in out] == ["1", "0", "2", "x", "nocomma"]
    assert out[4]["text"] == ""
    lab = parse_labelled_lines(df).select(F.when(F.col("label_str") == "1", 1.0).otherwise(0.0)).collect()
    assert [r[0] for r in lab] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_observations_from_events(spark):
    from textlens.sources.events import observations_from_events, stop_words
    rows = [("$set", "user", "0", '{"text": "a b", "category": "1", "label": 1}'),
            ("$set", "user", "1", '{"text": "c", "category": "0", "label": 0}'),
            ("$set", "item", "2", '{"text": "x", "label": 1}'),
            ("stopwords", "resource", "w", '{"word": "the"}'),
            ("stopwords", "resource", "w2", '{"word": "the"}')]
    ev = spark.createDataFrame(rows, "event string, entity_type string, entity_id string, properties string")
    obs = {r["doc_id"]: (r["label"], r["text"], r["category"]) for r in observations_from_events(ev).collect()}
    assert obs == {"0": (1.0, "a b", "1"), "1": (0.0, "c", "0")}
    words = stop_words(ev, "stopwords", "word", entity_col="event", props_col="properties").collect()
    assert [r["word"] for r in words] == ["the"]
