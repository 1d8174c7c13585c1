"""Sources and helpers not covered by the registered queries."""

import os
import tempfile

from textlens.session import cluster_conf
from textlens.sources.lines import read_labelled_lines
from textlens.sources.tables import sanity_message


def test_read_labelled_text_file(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    path = os.path.join(folder, "lines.txt")
    with open(path, "w", newline="") as f:
        f.write("1,hello, world\r\n0,plain\n2,x,y,z\n")
    rows = [tuple(r) for r in read_labelled_lines(spark, path).collect()]
    assert sorted(rows) == [(0, "1", "hello, world", 1.0, "1"), (1, "0", "plain", 0.0, "0"), (2, "2", "x,y,z", 0.0, "2")]


def test_line_numbers_over_splits_and_files(spark):
    """Ids follow files and lines though a file is read in several splits; a
    classifier can be fitted on what was read."""
    from textlens.operators.naive_bayes import fit_naive_bayes
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    lines = [f"{i % 2},word{i} {'good' if i % 2 else 'bad'}" for i in range(3000)]
    for k in range(3):
        with open(os.path.join(folder, f"part{k}.txt"), "w") as f:
            f.write("\n".join(lines[k * 1000:(k + 1) * 1000]) + "\n")
    key, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "4096")
    try:
        got = read_labelled_lines(spark, folder)
        assert [(r["doc_id"], f"{r['label_str']},{r['text']}") for r in got.orderBy("doc_id").collect()] == list(enumerate(lines))
        model = fit_naive_bayes(got, 1, 200, 0.25)
        hits = model.predict(got).join(got.select("doc_id", "label_str"), "doc_id").where("category = label_str").count()
    finally:
        spark.conf.set(key, old)
    assert hits > 2700  # words share buckets


def test_sanity_message(spark):
    empty = spark.createDataFrame([], "doc_id long, label double")
    assert "no observations" in sanity_message(empty)
    three = spark.createDataFrame([(i, float(i % 2)) for i in range(3)], "doc_id long, label double")
    msg = sanity_message(three)
    assert msg.count("sample") == 3 and "3 rows, 5 were asked for" in msg
    many = spark.createDataFrame([(i, 1.0) for i in range(20)], "doc_id long, label double")
    assert sanity_message(many).count("sample") == 5


def test_stop_words_leave_before_the_windows(spark):
    from textlens.operators.features import with_grams, with_terms
    docs = spark.createDataFrame([(1, "the cat the cat sat"), (2, "a the"), (3, "dog")], "doc_id long, text string")
    words = spark.createDataFrame([("the",), ("a",)], "word string")
    got = {r["doc_id"]: r["grams"] for r in with_grams(docs, 2, stop_words=words).collect()}
    assert got == {1: ["catcat", "catsat"], 2: [], 3: ["dog"]}
    assert [len(r["terms"]) for r in with_terms(docs, 1, 1000, stop_words=words).orderBy("doc_id").collect()] == [2, 0, 1]
    none = spark.createDataFrame([], "word string")
    assert with_grams(docs, 1, stop_words=none).first()["grams"] == "the cat the cat sat".split()


def test_cluster_conf_sizes():
    big = cluster_conf(100 * 2 ** 40, 8000)
    assert big["spark.sql.shuffle.partitions"] == "100000"
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 << 20)
    small = cluster_conf(2 ** 30, 8)
    assert small["spark.sql.shuffle.partitions"] == "24"


def test_events_with_text_entity_ids(spark):
    from textlens.sources.events import observations_from_events
    ev = spark.createDataFrame([("$set", "user", "u-a", '{"text": "x", "label": "1"}'),
                                ("$set", "user", "u-b", '{"text": "y", "label": "0"}')],
                               "event string, entity_type string, entity_id string, properties string")
    rows = observations_from_events(ev).collect()
    assert len({r["doc_id"] for r in rows}) == 2 and all(r["doc_id"] is not None for r in rows)
    assert sorted((r["text"], r["label"]) for r in rows) == [("x", 1.0), ("y", 0.0)]


def test_events_keep_entities_apart(spark):
    """"01" and "1" are two documents, also in the features."""
    from textlens.operators.features import hashed_tf
    from textlens.operators.naive_bayes import fit_naive_bayes
    from textlens.sources.events import observations_from_events
    ev = spark.createDataFrame([("$set", "user", i, f'{{"text": "t{i} x", "label": "{k % 2}"}}')
                                for k, i in enumerate(["1", "01", "1.0", "-5", "abc"])],
                               "event string, entity_type string, entity_id string, properties string")
    obs = observations_from_events(ev)
    assert sorted(r["doc_id"] for r in obs.collect()) == sorted(["1", "01", "1.0", "-5", "abc"])
    per = {r["doc_id"]: r["sum(tf)"] for r in hashed_tf(obs, 1, 1000).groupBy("doc_id").sum("tf").collect()}
    assert set(per.values()) == {2} and len(per) == 5
    assert fit_naive_bayes(obs, 1, 100).predict(obs).count() == 5


def test_one_pass_serving_rejects_mixed_featurizers(spark):
    import pytest
    from tests.conftest import SF_SMALL
    from textlens.operators.naive_bayes import fit_naive_bayes
    from textlens.operators.serve import serve_best_shared
    from textlens.sources.tables import load_observations, read_table
    obs = load_observations(spark, SF_SMALL)
    a = fit_naive_bayes(obs, 1, 50, 0.25)
    b = fit_naive_bayes(obs, 2, 50, 0.25)
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    with pytest.raises(ValueError):
        serve_best_shared([a, b], docs)
