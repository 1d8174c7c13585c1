"""Registered queries against their DuckDB twins on the smallest tables, the
entry point, and pyspark.ml cross-checks."""

import duckdb
import pytest

from tests.conftest import SF_SMALL
from textlens.plans.catalog import oracle_sql, queries
from textlens.sources.tables import TABLES

FAST = ["observations", "tokens", "ngrams", "hashed_tf", "idf", "tfidf", "nb_pi", "nb_theta", "nb_predict",
        "row_index", "kfold", "kfold_accuracy", "nb_grid", "linear_predict", "serve_best", "cooccurrence",
        "sppmi", "doc_sppmi_append", "event_props", "labelled_lines", "vw_lines", "coo_triples", "serve_best_shared",
        "sppmi_score_unseen", "text_vector_lookup", "readable_weights"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql_twin(spark, duck, name):
    df = queries()[name](spark, SF_SMALL)
    cur = duck.execute(oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _norm(df.collect(), df.columns) == _norm(cur.fetchall(), ocols)


def test_every_sql_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["doc_id", "category", "confidence", "label"]
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nb_matches_pyspark_ml(spark):
    """Relational Naive Bayes equals pyspark.ml NaiveBayes on the same vectors."""
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.linalg import SparseVector, VectorUDT
    from textlens.operators.naive_bayes import fit_naive_bayes
    from textlens.sources.tables import load_observations
    obs = load_observations(spark, SF_SMALL)
    model = fit_naive_bayes(obs, 1, 50, 0.25)
    x = model.features(obs.select("doc_id", "text"))
    vecs = {}
    for r in x.collect():
        vecs.setdefault(r["doc_id"], {})[r["bucket"]] = r["x"]
    rows = [(r["doc_id"], r["label"], SparseVector(50, sorted(vecs.get(r["doc_id"], {}).items())))
            for r in obs.select("doc_id", "label").collect()]
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType
    schema = StructType([StructField("doc_id", LongType()), StructField("label", DoubleType()),
                         StructField("features", VectorUDT())])
    ml = NaiveBayes(smoothing=0.25, modelType="multinomial").fit(spark.createDataFrame(rows, schema))
    pi = {r["label"]: r["pi"] for r in model.classes.collect()}
    assert [pi[0.0], pi[1.0]] == pytest.approx(list(ml.pi.toArray()), abs=1e-9)
    mine = model.predict(obs.select("doc_id", "text")).select("doc_id", "label").collect()
    theirs = ml.transform(spark.createDataFrame(rows, schema)).select("doc_id", "prediction").collect()
    assert {r[0]: r[1] for r in mine} == {r[0]: r[1] for r in theirs}


def test_l1_sparser_than_l2(spark):
    from textlens.operators.mlfit import fit_ovr_logistic, nonzero_weights
    from textlens.sources.tables import load_observations
    obs = load_observations(spark, SF_SMALL)
    l1 = fit_ovr_logistic(obs, 1, 200, 0.05, 100, elastic_net=1.0)
    l2 = fit_ovr_logistic(obs, 1, 200, 0.05, 10, elastic_net=0.0)
    assert max(nonzero_weights(l1)) < min(nonzero_weights(l2))


def test_lr_models_mirror_for_two_labels(spark):
    """The shortcut (fit one model, 1 - p for the other label) rests on this:
    fitting both one-vs-rest models gives opposite coefficients."""
    from pyspark.ml.classification import LogisticRegression
    from textlens.operators.features import ovr_columns
    from textlens.operators.mlfit import featurizer, gram_column
    from textlens.sources.tables import load_observations
    obs = load_observations(spark, SF_SMALL)
    grams = gram_column(obs, 1)
    data = ovr_columns(featurizer(100).fit(grams).transform(grams), [0.0, 1.0])
    a, b = (LogisticRegression(maxIter=10, regParam=0.5, labelCol=c).fit(data) for c in ("0", "1"))
    assert max(abs(a.coefficients.toArray() + b.coefficients.toArray())) < 1e-6
    assert abs(a.intercept + b.intercept) < 1e-6


def test_empty_training_raises(spark):
    from textlens.operators.naive_bayes import fit_naive_bayes
    empty = spark.createDataFrame([], "doc_id long, label double, text string, category string")
    with pytest.raises(ValueError):
        fit_naive_bayes(empty)


def test_stream_equals_batch(spark):
    df = queries()["score_stream"](spark, SF_SMALL)
    batch = queries()["nb_predict"](spark, SF_SMALL)
    assert df.exceptAll(batch).count() == 0 and batch.exceptAll(df).count() == 0


def test_representation_switch_rejects_unknown(spark):
    from textlens.operators.represent import fit_classifier
    from textlens.sources.tables import load_observations
    with pytest.raises(ValueError):
        fit_classifier(load_observations(spark, SF_SMALL), "word2vec")


def test_sppmi_nb_matches_sql_twin(spark, duck):
    test_query_matches_sql_twin(spark, duck, "sppmi_nb_predict")


def test_one_pass_serving_equals_joined_serving(spark):
    from textlens.operators.linear import nb_log_odds
    from textlens.operators.naive_bayes import fit_naive_bayes_many
    from textlens.operators.serve import serve_best, serve_best_shared
    from textlens.sources.tables import load_observations, read_table
    obs = load_observations(spark, SF_SMALL)
    a, b, c = fit_naive_bayes_many(obs, 2, 300, [0.25, 1.0, 0.01])
    models = [a, b, nb_log_odds(c)]
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    one = {r["doc_id"]: r for r in serve_best_shared(models, docs).collect()}
    joined = serve_best([m.predict(docs) for m in models]).collect()
    assert len(joined) == len(one) == docs.count()
    for r in joined:
        assert (one[r["doc_id"]]["category"], one[r["doc_id"]]["algo"]) == (r["category"], r["algo"])
        assert one[r["doc_id"]]["confidence"] == pytest.approx(r["confidence"], abs=1e-12)
    assert len({r["algo"] for r in joined}) > 1


@pytest.mark.parametrize("name", ["nb_predict", "kfold_accuracy", "doc_sppmi_sum"])
def test_salted_joins_match_broadcast_joins(spark, name):
    """With broadcasting disabled the bucket joins take the salted shuffle
    path; results must not change."""
    normal = queries()[name](spark, SF_SMALL).collect()
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = queries()[name](spark, SF_SMALL)
        plan = df._jdf.queryExecution().executedPlan().toString()
        salted = df.collect()
    finally:
        spark.conf.set(key, old)
    assert "_salt" in plan
    assert len(normal) == len(salted)
    for a, b in zip(sorted(map(tuple, normal)), sorted(map(tuple, salted)), strict=True):
        assert a == pytest.approx(b, abs=2e-6) if not any(isinstance(x, str) for x in a) else (
            [x for x in a if not isinstance(x, float)] == [x for x in b if not isinstance(x, float)])
