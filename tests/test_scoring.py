"""Scoring in the row and by joins, decisions on raw margins, serving of any
models, saved models and streams."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from textlens.operators.linear import LinearModel, nb_log_odds
from textlens.operators.mlfit import fit_ovr_logistic
from textlens.operators.naive_bayes import fit_naive_bayes
from textlens.operators.persist import load_model, save_model
from textlens.operators.represent import fit_classifier
from textlens.operators.scoring import sigmoid_best, softmax_best
from textlens.operators.serve import serve_best, serve_best_shared, serve_models
from textlens.session import scratch_path
from textlens.sources.tables import load_observations, read_table

LABELS = [0.0, 1.0, 2.0]


@pytest.fixture(scope="module")
def obs(spark):
    return load_observations(spark, SF_SMALL)


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF_SMALL, "documents").select("doc_id", "text")


@pytest.fixture(scope="module")
def models(obs):
    nb = fit_naive_bayes(obs, 2, 300, 0.25)
    return {"nb": nb, "linear": nb_log_odds(fit_naive_bayes(obs, 1, 100, 1.0)),
            "logistic": fit_ovr_logistic(obs, 1, 200, 0.05),
            "sppmi": fit_classifier(obs, "sppmi", 1, 400, 0.25, 1),
            "sppmi_sum": fit_classifier(obs, "sppmi", 1, 400, 0.25, 1, unseen="sum"),
            "sppmi_logistic": fit_classifier(obs, "sppmi", 1, 400, k=1, learner="logistic", unseen="sum")}


def test_saturated_margins_decide(spark):
    z = spark.createDataFrame([(1, [15.0, 16.0, 17.0]), (2, [800.0, 900.0, 850.0]), (3, [5.0, 5.0, 1.0])],
                              "doc_id long, z array<double>")
    assert [r["label"] for r in sigmoid_best(z, LABELS).orderBy("doc_id").collect()] == [2.0, 1.0, 0.0]
    got = softmax_best(z, LABELS, ["doc_id"]).orderBy("doc_id").collect()
    assert [r["label"] for r in got] == [2.0, 1.0, 0.0]
    assert [r["margin"] for r in got] == pytest.approx([17 - 16.3132617, 50.0, 5 - 5.0181499], abs=1e-6)
    for r in got:  # the margin is the log-odds of the confidence
        assert r["confidence"] == pytest.approx(1 / (1 + 2.718281828459045 ** -r["margin"]))


def test_predictions_of_two_models_join(models, docs):
    n = docs.count()
    for a in ("nb", "linear", "logistic"):
        for b in ("linear", "logistic", "sppmi_sum"):
            assert models[a].predict(docs).join(models[b].predict(docs), "doc_id").count() == n, (a, b)


@pytest.mark.parametrize("winner", [0, 1, 2])
def test_every_contestant_can_win(spark, winner):
    made = [spark.createDataFrame([(1, str(i), 1.0, 40.0 + (i == winner))],
                                  "doc_id long, category string, confidence double, margin double") for i in range(3)]
    r = serve_best(made).first()
    assert (r["algo"], r["category"]) == (winner, str(winner))


def test_serving_any_models(models, docs):
    best = serve_best([models[k].predict(docs) for k in ("nb", "linear", "logistic")])
    got = {r["doc_id"]: r for r in best.collect()}
    each = [{r["doc_id"]: r for r in models[k].predict(docs).collect()} for k in ("nb", "linear", "logistic")]
    for i, r in got.items():
        top = max(range(3), key=lambda a: (each[a][i]["margin"], -a))
        assert r["algo"] == top and r["category"] == each[top][i]["category"]
    assert len({r["algo"] for r in got.values()}) > 1


def test_serving_keeps_every_row(spark, models):
    """Null and repeated ids, null texts: one answer for each row, whatever the
    models; equal texts have equal answers."""
    asked = [(1, "a b c"), (1, "a b c"), (1, "d e"), (None, "a b c"), (2, None), (None, None), (3, "")]
    docs = spark.createDataFrame(asked, "doc_id bigint, text string")
    for names in (("nb", "linear"), ("nb", "logistic"), ("sppmi", "linear", "logistic"), ("sppmi_sum",)):
        some = [models[n] for n in names if n in models]
        got = serve_models(some, docs).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in asked), names
        assert all(r["category"] is not None and r["confidence"] is not None for r in got)
        texts = docs.select(F.xxhash64("text").alias("doc_id"), "text").distinct()
        alone = {r["doc_id"]: (r["category"], round(r["confidence"], 9), r["algo"]) for r in serve_models(some, texts).collect()}
        assert {(r["category"], round(r["confidence"], 9), r["algo"]) for r in got} == set(alone.values())


def test_serving_of_several_featurizers_has_one_scan(models, docs):
    _map_only(serve_models([models["nb"], models["linear"]], docs))


def test_one_pass_serving_of_wide_models_falls_back(spark, models, obs, docs):
    a, b = models["nb"], fit_naive_bayes(obs, 2, 300, 1.0)
    want = sorted((r["doc_id"], r["category"], r["algo"]) for r in serve_best_shared([a, b], docs).collect())
    key, old = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "4k")
    try:
        assert not a.in_rows()
        got = sorted((r["doc_id"], r["category"], r["algo"]) for r in serve_best_shared([a, b], docs).collect())
    finally:
        spark.conf.set(key, old)
    assert got == want


def test_scoring_in_the_row_has_no_shuffle_and_one_scan(models, docs):
    _map_only(models["nb"].predict(docs))


def _map_only(pred):
    plan = pred._jdf.queryExecution().executedPlan()
    assert plan.toString().count("documents.parquet") == 1
    main = [plan]  # without the subqueries, which make the model's one row
    for node in main:
        main += [node.children().apply(i) for i in range(node.children().length())]
        if "Adaptive" in node.nodeName():
            main.append(node.executedPlan())
    names = [n.nodeName() for n in main]
    assert not [n for n in names if "Exchange" in n or "Join" in n or "Aggregate" in n], names
    assert any("Scan" in n for n in names)


@pytest.mark.parametrize("name", ["nb", "linear"])
def test_row_and_join_scores_agree(spark, models, docs, name):
    odd = docs.union(spark.createDataFrame([(-1, ""), (-2, "   "), (-3, None), (-4, "never seen words")], "doc_id long, text string"))
    model = models[name]
    want = {r["doc_id"]: r for r in model.predict(odd).collect()}
    key, old = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        df = model.predict(odd)
        assert "_salt" in df._jdf.queryExecution().executedPlan().toString()
        got = {r["doc_id"]: r for r in df.collect()}
    finally:
        spark.conf.set(key, old)
    assert got.keys() == want.keys() and len(got) == odd.count()
    for i, r in got.items():
        assert r["category"] == want[i]["category"] and r["margin"] == pytest.approx(want[i]["margin"], rel=1e-9, abs=1e-9)


def test_hand_worked_linear_model(spark):
    weights = spark.createDataFrame([(0.0, 0, 1.0), (1.0, 1, 2.0)], "label double, bucket long, weight double")
    classes = spark.createDataFrame([(0.0, 0.5, "a"), (1.0, -1.0, "b")], "label double, intercept double, category string")
    m = LinearModel(1, 2, [0.0, 1.0], weights, classes).with_gains()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["x", "y", "x y z", ""])], "doc_id long, text string")
    tf = {}
    for r in m.features(docs).collect():
        tf.setdefault(r["doc_id"], {})[r["bucket"]] = r["tf"]
    for r in m.scores(docs).collect():
        t = tf.get(r["doc_id"], {})
        assert r["z"] == pytest.approx([0.5 + t.get(0, 0), -1.0 + 2.0 * t.get(1, 0)])


@pytest.mark.parametrize("name", ["nb", "linear", "logistic", "sppmi", "sppmi_sum", "sppmi_logistic"])
def test_saved_models_predict_alike(spark, models, docs, name):
    again = load_model(spark, save_model(models[name], scratch_path(spark, "model")))
    want = {r["doc_id"]: r for r in models[name].predict(docs).collect()}
    got = again.predict(docs).collect()
    assert len(got) == len(want) == docs.count()
    for r in got:
        assert r["category"] == want[r["doc_id"]]["category"]
        assert r["confidence"] == pytest.approx(want[r["doc_id"]]["confidence"], abs=1e-9)


@pytest.mark.parametrize("name", ["linear", "logistic"])
def test_streams_of_other_models(spark, models, docs, name):
    from textlens.streaming.score import document_stream, score_stream
    path = save_model(models[name], scratch_path(spark, "model"))
    out, query = score_stream(spark, document_stream(spark, SF_SMALL, max_files_per_trigger=1), path)
    query.awaitTermination()
    got = {r["doc_id"]: r["category"] for r in spark.read.parquet(out).collect()}
    assert got == {r["doc_id"]: r["category"] for r in models[name].predict(docs).collect()}


def test_unseen_texts_get_vectors(spark, models, docs, obs):
    """Summed vectors equal looked-up ones for training texts and are not zero
    for other texts that share buckets."""
    seen = obs.select("doc_id", "text")
    a = models["sppmi"].features.transform(seen).where("bucket is not null")
    b = models["sppmi_sum"].features.transform(seen).where("bucket is not null")
    wa, wb = ({(r["doc_id"], r["bucket"]): r["x"] for r in d.collect()} for d in (a, b))
    assert wa and wa.keys() == wb.keys() and all(wa[k] == pytest.approx(wb[k]) for k in wa)
    other = docs.join(obs.select("text").distinct(), "text", "left_anti")
    assert models["sppmi"].features.transform(other).where("bucket is not null").isEmpty()
    assert not models["sppmi_sum"].features.transform(other).where("bucket is not null").isEmpty()


def test_lookup_of_a_much_repeated_text(spark):
    from textlens.operators.cooccur import text_vector_lookup
    train = spark.createDataFrame([(1, "hot"), (2, "hot"), (3, "cold"), (4, "bare")], "doc_id long, text string")
    vec = spark.createDataFrame([(d, j, float(j + 1)) for d, n in ((1, 3), (2, 3), (3, 1)) for j in range(n)], "doc_id long, j long, x double")
    q = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "cold").when(F.col("id") == 7, "new")
                                 .when(F.col("id") == 8, "bare").otherwise("hot").alias("text"))
    got = text_vector_lookup(q, train, vec)
    assert got.where("j is not null").groupBy("doc_id").agg(F.sum("x")).groupBy("sum(x)").count().orderBy("sum(x)").collect() == [(1.0, 10), (6.0, 988)]
    assert got.where("doc_id = 7").count() == 0
    assert text_vector_lookup(q, train, vec, outer=True).where("j is null").count() == 2


def test_lookup_copies_only_repeated_texts(spark):
    """A vector travels once, and once more for each ``copy_rows`` queries of its
    text; rows are the same, in long form or packed, null texts and equal ids too."""
    from textlens.operators.cooccur import text_vector_lookup
    train = spark.createDataFrame([(i, f"t{i % 40}") for i in range(60)], "doc_id long, text string")
    vec = spark.createDataFrame([(i, [1, 4], [float(i % 40), 2.0]) for i in range(60)], "doc_id long, j array<long>, x array<double>")
    texts = ["t0"] * 50 + [f"t{i}" for i in range(1, 40)] + [None, None, "new"]
    q = spark.createDataFrame([(i % 80, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = sorted((i % 80, j, x) for i, t in enumerate(texts) if t and t != "new" for j, x in ((1, float(t[1:])), (4, 2.0)))
    for copy_rows in (7, 1000):
        got = text_vector_lookup(q, train, vec, copy_rows=copy_rows)
        assert sorted(map(tuple, got.collect())) == want
        every = text_vector_lookup(q, train, vec, copy_rows=copy_rows, outer=True, packed=True)
        assert every.count() == len(texts) and every.where("j is null").count() == 3
        copies = got._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(0, 31" not in copies


def test_models_drop_their_tables(spark, obs, docs):
    import os
    m = fit_naive_bayes(obs, 1, 50)
    paths = [p.removeprefix("file:") for p in m.made]
    assert paths and all(os.path.isdir(p) for p in paths)
    m.drop()
    assert not any(os.path.exists(p) for p in paths)


def test_scratch_folder_needs_a_shared_one(monkeypatch):
    import textlens.session as s
    assert s.shares_this_machine("local") and s.shares_this_machine("local[8]")
    assert not any(s.shares_this_machine(m) for m in ("local-cluster[2,1,1024]", "yarn", "spark://h:7077", "k8s://x"))

    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, k, default=None):
            return self.values.get(k, default)

    class Context:
        def __init__(self, master, folder):
            self.master, self.folder = master, folder

        def getConf(self):
            return Conf({})

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, path):
            self.folder = path

    class Session:
        def __init__(self, master, folder=None, conf=None):
            self.sparkContext, self.conf = Context(master, folder), Conf(conf or {})

    with pytest.raises(ValueError):
        s.ensure_checkpoint_dir(Session("yarn"))
    assert s.ensure_checkpoint_dir(Session("yarn", "hdfs://x/checkpoints")) == "hdfs://x/checkpoints"
    assert s.ensure_checkpoint_dir(Session("yarn", conf={"spark.checkpoint.dir": "hdfs://y"})) == "hdfs://y"
    assert s.ensure_checkpoint_dir(Session("local[2]")).startswith("/")
