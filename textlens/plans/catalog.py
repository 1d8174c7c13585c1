"""The registered queries: ``name -> (spark_fn(spark, base) -> DataFrame, sql | None)``.

Every query reads the given tables at ``base`` in full. The SQL twin
states the same result for DuckDB over the same parquet files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.functions.mathfn import rounded
from textlens.functions.text import ngrams, tokens
from textlens.operators.features import (
    category_map, distinct_labels, fit_idf, hashed_tf, ovr_columns, presence, tfidf, with_grams, with_terms,
)
from textlens.operators.cooccur import (
    doc_sppmi_append, doc_sppmi_sum, fit_sppmi, presence_arrays, sppmi_rows, text_vector_lookup,
)
from textlens.operators.evaluate import (
    accuracy, assign_folds, kfold_naive_bayes, kfold_roles, soft_accuracy,
)
from textlens.operators.fold_sppmi import fit_fold_sppmi, kfold_sppmi_logistic, kfold_sppmi_naive_bayes
from textlens.operators.linear import binary_confidence, nb_log_odds, readable_weights
from textlens.operators.minibatch import fit_minibatch_logistic
from textlens.operators.mlfit import fit_ovr_logistic, fold_logistic_predictions
from textlens.operators.naive_bayes import fit_naive_bayes, fit_naive_bayes_many
from textlens.operators.online import fit_online_logistic
from textlens.operators.serve import score_queries, serve_best_shared, serve_models
from textlens.operators.persist import load_model, save_model
from textlens.operators.represent import fit_classifier
from textlens.operators.rowindex import row_index
from textlens.operators.util import materialize
from textlens.session import scratch_path
from textlens.streaming.score import document_stream, score_stream
from textlens.plans import oracle as O
from textlens.plans import params as P
from textlens.functions.text import clean_text
from textlens.sources.events import event_scan, prop, stop_words
from textlens.sources.lines import parse_labelled_lines
from textlens.sources.sinks import coo_triples, onehot_triples, vw_lines
from textlens.sources.tables import load_observations, read_table, read_text_table, sanity_sample

SparkQuery = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[SparkQuery, str | None]] = {}

US = "\u001f"  # token separator of the digests


def register(name: str, sql: str | None):
    sql = O.inline_ctes(sql) if sql else sql

    def deco(fn: SparkQuery) -> SparkQuery:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _obs(spark, base):
    return load_observations(spark, base, P.LABEL_COL)


def _docs(spark, base):
    return read_text_table(spark, base, "documents", ["doc_id"], ["doc_id", "text"])


def _nb(spark, base, lam=P.NB_LAMBDA):
    return fit_naive_bayes(_obs(spark, base), P.EVAL_NGRAM, P.EVAL_FEATURES, lam)


# ---------------------------------------------------------------- sources

@register("observations", f"SELECT doc_id, label, category, md5(text) AS text_md5 FROM ({O.obs_sql()})")
def q_observations(spark, base):
    return _obs(spark, base).select("doc_id", "label", "category", F.md5("text").alias("text_md5"))


_EV_LIST = ", ".join(f"'{e}'" for e in P.SCAN_EVENTS)


@register("event_scan", f"SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ({_EV_LIST})")
def q_event_scan(spark, base):
    ev = read_table(spark, base, "events")
    return event_scan(ev, list(P.SCAN_EVENTS)).select("event_id", "user_id", "event_type", "value")


@register("event_props", f"SELECT event_id, CAST(json_extract_string(props, '$.{P.PROP_KEY}') AS BIGINT) AS {P.PROP_KEY} FROM events")
def q_event_props(spark, base):
    ev = read_table(spark, base, "events")
    return ev.select("event_id", prop(P.PROP_KEY, "bigint").alias(P.PROP_KEY))


@register("stopwords", f"SELECT DISTINCT json_extract_string(props, '$.{P.PROP_KEY}') AS word FROM events "
                       f"WHERE event_type = '{P.STOPWORD_EVENT}' AND json_extract_string(props, '$.{P.PROP_KEY}') IS NOT NULL")
def q_stopwords(spark, base):
    return stop_words(read_table(spark, base, "events"), P.STOPWORD_EVENT, P.PROP_KEY)


_FREQUENT = (f"tk AS (SELECT doc_id, unnest({O.tokens_sql()}) AS word FROM documents),\n"
             f"stop AS (SELECT word FROM tk GROUP BY word HAVING count(DISTINCT doc_id) * {P.STOP_SHARE} > (SELECT count(*) FROM documents))")


@register("stopword_filter", f"WITH {_FREQUENT}\nSELECT doc_id, CAST(count(w) AS BIGINT) AS n_left, "
                             f"md5(coalesce(string_agg(w, chr(31) ORDER BY i), '')) AS tokens_md5 FROM ("
                             f"SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM "
                             f"(SELECT doc_id, {O.tokens_sql()} AS ws FROM documents)) t "
                             f"WHERE w NOT IN (SELECT word FROM stop) GROUP BY doc_id")
def q_stopword_filter(spark, base):
    """S5 applied: the words that more than a tenth of the documents have are
    taken out; documents that keep any token."""
    docs = _docs(spark, base)
    words = with_grams(docs, 1).select("doc_id", F.explode_outer(F.array_distinct("grams")).alias("word")).where("word is not null")
    n = docs.select(F.count(F.lit(1))).scalar()
    stop = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * P.STOP_SHARE > n).select("word")
    left = with_grams(docs, 1, stop_words=stop).where(F.size("grams") > 0)
    return left.select("doc_id", F.size("grams").cast("bigint").alias("n_left"), F.md5(F.array_join("grams", US)).alias("tokens_md5"))


_LINES = f"SELECT d.doc_id, CAST(l.{P.LABEL_COL} AS VARCHAR) || ',' || d.text AS line FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


@register("labelled_lines", f"WITH ln AS ({_LINES}),\n"
                            f"st AS (SELECT doc_id, rtrim(line, chr(13) || chr(10)) AS s FROM ln),\n"
                            f"pr AS (SELECT doc_id, CASE WHEN instr(s, ',') > 0 THEN substr(s, 1, instr(s, ',') - 1) ELSE s END AS label_str, "
                            f"CASE WHEN instr(s, ',') > 0 THEN substr(s, instr(s, ',') + 1) ELSE '' END AS text FROM st)\n"
                            f"SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx, label_str, "
                            f"CASE WHEN label_str = '1' THEN {O.dbl(1)} ELSE {O.dbl(0)} END AS label, md5(text) AS text_md5 FROM pr")
def q_labelled_lines(spark, base):
    docs = read_table(spark, base, "documents")
    labels = read_table(spark, base, "labels")
    lines = docs.join(labels, "doc_id").select(
        "doc_id", F.concat(F.col(P.LABEL_COL).cast("string"), F.lit(","), F.col("text")).alias("line"))
    parsed = parse_labelled_lines(lines, "line")
    out = parsed.join(row_index(parsed.select("doc_id"), "doc_id"), "doc_id")
    return out.select("doc_id", "idx", "label_str",
                      F.when(F.col("label_str") == "1", 1.0).otherwise(0.0).alias("label"),
                      F.md5("text").alias("text_md5"))


@register("sanity_sample", f"SELECT doc_id, label FROM ({O.obs_sql()}) ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 5")
def q_sanity_sample(spark, base):
    return sanity_sample(_obs(spark, base))


@register("clean_text", f"SELECT doc_id, md5(regexp_replace(text, '[|:\\r\\n]', ' ', 'g')) AS clean_md5 FROM documents")
def q_clean_text(spark, base):
    return _docs(spark, base).select("doc_id", F.md5(clean_text(F.col("text"))).alias("clean_md5"))


_VW_PAIRS = (f"SELECT doc_id, string_agg(CAST(bucket AS VARCHAR) || ':' || CAST(CAST(tf AS DOUBLE) AS VARCHAR), ' ' ORDER BY bucket) AS pairs "
             f"FROM ({O.tf_sql('obs', ['doc_id'], P.TF_NGRAM, P.TF_FEATURES)}) GROUP BY doc_id")


@register("vw_lines", f"WITH obs AS ({O.obs_sql()}),\npairs AS ({_VW_PAIRS})\n"
                      f"SELECT o.doc_id, CASE WHEN o.label = 0 THEN '-1.0' ELSE '1.0' END || ' |n ' || "
                      f"regexp_replace(o.text, '[|:\\r\\n]', ' ', 'g') || ' ' || coalesce(p.pairs, '') AS line "
                      f"FROM obs o LEFT JOIN pairs p ON p.doc_id = o.doc_id")
def q_vw_lines(spark, base):
    obs = _obs(spark, base)
    terms = with_terms(obs.select("doc_id", "label", "text"), P.TF_NGRAM, P.TF_FEATURES)
    return vw_lines(terms)


_COO = (f"WITH obs AS ({O.obs_sql()}),\ntf AS ({O.tf_sql('obs', ['doc_id'], P.TF_NGRAM, P.TF_FEATURES)}),\n"
        f"{O.idf_ctes('tf', 'obs')},\nix AS (SELECT doc_id, label, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx FROM obs)\n")


@register("coo_triples", _COO + f"SELECT ix.idx AS row_idx, x.bucket AS feature_idx, round(x.x, {O.D}) AS value "
                                f"FROM ({O.tfidf_sql('tf')}) x JOIN ix ON ix.doc_id = x.doc_id")
def q_coo_triples(spark, base):
    obs = _obs(spark, base)
    tf = hashed_tf(obs, P.TF_NGRAM, P.TF_FEATURES)
    table, counts = fit_idf(tf, obs)
    index = row_index(obs.select("doc_id", "label"), "doc_id")
    out = coo_triples(tfidf(tf, table, counts, P.TF_FEATURES), index)
    return out.select("row_idx", "feature_idx", rounded(F.col("value")).alias("value"))


@register("onehot_triples", _COO + f"SELECT idx AS row_idx, CAST(label AS INTEGER) AS label, {O.dbl(1)} AS value FROM ix")
def q_onehot_triples(spark, base):
    index = row_index(_obs(spark, base).select("doc_id", "label"), "doc_id")
    return onehot_triples(index)


# ------------------------------------------------------------- text scalars

def _digest_sql(expr: str) -> str:
    return (f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_items, "
            f"CAST(len(list_filter(w, lambda t: t = '')) AS BIGINT) AS n_empty, "
            f"md5(coalesce(array_to_string(w, chr(31)), '')) AS digest "
            f"FROM (SELECT doc_id, {expr} AS w FROM documents)")


def _digest(df: DataFrame, arr) -> DataFrame:
    return df.select("doc_id", arr.alias("w")).select(
        "doc_id", F.size("w").cast("bigint").alias("n_items"),
        F.size(F.filter("w", lambda t: t == "")).cast("bigint").alias("n_empty"),
        F.md5(F.array_join("w", US)).alias("digest"))


@register("tokens", _digest_sql(O.tokens_sql()))
def q_tokens(spark, base):
    return _digest(_docs(spark, base), tokens(F.col("text")))


@register("ngrams", _digest_sql(O.grams_sql(O.tokens_sql(), P.EVAL_NGRAM)))
def q_ngrams(spark, base):
    return _digest(_docs(spark, base), ngrams(tokens(F.col("text")), P.EVAL_NGRAM))


# --------------------------------------------------------------- features

@register("hashed_tf", O.tf_sql("documents", ["doc_id"], P.TF_NGRAM, P.TF_FEATURES))
def q_hashed_tf(spark, base):
    return hashed_tf(_docs(spark, base), P.TF_NGRAM, P.TF_FEATURES)


@register("presence", f"SELECT doc_id, bucket FROM ({O.tf_sql('documents', ['doc_id'], P.TF_NGRAM, P.TF_FEATURES)})")
def q_presence(spark, base):
    return presence(hashed_tf(_docs(spark, base), P.TF_NGRAM, P.TF_FEATURES))


_IDF_SQL_HEAD = (f"WITH obs AS ({O.obs_sql()}),\n"
                 f"tf AS ({O.tf_sql('obs', ['doc_id'], P.TF_NGRAM, P.TF_FEATURES)}),\n"
                 f"{O.idf_ctes('tf', 'obs')}")


@register("idf", f"{_IDF_SQL_HEAD}\nSELECT bucket, df, round(idf, {O.D}) AS idf FROM idf")
def q_idf(spark, base):
    obs = _obs(spark, base)
    table, _ = fit_idf(hashed_tf(obs, P.TF_NGRAM, P.TF_FEATURES), obs)
    return table.select("bucket", "df", rounded(F.col("idf")).alias("idf"))


@register("tfidf", f"{_IDF_SQL_HEAD},\n"
                   f"qtf AS ({O.tf_sql('documents', ['doc_id'], P.TF_NGRAM, P.TF_FEATURES)})\n"
                   f"SELECT doc_id, bucket, round(x, {O.D}) AS x FROM ({O.tfidf_sql('qtf')})")
def q_tfidf(spark, base):
    obs = _obs(spark, base)
    table, counts = fit_idf(hashed_tf(obs, P.TF_NGRAM, P.TF_FEATURES), obs)
    x = tfidf(hashed_tf(_docs(spark, base), P.TF_NGRAM, P.TF_FEATURES), table, counts, P.TF_FEATURES)
    return x.select("doc_id", "bucket", rounded(F.col("x")).alias("x"))


@register("category_map", f"SELECT label, arg_max(category, doc_id) AS category FROM ({O.obs_sql()}) GROUP BY label")
def q_category_map(spark, base):
    return category_map(_obs(spark, base))


# ------------------------------------------------------------ Naive Bayes

_NB_HEAD = f"WITH {O.nb_model_ctes(P.EVAL_NGRAM, P.EVAL_FEATURES, P.NB_LAMBDA)}"


@register("nb_pi", f"{_NB_HEAD}\nSELECT label, n, round(pi, {O.D}) AS pi FROM classes")
def q_nb_pi(spark, base):
    return _nb(spark, base).classes.select("label", "n", rounded(F.col("pi")).alias("pi"))


@register("nb_theta", f"{_NB_HEAD}\nSELECT label, bucket, round(theta, {O.D}) AS theta FROM theta")
def q_nb_theta(spark, base):
    return _nb(spark, base).theta.select("label", "bucket", rounded(F.col("theta")).alias("theta"))


@register("nb_scores", f"{_NB_HEAD},\nq AS (SELECT doc_id, text FROM documents),\n"
                       f"q_tf AS ({O.tf_sql('q', ['doc_id'], P.EVAL_NGRAM, P.EVAL_FEATURES)}),\n"
                       f"q_x AS ({O.tfidf_sql('q_tf')}),\n{O.nb_z_ctes('q', 'q_x')}\n"
                       f"SELECT doc_id, label, round(e / sum(e) OVER (PARTITION BY doc_id), {O.D}) AS score "
                       f"FROM (SELECT doc_id, label, exp(z - max(z) OVER (PARTITION BY doc_id)) AS e FROM z)")
def q_nb_scores(spark, base):
    probs = _nb(spark, base).probabilities(_docs(spark, base))
    return probs.select("doc_id", "label", rounded(F.col("score")).alias("score"))


NB_PREDICT_SQL = (f"{_NB_HEAD},\nq AS (SELECT doc_id, text FROM documents),\n"
                  f"{O.nb_predict_ctes('q', ['doc_id'], P.EVAL_NGRAM, P.EVAL_FEATURES)}\n"
                  f"SELECT doc_id, category, round(confidence, {O.D}) AS confidence, label FROM pred")


@register("nb_predict", NB_PREDICT_SQL)
def q_nb_predict(spark, base):
    pred = _nb(spark, base).predict(_docs(spark, base))
    return pred.select("doc_id", "category", rounded(F.col("confidence")).alias("confidence"), "label")


# ------------------------------------------------------------------ SPPMI

def _sppmi(spark, base, k):
    obs = _obs(spark, base)
    terms = with_terms(obs.select("doc_id", "text"), P.SPPMI_NGRAM, P.SPPMI_FEATURES)
    pres = materialize(presence_arrays(terms))  # read again for vectors
    n = obs.select(F.count(F.lit(1))).scalar()
    cooc, sp = fit_sppmi(pres, n, P.SPPMI_FEATURES, k)
    return obs, pres, cooc, sp


_SP1 = f"WITH {O.sppmi_ctes(P.SPPMI_K_DENSE)}"
_SP2 = f"WITH {O.sppmi_ctes(P.SPPMI_K_SPARSE)}"


@register("cooccurrence", f"{_SP1}\nSELECT i, j, c FROM co")
def q_cooccurrence(spark, base):
    return _sppmi(spark, base, P.SPPMI_K_DENSE)[2]


@register("sppmi", f"{_SP1}\nSELECT i, j, round(s, {O.D}) AS sppmi FROM sp")
def q_sppmi(spark, base):
    sp = _sppmi(spark, base, P.SPPMI_K_DENSE)[3]
    return sp.select("i", "j", rounded(F.col("sppmi")).alias("sppmi"))


@register("sppmi_rows", f"{_SP2}\nSELECT i, j, round(s, {O.D}) AS s FROM srows")
def q_sppmi_rows(spark, base):
    rows = sppmi_rows(_sppmi(spark, base, P.SPPMI_K_SPARSE)[3])
    return rows.select("i", "j", rounded(F.col("s")).alias("s"))


@register("doc_sppmi_sum", f"{_SP2}\nSELECT doc_id, j, round(x, {O.D}) AS x FROM dsum")
def q_doc_sppmi_sum(spark, base):
    _, pres, _, sp = _sppmi(spark, base, P.SPPMI_K_SPARSE)
    x = doc_sppmi_sum(pres, sppmi_rows(sp), P.SPPMI_FEATURES)
    return x.select("doc_id", "j", rounded(F.col("x")).alias("x"))


@register("doc_sppmi_append", f"{_SP2}\nSELECT p.doc_id, CAST({P.SPPMI_FEATURES} * p.rk + r.j AS BIGINT) AS position, "
                              f"round(r.s, {O.D}) AS x FROM (SELECT doc_id, bucket, row_number() OVER "
                              f"(PARTITION BY doc_id ORDER BY bucket) AS rk FROM pres) p JOIN srows r ON r.i = p.bucket")
def q_doc_sppmi_append(spark, base):
    _, pres, _, sp = _sppmi(spark, base, P.SPPMI_K_SPARSE)
    x = doc_sppmi_append(pres, sppmi_rows(sp), P.SPPMI_FEATURES)
    return x.select("doc_id", "position", rounded(F.col("x")).alias("x"))


@register("text_vector_lookup", f"{_SP2},\nreps AS (SELECT md5(text) AS h, text, min(doc_id) AS rep FROM obs GROUP BY md5(text), text)\n"
                                f"SELECT q.doc_id, d.j, round(d.x, {O.D}) AS x FROM documents q "
                                f"JOIN reps ON reps.h = md5(q.text) AND reps.text = q.text JOIN dsum d ON d.doc_id = reps.rep")
def q_text_vector_lookup(spark, base):
    obs, pres, _, sp = _sppmi(spark, base, P.SPPMI_K_SPARSE)
    vec = doc_sppmi_sum(pres, sppmi_rows(sp), P.SPPMI_FEATURES, packed=True)
    x = text_vector_lookup(_docs(spark, base), obs.select("doc_id", "text"), vec)
    return x.select("doc_id", "j", rounded(F.col("x")).alias("x"))


@register("sppmi_nb_predict", f"{_SP2},\n"
                              f"pts AS (SELECT d.doc_id, o.label, d.j AS bucket, d.x FROM dsum d JOIN obs o ON o.doc_id = d.doc_id),\n"
                              f"{O.nb_ctes('pts', 'obs', P.NB_LAMBDA, P.SPPMI_FEATURES)},\n"
                              f"reps AS (SELECT md5(text) AS h, text, min(doc_id) AS rep FROM obs GROUP BY md5(text), text),\n"
                              f"q AS (SELECT doc_id, text FROM documents),\n"
                              f"qx AS (SELECT q.doc_id, d.j AS bucket, d.x FROM q JOIN reps ON reps.h = md5(q.text) "
                              f"AND reps.text = q.text JOIN dsum d ON d.doc_id = reps.rep),\n"
                              f"{O.nb_z_ctes('q', 'qx')},\n{O.softmax_best_ctes('z', 'pred')}\n"
                              f"SELECT doc_id, category, round(confidence, {O.D}) AS confidence, label FROM pred")
def q_sppmi_nb_predict(spark, base):
    """F3 with SPPMI on: NB over additive SPPMI document vectors; documents
    whose text is not a training text are scored from the priors."""
    model = fit_classifier(_obs(spark, base), "sppmi", P.SPPMI_NGRAM, P.SPPMI_FEATURES, P.NB_LAMBDA,
                           P.SPPMI_K_SPARSE)
    pred = model.predict(_docs(spark, base))
    return pred.select("doc_id", "category", rounded(F.col("confidence")).alias("confidence"), "label")


@register("sppmi_score_unseen", f"{_SP2},\n"
                                f"pts AS (SELECT d.doc_id, o.label, d.j AS bucket, d.x FROM dsum d JOIN obs o ON o.doc_id = d.doc_id),\n"
                                f"{O.nb_ctes('pts', 'obs', P.NB_LAMBDA, P.SPPMI_FEATURES)},\n"
                                f"q AS (SELECT doc_id, text FROM documents),\n"
                                f"qtf AS ({O.tf_sql('q', ['doc_id'], P.SPPMI_NGRAM, P.SPPMI_FEATURES)}),\n"
                                f"qx AS (SELECT p.doc_id, r.j AS bucket, sum(r.s) AS x FROM qtf p JOIN srows r ON r.i = p.bucket GROUP BY p.doc_id, r.j),\n"
                                f"{O.nb_z_ctes('q', 'qx')},\n{O.softmax_best_ctes('z', 'pred')}\n"
                                f"SELECT doc_id, category, round(confidence, {O.D}) AS confidence, label FROM pred")
def q_sppmi_score_unseen(spark, base):
    """F3 + F8 for any text: the vector of a query is summed from the rows of
    its own buckets, whether the text was seen in training or not."""
    model = fit_classifier(_obs(spark, base), "sppmi", P.SPPMI_NGRAM, P.SPPMI_FEATURES, P.NB_LAMBDA,
                           P.SPPMI_K_SPARSE, unseen="sum")
    pred = model.predict(_docs(spark, base))
    return pred.select("doc_id", "category", rounded(F.col("confidence")).alias("confidence"), "label")


@register("sppmi_eval", f"WITH {O.sppmi_ctes(P.SPPMI_K_EVAL, P.EVAL_NGRAM, P.EVAL_FEATURES)}\n"
                        f"SELECT i, j, round(s, {O.D}) AS sppmi FROM sp")
def q_sppmi_eval(spark, base):
    """F4-F6 at the evaluation setting: bigrams, 5,000 buckets, k = 10."""
    obs = _obs(spark, base)
    terms = with_terms(obs.select("doc_id", "text"), P.EVAL_NGRAM, P.EVAL_FEATURES)
    _, sp = fit_sppmi(presence_arrays(terms), obs.select(F.count(F.lit(1))).scalar(), P.EVAL_FEATURES, P.SPPMI_K_EVAL)
    return sp.select("i", "j", rounded(F.col("sppmi")).alias("sppmi"))


# ------------------------------------------------- linear models, serving

_Q = "q AS (SELECT doc_id, text FROM documents)"
_QX = (f"q_tf AS ({O.tf_sql('q', ['doc_id'], P.EVAL_NGRAM, P.EVAL_FEATURES)}),\n"
       f"q_x AS ({O.tfidf_sql('q_tf')})")
_LIN_HEAD = f"{_NB_HEAD},\n{_Q},\n{_QX},\n{O.log_odds_ctes(P.EVAL_FEATURES)},\n{O.linear_z_ctes('q', 'q_x')}"


def _linear(spark, base):
    return nb_log_odds(_nb(spark, base))


@register("linear_predict", f"{_LIN_HEAD},\n{O.sigmoid_best_ctes('lin_z', 'lp', 'catmap')}\n"
                            f"SELECT doc_id, category, round(confidence, {O.D}) AS confidence, label FROM lp")
def q_linear_predict(spark, base):
    pred = _linear(spark, base).predict(_docs(spark, base))
    return pred.select("doc_id", "category", rounded(F.col("confidence")).alias("confidence"), "label")


@register("binary_confidence", f"{_LIN_HEAD}\nSELECT doc_id, CASE WHEN p > 0.5 THEN '1' ELSE '0' END AS category, "
                               f"round(CASE WHEN p > 0.5 THEN p ELSE 1 - p END, {O.D}) AS confidence "
                               f"FROM (SELECT doc_id, 1 / (1 + exp(-z)) AS p FROM lin_z WHERE label = 1)")
def q_binary_confidence(spark, base):
    prob = _linear(spark, base).probability(_docs(spark, base), 1.0)
    out = binary_confidence(prob)
    return out.select("doc_id", "category", rounded(F.col("confidence")).alias("confidence"))


@register("readable_weights", f"{_NB_HEAD},\n{O.log_odds_ctes(P.EVAL_FEATURES)},\n"
                              f"g AS (SELECT DISTINCT unnest({O.grams_sql(O.tokens_sql(), P.EVAL_NGRAM)}) AS gram FROM obs)\n"
                              f"SELECT g.gram, {O.bucket_sql('g.gram', P.EVAL_FEATURES)} AS bucket, round(w.w, {O.D}) AS weight "
                              f"FROM g JOIN lin_w w ON w.label = 1 AND w.bucket = {O.bucket_sql('g.gram', P.EVAL_FEATURES)}")
def q_readable_weights(spark, base):
    rw = readable_weights(_obs(spark, base), _linear(spark, base), 1.0)
    return rw.select("gram", "bucket", rounded(F.col("weight")).alias("weight"))


_NB_B = O.nb_model_ctes(P.EVAL_NGRAM, P.EVAL_FEATURES, P.NB_GRID[1], prefix="b_")
_UNI = (f"{O.nb_model_ctes(P.TF_NGRAM, P.TF_FEATURES, P.NB_LAMBDA, prefix='u_')},\n"
        f"u_q_tf AS ({O.tf_sql('q', ['doc_id'], P.TF_NGRAM, P.TF_FEATURES)}),\nu_q_x AS ({O.tfidf_sql('u_q_tf', 'u_')}),\n"
        f"{O.log_odds_ctes(P.TF_FEATURES, 'u_')},\n{O.linear_z_ctes('q', 'u_q_x')}")
_BEST = (f"SELECT doc_id, category, round(confidence, {O.D}) AS confidence, algo FROM (SELECT *, row_number() OVER "
         f"(PARTITION BY doc_id ORDER BY margin DESC, algo) AS rn FROM allp) WHERE rn = 1")
_BEST_OF_3 = ("allp AS (SELECT doc_id, category, confidence, margin, 0 AS algo FROM pa "
              "UNION ALL SELECT doc_id, category, confidence, margin, 1 FROM pb "
              f"UNION ALL SELECT doc_id, category, confidence, margin, 2 FROM pc)\n{_BEST}")


def _served(best):
    return best.select("doc_id", "category", rounded(F.col("confidence")).alias("confidence"), "algo")


@register("serve_best", f"{_NB_HEAD},\n{_NB_B},\n{_Q},\n"
                        f"{O.nb_predict_ctes('q', ['doc_id'], P.EVAL_NGRAM, P.EVAL_FEATURES, '', 'pa')},\n"
                        f"{O.nb_predict_ctes('q', ['doc_id'], P.EVAL_NGRAM, P.EVAL_FEATURES, 'b_', 'pb')},\n"
                        f"{_UNI},\n{O.sigmoid_best_ctes('lin_z', 'pc', 'u_catmap')},\n{_BEST_OF_3}")
def q_serve_best(spark, base):
    """V1 over any models in one scan: two Naive Bayes models on bigrams and a
    linear one on unigrams, in another hash space."""
    obs, docs = _obs(spark, base), _docs(spark, base)
    nb_a, nb_b = fit_naive_bayes_many(obs, P.EVAL_NGRAM, P.EVAL_FEATURES, [P.NB_LAMBDA, P.NB_GRID[1]])
    lin = nb_log_odds(fit_naive_bayes(obs, P.TF_NGRAM, P.TF_FEATURES, P.NB_LAMBDA))
    return _served(serve_models([nb_a, nb_b, lin], docs))


@register("serve_best_shared", f"{_NB_HEAD},\n{_NB_B},\n{_Q},\n"
                               f"{O.nb_predict_ctes('q', ['doc_id'], P.EVAL_NGRAM, P.EVAL_FEATURES, '', 'pa')},\n"
                               f"{O.nb_predict_ctes('q', ['doc_id'], P.EVAL_NGRAM, P.EVAL_FEATURES, 'b_', 'pb')},\n"
                               f"allp AS (SELECT doc_id, category, confidence, margin, 0 AS algo FROM pa "
                               f"UNION ALL SELECT doc_id, category, confidence, margin, 1 FROM pb)\n{_BEST}")
def q_serve_best_shared(spark, base):
    """V1 in one pass: models of one featurizer scored inside the row."""
    models = fit_naive_bayes_many(_obs(spark, base), P.EVAL_NGRAM, P.EVAL_FEATURES, [P.NB_LAMBDA, P.NB_GRID[1]])
    return _served(serve_best_shared(models, _docs(spark, base)))


@register("serve_best_fitted", None)
def q_serve_best_fitted(spark, base):
    """V1 with an iterative fit among the contestants: Naive Bayes, a linear
    model and L2 logistic regression (its coefficients have no SQL twin)."""
    obs, docs = _obs(spark, base), _docs(spark, base)
    nb = fit_naive_bayes(obs, P.EVAL_NGRAM, P.EVAL_FEATURES, P.NB_LAMBDA)
    lin = nb_log_odds(fit_naive_bayes(obs, P.TF_NGRAM, P.TF_FEATURES, P.NB_LAMBDA))
    lr = fit_ovr_logistic(obs, P.EVAL_NGRAM, P.EVAL_FEATURES, P.LR_GRID[0], P.LR_MAX_ITER)
    return _served(serve_models([nb, lin, lr], docs))


@register("score_queries", f"{_NB_HEAD},\nq AS (SELECT conv_id, turn, text FROM conversations),\n"
                           f"{O.nb_predict_ctes('q', ['conv_id', 'turn'], P.EVAL_NGRAM, P.EVAL_FEATURES)}\n"
                           f"SELECT conv_id, turn, category, round(confidence, {O.D}) AS confidence FROM pred")
def q_score_queries(spark, base):
    conv = read_text_table(spark, base, "conversations", ["conv_id", "turn"], ["conv_id", "turn", "text"])
    pred = score_queries(_nb(spark, base), conv, ["conv_id", "turn"])
    return pred.select("conv_id", "turn", "category", rounded(F.col("confidence")).alias("confidence"))


# ------------------------------------------------- pyspark.ml fits (rows)

@register("labeled_points", f"{_NB_HEAD}\nSELECT o.doc_id, o.label, CAST(count(p.bucket) AS BIGINT) AS nnz, "
                            f"round(coalesce(sum(p.x), 0), {O.D}) AS sum_x FROM obs o LEFT JOIN pts p ON p.doc_id = o.doc_id "
                            f"GROUP BY o.doc_id, o.label")
def q_labeled_points(spark, base):
    obs = _obs(spark, base)
    nb = _nb(spark, base)
    x = nb.features(obs.select("doc_id", "text"))
    per_doc = x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nnz"), F.sum("x").alias("sum_x"))
    return (obs.select("doc_id", "label").join(per_doc, "doc_id", "left")
            .select("doc_id", "label", F.coalesce(F.col("nnz"), F.lit(0)).cast("bigint").alias("nnz"),
                    rounded(F.coalesce(F.col("sum_x"), F.lit(0.0))).alias("sum_x")))


@register("ovr_columns", f"SELECT doc_id, label, CASE WHEN label = 0 THEN {O.dbl(1)} ELSE {O.dbl(0)} END AS \"0\", "
                         f"CASE WHEN label = 1 THEN {O.dbl(1)} ELSE {O.dbl(0)} END AS \"1\" FROM ({O.obs_sql()})")
def q_ovr_columns(spark, base):
    obs = _obs(spark, base)
    return ovr_columns(obs.select("doc_id", "label"), distinct_labels(obs))


@register("lr_fit_predict", None)
def q_lr_fit_predict(spark, base):
    """M5: L2 one-vs-rest logistic regression (maxIter 10), all documents scored."""
    m = fit_ovr_logistic(_obs(spark, base), P.EVAL_NGRAM, P.EVAL_FEATURES, P.LR_GRID[0], P.LR_MAX_ITER)
    return m.predict(_docs(spark, base)).select("doc_id", "category", "confidence")


@register("l1lr_fit_predict", None)
def q_l1lr_fit_predict(spark, base):
    """M6: L1 one-vs-rest logistic regression (OWL-QN, up to 250 iterations)."""
    m = fit_ovr_logistic(_obs(spark, base), P.TF_NGRAM, P.TF_FEATURES, P.L1_REG, P.L1_MAX_ITER, elastic_net=1.0)
    return m.predict(_docs(spark, base)).select("doc_id", "category", "confidence")


@register("minibatch_lr_fit_predict", None)
def q_minibatch_lr_fit_predict(spark, base):
    """M6 by mini-batch proximal descent: mini-batches of 1000, rate 0.1, up to 250 passes."""
    m = _minibatch_model(_obs(spark, base), P.L1_REG, P.L1_MAX_ITER)
    return m.predict(_docs(spark, base)).select("doc_id", "category", rounded(F.col("confidence")).alias("confidence"))


_PENALTIES = (P.L1_REG, 0.02, 100.0)


@register("minibatch_lr_path", "WITH o AS (SELECT count(*) AS n FROM documents) SELECT penalty, CAST(n AS BIGINT) AS n_scored, "
                               "CAST(n AS BIGINT) AS n_in_range, TRUE AS thinner, place = 1 AS beats_majority, place = 3 AS no_weights FROM o, "
                               f"(VALUES {', '.join(f'({O.dbl(x)}, {i})' for i, x in enumerate(_PENALTIES, 1))}) v(penalty, place)")
def q_minibatch_lr_path(spark, base):
    """M6 by mini-batches along growing penalties: every document scored, each
    confidence in [0.5, 1], fewer weights (none in the end) the larger the
    penalty; with the configured one training accuracy beats the majority."""
    obs, docs = _obs(spark, base), _docs(spark, base)
    truth = obs.select("doc_id", F.col("category").alias("actual"))
    top = obs.groupBy("category").count().agg((F.max("count") / F.sum("count")).alias("m")).first()["m"]
    out, before = [], P.TF_FEATURES + 1
    for i, reg in enumerate(_PENALTIES):
        m = _minibatch_model(obs, reg, 15)
        n = m.weights.where("label = 1 and weight <> 0").count()
        scored = m.predict(docs).join(truth, "doc_id", "left").agg(
            F.count(F.lit(1)).alias("n_scored"), F.sum(F.col("confidence").between(0.5, 1.0).cast("bigint")).alias("n_in_range"),
            F.avg((F.col("category") == F.col("actual")).cast("double")).alias("acc"))
        out.append(scored.select(F.lit(float(reg)).alias("penalty"), "n_scored", "n_in_range", F.lit(n < before).alias("thinner"),
                                 ((F.col("acc") > top) & F.lit(i == 0)).alias("beats_majority"), F.lit(n == 0).alias("no_weights")))
        before = n
    return reduce(DataFrame.unionByName, out)


def _minibatch_model(obs, reg, passes):
    return fit_minibatch_logistic(obs, P.TF_NGRAM, P.TF_FEATURES, reg, P.L1_BATCH, P.L1_RATE, passes)


@register("hashed_lr_fit_predict", None)
def q_hashed_lr_fit_predict(spark, base):
    """M7 + M8: one online pass over hashed 1..n-grams of the cleaned text at 22
    bits, with the label "1" folded into (category, confidence)."""
    m = _hashed_model(_obs(spark, base))
    z = m.margins(_docs(spark, base))
    p1 = 1 / (1 + F.exp(-F.col("z")[m.labels.index(1.0)]))
    return binary_confidence(z.select("doc_id", p1.alias("p"))).select(
        "doc_id", "category", rounded(F.col("confidence")).alias("confidence"))


@register("lr_grid", None)
def q_lr_grid(spark, base):
    """E5 (logistic part): regParam grid x k folds, accuracy per (reg, fold)."""
    obs = _obs(spark, base)
    folds = assign_folds(obs, P.EVAL_K)
    pred = fold_logistic_predictions(obs, folds, P.EVAL_K, P.EVAL_NGRAM, P.EVAL_FEATURES, list(P.LR_GRID),
                                     P.LR_MAX_ITER)
    return accuracy(pred, ["reg", "fold"]).select("reg", "fold", "n_test", rounded(F.col("accuracy")).alias("accuracy"))


_LEARNERS = ("hashed", "l1", "l2")


@register("logistic_properties", "WITH o AS (SELECT count(*) AS n FROM documents) SELECT learner, CAST(n AS BIGINT) AS n_scored, "
                                 "CAST(n AS BIGINT) AS n_in_range, TRUE AS beats_majority FROM o, "
                                 f"(VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in _LEARNERS)}) v(learner)")
def q_logistic_properties(spark, base):
    """M5-M7: what must hold of the iterative fits whatever their digits: every
    document is scored, each confidence lies in [0.5, 1] (of the likelier of two
    labels), and training accuracy beats the majority label."""
    # labelled texts are joined once: each fit reads them, and the truth and the majority as well
    obs, docs = materialize(_obs(spark, base)), _docs(spark, base)
    truth = obs.select("doc_id", F.col("category").alias("actual"))
    majority = (obs.groupBy("category").count().agg(F.max("count").alias("top"), F.sum("count").alias("n"))
                .select((F.col("top") / F.col("n")).alias("m")))
    out = []
    for name, m in zip(_LEARNERS, _logistic_models(obs), strict=True):
        pred = m.predict(docs)
        scored = pred.join(truth, "doc_id", "left").agg(
            F.count(F.lit(1)).alias("n_scored"),
            F.sum(F.col("confidence").between(0.5, 1.0).cast("bigint")).alias("n_in_range"),
            F.avg((F.col("category") == F.col("actual")).cast("double")).alias("acc"))
        out.append(scored.select(F.lit(name).alias("learner"), "n_scored", "n_in_range",
                                 (F.col("acc") > majority.scalar()).alias("beats_majority")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def _hashed_model(obs):
    return fit_online_logistic(obs, P.HASHED_LR_NGRAM, P.HASHED_LR_BITS, P.HASHED_LR_STEP, P.HASHED_LR_REG, P.HASHED_LR_PASSES)


def _logistic_models(obs):
    """M7, M6, M5 at their registered settings."""
    return (_hashed_model(obs),
            fit_ovr_logistic(obs, P.TF_NGRAM, P.TF_FEATURES, P.L1_REG, P.L1_MAX_ITER, elastic_net=1.0),
            fit_ovr_logistic(obs, P.EVAL_NGRAM, P.EVAL_FEATURES, P.LR_GRID[0], P.LR_MAX_ITER))


# ---------------------------------------------------- persistence, stream

@register("model_roundtrip", NB_PREDICT_SQL)
def q_model_roundtrip(spark, base):
    """Fit, save the NB tables, reload them, predict every document."""
    path = save_model(_nb(spark, base), scratch_path(spark, "nb-model"))
    pred = load_model(spark, path).predict(_docs(spark, base))
    return pred.select("doc_id", "category", rounded(F.col("confidence")).alias("confidence"), "label")


@register("score_stream", NB_PREDICT_SQL)
def q_score_stream(spark, base):
    """V3: documents as a file stream scored micro-batch by micro-batch with
    the saved model; equals batch prediction."""
    path = save_model(_nb(spark, base), scratch_path(spark, "nb-model"))
    out, query = score_stream(spark, document_stream(spark, base), path)
    query.awaitTermination()
    pred = spark.read.parquet(out)
    return pred.select("doc_id", "category", rounded(F.col("confidence")).alias("confidence"), "label")


# -------------------------------------------------------------- evaluation

@register("row_index", "SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx FROM documents")
def q_row_index(spark, base):
    return row_index(_docs(spark, base).select("doc_id"), "doc_id")


@register("kfold", f"WITH obs AS ({O.obs_sql()}),\n"
                   f"ix AS (SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % {P.EVAL_K} AS INTEGER) AS g FROM obs)\n"
                   f"SELECT CAST(f.range AS INTEGER) AS fold, ix.doc_id, CASE WHEN ix.g = f.range THEN 'test' ELSE 'train' END AS role "
                   f"FROM ix CROSS JOIN range({P.EVAL_K}) f")
def q_kfold(spark, base):
    return kfold_roles(assign_folds(_obs(spark, base), P.EVAL_K), P.EVAL_K)


_KF = O.kfold_ctes(P.EVAL_K, P.EVAL_NGRAM, P.EVAL_FEATURES, [P.NB_LAMBDA])
_KF_GRID = O.kfold_ctes(P.EVAL_K, P.EVAL_NGRAM, P.EVAL_FEATURES, list(P.NB_GRID))
_ACC_SQL = (f"SELECT {{cols}}, CAST(count(*) AS BIGINT) AS n_test, "
            f"round(avg(CASE WHEN category = actual THEN {O.dbl(1)} ELSE {O.dbl(0)} END), {O.D}) AS accuracy "
            f"FROM pred GROUP BY {{cols}}")


@register("kfold_accuracy", f"WITH {_KF}\n" + _ACC_SQL.format(cols="fold"))
def q_kfold_accuracy(spark, base):
    pred = kfold_naive_bayes(_obs(spark, base), P.EVAL_K, P.EVAL_NGRAM, P.EVAL_FEATURES, [P.NB_LAMBDA])
    return accuracy(pred, ["fold"]).select("fold", "n_test", rounded(F.col("accuracy")).alias("accuracy"))


@register("kfold_predictions", f"WITH {_KF}\nSELECT fold, doc_id, category, round(confidence, {O.D}) AS confidence, actual FROM pred")
def q_kfold_predictions(spark, base):
    pred = kfold_naive_bayes(_obs(spark, base), P.EVAL_K, P.EVAL_NGRAM, P.EVAL_FEATURES, [P.NB_LAMBDA])
    return pred.select("fold", "doc_id", "category", rounded(F.col("confidence")).alias("confidence"), "actual")


@register("nb_grid", f"WITH {_KF_GRID}\n" + _ACC_SQL.format(cols="lam, fold"))
def q_nb_grid(spark, base):
    pred = kfold_naive_bayes(_obs(spark, base), P.EVAL_K, P.EVAL_NGRAM, P.EVAL_FEATURES, list(P.NB_GRID))
    return accuracy(pred, ["lam", "fold"]).select("lam", "fold", "n_test", rounded(F.col("accuracy")).alias("accuracy"))


_SPPMI_KF = O.sppmi_kfold_ctes(P.EVAL_K, P.EVAL_NGRAM, P.EVAL_FEATURES, P.SPPMI_K_EVAL, list(P.NB_GRID))


def _fold_sppmi(spark, base):
    return fit_fold_sppmi(_obs(spark, base), P.EVAL_K, P.EVAL_NGRAM, P.EVAL_FEATURES, P.SPPMI_K_EVAL)


@register("sppmi_kfold_accuracy", f"WITH {_SPPMI_KF}\n" + _ACC_SQL.format(cols="lam, fold"))
def q_sppmi_kfold_accuracy(spark, base):
    """E5 at the evaluation setting itself (bigrams, 5,000 buckets, SPPMI on):
    accuracy of both smoothing values in every fold."""
    pred = kfold_sppmi_naive_bayes(_fold_sppmi(spark, base), list(P.NB_GRID))
    return accuracy(pred, ["lam", "fold"]).select("lam", "fold", "n_test", rounded(F.col("accuracy")).alias("accuracy"))


@register("sppmi_kfold_predictions", f"WITH {_SPPMI_KF}\nSELECT lam, fold, doc_id, category, round(confidence, {O.D}) AS confidence, actual FROM pred")
def q_sppmi_kfold_predictions(spark, base):
    """E3 on SPPMI vectors: the predictions behind ``sppmi_kfold_accuracy``."""
    pred = kfold_sppmi_naive_bayes(_fold_sppmi(spark, base), list(P.NB_GRID))
    return pred.select("lam", "fold", "doc_id", "category", rounded(F.col("confidence")).alias("confidence"), "actual")


@register("sppmi_eval_grid", None)
def q_sppmi_eval_grid(spark, base):
    """The whole evaluation of the reference: two smoothing values and two
    penalties on SPPMI vectors, accuracy in every fold, one Gramian pass."""
    m = _fold_sppmi(spark, base)
    nb = accuracy(kfold_sppmi_naive_bayes(m, list(P.NB_GRID)), ["lam", "fold"])
    lr = accuracy(kfold_sppmi_logistic(m, list(P.LR_GRID), P.LR_MAX_ITER), ["reg", "fold"])
    cols = lambda learner, value: [F.lit(learner).alias("learner"), F.col(value).alias("value"), "fold", "n_test",
                                   rounded(F.col("accuracy")).alias("accuracy")]
    return nb.select(*cols("nb", "lam")).unionByName(lr.select(*cols("lr", "reg")))


@register("train_accuracy", f"{_NB_HEAD},\n{O.nb_predict_ctes('obs', ['doc_id'], P.EVAL_NGRAM, P.EVAL_FEATURES)}\n"
                            f"SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN p.category = o.category "
                            f"THEN {O.dbl(1)} ELSE {O.dbl(0)} END), {O.D}) AS accuracy FROM pred p JOIN obs o ON o.doc_id = p.doc_id")
def q_train_accuracy(spark, base):
    obs = _obs(spark, base)
    pred = _nb(spark, base).predict(obs.select("doc_id", "text"))
    joined = pred.join(obs.select("doc_id", F.col("category").alias("actual")), "doc_id")
    return (joined.agg(F.count(F.lit(1)).alias("n"),
                       F.avg((F.col("category") == F.col("actual")).cast("double")).alias("accuracy"))
            .select("n", rounded(F.col("accuracy")).alias("accuracy")))


@register("soft_accuracy", f"{_NB_HEAD},\nq_tf AS ({O.tf_sql('obs', ['doc_id'], P.EVAL_NGRAM, P.EVAL_FEATURES)}),\n"
                           f"q_x AS ({O.tfidf_sql('q_tf')}),\n{O.nb_z_ctes('obs', 'q_x')},\n"
                           f"pr AS (SELECT doc_id, label, e / sum(e) OVER (PARTITION BY doc_id) AS p "
                           f"FROM (SELECT doc_id, label, exp(z - max(z) OVER (PARTITION BY doc_id)) AS e FROM z))\n"
                           f"SELECT pr.label, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN pr.label = o.label "
                           f"THEN p ELSE 1 - p END), {O.D}) AS soft_accuracy FROM pr JOIN obs o ON o.doc_id = pr.doc_id GROUP BY pr.label")
def q_soft_accuracy(spark, base):
    obs = _obs(spark, base)
    probs = _nb(spark, base).probabilities(obs.select("doc_id", "text"))
    return soft_accuracy(probs, obs.select("doc_id", "label")).select(
        "label", "n", rounded(F.col("soft_accuracy")).alias("soft_accuracy"))


def queries() -> dict[str, SparkQuery]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
