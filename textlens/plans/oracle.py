"""SQL twins of the registered queries, for DuckDB over the same parquet
tables (views ``documents labels events conversations`` ...).

Each builder returns a full statement. The shared pieces (tokenising,
hashing, IDF, Naive Bayes) are written once as CTE templates so every query
states the same semantics as its Spark plan, independently of it.
"""

from __future__ import annotations

import re

from textlens.plans import params as P

D = P.DIGITS


def inline_ctes(sql: str) -> str:
    """Mark every CTE ``NOT MATERIALIZED``: DuckDB materialises CTEs used twice,
    which runs the list/unnest pipelines far slower than recomputing them."""
    return re.sub(r"(\w+) AS (?:NOT MATERIALIZED )?\((SELECT|WITH)\b", r"\1 AS NOT MATERIALIZED (\2", sql)


def dbl(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def obs_sql(label_col: str = P.LABEL_COL) -> str:
    """S3 observations."""
    raw = f"CAST(l.{label_col} AS VARCHAR)"
    return (f"SELECT d.doc_id, CASE WHEN {raw} = '1' THEN {dbl(1)} ELSE {dbl(0)} END AS label, "
            f"d.text, {raw} AS category FROM documents d JOIN labels l ON d.doc_id = l.doc_id")


def tokens_sql(text: str = "text") -> str:
    """T1 tokens as a list expression."""
    return (f"(CASE WHEN {text} = '' THEN [''] WHEN rtrim({text}, ' ') = '' THEN []::VARCHAR[] "
            f"ELSE string_split(rtrim({text}, ' '), ' ') END)")


def grams_sql(w: str, n: int) -> str:
    """T2 n-gram list expression over a token list ``w``."""
    if n == 1:
        return w
    window = " || ".join(f"{w}[i + {k}]" for k in range(n))
    return (f"(CASE WHEN len({w}) = 0 THEN []::VARCHAR[] "
            f"WHEN len({w}) < {n} THEN [array_to_string({w}, '')] "
            f"ELSE list_transform(range(1, len({w}) - {n} + 2), lambda i: {window}) END)")


def bucket_sql(g: str, v: int) -> str:
    return f"(('0x' || substr(md5({g}), 1, 8))::BIGINT % {v})"


def tf_sql(src: str, ids: list[str], n: int, v: int, carry: list[str] = (), text: str = "text") -> str:
    """T3 long TF ``(ids..., carry..., bucket, tf)`` from a relation ``src``."""
    cols = ", ".join(list(ids) + list(carry))
    return (f"SELECT {cols}, bucket, CAST(count(*) AS BIGINT) AS tf FROM ("
            f"SELECT {cols}, {bucket_sql('gram', v)} AS bucket FROM ("
            f"SELECT {cols}, unnest({grams_sql(tokens_sql(text), n)}) AS gram FROM {src})) "
            f"GROUP BY {cols}, bucket")


def idf_ctes(tf: str, docs: str, prefix: str = "") -> str:
    """``{prefix}m (m)`` and ``{prefix}idf (bucket, df, idf)``."""
    return (f"{prefix}m AS (SELECT CAST(count(*) AS BIGINT) AS m FROM {docs}),\n"
            f"{prefix}idf AS (SELECT t.bucket, CAST(count(*) AS BIGINT) AS df, "
            f"ln({dbl('mm.m + 1')} / {dbl('count(*) + 1')}) AS idf "
            f"FROM {tf} t CROSS JOIN {prefix}m mm GROUP BY t.bucket, mm.m)")


def tfidf_sql(tf: str, prefix: str = "", ids: list[str] = ("doc_id",), carry: list[str] = ()) -> str:
    """F2 over a TF relation with the IDF of ``{prefix}``; unseen -> ln(m+1)."""
    cols = ", ".join(f"t.{c}" for c in list(ids) + list(carry))
    return (f"SELECT {cols}, t.bucket, t.tf, t.tf * coalesce(i.idf, ln({dbl('mm.m + 1')})) AS x "
            f"FROM {tf} t LEFT JOIN {prefix}idf i ON t.bucket = i.bucket CROSS JOIN {prefix}m mm")


def nb_ctes(points: str, docs: str, lam: float, v: int, prefix: str = "") -> str:
    """M1 + F12: ``{prefix}classes (label, n, pi, s_c, dflt)``,
    ``{prefix}theta (label, bucket, s, theta)``, ``{prefix}catmap (label, category)``."""
    lam_s = dbl(lam)
    return (
        f"{prefix}counts AS (SELECT label, CAST(count(*) AS BIGINT) AS n FROM {docs} GROUP BY label),\n"
        f"{prefix}sums AS (SELECT label, bucket, sum(x) AS s FROM {points} GROUP BY label, bucket),\n"
        f"{prefix}mass AS (SELECT label, sum(s) AS s_c FROM {prefix}sums GROUP BY label),\n"
        f"{prefix}classes AS (SELECT c.label, c.n, "
        f"ln(c.n + {lam_s}) - ln(sum(c.n) OVER () + count(*) OVER () * {lam_s}) AS pi, "
        f"coalesce(ms.s_c, {dbl(0)}) AS s_c, "
        f"ln({lam_s}) - ln(coalesce(ms.s_c, {dbl(0)}) + {dbl(v)} * {lam_s}) AS dflt "
        f"FROM {prefix}counts c LEFT JOIN {prefix}mass ms ON c.label = ms.label),\n"
        f"{prefix}theta AS (SELECT s.label, s.bucket, s.s, ln(s.s + {lam_s}) - ln(cl.s_c + {dbl(v)} * {lam_s}) AS theta "
        f"FROM {prefix}sums s JOIN {prefix}classes cl ON s.label = cl.label),\n"
        f"{prefix}catmap AS (SELECT label, arg_max(category, doc_id) AS category FROM {docs} GROUP BY label)")


def nb_z_ctes(qdocs: str, qx: str, prefix: str = "", ids: list[str] = ("doc_id",)) -> str:
    """M2 raw scores ``{prefix}z (ids..., label, z)`` for every query document
    and class; unseen buckets use the class default theta."""
    on = " AND ".join(f"x.{c} = d.{c}" for c in ids)
    idc = ", ".join(f"d.{c}" for c in ids)
    return (f"{prefix}z AS (SELECT {idc}, cl.label, cl.pi + coalesce(sum(x.x * coalesce(th.theta, cl.dflt)), {dbl(0)}) AS z "
            f"FROM {qdocs} d CROSS JOIN {prefix}classes cl LEFT JOIN {qx} x ON {on} "
            f"LEFT JOIN {prefix}theta th ON th.label = cl.label AND th.bucket = x.bucket "
            f"GROUP BY {idc}, cl.label, cl.pi)")


def softmax_best_ctes(z: str, out: str, prefix: str = "", ids: list[str] = ("doc_id",)) -> str:
    """M3: ``{out} (ids..., label, confidence, category)``; ties to the lower label."""
    idc = ", ".join(ids)
    return (f"{out}_r AS (SELECT {idc}, label, z, max(z) OVER (PARTITION BY {idc}) AS zmax, "
            f"row_number() OVER (PARTITION BY {idc} ORDER BY z DESC, label) AS rn FROM {z}),\n"
            f"{out}_b AS (SELECT {idc}, max(CASE WHEN rn = 1 THEN label END) AS label, "
            f"1 / sum(exp(z - zmax)) AS confidence, max(zmax) - max(z) FILTER (rn = 2) "
            f"- ln(sum(exp(z - z2)) FILTER (rn > 1)) AS margin FROM "
            f"(SELECT *, max(CASE WHEN rn = 2 THEN z END) OVER (PARTITION BY {idc}) AS z2 FROM {out}_r) GROUP BY {idc}),\n"
            f"{out} AS (SELECT b.*, coalesce(cm.category, '') AS category FROM {out}_b b "
            f"LEFT JOIN {prefix}catmap cm ON b.label = cm.label)")


def nb_model_ctes(n: int, v: int, lam: float, label_col: str = P.LABEL_COL, prefix: str = "") -> str:
    """Observations -> TF -> IDF -> TF-IDF -> NB tables, all under ``prefix``."""
    return (f"{prefix}obs AS NOT MATERIALIZED ({obs_sql(label_col)}),\n"
            f"{prefix}tf AS NOT MATERIALIZED ({tf_sql(prefix + 'obs', ['doc_id'], n, v, carry=['label'])}),\n"
            f"{idf_ctes(prefix + 'tf', prefix + 'obs', prefix)},\n"
            f"{prefix}pts AS NOT MATERIALIZED ({tfidf_sql(prefix + 'tf', prefix, carry=['label'])}),\n"
            f"{nb_ctes(prefix + 'pts', prefix + 'obs', lam, v, prefix)}")


def nb_predict_ctes(qsrc: str, ids: list[str], n: int, v: int, prefix: str = "", out: str = "pred") -> str:
    """Score relation ``qsrc (ids..., text)`` with the model under ``prefix``."""
    return (f"{out}_tf AS ({tf_sql(qsrc, ids, n, v)}),\n"
            f"{out}_x AS ({tfidf_sql(out + '_tf', prefix, ids=ids)}),\n"
            f"{nb_z_ctes(qsrc, out + '_x', prefix, ids)},\n"
            f"{softmax_best_ctes(prefix + 'z', out, prefix, ids)}")


def kfold_ctes(k: int, n: int, v: int, lams: list[float], label_col: str = P.LABEL_COL) -> str:
    """Brute-force k-fold Naive Bayes: every (lam, fold) model fitted on its
    own training rows. Ends in ``pred (lam, fold, doc_id, label, category,
    confidence, actual)``."""
    lam_rows = ", ".join(f"({dbl(l)})" for l in lams)
    return f"""obs AS ({obs_sql(label_col)}),
ix AS (SELECT doc_id, label, category, CAST((row_number() OVER (ORDER BY doc_id) - 1) % {k} AS INTEGER) AS g FROM obs),
models AS (SELECT l.lam, CAST(f.fold AS INTEGER) AS fold FROM (VALUES {lam_rows}) l(lam) CROSS JOIN (SELECT range AS fold FROM range({k})) f),
tf AS ({tf_sql('obs', ['doc_id'], n, v, carry=['label'])}),
tr AS (SELECT md.lam, md.fold, ix.doc_id, ix.label, ix.category FROM models md JOIN ix ON ix.g <> md.fold),
mm AS (SELECT lam, fold, count(*) AS m FROM tr GROUP BY lam, fold),
trtf AS (SELECT tr.lam, tr.fold, t.doc_id, t.label, t.bucket, t.tf FROM tr JOIN tf t ON t.doc_id = tr.doc_id),
idf AS (SELECT t.lam, t.fold, t.bucket, ln({dbl('mm.m + 1')} / {dbl('count(*) + 1')}) AS idf
        FROM trtf t JOIN mm ON mm.lam = t.lam AND mm.fold = t.fold GROUP BY t.lam, t.fold, t.bucket, mm.m),
pts AS (SELECT t.lam, t.fold, t.doc_id, t.label, t.bucket, t.tf * i.idf AS x
        FROM trtf t JOIN idf i ON i.lam = t.lam AND i.fold = t.fold AND i.bucket = t.bucket),
counts AS (SELECT lam, fold, label, count(*) AS n FROM tr GROUP BY lam, fold, label),
sums AS (SELECT lam, fold, label, bucket, sum(x) AS s FROM pts GROUP BY lam, fold, label, bucket),
mass AS (SELECT lam, fold, label, sum(s) AS s_c FROM sums GROUP BY lam, fold, label),
classes AS (SELECT c.lam, c.fold, c.label,
            ln(c.n + c.lam) - ln(sum(c.n) OVER (PARTITION BY c.lam, c.fold) + count(*) OVER (PARTITION BY c.lam, c.fold) * c.lam) AS pi,
            coalesce(ms.s_c, {dbl(0)}) AS s_c,
            ln(c.lam) - ln(coalesce(ms.s_c, {dbl(0)}) + {dbl(v)} * c.lam) AS dflt
            FROM counts c LEFT JOIN mass ms ON ms.lam = c.lam AND ms.fold = c.fold AND ms.label = c.label),
theta AS (SELECT s.lam, s.fold, s.label, s.bucket, ln(s.s + s.lam) - ln(cl.s_c + {dbl(v)} * s.lam) AS theta
          FROM sums s JOIN classes cl ON cl.lam = s.lam AND cl.fold = s.fold AND cl.label = s.label),
catmap AS (SELECT lam, fold, label, arg_max(category, doc_id) AS category FROM tr GROUP BY lam, fold, label),
te AS (SELECT md.lam, md.fold, ix.doc_id, ix.category AS actual FROM models md JOIN ix ON ix.g = md.fold),
tex AS (SELECT te.lam, te.fold, t.doc_id, t.bucket, t.tf * coalesce(i.idf, ln({dbl('mm.m + 1')})) AS x
        FROM te JOIN tf t ON t.doc_id = te.doc_id JOIN mm ON mm.lam = te.lam AND mm.fold = te.fold
        LEFT JOIN idf i ON i.lam = te.lam AND i.fold = te.fold AND i.bucket = t.bucket),
z AS (SELECT te.lam, te.fold, te.doc_id, cl.label, cl.pi + coalesce(sum(x.x * coalesce(th.theta, cl.dflt)), {dbl(0)}) AS z
      FROM te JOIN classes cl ON cl.lam = te.lam AND cl.fold = te.fold
      LEFT JOIN tex x ON x.lam = te.lam AND x.fold = te.fold AND x.doc_id = te.doc_id
      LEFT JOIN theta th ON th.lam = te.lam AND th.fold = te.fold AND th.label = cl.label AND th.bucket = x.bucket
      GROUP BY te.lam, te.fold, te.doc_id, cl.label, cl.pi),
zr AS (SELECT *, max(z) OVER (PARTITION BY lam, fold, doc_id) AS zmax,
       row_number() OVER (PARTITION BY lam, fold, doc_id ORDER BY z DESC, label) AS rn FROM z),
zb AS (SELECT lam, fold, doc_id, max(CASE WHEN rn = 1 THEN label END) AS label, 1 / sum(exp(z - zmax)) AS confidence
       FROM zr GROUP BY lam, fold, doc_id),
pred AS (SELECT zb.*, coalesce(cm.category, '') AS category, te.actual FROM zb
         JOIN te ON te.lam = zb.lam AND te.fold = zb.fold AND te.doc_id = zb.doc_id
         LEFT JOIN catmap cm ON cm.lam = zb.lam AND cm.fold = zb.fold AND cm.label = zb.label)"""


def log_odds_ctes(v: int, prefix: str = "", out: str = "lin") -> str:
    """Dense binary weights from the NB model under ``prefix``:
    ``{out}_w (label, bucket, w)`` and ``{out}_b (label, intercept)``."""
    c1 = f"(SELECT dflt, pi FROM {prefix}classes WHERE label = 1)"
    c0 = f"(SELECT dflt, pi FROM {prefix}classes WHERE label = 0)"
    return (f"{out}_w1 AS (SELECT b.range AS bucket, coalesce(t1.theta, c1.dflt) - coalesce(t0.theta, c0.dflt) AS w "
            f"FROM range({v}) b CROSS JOIN {c1} c1 CROSS JOIN {c0} c0 "
            f"LEFT JOIN {prefix}theta t1 ON t1.label = 1 AND t1.bucket = b.range "
            f"LEFT JOIN {prefix}theta t0 ON t0.label = 0 AND t0.bucket = b.range),\n"
            f"{out}_w AS (SELECT {dbl(1)} AS label, bucket, w FROM {out}_w1 UNION ALL "
            f"SELECT {dbl(0)} AS label, bucket, -w AS w FROM {out}_w1),\n"
            f"{out}_b AS (SELECT {dbl(1)} AS label, c1.pi - c0.pi AS intercept FROM {c1} c1 CROSS JOIN {c0} c0 "
            f"UNION ALL SELECT {dbl(0)} AS label, c0.pi - c1.pi AS intercept FROM {c1} c1 CROSS JOIN {c0} c0)")


def linear_z_ctes(qdocs: str, qx: str, out: str = "lin", ids: list[str] = ("doc_id",)) -> str:
    """``{out}_z (ids..., label, z)`` = intercept + w . x for every class."""
    on = " AND ".join(f"x.{c} = d.{c}" for c in ids)
    idc = ", ".join(f"d.{c}" for c in ids)
    return (f"{out}_z AS (SELECT {idc}, b.label, b.intercept + coalesce(sum(x.x * w.w), {dbl(0)}) AS z "
            f"FROM {qdocs} d CROSS JOIN {out}_b b LEFT JOIN {qx} x ON {on} "
            f"LEFT JOIN {out}_w w ON w.label = b.label AND w.bucket = x.bucket "
            f"GROUP BY {idc}, b.label, b.intercept)")


def sigmoid_best_ctes(z: str, out: str, catmap: str, ids: list[str] = ("doc_id",)) -> str:
    """M4: arg-max of the margins with ties to the lower label, sigmoid as confidence."""
    idc = ", ".join(ids)
    return (f"{out}_p AS (SELECT {idc}, label, z AS margin, 1 / (1 + exp(-z)) AS p, "
            f"row_number() OVER (PARTITION BY {idc} ORDER BY z DESC, label) AS rn FROM {z}),\n"
            f"{out} AS (SELECT p.{idc.replace(', ', ', p.')}, p.label, p.margin, p.p AS confidence, coalesce(cm.category, '') AS category "
            f"FROM {out}_p p LEFT JOIN {catmap} cm ON cm.label = p.label WHERE p.rn = 1)")


def sppmi_ctes(k: float, n: int = P.SPPMI_NGRAM, v: int = P.SPPMI_FEATURES, label_col: str = P.LABEL_COL) -> str:
    """Presence, co-occurrence by self-join, SPPMI and mirrored rows:
    ``pres (doc_id, bucket)``, ``co (i, j, c)``, ``sp (i, j, s)``, ``srows (i, j, s)``."""
    return f"""obs AS ({obs_sql(label_col)}),
tf AS ({tf_sql('obs', ['doc_id'], n, v)}),
pres AS (SELECT doc_id, bucket FROM tf),
nn AS (SELECT CAST(count(*) AS BIGINT) AS n FROM obs),
co AS (SELECT a.bucket AS i, b.bucket AS j, CAST(count(*) AS BIGINT) AS c FROM pres a JOIN pres b
       ON a.doc_id = b.doc_id AND a.bucket <= b.bucket GROUP BY a.bucket, b.bucket),
dg AS (SELECT i, c FROM co WHERE i = j),
sp AS (SELECT co.i, co.j, log2({dbl('co.c * nn.n')} / {dbl('di.c * dj.c')}) - log2({dbl(k)}) AS s
       FROM co JOIN dg di ON di.i = co.i JOIN dg dj ON dj.i = co.j CROSS JOIN nn
       WHERE {dbl('co.c * nn.n')} > {dbl(k)} * di.c * dj.c),
srows AS (SELECT i, j, s FROM sp UNION ALL SELECT j AS i, i AS j, s FROM sp WHERE i <> j),
dsum AS (SELECT p.doc_id, r.j, sum(r.s) AS x FROM pres p JOIN srows r ON r.i = p.bucket GROUP BY p.doc_id, r.j)"""


def sppmi_kfold_ctes(k: int, n: int, v: int, shift: float, lams: list[float], label_col: str = P.LABEL_COL) -> str:
    """Brute-force k-fold Naive Bayes on SPPMI vectors: each training fold counts
    its own pairs and builds its own table; test texts are summed from their
    own buckets. Ends in ``pred`` like ``kfold_ctes``."""
    lam_rows = ", ".join(f"({dbl(l)})" for l in lams)
    return f"""obs AS ({obs_sql(label_col)}),
ix AS (SELECT doc_id, label, category, CAST((row_number() OVER (ORDER BY doc_id) - 1) % {k} AS INTEGER) AS g FROM obs),
folds AS (SELECT CAST(range AS INTEGER) AS fold FROM range({k})),
tf AS ({tf_sql('obs', ['doc_id'], n, v)}),
pres AS MATERIALIZED (SELECT doc_id, bucket FROM tf),
tr AS (SELECT f.fold, ix.doc_id, ix.label, ix.category FROM folds f JOIN ix ON ix.g <> f.fold),
te AS (SELECT g AS fold, doc_id, category AS actual FROM ix),
nn AS (SELECT fold, CAST(count(*) AS BIGINT) AS n FROM tr GROUP BY fold),
co AS MATERIALIZED (SELECT tr.fold, a.bucket AS i, b.bucket AS j, CAST(count(*) AS BIGINT) AS c FROM tr JOIN pres a ON a.doc_id = tr.doc_id
       JOIN pres b ON b.doc_id = a.doc_id AND a.bucket <= b.bucket GROUP BY tr.fold, a.bucket, b.bucket),
dg AS MATERIALIZED (SELECT fold, i, c FROM co WHERE i = j),
sp AS MATERIALIZED (SELECT co.fold, co.i, co.j, log2({dbl('co.c * nn.n')} / {dbl('di.c * dj.c')}) - log2({dbl(shift)}) AS s
       FROM co JOIN dg di ON di.fold = co.fold AND di.i = co.i JOIN dg dj ON dj.fold = co.fold AND dj.i = co.j
       JOIN nn ON nn.fold = co.fold WHERE {dbl('co.c * nn.n')} > {dbl(shift)} * di.c * dj.c),
srows AS (SELECT fold, i, j, s FROM sp UNION ALL SELECT fold, j AS i, i AS j, s FROM sp WHERE i <> j),
vec AS MATERIALIZED (SELECT r.fold, p.doc_id, r.j AS bucket, sum(r.s) AS x FROM pres p JOIN srows r ON r.i = p.bucket GROUP BY r.fold, p.doc_id, r.j),
lams AS (SELECT lam FROM (VALUES {lam_rows}) l(lam)),
counts AS (SELECT fold, label, count(*) AS n, arg_max(category, doc_id) AS category FROM tr GROUP BY fold, label),
sums AS MATERIALIZED (SELECT tr.fold, tr.label, vec.bucket, sum(vec.x) AS s FROM tr JOIN vec ON vec.fold = tr.fold AND vec.doc_id = tr.doc_id
         GROUP BY tr.fold, tr.label, vec.bucket),
mass AS (SELECT fold, label, sum(s) AS s_c FROM sums GROUP BY fold, label),
classes AS MATERIALIZED (SELECT lam, c.fold, c.label, c.category,
            ln(c.n + lam) - ln(sum(c.n) OVER (PARTITION BY lam, c.fold) + count(*) OVER (PARTITION BY lam, c.fold) * lam) AS pi,
            ln(coalesce(ms.s_c, {dbl(0)}) + {dbl(v)} * lam) AS norm
            FROM counts c CROSS JOIN lams LEFT JOIN mass ms ON ms.fold = c.fold AND ms.label = c.label),
z AS (SELECT cl.lam, te.fold, te.doc_id, cl.label, cl.category, te.actual,
             cl.pi + coalesce(sum(vec.x * (ln(coalesce(s.s, {dbl(0)}) + cl.lam) - cl.norm)), {dbl(0)}) AS z
      FROM te JOIN classes cl ON cl.fold = te.fold
      LEFT JOIN vec ON vec.fold = te.fold AND vec.doc_id = te.doc_id
      LEFT JOIN sums s ON s.fold = te.fold AND s.label = cl.label AND s.bucket = vec.bucket
      GROUP BY cl.lam, te.fold, te.doc_id, cl.label, cl.category, te.actual, cl.pi),
zr AS (SELECT *, max(z) OVER (PARTITION BY lam, fold, doc_id) AS zmax,
       row_number() OVER (PARTITION BY lam, fold, doc_id ORDER BY z DESC, label) AS rn FROM z),
pred AS (SELECT lam, fold, doc_id, actual, max(CASE WHEN rn = 1 THEN category END) AS category, 1 / sum(exp(z - zmax)) AS confidence
         FROM zr GROUP BY lam, fold, doc_id, actual)"""
