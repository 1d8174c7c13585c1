"""Mixing sources to target weights by weighted fair queueing.

Every shuffled document (and every repeat of it, up to ``max_epochs``) gets a
virtual finish time: the words its source has sent so far, this document
included, divided by the source's weight. Sorting all of them by finish time
is the order in which a fair queue would send them; the mix is the part of
that order that fits the total budget. A source that has sent all its epochs
leaves the queue and the others share what it leaves by weight.

``targets`` gives the same shares in closed form: budget times weight share,
held at ``max_epochs`` times the source's size, the excess shared anew by
weight until none is above; each round is one small aggregate.

Both orders are Spark range sorts with running sums (``common.ranked``) over
narrow rows; a source with a third of the rows spreads like any other.

Defined cases: null sources are one source, the last; null texts have size 0;
documents of size 0 are never counted as taken (``taken`` 0; ``mix`` drops
them); rows that repeat an id are queued separately; an empty table gives no
rows; all sizes 0 give targets 0; further columns, whatever their names,
are kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.common import WORD, attach_rows, crc, fresh, ranked, read, row_key, save, shuffled

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, "mix-1"


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
            budget: int | None = None) -> tuple[DataFrame, int]:
    """``sources`` (``_src``, ``source_size``) with ``_place`` (0-based in
    code point order, null last), ``_w`` and ``target``; and the budget."""
    placed = ranked(sources, [F.col("_src").asc_nulls_last()], name="sources").withColumnRenamed("_rank", "_place")
    at = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("_w", at).withColumn("_cap", F.col("source_size") * max_epochs)
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    budget = total if budget is None else min(budget, total * max_epochs)
    level, held = 0.0, -1
    while True:  # the level only rises; every round holds at least one more source
        above = F.col("_cap") < F.lit(level) * F.col("_w")
        r = placed.agg(F.sum(F.when(above, F.col("_cap"))).alias("cap"), F.count(F.when(above, 1)).alias("n"),
                       F.sum(F.when(~above, F.col("_w"))).alias("w")).first()
        if r["n"] == held or not r["w"]:
            break
        held, level = r["n"], (budget - (r["cap"] or 0)) / r["w"]
    share = F.lit(level) * F.col("_w")
    return placed.withColumn("target", F.when(F.col("_cap") < share, F.col("_cap").cast("double")).otherwise(share)), budget


def taken(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: int | None = None,
          seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          keyed: bool = False) -> DataFrame:
    """One narrow row per row of ``docs``: doc_id, size, source_size, target,
    copies (how often the mix sends it), taken (size times copies) and, if
    ``keyed``, ``_k`` (``row_key``)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("_src"),
                       n_words(F.col(text)).alias("size"), crc(F.col(text)).alias("_crc"),
                       shuffled(seed, F.col(doc_id)).alias("_h"),
                       *([row_key(F.col(doc_id), F.col(text)).alias("_k")] if keyed else []))
    rows = save(rows, "sized")  # the range sort samples its input: narrow rows are read twice, texts once
    queued = ranked(rows, [F.col("_src").asc_nulls_last(), F.col("_h"), F.col("_crc"), F.col("size")],
                    sums=["size"], name="queues")
    sources = save(queued.groupBy("_src").agg(F.sum("size").alias("source_size"),
                                              F.min(F.col("_cum_size") - F.col("size")).alias("_base")), "totals")
    goal, budget = targets(sources, weights, max_epochs, budget)
    goal = goal.select(F.col("_src").alias("_of"), "source_size", "target", "_base", "_w", "_place")
    sent = F.col("_epoch") * F.col("source_size") + F.col("_cum_size") - F.col("_base")
    copies = (queued.join(goal, F.col("_src").eqNullSafe(F.col("_of")))
              .withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
              .withColumn("_finish", sent / F.col("_w"))
              .select("doc_id", "size", "source_size", "target", "_place", "_rank", "_epoch", "_finish",
                      *(["_k"] if keyed else [])).withColumnRenamed("_rank", "_row"))
    order = ranked(copies, [F.col("_finish"), F.col("_place"), F.col("_row"), F.col("_epoch")], sums=["size"],
                   name="fair-order")
    inside = (F.col("_cum_size") <= budget) & (F.col("size") > 0)
    keys = ["_row", "doc_id", "size", "source_size", "target", *(["_k"] if keyed else [])]
    return (order.groupBy(*keys).agg(F.sum(inside.cast("long")).alias("copies"))
            .withColumn("taken", F.col("size") * F.col("copies")).drop("_row"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, budget: int | None = None,
        seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    found = taken(docs, weights, max_epochs, budget, seed, doc_id, text, source, keyed=True)
    n = fresh(docs, "copies")
    found = save(found.select("_k", F.col("copies").alias(n)), "copies")
    got = attach_rows(docs, found, [n], doc_id, text).where(F.col(n) > 0)
    return got.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).drop(n)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: sources weigh 5, 2, 1 in turn,
    up to 3 epochs, the budget is the size of the whole table."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return taken(docs).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), levels AS (
  SELECT *, {MAX_EPOCHS} * source_size AS cap, sum(source_size) OVER () AS budget,
         coalesce(sum({MAX_EPOCHS} * source_size) OVER below, 0) AS cap_below,
         sum(w) OVER () - coalesce(sum(w) OVER below, 0) AS w_rest
  FROM src
  WINDOW below AS (ORDER BY {MAX_EPOCHS} * source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lvl AS (
  SELECT arg_min((budget - cap_below)::DOUBLE / w_rest, cap / w)
         FILTER (cap >= (budget - cap_below)::DOUBLE / w_rest * w) AS lam
  FROM levels
), goal AS (
  SELECT source, source_size, w, place, budget,
         CASE WHEN cap < lam * w THEN cap::DOUBLE ELSE lam * w END AS target
  FROM levels, lvl
), queued AS (
  SELECT s.*, g.source_size, g.w, g.place, g.target, g.budget,
         sum(size) OVER (PARTITION BY s.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS cum
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
), copies AS (
  SELECT *, (e * source_size + cum)::DOUBLE / w AS finish FROM queued, range({MAX_EPOCHS}) r(e)
), sent AS (
  SELECT *, sum(size) OVER (ORDER BY finish, place, h, e ROWS UNBOUNDED PRECEDING) AS total FROM copies
)
SELECT doc_id, size, source_size, target,
       (size * count(*) FILTER (total <= budget))::BIGINT AS taken
FROM sent GROUP BY doc_id, h, size, source_size, target
"""
