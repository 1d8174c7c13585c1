"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source, a row's fractional
rank is its place in its source divided by the source's size, and sorting by
it interleaves the sources in proportion. Cutting that order into equal runs
gives shards whose row counts differ by one at most (law ``rows``) and which
all hold the mixture of the whole table to within about a row per source.

Both sorts are Spark range sorts (``common.ranked``): the sort keys contain
the hash, so a source with a third of all rows spreads over the partitions
like any other. Only narrow columns take part; ``shard`` shuffles the text once.

Defined cases: null sources form one source of their own; null texts have
size 1 and CRC 0; rows that repeat an id are placed separately; rows equal in
every used column are interchangeable; an empty table gives no rows;
further columns, whatever their names, are kept by ``shard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm.common import attach_rows, crc, ranked, read, row_key, save, shuffled, utf8_bytes

N_SHARDS, SEED = 8, "shards-1"


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, seed: str = SEED, doc_id: str = "doc_id",
                  text: str = "text", source: str = "source", keyed: bool = False) -> DataFrame:
    """One narrow row per row of ``docs``: doc_id, size, text_crc32, shard,
    slot (place within the shard) and, if ``keyed``, ``_k`` (``row_key``)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("_src"),
                       (utf8_bytes(F.col(text)) + 1).alias("size"), crc(F.col(text)).alias("text_crc32"),
                       shuffled(seed, F.col(doc_id)).alias("_h"),
                       *([row_key(F.col(doc_id), F.col(text)).alias("_k")] if keyed else []))
    rows = save(rows, "sized")  # the range sort samples its input: narrow rows are read twice, texts once
    tie = [F.col("_src").asc_nulls_last(), F.col("_h"), F.col("text_crc32"), F.col("size")]
    inside = ranked(rows, tie, name="by-source").withColumnRenamed("_rank", "_at")
    sources = inside.groupBy(F.col("_src").alias("_of")).agg(F.min("_at").alias("_first"),
                                                             F.count(F.lit(1)).alias("_n"))
    mixed = (inside.join(sources, F.col("_src").eqNullSafe(F.col("_of")))
             .withColumn("_frac", (F.col("_at") - F.col("_first") + F.lit(0.5)) / F.col("_n"))
             .drop("_at", "_of", "_first", "_n"))
    order = ranked(mixed, [F.col("_frac"), *tie], name="interleaved")
    total = sources.agg(F.sum("_n")).first()[0] or 1
    shard = F.expr(f"((_rank + 1) * {n_shards}L - 1) div {total}L")
    return (order.withColumn("shard", shard.cast("int"))
            .withColumn("slot", F.col("_rank") - F.expr(f"(shard * {total}L) div {n_shards}L"))
            .drop("_src", "_h", "_frac", "_rank"))


def shard(docs: DataFrame, n_shards: int = N_SHARDS, seed: str = SEED, doc_id: str = "doc_id", text: str = "text",
          source: str = "source") -> DataFrame:
    """``docs`` with the columns ``shard`` and ``slot`` (replacing such columns)."""
    docs = docs.drop("shard", "slot")
    placed = save(assign_shards(docs, n_shards, seed, doc_id, text, source, keyed=True).select("_k", "shard", "slot"),
                  "placed")
    return attach_rows(docs, placed, ["shard", "slot"], doc_id, text)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``rows``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return assign_shards(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                      F.lit(None).cast("int").alias("grown_shard"))


OP1_SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i::BIGINT, [1::BIGINT,2,3,4,5,6,7,8]),
              lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), sized AS (
  SELECT doc_id, source, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT,
             [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents, crc_table
), placed AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, text_crc32, size) - 0.5::DOUBLE)
            / count(*) OVER (PARTITION BY source) AS frac
  FROM sized
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY frac, source NULLS LAST, h, text_crc32, size) - 1 AS rank,
         count(*) OVER () AS n
  FROM placed
), cut AS (
  SELECT *, ((rank + 1) * {N_SHARDS} - 1) // n AS shard FROM ordered
)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard,
       (rank - (shard * n) // {N_SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""
