"""Helpers shared by the training-data operators.

* ``save`` writes a table once to the shared checkpoint folder and reads it
  back: lineage is cut and a lost executor never re-runs what is upstream.
* ``ranked`` gives every row its exact global position (and running sums) in
  a total order with Spark's range partitioning: no single-task window.
* ``row_key`` / ``attach_rows`` bring per-row results computed on narrow
  tables back to the full rows with one shuffle of the text, also when ids
  are null or rows are repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textlens.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes; a null text counts as no bytes (0)."""
    return F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")


def shuffled(seed: str, key: Column) -> Column:
    """A pseudo-random, reproducible sort key of a row."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))


def row_key(doc_id: Column, text: Column) -> Column:
    """Never null; equal for rows that repeat the same id and text only."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"),
                    F.md5(F.coalesce(text, F.lit(""))), F.when(text.isNull(), F.lit("-")).otherwise(F.lit("")))


def ranked(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = (), name: str = "ranked") -> DataFrame:
    """Add ``_rank`` (0-based position of the row in the order, over the whole
    table) and, for each column of ``sums``, ``_cum_<col>`` (running total,
    the row included). The rows are range-partitioned and sorted once and
    written; only one count (and sum) per partition is gathered."""
    parts = partitions(df)
    rows = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .withColumn("_mid", F.monotonically_increasing_id()))
    if sums:
        schema = T.StructType(rows.schema.fields + [T.StructField(f"_cum_{c}", T.LongType()) for c in sums])
        cols = list(sums)

        def running(batches):
            before = dict.fromkeys(cols, 0)
            for b in batches:
                arrays = list(b.columns)
                for c in cols:
                    v = b.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    run = np.cumsum(v) + before[c]
                    before[c] = int(run[-1]) if len(run) else before[c]
                    arrays.append(pa.array(run))
                yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names, *(f"_cum_{c}" for c in cols)])

        rows = rows.mapInArrow(running, schema)
    rows = save(rows, name).withColumn("_pid", F.shiftright("_mid", 33))
    totals = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"),
                                      *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_t_{c}") for c in sums])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("_pid", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(f"_o{c}")
                                      for c in totals.columns if c != "_pid"])
    out = rows.join(F.broadcast(offsets), "_pid")  # at most `parts` rows of a few numbers
    out = out.withColumn("_rank", F.col("_o_n") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    for c in sums:
        out = out.withColumn(f"_cum_{c}", F.col(f"_cum_{c}") + F.col(f"_o_t_{c}"))
    return out.drop("_pid", "_mid", *offsets.columns)


def attach_rows(docs: DataFrame, narrow: DataFrame, cols: Sequence[str], doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """``docs`` with ``cols`` of ``narrow``, a table with one row for each row
    of ``docs`` and the column ``_k`` (``row_key``). Repeated rows take the
    results of their key in turn. The text is shuffled once, by the key."""
    each = narrow.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("_all"))
    got = in_turn(docs, doc_id, text).join(each, "_k").withColumn("_mine", F.element_at("_all", F.col("_turn")))
    return got.select("_row.*", *[F.col("_mine")[c].alias(c) for c in cols])


def in_turn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_row`` (a row of ``docs``), its ``_k`` and ``_turn``: 1 for the first
    row of the key, 2 for its first repeat, and so on."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), row_key(F.col(doc_id), F.col(text)).alias("_k"))
    return rows.withColumn("_turn", F.row_number().over(Window.partitionBy("_k").orderBy("_k")))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column has it."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name
