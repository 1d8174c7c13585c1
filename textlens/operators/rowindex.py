"""Distributed row index (E1): ``idx`` = 0-based rank of the key.

Spark's range partitioning cuts the keys into as many ranges as asked for
(it samples, the driver sees only the cut points), rows are sorted within
their range and numbered there; one count per range gives the offsets. The
numbered rows are written once, so both readers see the same ranges. Any
sortable key works: numbers, strings, several columns, nulls (first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlens.operators.util import materialize


def row_index(df: DataFrame, key: str | list[str] = "doc_id", out_col: str = "idx", n_ranges: int | None = None,
              tie_breakers: list[str] = ()) -> DataFrame:
    """Add ``out_col`` (bigint): rank of ``key`` (then ``tie_breakers``) from 0.

    ``n_ranges`` defaults to the session's shuffle partitions; each range has
    about ``rows / n_ranges`` rows whatever the size of the table. Rows that tie
    in all columns are numbered in any order. Pass narrow columns: they are
    shuffled and written once.
    """
    if n_ranges is None:
        n_ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    order = [key] if isinstance(key, str) else list(key)
    order += list(tie_breakers)
    numbered = materialize(df.repartitionByRange(max(1, n_ranges), *order).sortWithinPartitions(*order)
                           .withColumn("_m", F.monotonically_increasing_id()))
    ranged = numbered.withColumn("_range", F.shiftright("_m", 33))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range: a global window over it is tiny
    offsets = counts.select(
        "_range",
        F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    within = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return (ranged.join(F.broadcast(offsets), "_range")  # at most n_ranges rows
            .withColumn(out_col, (F.col("_off") + within).cast("bigint"))
            .drop("_m", "_range", "_off"))
