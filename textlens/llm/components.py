"""Connected components of a table of links, in Spark rounds.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): every node points its larger
neighbours, then its smaller ones, to the least node it knows, until the
links form stars around the least node of each component. Every round is
written to the shared checkpoint folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.llm.common import save


def _point(links: DataFrame, keep_self: bool) -> DataFrame:
    least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = links.join(least, "u")
    if not keep_self:  # large star: the larger neighbours
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))))


def components(links: DataFrame) -> DataFrame:
    """``links``: ``u``, ``v`` (any order, repeats and loops allowed, no
    nulls). Returns (``node``, ``root``) for each node but the roots."""
    state, before = save(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                         .distinct(), "links"), None
    while True:
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _point(both, False).where("u <> v").distinct()
        large = save(large, "large-star")
        state = save(_point(large, True).where("u <> v").distinct(), "small-star")
