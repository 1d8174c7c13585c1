"""Labelled text lines (S4): ``label,text`` split at the FIRST comma only;
trailing CR/LF stripped; the text may itself contain commas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlens.operators.util import broadcast_if_bounded, materialize


def parse_labelled_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Add ``label_str`` and ``text`` parsed from ``line_col``."""
    line = F.expr(f"trim(TRAILING '\\r\\n' FROM `{line_col}`)")
    cut = F.instr(line, ",")
    label = F.when(cut > 0, F.substring_index(line, ",", 1)).otherwise(line)
    text = F.when(cut > 0, F.expr(f"substr(trim(TRAILING '\\r\\n' FROM `{line_col}`), instr(trim(TRAILING '\\r\\n' FROM `{line_col}`), ',') + 1)")).otherwise(F.lit(""))
    return lines.select("*", label.alias("label_str"), text.alias("text"))


def read_labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """Read labelled text files: ``(doc_id, label_str, text, label, category)``.

    ``doc_id`` is the running number of the line from 0, files in the order of
    their paths. Two scans: the first counts the lines of each split, a few
    numbers per split are added up, the second numbers its lines as it reads
    them; texts are neither shuffled nor written. Both scans have to see the
    same splits: a line that finds none of its own stops the job.
    """
    lines = spark.read.text(path).select(
        F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("_s"),
        F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_i"), "value")
    splits = lines.groupBy("_s", "_f", "_b").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    splits = splits.select("_s", "_first", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    splits = materialize(splits)
    known = broadcast_if_bounded(splits, splits.count(), 40)
    within = F.col("_i") - F.col("_first")
    doc_id = F.when(within.between(0, F.col("_n") - 1), F.col("_off") + within).otherwise(
        F.raise_error(F.lit("the files or their splits changed between the two scans")).cast("bigint"))
    numbered = lines.join(known, "_s", "left").select(doc_id.cast("bigint").alias("doc_id"), "value")
    parsed = parse_labelled_lines(numbered)
    raw = F.col("label_str")
    return parsed.select("doc_id", "label_str", "text",
                         F.when(raw == "1", F.lit(1.0)).otherwise(F.lit(0.0)).alias("label"),
                         raw.alias("category"))
