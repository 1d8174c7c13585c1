"""Sinks: VW-format text lines (S8), sparse COO triples (S9), one-hot label
triples (S10). Each is a DataFrame builder plus a distributed writer; none
collects to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlens.functions.text import clean_text


def vw_lines(docs: DataFrame, namespace: str = "n", ids: list[str] = ("doc_id",),
             label_col: str = "label", text_col: str = "text", terms_col: str = "terms") -> DataFrame:
    """``label |namespace cleaned-text idx:value ...`` per row.

    Label 0 -> "-1.0", anything else -> "1.0"; the pairs come from a sorted
    ``terms`` array (bucket order), values printed as doubles. Built inside
    the row: no shuffle.
    """
    pairs = F.array_join(F.transform(terms_col, lambda t: F.concat(
        t["bucket"].cast("string"), F.lit(":"), t["tf"].cast("double").cast("string"))), " ")
    label = F.when(F.col(label_col) == 0.0, F.lit("-1.0")).otherwise(F.lit("1.0"))
    return docs.select(*ids, F.concat(label, F.lit(f" |{namespace} "), clean_text(F.col(text_col)),
                                      F.lit(" "), pairs).alias("line"))


def coo_triples(points: DataFrame, index: DataFrame, key: str = "doc_id", value_col: str = "x") -> DataFrame:
    """``(row_idx, feature_idx, value)`` from long features and a row index."""
    return points.join(index.select(key, "idx"), key).select(
        F.col("idx").alias("row_idx"), F.col("bucket").alias("feature_idx"), F.col(value_col).alias("value"))


def onehot_triples(index: DataFrame, label_col: str = "label") -> DataFrame:
    """``(row_idx, label, 1.0)`` with the label as an integer column index."""
    return index.select(F.col("idx").alias("row_idx"), F.col(label_col).cast("int").alias("label"),
                        F.lit(1.0).alias("value"))


def write_text(lines: DataFrame, path: str, line_col: str = "line") -> None:
    lines.select(line_col).write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
