"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW_SPLITS = 8

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """``{base}/{name}.parquet``; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-distribute an input of very few splits (a file that can't be split)
    over the session's parallelism before per-row text work. With more than
    ``FEW_SPLITS`` splits it is returned as is: shuffling text that is already
    spread would cost a full exchange for nothing, however many cores there
    are. The rows are the same either way."""
    try:
        want = df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # no driver-side context (e.g. a remote session): leave the plan as is
        return df
    if have >= min(want, FEW_SPLITS):
        return df
    return df.repartition(want, *keys)


def read_text_table(spark: SparkSession, base: str, name: str, keys: list[str], cols: list[str]) -> DataFrame:
    """A text table, pruned to ``cols`` and spread by ``keys`` when needed."""
    return spread(read_table(spark, base, name).select(*cols), keys)


def observations(documents: DataFrame, labels: DataFrame, label_col: str = "toxic") -> DataFrame:
    """S3: labelled documents ``(doc_id, label, text, category)``.

    ``label`` is 1.0 when the raw label string is "1", else 0.0; ``category``
    keeps the raw label string.
    """
    raw = F.col(label_col).cast("string")
    return (documents.select("doc_id", "text")
            .join(labels.select("doc_id", label_col), "doc_id")
            .select("doc_id", F.when(raw == "1", F.lit(1.0)).otherwise(F.lit(0.0)).alias("label"),
                    "text", raw.alias("category")))


def load_observations(spark: SparkSession, base: str, label_col: str = "toxic") -> DataFrame:
    docs = read_text_table(spark, base, "documents", ["doc_id"], ["doc_id", "text"])
    return observations(docs, read_table(spark, base, "labels"), label_col)


def sanity_sample(observations: DataFrame, n: int = 5, key: str = "doc_id") -> DataFrame:
    """``n`` labels picked by a deterministic hash order (the sampling
    is the feature here, so the limit stays). Top-k per partition, then a
    merge of ``n`` rows per partition: no full sort."""
    return (observations.orderBy(F.md5(F.col(key).cast("string")), key)
            .limit(n).select(key, "label"))


def sanity_message(observations: DataFrame, n: int = 5) -> str:
    """The check as text: the sampled labels, or a note that there are none, or
    fewer than ``n``."""
    rows = sanity_sample(observations, n).collect()  # at most n rows
    if not rows:
        return "no observations found: compare the source filters with the table's columns"
    said = [f"sample {i + 1}: label {r['label']}" for i, r in enumerate(rows)]
    if len(rows) < n:
        said.append(f"the table has {len(rows)} rows, {n} were asked for")
    return "\n".join(said)
