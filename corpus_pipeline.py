"""Corpus pipeline: toxicity, near-duplicates, benchmark leaks, mixture, shards.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` over all rows
that the stage before it kept; ``run`` writes every stage's result as Parquet
below the shared checkpoint folder and reads it again for the next one. All
stages but the last return the columns of their input; the mixture repeats
rows of sources that it takes more than once; the last one adds ``shard`` and
``slot``. A classifier and two floating-point orders are involved, so the
rows are checked against a plain recomputation in the tests, not in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.llm import decontaminate, mixing, sharding, simhash, toxicity
from textlens.llm.common import fresh, read, save
from textlens.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents scored 0.5 or more go."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    score = fresh(docs, "toxicity")
    return toxicity.score(docs, model, out=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each component the document with the least id stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: each row as often as the weighted mixture takes it."""
    return mixing.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: ``shard`` and ``slot`` of every row."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_checkpoint_dir(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
