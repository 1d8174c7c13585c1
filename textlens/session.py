"""Spark session helpers.

The cluster names a shared checkpoint folder in ``spark.checkpoint.dir``;
we read it from the session and only invent one when it is unset (tests,
local benches).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "textlens", extra: dict | None = None) -> SparkSession:
    """Session for tests and benches; on a cluster pass ``master=None``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    return spark


def shares_this_machine(master: str) -> bool:
    """Whether driver and executors are one process, as in ``local[4]``."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: ``spark.checkpoint.dir`` of the session,
    else the one set on the SparkContext. Only where driver and executors are
    one process a scratch folder is made when neither is set; anywhere else
    that would scatter the files over the machines, so it is an error."""
    try:
        sc = spark.sparkContext
    except Exception:  # remote session: only the runtime conf is visible
        sc = None
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and sc is not None:
        path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if sc is None or not shares_this_machine(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
        path = path if spark.conf.get("spark.checkpoint.dir", None) else sc.getCheckpointDir()
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/textlens-{name}-{uuid.uuid4().hex[:12]}"


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables, wherever the checkpoint folder is."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        target = jvm.org.apache.hadoop.fs.Path(p)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings sized for a run over ``input_bytes`` of input on
    ``total_cores`` executor cores (apply at session build).

    * scan splits of ``target_partition_bytes`` keep a task's text (and its
      term arrays, about the same size) well inside executor memory;
    * shuffle partitions sized for the largest shuffle, not the input: the
      biggest exchange carries one compact term array per document (about a
      third of the text; per-document scores are far smaller), so
      ``max(3 x cores, min(100_000, input / 3 / target))``; AQE coalesces the
      small exchanges (model tables) at run time and splits skewed ones; the
      cap of 100,000 keeps the shuffle's bookkeeping on the driver small;
    * Arrow batches of 2,048 documents bound the co-occurrence task's block
      (documents x features float32) next to its V x V accumulator.
    """
    partitions = max(3 * total_cores, min(100_000, -(-input_bytes // (3 * target_partition_bytes))))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    }
