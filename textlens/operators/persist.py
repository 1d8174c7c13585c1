"""Model save / load (M10): every fitted model as small tables (logistic
models also as ``pyspark.ml`` stages) and one metadata row under a shared
folder, so any executor, job or stream can reload it and score with it.

``save_model`` / ``load_model`` know Naive Bayes, linear, logistic, online and
SPPMI models; the metadata says which one a folder holds.

A save never touches what readers read: it claims the next number (by creating
a file, which exactly one of several savers can do), writes a version of that
number and marks it as committed last. ``load_model`` takes the highest
committed version, so a save that fails or is still under way changes
nothing; committed versions before the last two are dropped.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textlens.operators.linear import LinearModel
from textlens.operators.mlfit import OvrLogistic
from textlens.operators.naive_bayes import NBModel
from textlens.operators.online import OnlineLogistic
from textlens.operators.represent import SppmiFeatures, SppmiLogistic, SppmiNB
from textlens.session import drop_paths

#: Class -> (plain fields, tables, tables that may be missing).
KINDS = {
    NBModel: (["n_gram", "num_features", "labels"], ["classes", "theta", "idf_table", "idf_counts"], ["wide", "gains"]),
    LinearModel: (["n_gram", "num_features", "labels"], ["weights", "classes"], ["idf_table", "idf_counts", "gains"]),
    OvrLogistic: (["n_gram", "num_features", "labels", "upto", "clean", "mirrored"], ["categories"], []),
    OnlineLogistic: (["n_gram", "num_features", "labels", "n_weights", "upto", "clean"], ["weights", "classes"], []),
    SppmiNB: (["labels"], ["classes", "theta"], []),
    SppmiLogistic: ([], [], []),
    SppmiFeatures: (["n_gram", "num_features", "unseen"], ["texts", "vectors", "rows"], []),
}
#: Class -> fields that are models themselves.
PARTS = {SppmiNB: ["features"], SppmiLogistic: ["features", "linear"]}


def _fs(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and a maker of its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _numbers(spark: SparkSession, folder: str, prefix: str = "") -> list[int]:
    fs, make = _fs(spark, folder)
    if not fs.exists(make(folder)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(make(folder))]
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())


def _committed(spark: SparkSession, path: str) -> list[int]:
    fs, make = _fs(spark, path)
    return [n for n in _numbers(spark, path, "version-") if fs.exists(make(f"{path}/version-{n}/COMMITTED"))]


def _claim(spark: SparkSession, path: str) -> int:
    fs, make = _fs(spark, path)
    while True:
        number = max(_numbers(spark, f"{path}/claims"), default=-1) + 1
        try:
            fs.create(make(f"{path}/claims/{number}"), False).close()
            return number
        except Py4JJavaError as e:  # another saver has it
            if "exist" not in str(e.java_exception):
                raise


def save_model(model, path: str) -> str:
    """Write any fitted model as a new version under ``path`` and commit it."""
    path, spark = path.rstrip("/"), SparkSession.active()
    folder = f"{path}/version-{_claim(spark, path)}"
    _write(model, folder)
    fs, make = _fs(spark, path)
    fs.create(make(f"{folder}/COMMITTED"), False).close()
    drop_paths(spark, [f"{path}/version-{n}" for n in _committed(spark, path)[:-2]])
    return path


def _write(model, path: str) -> None:
    plain, tables, optional = KINDS[type(model)]
    meta = {f: getattr(model, f) for f in plain} | {"kind": type(model).__name__}
    meta["has"] = [t for t in optional if getattr(model, t) is not None]
    for t in tables + meta["has"]:
        getattr(model, t).write.parquet(f"{path}/{t}")
    spark = SparkSession.active()
    if isinstance(model, OvrLogistic):
        model.features_model.write().save(f"{path}/features")
        for i, m in enumerate(model.models):
            m.write().save(f"{path}/model-{i}")
        meta["models"] = len(model.models)
    for part in PARTS.get(type(model), []):
        _write(getattr(model, part), f"{path}/{part}")
    spark.range(1).select(F.lit(json.dumps(meta)).alias("meta")).write.parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str):
    """Read the model that was committed last by ``save_model``."""
    path = path.rstrip("/")
    versions = _committed(spark, path)
    if not versions:
        raise ValueError(f"no committed model under {path}")
    return _read(spark, f"{path}/version-{versions[-1]}")


def _read(spark: SparkSession, path: str):
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])  # one row
    kind = next(k for k in KINDS if k.__name__ == meta["kind"])
    plain, tables, _ = KINDS[kind]
    fields = {f: meta[f] for f in plain} | {t: spark.read.parquet(f"{path}/{t}") for t in tables + meta["has"]}
    if kind is OvrLogistic:
        fields["features_model"] = PipelineModel.load(f"{path}/features")
        fields["models"] = [LogisticRegressionModel.load(f"{path}/model-{i}") for i in range(meta["models"])]
    fields |= {part: _read(spark, f"{path}/{part}") for part in PARTS.get(kind, [])}
    return kind(**fields)
