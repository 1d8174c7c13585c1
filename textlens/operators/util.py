"""Plan helpers shared by the operators.

* ``broadcast_if_bounded`` broadcasts a side only when a static upper bound of
  its size (from parameters such as number of features x number of models)
  is below the session's broadcast threshold; otherwise the join stays a
  shuffle join and AQE may still switch it at run time from measured sizes.
* ``attach`` joins per-model parameters (a table with one row per model key)
  onto a larger table; with no key it becomes a scalar subquery, so no
  cartesian product appears in the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BROADCAST = 256 * 1024 * 1024


def _bytes(raw: str) -> int:
    raw = str(raw).strip().lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    for suffix in sorted(units, key=len, reverse=True):
        if raw.endswith(suffix):
            return int(float(raw[: -len(suffix)]) * units[suffix])
    return int(raw)


def broadcast_limit(df: DataFrame) -> int:
    """Bytes we accept to broadcast: the session's threshold, never above
    256 MB; 0 when the session disables broadcasting."""
    value = _bytes(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760"))
    return max(0, min(value, MOST_BROADCAST))


def broadcast_if_bounded(df: DataFrame, max_rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only when ``max_rows * row_bytes`` is a proven bound
    below the limit."""
    if max_rows * row_bytes <= broadcast_limit(df):
        return F.broadcast(df)
    return df


def attach(df: DataFrame, params: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Add ``cols`` of ``params`` (one row per key) to every row of ``df``.

    Keyed: broadcast equi-join on the keys (one row per model, so the side
    is as small as the model grid). Unkeyed: one scalar subquery, evaluated
    once and inlined as a literal.
    """
    if keys:
        return df.join(F.broadcast(params.select(*keys, *cols)), keys, "left")
    packed = params.select(F.struct(*cols).alias("_p")).scalar()
    return df.select("*", *[packed[c].alias(c) for c in cols])


def label_array(values: list, cast: str = "double"):
    """A literal array of the label values, in order."""
    return F.array(*[F.lit(v).cast(cast) for v in values])


def materialize(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """Write a fitted model table once as parquet under the shared checkpoint
    folder and read it back: every consumer reuses it instead of re-running
    the fit, and its lineage is cut, so a lost executor never re-triggers the
    fit. One job (a reliable ``checkpoint()`` would compute the table twice).
    For tables bounded by the model size (classes x features, features^2)
    and for narrow ones of ids. The path is added to ``made``, for whoever
    drops the tables (``session.drop_paths``) when they are no longer read."""
    from textlens.session import scratch_path
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.mode("overwrite").parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_join(left: DataFrame, right: DataFrame, on: list[str], how: str, max_rows: int, row_bytes: int,
                 salt_col: str = "doc_id", salts: int = 32) -> DataFrame:
    """Join a large ``left`` to a model-sized ``right`` (``max_rows`` is a
    proven bound of its rows).

    Under the broadcast limit: broadcast hash join, no shuffle of ``left``.
    Above it: a salted shuffle join, so a key carrying a large share of the
    left rows (a very common gram's bucket) is split over ``salts`` tasks:
    left rows get ``pmod(xxhash64(salt_col), salts)``, right rows are
    replicated once per salt value (``max_rows * salts`` rows, still model
    sized). Deterministic, so a recomputed task sees the same split.
    """
    if max_rows * row_bytes <= broadcast_limit(left):
        return left.join(F.broadcast(right), on, how)
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salts)).cast("int"))
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(salted_right, list(on) + ["_salt"], how).drop("_salt")
