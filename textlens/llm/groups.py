"""Groups of whole texts that Spark deals out once and visits several times.

``deal`` gives each row a group by a hash of its id and text; groups hold
about ``GROUP_BYTES`` of text. Every visit (``visit``, ``visit_with``) is a
grouped Arrow function over the same exchange, which Spark reuses within a
plan, so the texts are shuffled once. Within a group the rows are in the
order of their hash, so a place in the group means the same in each visit.

What the visits exchange are packed numpy arrays, one binary value for each
(group, bucket) pair, so a hundred million small facts stay few rows; what
occurs more than once in a group is sent once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_BYTES = 4 << 20


def deal(docs: DataFrame, doc_id: str, text: str, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """Rows (``_row``: the other columns of a row of ``docs``, ``_id``, ``_rid``,
    ``_bytes``, ``_db``) and the number of groups, which follows the bytes of
    all texts."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-total // group_bytes))
    rid = F.xxhash64(doc_id, text)
    return docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("_row"), F.col(doc_id).alias("_id"),
                       rid.alias("_rid"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_bytes"),
                       F.pmod(rid, F.lit(n)).cast("int").alias("_db")), n


def ordered(group: pa.Table) -> pa.Table:
    """The group's rows in the order that all visits share."""
    rid = group.column("_rid").to_numpy()
    return group.take(pa.array(np.argsort(rid, kind="stable"))).combine_chunks()


def texts(group: pa.Table) -> pa.Array:
    col = group.column("_bytes").cast(pa.large_binary())
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.view(pa.large_string())


def visit(rows: DataFrame, f: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``f(group number, its rows)`` for each group."""
    return rows.groupBy("_db").applyInArrow(lambda k, t: f(k[0].as_py(), ordered(t)), schema)


def visit_with(rows: DataFrame, facts: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """``f(rows, facts)`` for each group; ``facts`` has the group in ``_db``."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return f(ordered(left), right) if left.num_rows else f(left, right)
    return rows.groupBy("_db").cogroup(facts.groupBy("_db")).applyInArrow(run, schema)


def by_bucket(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(bucket, the arrays' values in it) for each bucket that occurs."""
    if not len(bucket):
        return
    o = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[o])) + 1
    split = [np.split(a[o], cut) for a in arrays]
    for i, b in enumerate(bucket[o][np.concatenate([[0], cut])].tolist()):
        yield (b, *[s[i] for s in split])


def unpack(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), kind) if v.is_valid else np.zeros(0, kind) for v in column]


def meet(facts: DataFrame, kind: str, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Bring the packed records (``recs`` of numpy type ``kind``) of each
    ``bucket`` together: ``f(records, their groups)`` says which to send back;
    the result has ``_db`` and ``recs``. ``known`` records go back untouched."""
    def run(table: pa.Table) -> pa.Table:
        recs, dbs = unpack(table.column("recs"), kind), table.column("db").to_numpy()
        out = [(int(d), k) for d, k in zip(dbs, unpack(table.column("known"), kind), strict=True) if len(k)]
        r, d = np.concatenate(recs), np.repeat(dbs, [len(x) for x in recs])
        back = f(r, d)
        out += list(by_bucket(d[back], r[back]))
        return pa.table({"_db": pa.array([x[0] for x in out], pa.int32()),
                         "recs": pa.array([x[1].tobytes() for x in out], pa.binary())})

    return facts.groupBy("bucket").applyInArrow(run, "_db int, recs binary")


def sent(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    """Rows (bucket, db, recs, known) as the table that ``meet`` takes."""
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "db", "recs", "known"])


SENT = "bucket int, db int, recs binary, known binary"
