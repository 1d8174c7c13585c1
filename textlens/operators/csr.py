"""Sparse documents times a sparse table of rows, inside the tasks.

``row_sums`` adds up, for every document, the rows of its buckets. The table is
packed as sorted sparse rows (CSR), the documents of an Arrow batch are sparse
rows as well, and their product is taken in numpy a few documents at a time,
so only the finished vectors leave a task.

* A table of at most the broadcast limit, by its counted entries, is shared
  with every task as one packed array; the documents do not move.
* A larger table is cut into blocks of bucket ranges of about half the limit.
  A document sends each block the buckets that it has there; blocks are
  replicated under salts (one per ``SALT_DOCS`` documents), so a block that
  every document needs is many groups; the blocks' partial vectors are added
  up per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.operators.util import broadcast_limit

ENTRY_BYTES = 12
CELLS = 1 << 22        # documents x buckets of a block of sums
SALT_DOCS = 20_000


class Rows:
    """Sparse rows of the buckets from ``first`` on."""

    def __init__(self, i: np.ndarray, j: np.ndarray, s: np.ndarray, first: int, n: int):
        order = np.argsort(i, kind="stable")
        self.first, self.n = first, n
        self.start = np.searchsorted(i[order], np.arange(first, first + n + 1))
        self.j, self.s = j[order].astype(np.int32), s[order].astype(np.float64)

    def times(self, size: np.ndarray, bucket: np.ndarray, v: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(number of entries of each document, j, x) for runs of documents with
        ``size`` buckets each, ``bucket`` one after the other."""
        ends = np.cumsum(size)
        step = max(1, CELLS // v)
        for lo in range(0, len(size), step):
            hi = min(lo + step, len(size))
            a, z = (ends[lo - 1] if lo else 0), ends[hi - 1]
            sums = np.zeros((hi - lo) * v)
            hit = np.zeros((hi - lo) * v, bool)
            doc = np.repeat(np.arange(hi - lo), size[lo:hi])
            at = bucket[a:z] - self.first
            counted = np.cumsum(self.start[at + 1] - self.start[at])
            b = a
            while b < z:  # as many buckets as have CELLS entries, one at least
                had = counted[b - a - 1] if b > a else 0
                part = slice(b, a + max(b - a + 1, int(np.searchsorted(counted, had + CELLS, "right"))))
                b = part.stop
                at = bucket[part] - self.first
                n = self.start[at + 1] - self.start[at]
                entry = np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                cell = np.repeat(doc[part.start - a: part.stop - a] * v, n) + self.j[entry]
                sums += np.bincount(cell, self.s[entry], len(sums))
                hit[cell] = True
            cell = np.flatnonzero(hit)
            yield np.bincount(cell // v, minlength=hi - lo), cell % v, sums[cell]


def _buckets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    size = np.nan_to_num(pc.list_value_length(col).to_numpy(zero_copy_only=False)).astype(np.int64)
    return size, col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _vectors(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[pa.Array, pa.Array]:
    n, j, x = (np.concatenate(p) for p in zip(*parts, strict=True))
    ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(j.astype(np.int64))), pa.ListArray.from_arrays(ends, pa.array(x))


def row_sums(docs: DataFrame, rows: DataFrame, num_features: int, ids: list[str] = ("doc_id",), value: str = "s",
             limit: int | None = None) -> DataFrame:
    """``(ids..., j array<bigint>, x array<double>)``: for each document the sum of
    ``rows (i, j, value)`` over the buckets of its array ``b``, entries in order;
    ``ids`` tell documents apart."""
    ids, v = list(ids), int(num_features)
    limit = broadcast_limit(docs) if limit is None else limit
    packed = rows.select("i", "j", F.col(value).cast("double").alias("s"))
    entries = packed.count()
    schema = T.StructType([*docs.select(*ids).schema.fields, T.StructField("j", T.ArrayType(T.LongType())),
                           T.StructField("x", T.ArrayType(T.DoubleType()))])
    if entries * ENTRY_BYTES <= limit:
        t = packed.toArrow()  # within the limit
        table = Rows(*(t.column(c).to_numpy() for c in ("i", "j", "s")), 0, v)
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    size, bucket = _buckets(b.column(len(ids)))
                    yield pa.RecordBatch.from_arrays([*b.columns[:len(ids)], *_vectors(list(shared.value.times(size, bucket, v)))],
                                                     [*ids, "j", "x"])

        return docs.select(*ids, "b").mapInArrow(run, schema)
    return _by_blocks(docs, packed, entries, v, ids, limit)


def _by_blocks(docs: DataFrame, packed: DataFrame, entries: int, v: int, ids: list[str], limit: int) -> DataFrame:
    n_blocks = min(v, max(2, -(-2 * entries * ENTRY_BYTES // max(limit, 1))))
    width = -(-v // n_blocks)
    salts = max(1, -(-docs.count() // SALT_DOCS))
    salt = F.pmod(F.xxhash64(*ids), F.lit(salts)).cast("int").alias("_salt")
    found = docs.select(F.struct(*ids).alias("_id"), salt, "b")
    cut = F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda k: F.struct(
        k.alias("block"), F.filter("b", lambda x: F.floor(x / width) == k).alias("b")))
    sent = found.select("_id", "_salt", F.explode(F.filter(cut, lambda e: F.size(e["b"]) > 0)).alias("_e")).select(
        "_id", "_salt", F.col("_e.block").cast("int").alias("block"), "_e.b")
    table = packed.select(F.floor(F.col("i") / width).cast("int").alias("block"), "i", "j", "s",
                          F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    kind = T.StructType([T.StructField("_id", found.schema["_id"].dataType), T.StructField("j", T.ArrayType(T.LongType())),
                         T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        first = key[0].as_py() * width
        part = Rows(*(right.column(c).to_numpy() for c in ("i", "j", "s")), first, width)
        left = left.combine_chunks()
        if not left.num_rows:
            return pa.table({"_id": left.column("_id"), "j": pa.array([], pa.list_(pa.int64())), "x": pa.array([], pa.list_(pa.float64()))})
        size, bucket = _buckets(left.column("b").combine_chunks())
        return pa.Table.from_arrays([left.column("_id"), *_vectors(list(part.times(size, bucket, v)))], ["_id", "j", "x"])

    parts = sent.groupBy("block", "_salt").cogroup(table.groupBy("block", "_salt")).applyInArrow(run, kind)
    long = parts.select("_id", F.explode(F.arrays_zip("j", "x")).alias("_e")).select("_id", "_e.j", "_e.x")
    sums = long.groupBy("_id", "j").agg(F.sum("x").alias("x")).groupBy("_id").agg(
        F.sort_array(F.collect_list(F.struct("j", "x"))).alias("_v"))  # at most v entries each
    sums = sums.select("_id", F.transform("_v", lambda e: e["j"]).alias("j"), F.transform("_v", lambda e: e["x"]).alias("x"))
    none = [F.coalesce("j", F.array().cast("array<bigint>")).alias("j"), F.coalesce("x", F.array().cast("array<double>")).alias("x")]
    return found.join(sums, "_id", "left").select("_id.*", *none)
