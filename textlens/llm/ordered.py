"""Places and prefix hashes along the rows of a key, without a task per key.

``numbered`` sorts rows by a key and an order with Spark's range partitioner,
so a key with a third of all rows spreads over many tasks; each task numbers
what it has, and a carry of a few numbers per partition (the only thing that
the driver gathers) tells each one where the key it begins with stood before.

Prefix hashes are polynomials modulo 2^64 over 64-bit symbols: the hash of the
first n + 1 symbols is that of the first n plus the next symbol times the n-th
power of an odd base, so two stretches of a key are joined by one product.

Defined cases: null keys are one key, the first; an empty table gives no rows;
rows that are equal in the whole order are numbered as they come.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.llm.common import partitions, save

BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def power(n: int) -> int:
    return pow(BASE, n, 1 << 64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def breaks(values: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Where a sorted column (its values, and which are null) changes."""
    out = np.ones(len(values), bool)
    out[1:] = (values[1:] != values[:-1]) | (null[1:] != null[:-1])
    return out


def longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of integers, 0 for null, and which are null."""
    return (column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False),
            column.is_null().to_numpy(zero_copy_only=False))


def _number(batches: Iterator[pa.RecordBatch], key: str, symbols: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Places and hashes within the partition."""
    last, at, sums = None, 0, [0] * len(symbols)
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        value, null = longs(b.column(key))
        new = breaks(value, null)
        new[0] = last != (value[0], null[0])
        place = np.arange(n)
        begin = np.maximum.accumulate(np.where(new, place, -1))
        here = place - np.maximum(begin, 0) + np.where(begin < 0, at, 0)
        arrays, up, down = [pa.array(here)], *_powers(n)
        for i, c in enumerate(symbols):
            run = np.zeros(n + 1, np.uint64)
            np.cumsum(longs(b.column(c))[0].view(np.uint64) * up[:n], out=run[1:], dtype=np.uint64)
            first = np.maximum(begin, 0)
            h = (run[1:] - run[first]) * down[first]
            go_on = begin < 0
            h[go_on] = h[go_on] * np.uint64(power(at)) + np.uint64(sums[i])
            sums[i] = int(h[-1])
            arrays.append(pa.array(h.view(np.int64)))
        last, at = (value[-1], null[-1]), int(here[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, *arrays], [*b.schema.names, "_at", *(f"_h_{c}" for c in symbols)])


def numbered(df: DataFrame, key: str, order: Sequence[Column], symbols: Sequence[str] = (),
             name: str = "numbered") -> DataFrame:
    """``df`` with ``_at``, the row's place (from 0) among those of its ``key``
    (an integer column) in the ``order``, and for each column of ``symbols``
    (64-bit integers) ``_h_<column>``, the hash of the key's symbols up to and
    with the row's. The rows are written once."""
    place = [F.col(key).asc_nulls_first(), *order]
    rows = df.repartitionByRange(partitions(df), *place).sortWithinPartitions(*place)
    more = [T.StructField(c, T.LongType()) for c in ("_at", *(f"_h_{c}" for c in symbols))]
    rows = rows.mapInArrow(lambda it: _number(it, key, symbols), T.StructType([*rows.schema.fields, *more]))
    rows = save(rows.withColumn("_mid", F.monotonically_increasing_id()), name).withColumn("_pid", F.shiftright("_mid", 33))
    hashes = [f"_h_{c}" for c in symbols]
    ends = (rows.groupBy("_pid").agg(F.min_by(F.struct(key), "_mid").alias("a"),
                                     F.max_by(F.struct(key, "_at", *hashes), "_mid").alias("z"))
            .orderBy("_pid").collect())  # a few numbers for each partition
    carry, last, at, sums = {}, None, 0, [0] * len(symbols)
    for e in ends:
        if last is not None and e["a"][0] == last[0]:
            carry[e["_pid"]] = (e["a"][0], at, sums)
        if last is None or e["z"][0] != last[0] or e["a"][0] != last[0]:
            at, sums = 0, [0] * len(symbols)
        tail = [e["z"][h] & _MASK for h in hashes]
        sums = [(s + power(at) * t) & _MASK for s, t in zip(sums, tail, strict=True)]
        last, at = e["z"], at + e["z"]["_at"] + 1
    if not carry:
        return rows.drop("_pid", "_mid")
    flat = [(p, k, at, *[_signed(s) for s in sums]) for p, (k, at, sums) in carry.items()]
    known = df.sparkSession.createDataFrame(
        flat, T.StructType([T.StructField(c, T.LongType()) for c in ("_pid", "_key", "_at0", *(f"_c{h}" for h in hashes))]))
    joined = rows.join(F.broadcast(known), (rows["_pid"] == known["_pid"]) & rows[key].eqNullSafe(F.col("_key")), "left")
    joined = joined.drop("_pid", "_mid", "_key")
    kept = [c for c in joined.columns if c != "_at0" and not c.startswith("_c_h_")]

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {c: b.column(c) for c in kept}
            at, fresh = longs(b.column("_at0"))
            up = np.ones(len(at), np.uint64)
            for a in np.unique(at[~fresh]).tolist():
                up[at == a] = power(a)
            cols["_at"] = pa.array(longs(cols["_at"])[0] + at)
            for h in hashes:
                mine, before = longs(cols[h])[0].view(np.uint64), longs(b.column(f"_c{h}"))[0].view(np.uint64)
                cols[h] = pa.array((mine * up + before).view(np.int64))
            yield pa.RecordBatch.from_arrays(list(cols.values()), kept)

    return joined.mapInArrow(go_on, joined.select(*kept).schema)
