"""Line dedup: boilerplate lines found in many documents.

1. Every text is read once; each distinct line key of at least ``min_chars``
   code points becomes a 16-byte XXH3 digest in a narrow table.
2. Two blocked Bloom filters over these digests, once-seen and twice-seen,
   are built segment by segment: a digest that finds its bits set in the
   first filter sets them in the second. A filter has about ``BITS_PER_KEY``
   bits for each digest, at most ``MAX_BITS`` (64 MB, the proven bound of what
   is collected and broadcast); beyond it more single lines pass as suspects,
   the result stays the same.
3. Only digests whose bits are set in the twice-seen filter are shuffled, for
   the exact number of documents and the largest id that holds the line.
4. The digests each document loses are joined to the texts (their one
   shuffle), which are rewritten.

Digests have 128 bits: equal digests are taken for equal lines.

Defined cases: null and empty texts are one empty line; rows that repeat an
id count as documents of their own, and all rows with the largest id keep the
line; null ids are below every other (if only null ids hold a line, all keep
it); an empty table gives no rows; further columns are kept (``n_lines`` and
``n_dropped`` replace such columns).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.llm.common import partitions, read, save
from textlens.llm.words import mix

MIN_CHARS, MIN_DOCS = 40, 5
BITS_PER_KEY, MAX_BITS, SEGMENT = 16, 1 << 29, 1 << 17
_BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Digest of the line's key, or None if the key is too short."""
    key = line.strip(_BLANKS).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def digests(docs: DataFrame, min_chars: int) -> DataFrame:
    """(``doc_id``, ``_rid``, ``keys``: the distinct digests, concatenated)."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            found = []
            for t in b.columns[-1]:
                keys = dict.fromkeys(line_key(x, min_chars) for x in t.as_py().split(b"\n"))
                keys.pop(None, None)
                found.append(b"".join(keys))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.binary())], ["doc_id", "_rid", "keys"])

    kind = docs.schema["doc_id"]
    return docs.select("doc_id", "_rid", "_bytes").mapInArrow(
        run, T.StructType([kind, T.StructField("_rid", T.LongType()), T.StructField("keys", T.BinaryType())]))


class Places:
    """Segment and two bits of a digest in a filter of ``bits`` bits."""

    def __init__(self, bits: int):
        self.size = min(bits, SEGMENT)
        self.segments = max(1, bits // SEGMENT)

    def segment(self, h: np.ndarray) -> np.ndarray:
        return (h % np.uint64(self.segments)).astype(np.int64)

    def bits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = mix(h)
        return ((m & np.uint64(self.size - 1)).astype(np.int64),
                ((m >> np.uint64(32)) & np.uint64(self.size - 1)).astype(np.int64))


def heads(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First 8 bytes of every digest of a batch, and the row each is in."""
    size = np.array([len(k) // 16 for k in (k.as_py() for k in keys)], np.int64)
    joined = b"".join(k.as_py() for k in keys)
    return np.frombuffer(joined, "<u8")[::2], np.repeat(np.arange(len(keys)), size)


def twice_seen(keyed: DataFrame, bits: int) -> np.ndarray:
    """Bits of the twice-seen filter, one row a segment (``bits`` is bounded)."""
    place = Places(bits)

    def spread(batches):
        for b in batches:
            h, n = np.unique(heads(b.column("keys"))[0], return_counts=True)
            h = np.concatenate([h, h[n > 1]])  # seen twice here: comes twice
            seg = place.segment(h)
            o = np.argsort(seg, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(seg[o]) > 0])) if len(o) else np.zeros(0, np.int64)
            parts = np.split(h[o], at[1:]) if len(o) else []
            yield pa.RecordBatch.from_arrays([pa.array(seg[o][at].astype(np.int32)),
                                              pa.array([p.tobytes() for p in parts], pa.binary())], ["seg", "h"])

    def merge(batches):
        now, once, twice = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice).tobytes()])],
                                              ["seg", "bits"])
        for b in batches:
            for seg, raw in zip(b.column("seg").to_pylist(), b.column("h"), strict=True):
                if seg != now:
                    if now is not None and twice.any():
                        yield done()
                    now, once, twice = seg, np.zeros(place.size, bool), np.zeros(place.size, bool)
                h = np.sort(np.frombuffer(raw.as_buffer(), "<u8"))
                again = np.zeros(len(h), bool)
                again[1:] = h[1:] == h[:-1]
                x, y = place.bits(h)
                seen = again | (once[x] & once[y])
                twice[x[seen]] = twice[y[seen]] = True
                once[x] = once[y] = True
        if now is not None and twice.any():
            yield done()

    parts = keyed.select("keys").mapInArrow(spread, "seg int, h binary")
    rows = (parts.repartition(min(partitions(keyed), place.segments), "seg").sortWithinPartitions("seg")
            .mapInArrow(merge, "seg int, bits binary").toArrow().to_pylist())
    out = np.zeros((place.segments, -(-place.size // 8)), np.uint8)
    for r in rows:
        out[r["seg"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def repeated_lines(keyed: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Suspects (``key``, ``doc_id``, ``_rid``) and the confirmed lines
    (``key``, ``keeper``: the largest id holding it)."""
    total = keyed.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    bits = min(MAX_BITS, 1 << max(16, (total // 16 * BITS_PER_KEY - 1).bit_length()))
    place = Places(bits)
    shared = keyed.sparkSession.sparkContext.broadcast(twice_seen(keyed, bits))

    def probe(batches):
        seen = shared.value
        for b in batches:
            h, row = heads(b.column("keys"))
            seg = place.segment(h)
            x, y = place.bits(h)
            hit = np.flatnonzero((seen[seg, x >> 3] >> (7 - (x & 7)) & 1) & (seen[seg, y >> 3] >> (7 - (y & 7)) & 1))
            first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))])
            keys, rows = b.column("keys"), row[hit].tolist()
            at = (hit - first[row[hit]]).tolist()
            raw = {r: keys[r].as_py() for r in set(rows)}
            yield pa.RecordBatch.from_arrays(
                [pa.array([raw[r][16 * i: 16 * i + 16] for r, i in zip(rows, at, strict=True)], pa.binary()),
                 b.column("doc_id").take(pa.array(rows, pa.int64())), b.column("_rid").take(pa.array(rows, pa.int64()))],
                ["key", "doc_id", "_rid"])

    kinds = [T.StructField("key", T.BinaryType()), *keyed.select("doc_id", "_rid").schema.fields]
    suspects = keyed.mapInArrow(probe, T.StructType(kinds))
    confirmed = (suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
                 .where(F.col("n") >= min_docs).select("key", "keeper"))
    return suspects, save(confirmed, "repeated-lines")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text: str = "text") -> DataFrame:
    """``docs`` with its texts rewritten and the columns ``n_lines`` (before)
    and ``n_dropped``."""
    docs = docs.drop("n_lines", "n_dropped")
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others).alias("_row"), "doc_id", F.xxhash64("doc_id", text).alias("_rid"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_bytes"))
    keyed = save(digests(rows, min_chars), "line-keys")
    suspects, confirmed = repeated_lines(keyed, min_docs)
    lost = (suspects.join(confirmed, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
            .select("_rid", F.col("doc_id").alias("_id"), "key").distinct()
            .groupBy("_rid", "_id").agg(F.collect_list("key").alias("_lost")))
    lost = lost.withColumnRenamed("_rid", "_r")
    joined = rows.join(lost, (F.col("_rid") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    given = joined.select("_row", "_lost", "_bytes")

    def rewrite(batches):
        for b in batches:
            n_lines, n_dropped, kept = [], [], []
            for lost, raw in zip(b.column("_lost"), b.column("_bytes"), strict=True):
                raw, lost = raw.as_py(), lost.as_py()
                lines = raw.split(b"\n") if lost else None
                n_lines.append(raw.count(b"\n") + 1)
                if lost:
                    gone = set(lost)
                    left = [x for x in lines if line_key(x, min_chars) not in gone]
                    raw = b"\n".join(left)
                    n_dropped.append(n_lines[-1] - len(left))
                else:
                    n_dropped.append(0)
                kept.append(raw)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-2], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()),
                 pa.array(n_dropped, pa.int64())], ["_row", "_kept", "n_lines", "n_dropped"])

    schema = T.StructType([given.schema["_row"], T.StructField("_kept", T.StringType()),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return given.mapInArrow(rewrite, schema).select("_row.*", F.col("_kept").alias(text), "n_lines", "n_dropped")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before, lines dropped, digest of the rest."""
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = rf"""
WITH lines AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), often AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), judged AS (
  SELECT l.*, o.key IS NOT NULL AND l.doc_id <> o.keeper AS gone FROM lines l LEFT JOIN often o USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
