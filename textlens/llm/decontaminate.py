"""Benchmark decontamination by a prefix-filtered set join.

Every window of ``window`` consecutive words of a benchmark item (the whole
item if it has fewer) is a set record whose tokens are its word shingles. A
document contains the record only if it contains all of its tokens, so for
exact containment a prefix of one token is enough to find it:

1. one pass over the documents counts how often each token of the records
   occurs (tokens are compared by hash; only those of records are counted);
2. each record is ordered by that rarity and its rarest token is its prefix;
3. a second pass joins the documents' shingles with the prefixes; where one
   matches, its offset gives the only place the record can have: bounds on
   the position and the length of the document are applied, then the hash of
   the whole window, then its words themselves.

Records are the distinct windows, each with a numeric id. They go to the tasks
in blocks of about ``BLOCK_BYTES`` of window text and ids, so what is broadcast
is bounded however large the benchmark is and however many items share a
window; every block sees all documents. Spark joins the items to the record
ids found, once for each distinct set of records that documents hold. The
documents' texts are never shuffled.

Defined cases: null, empty and wordless texts have no words and are clean;
items without words are no records; a null item id is written ``null``; items
that repeat an id are one item; repeated rows are judged each; empty tables
give no rows or no hits; further columns are kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.llm.common import read, row_key, save
from textlens.llm.words import Running, Words, batch_words, byte_class, buffer_of

WINDOW, SHINGLE = 10, 3
BLOCK_BYTES = 16 << 20
_ALNUM = byte_class("alnum")
_BITMAP = 1 << 20


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (``item``, ``words``: the window's words joined by a space)."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for lo, hi, w in batch_words(b.column("_text"), _ALNUM, True, overlap=window - 1):
                for r in range(hi - lo):
                    words = [w.word(i) for i in range(w.first[r], w.first[r + 1])]
                    if not words or w.before and len(words) < window:  # a later piece without a window of its own
                        continue
                    k = min(window, len(words))
                    found = list(dict.fromkeys(b" ".join(words[i: i + k]) for i in range(len(words) - k + 1)))
                    for i in range(0, len(found), 10000):
                        part = found[i: i + 10000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([b.column("item")[lo + r].as_py()] * len(part), pa.string()),
                             pa.array(part, pa.binary())], ["item", "words"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
                        F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(run, "item string, words binary").distinct()


class Block:
    """The records of one block, ready for the two passes."""

    def __init__(self, rows: list, shingle: int = SHINGLE):
        ids = {bytes(r["words"]): r["id"] for r in rows}
        self.texts = sorted(ids)
        self.ids = [ids[t] for t in self.texts]
        data, offsets = buffer_of(pa.array(self.texts, pa.binary()).cast(pa.large_string()))
        w = Words(data, offsets, 0, len(self.texts), _ALNUM, False)
        run = Running(w.hashes())
        self.length = np.diff(w.first)
        self.whole = run.of(w.first[:-1], w.first[1:])
        self.tokens: dict[int, np.ndarray] = {}  # token length -> sorted hashes
        self.of: dict[int, tuple] = {}  # token length -> (record, offset, hash) of each token
        for n in sorted(set(np.minimum(self.length, shingle).tolist())):
            rec = np.flatnonzero(np.minimum(self.length, shingle) == n)
            count = self.length[rec] - n + 1
            record = np.repeat(rec, count)
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = w.first[record] + offset
            h = run.of(start, start + n)
            self.tokens[n] = np.unique(h)
            self.of[n] = record, offset, h
        self.prefix: dict[int, tuple] = {}

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Choose each record's rarest token (then the least hash)."""
        for n, (record, offset, h) in self.of.items():
            at = np.searchsorted(self.tokens[n], h)
            freq = np.array([counts.get((n, i), 0) for i in range(len(self.tokens[n]))], np.int64)[at]
            o = np.lexsort((offset, h, freq, record))
            o = o[np.concatenate([[True], record[o][1:] != record[o][:-1]])]
            o = o[np.argsort(h[o], kind="stable")]
            keys, first = np.unique(h[o], return_index=True)
            self.prefix[n] = keys, np.append(first, len(o)), record[o], offset[o]
        self.of = {}


def _bitmap(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(_BITMAP, bool)
    out[(keys & np.uint64(_BITMAP - 1)).astype(np.int64)] = True
    return out


def _matches(w: Words, run: Running, n: int, keys: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words' ``n``-shingles that are in ``keys``, and which."""
    total = len(w.start)
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p = np.arange(total - n + 1)
    h = run.of(p, p + n)
    p = np.flatnonzero(bitmap[(h & np.uint64(_BITMAP - 1)).astype(np.int64)])
    p = p[w.row[p] == w.row[p + n - 1]]
    at = np.minimum(np.searchsorted(keys, h[p]), len(keys) - 1)
    hit = keys[at] == h[p]
    return p[hit], at[hit]


def token_counts(docs: DataFrame, shared) -> DataFrame:
    """(``n``, ``token``, ``count``) over all documents, summed by Spark."""
    def run(batches):
        b_ = shared.value
        maps = {n: _bitmap(k) for n, k in b_.tokens.items()}
        total = {n: np.zeros(len(k), np.int64) for n, k in b_.tokens.items()}
        for b in batches:
            for _, _, w in batch_words(b.columns[0], _ALNUM, True):
                r = Running(w.hashes())
                for n, keys in b_.tokens.items():
                    total[n] += np.bincount(_matches(w, r, n, keys, maps[n])[1], minlength=len(keys))
        for n, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(at), pa.array(c[at])],
                                             ["n", "token", "count"])

    parts = docs.select("_text").mapInArrow(run, "n int, token long, count long")
    return parts.groupBy("n", "token").agg(F.sum("count").alias("count"))


def _spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Union of intervals as a flat array of starts and ends."""
    o = np.argsort(start, kind="stable")
    start, end = start[o], np.maximum.accumulate(end[o])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return np.stack([start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], 1).reshape(-1)


def block_hits(docs: DataFrame, shared, keep: list[str], window: int = WINDOW) -> DataFrame:
    """``keep`` with ``n_words``, ``spans`` (word intervals hit) and ``records`` (their ids)."""
    def run(batches):
        k = shared.value
        maps = {n: _bitmap(p[0]) for n, p in k.prefix.items()}
        for b in batches:
            n_words, spans, records = np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)], [set() for _ in range(b.num_rows)]
            for lo, hi, w in batch_words(b.columns[-1], _ALNUM, True, overlap=window - 1):
                n_words[lo:hi] += np.diff(w.first) - w.fresh
                r, found = Running(w.hashes()), []
                for n, (keys, first, record, offset) in k.prefix.items():
                    p, at = _matches(w, r, n, keys, maps[n])
                    many = first[at + 1] - first[at]  # records with this prefix
                    entry = np.repeat(first[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    rec, start, row = record[entry], np.repeat(p, many) - offset[entry], np.repeat(w.row[p], many)
                    end = start + k.length[rec]
                    fits = np.flatnonzero((start >= w.first[row]) & (end <= w.first[row + 1]))
                    rec, start, end, row = rec[fits], start[fits], end[fits], row[fits]
                    same = np.flatnonzero(r.of(start, end) == k.whole[rec])
                    for i in same.tolist():
                        if b" ".join(w.word(j) for j in range(start[i], end[i])) == k.texts[rec[i]]:
                            found.append((row[i], start[i], end[i], rec[i]))
                if found:
                    f = np.array(found, np.int64)
                    f = f[np.argsort(f[:, 0], kind="stable")]
                    for g in np.split(f, np.flatnonzero(np.diff(f[:, 0])) + 1):
                        d, base = int(g[0, 0]), w.first[g[0, 0]] - w.before
                        spans[lo + d].append(_spans(g[:, 1] - base, g[:, 2] - base).astype(np.int64).tobytes())
                        records[lo + d] |= {k.ids[rec] for rec in g[:, 3].tolist()}
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(n_words), pa.array([b"".join(s) for s in spans], pa.binary()),
                 pa.array([sorted(i) for i in records], pa.list_(pa.int64()))],
                [*keep, "n_words", "spans", "records"])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("n_words", T.LongType()),
                           T.StructField("spans", T.BinaryType()), T.StructField("records", T.ArrayType(T.LongType()))])
    return docs.select(*keep, "_text").mapInArrow(run, schema)


def record_hits(docs: DataFrame, windows: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, text: str = "text",
                doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``_k`` (``row_key``), n_words,
    n_hit, ``records`` (the ids found, in order). ``windows`` has (``id``, ``words``)."""
    size = windows.agg(F.sum(F.octet_length("words") + 8)).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    part = F.pmod(F.xxhash64("words"), F.lit(n_blocks))
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("_k"),
                       F.col(text).cast("string").alias("_text"))
    sc, hits = docs.sparkSession.sparkContext, []
    for i in range(n_blocks):
        block = Block(windows.where(part == i).toArrow().to_pylist(), shingle)  # distinct windows: bounded by block_bytes
        if n_blocks > 1 or block.texts:
            counts = token_counts(rows, sc.broadcast(block)).toArrow().to_pylist()
            block.order({(r["n"], r["token"]): r["count"] for r in counts})
        hits.append(block_hits(rows, sc.broadcast(block), ["doc_id", "_k"], window))
    found = hits[0].select("doc_id", "_k", "n_words", F.array("spans").alias("spans"), "records")
    if n_blocks > 1:  # rows of equal key have equal results in each block
        every = hits[0]
        for h in hits[1:]:
            every = every.unionByName(h)
        every = every.groupBy("doc_id", "_k", "n_words").agg(
            F.collect_set("spans").alias("spans"), F.sort_array(F.flatten(F.collect_set("records"))).alias("records"),
            (F.count(F.lit(1)) / n_blocks).cast("int").alias("_rows"))
        found = every.withColumn("_rows", F.explode(F.sequence(F.lit(1), "_rows"))).drop("_rows")

    def finish(batches):
        for b in batches:
            n_hit = []
            for spans in b.column("spans").to_pylist():
                s = np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)
                s = _spans(s[:, 0], s[:, 1]) if len(s) else np.zeros(0, np.int64)
                n_hit.append(int((s[1::2] - s[::2]).sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n_hit, pa.int64()), b.column("records")],
                                             ["doc_id", "_k", "n_words", "n_hit", "records"])

    schema = T.StructType([*found.select("doc_id", "_k", "n_words").schema.fields, T.StructField("n_hit", T.LongType()),
                           T.StructField("records", T.ArrayType(T.LongType()))])
    return found.mapInArrow(finish, schema)


def numbered(windows: DataFrame) -> DataFrame:
    """The distinct windows (``id``, ``words``); written, so that ids stay."""
    return save(windows.select("words").distinct().select(F.monotonically_increasing_id().alias("id"), "words"), "records")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, **settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``_k`` (``row_key``), n_words,
    n_hit, n_items, items_sha256, contaminated. For ``settings`` see ``record_hits``."""
    windows = save(item_windows(items, window), "windows")
    records = numbered(windows)
    found = save(record_hits(docs, records, window, **settings), "record-hits")
    some = F.size("records") > 0
    hit = found.where(some).withColumn("_set", F.sha2(F.array_join(F.col("records").cast("array<string>"), ","), 256))
    sets = hit.select("_set", "records").dropDuplicates(["_set"]).select("_set", F.explode("records").alias("id"))
    named = (sets.join(records, "id").join(windows, "words").groupBy("_set").agg(F.collect_set("item").alias("_items"))
             .select("_set", F.size("_items").cast("long").alias("n_items"),
                     F.sha2(F.array_join(F.sort_array("_items"), ","), 256).alias("items_sha256")))
    cols = ["doc_id", "_k", "n_words", "n_hit", "n_items", "items_sha256"]
    clean_rows = found.where(~some).withColumns({"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)})
    return (hit.join(named, "_set").select(*cols).unionByName(clean_rows.select(*cols))
            .withColumn("contaminated", F.col("n_hit") > 0))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, **settings) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item."""
    text, doc_id = settings.get("text", "text"), settings.get("doc_id", "doc_id")
    found = record_hits(docs, numbered(item_windows(items, window)), window, **settings)
    bad = found.where("n_hit > 0").select(F.col("_k").alias("_bad")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), row_key(F.col(doc_id), F.col(text)).alias("_k"))
    return rows.join(save(bad, "contaminated"), F.col("_k") == F.col("_bad"), "left_anti").select("_row.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items found in every document."""
    found = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.drop("_k")


_WORDS = r"""list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
OP3_SQL = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS words FROM documents),
item AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(words), {WINDOW}) AS n,
         array_to_string(words[i: i + least(len(words), {WINDOW}) - 1], ' ') AS w
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - {WINDOW} + 1, 1) + 1)) AS i FROM item
        WHERE len(words) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
gram AS (
  SELECT doc_id, i, n, array_to_string(words[i: i + n - 1], ' ') AS w
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM doc, sizes WHERE len(words) >= n)
),
hit AS (SELECT g.doc_id, g.i, g.n, v.item_id FROM gram g JOIN win v ON g.n = v.n AND g.w = v.w),
word AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range({WINDOW}) r(k) WHERE k < n GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN word USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
