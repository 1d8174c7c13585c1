"""Substring dedup over words by recompression.

Texts are named bottom up by the locally consistent rounds of ``recompress``;
equal stretches get equal high-level symbols wherever they occur.

1. Round one (Spark): every group of texts sends the names of its anchors,
   each once; names that two groups sent, or that occur twice in one group,
   are shared. Everything else is dropped here: a window of words that occurs
   anywhere else has a shared anchor.
2. Round two: windows with a shared anchor are named by 64-bit digests of
   their words, and those met in a bucket chosen by further independent bits
   are verified; the more data, the more buckets, so the bits that two
   windows must share grow with the data (72 for 1 GB, 88 for 100 TB).
   Again each group sends a repeated one once and knows its own repeats.
3. The places go back to the groups, where the covered words are removed.

The texts are shuffled once (``groups``). No step pairs occurrences, so a
passage in a third of all documents costs what its words cost.

Defined cases: null, empty and blank texts have no words; texts with fewer
words than the window lose nothing; rows that repeat id and text count as
further occurrences; null ids are ids like others; an empty table gives no
rows. The text that is returned has its words joined by one space. Columns
``n_words`` and ``n_removed`` replace such columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.llm.common import read
from textlens.llm.groups import GROUP_BYTES, SENT, by_bucket, deal, meet, sent, texts, unpack, visit, visit_with
from textlens.llm.recompress import Schedule, anchors, schedule
from textlens.llm.words import Running, batch_words, byte_class, mix, split_pieces

WINDOW = 35
_BLANK = byte_class("blank")
_PLACE = np.dtype([("digest", "<u8"), ("at", "<u4")])


def _shared_names(table: pa.Table, plan: Schedule) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor names of the group, and whether each occurs twice."""
    names = []
    for _, _, w in batch_words(texts(table), _BLANK, False, overlap=plan.window - 1):
        _, name, pick = anchors(w, plan)
        new = np.ones(len(pick), bool)
        new[1:] = pick[1:] != pick[:-1]
        names.append(name[new])
    name, n = np.unique(np.concatenate(names) if names else np.zeros(0, np.uint64), return_counts=True)
    return name, n > 1


def _twice(key: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    o = np.argsort(key, kind="stable")
    same = key[o][1:] == key[o][:-1]
    out = np.zeros(len(key), bool)
    out[o[1:][same]] = True
    out[o[:-1][same]] = True
    return out


def repeated_windows(rows: DataFrame, n_groups: int, plan: Schedule) -> DataFrame:
    """(``_db``, ``recs``: windows of that group that occur elsewhere)."""
    def send_names(db: int, table: pa.Table) -> pa.Table:
        name, _ = _shared_names(table, plan)
        return sent([(b, db, v.tobytes(), b"") for b, v in by_bucket((mix(name) % np.uint64(n_groups)).astype(np.int32), name)])

    names = meet(visit(rows, send_names, SENT), "<u8", lambda name, db: _twice(name))

    def send_windows(table: pa.Table, facts: pa.Table) -> pa.Table:
        if not table.num_rows:
            return sent([])
        db = table.column("_db")[0].as_py()
        own, twice = _shared_names(table, plan)
        known = unpack(facts.column("recs"), "<u8")
        shared = np.unique(np.concatenate([own[twice], *known]))
        base, digests, spread, places = 0, [], [], []
        for _, _, w in batch_words(texts(table), _BLANK, False, overlap=plan.window - 1):
            base -= w.fresh
            start, name, _ = anchors(w, plan)
            if len(start) and len(shared):
                hit = shared[np.minimum(np.searchsorted(shared, name), len(shared) - 1)] == name
                s = start[hit]
                d = mix(Running(w.hashes()).of(s, s + plan.window))
                digests.append(d)
                spread.append(mix(name[hit] ^ mix(d)))
                places.append(s + base)
            base += len(w.start)
        if not digests:
            return sent([])
        recs = np.zeros(sum(map(len, digests)), _PLACE)
        recs["digest"], recs["at"] = np.concatenate(digests), np.concatenate(places)
        bucket = np.concatenate(spread)
        o = np.lexsort((recs["at"], bucket, recs["digest"]))
        recs, bucket = recs[o], bucket[o]
        same = (recs["digest"][1:] == recs["digest"][:-1]) & (bucket[1:] == bucket[:-1])
        first = np.concatenate([[True], ~same])
        again = np.zeros(len(recs), bool)
        again[1:] |= same
        again[:-1] |= same
        out = [(b, db, r.tobytes(), b"") for b, r in
               by_bucket((bucket[first] % np.uint64(n_groups)).astype(np.int32), recs[first])]
        out.append((db, db, b"", recs[again].tobytes()))
        return sent(out)

    windows = visit_with(rows, names, send_windows, SENT)
    return meet(windows, _PLACE, lambda r, db: _twice(r["digest"]))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
                     group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` with its texts rewritten, ``n_words`` (before) and ``n_removed``."""
    docs = docs.drop("n_words", "n_removed")
    rows, n_groups = deal(docs, doc_id, text, group_bytes)
    facts = repeated_windows(rows, n_groups, schedule(window))

    def rewrite(table: pa.Table, facts: pa.Table) -> pa.Table:
        starts = np.concatenate([np.zeros(0, np.int64), *[r["at"].astype(np.int64) for r in unpack(facts.column("recs"), _PLACE)]])
        starts = np.unique(starts)
        kept, n_words, n_removed, base = [], [], [], 0
        ends = starts + window
        for t in (table.column("_bytes") if table.num_rows else []):
            parts, first, lost = [], base, 0
            for words in split_pieces(t.as_py()):
                n = len(words)
                lo, hi = np.searchsorted(ends, base, "right"), np.searchsorted(starts, base + n)
                if hi > lo:  # windows that cover words of this piece; none crosses the end of a text
                    gone = np.zeros(n + 1, np.int32)
                    np.add.at(gone, np.maximum(starts[lo:hi] - base, 0), 1)
                    np.add.at(gone, np.minimum(ends[lo:hi] - base, n), -1)
                    stays = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    lost += n - len(stays)
                    words = [words[i] for i in stays.tolist()]
                parts += [b" ".join(words)] if words else []
                base += n
            kept.append(b" ".join(parts))
            n_words.append(base - first)
            n_removed.append(lost)
        return pa.table([table.column("_row"), pa.array(kept, pa.binary()).cast(pa.string()),
                         pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                        ["_row", "_kept", "n_words", "n_removed"])

    schema = T.StructType([rows.schema["_row"], T.StructField("_kept", T.StringType()),
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = visit_with(rows, facts, rewrite, schema)
    return out.select("_row.*", F.col("_kept").alias(text), "n_words", "n_removed")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, words removed, digest of the rest."""
    out = dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = rf"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(words[i: i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW} + 2)) AS i FROM doc)
), often AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM often, range({WINDOW}) r(k)
), word AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM doc
), kept AS (
  SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS s, count(*) AS n
  FROM word w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i WHERE g.i IS NULL GROUP BY w.doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.s, '')) AS kept_sha256
FROM doc d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
