"""Token counts of whole texts by a public tokenizer.

Texts go to the executors in Arrow batches and only counts come back. Inside
a task texts are regrouped into calls of about ``CALL_BYTES`` bytes, so a call
holds many short texts or a few long ones; a text longer than ``PART_BYTES``
is split at safe boundaries and its parts may fall into different calls.

A safe boundary is one single space between two other characters: no piece of
the vocabulary has its space mark after another character (checked when the
model is loaded), so no merge crosses it, and the mark that the encoder puts
before each text stands for the dropped space. A text without such a place is
encoded in one piece. Nothing is ever cut off.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows
are counted each; an empty table gives no rows; further columns are kept by
``count_tokens`` (``n_bytes`` and ``n_tokens`` replace columns of that name).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlens.llm.common import fresh, read

MODEL, LIMIT = "piece_bpe_32k.model", 4096
PART_BYTES, CALL_BYTES = 32 << 10, 1 << 20
_MARK = "▁"
_SAFE = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")


def load(model: str):
    """The sentencepiece model, after the check that the split relies on."""
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    if any(_MARK in p.lstrip(_MARK) for p in pieces) or sp.encode("a b", out_type=str)[0][0] != _MARK:
        raise ValueError(f"{model}: pieces cross spaces; texts can't be split")
    return sp


def parts(text: str, most: int) -> Iterator[str]:
    """``text`` in parts of about ``most`` characters, cut at safe boundaries
    (longer where there is none)."""
    at = 0
    while len(text) - at > most:
        cut = _SAFE.search(text, at + most)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.end()
    yield text[at:]


def count_batches(batches: Iterator[pa.RecordBatch], model: str, part: int, call: int) -> Iterator[pa.RecordBatch]:
    """Replace the last column, the texts, by the two counts."""
    sp = load(model)
    for b in batches:
        texts = b.columns[-1].fill_null("")
        counts = [0] * len(texts)
        rows, group, held = [], [], 0

        def flush():
            for i, ids in zip(rows, sp.encode(group, num_threads=1), strict=True):
                counts[i] += len(ids)
            rows.clear()
            group.clear()

        for i, s in enumerate(texts):
            for p in parts(s.as_py(), part):
                rows.append(i)
                group.append(p)
                held += len(p)
                if held >= call:
                    flush()
                    held = 0
        flush()
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:-1], pc.binary_length(texts.cast(pa.binary())).cast(pa.int64()), pa.array(counts, pa.int64())],
            [*b.schema.names[:-1], "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, model: str = MODEL, text: str = "text", part: int = PART_BYTES,
                 call: int = CALL_BYTES) -> DataFrame:
    """``docs`` without its text but with ``n_bytes`` and ``n_tokens``."""
    keep = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens")]
    rows = docs.select(*keep, F.col(text).cast("string").alias(fresh(docs, "_text")))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(lambda it: count_batches(it, model, part, call), schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the 32k BPE piece model."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > LIMIT)
