"""Co-occurrence and shifted positive PMI.

F4 ``C[i, j]`` = number of documents containing both buckets: the Gramian
of the 0/1 presence matrix (``gramian``): dense partial sums for a small
feature space, tiles that documents are sent to for any other. No self-join,
so a document with many features never multiplies into rows.

F6 ``SPPMI[i, j] = max(0, log2(C[i, j] * N / (C[i, i] * C[j, j])) - log2(k))``.
Only positive entries are kept (sparse); a pair of seen buckets that never
co-occur is ``max(0, -inf) = 0`` and is absent too, and buckets never seen
have no row at all (the dense formula would give 0/0 there). Positivity is
decided exactly, ``C[i, j] * N > k * C[i, i] * C[j, j]`` in 38-digit decimals
(products of counts outgrow 64 bits from about 3e9 documents on); the value
is a sum of logarithms.

F8 is a sparse matrix product, documents x SPPMI rows, done inside the tasks
(``csr``): one row per document comes out, none per (document, bucket, j).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from textlens.operators.csr import row_sums
from textlens.operators.gramian import PAIR_CHUNK, gramian
from textlens.operators.util import bounded_join, broadcast_if_bounded, materialize

COPY_ROWS = 20_000  # queries of one text that share a copy of its vector


def presence_arrays(terms: DataFrame, ids: list[str] = ("doc_id",), terms_col: str = "terms") -> DataFrame:
    """``(ids..., b array<bigint>)``: the distinct buckets of each row, sorted."""
    return terms.select(*ids, F.transform(terms_col, lambda t: t["bucket"]).alias("b"))


def cooccurrence(presence: DataFrame, num_features: int, strategy: str = "auto",
                 pair_chunk: int = PAIR_CHUNK) -> DataFrame:
    """``(i, j, c)`` with ``i <= j`` and ``c > 0`` from ``(…, b array)`` rows.

    ``strategy``: ``dense`` (V x V blocks), ``tiled`` (``sparse`` is the same) or
    ``auto`` (dense up to 2048 features)."""
    return gramian(presence, num_features, "tiled" if strategy == "sparse" else strategy, pair_chunk=pair_chunk)


def fit_sppmi(presence: DataFrame, n_docs, num_features: int, k: float = 10.0,
              strategy: str = "auto") -> tuple[DataFrame, DataFrame]:
    """Co-occurrence and SPPMI, both materialized once (each at most V^2 / 2
    rows) because the diagonal, both triangles and every document vector
    read them: ``(cooc, sppmi)``."""
    cooc = materialize(cooccurrence(presence, num_features, strategy))
    return cooc, materialize(sppmi(cooc, n_docs, k, num_features))


def sppmi(cooc: DataFrame, n_docs, k: float = 10.0, num_features: int | None = None) -> DataFrame:
    """``(i, j, sppmi)`` for ``i <= j``, positive entries only.

    ``n_docs`` is a Column (e.g. a scalar subquery) or a number: N, the
    number of documents of the presence matrix (F5)."""
    n = n_docs if not isinstance(n_docs, (int, float)) else F.lit(int(n_docs))
    diag = cooc.where(F.col("i") == F.col("j")).select("i", F.col("c").alias("cii"))
    bound = num_features if num_features is not None else 1 << 62
    di = broadcast_if_bounded(diag, bound, 24)
    dj = broadcast_if_bounded(diag.select(F.col("i").alias("j"), F.col("cii").alias("cjj")), bound, 24)
    x = cooc.join(di, "i").join(dj, "j").withColumn("_n", n.cast("bigint"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    positive = wide("c") * wide("_n") > F.lit(Decimal(str(k))) * (wide("cii") * wide("cjj"))
    value = F.log2("c") + F.log2("_n") - F.log2("cii") - F.log2("cjj") - F.log2(F.lit(float(k)))
    return x.where(positive).select("i", "j", value.alias("sppmi"))


def sppmi_rows(sp: DataFrame) -> DataFrame:
    """row vectors in long form, both triangles: ``(i, j, s)``."""
    upper = sp.select("i", "j", F.col("sppmi").alias("s"))
    lower = sp.where(F.col("i") != F.col("j")).select(F.col("j").alias("i"), F.col("i").alias("j"),
                                                      F.col("sppmi").alias("s"))
    return upper.unionByName(lower)


def doc_sppmi_sum(presence: DataFrame, rows: DataFrame, num_features: int,
                  ids: list[str] = ("doc_id",), outer: bool = False, packed: bool = False) -> DataFrame:
    """F8 (additive): ``(ids..., j, x)`` = sum of the SPPMI rows of the buckets in
    the array ``b`` of each document (``outer``: a null row keeps each document);
    ``packed``: one row per document, ``j`` and ``x`` arrays."""
    sums = row_sums(presence, rows, num_features, ids)
    if packed:
        return sums
    out = sums.select(*ids, F.explode_outer(F.arrays_zip("j", "x")).alias("_e")).select(*ids, "_e.j", "_e.x")
    return out if outer else out.where(F.col("j").isNotNull())


def doc_sppmi_append(presence: DataFrame, rows: DataFrame, num_features: int,
                     ids: list[str] = ("doc_id",)) -> DataFrame:
    """F9 (appending, the reference's active form): V zeros, then the SPPMI row
    of each present bucket in bucket order. ``(ids..., position, x)`` with
    ``position = V * rank + j`` (rank from 1), non-zero entries only. The rank
    comes from the position in the sorted presence array: no window."""
    # outer variant: plain posexplode infers a size(b) > 0 filter that the
    # optimizer pushes down into the scan, re-running the whole text pipeline
    ranked = (presence.select(*ids, F.posexplode_outer("b").alias("_r", "bucket"))
              .where(F.col("bucket").isNotNull()))
    joined = bounded_join(ranked, rows.withColumnRenamed("i", "bucket"), ["bucket"], "inner",
                          num_features * num_features, 24, salt_col=list(ids)[0])
    return joined.select(
        *ids, (F.lit(num_features) * (F.col("_r") + 1) + F.col("j")).cast("bigint").alias("position"),
        F.col("s").alias("x"))


def packed_vectors(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, _v array<struct<j, x>>)``, one row per key, of vectors in long form
    or with arrays ``j`` and ``x``."""
    if isinstance(vectors.schema["x"].dataType, ArrayType):
        return vectors.groupBy(key).agg(F.flatten(F.collect_list(F.arrays_zip("j", "x"))).alias("_v"))
    return vectors.groupBy(key).agg(F.collect_list(F.struct("j", "x")).alias("_v"))  # at most V entries


def text_vector_lookup(queries: DataFrame, train_texts: DataFrame, train_vectors: DataFrame,
                       ids: list[str] = ("doc_id",), text_col: str = "text", copy_rows: int = COPY_ROWS,
                       outer: bool = False, packed: bool = False) -> DataFrame:
    """vector of a query text = vector of the identical training text.

    Texts are compared by their SHA-256, so no text is shuffled; equal texts
    have equal vectors, so of each distinct training text that queries have
    one vector (that of its lowest doc_id) travels, as one array, to meet them. Only a
    text that more than ``copy_rows`` queries repeat has its vector copied, once for so
    many of them, and its queries are spread over the copies. A text never seen in
    training has no rows (zero vector), or with ``outer`` one row of nulls, as
    has a text whose vector is empty. ``packed``: one row per query, arrays ``j`` and ``x``."""
    reps = (train_texts.select("doc_id", F.sha2(text_col, 256).alias("_h"))
            .groupBy("_h").agg(F.min("doc_id").alias("doc_id")))
    q = queries.select(*[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)], F.sha2(text_col, 256).alias("_h"))
    asked = q.where(F.col("_h").isNotNull()).groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    asked = asked.select("_h", F.ceil(F.col("_n") / copy_rows).cast("int").alias("_copies"))
    places = reps.join(asked, "_h").select("_h", "doc_id", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_salt"))
    vec = packed_vectors(train_vectors).join(places, "doc_id").where(F.size("_v") > 0).select("_h", "_salt", "_v")
    often = asked.where(F.col("_copies") > 1)  # at most one in copy_rows queries
    spread = F.xxhash64(*[f"_id{i}" for i in range(len(ids))])
    salt = F.pmod(spread, F.when(F.col("_h").isNull(), F.lit(1 << 20)).otherwise(F.coalesce("_copies", F.lit(1)))).cast("int")
    q = q.join(F.broadcast(often), "_h", "left").withColumn("_salt", salt)
    out = q.join(vec, ["_h", "_salt"], "left" if outer else "inner")
    named = [F.col(f"_id{i}").alias(c) for i, c in enumerate(ids)]
    if packed:
        return out.select(*named, F.transform("_v", lambda e: e["j"]).alias("j"), F.transform("_v", lambda e: e["x"]).alias("x"))
    return out.select(*named, F.inline_outer("_v"))
