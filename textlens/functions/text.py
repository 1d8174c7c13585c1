"""Text scalar functions: tokenising, n-gram windows, the bucket hash and
delimiter cleaning. All are built-in Spark expressions, so they run in the
JVM next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _empty_strings() -> Column:
    return F.array().cast("array<string>")


def tokens(text: Column) -> Column:
    """Split on one space like Java ``String.split(" ")``.

    Case and punctuation are kept, newlines are not delimiters, leading and
    inner empty tokens are kept, trailing empty tokens are dropped. ``''``
    gives one empty token; text made only of spaces gives no token.
    """
    stripped = F.rtrim(text)  # removes trailing U+0020 only
    return (F.when(text == "", F.array(F.lit("")))
            .when(stripped == "", _empty_strings())
            .otherwise(F.split(stripped, " ")))


def ngrams(words: Column, n: int) -> Column:
    """Sliding windows of exactly ``n`` tokens joined with no separator.

    Fewer than ``n`` tokens give one gram of all of them; no token gives none.
    The windows are built by zipping ``n`` shifted slices, so ``words`` is
    only ever an argument of the higher-order functions (evaluated once per
    row), never read inside a lambda body.
    """
    if n < 1:
        raise ValueError("n must be >= 1")
    if n == 1:
        return words
    size = F.size(words)
    m = size - n + 1
    grams = F.slice(words, 1, m)
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(words, k + 1, m), lambda a, b: F.concat(a, b))
    return (F.when(size == 0, _empty_strings())
            .when(size < n, F.array(F.array_join(words, "")))
            .otherwise(grams))


def bucket_of(gram: Column, num_features: int) -> Column:
    """Feature bucket of a gram: first 32 bits of its MD5, modulo ``num_features``.

    The same value is computable in plain SQL engines, which is what makes the
    feature tables checkable against an independent oracle.
    """
    return F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("bigint") % F.lit(num_features).cast("bigint")


def sorted_buckets(grams: Column, num_features: int) -> Column:
    """Sorted ``array<bigint>`` of the buckets of every gram of a row."""
    return F.sort_array(F.transform(grams, lambda g: bucket_of(g, num_features)))


def run_lengths(b: Column) -> Column:
    """Run-length encode a sorted ``array<bigint>`` into
    ``array<struct<bucket:bigint, tf:bigint>>`` (one entry per distinct
    bucket, in bucket order). Linear in the array length: ``b`` is compared
    with its own one-step shifts through ``zip_with``.
    """
    n = F.size(b)
    null = F.lit(None).cast("bigint")
    prev = F.concat(F.array(null), F.slice(b, 1, n - 1))
    nxt = F.concat(F.slice(b, 2, n - 1), F.array(null))
    first = F.zip_with(b, prev, lambda x, p: p.isNull() | (x != p))
    last = F.zip_with(b, nxt, lambda x, q: q.isNull() | (x != q))
    pos = F.sequence(F.lit(1), n)

    def keep(values, flags):
        return F.filter(F.zip_with(values, flags, lambda v, f: F.when(f, v)), lambda v: v.isNotNull())

    counts = F.zip_with(keep(pos, first), keep(pos, last), lambda s, e: (e - s + 1).cast("bigint"))
    runs = F.zip_with(keep(b, first), counts,
                      lambda k, c: F.struct(k.alias("bucket"), c.alias("tf")))
    return F.when(n == 0, F.array().cast("array<struct<bucket:bigint,tf:bigint>>")).otherwise(runs)


def clean_text(text: Column) -> Column:
    """Replace the record delimiters ``|`` and ``:`` (and CR/LF, so one row
    stays one line) with a space."""
    return F.regexp_replace(text, r"[|:\r\n]", " ")
