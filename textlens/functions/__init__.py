"""Column expressions (JVM-side, no Python UDFs)."""

from textlens.functions.text import (
    bucket_of, clean_text, ngrams, run_lengths, sorted_buckets, tokens,
)
from textlens.functions.mathfn import rounded, sigmoid

__all__ = ["bucket_of", "clean_text", "ngrams", "run_lengths", "sorted_buckets", "tokens", "rounded", "sigmoid"]
