"""textlens: supervised text classification on Spark DataFrames.

Hashed n-gram TF / TF-IDF and SPPMI co-occurrence features, Naive Bayes and
logistic-regression classifiers, batch and streaming scoring, k-fold
evaluation. Every operator is a function ``DataFrame -> DataFrame``; the
model arithmetic stays in Spark plans.
"""

from textlens.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
