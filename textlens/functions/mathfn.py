"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6


def sigmoid(z: Column) -> Column:
    """Logistic link ``1 / (1 + exp(-z))``; stays finite for large ``|z|``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def rounded(c: Column, digits: int = DIGITS) -> Column:
    """Round a double for cross-engine comparison."""
    return F.round(c.cast("double"), digits)
