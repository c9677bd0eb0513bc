"""Diagonals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as num
from ..plans.matrix import SparseMatrix, Vector


def diagonal(a: SparseMatrix, k: int = 0) -> Vector:
    """The k-th diagonal with its zeros; empty where k lies outside of the matrix."""
    m, n = a.shape
    length = max(0, min(m + min(k, 0), n - max(k, 0)))
    entries = a.df.where(F.col("j") - F.col("i") == k).select(F.least("i", "j").alias("i"), "v")
    summed = entries.groupBy("i").agg(num.total(F.col("v"), a.dtype).alias("v"))
    return Vector(Vector(summed, length, a.dtype).filled(), length, a.dtype)
