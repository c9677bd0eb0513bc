"""Element-wise algebra of two matrices: unions with a sum, and inner joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as num
from ..plans.matrix import DenseMatrix, SparseMatrix, Vector, check
from .blocks import laid_out, sorted_entries


def _same(a, b) -> str:
    check(a.shape == b.shape, f"shapes {a.shape} and {b.shape} differ")
    return num.common_dtype(a.dtype, b.dtype)


def add(a: SparseMatrix, b: SparseMatrix) -> SparseMatrix:
    """Entries of either; a sum of zero stays stored. A union with a sum needs one shuffle, pre-aggregated."""
    dtype = _same(a, b)
    both = a.astype(dtype).df.unionByName(b.astype(dtype).df)
    return SparseMatrix(both.groupBy("i", "j").agg(num.total(F.col("v"), dtype).alias("v")), a.shape, dtype, a.format)


def multiply(a: SparseMatrix, b: SparseMatrix) -> SparseMatrix:
    """Entries that both store."""
    dtype = _same(a, b)
    x, y = a.astype(dtype).df, b.astype(dtype).df.withColumnRenamed("v", "w")
    return SparseMatrix(x.join(y, ["i", "j"]).select("i", "j", num.multiply(F.col("v"), F.col("w"), dtype).alias("v")), a.shape, dtype, a.format)


def multiply_dense(a: SparseMatrix, b: DenseMatrix | Vector) -> SparseMatrix:
    """Each entry times the dense value at its place. A one-row or one-column matrix is repeated, a vector is a row."""
    dtype = num.common_dtype(a.dtype, b.dtype)
    m, n = a.shape
    if isinstance(b, Vector):
        check(b.size == n, f"a row of {n} values is needed")
        values, key = b.df.select(F.col("i").alias("j"), F.col("v").alias("w")), "j"
    elif b.shape == (m, n):
        values, key = b.df.select("i", "row"), "i"
    elif b.shape == (1, n):
        values, key = b.long().select("j", F.col("v").alias("w")), "j"
    elif b.shape == (m, 1):
        values, key = b.df.select("i", F.col("row")[0].alias("w")), "i"
    else:
        raise ValueError(f"shapes {a.shape} and {b.shape} do not fit")
    joined = a.astype(dtype).df.join(values, key, "left" if isinstance(b, Vector) else "inner")
    weight = F.get("row", F.col("j").cast("int")) if "row" in joined.columns else F.coalesce("w", num.zero(b.dtype))
    return SparseMatrix(joined.select("i", "j", num.multiply(F.col("v"), num.convert(weight, b.dtype, dtype), dtype).alias("v")), a.shape, dtype, a.format)


def add_dense(a: SparseMatrix, b: DenseMatrix) -> DenseMatrix:
    """A dense sum; each dense row takes the entries of its row."""
    check(a.shape == b.shape, f"shapes {a.shape} and {b.shape} differ")
    entries = a.astype("float64").df.groupBy("i").agg(sorted_entries("j", "v").alias("_e"))
    value = F.zip_with("row", laid_out(F.col("_e"), F.size("row"), F.lit(0.0)), lambda x, y: x + y)
    return DenseMatrix(b.df.join(entries, "i", "left").select("i", F.when(F.col("_e").isNull(), F.col("row")).otherwise(value).alias("row")), a.shape)
