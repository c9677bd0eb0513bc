"""Handles: a relation together with the shape and type that the relation itself cannot tell.

A sparse matrix is a table (i, j, v) of its stored entries, a vector a table (i, v) whose missing rows are zero, a
dense matrix a table (i, row) of arrays. Handles are immutable; every method gives a new handle over a lazy plan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as num
from .ordering import numbered

FORMATS = ("coo", "csr", "csc", "dia")


def check(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class Vector:
    df: DataFrame
    size: int
    dtype: str = "float64"

    @property
    def spark(self):
        return self.df.sparkSession

    def astype(self, dtype: str) -> Vector:
        return Vector(self.df.select("i", num.convert(F.col("v"), self.dtype, dtype).alias("v")), self.size, dtype)

    def filled(self) -> DataFrame:
        """(i, v) with the zeros that the relation leaves out."""
        rows = self.spark.range(self.size).select(F.col("id").alias("i"))
        return rows.join(self.df, "i", "left").select("i", F.coalesce("v", num.zero(self.dtype)).alias("v"))

    def dot(self, other: Vector) -> float:
        x, y = self.df.select("i", F.col("v").alias("x")), other.df.select("i", F.col("v").alias("y"))
        return x.join(y, "i").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0))).first()[0]

    def norm(self) -> float:
        return self.df.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)))).first()[0]


@dataclass(frozen=True)
class DenseMatrix:
    df: DataFrame
    shape: tuple[int, int]
    dtype: str = "float64"

    def long(self) -> DataFrame:
        """(i, j, v) with every cell."""
        return self.df.select("i", F.posexplode("row").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")


@dataclass(frozen=True)
class DenseBlocks:
    """(bi, bj, cells): squares of side rows and columns (less at the lower and right border), each an array by row. No value
    grows with the matrix."""

    df: DataFrame
    shape: tuple[int, int]
    side: int
    dtype: str = "float64"

    def width(self, bj: Column) -> Column:
        """Columns of a block."""
        return F.least(F.lit(self.side), F.lit(self.shape[1]) - bj * self.side).cast("int")

    def height(self, bi: Column) -> Column:
        return F.least(F.lit(self.side), F.lit(self.shape[0]) - bi * self.side).cast("int")

    def long(self) -> DataFrame:
        """(i, j, v) with every cell."""
        cells = self.df.select("bi", "bj", F.posexplode("cells").alias("_k", "v")).withColumn("_w", self.width(F.col("bj")))
        i, j = F.col("bi") * self.side + F.floor(F.col("_k") / F.col("_w")), F.col("bj") * self.side + F.col("_k") % F.col("_w")
        return cells.select(i.cast("long").alias("i"), j.cast("long").alias("j"), "v")


@dataclass(frozen=True)
class SparseMatrix:
    df: DataFrame
    shape: tuple[int, int]
    dtype: str = "float64"
    format: str = "coo"

    def __post_init__(self):
        check(len(self.shape) == 2 and all(n >= 0 for n in self.shape), f"a shape of two sizes is needed, not {self.shape}")
        check(self.format in FORMATS, f"unknown format {self.format}")

    @property
    def spark(self):
        return self.df.sparkSession

    def over(self, df: DataFrame, **changes) -> SparseMatrix:
        return replace(self, df=df.select("i", "j", "v"), **changes)

    def with_data(self, f) -> SparseMatrix:
        """The same structure with f(v) for each stored value."""
        return self.over(self.df.withColumn("v", f(F.col("v"))))

    # formats
    def asformat(self, name: str | None) -> SparseMatrix:
        check(name is None or name in FORMATS, f"unknown format {name}")
        return self if name in (None, self.format) else replace(self, format=name)

    def tocoo(self):
        return self.asformat("coo")

    def tocsr(self):
        return self.asformat("csr")

    def tocsc(self):
        return self.asformat("csc")

    def todia(self):
        return self.asformat("dia")

    def copy(self):
        return self

    def astype(self, dtype: str) -> SparseMatrix:
        return replace(self.with_data(lambda v: num.convert(v, self.dtype, dtype)), dtype=dtype)

    def todense(self) -> DenseMatrix:
        from ..operators.convert import to_dense

        return to_dense(self)

    def toblocks(self, side: int | None = None) -> DenseBlocks:
        from ..operators.blocks import SIDE, to_blocks

        return to_blocks(self, side or SIDE)

    # structure
    @property
    def T(self) -> SparseMatrix:
        return self.transpose()

    def transpose(self) -> SparseMatrix:
        flipped = {"csr": "csc", "csc": "csr"}.get(self.format, self.format)
        return replace(self, df=self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), shape=self.shape[::-1], format=flipped)

    def conj(self) -> SparseMatrix:
        return self.with_data(lambda v: num.conjugate(v, self.dtype))

    @property
    def nnz(self) -> int:
        return self.df.count()

    def entries(self) -> DataFrame:
        """(k, i, j, v): the stored entries numbered in their order, by column for csc and by row for all others."""
        order = ["j", "i"] if self.format == "csc" else ["i", "j"]
        return numbered(self.df, [F.col(c) for c in order], "k").select("k", "i", "j", "v")

    @property
    def data(self) -> DataFrame:
        """(k, v) in the order of entries."""
        return self.entries().select("k", "v")

    @property
    def row(self) -> DataFrame:
        """(k, i) in the order of entries."""
        return self.entries().select("k", "i")

    @property
    def col(self) -> DataFrame:
        """(k, j) in the order of entries."""
        return self.entries().select("k", "j")

    @property
    def indices(self) -> DataFrame:
        """(k, index): columns of a csr matrix, rows of a csc matrix."""
        check(self.format in ("csr", "csc"), "indices are of compressed formats")
        return self.entries().select("k", F.col("i" if self.format == "csc" else "j").alias("index"))

    @property
    def indptr(self) -> DataFrame:
        """(i, start, end): the stretch of entries of each row of a csr matrix, column of a csc matrix."""
        from ..operators.convert import row_pointers

        check(self.format in ("csr", "csc"), "pointers are of compressed formats")
        return row_pointers(self.transpose() if self.format == "csc" else self).select("i", "start", "end")

    def with_indices(self, indices: DataFrame) -> SparseMatrix:
        """The matrix with other indices (k, index), the values and the pointers staying."""
        check(self.format in ("csr", "csc"), "indices are of compressed formats")
        place = "i" if self.format == "csc" else "j"
        return self.over(self.entries().drop(place).join(indices.select("k", F.col("index").cast("long").alias(place)), "k"))

    def diagonal(self, k: int = 0) -> Vector:
        from ..operators.structure import diagonal

        return diagonal(self, k)

    def sum(self, axis: int | None = None, dtype: str | None = None):
        from ..operators.reduce import total

        return total(self, axis, dtype)

    def balance(self, partitions: int | None = None) -> SparseMatrix:
        from ..operators.partitioned import balance

        return balance(self, partitions)

    # arithmetic
    def _value(self, s) -> tuple[Column, str]:
        dtype = num.common_dtype(self.dtype, "complex128" if isinstance(s, complex) else "float64" if isinstance(s, float) else self.dtype)
        return num.as_literal(s, dtype), dtype

    def scale(self, s) -> SparseMatrix:
        value, dtype = self._value(s)
        return self.astype(dtype).with_data(lambda v: num.multiply(v, value, dtype))

    def __neg__(self):
        return self.with_data(lambda v: num.negate(v, self.dtype))

    def __mul__(self, other):
        return self.multiply(other)

    def __rmul__(self, other):
        return self.multiply(other)

    def multiply(self, other):
        from ..operators import elementwise

        if isinstance(other, SparseMatrix):
            return elementwise.multiply(self, other)
        if isinstance(other, DenseMatrix | Vector):
            return elementwise.multiply_dense(self, other)
        return self.scale(other)

    def __add__(self, other):
        from ..operators import elementwise

        if isinstance(other, DenseMatrix):
            return elementwise.add_dense(self, other)
        if isinstance(other, DenseBlocks):
            from ..operators.blocks import add_blocks

            return add_blocks(self, other)
        if not isinstance(other, SparseMatrix):
            raise TypeError("only a matrix can be added to a matrix")
        return elementwise.add(self, other)

    def __sub__(self, other):
        if not isinstance(other, SparseMatrix):
            raise TypeError("only a matrix can be subtracted from a matrix")
        return self + (-other)

    def power(self, n, dtype: str | None = None):
        out = self.with_data(lambda v: F.pow(v, F.lit(n)).cast(num.spark_type(self.dtype)))
        return out.astype(dtype) if dtype else out

    def __rtruediv__(self, s):
        return self.astype("float64").with_data(lambda v: num.divide(F.lit(float(s)), v))

    # products
    def dot(self, other, **options):
        from ..operators import products

        if isinstance(other, Vector):
            return products.spmv(self, other, **options)
        if isinstance(other, DenseMatrix):
            return products.spmm(self, other)
        if isinstance(other, SparseMatrix):
            if (self.format, other.format) == ("csr", "csc") and not options:
                from ..operators.partitioned import spgemm_grid

                return spgemm_grid(self, other)
            return products.spgemm(self, other, **options)
        raise TypeError("a product takes a vector or a matrix")

    def __matmul__(self, other):
        return self.dot(other)

    matvec = dot

    def __rmatmul__(self, other: DenseMatrix | DenseBlocks) -> DenseMatrix | DenseBlocks:
        if isinstance(other, DenseBlocks):
            from ..operators.blocks import blocks_times_sparse

            return blocks_times_sparse(other, self)
        from ..operators.products import dense_times_sparse

        return dense_times_sparse(other, self)

    def sddmm(self, c: DenseMatrix, d: DenseMatrix) -> SparseMatrix:
        from ..operators.products import sddmm

        return sddmm(self, c, d)

    def tropical_spmv(self, x: DataFrame) -> DataFrame:
        from ..operators.products import tropical_spmv

        return tropical_spmv(self, x)

    def show(self, n: int = 20) -> None:
        self.df.show(n)


def _ufunc(name: str):
    def method(self: SparseMatrix) -> SparseMatrix:
        return self.astype("float64").with_data(num.UFUNCS[name])

    method.__name__ = name
    method.__doc__ = f"{name} of each stored value."
    return method


for _name in num.UFUNCS:
    setattr(SparseMatrix, _name, _ufunc(_name))


def issparse(x) -> bool:
    return isinstance(x, SparseMatrix)


isspmatrix = is_sparse_matrix = issparse


def isspmatrix_coo(x) -> bool:
    return issparse(x) and x.format == "coo"


def isspmatrix_csr(x) -> bool:
    return issparse(x) and x.format == "csr"


def isspmatrix_csc(x) -> bool:
    return issparse(x) and x.format == "csc"


def isspmatrix_dia(x) -> bool:
    return issparse(x) and x.format == "dia"
