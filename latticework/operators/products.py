"""The product family: a join on the shared index, a multiplication, and an aggregate over what is left.

A vector is broadcast where its size, known from the handle's shape, stays under BROADCAST_BYTES; beyond that the
product shuffles both sides on the shared index. Catalyst chooses between hash and merge joins, and sums are
pre-aggregated before the second shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..plans.matrix import DenseBlocks, DenseMatrix, SparseMatrix, Vector, check
from .blocks import row_array, sorted_entries

BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Semiring:
    """multiply maps two columns to one; add is an aggregate of it."""

    multiply: Callable[[Column, Column], Column]
    add: Callable[[Column], Column]


def plus_times(dtype: str) -> Semiring:
    return Semiring(lambda x, y: num.multiply(x, y, dtype), lambda x: num.total(x, dtype))


MIN_PLUS = Semiring(lambda x, y: x + y, F.min)
MAX_PLUS = Semiring(lambda x, y: x + y, F.max)
MAX_MIN = Semiring(F.least, F.max)


def hinted(df: DataFrame, rows: int, bytes_per_row: int = 16) -> DataFrame:
    """df broadcast if the handle's shape bounds it, else left to the planner."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df


def spmv(a: SparseMatrix, x: Vector, column_split: bool = False, semiring: Semiring | None = None) -> Vector:
    """y = A x. column_split: entries and vector meet by column, and partial sums are combined by row, whatever the vector's size."""
    check(a.shape[1] == x.size, f"a vector of {a.shape[1]} is needed, not of {x.size}")
    dtype = num.common_dtype(a.dtype, x.dtype)
    ring = semiring or plus_times(dtype)
    values = x.astype(dtype).df.select(F.col("i").alias("j"), F.col("v").alias("_x"))
    joined = a.astype(dtype).df.join(values if column_split else hinted(values, x.size), "j")
    return Vector(joined.groupBy("i").agg(ring.add(ring.multiply(F.col("v"), F.col("_x"))).alias("v")), a.shape[0], dtype)


def spmv_many(a: SparseMatrix, x: DataFrame, width: int) -> DataFrame:
    """(i, c, v): A times each of `width` vectors, given as (i, c, v) with c their number, through one join."""
    values = x.select(F.col("i").alias("j"), "c", F.col("v").alias("_x"))
    joined = a.astype("float64").df.join(hinted(values, a.shape[1] * width, 24), "j")
    return joined.groupBy("i", "c").agg(F.sum(F.col("v") * F.col("_x")).alias("v"))


def spgemm(a: SparseMatrix, b: SparseMatrix, semiring: Semiring | None = None) -> SparseMatrix:
    """C = A B; an entry whose terms cancel stays stored."""
    check(a.shape[1] == b.shape[0], f"shapes {a.shape} and {b.shape} do not fit")
    dtype = num.common_dtype(a.dtype, b.dtype)
    ring = semiring or plus_times(dtype)
    x = a.astype(dtype).df.select("i", F.col("j").alias("_k"), F.col("v").alias("_a"))
    y = b.astype(dtype).df.select(F.col("i").alias("_k"), "j", F.col("v").alias("_b"))
    cells = x.join(y, "_k").groupBy("i", "j").agg(ring.add(ring.multiply(F.col("_a"), F.col("_b"))).alias("v"))
    return SparseMatrix(cells, (a.shape[0], b.shape[1]), dtype, "csr")


def spgemm_terms(a: SparseMatrix, b: SparseMatrix) -> int:
    """How many products A B takes: the size of its join, from counts per index alone."""
    left, right = a.df.groupBy(F.col("j").alias("k")).agg(F.count("*").alias("x")), b.df.groupBy(F.col("i").alias("k")).agg(F.count("*").alias("y"))
    return left.join(right, "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0))).first()[0]


def spmm(a: SparseMatrix, b: DenseMatrix) -> DenseMatrix:
    """C = A B with dense rows: row i of C sums the rows of B that row i of A names.

    Rows stay arrays: an entry that has met its row of B is one value, never one for each column. Batches add up what
    they hold of a row of C before anything is sent, so that a row with most of the entries comes to its task as one
    array for each batch; there the arrays of a row, which stand together, are added as they come by."""
    check(a.shape[1] == b.shape[0], f"shapes {a.shape} and {b.shape} do not fit")
    m, n = a.shape[0], b.shape[1]
    rows = b.df.select(F.col("i").alias("j"), F.col("row").cast("array<double>").alias("row"))
    joined = a.astype("float64").df.join(hinted(rows, b.shape[0], 8 * max(1, n) + 16), "j")
    parts = joined.select("i", "v", "row").mapInArrow(lambda batches: _added(batches, n), _ROWS)
    sums = parts.repartition("i").sortWithinPartitions("i").mapInArrow(lambda batches: _merged_rows(batches, n), _ROWS)
    every = a.spark.range(m).select(F.col("id").alias("i")).join(sums, "i", "left")
    return DenseMatrix(every.select("i", F.coalesce("row", F.array_repeat(F.lit(0.0), n)).alias("row")), (m, n))


_ROWS = "i long, row array<double>"


def _arrays(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return batch.column("row").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n)


def _as_rows(i: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(len(i) + 1, dtype=np.int32) * rows.shape[1]
    return pa.RecordBatch.from_arrays([pa.array(i), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], names=["i", "row"])


def _sums(i: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with equal numbers added up; numbers ascending."""
    order = np.argsort(i, kind="stable")
    i, rows = i[order], rows[order]
    starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
    return i[starts], np.add.reduceat(rows, starts, axis=0) if rows.shape[1] else rows[starts]


def _added(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            v = batch.column("v").to_numpy(zero_copy_only=False)
            yield _as_rows(*_sums(batch.column("i").to_numpy(), v[:, None] * _arrays(batch, n)))


def _merged_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        i, rows = batch.column("i").to_numpy(), _arrays(batch, n)
        if held is not None:
            i, rows = np.concatenate((held[0], i)), np.concatenate((held[1], rows))
        i, rows = _sums(i, rows)
        held = i[-1:].copy(), rows[-1:].copy()  # its next part may be in the next batch
        if len(i) > 1:
            yield _as_rows(i[:-1], rows[:-1])
    if held is not None:
        yield _as_rows(*held)


def dense_times_sparse(b: DenseMatrix, a: SparseMatrix) -> DenseMatrix:
    """C = B A: the dense matrix in long form meets the entries on the shared index."""
    check(b.shape[1] == a.shape[0], f"shapes {b.shape} and {a.shape} do not fit")
    left = b.long().select("i", F.col("j").alias("_k"), F.col("v").alias("_b"))
    right = a.astype("float64").df.select(F.col("i").alias("_k"), F.col("j").alias("c"), F.col("v").alias("_a"))
    cells = left.join(right, "_k").groupBy("i", "c").agg(F.sum(F.col("_b") * F.col("_a")).alias("v"))
    rows = cells.groupBy("i").agg(sorted_entries("c", "v").alias("_e"))
    every = a.spark.range(b.shape[0]).select(F.col("id").alias("i")).join(rows, "i", "left")
    return DenseMatrix(every.select("i", row_array("_e", a.shape[1]).alias("row")), (b.shape[0], a.shape[1]))


def dot_of(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sddmm(a: SparseMatrix, c: DenseMatrix, d: DenseMatrix | DenseBlocks) -> SparseMatrix:
    """A_ij (C D)_ij where A stores an entry: each entry fetches its row of C and its column of D, arrays as long as the
    factors share an index. D is best given in blocks, where it is wide."""
    check(c.shape[0] == a.shape[0] and d.shape[1] == a.shape[1] and c.shape[1] == d.shape[0], "the factors do not fit the matrix")
    columns = d.long().groupBy(F.col("j")).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("e")).select("j", F.col("e.v").alias("_d"))
    rows = c.df.select("i", F.col("row").alias("_c"))
    width = 8 * c.shape[1] + 16
    joined = a.astype("float64").df.join(hinted(rows, c.shape[0], width), "i").join(hinted(columns, d.shape[1], width), "j")
    return SparseMatrix(joined.select("i", "j", (F.col("v") * dot_of(F.col("_c"), F.col("_d"))).alias("v")), a.shape, "float64", a.format)


def tropical_spmv(a: SparseMatrix, x: DataFrame) -> DataFrame:
    """(i, f...): the lexicographic maximum of the tuples of x at the stored columns of each row, not below zeros.

    x: (i, f0, f1, ...) with long columns; the values of A play no part."""
    fields = [c for c in x.columns if c != "i"]
    tuples = x.select(F.col("i").alias("j"), F.struct(*fields).alias("_t"))
    best = a.df.select("i", "j").join(hinted(tuples, a.shape[1], 8 + 8 * len(fields)), "j").groupBy("i").agg(F.max("_t").alias("_t"))
    least = F.struct(*(F.lit(0).cast("long").alias(f) for f in fields))
    every = a.spark.range(a.shape[0]).select(F.col("id").alias("i")).join(best, "i", "left")
    return every.select("i", F.when(F.col("_t") > least, F.col("_t")).otherwise(least).alias("_t")).select("i", "_t.*")


def axpby(y: Vector, x: Vector, a: float, b: float, alpha: bool = True, negate: bool = False) -> Vector:
    """y + x (a / b) if alpha, else x + y (a / b); negate takes the quotient's opposite. One join, one projection."""
    s = (-1 if negate else 1) * (a / b)
    both = y.df.select("i", F.col("v").alias("_y")).join(x.df.select("i", F.col("v").alias("_x")), "i", "full")
    u, w = F.coalesce("_y", F.lit(0.0)), F.coalesce("_x", F.lit(0.0))
    return Vector(both.select("i", (u + w * s if alpha else w + u * s).alias("v")), y.size)


def cdist(xa: DenseMatrix, xb: DenseMatrix, metric: str = "euclidean") -> DataFrame:
    """(i, j, d): distances of all rows of xa from all rows of xb; the result is dense by definition.

    The side that its shape bounds under BROADCAST_BYTES is broadcast; otherwise both are dealt into blocks of rows that
    meet pairwise on block numbers."""
    check(metric == "euclidean", "only euclidean distances are defined")
    check(xa.shape[1] == xb.shape[1], "points of different dimensions")
    a, b = xa.df.select("i", F.col("row").alias("_a")), xb.df.select(F.col("i").alias("j"), F.col("row").alias("_b"))
    width = 8 * xa.shape[1] + 16
    if min(xa.shape[0], xb.shape[0]) * width <= BROADCAST_BYTES:
        pairs = a.join(F.broadcast(b)) if xb.shape[0] <= xa.shape[0] else F.broadcast(a).join(b)
    else:
        blocks = -(-xb.shape[0] * width // BROADCAST_BYTES)
        left = a.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pairs = left.join(b.withColumn("_block", F.pmod(F.hash("j"), F.lit(blocks))), "_block")
    square = F.aggregate(F.zip_with("_a", "_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return pairs.select("i", "j", F.sqrt(square).alias("d"))


def rk_stage(stages: DataFrame, coefficients: list[float], h: float) -> DataFrame:
    """(i, dy): h times the combination of the stages k0, k1, ... with these coefficients."""
    total = sum((F.col(f"k{s}") * F.lit(float(c)) for s, c in enumerate(coefficients)), F.lit(0.0))
    return stages.select("i", (F.lit(float(h)) * total).alias("dy"))
