"""Layouts other than the canonical entries: compressed rows and columns, diagonals, dense rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers as num
from ..plans.matrix import DenseMatrix, SparseMatrix
from ..plans.scratch import materialize
from .blocks import row_array, sorted_entries

#: Rows that are counted together before the running sum over the blocks.
ROW_BLOCK = 1 << 16


def compressed_rows(a: SparseMatrix) -> DataFrame:
    """(i, cols, vals) for each row with entries, sorted by column."""
    rows = a.df.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("e"))
    return rows.select("i", F.col("e.j").alias("cols"), F.col("e.v").alias("vals"))


def compressed_columns(a: SparseMatrix) -> DataFrame:
    """(j, rows, vals) for each column with entries, sorted by row."""
    return compressed_rows(a.transpose()).select(F.col("i").alias("j"), F.col("cols").alias("rows"), "vals")


def from_compressed_rows(rows: DataFrame, shape: tuple[int, int], dtype: str = "float64") -> SparseMatrix:
    cells = rows.select("i", F.explode(F.arrays_zip("cols", "vals")).alias("e")).select("i", F.col("e.cols").alias("j"), F.col("e.vals").alias("v"))
    return SparseMatrix(cells, shape, dtype, "csr")


def from_compressed_columns(columns: DataFrame, shape: tuple[int, int], dtype: str = "float64") -> SparseMatrix:
    cells = columns.select("j", F.explode(F.arrays_zip("rows", "vals")).alias("e")).select(F.col("e.rows").alias("i"), "j", F.col("e.vals").alias("v"))
    return SparseMatrix(cells, shape, dtype, "csc")


def row_pointers(a: SparseMatrix) -> DataFrame:
    """(i, count, start, end) of every row, empty ones included: running sums within blocks of rows, shifted by those over the blocks."""
    counts = a.df.groupBy("i").agg(F.count("*").alias("count"))
    every = a.spark.range(a.shape[0]).select(F.col("id").alias("i")).join(counts, "i", "left").select("i", F.coalesce("count", F.lit(0)).alias("count"))
    every = every.withColumn("_block", F.floor(F.col("i") / ROW_BLOCK))
    order = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = every.groupBy("_block").agg(F.sum("count").alias("_n")).select("_block", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_shift"))
    run = F.sum("count").over(Window.partitionBy("_block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    end = (F.col("_shift") + F.col("_run")).alias("end")
    return every.withColumn("_run", run).join(shifts, "_block").select("i", "count", (F.col("_shift") + F.col("_run") - F.col("count")).alias("start"), end)


def diagonals(a: SparseMatrix) -> DataFrame:
    """(k, j, v): the entries by diagonal, zeros left out."""
    return a.df.where(~num.is_zero(F.col("v"), a.dtype)).select((F.col("j") - F.col("i")).alias("k"), "j", "v")


def to_dense(a: SparseMatrix) -> DenseMatrix:
    """Every row as an array of the matrix's width; for matrices whose rows fit in memory (blocks are for all others)."""
    entries = a.df.groupBy("i").agg(sorted_entries("j", "v").alias("_e"))
    every = a.spark.range(a.shape[0]).select(F.col("id").alias("i")).join(entries, "i", "left")
    return DenseMatrix(every.select("i", row_array("_e", a.shape[1], a.dtype).alias("row")), a.shape, a.dtype)


def to_arrays(a: SparseMatrix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, row, col) on the driver, for small matrices."""
    pdf = a.df.orderBy("i", "j").toPandas()
    values = [complex(x["re"], x["im"]) for x in pdf["v"]] if num.is_complex(a.dtype) else pdf["v"].to_numpy()
    return np.asarray(values), pdf["i"].to_numpy(), pdf["j"].to_numpy()


def to_compressed_arrays(a: SparseMatrix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, indices, indptr) on the driver, for small matrices: by column of a CSC matrix, else by row."""
    data, row, col = to_arrays(a.transpose() if a.format == "csc" else a)
    size = a.shape[1] if a.format == "csc" else a.shape[0]
    return data, col, np.searchsorted(row, np.arange(size + 1))


def to_numpy(a: SparseMatrix) -> np.ndarray:
    """A dense array on the driver, for small matrices."""
    data, row, col = to_arrays(a)
    out = np.zeros(a.shape, np.dtype(a.dtype))
    np.add.at(out, (row, col), data)
    return out


def stored(a: SparseMatrix, name: str = "matrix") -> SparseMatrix:
    """The matrix written out once, for loops that read it again and again: in parts of the advisory size, so that a step
    over a small one is not a task on each core, and one over a hot range is not one long task."""
    return a.over(materialize(a.df.hint("rebalance"), name))
