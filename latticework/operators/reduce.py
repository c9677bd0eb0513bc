"""Sums over a matrix, its rows or its columns, and counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..plans.matrix import SparseMatrix, Vector, check


def total(a: SparseMatrix, axis: int | None = None, dtype: str | None = None):
    """A number for axis None; a vector of column sums for 0 (-2) and of row sums for 1 (-1), zeros included."""
    check(axis in (None, 0, 1, -1, -2), f"no axis {axis}")
    a = a.astype(dtype) if dtype else a
    if axis is None:
        value = total_frame(a).first()["v"]
        return complex(value["re"], value["im"]) if num.is_complex(a.dtype) else value
    key, size = ("j", a.shape[1]) if axis in (0, -2) else ("i", a.shape[0])
    sums = a.df.groupBy(F.col(key).alias("i")).agg(num.total(F.col("v"), a.dtype).alias("v"))
    return Vector(Vector(sums, size, a.dtype).filled(), size, a.dtype)


def total_frame(a: SparseMatrix) -> DataFrame:
    """One row with the sum of all entries; zero for an empty matrix."""
    return a.df.agg(F.coalesce(num.total(F.col("v"), a.dtype), num.zero(a.dtype)).alias("v"))


def counts_per_row(a: SparseMatrix) -> DataFrame:
    return a.df.groupBy("i").agg(F.count("*").alias("count"))


def bounds(a: SparseMatrix) -> DataFrame:
    """The smallest and largest coordinates of the stored entries."""
    return a.df.agg(F.min("i").alias("min_i"), F.max("i").alias("max_i"), F.min("j").alias("min_j"), F.max("j").alias("max_j"))


def frobenius_norm(a: SparseMatrix) -> float:
    square = F.col("v.re") ** 2 + F.col("v.im") ** 2 if num.is_complex(a.dtype) else F.col("v") * F.col("v")
    return a.df.agg(F.sqrt(F.coalesce(F.sum(square), F.lit(0.0)))).first()[0]


#: Cells that a task sorts at once, and about as many that a bucket gets.
SORTED = 1 << 20


def distinct_cells(a: SparseMatrix, entries: int) -> DataFrame:
    """One row with the number of different cells, exactly. entries: about how many are stored, which sets the buckets.

    Tasks send sorted runs of cell numbers, as the bytes of their differences by place, so that the places which are
    zero all but vanish: two or three bytes a cell, where rows would take thirty."""
    m, n = a.shape
    check(m * n < 1 << 62, "too many cells to be numbered")
    buckets = max(1, -(-entries // SORTED))
    width = max(1, -(-m * n // buckets))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def sent() -> pa.RecordBatch:
            cells = np.unique(np.concatenate(held))
            at = cells // width
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            packed = [np.diff(run, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes() for run in np.split(cells, starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(at[starts]), pa.array(packed, pa.binary())], names=["bucket", "run"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column("c").to_numpy())
                count += batch.num_rows
            if count >= SORTED:
                yield sent()
                held, count = [], 0
        if held:
            yield sent()

    def counted(table: pa.Table) -> pa.Table:
        found = [np.frombuffer(x.as_buffer(), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel().cumsum() for x in table.column("run")]
        return pa.table({"cells": pa.array([len(np.unique(np.concatenate(found)))])})

    packed = a.df.select((F.col("i") * n + F.col("j")).alias("c")).mapInArrow(runs, "bucket long, run binary")
    return packed.groupBy("bucket").applyInArrow(counted, "cells long").agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"))
