"""Constructors by the customary class names; each takes a session and whatever describes a matrix."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import SparkSession

from ..plans.matrix import DenseMatrix, SparseMatrix, check
from . import construct


def matrix(spark: SparkSession, source, shape: tuple[int, int] | None = None, dtype: str | None = None, format: str = "csr") -> SparseMatrix:
    """A matrix from another one, a shape, (data, (row, col)), (data, indices, indptr), (data, offsets) for DIA, an object
    with tocoo(), or dense rows."""
    if isinstance(source, SparseMatrix):
        out = source
    elif isinstance(source, DenseMatrix):
        out = construct.from_dense(source)
    elif hasattr(source, "tocoo"):
        out = construct.from_scipy_like(spark, source)
    elif isinstance(source, tuple):
        out = _from_parts(spark, source, shape, dtype, format)
    else:
        out = construct.from_dense(np.atleast_2d(np.asarray(source)), spark)
    check(shape is None or out.shape == tuple(shape), "the shape is not that of the matrix")
    return (out if dtype is None else out.astype(dtype)).asformat(format)


def _from_parts(spark: SparkSession, parts: tuple, shape: tuple[int, int] | None, dtype: str | None, format: str) -> SparseMatrix:
    if len(parts) == 2 and all(isinstance(x, (int, np.integer)) for x in parts):
        return construct.make_empty(spark, tuple(map(int, parts)), dtype or "float64")
    if len(parts) == 2 and format == "dia":
        check(shape is not None, "diagonals need a shape")
        return construct.spdiags(spark, np.atleast_2d(parts[0]), np.atleast_1d(parts[1]), *shape)
    if len(parts) == 2:
        data, (row, col) = parts
        return construct.from_triples(spark, data, row, col, shape or (max(row, default=-1) + 1, max(col, default=-1) + 1))
    check(len(parts) == 3, "two or three parts describe a matrix")
    check(format in ("csr", "csc"), f"{format} has no pointers")
    data, indices, pointers = parts
    ends = (len(pointers) - 1, max(indices, default=-1) + 1)
    return construct.from_compressed(spark, data, indices, pointers, shape or (ends if format == "csr" else ends[::-1]), format)


csr_matrix = csr_array = partial(matrix, format="csr")
csc_matrix = csc_array = partial(matrix, format="csc")
coo_matrix = coo_array = partial(matrix, format="coo")
dia_matrix = dia_array = partial(matrix, format="dia")
