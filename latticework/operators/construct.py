"""Constructors: matrices from tables, arrays and rules."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..plans.matrix import DenseMatrix, SparseMatrix, Vector, check


def from_table(df: DataFrame, shape: tuple[int, int], i: str = "i", j: str = "j", v: str = "v", dtype: str = "float64", format: str = "coo", assume_unique: bool = False) -> SparseMatrix:
    """Entries from three columns; entries of one cell are summed unless they are known to be unique."""
    rows = df.select(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"), F.col(v).cast(num.spark_type(dtype)).alias("v"))
    if not assume_unique:
        rows = rows.groupBy("i", "j").agg(num.total(F.col("v"), dtype).alias("v"))
    return SparseMatrix(rows, shape, dtype, format)


def from_triples(spark: SparkSession, data, row, col, shape: tuple[int, int], format: str = "coo") -> SparseMatrix:
    data = np.asarray(data)
    dtype = data.dtype.name if data.dtype.name in num.SPARK_TYPES else "float64"
    values = [{"re": float(x.real), "im": float(x.imag)} for x in data] if num.is_complex(dtype) else data.tolist()
    rows = spark.createDataFrame(list(zip(map(int, row), map(int, col), values, strict=True)), f"i long, j long, v {num.spark_type(dtype)}")
    return SparseMatrix(rows.groupBy("i", "j").agg(num.total(F.col("v"), dtype).alias("v")), shape, dtype, format)


def from_compressed(spark: SparkSession, data, indices, indptr, shape: tuple[int, int], format: str = "csr") -> SparseMatrix:
    """(data, indices, indptr) of rows (csr) or of columns (csc)."""
    check(format in ("csr", "csc"), "compressed parts are of rows or of columns")
    major = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    row, col = (major, indices) if format == "csr" else (indices, major)
    return from_triples(spark, data, row, col, shape, format)


def from_scipy_like(spark: SparkSession, matrix, format: str = "csr") -> SparseMatrix:
    """Any object with tocoo() giving row, col, data and shape."""
    coo = matrix.tocoo()
    return from_triples(spark, coo.data, coo.row, coo.col, coo.shape, format)


def from_dense(dense, spark: SparkSession | None = None, format: str = "csr") -> SparseMatrix:
    """A dense matrix handle, or an array on the driver; exact zeros are left out."""
    if not isinstance(dense, DenseMatrix):
        dense = dense_matrix(spark, dense)
    return SparseMatrix(dense.long().where(~num.is_zero(F.col("v"), dense.dtype)), dense.shape, dense.dtype, format)


def dense_matrix(spark: SparkSession, array) -> DenseMatrix:
    array = np.atleast_2d(np.asarray(array, dtype=float))
    return DenseMatrix(spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(array)], "i long, row array<double>"), array.shape)


def vector(spark: SparkSession, values) -> Vector:
    values = np.asarray(values, dtype=float).ravel()
    return Vector(spark.createDataFrame([(k, float(x)) for k, x in enumerate(values)], "i long, v double"), len(values))


def make_empty(spark: SparkSession, shape: tuple[int, int], dtype: str = "float64", format: str = "csr") -> SparseMatrix:
    return SparseMatrix(spark.createDataFrame([], f"i long, j long, v {num.spark_type(dtype)}"), shape, dtype, format)


def spdiags(spark: SparkSession, data, diags, m: int, n: int, format: str | None = None) -> SparseMatrix:
    """data[d, j] goes to (j - diags[d], j)."""
    check(format is None, "spdiags gives a dia matrix only")
    data, diags = np.atleast_2d(np.asarray(data, dtype=float)), np.atleast_1d(diags)
    check(len(data) == len(diags), "a row of data is needed for each diagonal")
    rows = spark.createDataFrame([(int(k), row.tolist()) for k, row in zip(diags, data, strict=True)], "k long, data array<double>")
    cells = rows.select("k", F.posexplode("data").alias("j", "v")).select((F.col("j") - F.col("k")).alias("i"), F.col("j").cast("long").alias("j"), "v")
    return SparseMatrix(cells.where((F.col("i") >= 0) & (F.col("i") < m) & (F.col("j") < n)), (m, n), "float64", "dia")


def diags(spark: SparkSession, diagonals, offsets=0, shape: tuple[int, int] | None = None, format: str | None = None, dtype: str = "float64") -> SparseMatrix:
    """Diagonals as scalars (repeated along the diagonal) or sequences of their exact length."""
    if np.isscalar(offsets):
        diagonals, offsets = ([diagonals] if np.ndim(diagonals) <= 1 and not (np.ndim(diagonals) == 1 and np.ndim(diagonals[0]) == 1) else diagonals), [offsets]
    check(format in (None, "csr", "dia"), "diags gives csr or dia")
    check(len(diagonals) == len(offsets), "the numbers of diagonals and of offsets differ")
    check(len(set(offsets)) == len(offsets), "an offset is given twice")
    if shape is None:
        size = max(np.size(d) + abs(k) for d, k in zip(diagonals, offsets, strict=True))
        shape = (size, size)
    m, n = shape
    parts = None
    for d, k in zip(diagonals, offsets, strict=True):
        length = min(m + min(k, 0), n - max(k, 0))
        check(length >= 0, f"offset {k} lies outside of the shape")
        at = spark.range(length).select((F.col("id") + max(0, -k)).alias("i"), (F.col("id") + max(0, k)).alias("j"), "id")
        if np.size(d) == 1:
            part = at.select("i", "j", num.as_literal(np.ravel(d)[0].item(), dtype).alias("v"))
        else:
            check(np.size(d) == length, f"the diagonal at {k} has {np.size(d)} values, not {length}")
            values = spark.createDataFrame([(p, float(x)) for p, x in enumerate(np.ravel(d))], "id long, v double")
            part = at.join(values, "id").select("i", "j", F.col("v").cast(num.spark_type(dtype)).alias("v"))
        parts = part if parts is None else parts.unionByName(part)
    return SparseMatrix(parts, shape, dtype, format or "dia")


def eye(spark: SparkSession, m: int, n: int | None = None, k: int = 0, dtype: str = "float64", format: str = "csr") -> SparseMatrix:
    n = m if n is None else n
    length = max(0, min(m + min(k, 0), n - max(k, 0)))
    at = spark.range(length).select((F.col("id") + max(0, -k)).alias("i"), (F.col("id") + max(0, k)).alias("j"), num.as_literal(1, dtype).alias("v"))
    return SparseMatrix(at, (m, n), dtype, format)


def identity(spark: SparkSession, n: int, dtype: str = "float64", format: str = "csr") -> SparseMatrix:
    return eye(spark, n, dtype=dtype, format=format or "csr")


def kron(a: SparseMatrix, b: SparseMatrix, format: str | None = None) -> SparseMatrix:
    """Every entry of a times every entry of b: as many rows as the result has entries."""
    dtype = num.common_dtype(a.dtype, b.dtype)
    x = a.astype(dtype).df.select(F.col("i").alias("ia"), F.col("j").alias("ja"), F.col("v").alias("x"))
    y = b.astype(dtype).df.select(F.col("i").alias("ib"), F.col("j").alias("jb"), F.col("v").alias("y"))
    (mb, nb), (ma, na) = b.shape, a.shape
    cells = x.crossJoin(y).select((F.col("ia") * mb + F.col("ib")).alias("i"), (F.col("ja") * nb + F.col("jb")).alias("j"), num.multiply(F.col("x"), F.col("y"), dtype).alias("v"))
    return SparseMatrix(cells, (ma * mb, na * nb), dtype, format or a.format)


#: Rounds of the permutation of cells, and the most steps of a walk along its cycles.
ROUNDS, LONGEST_WALK = 7, 64
#: Shifts and factors of the mixing function of a round (the finaliser of splitmix64).
MIX = ((np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB)))
#: Cells that a task draws.
DRAWN = 1 << 22


def permuted(number: Column, size: int, seed: int) -> Column:
    """The image of a number below size under a permutation of these numbers that the seed chooses.

    A Feistel network permutes pairs of numbers below the square root of size, rounded up; a value that lies beyond size
    is permuted again, until one does not: this walk stays on its cycle, so that no image is met twice. A cycle holds at
    most side * side - size values beyond, which bounds the walk of small sizes; of large ones hardly any lies beyond.
    Numbers come in batches, each round being a few operations on all of them."""
    side = math.isqrt(max(0, size - 1)) + 1
    keys = np.random.SeedSequence([seed & (1 << 64) - 1, size]).generate_state(ROUNDS, np.uint64)
    walk = max(1, min(LONGEST_WALK, side * side - size))

    def network(x: np.ndarray) -> np.ndarray:
        half = np.uint64(side)
        l, r = np.divmod(x, half)  # noqa: E741
        for key in keys:
            h = r + key
            for shift, factor in MIX:
                h ^= h >> shift
                h *= factor
            h ^= h >> np.uint64(31)
            h %= half
            h += l
            h -= half * (h >= half)
            l, r = r, h  # noqa: E741
        return l * half + r

    def images(numbers: pd.Series) -> pd.Series:
        out = network(numbers.to_numpy().astype(np.uint64))
        for _ in range(walk):
            beyond = np.flatnonzero(out >= np.uint64(size))
            if not len(beyond):
                break
            out[beyond] = network(out[beyond])
        if len(out) and out.max() >= size:
            raise ValueError("a walk of the permutation is too long")
        return pd.Series(out.astype(np.int64))

    images.__annotations__ = {"numbers": pd.Series, "return": pd.Series}  # as types, which pandas_udf looks for
    return F.pandas_udf(images, "long")(number)


def random(spark: SparkSession, m: int, n: int, density: float = 0.01, format: str = "coo", dtype: str = "float64", seed: int = 0, data_rvs: Callable[[Column], Column] | None = None) -> SparseMatrix:
    """round(density * m * n) distinct cells, drawn without replacement. data_rvs makes a value of a uniform number between
    0 and 1, which is the value otherwise.

    Cells are the images of 0, 1, 2 ... under a keyed permutation of the cell numbers, so that none is drawn twice,
    nothing is shuffled, and a lost part is drawn again alike."""
    check(0 <= density <= 1, "a density lies between 0 and 1")
    cells = m * n
    check(cells < 1 << 62, "too many cells to be numbered")
    uniform = F.shiftrightunsigned(F.xxhash64("c", F.lit(seed)), 11) / F.lit(float(1 << 53))  # of the cell, however rows are dealt
    value = uniform if data_rvs is None else data_rvs(uniform)
    row = F.floor(F.col("c") / n).cast("long") if cells < 1 << 52 else F.expr(f"c div {n}")
    drawn = round(density * cells)
    parts = max(spark.sparkContext.defaultParallelism, -(-drawn // DRAWN))
    rows = spark.range(0, drawn, 1, parts).select(permuted(F.col("id"), max(1, cells), seed).alias("c"))
    return SparseMatrix(rows.select(row.alias("i"), (F.col("c") % max(1, n)).alias("j"), value.cast(num.spark_type(dtype)).alias("v")), (m, n), dtype, format)


rand = random


def poisson2d(spark: SparkSession, n: int) -> SparseMatrix:
    """The five-point stencil with fixed borders on an n x n grid."""
    return stencil(spark, {(0, 0): 4.0, (-1, 0): -1.0, (1, 0): -1.0, (0, -1): -1.0, (0, 1): -1.0}, n)


def rotated_diffusion(spark: SparkSession, n: int, epsilon: float = 1.0, theta: float = 0.0) -> SparseMatrix:
    """Bilinear finite elements on a square grid for diffusion that is epsilon times weaker across the direction theta.

    The tensor is diag(1, epsilon) turned by theta. With the one-dimensional stiffness K and mass M of hat functions its
    diagonal entries weigh K x M and M x K; the mixed one weighs the two products of first derivatives, -ab / 4 each."""
    turn = np.array([[np.cos(theta), -np.sin(theta)], [np.sin(theta), np.cos(theta)]])
    tensor = turn @ np.diag([1.0, epsilon]) @ turn.T
    stiffness, mass = {-1: -1.0, 0: 2.0, 1: -1.0}, {-1: 1 / 6, 0: 4 / 6, 1: 1 / 6}
    weights = {(a, b): float(tensor[0, 0] * stiffness[a] * mass[b] + tensor[1, 1] * mass[a] * stiffness[b] - tensor[0, 1] * a * b / 2) for a in stiffness for b in stiffness}
    return stencil(spark, weights, n)


def stencil(spark: SparkSession, weights: dict[tuple[int, int], float], n: int) -> SparseMatrix:
    """Row x * n + y holds the weights of the neighbours of the grid point (x, y) that lie in the grid."""
    table = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(w)).alias("w")) for (dx, dy), w in weights.items()))
    cells = spark.range(n * n).select(F.col("id").alias("i"), F.expr(f"id div {n}").alias("x"), (F.col("id") % n).alias("y"), F.explode(table).alias("s"))
    x, y = F.col("x") + F.col("s.dx"), F.col("y") + F.col("s.dy")
    inside = cells.where((x >= 0) & (x < n) & (y >= 0) & (y < n)).select("i", (x * n + y).alias("j"), F.col("s.w").alias("v"))
    return SparseMatrix(inside, (n * n, n * n), "float64", "csr")
