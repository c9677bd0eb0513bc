"""Dense matrices in square blocks, and arrays laid out from sorted entries in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..plans.matrix import DenseBlocks, DenseMatrix, SparseMatrix, check

#: Rows and columns of a block: 512 KB of doubles.
SIDE = 256


def laid_out(entries: Column, length: Column, zero: Column) -> Column:
    """An array with the values of entries, structs (at, v) in ascending order of places, and zeros between and after them.

    Each entry brings the zeros before it, so the work is that of writing the array once."""
    gap = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(entries, k - 1)["at"])
    pieces = F.transform(entries, lambda x, k: F.concat(F.array_repeat(zero, (x["at"] - gap(k) - 1).cast("int")), F.array(x["v"])))
    rest = length - 1 - F.when(F.size(entries) == 0, F.lit(-1)).otherwise(F.element_at(entries, -1)["at"])
    return F.concat(F.flatten(pieces), F.array_repeat(zero, rest.cast("int")))


def sorted_entries(at: str, v: str) -> Column:
    """The aggregate that laid_out reads."""
    return F.sort_array(F.collect_list(F.struct(F.col(at).cast("int").alias("at"), F.col(v).alias("v"))))


def row_array(entries: str, n: int, dtype: str = "float64") -> Column:
    """A row of n cells from a column of sorted entries, all zeros where that is null."""
    zeros = F.array_repeat(num.zero(dtype), n)
    return F.when(F.col(entries).isNull(), zeros).otherwise(laid_out(F.col(entries), F.lit(n), num.zero(dtype)))


def _keyed(cells: DataFrame, side: int) -> DataFrame:
    return cells.select(F.floor(F.col("i") / side).alias("bi"), F.floor(F.col("j") / side).alias("bj"), (F.col("i") % side).alias("_i"), (F.col("j") % side).alias("_j"), "v")


def from_cells(cells: DataFrame, shape: tuple[int, int], side: int = SIDE, dtype: str = "float64") -> DenseBlocks:
    """Blocks of (i, j, v), each cell once; cells that are left out are zero, and so are blocks without any. A block gathers
    side * side cells at most."""
    out = DenseBlocks(cells, shape, side, dtype)
    filled = _keyed(cells, side).withColumn("_at", F.col("_i") * out.width(F.col("bj")) + F.col("_j")).groupBy("bi", "bj").agg(sorted_entries("_at", "v").alias("_e"))
    down, across = -(-shape[0] // side), -(-shape[1] // side)
    spark = cells.sparkSession
    every = spark.range(down * across).select(F.floor(F.col("id") / max(1, across)).alias("bi"), (F.col("id") % max(1, across)).alias("bj"))
    length, zero = out.width(F.col("bj")) * out.height(F.col("bi")), num.zero(dtype)
    array = F.when(F.col("_e").isNull(), F.array_repeat(zero, length)).otherwise(laid_out(F.col("_e"), length, zero))
    return DenseBlocks(every.join(filled, ["bi", "bj"], "left").select("bi", "bj", array.alias("cells")), shape, side, dtype)


def to_blocks(a: SparseMatrix, side: int = SIDE) -> DenseBlocks:
    return from_cells(a.df, a.shape, side, a.dtype)


def from_rows(a: DenseMatrix, side: int = SIDE) -> DenseBlocks:
    return from_cells(a.long(), a.shape, side, a.dtype)


def to_rows(a: DenseBlocks) -> DenseMatrix:
    """Whole rows as arrays, for matrices that are narrow: stretches of a row are cut from its blocks and joined in order."""
    width = a.width(F.col("bj"))
    stretch = F.posexplode(F.transform(F.sequence(F.lit(0), a.height(F.col("bi")) - 1), lambda k: F.slice("cells", (k * width + 1).cast("int"), width)))
    rows = a.df.select("bi", "bj", stretch.alias("_i", "part")).groupBy((F.col("bi") * a.side + F.col("_i")).alias("i"))
    return DenseMatrix(rows.agg(F.flatten(F.sort_array(F.collect_list(F.struct("bj", "part")))["part"]).alias("row")), a.shape, a.dtype)


def add_blocks(a: SparseMatrix, b: DenseBlocks) -> DenseBlocks:
    """A dense sum: the entries of a block are laid out and added cell by cell."""
    check(a.shape == b.shape, f"shapes {a.shape} and {b.shape} differ")
    entries = _keyed(a.astype("float64").df, b.side).withColumn("_at", F.col("_i") * b.width(F.col("bj")) + F.col("_j")).groupBy("bi", "bj").agg(sorted_entries("_at", "v").alias("_e"))
    summed = F.zip_with("cells", laid_out(F.col("_e"), F.size("cells"), F.lit(0.0)), lambda x, y: x + y)
    joined = b.df.join(entries, ["bi", "bj"], "left")
    return DenseBlocks(joined.select("bi", "bj", F.when(F.col("_e").isNull(), F.col("cells")).otherwise(summed).alias("cells")), b.shape, b.side)


def blocks_times_sparse(b: DenseBlocks, a: SparseMatrix) -> DenseBlocks:
    """C = B A in blocks: dense cells meet the entries on the shared index, and cells of C are summed, map side first."""
    check(b.shape[1] == a.shape[0], f"shapes {b.shape} and {a.shape} do not fit")
    left = b.long().select("i", F.col("j").alias("_k"), F.col("v").alias("_b"))
    right = a.astype("float64").df.select(F.col("i").alias("_k"), "j", F.col("v").alias("_a"))
    cells = left.join(right, "_k").groupBy("i", "j").agg(F.sum(F.col("_b") * F.col("_a")).alias("v"))
    return from_cells(cells, (b.shape[0], a.shape[1]), b.side)
