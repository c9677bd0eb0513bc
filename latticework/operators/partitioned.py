"""Operators that choose where entries lie: products on a grid of blocks, a matrix stored by column for repeated products,
and entries dealt out in equal numbers.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..plans.matrix import SparseMatrix, Vector, check
from ..plans.scratch import materialize, remove, scratch_dir, settings
from .products import Semiring, plus_times, spgemm, spgemm_terms

#: Products that a block of a grid is planned for, and the most blocks.
BLOCK_TERMS, MOST_BLOCKS = 20_000_000, 1 << 14
#: Joins and sums whose keys hold the block keep to its partition.
CO_PARTITIONED = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.requireAllClusterKeysForDistribution": "false"}


# Products on a grid


@dataclass(frozen=True)
class Grid:
    """Blocks of rows of the left factor times columns of the right one, times slices of the shared index."""

    rows: int
    columns: int
    inner: int = 1

    @property
    def blocks(self) -> int:
        return self.rows * self.columns * self.inner


@dataclass(frozen=True)
class Profile:
    """What the choice of a grid rests on: entries of the factors, terms of the product, and the largest shares of the
    entries that one row of the left and one column of the right factor have."""

    left: int
    right: int
    terms: int
    row_share: float
    column_share: float


def profile(a: SparseMatrix, b: SparseMatrix) -> Profile:
    def counted(m: SparseMatrix, key: str):
        return m.df.groupBy(key).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()

    (left, row), (right, column) = counted(a, "i"), counted(b, "j")
    return Profile(left, right, spgemm_terms(a, b), row / max(1, left), column / max(1, right))


def choose_grid(p: Profile, parallelism: int) -> Grid | None:
    """A grid with a block for each BLOCK_TERMS products and each core at least, shaped so that least is sent: left entries
    go to every column of blocks, right ones to every row. The shared index is sliced where a row or a column has more
    than its block's share of the entries. None where a plain join, which sends every entry once and every product that
    the map side does not combine, sends no more."""
    blocks = min(MOST_BLOCKS, max(parallelism, ceil(p.terms / BLOCK_TERMS)))
    rows = min(blocks, max(1, round(sqrt(blocks * p.left / max(1, p.right)))))
    columns = max(1, blocks // rows)
    if p.left * columns + p.right * rows >= p.left + p.right + p.terms:
        return None
    inner = ceil(max(1.0, p.row_share * rows, p.column_share * columns) - 0.5)
    return Grid(rows, columns, max(1, min(inner, MOST_BLOCKS // (rows * columns))))


def _bucket(key: str, n: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)).cast("int")


def grid_terms(a: SparseMatrix, b: SparseMatrix, grid: Grid) -> DataFrame:
    """(_block, i, j, _a, _b): the products of a grid, each block in a partition of its own. An index that many entries
    share meets in as many blocks as the grid has, since the entries are dealt by their other index."""
    slices = _bucket("_k", grid.inner, 3)

    def at(row: Column, column: Column) -> Column:
        return ((row * grid.columns + column) * grid.inner + slices).alias("_block")

    x = a.df.select("i", F.col("j").alias("_k"), F.col("v").alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(grid.columns - 1))).alias("_c"))
    y = b.df.select(F.col("i").alias("_k"), "j", F.col("v").alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(grid.rows - 1))).alias("_r"))
    x = x.select(at(_bucket("i", grid.rows, 1), F.col("_c")), "i", "_k", "_a").repartitionById(grid.blocks, "_block")
    y = y.select(at(F.col("_r"), _bucket("j", grid.columns, 2)), "j", "_k", "_b").repartitionById(grid.blocks, "_block")
    return x.join(y, ["_block", "_k"]).select("_block", "i", "j", "_a", "_b")


def spgemm_grid(a: SparseMatrix, b: SparseMatrix, grid: Grid | None = None, semiring: Semiring | None = None) -> SparseMatrix:
    """C = A B over a grid of blocks, chosen from the factors' profile if not given; the product is stored.

    Each factor is sent once, to all blocks that need it. A block joins on the shared index and sums its cells where they
    are; only where the shared index is sliced are sums of slices sent on. So what is sent grows with the entries times
    the square root of the blocks, not with the number of products."""
    check(a.shape[1] == b.shape[0], f"shapes {a.shape} and {b.shape} do not fit")
    if grid is None:
        grid = choose_grid(profile(a, b), a.spark.sparkContext.defaultParallelism)
    if grid is None:
        return spgemm(a, b, semiring)
    dtype = num.common_dtype(a.dtype, b.dtype)
    ring = semiring or plus_times(dtype)
    terms = grid_terms(a.astype(dtype), b.astype(dtype), grid)
    cells = terms.groupBy("_block", "i", "j").agg(ring.add(ring.multiply(F.col("_a"), F.col("_b"))).alias("v"))
    if grid.inner > 1:
        cells = cells.groupBy("i", "j").agg(ring.add(F.col("v")).alias("v"))
    with settings(a.spark, CO_PARTITIONED):
        return SparseMatrix(materialize(cells.select("i", "j", "v"), "product"), (a.shape[0], b.shape[1]), dtype, "csr")


# A matrix stored by column


class ColumnBuckets:
    """A matrix written once in buckets of columns, so that repeated products read it where the vector's entries come to:
    a step sends partial sums by row, and nothing else.

    Columns with more than HOT of a bucket's entries are kept apart, in even parts; there are at most buckets / HOT of
    them, so what they take of a vector is broadcast. Use as a context manager, or drop when done."""

    HOT = 0.5

    def __init__(self, a: SparseMatrix, buckets: int | None = None):
        spark = self.spark = a.spark
        self.shape, self.dtype = a.shape, a.dtype
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        counts = a.df.groupBy("j").count()
        total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        hot = materialize(counts.where(F.col("count") > max(1.0, self.HOT * total / self.buckets)).select("j"), "hot-columns")
        self._name, self._path = f"columns_{uuid.uuid4().hex}", f"{scratch_dir(spark)}/columns-{uuid.uuid4().hex}"
        cold = a.df.join(F.broadcast(hot), "j", "left_anti").select("i", "j", "v")
        cold.repartition(self.buckets, "j").write.bucketBy(self.buckets, "j").option("path", self._path).saveAsTable(self._name)
        self._cold = spark.table(self._name)
        self._hot = None
        if not hot.isEmpty():
            self._hot = materialize(a.df.join(F.broadcast(hot), "j", "left_semi").select("i", "j", "v").hint("rebalance"), "hot-entries")
            self._columns = hot

    def spmv(self, x: Vector, semiring: Semiring | None = None) -> Vector:
        """y = A x; as x comes from such a step, it lies where it is needed."""
        check(self.shape[1] == x.size, f"a vector of {self.shape[1]} is needed, not of {x.size}")
        dtype = num.common_dtype(self.dtype, x.dtype)
        ring = semiring or plus_times(dtype)
        values = x.astype(dtype).df.select(F.col("i").alias("j"), F.col("v").alias("_x"))

        def terms(entries: DataFrame, values: DataFrame) -> DataFrame:
            return entries.select("i", "j", num.convert(F.col("v"), self.dtype, dtype).alias("v")).join(values, "j").select("i", ring.multiply(F.col("v"), F.col("_x")).alias("v"))

        # a merge join keeps the buckets; a broadcast of the vector would need no buckets, but grows with it
        found = terms(self._cold, values.hint("merge"))
        if self._hot is not None:
            found = found.unionByName(terms(self._hot, F.broadcast(values.join(F.broadcast(self._columns), "j", "left_semi"))))
        return Vector(found.groupBy("i").agg(ring.add(F.col("v")).alias("v")), self.shape[0], dtype)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name}")
        remove(self.spark, self._path)

    def __enter__(self) -> ColumnBuckets:
        return self

    def __exit__(self, *exc) -> None:
        self.drop()


# Entries in equal numbers

#: Units, of which a partition has this many at least: the largest is the most by which partitions differ.
UNITS = 32
#: Stretches of rows in which the bounds of partitions are looked up.
STRETCHES = 1 << 14


def balance(a: SparseMatrix, partitions: int | None = None) -> SparseMatrix:
    """Entries in so many partitions by row, each with the same number of them but for one part in UNITS.

    Rows are counted, and rows with more than a unit are split into pieces by the hash of the column. Running sums of the
    counts, within stretches of rows and over the stretches, say at which row and piece a partition ends; these bounds,
    one for each partition, deal out the entries, which are sent once."""
    spark, m = a.spark, a.shape[0]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = a.df.groupBy("i").agg(F.count("*").alias("_n"))
    total = rows.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    unit = max(1, total // (n * UNITS))
    width = max(1, ceil(m / STRETCHES))
    # at most n * UNITS rows have more than a unit
    large = materialize(rows.where(F.col("_n") > unit).select("i", F.ceil(F.col("_n") / unit).cast("int").alias("_pieces")), "large-rows")

    def pieced(df: DataFrame) -> DataFrame:
        joined = df.join(F.broadcast(large), "i", "left")
        return joined.withColumn("_piece", F.coalesce(F.pmod(F.xxhash64("j"), F.col("_pieces")), F.lit(0)).cast("int")).drop("_pieces")

    units = materialize(pieced(a.df).groupBy("i", "_piece").agg(F.count("*").alias("_n")).withColumn("_stretch", F.floor(F.col("i") / width)), "units")
    before = materialize(_running(units.groupBy("_stretch").agg(F.sum("_n").alias("_n")), [], ["_stretch"]).select("_stretch", F.col("_before").alias("_shift")), "stretches")
    placed = _running(units, ["_stretch"], ["i", "_piece"]).join(F.broadcast(before), "_stretch")  # at most STRETCHES rows
    middle = F.col("_before") + F.col("_shift") + F.col("_n") / 2
    part = F.least(F.floor(middle * n / max(1, total)), F.lit(n - 1)).cast("int")
    bounds = placed.select(part.alias("_part"), F.struct("i", "_piece").alias("_at")).groupBy("_part").agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"))
    stretches = F.explode(F.sequence(F.floor(F.col("_from.i") / width), F.floor(F.col("_to.i") / width)))
    # each stretch once, and once more for each bound in it
    bounds = materialize(bounds.select("_part", "_from", "_to", stretches.alias("_stretch")), "bounds")
    at = F.struct("i", "_piece")
    dealt = pieced(a.df).withColumn("_stretch", F.floor(F.col("i") / width)).join(F.broadcast(bounds), "_stretch").where((at >= F.col("_from")) & (at <= F.col("_to")))
    return a.over(dealt.select("i", "j", "v", "_part").repartitionById(n, "_part"))


def _running(df: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """df with _before, the sum of _n over the rows before in the order."""
    from pyspark.sql.window import Window

    window = (Window.partitionBy(*within) if within else Window).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum("_n").over(window), F.lit(0)))
