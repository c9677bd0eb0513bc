"""Geometric and algebraic multigrid as preconditioners.

A hierarchy is a list of levels (matrix, inverse diagonal, prolongation); coarse matrices are Galerkin products
P^T A P, written out once. A V-cycle smooths with weighted Jacobi and solves the coarsest level, whose size is bounded
by COARSEST, with a dense matrix on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.convert import stored, to_numpy
from ..operators.products import hinted, spgemm, spmv
from ..plans.matrix import SparseMatrix, Vector, check
from ..plans.scratch import materialize, remove, written
from .graphs import aggregates
from .linalg import LinearOperator, spectral_norm

COARSEST = 400
SMOOTHING = 4 / 3


@dataclass
class Level:
    a: SparseMatrix
    weight: DataFrame  # (i, w): omega over the diagonal
    p: SparseMatrix | None = None


def jacobi_weights(a: SparseMatrix, omega: float = 2 / 3) -> DataFrame:
    return materialize(a.diagonal().df.select("i", F.when(F.col("v") != 0, F.lit(omega) / F.col("v")).otherwise(0.0).alias("w")), "jacobi")


def scaled_rows(a: SparseMatrix, weights: DataFrame) -> SparseMatrix:
    return a.over(a.df.join(hinted(weights, a.shape[0]), "i").withColumn("v", F.col("v") * F.col("w")))


def linear_interpolation(spark: SparkSession, n: int) -> SparseMatrix:
    """From every second point of an n x n grid to all, weights 1, 1/2 and 1/4; coarse point (x, y) lies at (2x+1, 2y+1)."""
    c = n // 2
    offsets = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dx, dy, w in [(x, y, (1 - abs(x) / 2) * (1 - abs(y) / 2)) for x in (-1, 0, 1) for y in (-1, 0, 1)]))
    cells = spark.range(c * c).select(F.col("id").alias("j"), F.expr(f"id div {c}").alias("x"), (F.col("id") % c).alias("y"), F.explode(offsets).alias("o"))
    x, y = 2 * F.col("x") + 1 + F.col("o.dx"), 2 * F.col("y") + 1 + F.col("o.dy")
    inside = cells.where((x >= 0) & (x < n) & (y >= 0) & (y < n)).select((x * n + y).alias("i"), "j", F.col("o.w").cast("double").alias("v"))
    return SparseMatrix(inside, (n * n, c * c), "float64", "csr")


def injection(spark: SparkSession, n: int) -> SparseMatrix:
    """Coarse point (x, y) takes the value at (2x+1, 2y+1): ones at those places."""
    c = n // 2
    cells = spark.range(c * c).select(((2 * F.expr(f"id div {c}") + 1) * n + 2 * (F.col("id") % c) + 1).alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    return SparseMatrix(cells, (n * n, c * c), "float64", "csr")


def strength(a: SparseMatrix, theta: float = 0.0) -> SparseMatrix:
    """Entries with |a_ij| >= theta sqrt(|a_ii a_jj|), and the diagonal."""
    if theta == 0:
        return a
    d = a.diagonal().df
    sized = a.df.join(d.select("i", F.abs("v").alias("_di")), "i").join(d.select(F.col("i").alias("j"), F.abs("v").alias("_dj")), "j")
    return a.over(sized.where((F.col("i") == F.col("j")) | (F.abs("v") >= theta * F.sqrt(F.col("_di") * F.col("_dj")))))


def smoothed_prolongation(a: SparseMatrix, theta: float = 0.0, seed: int = 0) -> SparseMatrix:
    """Aggregates of a distance-2 independent set, with constant candidates of norm 1 and one step of Jacobi smoothing."""
    roots = materialize(aggregates(strength(a, theta), seed), "roots")
    sizes = roots.groupBy("root").agg(F.count("*").alias("_n"))
    from ..plans.ordering import numbered

    numbers = materialize(numbered(sizes, [F.col("root")], "j"), "aggregates")
    t = SparseMatrix(roots.join(numbers, "root").select("i", "j", (1 / F.sqrt("_n")).alias("v")), (a.shape[0], numbers.count()), "float64", "csr")
    weights = jacobi_weights(a, 1.0)
    da = stored(scaled_rows(a, weights), "scaled")
    rho = spectral_norm(da, iterations=15, tol=1e-2)
    return stored(t - spgemm(da, t).scale(SMOOTHING / rho), "prolongation")


def hierarchy(a: SparseMatrix, prolong, coarsest: int = COARSEST, most_levels: int = 10) -> list[Level]:
    levels = []
    while True:
        a = stored(a, "level")
        level = Level(a, jacobi_weights(a))
        levels.append(level)
        if a.shape[0] <= coarsest or len(levels) >= most_levels:
            break
        level.p = stored(prolong(a, len(levels) - 1), "prolongation")
        check(level.p.shape[1] < a.shape[0], "the coarse level is not smaller")
        a = spgemm(spgemm(level.p.transpose(), a), level.p)
    check(levels[-1].a.shape[0] <= coarsest, f"the coarsest level has {levels[-1].a.shape[0]} rows")
    return levels


def geometric(spark: SparkSession, a: SparseMatrix, n: int, coarsest: int = COARSEST, restriction: str = "linear") -> list[Level]:
    check(a.shape == (n * n, n * n), "the matrix does not fit the grid")
    make = linear_interpolation if restriction == "linear" else injection
    sides = {}

    def prolong(m: SparseMatrix, k: int) -> SparseMatrix:
        side = sides.setdefault(k, n if k == 0 else sides[k - 1] // 2)
        return make(spark, side)

    return hierarchy(a, prolong, coarsest)


def algebraic(a: SparseMatrix, theta: float = 0.0, coarsest: int = COARSEST, seed: int = 0) -> list[Level]:
    return hierarchy(a, lambda m, k: smoothed_prolongation(m, theta, seed + k), coarsest)


def preconditioner(levels: list[Level]) -> LinearOperator:
    """One V-cycle with a smoothing step before and after each coarse correction. The tables of a cycle live until the next
    one begins, by which the caller has written what it makes of the result."""
    last = levels[-1].a
    inverse = np.linalg.pinv(to_numpy(last))
    spark = last.spark
    dense = SparseMatrix(
        materialize(spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(inverse)], "i long, row array<double>").select("i", F.posexplode("row").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v"), "coarsest"),
        last.shape,
    )

    tables: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        tables.append(path)
        return out

    def begun(b: DataFrame) -> DataFrame:
        before = tables[:]
        tables.clear()
        b = kept(b, "cycle")
        for path in before:
            remove(spark, path)
        return b

    def cycle(k: int, b: DataFrame) -> DataFrame:
        if k == len(levels) - 1:
            return spmv(dense, Vector(b, last.shape[1])).df
        level, n = levels[k], levels[k].a.shape[0]

        def smooth(x: DataFrame | None, b: DataFrame) -> DataFrame:
            if x is None:
                return level.weight.join(b, "i").select("i", (F.col("w") * F.col("v")).alias("v"))
            r = residual(x, b).select("i", F.col("v").alias("_r"))
            both = level.weight.join(x, "i", "left").join(r, "i", "left")
            return both.select("i", (F.coalesce("v", F.lit(0.0)) + F.col("w") * F.coalesce("_r", F.lit(0.0))).alias("v"))

        def residual(x: DataFrame, b: DataFrame) -> DataFrame:
            ax = spmv(level.a, Vector(x, n)).df.select("i", F.col("v").alias("_ax"))
            return b.join(ax, "i", "full").select("i", (F.coalesce("v", F.lit(0.0)) - F.coalesce("_ax", F.lit(0.0))).alias("v"))

        x = kept(smooth(None, b), "smoothed")
        coarse = kept(spmv(level.p.transpose(), Vector(residual(x, b), n)).df, "restricted")
        fine = spmv(level.p, Vector(cycle(k + 1, coarse), level.p.shape[1])).df.select("i", F.col("v").alias("_c"))
        x = kept(x.join(fine, "i", "left").select("i", (F.col("v") + F.coalesce("_c", F.lit(0.0))).alias("v")), "corrected")
        return smooth(x, b)

    return LinearOperator(levels[0].a.shape, lambda b: cycle(0, begun(b)))


def complexities(levels: list[Level]) -> dict[str, float]:
    """Entries and rows of all levels over those of the finest."""
    nnz, rows = [level.a.nnz for level in levels], [level.a.shape[0] for level in levels]
    return {"operator": sum(nnz) / nnz[0], "grid": sum(rows) / rows[0]}
