"""Where entries lie: grids of blocks, buckets of columns, partitions of equal size."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import construct, convert, partitioned, products
from latticework.operators.partitioned import Grid, Profile
from latticework.plans.matrix import SparseMatrix
from latticework.plans.scratch import settings

from .test_matrix import sparse, values


def hub(m: int, n: int, seed: int, column: int | None = None, row: int | None = None) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.where(rng.random((m, n)) < 0.05, rng.integers(1, 9, (m, n)), 0).astype(float)
    if column is not None:
        out[:, column] = rng.integers(1, 9, m)
    if row is not None:
        out[row, :] = rng.integers(1, 9, n)
    return out


def dense(a: SparseMatrix) -> np.ndarray:
    out = np.zeros(a.shape)
    for r in a.df.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def test_grid_products(spark):
    a, b = hub(90, 40, 1, column=7), hub(40, 70, 2, row=7)
    x, y = sparse(spark, a), sparse(spark, b)
    for grid in (Grid(1, 1), Grid(3, 2), Grid(2, 3, 4), None):
        got = partitioned.spgemm_grid(x, y, grid)
        assert np.array_equal(dense(got), a @ b) and got.df.count() == len(got.df.select("i", "j").distinct().collect())
    shortest = partitioned.spgemm_grid(x, y, Grid(2, 2, 2), products.MIN_PLUS)
    assert sorted(map(tuple, shortest.df.collect())) == sorted(map(tuple, products.spgemm(x, y, products.MIN_PLUS).df.select("i", "j", "v").collect()))
    assert np.array_equal(dense(x.tocsr() @ y.tocsc()), a @ b)
    c = sparse(spark, a).scale(1 + 2j)
    parts = partitioned.spgemm_grid(c, sparse(spark, b), Grid(2, 2)).df.select("i", "j", "v.re", "v.im").collect()
    assert all(r["re"] == (a @ b)[r["i"], r["j"]] and r["im"] == 2 * r["re"] for r in parts)


def test_a_hub_is_spread_over_the_grid(spark):
    """Nine tenths of the products share one index; every block gets its part, and no other exchange is made."""
    a, b = np.zeros((400, 50)), np.zeros((50, 400))
    a[:, 3], b[3, :] = 1, 1
    a[np.arange(400), np.arange(400) % 50], b[np.arange(400) % 50, np.arange(400)] = 1, 1
    x, y, grid = convert.stored(sparse(spark, a)), convert.stored(sparse(spark, b)), Grid(4, 3)
    terms = partitioned.grid_terms(x, y, grid)
    with settings(spark, partitioned.CO_PARTITIONED | {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        loads = [r["count"] for r in terms.groupBy("_block").count().collect()]
        plan = terms.groupBy("_block", "i", "j").count()._jdf.queryExecution().executedPlan().toString()
    assert len(loads) == 12 and max(loads) < 1.4 * np.mean(loads)
    assert plan.count("Exchange") == 2
    # a row that holds most of the left factor is cut along the shared index
    tall = hub(60, 300, 3, row=5)
    tall[:5], tall[6:] = 0, 0
    tall[np.arange(60), np.arange(60)] = 1
    wide = hub(300, 60, 4)
    grid = partitioned.choose_grid(partitioned.profile(sparse(spark, tall), sparse(spark, wide)), 8)
    assert grid is None or grid.inner > 1
    got = partitioned.spgemm_grid(sparse(spark, tall), sparse(spark, wide), Grid(4, 2, 3))
    assert np.array_equal(dense(got), tall @ wide)
    loads = [r["count"] for r in partitioned.grid_terms(sparse(spark, tall), sparse(spark, wide), Grid(4, 1, 8)).groupBy("_block").count().collect()]
    assert max(loads) < 0.35 * sum(loads)


def test_grid_choice():
    even = Profile(10**6, 10**6, 10**10, 1e-4, 1e-4)
    grid = partitioned.choose_grid(even, 8)
    assert grid.inner == 1 and 400 <= grid.blocks <= 520 and abs(grid.rows - grid.columns) <= 2
    flat = partitioned.choose_grid(Profile(10**8, 10**4, 10**10, 1e-6, 1e-3), 8)
    assert flat.rows > 100 * flat.columns
    assert partitioned.choose_grid(Profile(10**6, 10**6, 10**5, 0.0, 0.0), 8) is None
    assert partitioned.choose_grid(Profile(10**6, 10**6, 10**10, 0.3, 1e-4), 8).inner >= 6


def test_column_buckets(spark):
    a = hub(60, 60, 5)
    with settings(spark, {"spark.sql.shuffle.partitions": "4"}), partitioned.ColumnBuckets(sparse(spark, a)) as buckets:
        x = construct.vector(spark, np.arange(60.0))
        three = buckets.spmv(buckets.spmv(buckets.spmv(x)))
        plan = three.df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 4  # the first vector, and one for each step
        assert np.allclose(values(three), np.linalg.matrix_power(a, 3) @ np.arange(60.0))
        name = buckets._name
        assert spark.catalog.tableExists(name)
    assert not spark.catalog.tableExists(name)


def test_hot_columns(spark):
    a = hub(200, 40, 6, column=9)
    with partitioned.ColumnBuckets(sparse(spark, a), 16) as buckets:
        assert buckets._hot is not None and {r["j"] for r in buckets._hot.select("j").distinct().collect()} >= {9}
        assert np.allclose(values(buckets.spmv(construct.vector(spark, np.arange(40.0)))), a @ np.arange(40.0))
    with partitioned.ColumnBuckets(construct.make_empty(spark, (3, 4)), 2) as empty:
        assert empty.spmv(construct.vector(spark, np.ones(4))).df.count() == 0


@pytest.mark.parametrize("row", [None, 17])
def test_balance(spark, row):
    a = hub(300, 400, 8, row=row)
    if row is not None:  # one row has half of all entries
        a[np.random.default_rng(1).random(300) < 0.9] = 0
        a[row] = 1
    m = sparse(spark, a)
    got = m.balance(5)
    sizes = got.df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi")).orderBy("p").collect()
    mean = np.count_nonzero(a) / 5
    assert len(sizes) == 5 and all(abs(r["n"] - mean) <= 0.1 * mean for r in sizes)
    assert all(x["hi"] <= y["lo"] for x, y in zip(sizes, sizes[1:], strict=False))
    assert np.array_equal(dense(got), a)
    assert construct.make_empty(spark, (4, 4)).balance(3).nnz == 0
