"""Dense blocks, keyed sampling and operators on several vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import blocks, construct, packed
from latticework.plans.matrix import SparseMatrix
from latticework.solvers import linalg

from .test_matrix import dense, sample, sparse, values


def cells(x) -> np.ndarray:
    out = np.full(x.shape, np.nan)
    for r in x.long().collect():
        assert math.isnan(out[r["i"], r["j"]])
        out[r["i"], r["j"]] = r["v"]
    return out


@pytest.mark.parametrize(("m", "n", "side"), [(7, 9, 3), (6, 6, 3), (5, 2, 8), (1, 1, 4)])
def test_blocks(spark, m, n, side):
    a = sample(m, n, seed=m * n)
    a[m // 2] = 0
    x = sparse(spark, a).toblocks(side)
    assert np.array_equal(cells(x), a) and x.df.count() == -(-m // side) * -(-n // side)
    assert x.df.agg(F.max(F.size("cells"))).first()[0] <= side * side
    b = np.arange(float(m * n)).reshape(m, n)
    full = blocks.from_rows(construct.dense_matrix(spark, b), side)
    assert np.array_equal(cells(sparse(spark, a) + full), a + b)
    assert np.array_equal(dense(blocks.to_rows(full)), b)
    c = sample(n, 4, seed=3)
    assert np.array_equal(cells(sparse(spark, c).__rmatmul__(full)), b @ c)
    assert np.array_equal(dense(sparse(spark, c).__rmatmul__(construct.dense_matrix(spark, b))), b @ c)
    assert np.array_equal(dense(sparse(spark, a).todense()), a) and np.array_equal(dense(sparse(spark, a) + construct.dense_matrix(spark, b)), a + b)


def test_blocks_of_complex_and_empty_matrices(spark):
    a = sample(5, 4)
    x = sparse(spark, a).scale(1 + 2j).toblocks(2)
    assert {(r["i"], r["j"]): complex(r["v"]["re"], r["v"]["im"]) for r in x.long().collect()} == {(i, j): a[i, j] * (1 + 2j) for i in range(5) for j in range(4)}
    assert construct.make_empty(spark, (0, 4)).toblocks().long().count() == 0
    assert np.array_equal(cells(construct.make_empty(spark, (3, 2)).toblocks(2)), np.zeros((3, 2)))


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 100, 1000, 12345])
def test_permutation(spark, size):
    images = [r[0] for r in spark.range(size).select(construct.permuted(F.col("id"), size, 5)).collect()]
    assert sorted(images) == list(range(size))
    if size > 50:
        other = [r[0] for r in spark.range(size).select(construct.permuted(F.col("id"), size, 6)).collect()]
        assert sum(x == y for x, y in zip(images, other, strict=True)) < 10


def test_large_permutation(spark):
    size = (1 << 61) + 12345
    images = spark.range(2000).select(construct.permuted(F.col("id"), size, 1).alias("x")).agg(F.count_distinct("x"), F.min("x"), F.max("x"), F.avg("x")).first()
    assert images[0] == 2000 and images[1] >= 0 and images[2] < size and abs(images[3] / size - 0.5) < 0.05


def test_sampling_is_uniform(spark):
    """Cells, and pairs of rows that have a cell in the same column, are drawn as often as chance has it."""
    m, n, density, seeds = 12, 10, 0.25, 60
    hits, pairs = np.zeros((m, n)), np.zeros((m, m))
    parts = [construct.random(spark, m, n, density, seed=s).df.withColumn("s", F.lit(s)) for s in range(seeds)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    drawn = np.zeros((seeds, m, n))
    for r in every.collect():
        drawn[r["s"], r["i"], r["j"]] += 1
    assert set(drawn.sum(axis=(1, 2))) == {30} and drawn.max() == 1
    hits = drawn.sum(axis=0)
    expected = seeds * density
    assert ((hits - expected) ** 2 / (expected * (1 - density))).sum() < 120 + 4 * math.sqrt(240)
    for s in range(seeds):
        pairs += drawn[s] @ drawn[s].T
    together = seeds * n * density * (30 - 1) / (m * n - 1)
    off = pairs[~np.eye(m, dtype=bool)]
    assert abs(off.mean() - together) < 0.05 * together and off.std() < 2 * math.sqrt(together)


def test_values_of_samples(spark):
    a = construct.random(spark, 50, 40, 0.2, seed=1, data_rvs=lambda u: F.floor(u * 3) - 1)
    values = {r["v"] for r in a.df.collect()}
    assert values == {-1.0, 0.0, 1.0} and a.nnz == 400
    same = construct.random(spark, 50, 40, 0.2, seed=1)
    assert {(r["i"], r["j"]) for r in same.df.collect()} == {(r["i"], r["j"]) for r in a.df.collect()}
    assert construct.random(spark, 0, 40, 0.5).nnz == 0 and construct.random(spark, 4, 4, 1.0, dtype="int64").dtype == "int64"


def many(spark, array) -> tuple:
    rows = [(i, c, float(array[i, c])) for i in range(array.shape[0]) for c in range(array.shape[1])]
    return spark.createDataFrame(rows, "i long, c int, v double"), array.shape[1]


def from_many(df, shape) -> np.ndarray:
    out = np.zeros(shape)
    for r in df.collect():
        out[r["i"], r["c"]] += r["v"]
    return out


def test_operators_on_several_vectors(spark):
    a, x, y = sample(6, 5), np.arange(10.0).reshape(5, 2), np.arange(12.0).reshape(6, 2) - 3
    op = linalg.make_linear_operator(sparse(spark, a))
    plain = linalg.LinearOperator(op.shape, op.matvec, op.rmatvec)
    for o in (op, plain):
        assert np.array_equal(from_many(o.matmat(*many(spark, x)), (6, 2)), a @ x)
        assert np.array_equal(from_many(o.rmatmat(*many(spark, y)), (5, 2)), a.T @ y)
    assert op.matmat(*many(spark, x))._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    with pytest.raises(NotImplementedError):
        linalg.LinearOperator(op.shape, op.matvec).rmatmat(*many(spark, y))
    assert plain.dtype == op.dtype == "float64" and linalg.IdentityOperator(3).dtype == "float64"
    turn = linalg.LinearOperator((3, 3), lambda v: v.select("i", F.struct(F.lit(0.0).alias("re"), F.col("v").alias("im")).alias("v")))
    assert turn.dtype == "complex128"
    assert linalg.LinearOperator((3, 3), lambda v: v.select("i", F.col("v").cast("float").alias("v"))).dtype == "float32"


def test_several_right_sides(spark):
    rng = np.random.default_rng(2)
    s = rng.normal(size=(20, 8))
    a = s.T @ s + np.eye(8)
    x = np.stack([np.arange(8.0), np.ones(8), np.zeros(8)], axis=1)
    got, steps = linalg.cg_many(sparse(spark, a), many(spark, a @ x)[0], 3, tol=1e-10, conv_test_iters=1)
    assert np.allclose(from_many(got, x.shape), x) and steps[2] == 0 and 0 < steps[1] <= 16
    alone, _ = linalg.cg(sparse(spark, a), construct.vector(spark, a @ x[:, 0]), tol=1e-10, conv_test_iters=1)
    assert np.allclose([r["v"] for r in alone.df.orderBy("i").collect()], from_many(got, x.shape)[:, 0])
    assert isinstance(sparse(spark, a), SparseMatrix)


def test_products_with_dense_rows(spark):
    """A row with most of the entries, empty rows and columns, and batches that cut rows apart."""
    rng = np.random.default_rng(3)
    a = sample(40, 300)
    a[7], a[9:20] = 1, 0
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        for n in (1, 5):
            b = rng.integers(-4, 5, (300, n)).astype(float)
            got = sparse(spark, a) @ construct.dense_matrix(spark, b)
            assert np.array_equal(dense(got), a @ b)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert np.array_equal(dense(construct.make_empty(spark, (3, 2)) @ construct.dense_matrix(spark, np.ones((2, 4)))), np.zeros((3, 4)))


def test_packed_blocks(spark):
    a, x = sample(50, 33), np.arange(33.0) - 9
    a[20:31] = 0
    for side, piece in ((8, 1000), (16, 3), (64, 1000)):
        p = packed.PackedBlocks(sparse(spark, a), side, piece)
        assert p.df.agg(F.max(F.octet_length("rows"))).first()[0] <= 4 * max(piece, side * side)
        got = p.spmv(construct.vector(spark, x))
        assert np.allclose(values(got), a @ x)
        again = p.apply(p.stretches(construct.vector(spark, x)))
        assert np.allclose(values(p.vector(again, 50)), a @ x)
    square = sample(20, 20)
    p = packed.PackedBlocks(sparse(spark, square), 7)
    y = p.stretches(construct.vector(spark, np.ones(20)))
    for _ in range(3):
        y = p.apply(y)
    assert np.allclose(values(p.vector(y, 20)), np.linalg.matrix_power(square, 3) @ np.ones(20))
    with pytest.raises(ValueError):
        packed.PackedBlocks(sparse(spark, a).scale(1j))
