"""Operators against dense NumPy arrays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions import numbers as num
from latticework.operators import construct, convert, products, reduce, formats
from latticework.plans.matrix import SparseMatrix, Vector, isspmatrix_csr, issparse
from latticework.sources import matrix_market
from latticework.sources.matrix_market import mmread, mmwrite

DENSE = np.array([[2.0, 0, 0, 3, 0], [0, 0, 0, 0, 4], [0, 0, 0, 0, 0], [3, 0, 0, 0, 0], [0, 4, 0, 0, 0]])


def sample(m: int, n: int, seed: int = 471014) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.where(rng.random((m, n)) < 0.3, rng.integers(-5, 6, (m, n)), 0).astype(float)


def sparse(spark, array) -> SparseMatrix:
    i, j = np.nonzero(array)
    return construct.from_triples(spark, array[i, j], i, j, array.shape, "csr")


def dense(matrix) -> np.ndarray:
    out = np.zeros(matrix.shape)
    for r in matrix.df.collect():
        out[r["i"]] = r["row"]
    return out


def values(x: Vector) -> np.ndarray:
    out = np.zeros(x.size)
    for r in x.df.collect():
        out[r["i"]] = r["v"]
    return out


def test_elementwise(spark):
    a, b = sample(6, 5), np.roll(sample(6, 5), 1)
    x, y = sparse(spark, a), sparse(spark, b)
    assert np.array_equal(convert.to_numpy(x + y), a + b)
    assert np.array_equal(convert.to_numpy(x - y), a - b)
    assert np.array_equal(convert.to_numpy(x * y), a * b)
    assert np.array_equal(convert.to_numpy(-(2.5 * x)), -2.5 * a)
    assert np.array_equal(convert.to_numpy(x.multiply(construct.dense_matrix(spark, b))), a * b)
    assert np.array_equal(convert.to_numpy(x.multiply(construct.vector(spark, np.arange(5.0)))), a * np.arange(5.0))
    assert np.array_equal(dense(x + construct.dense_matrix(spark, b)), a + b)
    assert np.array_equal(convert.to_numpy(x.power(2)), a**2)
    with pytest.raises(ValueError):
        x + sparse(spark, sample(5, 5))
    with pytest.raises(TypeError):
        x + 1


def test_products(spark):
    a, b, v = sample(6, 5), sample(5, 4, 3), np.arange(1.0, 6.0)
    x, y = sparse(spark, a), sparse(spark, b)
    assert np.array_equal(values(x @ construct.vector(spark, v)), a @ v)
    assert np.array_equal(values(x.dot(construct.vector(spark, v), column_split=True)), a @ v)
    assert np.array_equal(convert.to_numpy(x @ y), a @ b)
    assert np.array_equal(dense(x @ construct.dense_matrix(spark, b)), a @ b)
    assert np.array_equal(dense(y.__rmatmul__(construct.dense_matrix(spark, a))), a @ b)
    assert products.spgemm_terms(x, y) == sum((a[:, k] != 0).sum() * (b[k] != 0).sum() for k in range(5))
    c, d = sample(6, 3, 5), sample(3, 5, 6)
    assert np.array_equal(convert.to_numpy(x.sddmm(construct.dense_matrix(spark, c), construct.dense_matrix(spark, d))), a * (c @ d))
    dist = {(r["i"], r["j"]): r["d"] for r in products.cdist(construct.dense_matrix(spark, c), construct.dense_matrix(spark, d.T)).collect()}
    assert all(np.isclose(dist[i, j], np.linalg.norm(c[i] - d.T[j])) for i in range(6) for j in range(5))


def test_structure_and_reductions(spark):
    a = sample(6, 5)
    x = sparse(spark, a)
    assert np.array_equal(convert.to_numpy(x.T), a.T) and x.T.format == "csc"
    assert np.array_equal(values(x.sum(axis=0)), a.sum(0)) and np.array_equal(values(x.sum(axis=-1)), a.sum(1))
    assert x.sum() == a.sum() and x.nnz == np.count_nonzero(a)
    for k in (-6, -2, 0, 3, 7):
        assert np.array_equal(values(x.diagonal(k)), np.diag(a, k) if -6 < k < 5 else np.zeros(0))
    assert construct.make_empty(spark, (3, 3)).sum() == 0
    pointers = {r["i"]: (r["start"], r["end"]) for r in convert.row_pointers(x).collect()}
    ends = np.cumsum((a != 0).sum(1))
    assert [pointers[k] for k in range(6)] == list(zip([0, *ends[:-1]], ends, strict=True))
    assert np.isclose(reduce.frobenius_norm(x), np.linalg.norm(a))


def test_formats(spark):
    a = sample(6, 5)
    x = sparse(spark, a)
    assert np.array_equal(convert.to_numpy(convert.from_compressed_rows(convert.compressed_rows(x), x.shape)), a)
    assert np.array_equal(convert.to_numpy(convert.from_compressed_columns(convert.compressed_columns(x), x.shape)), a)
    assert np.array_equal(dense(x.todense()), a)
    assert np.array_equal(convert.to_numpy(construct.from_dense(x.todense())), a)
    assert issparse(x) and isspmatrix_csr(x) and not isspmatrix_csr(x.tocsc())
    with pytest.raises(ValueError):
        x.asformat("bsr")


def test_constructors(spark):
    data = np.array([[1.0, 2, 3, 4]] * 3)
    expected = np.zeros((4, 4))
    for row, k in zip(data, (0, -1, 2), strict=True):
        for j in range(4):
            if 0 <= j - k < 4:
                expected[j - k, j] += row[j]
    assert np.array_equal(convert.to_numpy(construct.spdiags(spark, data, [0, -1, 2], 4, 4)), expected)
    for m, n, k in ((3, 4, 1), (4, 2, -1), (1, 1, 0)):
        assert np.array_equal(convert.to_numpy(construct.eye(spark, m, n, k)), np.eye(m, n, k))
    a, b = sample(3, 2), sample(2, 4, 2)
    assert np.array_equal(convert.to_numpy(construct.kron(sparse(spark, a), sparse(spark, b))), np.kron(a, b))
    assert np.array_equal(convert.to_numpy(construct.diags(spark, [[1.0, 2], 5.0], [1, 0], (3, 3))), np.diag([1.0, 2], 1) + 5 * np.eye(3))
    cells = construct.random(spark, 20, 10, 0.25, seed=3).df
    assert cells.count() == 50 == cells.select("i", "j").distinct().count()
    assert convert.to_numpy(construct.poisson2d(spark, 3))[4].tolist() == [0, -1, 0, -1, 4, -1, 0, -1, 0]
    with pytest.raises(ValueError):
        construct.diags(spark, [[1.0, 2.0]], [0], (3, 3))


def test_complex(spark):
    a = sample(4, 4) + 1j * sample(4, 4, 9)
    x = sparse(spark, a)
    assert np.allclose(convert.to_numpy(x @ x), a @ a) and np.allclose(convert.to_numpy(x.conj()), a.conj())
    assert np.isclose(x.sum(), a.sum()) and np.allclose(convert.to_numpy(x + x.T), a + a.T)
    assert num.common_dtype("float64", "complex64") == "complex128"


def test_ufuncs(spark):
    a = np.array([[0.5, -0.25, 0.0, 1.0, -1.5]])
    x = sparse(spark, a)
    for name in num.UFUNCS:
        got = {r["j"]: r["v"] for r in getattr(x, name)().df.collect()}
        with np.errstate(all="ignore"):
            want = getattr(np, name)(a[0])
        assert all(np.allclose(got[j], want[j], equal_nan=True) for j in got), name
    inverse = {r["j"]: r["v"] for r in (1 / SparseMatrix(x.df.withColumn("v", F.when(F.col("j") == 0, 0.0).otherwise(F.col("v"))), x.shape)).df.collect()}
    assert np.isinf(inverse[0]) and inverse[3] == 1


def test_tropical(spark):
    x = spark.createDataFrame([(0, 1, 5), (3, 1, 7), (4, -1, 0)], "i long, f0 long, f1 long")
    got = {r["i"]: (r["f0"], r["f1"]) for r in sparse(spark, DENSE).tropical_spmv(x).collect()}
    assert got == {0: (1, 7), 1: (0, 0), 2: (0, 0), 3: (1, 5), 4: (0, 0)}


def test_matrix_market(spark, tmp_path):
    path = tmp_path / "m.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real symmetric\n% a comment\n5 5 3\n1 1 2.0\n4 1  3.0\n5 2 4.0\n\n")
    a = mmread(spark, str(path))
    assert np.array_equal(convert.to_numpy(a), DENSE) and np.array_equal(convert.to_numpy(a + a), 2 * DENSE)
    mmwrite(a, str(tmp_path / "out"))
    assert np.array_equal(convert.to_numpy(mmread(spark, str(tmp_path / "out"))), DENSE)
    path.write_text("%%MatrixMarket matrix array real general\n1 1\n1\n")
    with pytest.raises(ValueError):
        mmread(spark, str(path))


def test_constructors_by_class_name(spark):
    data, indices, pointers = [2.0, 3, 4, 3, 4], [0, 3, 4, 0, 1], [0, 2, 3, 3, 4, 5]
    built = [
        formats.csr_matrix(spark, DENSE),
        formats.csr_array(spark, (data, indices, pointers), shape=(5, 5)),
        formats.coo_matrix(spark, (data, ([0, 0, 1, 3, 4], indices))),
        formats.csc_matrix(spark, formats.csr_matrix(spark, DENSE)),
        formats.csc_array(spark, (data, indices, pointers), shape=(5, 5)).T,
    ]
    for a, name in zip(built, ("csr", "csr", "coo", "csc", "csr"), strict=True):
        assert a.format == name and np.array_equal(convert.to_numpy(a), DENSE)
    assert [x.tolist() for x in convert.to_compressed_arrays(built[1])] == [data, indices, pointers]
    columns = formats.csc_matrix(spark, DENSE.T.copy())
    assert [x.tolist() for x in convert.to_compressed_arrays(columns)] == [data, indices, pointers]
    band = formats.dia_matrix(spark, ([[1.0, 2, 3], [4, 5, 6]], [0, 1]), shape=(3, 3))
    assert band.format == "dia" and np.array_equal(convert.to_numpy(band), [[1, 5, 0], [0, 2, 6], [0, 0, 3]])
    assert formats.csr_matrix(spark, (3, 4)).shape == (3, 4) and formats.coo_matrix(spark, DENSE, dtype="float32").dtype == "float32"
    for wrong in (lambda: formats.csr_matrix(spark, DENSE, shape=(2, 2)), lambda: formats.coo_matrix(spark, (data, indices, pointers))):
        with pytest.raises(ValueError):
            wrong()


def test_matrix_market_folder_whose_header_is_in_its_smallest_part(spark, tmp_path):
    (tmp_path / "part-0").write_text("%%MatrixMarket matrix coordinate real general\n% a comment\n200 200 199\n")
    (tmp_path / "part-1").write_text("".join(f"{k} {k} {k}.5\n" for k in range(1, 200)))
    a = mmread(spark, str(tmp_path))
    assert a.shape == (200, 200) and a.df.count() == 199 and a.df.agg(F.sum("v")).first()[0] == sum(range(1, 200)) + 199 / 2


def test_matrix_market_data_source(spark, tmp_path):
    a = sample(30, 20)
    head = "%%MatrixMarket matrix coordinate real general\n% a comment\n\n"
    rows = [(i, j) for i, j in zip(*np.nonzero(a), strict=True)]
    text = head + f"30 20 {len(rows)}\n" + "".join(f"{i + 1}\t {j + 1}  {a[i, j]}\n" + ("% note\n\n" if k % 9 == 0 else "") for k, (i, j) in enumerate(rows))
    (tmp_path / "a.mtx").write_text(text.rstrip("\n"))
    matrix_market.register(spark)
    for size in (1, 7, 64, 1 << 20):
        got = matrix_market.load(spark, str(tmp_path / "a.mtx"), size)
        assert got.shape == (30, 20) and {(r["i"], r["j"], r["v"]) for r in got.df.collect()} == {(i, j, a[i, j]) for i, j in rows} and got.nnz == len(rows)
    assert matrix_market.load(spark, f"file://{tmp_path}/a.mtx", 200).df.rdd.getNumPartitions() > 3
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n3 3 3\n1 1\n2 1\n3 2\n")
    got = spark.read.format("mtx").load(str(tmp_path / "s.mtx"))
    assert sorted(map(tuple, got.collect())) == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)]
    mmwrite(sparse(spark, a), str(tmp_path / "parts"))
    assert {(r["i"], r["j"], r["v"]) for r in matrix_market.load(spark, str(tmp_path / "parts"), 50).df.collect()} == {(i, j, a[i, j]) for i, j in rows}
    for wrong in ("%%MatrixMarket matrix array real general\n1 1\n", "no header\n", "%%MatrixMarket matrix coordinate real general\n"):
        (tmp_path / "wrong.mtx").write_text(wrong)
        with pytest.raises(ValueError):
            matrix_market.read_header(str(tmp_path / "wrong.mtx"))


def test_parts_of_a_matrix(spark):
    a = sample(6, 5)
    i, j = np.nonzero(a)
    m = sparse(spark, a)
    assert [r["v"] for r in m.data.orderBy("k").collect()] == a[i, j].tolist()
    assert [r["index"] for r in m.tocsr().indices.orderBy("k").collect()] == j.tolist()
    assert [r["i"] for r in m.tocoo().row.orderBy("k").collect()] == i.tolist() and [r["j"] for r in m.tocoo().col.orderBy("k").collect()] == j.tolist()
    by_column = sorted(zip(j.tolist(), i.tolist(), strict=True))
    assert [r["index"] for r in m.tocsc().indices.orderBy("k").collect()] == [x for _, x in by_column]
    ends = [r["end"] for r in m.tocsc().indptr.orderBy("i").collect()]
    assert ends == np.cumsum((a != 0).sum(axis=0)).tolist()
    moved = m.tocsr().with_indices(m.tocsr().indices.select("k", (4 - F.col("index")).alias("index")))
    got = np.zeros((6, 5))
    for r in moved.df.collect():
        got[r["i"], r["j"]] = r["v"]
    assert np.array_equal(got, a[:, ::-1])
    with pytest.raises(ValueError):
        m.todia().indices  # noqa: B018


def test_distinct_cells(spark, monkeypatch):
    """Cells are counted once, wherever they lie, from runs that are sorted and packed."""
    monkeypatch.setattr(reduce, "SORTED", 7)
    i, j = np.arange(60) * 7919 % 50, np.arange(60) % 5 * 199_999_999_999
    rows = spark.createDataFrame([(int(a), int(b), 1.0) for a, b in [*zip(i, j, strict=True)] * 2], "i long, j long, v double")
    a = SparseMatrix(rows, (50, 10**12))
    assert reduce.distinct_cells(a, 120).first()[0] == len(set(zip(i.tolist(), j.tolist(), strict=True)))
    assert reduce.distinct_cells(construct.make_empty(spark, (3, 4)), 0).first()[0] == 0
