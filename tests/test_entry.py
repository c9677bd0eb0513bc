"""The contract: queries run on the driver's tables and agree with their DuckDB statements."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from latticework.plans import catalogue

D = "/root/testdata/sf0.001"
SAMPLE = ["coo_from_table", "coo_to_csr_indptr", "csr_to_dense", "kron", "diagonal_k", "ufunc_log1p", "add", "multiply", "spmv", "matvec_2d", "spgemm_csr", "sddmm", "cdist", "tropical_spmv", "independent_sets", "independent_sets_wide", "hamiltonian_wide", "balance", "spgemm_grid", "repeated_products", "random_bounds", "csr_indices", "matrix_market_source", "add_dense", "cg_many", "lsqr", "eigsh"]


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, name):
    got = catalogue.QUERIES[name](spark, D).toPandas()
    con = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(catalogue.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(df):
        return sorted(tuple(round(float(x), 6) for x in r) for r in df[columns].itertuples(index=False))

    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
