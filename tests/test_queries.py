"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from starfold import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    one = lambda v: f"{v:.6g}" if isinstance(v, float) else str(list(v)) if isinstance(v, list) else str(v)
    return sorted(tuple(one(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, name):
    got = catalog.queries()[name](spark, SF)
    expected = oracle.sql(SQL[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(expected.fetchall(), expected.columns)
