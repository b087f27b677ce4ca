"""Every core query with SQL gives the same rows as DuckDB, where the test data are at hand."""
from collections import Counter
from pathlib import Path

import pytest

from sylvan.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns] if len(set(df.columns)) == len(df.columns) else range(len(df.columns))
    assert Counter(tuple(r) for r in df.collect()) == Counter(tuple(r[i] for i in order) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    if not DATA.exists():
        pytest.skip("no test data")
    QUERIES[name](spark, str(DATA)).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())
