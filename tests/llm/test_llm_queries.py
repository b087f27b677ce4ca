"""Every query of the subpackage with SQL gives the same rows as DuckDB, where the test data are at hand."""
from collections import Counter
from pathlib import Path

import pytest

from sylvan.llm.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equal(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test data")
    df = QUERIES[name](spark, str(DATA))
    got = [tuple(r) for r in df.collect()]
    if name in SQL:
        con = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        rel = con.sql(SQL[name])
        assert sorted(df.columns) == sorted(rel.columns)
        order = [rel.columns.index(c) for c in df.columns]
        assert Counter(got) == Counter(tuple(r[i] for i in order) for r in rel.fetchall())
