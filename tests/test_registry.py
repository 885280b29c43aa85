"""Every registered query of the engine against its SQL, in DuckDB."""

import glob
import os

import duckdb
import pytest

from vecstrata.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(map(str, (tuple(r) for r in df.select(cols).collect())))
    if name not in SQL:
        assert rows
        return
    result = con.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(str(tuple(r[i] for i in at)) for r in result.fetchall()) == rows


def test_entry_points_exist():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and callable(entry.entry)
