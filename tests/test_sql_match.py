"""Every query of the knowledge base that has SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from quern.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for f in glob.glob(folder + "/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match(spark, con, folder, name):
    got = QUERIES[name](spark, folder)
    cols = sorted(got.columns)
    a = [tuple(_plain(r[c]) for c in cols) for r in got.collect()]
    want = con.sql(SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    b = [tuple(_plain(r[i]) for i in at) for r in want.fetchall()]
    assert sorted(a, key=repr) == sorted(b, key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, folder, name):
    found = QUERIES[name](spark, folder)
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)
