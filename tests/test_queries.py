"""Every query of the core with SQL gives the same rows as DuckDB on small generated or given tables; skipped where there are none."""

import glob
import os

import pytest

import __spark_entry__
from helixlake import queries as core

TABLES = os.environ.get("HELIXLAKE_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
SQL = core.SQL


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.5g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, TABLES)
    names = sorted(got.columns)
    a = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    rel = duck.execute(SQL[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == names
    b = sorted(tuple(plain(r[cols.index(c)]) for c in names) for r in rel.fetchall())
    assert a == b


def test_names_and_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
