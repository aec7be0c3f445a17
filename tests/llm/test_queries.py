"""Queries of the problems with SQL give the same rows as DuckDB on the given tables; skipped where there are none."""

import pytest

from helixlake.llm.queries import QUERIES, SQL
from tests.test_queries import TABLES, duck, plain, pytestmark  # noqa: F401


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):  # noqa: F811
    got = QUERIES[name](spark, TABLES)
    names = sorted(got.columns)
    rel = duck.execute(SQL[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == names
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == sorted(tuple(plain(r[cols.index(c)]) for c in names) for r in rel.fetchall())
