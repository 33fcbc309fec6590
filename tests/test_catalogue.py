"""Every query with SQL agrees with DuckDB on the smallest test tables, if they are there."""

import math
import os

import duckdb
import pytest

from threadmill.plans import reports, text_sql  # noqa: F401 - they add to the catalogue
from threadmill.plans.catalogue import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return str(round(float(v), 6)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = duck.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == want
