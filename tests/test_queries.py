"""Every query runs on the smallest tables and, where it has SQL, returns what DuckDB returns."""

import os

import duckdb
import pytest

from quire.plans import format_queries, more_queries, scalar_queries  # noqa: F401  registers their queries
from quire.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(names).collect()), key=repr)
    if name not in SQL:
        assert rows
        return
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == names
    assert rows == sorted((tuple(map(plain, r)) for r in found.select(*[f'"{c}"' for c in names]).fetchall()), key=repr)
