"""Every query with SQL against DuckDB on the smallest tables; the others must give rows."""

import math
import os

import duckdb
import pytest

from grainfield.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.5g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    rows = found.collect()
    if name not in SQL:
        assert found.columns
        return
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    theirs = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in rows) == theirs
