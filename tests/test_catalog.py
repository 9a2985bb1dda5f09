import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from brindle.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_sql(spark, tables, name):
    want = tables.sql(catalog.SQL[name])
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
