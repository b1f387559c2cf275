"""Every registered query against its SQL twin, or against its being well-formed, at the smallest size."""

import math
import os
from decimal import Decimal

import pytest

import __spark_entry__

FOLDER = os.environ.get("DOCKETRY_TEST_DATA", "/root/testdata/sf0.001")
QUERIES = __spark_entry__.queries()
SQL = __spark_entry__.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        path = os.path.join(FOLDER, name)
        connection.sql(f"create view {name.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.collect()
    if name not in SQL:
        assert df.columns
        return
    other = duck.sql(SQL[name])
    assert sorted(other.columns) == sorted(df.columns)
    at = [df.columns.index(c) for c in other.columns]
    assert sorted(tuple(plain(r[i]) for i in at) for r in got) == sorted(tuple(map(plain, r)) for r in other.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
