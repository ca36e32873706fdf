"""Every query against its SQL on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from tarnbeck.plans import oracle, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()))
    cursor = con.execute(oracle.SQL[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    want = sorted(repr(tuple(plain(r[order.index(c)]) for c in columns)) for r in cursor.fetchall())
    assert [x.replace(".0,", ",").replace(".0)", ")") for x in got] == [x.replace(".0,", ",").replace(".0)", ")") for x in want]


def test_every_query_has_sql():
    assert set(oracle.SQL) == set(queries.QUERIES)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
