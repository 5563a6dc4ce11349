"""Every registered query of the core against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from millrace.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_sql(spark, duck, name):
    frame, sql = catalogue.queries()[name](spark, FOLDER), catalogue.oracle_sql()[name]
    expected = duck.sql(sql)
    columns = sorted(frame.columns)
    assert columns == sorted(expected.columns)
    places = [expected.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in places) for r in expected.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert got == want


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
