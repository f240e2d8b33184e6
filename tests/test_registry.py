"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from textloom.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: a spread over the families; the driver compares all of them
SOME = sorted(ORACLES)[::9]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 7)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    want = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
