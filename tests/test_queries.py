import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.plans import oracles
from palimpsest.plans import queries as Q

NAMES = sorted(Q.queries())


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf, db, name):
    df = Q.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(rounded(r[c]) for c in cols) for r in df.collect())
    want = db.sql(oracles.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == Counter(tuple(rounded(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(oracles.oracle_sql()) <= set(entry.queries())
