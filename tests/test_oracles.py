"""Every query with an oracle gives the same rows as its SQL."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tidegauge.plans.all_queries import oracle_sql, queries


def _plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return str(x) if hasattr(x, "isoformat") else x


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, sf, name):
    df = queries()[name](spark, sf)
    columns = sorted(df.columns)
    ours = Counter(tuple(map(_plain, r)) for r in df.select(*columns).collect())
    result = duck.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in result.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert {q for q in queries()} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
