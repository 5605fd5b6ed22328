"""Every registered query against its checking SQL on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from pinwatch.catalog import all_checks, all_queries
from pinwatch.catalog.views import BASE

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = all_queries(), all_checks()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in BASE:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value.isoformat() if hasattr(value, "isoformat") else value


def test_every_query_has_a_check():
    assert sorted(QUERIES) == sorted(CHECKS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(row[c]) for c in columns) for row in df.collect())
    result = duck.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert got == expected
