"""Every training-data query against its SQL on the smallest tables, and the set of queries itself."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from pinwatch.catalog.views import BASE
from pinwatch.llm.catalog import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in BASE:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def test_all_operators_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= names
    assert set(CHECKS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(row[c]) for c in columns) for row in df.collect())
    result = duck.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
