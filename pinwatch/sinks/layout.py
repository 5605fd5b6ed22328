"""Stored tables laid out for look-ups: one folder per bucket of a key, rows in order of the key in each file.

A look-up of one key reads the files of one bucket, and of these the row groups whose range and Bloom
filter may hold it. The bucket is a partition column whose name says the key and the number of buckets,
so whoever reads the table can tell which one to read. A table that is looked up by several keys is
stored once for each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pinwatch import schemas
from pinwatch.sources.tables import conform

BUCKETS = 64
#: Keys that the stored tables are looked up by; the first one is the default.
LOOKUP_KEYS = {
    "vulnerabilities": ("cve_id",),
    "vulnerability_matches": ("service_id", "cve_id"),
    "triage_reports": ("match_id",),
    "dep_graph_snapshots": ("service_id",),
    "service_registry": ("service_id",),
}


def bucket_column(key: str, buckets: int = BUCKETS) -> str:
    return f"{key}_of_{buckets}"


def bucket_of(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def clustered(rows: DataFrame, key: str, buckets: int = BUCKETS, *order: str) -> DataFrame:
    """Rows with their bucket, a bucket in as few tasks as its size allows, in order of the key. Adaptive
    execution splits a bucket that a frequent key fills, and puts small ones together."""
    column = bucket_column(key, buckets)
    return rows.withColumn(column, bucket_of(F.col(key), buckets)).hint("rebalance", column).sortWithinPartitions(column, key, *order)


def write_clustered(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS, *order: str, mode: str = "append") -> None:
    writer = clustered(rows, key, buckets, *order).write.mode(mode).partitionBy(bucket_column(key, buckets))
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def append_clustered(rows: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Append to a stored table in exactly its schema, below ``path`` once for each key it is looked up by."""
    held = conform(rows, schemas.TABLES[name])
    for key in LOOKUP_KEYS[name]:
        write_clustered(held, f"{path}/by_{key}", key, buckets)


def read_clustered(spark: SparkSession, name: str, path: str, key: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """A stored table as laid out for ``key``."""
    key = key or LOOKUP_KEYS[name][0]
    return spark.read.schema(f"{schemas.TABLES[name]}, {bucket_column(key, buckets)} INT").parquet(f"{path}/by_{key}")


def merge_files(spark: SparkSession, name: str, path: str, target: str, buckets: int = BUCKETS) -> None:
    """Write a table anew below ``target``, with the files that many appends left in a bucket merged."""
    for key in LOOKUP_KEYS[name]:
        rows = read_clustered(spark, name, path, key, buckets).drop(bucket_column(key, buckets))
        write_clustered(rows, f"{target}/by_{key}", key, buckets, mode="overwrite")


def only(df: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key; of a table laid out for it the one bucket is read. Without a value, all rows."""
    if value is None:
        return df
    found = df.filter(F.col(key) == value)
    for column in df.columns:
        if laid_out := re.fullmatch(rf"{re.escape(key)}_of_(\d+)", column):
            found = found.filter(F.col(column) == bucket_of(F.lit(value).cast(df.schema[key].dataType), int(laid_out[1])))
    return found
