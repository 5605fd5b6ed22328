"""Vulnerability feeds as stored files: score feed responses, advisory corpus, modification index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pinwatch import schemas
from pinwatch.functions.scalars import lenient_timestamp


def read_nvd(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per item of the stored response bodies (one body per file, or per line)."""
    bodies = spark.read.schema(schemas.NVD_RESPONSE).option("multiLine", multi_line).json(path)
    return bodies.select(F.explode("vulnerabilities").alias("item")).select("item.cve.*")


def read_osv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Advisories below ``<path>/<ecosystem>/``; unreadable entries keep a NULL id and their text."""
    schema = f"{schemas.OSV_RECORD}, _corrupt_record STRING"
    return (
        spark.read.schema(schema)
        .option("multiLine", multi_line)
        .option("recursiveFileLookup", True)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
        .withColumn("feed_ecosystem", F.regexp_extract("_metadata.file_path", r"([^/=]+)/[^/]+$", 1))
        .withColumn("modified_at", lenient_timestamp(F.col("modified")))
    )


def readable(records: DataFrame) -> DataFrame:
    """Skip entries that did not parse; one bad entry never fails the load."""
    return records.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_osv_index(spark: SparkSession, path: str) -> DataFrame:
    """Headerless (modified, id) lines; lines without both parts or with a bad time are skipped."""
    lines = spark.read.schema(schemas.OSV_INDEX).option("mode", "PERMISSIVE").csv(path)
    return lines.select(
        lenient_timestamp(F.trim("modified"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified_at"),
        F.trim("id").alias("id"),
    ).filter("modified_at IS NOT NULL AND id IS NOT NULL")
