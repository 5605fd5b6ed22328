"""Stored tables with enforced schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pinwatch import schemas


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Exactly the contract's columns and types; missing ones are NULL, extra ones go."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.struct_of(schema).fields
        ]
    )


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.schema(schemas.TABLES[name]).parquet(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Service dimension, joined once per query instead of looked up per row."""
    return read_table(spark, "service_registry", path)


def read_registry_jdbc(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """The same dimension from a database; needs the vendor's driver on the class path."""
    frame = spark.read.format("jdbc").option("url", url).option("dbtable", "service_registry")
    return conform(frame.options(**options).load(), schemas.SERVICE_REGISTRY)
