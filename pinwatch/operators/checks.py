"""Referential rules of the stored tables, as the rows that break them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def foreign_key_violations(child: DataFrame, column: str, parent: DataFrame, parent_column: str | None = None) -> DataFrame:
    """Child rows whose reference is set but has no parent."""
    keys = parent.select(F.col(parent_column or column).alias(column)).distinct()
    return child.filter(F.col(column).isNotNull()).join(keys, column, "left_anti").select(*child.columns)
