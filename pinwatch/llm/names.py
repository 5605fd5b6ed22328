"""Names of helper columns that no column of the input has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def spare(name: str, taken: Iterable[str]) -> str:
    """``name`` with underscores before it until no column has it, whatever the case."""
    taken = {c.lower() for c in taken}
    name = f"__{name}"
    while name in taken:
        name = f"_{name}"
    return name


def plain(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by name, for a select on something derived from it."""
    return [F.col(f"`{c}`") for c in df.columns]
