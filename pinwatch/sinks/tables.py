"""Stored tables: schema-enforced appends, registry upsert, audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pinwatch import schemas
from pinwatch.operators.checks import foreign_key_violations
from pinwatch.plans.timeline import pick
from pinwatch.sources.tables import conform

# References between stored tables (child, column, parent).
REFERENCES = (
    ("vulnerability_matches", "cve_id", "vulnerabilities"),
    ("triage_reports", "match_id", "vulnerability_matches"),
)


def append_table(rows: DataFrame, name: str, path: str) -> None:
    """Append rows in exactly the table's schema."""
    conform(rows, schemas.TABLES[name]).write.mode("append").parquet(path)


def violations(name: str, child: DataFrame, parents: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows of ``child`` breaking each reference of the table."""
    return {
        column: foreign_key_violations(child, column, parents[parent])
        for table, column, parent in REFERENCES
        if table == name
    }


def registry_additions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows an insert-if-absent adds: one per unknown service id, known ones stay as they are."""
    rest = [c for c in new.columns if c != "service_id"]
    return pick(new, ["service_id"], rest).join(existing.select("service_id"), "service_id", "left_anti")


def upsert_registry(new: DataFrame, existing: DataFrame, path: str) -> None:
    append_table(registry_additions(new, existing), "service_registry", path)


def audit_rows(matches: DataFrame, created_at: Column) -> DataFrame:
    """Detection entries of the audit log."""
    return matches.select(
        F.sha2(F.concat_ws("|", F.lit("detection"), "match_id"), 256).alias("log_id"),
        F.lit("detection").alias("event_type"),
        F.col("match_id").alias("entity_id"),
        F.lit("matcher").alias("actor"),
        F.concat_ws(" ", F.lit("matched"), "cve_id").alias("action"),
        F.create_map(F.lit("service_id"), F.col("service_id"), F.lit("cve_id"), F.col("cve_id")).alias("metadata"),
        created_at.alias("created_at"),
    )


def append_audit(rows: DataFrame, path: str) -> None:
    """Append-only, one directory per day. Rows are gathered by day, in files of the size that adaptive execution
    aims at: a busy day is split over tasks, and a quiet one is one small file."""
    entries = conform(rows, schemas.TABLES["audit_log"]).withColumn("event_date", F.to_date("created_at"))
    entries.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(path)
