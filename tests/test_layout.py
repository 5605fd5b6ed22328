"""Look-ups on laid-out tables: right rows, and only the files of one bucket read."""

from datetime import datetime

from pyspark.sql import functions as F

from pinwatch import schemas
from pinwatch.operators import lookups
from pinwatch.sinks import layout
from pinwatch.sinks.tables import append_audit

AT = datetime(2024, 3, 1)


def matches(spark, n=3000):
    rows = spark.range(n).select(
        F.concat(F.lit("m"), "id").alias("match_id"), F.concat(F.lit("CVE-"), F.col("id") % 97).alias("cve_id"),
        # a third of all rows are one service's
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 211)).alias("service_id"),
        F.lit("HIGH").alias("blast_radius"), F.lit("open").alias("status"), F.lit(AT).alias("detected_at"), F.lit(AT).alias("sla_deadline"),
    )
    return rows.unionByName(rows.limit(1).withColumn("service_id", F.lit(None).cast("string")).withColumn("match_id", F.lit("no service")), allowMissingColumns=True)


def files_read(df):
    """How many files the scans of a query read, from its own metrics; and its rows."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.finalPhysicalPlan()
    leaves = plan.collectLeaves()
    found = 0
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numFiles")
        if metric.isDefined():
            found += metric.get().value()
    return found, rows


def files_of(path, bucket):
    return len(list((path / bucket).glob("*.parquet")))


def test_a_look_up_reads_one_bucket(spark, tmp_path):
    path, rows = tmp_path / "matches", matches(spark)
    layout.append_clustered(rows, "vulnerability_matches", str(path), buckets=16)
    for key, value in (("service_id", "hot"), ("service_id", "s7"), ("cve_id", "CVE-5"), ("service_id", "unknown")):
        table = layout.read_clustered(spark, "vulnerability_matches", str(path), key, buckets=16)
        found = layout.only(table, key, value)
        read, got = files_read(found)
        assert {r.match_id for r in got} == {r.match_id for r in rows.filter(F.col(key) == value).collect()}
        bucket = spark.range(1).select(layout.bucket_of(F.lit(value), 16)).first()[0]
        assert read == files_of(path / f"by_{key}", f"{key}_of_16={bucket}")
        assert layout.only(table, key, None).count() == rows.count()


def test_the_lookup_operator_uses_the_layout(spark, tmp_path):
    rows = matches(spark)
    reports = rows.filter("match_id LIKE '%1'").select("match_id", F.lit("r").alias("report_id"))
    layout.append_clustered(rows, "vulnerability_matches", str(tmp_path / "m"))
    layout.append_clustered(reports.unionByName(reports), "triage_reports", str(tmp_path / "r"))
    table = layout.read_clustered(spark, "vulnerability_matches", str(tmp_path / "m"))
    stored = layout.read_clustered(spark, "triage_reports", str(tmp_path / "r"))
    for service in ("s7", "hot", "nobody", None):
        by_layout = lookups.vulnerability_exposure(table, stored, "2024-06-01 00:00:00", service)
        plain = lookups.vulnerability_exposure(rows.withColumn("resolved_at", F.lit(None).cast("timestamp")).withColumn("assigned_to", F.lit(None).cast("string")),
                                               reports, "2024-06-01 00:00:00", service)
        assert sorted(map(str, by_layout.collect())) == sorted(map(str, plain.collect()))


def test_merged_files_hold_the_same_rows(spark, tmp_path):
    for i in range(4):
        layout.append_clustered(matches(spark, 200).withColumn("match_id", F.concat("match_id", F.lit(f"-{i}"))), "vulnerability_matches", str(tmp_path / "a"), buckets=4)
    layout.merge_files(spark, "vulnerability_matches", str(tmp_path / "a"), str(tmp_path / "b"), buckets=4)
    for key in ("service_id", "cve_id"):
        before, after = (layout.read_clustered(spark, "vulnerability_matches", str(tmp_path / p), key, buckets=4) for p in "ab")
        assert before.exceptAll(after).count() == 0 and before.count() == after.count() == 804
        files = lambda p: len(list((tmp_path / p / f"by_{key}").rglob("*.parquet")))  # noqa: E731, B023
        assert files("b") <= 5 < files("a")


def test_the_audit_log_has_few_files_for_each_day(spark, tmp_path):
    entries = spark.range(2000).repartition(8).select(
        F.col("id").cast("string").alias("log_id"), F.timestamp_seconds(F.col("id") % 10 * 86_400).alias("created_at"))
    append_audit(entries, str(tmp_path / "audit"))
    assert len(list((tmp_path / "audit").rglob("*.parquet"))) <= 12
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2000
    assert "log_id" in schemas.TABLES["audit_log"]
