"""What the plans must not contain, and what must reach the scan."""

import pytest
from pyspark.sql import functions as F

from pinwatch.catalog import all_queries
from pinwatch.catalog.views import Tables
from pinwatch.operators import posture, search
from pinwatch.plans.exposure import exposure

FOLDER = "/root/testdata/sf0.001"
FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")
BATCH = [
    "exposure_matches", "exposure_by_topic", "cve_dep_join", "match_both_orders", "match_asof_reference", "scd2_dependencies",
    "dep_snapshot_history", "auto_resolve", "pr_risk_gate", "get_remediation_path", "dedup_first_24h", "cvss_enrich", "archive_bump_events",
    "chunk_documents", "embedding_topk", "posture_breakdown", "get_compliance_gaps", "team_exposure_agg",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_nested_loops_and_no_python(spark, name):
    text = plan_of(all_queries()[name](spark, FOLDER))
    assert not [node for node in FORBIDDEN if node in text]


def test_only_needed_columns_are_read(spark):
    t = Tables(spark, FOLDER)
    text = plan_of(posture.open_counts(t.matches, "2001-08-02 00:00:00"))
    schema = text[text.index("ReadSchema: "):]
    assert "o_custkey" not in schema and "o_orderdate" in schema


def test_rank_limit_runs_before_the_shuffle(spark):
    vectors = Tables(spark, FOLDER).base("embeddings")
    text = plan_of(search.topk_per_collection(vectors, search.mean_vector(vectors)))
    assert text.count("WindowGroupLimit") == 2


def test_flagship_joins_large_sides_by_key(spark):
    """With broadcasting off, every join is an equi-join by shuffle, which adaptive execution can split."""
    t = Tables(spark, FOLDER)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_of(exposure(t.ops, t.vulns, t.registry))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text and "Broadcast" not in text and "Cartesian" not in text


def test_time_is_an_argument(spark):
    text = plan_of(all_queries()["posture_report"](spark, FOLDER))
    assert "current_timestamp" not in text and "now()" not in text


def test_a_package_everyone_uses_is_split(spark):
    """A third of all pins hold one package: joined in shares, with the same result."""
    from pyspark.sql import functions as F

    from pinwatch.operators import match
    from tests.test_operators import cves

    pins = spark.range(300_000).select(
        F.concat(F.lit("svc-"), F.col("id")).alias("service_id"),
        F.when(F.col("id") % 7 == 0, "npm").otherwise("pypi").alias("ecosystem"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 5000)).alias("package"),
        F.when(F.col("id") % 11 == 0, "1.1").otherwise("1.0").alias("version"),
    ).repartition(16)
    hot = [(0, f"H{i}", "hot", "< 2", [], "") for i in range(3)]
    known = cves(spark, hot + [(0, f"C{i}", f"p{i}", "< 2", [], "") for i in range(200)])
    plain, spread = match.match_pins(pins, known), match.match_pins(pins, known, limit=10_000)
    expected = 300_000 // 3 * 3 + pins.filter("package <> 'hot' AND cast(substring(package, 2) AS int) < 200").count()
    columns = ["service_id", "ecosystem", "package", "version", "cve_id"]
    summed = [df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first() for df in (plain, spread)]
    assert summed[0] == summed[1] and summed[0][0] == expected
    assert "_share" in plan_of(spread) and "_share" not in plan_of(plain)
    whole, shared = match.affected_versions(pins, known), match.affected_versions(pins, known, limit=5)
    assert "_share" in plan_of(shared) and "_share" not in plan_of(whole)
    assert shared.exceptAll(whole).count() == 0 and whole.exceptAll(shared).count() == 0


def test_poll_figures_are_observed_in_the_pass_that_writes(spark, tmp_path):
    from pyspark.sql import Observation

    from pinwatch.operators import cursors
    from pinwatch.streaming import flows
    from pinwatch.streaming.progress import ObservedFigures

    records = spark.createDataFrame([("osv", "a"), ("osv", None), ("nvd", "b"), ("other", "c"), (None, "d")] * 7, "source string, cve_id string")
    sources, good = ["osv", "nvd", "none"], F.col("cve_id") != "b"
    seen = Observation("poll")
    watched = cursors.observed_poll(records, good, sources, seen)
    assert watched._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + watched._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1
    watched.write.parquet(str(tmp_path / "batch"))
    want = sorted((r.source, r.fetched, r.published, r.skipped) for r in cursors.poll_summary(records.filter("source IN ('osv', 'nvd')"), good).collect())
    assert sorted(cursors.observed_summary([seen.get], sources)) == want
    records.coalesce(1).write.parquet(str(tmp_path / "in"))
    records.filter("source = 'osv'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    figures = ObservedFigures("poll")
    spark.streams.addListener(figures)
    try:
        stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        sink = lambda df: (df.writeStream.format("parquet").option("path", str(tmp_path / "out"))
                           .option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True))
        flows.start(cursors.observed_poll(stream, good, sources, "poll"), sink).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(figures)
    assert len(figures.figures) >= 2
    assert dict((s, f) for s, f, _, _ in cursors.observed_summary(figures.figures, sources)) == {"osv": 28, "nvd": 7}


def test_the_flagship_reads_the_operations_once(spark, tmp_path, monkeypatch):
    from pinwatch.plans import exposure as plan
    from tests.test_operators import cves, ops

    rows = ops(spark, [(0, "s", "PyYAML", "added", "1.0"), (1, "s", "pyyaml", "added", "1.0"), (2, "t", "x", "added", "1.0")])
    rows.write.parquet(str(tmp_path / "ops"))
    stored = spark.read.parquet(str(tmp_path / "ops"))
    written = []
    real = plan.stored_table
    monkeypatch.setattr(plan, "stored_table", lambda df, label: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, label))
    registry = spark.createDataFrame([], "service_id string, team string, is_customer_facing boolean, pci_scope boolean, hipaa_scope boolean, soc2_scope boolean, pii_handler boolean")
    found = plan.exposure(stored, cves(spark, [(0, "C", "pyyaml", "< 2")]), registry, mark_new=True)
    scans = [text.count("event_id") for text in written]
    assert sum("op_rank" in text for text in written) == 1 and len(scans) == 2
    assert "op_rank" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 1


def test_a_scope_removes_what_was_stored_inside(spark):
    import os

    from pinwatch.session import scratch_path, scratch_scope, stored_table

    stays = scratch_path(spark, "stays")
    with scratch_scope(spark):
        inside = stored_table(spark.range(3), "inside")
        path = inside.inputFiles()[0].removeprefix("file://")
        inside.write.parquet(stays)
        assert os.path.exists(path)
    assert not os.path.exists(path) and spark.read.parquet(stays).count() == 3


def test_first_detections_travel_without_the_rest(spark):
    text = all_queries()["match_idempotent"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "blast_radius_tier" not in text and "sla_deadline" not in text


def test_operations_read_several_times_are_joined_once(spark):
    t = Tables(spark, FOLDER)
    assert t.ops_once is t.ops_once and "Join" not in t.ops_once._jdf.queryExecution().optimizedPlan().toString()
    for name in ("auto_resolve", "match_asof_reference", "eco_wildcard"):
        assert "lineitem" not in all_queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
