"""What a job leaves on disk and sends through exchanges, which at size is what fails first."""

import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pinwatch.catalog import exposure as catalog
from pinwatch.operators import graph, lookups, match
from pinwatch.plans.timeline import crowded_keys, pick
from pinwatch.session import stored_table
from pinwatch.sinks import delivery
from pinwatch.sinks.topics import latest_messages
from pinwatch.streaming import triggers
from tests.test_operators import cves, hours, ops, random_ops, rows

MESSAGE = "topic STRING, key STRING, value STRING"


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(n).getName() for n in range(files.size()) if files.apply(n).getName().startswith("shuffle_")}


def settled_shuffles(spark, before):
    """Removal is not waited for."""
    import time

    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition)", plan_of(df)[1]))


def test_what_is_stored_or_delivered_leaves_no_shuffle_files(spark, tmp_path):
    counted = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    before = shuffle_files(spark)
    table = stored_table(counted, "counted")
    delivery.deliver(counted, str(tmp_path), "counted", 0)
    assert not settled_shuffles(spark, before)
    assert table.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    file = next((tmp_path / "counted" / "batch-0").glob("*.parquet"))
    assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "ZSTD"


# --- messages of the stream -------------------------------------------------------------------------


def message(match, revision, topic, key="s"):
    return topic, key, f'{{"match_id":"{match}","revision":{revision}}}' if match is not None else "{}"


def test_the_last_word_on_each_match_takes_one_exchange(spark):
    told = [message("ab12", 0, "low"), message("ab12", 1, "high"), message("ab12", 1, "prs"), message("ab12", 1, "prs"), message("cd", 0, "low"),
            message("CD", 0, "low"), message("not hex", 2, "low"), message("not hex", 3, "low"), message("abc", 0, "low"), message("", 0, "low"), message(None, 0, "low")]
    got = latest_messages(spark.createDataFrame(told, MESSAGE))
    assert exchanges(got) == 1 and len(re.findall(r"\bSort \[", plan_of(got)[1])) == 1 and "Aggregate" not in plan_of(got)[1]
    expected = {("high", "ab12"), ("prs", "ab12"), ("low", "cd"), ("low", "CD"), ("low", "not hex"), ("low", "abc"), ("low", "")}
    found = got.select("topic", F.get_json_object("value", "$.match_id").alias("m")).collect()
    assert len(found) == len(expected) and {(r.topic, r.m) for r in found} == expected


def test_matches_of_one_interval_are_merged_with_none(spark):
    """Only intervals that may be the same match meet each other; the rest stay where the join has put them."""
    one = ("c", "s", "npm", "a", "1.0", hours(1), "a", hours(2), False, "A", 1.0, "LOW", 5.0)
    kind = ("cve_id string, service_id string, ecosystem string, package_key string, version string, since timestamp, package string, detected_at timestamp, "
            "is_new_dependency boolean, matched_package string, own_score double, own_tier string, score double, mixed boolean")
    found = spark.createDataFrame([(*one, False), (*one[:3], "b", *one[4:6], "b", *one[7:], True), (*one[:3], "b", *one[4:6], "B", hours(1), True, *one[9:], True)], kind)
    merged = triggers._merged(found, None, found.select("cve_id", "score"))
    assert rows(merged, "package_key", "package", "detected_at", "is_new_dependency", "score") == [("a", "a", hours(2), False, 5.0), ("b", "B", hours(1), True, 5.0)]
    alone = triggers._merged(found.withColumn("mixed", F.lit(False)), None, found.select("cve_id", "score"))
    assert alone.count() == 3


# --- order, neighbours, counts ------------------------------------------------------------------------


def test_an_operation_crosses_the_exchange_of_its_pin_once_and_alone(spark):
    o = random_ops(spark, 50)
    for df in (graph.timeline(o), graph.new_dependencies(o), graph.validity_intervals(o, mark_new=True)):
        assert exchanges(df) == 1 and "_rec" not in plan_of(df)[0]


def test_a_row_that_its_order_says_is_sent_once(spark):
    found = spark.createDataFrame([("c", "s", "1", 2), ("c", "s", "1", 1), ("c", "t", "1", None)], "cve_id string, service_id string, matched_version string, detected_at int")
    for last, expected in ((False, [("s", 1), ("t", None)]), (True, [("s", 2), ("t", None)])):
        got = pick(found, ["cve_id", "service_id", "matched_version"], ["detected_at"], last)
        assert rows(got, "service_id", "detected_at") == expected
        assert "min_by" not in plan_of(got)[0] and "max_by" not in plan_of(got)[0]


def test_crowded_keys_are_told_apart_where_their_numbers_meet(spark, monkeypatch):
    from pinwatch.plans import timeline

    df = spark.createDataFrame([("a", n) for n in range(5)] + [("b", n) for n in range(3)] + [("c", 0), (None, 0), (None, 1)], "k string, n int")
    real = timeline.F.xxhash64
    assert rows(crowded_keys(df, ["k"], 2), "k") == [("a",), ("b",)]
    monkeypatch.setattr(timeline.F, "xxhash64", lambda *c: real(timeline.F.lit(0)))  # all keys under one number
    assert rows(crowded_keys(df, ["k"], 4), "k") == [("a",)]
    assert crowded_keys(df, ["k"], 5) is None


# --- single queries -----------------------------------------------------------------------------------


def test_matches_seen_by_snapshots_are_made_once(spark):
    o = ops(spark, [(10, "s", "a", "added", "1.0"), (20, "s", "a", "updated", "2.0"), (30, "s", "a", "updated", "1.0"), (40, "s", "b", "added", "1.0"), (5, "t", "a", "added", "1.0"), (50, "t", "b", "added", "1.0")])
    c = cves(spark, [(0, "early", "a", "< 2"), (25, "between", "a", "< 2"), (45, "late", "a", "< 2"), (35, "waits", "a", "< 2")])
    got = match.match_asof(graph.states(o), o, c)
    at = lambda cve, service, time: (cve, service, hours(time))
    assert rows(got, "cve_id", "service_id", "detected_at") == sorted([
        at("early", "s", 10), at("between", "s", 30), at("waits", "s", 40), at("early", "t", 5), at("between", "t", 50), at("waits", "t", 50), at("late", "t", 50)])
    # The timeline and the join of versions are not in the last step, and what one state decides is not gathered.
    assert "Window" not in plan_of(got)[1] and "ranges-" not in plan_of(got)[1]


def test_an_interval_of_a_service_with_few_events_travels_once(spark):
    o = random_ops(spark, 200)
    columns = ["service_id", "ecosystem", "package", "version", "trigger_event_id", "snapshot_at"]
    whole, split = graph._by_month(o, o, None), graph._by_month(o, o, None, limit=1)
    assert rows(whole, *columns) == rows(split, *columns) == rows(graph.snapshot_rows(o, o), *columns)
    years = ops(spark, [(0, "s", "a", "added", "1"), (24 * 2000, "s", "b", "added", "1")])
    assert graph._by_month(years, years, None).select("month").distinct().count() == 1
    assert graph._by_month(years, years, None, limit=1).select("month").distinct().count() == 2
    # Operations by pin, states and events by service; maps are made where these meet.
    assert exchanges(graph.snapshot_history(o, o)) <= 3


def test_findings_of_single_intervals_meet_no_neighbours(spark, monkeypatch):
    met, real = [], lookups.with_neighbours
    monkeypatch.setattr(lookups, "with_neighbours", lambda df, keys, *rest: met.append((keys, df)) or real(df, keys, *rest))
    o = ops(spark, [(0, "s", "a", "added", "1.0"), (9, "s", "a", "removed", None), (20, "s", "a", "added", "1.1"), (1, "t", "a", "added", "1.0"), (5, "t", "a", "updated", "1.1"),
                    (7, "t", "a", "updated", "3.0")])
    c = cves(spark, [(2, "c", "a", "< 2"), (10, "late", "a", "< 2")])
    got = lookups.auto_resolve(o, c)
    assert rows(got, "cve_id", "service_id", "detected_at", "resolved_at") == sorted([
        ("c", "s", hours(2), hours(9)), ("c", "s", hours(20), None), ("late", "s", hours(20), None), ("c", "t", hours(2), hours(7))], key=str)
    assert "Exchange hashpartitioning(cve_id" not in plan_of(got)[1]  # findings of a pin travel together
    joined = [df for keys, df in met if "cve_id" in keys]
    assert joined and {r.service_id for df in joined for r in df.collect()} == {"t"}


def test_current_matches_read_their_pins_from_a_table(spark):
    from pinwatch.catalog.views import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert "/ops-" not in plan_of(catalog.current_routed(t))[1]
