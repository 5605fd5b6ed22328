"""Streams whose triggers are batch joins, over several triggers, compared with their batch twins."""

import pytest
from pyspark.sql import functions as F

from pinwatch.operators import graph, match, vulnerabilities as V
from pinwatch.plans import exposure as plan
from pinwatch.sinks import delivery
from pinwatch.sinks.topics import keyed_matches, latest_messages
from pinwatch.sources import changes
from pinwatch.streaming import flows, triggers
from tests.test_operators import cves, detected, hours, ops, random_ops, rows

MATCH = (
    "cve_id STRING, service_id STRING, ecosystem STRING, package STRING, version STRING, detected_at TIMESTAMP, is_new_dependency BOOLEAN, "
    "matched_package STRING, cvss_score DOUBLE, severity_tier STRING"
)
MESSAGE = "topic STRING, key STRING, value STRING"


def joined(spark, base, steps, hours_=None, twice=False):
    """Triggers of (operations, vulnerabilities), each row a stream's row of its own kind."""
    known, out = str(base / "known"), str(base / "out")
    for number, (o, c) in enumerate(steps):
        each = triggers.join_triggers(spark, known, lambda _, o=o, c=c: (o, c), lambda r, b: delivery.deliver(r, out, "matches", b), hours_)
        for _ in range(1 + twice):
            each(o, number)
    return delivery.delivered(spark, out, "matches", MATCH)


@pytest.mark.parametrize("twice", [False, True])
def test_triggers_match_in_both_orders(spark, tmp_path, twice):
    o = ops(spark, [(10, "s", "a", "added", "1.0"), (30, "s", "a", "updated", "3.0"), (5, "t", "A", "added", "1.0"), (50, "t", "A", "removed", None),
                    (51, "u", "a", "added", "1.5")])
    c = cves(spark, [(0, "early", "a", "< 2"), (20, "between", "A", "< 2"), (40, "late", "a", ">= 3, != 3.1"), (60, "list", "a", "", ["1.5"]),
                     (61, "early", "a", "< 2"), (62, "anywhere", "a", "< 2", [], "")])
    expected = detected(match.match_both_orders(graph.validity_intervals(o), V.dedup_first_ever(c)))
    cut = F.lit(hours(25))
    steps = [(o.filter(F.col("occurred_at") < cut), c.filter(F.col("ingested_at") < cut)), (o.filter(F.col("occurred_at") >= cut), c.filter(F.col("ingested_at") >= cut))]
    got = joined(spark, tmp_path, steps, twice=twice)
    assert detected(got) == expected
    assert detected(joined(spark, tmp_path / "one", [(o, c)])) == expected


def test_an_older_operation_and_a_repeated_record_change_nothing(spark, tmp_path):
    o, c = ops(spark, [(10, "s", "a", "added", "1.0")]), cves(spark, [(0, "c", "a", "< 2")])
    got = joined(spark, tmp_path, [(o, c), (ops(spark, [(5, "s", "a", "removed", None)]), cves(spark, [(20, "c", "a", "< 2")]))])
    assert len(detected(got)) == 1
    # Another record of the vulnerability covers a version that is reported already.
    got = joined(spark, tmp_path / "b", [(o, c), (o.filter("false"), cves(spark, [(20, "c", "a", "< 3")]))])
    assert len(detected(got)) == 1


def test_a_vulnerability_expires_between_triggers(spark, tmp_path):
    none = cves(spark, [(0, "c", "a", "< 2")]).filter("false")
    steps = [(ops(spark, [(1, "s", "a", "added", "1.0")]), cves(spark, [(0, "c", "a", "< 2")])), (ops(spark, [(9, "t", "a", "added", "1.0")]), none),
             (ops(spark, [(11, "u", "a", "added", "1.0")]), none)]
    got = joined(spark, tmp_path, steps, hours_=10)
    assert sorted(r.service_id for r in got.collect()) == ["s", "t"]
    assert spark.read.parquet(str(tmp_path / "known" / "records" / "batch-2")).count() == 0


def test_scores_spellings_and_reruns_across_triggers(spark, tmp_path):
    o = ops(spark, [(10, "s", "a", "added", "1.0"), (12, "s", "A", "added", "1.0"), (14, "t", "a", "added", "1.0")])
    late = ops(spark, [(30, "s", "a", "removed", None), (40, "s", "a", "added", "1.0"), (41, "v", "a", "added", "1.0")])
    c = cves(spark, [(0, "c", "a", "< 2"), (20, "d", "a", "< 2")])
    scored = lambda at, value: cves(spark, [(at, "c", "", "")]).withColumns({"cvss_score": F.lit(value), "source": F.lit("nvd")})
    registry = spark.createDataFrame([("s", "red", True, True, False, False, False)],
                                     "service_id string, team string, is_customer_facing boolean, pci_scope boolean, hipaa_scope boolean, soc2_scope boolean, pii_handler boolean")
    known, out = str(tmp_path / "known"), str(tmp_path / "out")
    steps = [(o, c, scored(1, 2.0)), (late, c.filter("false"), scored(2, 9.5)), (o.filter("false"), c.filter("false"), scored(1, 5.0))]
    for number, step in enumerate(steps):
        each = triggers.exposure_triggers(spark, known, lambda _, step=step: step, registry, lambda r, b: delivery.deliver(r, out, "messages", b))
        for _ in range(2 if number == 1 else 1):
            each(o, number)
    got = latest_messages(delivery.delivered(spark, out, "messages", MESSAGE))
    news = c.withColumn("source", F.lit("osv")).unionByName(scored(2, 9.5), allowMissingColumns=True)
    expected = keyed_matches(plan.routed_exposure(o.unionByName(late), news, registry))
    told = lambda df: sorted((r.topic, r.key) for r in df.collect())
    assert told(got) == told(expected)
    # An older score that arrives last sends nothing.
    assert spark.read.schema(MESSAGE).parquet(f"{out}/messages/batch-2").count() == 0


def test_the_streams_keep_no_rows_in_python(spark):
    """State per key in Python is what the size of a key used to limit."""
    from pinwatch.catalog import all_queries

    started = []
    start = flows.start
    try:
        flows.start = lambda stream, *rest, **more: started.append(stream._jdf.queryExecution().logical().toString()) or start(stream, *rest, **more)
        all_queries()["stream_symmetric_join"](spark, "/root/testdata/sf0.001")
    finally:
        flows.start = start
    assert started and not any("TransformWithState" in text for text in started)


def handled_by(spark, name):
    """The plans of the streams that a query starts."""
    from pinwatch.catalog import all_queries

    started = []
    start = flows.start
    try:
        flows.start = lambda stream, *rest, **more: started.append(stream._jdf.queryExecution().logical().toString()) or start(stream, *rest, **more)
        all_queries()[name](spark, "/root/testdata/sf0.001")
    finally:
        flows.start = start
    return started


# --- snapshots -------------------------------------------------------------------------------------


def change_events(spark, o):
    """Operations as change events, one per event and ecosystem."""
    pin = lambda op: F.collect_list(F.when(F.col("op") == op, F.struct("package", "version")))
    listed = o.orderBy("pos").groupBy("event_id", "service_id", "ecosystem", "occurred_at").agg(pin("added").alias("added"), pin("removed").alias("removed"), pin("updated").alias("_u"))
    updated = F.transform("_u", lambda u: F.struct(u["package"].alias("package"), F.lit(None).cast("string").alias("from_version"), u["version"].alias("to_version")))
    return listed.withColumn("updated", updated).drop("_u")


def snapshots(spark, base, steps, twice=False):
    known, out = str(base / "known"), str(base / "out")
    for number, events in enumerate(steps):
        each = triggers.snapshot_triggers(spark, known, lambda r, b: delivery.deliver(r, out, "snapshots", b))
        for _ in range(1 + twice):
            each(events, number)
    return spark.read.parquet(*[f"{out}/snapshots/batch-{n}" for n in range(len(steps))])


def held(df):
    return sorted((r.service_id, r.trigger_event_id, str(r.snapshot_at), r.ecosystem, tuple(sorted(r.dependencies.items()))) for r in df.collect())


@pytest.mark.parametrize("block", [1, 3, 256])
def test_triggers_take_a_snapshot_after_every_event(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(triggers, "BLOCK", block)
    events = change_events(spark, random_ops(spark, 200)).cache()
    expected = held(graph.snapshot_history(changes.explode_changes(events), changes.explode_changes(events)))
    cuts = events.selectExpr("percentile(unix_micros(occurred_at), array(0.3, 0.6)) AS p").first().p
    at = F.unix_micros("occurred_at")
    steps = [events.filter(at <= cuts[0]), events.filter((at > cuts[0]) & (at <= cuts[1])), events.filter(at > cuts[1])]
    assert len(expected) > 100
    assert held(snapshots(spark, tmp_path / "one", [events])) == expected
    assert held(snapshots(spark, tmp_path / "three", steps, twice=block == 3)) == expected


def test_a_late_event_sees_what_is_newer_and_an_empty_one_what_stands(spark, tmp_path):
    first = change_events(spark, ops(spark, [(10, "s", "a", "added", "2.0"), (10, "t", "a", "added", "1.0")]))
    late = change_events(spark, ops(spark, [(5, "s", "a", "added", "1.0"), (6, "s", "b", "added", "1.0")]))
    empty = late.filter("false").unionByName(first.filter("service_id = 't'").withColumns({
        "event_id": F.lit("nothing"), "occurred_at": F.lit(hours(20)), "added": F.array().cast(first.schema["added"].dataType)}))
    got = held(snapshots(spark, tmp_path, [first, late, empty]))
    assert [(r[0], r[2][:13], r[4]) for r in got if r[0] == "s"] and {r[4] for r in got if r[0] == "s"} == {(("a", "2.0"),), (("a", "2.0"), ("b", "1.0"))}
    assert sorted(r[1] == "nothing" for r in got if r[0] == "t") == [False, True]


def test_snapshots_keep_no_rows_in_python(spark):
    started = handled_by(spark, "stream_snapshots")
    assert started and not any("TransformWithState" in text for text in started)


# --- first records and dependency state --------------------------------------------------------------


def test_triggers_remember_first_records(spark, tmp_path):
    untimed = cves(spark, [(0, "C", "a", "< 2")]).withColumn("ingested_at", F.lit(None).cast("timestamp"))
    c = cves(spark, [(h, "C", "a", "< 2") for h in (0, 6, 20, 30, 40, 54, 55)] + [(h, "D", "a", "< 2") for h in (23, 24, 47, 48)])
    late = cves(spark, [(1, "C", "a", "< 2")])
    known, out, cut = str(tmp_path / "known"), str(tmp_path / "out"), F.lit(hours(24))
    for number, step in enumerate([c.filter(F.col("ingested_at") < cut), c.filter(F.col("ingested_at") >= cut).unionByName(untimed), late]):
        each = triggers.dedup_triggers(spark, known, lambda r, b: delivery.deliver(r, out, "first", b))
        each(step, number), each(step, number)
    got = delivery.delivered(spark, out, "first", c.schema)
    assert rows(got.filter("ingested_at IS NOT NULL"), "cve_id", "ingested_at") == rows(V.dedup_first_24h(c), "cve_id", "ingested_at")
    assert got.filter("ingested_at IS NULL").count() == 1


def test_triggers_keep_the_newest_operation(spark, tmp_path):
    o = random_ops(spark, 200).cache()
    known, out = str(tmp_path / "known"), str(tmp_path / "out")
    steps = [o.filter("event_id >= 'e0150'"), o.filter("event_id < 'e0100'"), o.filter("event_id BETWEEN 'e0100' AND 'e0149'")]
    for number, step in enumerate(steps):
        each = triggers.graph_triggers(spark, known, lambda r, b: delivery.deliver(r.withColumn("n", F.lit(b)), out, "updates", b))
        each(step, number), each(step, number)
    updates = spark.read.parquet(*[f"{out}/updates/batch-{n}" for n in range(3)])
    state = updates.groupBy(*graph.PIN).agg(F.max_by(F.struct("op", "version"), "n").alias("s")).filter("s.op <> 'removed'")
    assert rows(state, *graph.PIN, "s.version") == rows(graph.current_pins(o), *graph.PIN, "version")


def test_first_records_keep_no_rows_in_python(spark):
    started = handled_by(spark, "stream_dedup")
    assert started and not any("TransformWithState" in text for text in started)


def test_dependency_state_is_no_aggregate_of_the_stream(spark):
    started = handled_by(spark, "stream_dep_graph")
    assert started and not any("Aggregate" in text for text in started)
