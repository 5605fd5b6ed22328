"""Streams over several triggers, compared with their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from pinwatch.operators import graph, match, vulnerabilities as V
from pinwatch.plans import exposure as plan
from pinwatch.sinks import delivery
from pinwatch.sinks.topics import keyed_matches, latest_messages
from pinwatch.sources import changes
from pinwatch.streaming import flows
from tests.test_operators import CVES, cves, detected, hours, ops, random_ops, rows


def feed(df, folder):
    """A stream of one file per trigger."""
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(stream, tmp_path, name, state=None):
    """What a stream has written so far; ``state`` is told how many rows its state holds."""
    out = str(tmp_path / f"{name}-out")

    def sink(df):
        return (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-marks"))
                .trigger(availableNow=True))

    query = flows.start(stream, sink, state_partitions=2)
    query.awaitTermination()
    if state is not None:
        state.append(sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]))
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def append(df, folder):
    df.coalesce(1).write.mode("append").parquet(str(folder))


def test_dedup_remembers_across_triggers(spark, tmp_path):
    c = cves(spark, [(h, "C", "a", "< 2") for h in (0, 6, 20, 30, 40, 54, 55)])
    folder = tmp_path / "in"
    append(c.filter("ingested_at < '2024-03-02'"), folder)
    stream = flows.stream_dedup(feed(c, folder))
    run(stream, tmp_path, "dedup")
    append(c.filter("ingested_at >= '2024-03-02'"), folder)
    got = run(flows.stream_dedup(feed(c, folder)), tmp_path, "dedup")
    assert rows(got, "ingested_at") == rows(V.dedup_first_24h(c), "ingested_at") == [(hours(0),), (hours(30),), (hours(54),)]


def test_matches_in_both_orders_across_triggers(spark, tmp_path):
    o = ops(spark, [(10, "s", "a", "added", "1.0"), (30, "s", "a", "updated", "3.0"), (5, "t", "A", "added", "1.0"), (50, "t", "A", "removed", None),
                    (51, "u", "a", "added", "1.5")])
    c = cves(spark, [(0, "early", "a", "< 2"), (20, "between", "A", "< 2"), (40, "late", "a", ">= 3, != 3.1"), (60, "list", "a", "", ["1.5"]),
                     (61, "early", "a", "< 2"), (62, "anywhere", "a", "< 2", [], "")])
    expected = detected(match.match_both_orders(graph.validity_intervals(o), V.dedup_first_ever(c)))
    assert len(expected) == 9
    for held in (0, 20_000):
        base = tmp_path / f"held{held}"
        for until, since in (("2024-03-01 15:00", "2000-01-01"), ("2024-03-02 11:00", "2024-03-01 15:00"), ("2030-01-01", "2024-03-02 11:00")):
            append(o.filter(f"occurred_at >= '{since}' AND occurred_at < '{until}'"), base / "ops")
            append(c.filter(f"ingested_at >= '{since}' AND ingested_at < '{until}'"), base / "cves")
            stream = flows.stream_symmetric_join(feed(o, base / "ops"), feed(c, base / "cves"), pin_shares=2, cve_shares=2, held_pins=held)
            got = run(stream, base, "match")
        assert detected(got) == expected


def test_several_records_of_a_vulnerability_match_once(spark, tmp_path):
    o = ops(spark, [(10, "s", "a", "added", "1.0"), (10, "t", "a", "added", "2.5"), (40, "u", "a", "added", "1.2"), (70, "v", "a", "added", "1.0")])
    c = cves(spark, [(0, "C", "a", "< 2"), (5, "C", "a", "< 3"), (20, "C", "a", "< 1.5"), (60, "C", "a", "", ["1.0"]), (61, "D", "a", "< 2, != 1.2")])
    expected = detected(match.match_both_orders(graph.validity_intervals(o), V.dedup_first_ever(c)))
    for until, since in (("2024-03-01 15:00", "2000-01-01"), ("2030-01-01", "2024-03-01 15:00")):
        append(o.filter(f"occurred_at >= '{since}' AND occurred_at < '{until}'"), tmp_path / "ops")
        append(c.filter(f"ingested_at >= '{since}' AND ingested_at < '{until}'"), tmp_path / "cves")
        got = run(flows.stream_symmetric_join(feed(o, tmp_path / "ops"), feed(c, tmp_path / "cves"), pin_shares=2), tmp_path, "match")
    assert detected(got) == expected


def test_a_stream_needs_no_driver_folder(tmp_path):
    """Workers get the package from the application, not from the folder the driver was started in."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as entry
print("ROWS", entry.queries()["stream_dedup"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_live_state_ignores_late_changes(spark, tmp_path):
    o = random_ops(spark, 200).cache()
    folder = tmp_path / "in"
    append(o.filter("event_id >= 'e0100'"), folder)
    out = str(tmp_path / "out")

    def sink(df):
        return (df.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True)
                .foreachBatch(lambda batch, n: batch.withColumn("n", F.lit(n)).write.mode("append").parquet(out)))

    flows.start(flows.stream_dep_graph(feed(o, folder)), sink, state_partitions=2).awaitTermination()
    append(o.filter("event_id < 'e0100'"), folder)
    flows.start(flows.stream_dep_graph(feed(o, folder)), sink, state_partitions=2).awaitTermination()
    updates = spark.read.parquet(out)
    state = updates.groupBy(*graph.PIN).agg(F.max_by(F.struct("op", "version"), "n").alias("s")).filter("s.op <> 'removed'")
    assert rows(state, *graph.PIN, "s.version") == rows(graph.current_pins(o), *graph.PIN, "version")


# --- late scores, spellings, snapshots, expiry, delivery ---------------------------------------------


EVENT = "event_id string, service_id string, ecosystem string, occurred_at timestamp, added array<struct<package: string, version: string>>, " \
    "removed array<struct<package: string, version: string>>, updated array<struct<package: string, from_version: string, to_version: string>>"


def registry(spark):
    rows = [("s", "red", True, True, False, False, False), ("t", "blue", False, False, False, False, True)]
    return spark.createDataFrame(rows, "service_id string, team string, is_customer_facing boolean, pci_scope boolean, hipaa_scope boolean, soc2_scope boolean, pii_handler boolean")


def scores(spark, rows):
    """(hour, cve, score)"""
    full = [(f"n{i}", cve, "nvd", hours(h), float(value), "LOW", None, "", "", "", None, []) for i, (h, cve, value) in enumerate(rows)]
    return spark.createDataFrame(full, CVES)


def said(messages):
    body = "match_id string, cve_id string, service_id string, package string, cvss_score double, severity_tier string, score double, detected_at timestamp, is_new_dependency boolean"
    parsed = messages.select("topic", F.from_json("value", body).alias("m")).select("topic", "m.*")
    return rows(parsed, "topic", "match_id", "cve_id", "service_id", "package", "cvss_score", "severity_tier", "score", "detected_at", "is_new_dependency")


def expected_messages(o, c, n, r):
    return said(keyed_matches(plan.routed_exposure(o, c.unionByName(n), r).withColumnRenamed("matched_package", "spelled")
                .withColumn("package", F.col("spelled"))))


def fed(spark, tmp_path, parts, build):
    """Run ``build`` of one stream per table over triggers; each trigger is a list of frames, None for nothing."""
    folders = [tmp_path / f"in{i}" for i in range(len(parts[0]))]
    frames = [next(p[i] for p in parts if p[i] is not None) for i in range(len(folders))]
    for folder, df in zip(folders, frames, strict=True):
        append(df.filter("false"), folder)
    for part in parts:
        for folder, df in zip(folders, part, strict=True):
            if df is not None:
                append(df, folder)
        got = run(build(*[feed(df, folder) for df, folder in zip(frames, folders, strict=True)]), tmp_path, "out")
    return got


@pytest.mark.parametrize("order", ["first", "with", "last", "between"])
def test_a_score_counts_whenever_it_arrives(spark, tmp_path, order):
    o = ops(spark, [(10, "s", "a", "added", "1.0"), (12, "t", "b", "added", "1.0"), (14, "u", "a", "added", "1.5"), (50, "t", "a", "added", "1.1")])
    c = cves(spark, [(0, "C", "a", "< 2"), (1, "D", "b", "< 2"), (2, "E", "a", "< 1.2")])
    n = scores(spark, [(3, "C", 9.8), (4, "D", 0.0), (5, "E", 3.0), (6, "C", 7.5), (7, "D", 0.0), (8, "F", 9.0)])
    early, late = o.filter("occurred_at < '2024-03-02'"), o.filter("occurred_at >= '2024-03-02'")
    first, second = n.filter("event_id IN ('n0', 'n1', 'n2')"), n.filter("event_id NOT IN ('n0', 'n1', 'n2')")
    parts = {
        "first": [(None, None, n), (early, c, None), (late, None, None)],
        "with": [(early, c, n), (late, None, None)],
        "last": [(early, c, None), (late, None, None), (None, None, second), (None, None, first)],
        "between": [(early, c, first), (late, None, second)],
    }[order]
    empty = [df.filter("false") for df in (o, c, n)]
    parts = [tuple(e if df is None else df for df, e in zip(p, empty, strict=True)) for p in parts]
    got = fed(spark, tmp_path, parts, lambda *streams: flows.stream_exposure(*streams, registry(spark), pin_shares=2))
    last = said(latest_messages(got))
    want = expected_messages(o, c, n, registry(spark))
    assert [r[:4] + r[5:] for r in last] == [r[:4] + r[5:] for r in want] and len(want) > 5
    if order == "last":
        assert got.count() > latest_messages(got).count()  # corrections


def test_spellings_in_a_stream_are_one_finding(spark, tmp_path):
    o = ops(spark, [(10, "s", "PyYAML", "added", "5.0"), (20, "s", "pyyaml", "added", "5.0"), (30, "s", "PyYAML", "removed", None),
                    (40, "s", "PyYAML", "added", "5.0"), (50, "s", "pyyaml", "removed", None), (60, "s", "PYYAML", "added", "5.1"),
                    (5, "t", "Rich", "added", "1.0"), (6, "t", "Rich", "removed", None), (6, "t", "rich", "added", "1.0")])
    c = cves(spark, [(0, "C", "pyyaml", "< 6"), (25, "D", "PyYaml", "< 6"), (45, "E", "pyyaml", "< 6, != 5.3"), (46, "E", "pyyaml", "< 5.5"), (1, "R", "rich", "")])
    c = c.withColumn("affected_versions", F.when(F.col("cve_id") == "R", F.array(F.lit("1.0"))).otherwise(F.col("affected_versions")))
    n = scores(spark, [(3, "C", 9.8)])
    cut = "2024-03-02 04:30"
    parts = [(o.filter(f"occurred_at < '{cut}'"), c.filter(f"ingested_at < '{cut}'"), n.filter("false")),
             (o.filter(f"occurred_at >= '{cut}'"), c.filter(f"ingested_at >= '{cut}'"), n)]
    got = fed(spark, tmp_path, parts, lambda *streams: flows.stream_exposure(*streams, registry(spark), pin_shares=2))
    matched = F.from_json("value", "cve_id string, service_id string, package string, version string, detected_at timestamp, cvss_score double, is_new_dependency boolean")
    columns = ("cve_id", "service_id", "package", "version", "detected_at", "cvss_score")
    last = latest_messages(got).select(matched.alias("m")).select("m.*").distinct()
    batch = plan.exposure(o, c.unionByName(n), registry(spark))
    want = rows(batch.withColumnRenamed("matched_version", "version").withColumn("package", F.lit("")), *columns)
    assert rows(last.withColumn("package", F.lit("")), *columns) == want and len(want) == 8
    assert ("C", "s", "PyYAML", "5.0") in rows(last, "cve_id", "service_id", "package", "version")


def test_snapshots_of_a_stream_are_the_history(spark, tmp_path):
    rng = random.Random(2)
    events = []
    for i in range(120):
        pins = [(f"p{rng.randrange(6)}", f"1.{rng.randrange(4)}") for _ in range(3)]
        events.append((f"e{i:03d}", f"s{rng.choice([0, 0, 1])}" if i % 40 else None, rng.choice(["pypi", "npm", None]), hours(i // 2),
                       pins[:1], [(pins[1][0], None)] if i % 3 else None, [(pins[2][0], "1", pins[2][1]), ("", "1", "2"), ("q", "1", "")]))
    e = spark.createDataFrame(events, EVENT)
    o = changes.explode_changes(e)
    for until, since in (("e040", ""), ("e080", "e040"), ("z", "e080")):
        append(e.filter(f"event_id >= '{since}' AND event_id < '{until}'"), tmp_path / "in")
        got = run(flows.stream_snapshots(feed(e, tmp_path / "in")), tmp_path, "snapshots")
    columns = ["service_id", "trigger_event_id", "snapshot_at", "ecosystem", F.to_json("dependencies")]
    as_text = lambda df: df.withColumn("dependencies", F.map_from_entries(F.array_sort(F.map_entries("dependencies"))))
    assert rows(as_text(got), *columns) == rows(as_text(graph.snapshot_history(o, o)), *columns)


def test_vulnerabilities_expire_with_the_watermark(spark, tmp_path):
    o = ops(spark, [(10, "s", "a", "added", "1.0"), (29, "t", "a", "added", "1.0"), (30, "u", "a", "added", "1.0"), (60, "v", "a", "added", "1.0"),
                    (100, "w", "b", "added", "1.0"), (101, "x", "b", "added", "1.0")])
    c = cves(spark, [(6, "C", "a", "< 2"), (40, "D", "a", "< 2"), (55, "E", "a", "< 1.5, != 1.1"), (90, "L", "b", "< 2")])
    intervals = graph.validity_intervals(o)
    expected = detected(match.match_both_orders(intervals, c, hours=24))
    assert ("C", "t", "a", "1.0", hours(29)) in expected and ("C", "u", "a", "1.0", hours(30)) not in expected
    state = []
    for until, since in ((20, 0), (45, 20), (70, 45), (99, 70), (1000, 99)):
        span = lambda column: f"{column} >= '{hours(since)}' AND {column} < '{hours(until)}'"  # noqa: E731, B023
        append(o.filter(span("occurred_at")), tmp_path / "ops")
        append(c.filter(span("ingested_at")), tmp_path / "cves")
        stream = flows.stream_symmetric_join(feed(o, tmp_path / "ops"), feed(c, tmp_path / "cves"), pin_shares=1, hours=24, delay="1 hour")
        got = run(stream, tmp_path, "match", state)
    assert detected(got) == expected
    # pins stay; of the vulnerabilities only what is younger than the limit
    assert state[-1] < max(state) + 3


def test_a_batch_that_runs_again_is_delivered_once(spark, tmp_path):
    path, folder = str(tmp_path / "tables"), tmp_path / "in"
    schema = "n bigint, kind string"
    numbers = spark.createDataFrame([(i, "even" if i % 2 == 0 else "odd") for i in range(30)], schema)
    tables = {"all": lambda df: df, "odd": lambda df: df.filter("kind = 'odd'")}
    write = delivery.deliver_batches(path, tables)

    def start(hook=None):
        def sink(df):
            return df.writeStream.option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).foreachBatch(hook or write)
        flows.start(feed(numbers, folder), sink, state_partitions=2).awaitTermination()

    def killed_after_data(df, batch):
        tables["all"](df).write.mode("overwrite").parquet(f"{path}/all/batch-{batch}")
        raise RuntimeError("killed after the data, before the marker")

    def killed_between_tables(df, batch):
        delivery.deliver(tables["all"](df), path, "all", batch)
        raise RuntimeError("killed between two tables")

    def killed_before_the_checkpoint(df, batch):
        write(df, batch)
        raise RuntimeError("killed after all markers")

    done = 0
    for hook in (killed_after_data, killed_between_tables, killed_before_the_checkpoint):
        append(numbers.filter(f"n >= {done} AND n < {done + 10}"), folder)
        with pytest.raises(Exception, match="killed"):
            start(hook)
        seen = delivery.delivered(spark, path, "all", schema).count()
        assert seen == (done if hook is killed_after_data else done + 10)
        done += 10
        start()
        for name, rows_of in tables.items():
            want = rows(rows_of(numbers.filter(f"n < {done}")), "n", "kind")
            assert rows(delivery.delivered(spark, path, name, schema), "n", "kind") == want
    delivery.merge_batches(spark, path, "all", schema, keep=1)
    assert rows(delivery.delivered(spark, path, "all", schema), "n") == [(i,) for i in range(30)]
    delivery.merge_batches(spark, path, "all", schema)
    assert delivery.is_delivered(spark, path, "all", 0) and len(list((tmp_path / "tables" / "all").iterdir())) == 1
    append(numbers.filter("n < 5"), folder)
    start()
    assert delivery.delivered(spark, path, "all", schema).count() == 35


def test_records_without_a_time_pass_and_end_no_stream(spark, tmp_path):
    c = cves(spark, [(h, "C", "a", "< 2") for h in (0, 6, 30)]).unionByName(
        cves(spark, [(0, "C", "a", "< 2")] * 2).withColumn("ingested_at", F.lit(None).cast("timestamp")).withColumn("event_id", F.lit(None).cast("string")))
    append(c, tmp_path / "in")
    got = run(flows.stream_dedup(feed(c, tmp_path / "in")), tmp_path, "dedup")
    key = lambda df: sorted((str(r.ingested_at), str(r.event_id)) for r in df.collect())
    assert key(got) == key(V.dedup_first_24h(c)) and got.count() == 4
    o = ops(spark, [(10, "s", "a", "added", "1.0"), (11, "t", "a", "added", "1.0")]).withColumn("occurred_at", F.when(F.col("service_id") == "s", F.col("occurred_at")))
    append(o, tmp_path / "ops")
    found = run(flows.stream_symmetric_join(feed(o, tmp_path / "ops"), feed(c, tmp_path / "in"), pin_shares=1), tmp_path, "match")
    assert {(r.service_id, r.package) for r in found.collect()} == {("s", "a"), ("t", "a")}
