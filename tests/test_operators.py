"""Table-driven cases for single operators, edge inputs included."""

import gzip
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row, functions as F

from pinwatch import schemas
from pinwatch.functions import scalars as S
from pinwatch.operators import closure, cursors, graph, lookups, manifests, match, sbom, scoring, search, vulnerabilities as V
from pinwatch.plans.timeline import crowded_keys, with_neighbours
from pinwatch.sinks import tables as stored, topics as out
from pinwatch.sources import changes, feeds, tables, topics

T0 = datetime(2024, 3, 1)


def hours(n):
    return T0 + timedelta(hours=n)


OPS = "service_id string, ecosystem string, package string, version string, op string, occurred_at timestamp, event_id string, op_rank int, pos int"
CVES = (
    "event_id string, cve_id string, source string, ingested_at timestamp, cvss_score double, severity_tier string, "
    "cwe_id string, affected_package string, ecosystem string, affected_version_range string, safe_version string, "
    "affected_versions array<string>"
)
RANK = {"removed": 0, "added": 1, "updated": 2}


def ops(spark, rows):
    """(hour, service, package, op, version[, ecosystem])"""
    full = [
        (s, (rest or ["pypi"])[0], p, v, op, hours(h), f"e{i:04d}", RANK[op], 0)
        for i, (h, s, p, op, v, *rest) in enumerate(rows)
    ]
    return spark.createDataFrame(full, OPS)


def cves(spark, rows):
    """(hour, cve, package, range[, listed[, ecosystem]])"""
    full = []
    for i, (h, cve, package, text, *rest) in enumerate(rows):
        listed = rest[0] if rest else []
        eco = rest[1] if len(rest) > 1 else "pypi"
        full.append((f"c{i}", cve, "osv", hours(h), 5.0, "MEDIUM", None, package, eco, text, "", listed))
    return spark.createDataFrame(full, CVES)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- scalars ----------------------------------------------------------------------------------------


def test_severity_and_tier_bounds(spark):
    scores = [(9.0, "CRITICAL"), (10.0, "CRITICAL"), (7.0, "HIGH"), (8.9, "HIGH"), (4.0, "MEDIUM"), (6.9, "MEDIUM"), (0.0, "LOW"), (3.9, "LOW")]
    df = spark.createDataFrame(scores, "s double, expected string")
    assert df.filter(S.severity_from_cvss(F.col("s")) != F.col("expected")).count() == 0
    tiers = [(1.0, "CRITICAL"), (0.75, "CRITICAL"), (0.5, "HIGH"), (0.25, "MEDIUM"), (0.12, "LOW"), (0.2499, "LOW")]
    df = spark.createDataFrame(tiers, "s double, expected string")
    assert df.filter(S.tier_from_score(F.col("s")) != F.col("expected")).count() == 0


def test_branches_and_titles(spark):
    df = spark.createDataFrame(
        [("dependabot/uv/x", "Bump a/b-c.d from 1.0 to 2.0.0rc1"), ("renovate/go/y/z", "no"), ("dependabot/pip", "Bump @s/p from 1 to 2"),
         ("feature/dependabot/pip/x", "build(deps): bump X from 1.2 to 1.3")], "ref string, title string")
    got = rows(df.select("ref", S.ecosystem_from_branch(F.col("ref")).alias("e"), S.bump_title(F.col("title")).alias("b")), "ref", "e", "b.package", "b.to_version")
    assert got == [("dependabot/pip", "", "", ""), ("dependabot/uv/x", "pypi", "a/b-c.d", "2.0.0"),
                   ("feature/dependabot/pip/x", "", "X", "1.3"), ("renovate/go/y/z", "go", "", "")]


def test_score_treats_missing_values_as_zero_and_caps_cvss(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None), (12.0, True, True, True, True, True)],
                               "c double, a boolean, p boolean, h boolean, s boolean, i boolean")
    got = [r[0] for r in df.select(S.exposure_score(*[F.col(x) for x in "caphsi"])).collect()]
    assert got == [0.0, 1.0]


# --- sources ----------------------------------------------------------------------------------------


def test_a_change_is_parsed_once(spark):
    text = ['{"event_id": "e", "service_id": "s", "added": [{"package": "a", "version": "1"}]}', '{"event_id": "f", "serv', '{"service_id": "x"}', "[]", None]
    records = spark.createDataFrame([(v,) for v in text], "value string")
    assert rows(topics.change_events(records), "event_id", "service_id") == [("e", "s")]
    assert sorted(str(r.raw) for r in topics.change_quarantine(records).collect()) == sorted(str(v) for v in text[1:])
    for build in (topics.change_events, topics.change_quarantine):
        assert planned(build(records)).count("from_json(") == 1


def test_valid_and_quarantined_records(spark):
    texts = [
        json.dumps({"event_id": "first", "cve_id": "CVE-7", "source": "osv", "ingested_at": "2023-06-05T04:03:02Z", "cvss_score": 9.9,
                    "affected_package": "left", "ecosystem": "npm"}),
        "{broken", json.dumps({"source": "nvd"}), json.dumps({"cve_id": "CVE-7", "source": "mail"}),
        "", "[1]", None, json.dumps({"cve_id": "CVE-9", "source": "NVD", "affected_versions": None}),
        json.dumps({"cve_id": "CVE-8", "source": "osv", "cvss_score": "high"}),
    ]
    records = spark.createDataFrame([(t,) for t in texts], "value string")
    now = F.lit(T0)
    valid = topics.vulnerability_events(records, now)
    assert rows(valid, "cve_id", "severity_tier", "ingested_at") == [("CVE-7", "CRITICAL", datetime(2023, 6, 5, 4, 3, 2)), ("CVE-9", "LOW", T0)]
    reasons = sorted(r.reason for r in topics.quarantine(records).collect())
    assert len(reasons) == 7 and reasons.count("unknown source") == 1 and reasons.count("bad field") == 1 and reasons.count("no cve id") == 1


def test_nvd_and_osv_files(spark, tmp_path):
    body = {"totalResults": 2, "vulnerabilities": [
        {"cve": {"id": "CVE-1", "published": "2024-01-02T03:04:05.000", "descriptions": [{"lang": "es", "value": "no"}, {"lang": "en", "value": "yes"}],
                 "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 9.8}}, {"cvssData": {"baseScore": 1.0}}]},
                 "weaknesses": [{"description": [{"value": "CWE-79"}]}]}},
        {"cve": {"id": "CVE-2", "published": "garbage", "descriptions": [], "metrics": {}, "weaknesses": []}}, {"cve": {"id": ""}}]}
    (tmp_path / "nvd.json").write_text(json.dumps(body, indent=1))
    nvd = V.nvd_normalise(feeds.read_nvd(spark, str(tmp_path / "nvd.json")), F.lit(T0))
    assert rows(nvd, "cve_id", "cvss_score", "severity_tier", "description", F.coalesce("cwe_id", F.lit("-")), F.col("published_at").isNull()) == [
        ("CVE-1", 9.8, "CRITICAL", "yes", "CWE-79", False), ("CVE-2", 0.0, "LOW", "", "-", True)]
    folder = tmp_path / "osv" / "PyPI"
    folder.mkdir(parents=True)
    record = {"id": "GHSA-1", "modified": "2024-01-05T00:00:00.123456789Z", "published": "2024-01-01T00:00:00Z", "aliases": ["X", "CVE-7", "CVE-8"],
              "summary": "", "details": "long", "affected": [
                  {"package": {"name": "a", "ecosystem": "crates.io"}, "versions": ["1.0"], "ranges": [
                      {"type": "SEMVER", "events": [{"fixed": "9"}]},
                      {"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "1.5"}, {"introduced": "2.0"}, {"fixed": "2.3"}]}]},
                  {"package": {"name": "", "ecosystem": "npm"}}, {"package": {"name": "b", "ecosystem": "Hex"}}]}
    (folder / "1.json").write_text(json.dumps(record))
    (folder / "2.json").write_text("{broken")
    corpus = feeds.read_osv(spark, str(tmp_path / "osv"))
    assert corpus.cache().filter("_corrupt_record IS NOT NULL").count() == 1
    osv = V.osv_normalise(feeds.readable(corpus), F.lit(T0))
    assert rows(osv, "cve_id", "affected_package", "ecosystem", "affected_version_range", F.coalesce("safe_version", F.lit("-")), "description") == [
        ("CVE-7", "a", "cargo", "< 2.3", "2.3", "long"), ("CVE-7", "b", "hex", "", "-", "long")]
    assert rows(feeds.readable(corpus), "feed_ecosystem") == [("PyPI",)]


def test_modified_index_skips_bad_lines(spark, tmp_path):
    (tmp_path / "i.csv").write_text("2024-01-02T00:00:00Z,A\nonlyone\nbad,B\n\n 2024-01-03T00:00:00.5Z , C \n")
    assert rows(feeds.read_osv_index(spark, str(tmp_path / "i.csv")), "id") == [("A",), ("C",)]


def archive_line(**changed):
    event = {"type": "PullRequestEvent", "actor": {"login": "Dependabot[bot]"}, "repo": {"name": "o/r"}, "payload": {"action": "closed", "pull_request": {
        "number": 7, "title": "Bump x from 1.0 to 1.1", "merged": True, "merged_at": "2024-02-01T00:00:00Z", "head": {"ref": "dependabot/pip/x"}}}}
    pr = event["payload"]["pull_request"]
    for key, value in changed.items():
        (pr if key in pr else event["payload"] if key == "action" else event)[key] = value
    return json.dumps(event)


def test_archive_files_and_filter(spark, tmp_path):
    lines = [archive_line(), archive_line(merged=False), archive_line(merged_at="2023-12-31T23:59:59Z"), archive_line(merged_at="soon"),
             archive_line(actor={"login": "alice"}), archive_line(title="Fix"), archive_line(head={"ref": "main"}), archive_line(action="opened"),
             archive_line(type="PushEvent"), '{"type":"PullRequestEvent",broken', "{}", archive_line(merged="true")]
    for name in ("2024-01-05-3.json.gz", "2024-01-05-14.json.gz"):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write("\n".join(lines))
    read = changes.read_archive(spark, str(tmp_path))
    assert rows(read.groupBy("archive_day", "archive_hour").count(), F.col("archive_day").cast("string"), "archive_hour", "count") == [
        ("2024-01-05", 3, 12), ("2024-01-05", 14, 12)]
    kept = changes.archive_bump_events(changes.archive_window(read, "2020-01-01", "2024-01-31"))
    assert rows(kept, "service_id", "author", "ecosystem", "manifest_file", "pr_number") == [("o/r", "dependabot[bot]", "pypi", "requirements.txt", 7)] * 2


def test_change_events_tolerate_null_arrays(spark):
    text = json.dumps({"event_id": "e", "service_id": "s", "ecosystem": "pypi", "added": None, "removed": [{"package": "a", "version": "1"}],
                       "updated": [{"package": "b", "from_version": "1", "to_version": ""}, {"package": "a", "to_version": "2"}],
                       "occurred_at": "2024-01-01T00:00:00Z"})
    events = topics.change_events(spark.createDataFrame([(text,), ("nonsense",)], "value string"))
    assert rows(changes.explode_changes(events), "op", "package", F.coalesce("version", F.lit("-"))) == [("removed", "a", "-"), ("updated", "a", "2")]


# --- dependency state ---------------------------------------------------------------------------------


def test_removed_and_added_in_one_event_ends_added(spark):
    event = [("e", "s", "pypi", T0, [Row(package="a", version="2")], [Row(package="a", version="1")], None)]
    schema = f"event_id string, service_id string, ecosystem string, occurred_at timestamp, added {schemas.PINS}, removed {schemas.PINS}, updated {schemas.UPDATES}"
    exploded = changes.explode_changes(spark.createDataFrame(event, schema))
    assert rows(graph.current_pins(exploded), "package", "version") == [("a", "2")]
    assert rows(graph.new_dependencies(exploded), "package", "version") == [("a", "2")]


def test_intervals_cover_removal_and_return(spark):
    o = ops(spark, [(0, "s", "a", "added", "1"), (5, "s", "a", "removed", None), (9, "s", "a", "added", "1"), (9, "s", "b", "removed", None),
                    (12, "s", "a", "updated", "2"), (12, "s", "a", "updated", "3"), (1, "s", "a", "added", "7", "npm")])
    assert rows(graph.validity_intervals(o), "ecosystem", "package", "version", "valid_from", F.coalesce("valid_to", F.lit(hours(99)))) == [
        ("npm", "a", "7", hours(1), hours(99)), ("pypi", "a", "1", hours(0), hours(5)), ("pypi", "a", "1", hours(9), hours(12)),
        ("pypi", "a", "3", hours(12), hours(99))]
    assert rows(graph.current_pins(o), "ecosystem", "version") == [("npm", "7"), ("pypi", "3")]
    assert rows(graph.new_dependencies(o), "ecosystem", "occurred_at") == [("npm", hours(1)), ("pypi", hours(0)), ("pypi", hours(9))]


def random_ops(spark, n=600, seed=3):
    rng = random.Random(seed)
    return ops(spark, [
        (rng.randrange(3000), f"s{rng.choice([0, 0, 0, 1, 2])}", f"p{rng.choice([0, 0, 1, 2])}", op, None if op == "removed" else f"1.{rng.randrange(6)}")
        for op in rng.choices(["added", "updated", "removed"], k=n)
    ])


def test_crowded_pins_give_the_same_intervals(spark):
    o = random_ops(spark).cache()
    crowded = graph.crowded_pins(o, limit=60)
    assert crowded is not None and 0 < crowded.count() < 9
    for build in (graph.validity_intervals, graph.new_dependencies):
        plain, split = build(o), build(o, crowded)
        assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0
    assert graph.crowded_pins(o, limit=10_000) is None


def test_a_snapshot_is_one_row_whatever_its_size(spark):
    o = ops(spark, [(i, "s", f"p{i}", "added", "1") for i in range(50)] + [(60, "s", "x", "added", "1", "npm")])
    assert rows(graph.snapshot_maps(o), "ecosystem", F.size("dependencies")) == [("npm", 1), ("pypi", 50)]


def test_latest_snapshot_keeps_every_ecosystem(spark):
    o = ops(spark, [(0, "s", "a", "added", "1"), (1, "s", "b", "added", "2", "npm"), (2, "s", "a", "updated", "3"), (0, "t", "a", "added", "1"), (4, "t", "a", "removed", None)])
    last = graph.stored_snapshots(graph.latest_state(o, o))
    early = o.filter(F.col("occurred_at") < F.lit(hours(2)))
    both = graph.stored_snapshots(graph.latest_state(early, early)).unionByName(last)
    newest = graph.latest_snapshot(both.filter("service_id = 's'")).select("service_id", "ecosystem", F.explode("dependencies"))
    assert rows(newest, "ecosystem", "key", "value") == [("npm", "b", "2"), ("pypi", "a", "3")]
    history = graph.snapshot_rows(o, o).join(last.select("service_id", F.col("snapshot_id").alias("trigger_event_id")).distinct(), ["service_id", "trigger_event_id"], "left_semi")
    state = graph.latest_state(o, o)
    assert rows(state, *sorted(state.columns)) == rows(history, *sorted(history.columns))


def test_the_latest_snapshot_is_chosen_among_several(spark, monkeypatch):
    from types import SimpleNamespace

    from pinwatch.catalog import exposure as catalog

    o = ops(spark, [(0, "s", "a", "added", "1"), (3, "s", "a", "updated", "2"), (8, "s", "b", "added", "1", "npm"), (1, "t", "a", "added", "1"), (7, "t", "a", "removed", None), (2, "u", "a", "added", "1")])
    held, choose = [], graph.latest_snapshot
    monkeypatch.setattr(graph, "latest_snapshot", lambda snapshots: held.append(snapshots) or choose(snapshots))
    newest = catalog.latest_snapshot(SimpleNamespace(ops=o, spark=spark))
    assert rows(newest, "service_id", "ecosystem", "snapshot_at", "dependencies") == [
        ("s", "npm", hours(8), "b=1"), ("s", "pypi", hours(8), "a=2"), ("u", "pypi", hours(2), "a=1")]
    assert rows(held[0], "service_id", "ecosystem", "snapshot_at") == [
        ("s", "npm", hours(8)), ("s", "pypi", hours(0)), ("s", "pypi", hours(3)), ("s", "pypi", hours(8)),
        ("t", "", hours(7)), ("t", "pypi", hours(1)), ("u", "pypi", hours(2))]


# --- records ----------------------------------------------------------------------------------------


def brute_force_24h(times):
    kept, last = [], None
    for at in sorted(set(times)):
        if last is None or at >= last + timedelta(hours=24):
            kept.append(at)
            last = at
    return kept


@pytest.mark.parametrize("fold_limit", [100_000, 5])
def test_24h_dedup_both_ways_against_brute_force(spark, fold_limit):
    rng = random.Random(5)
    times = {f"k{k}": [T0 + timedelta(minutes=rng.randrange(60 * 24 * days)) for _ in range(n)]
             for k, (n, days) in enumerate([(3, 1), (40, 9), (300, 20), (200, 3), (1, 1), (60, 200)])}
    times["edge"] = [T0, hours(6), hours(20), hours(24), hours(40), hours(48), hours(48)]
    times["gaps"] = [hours(3), None, hours(1), hours(30), None, hours(80)]
    times[None] = [hours(h) for h in (0, 5, 24, 24, 25, 47, 48, 100)]
    data = [(f"{k}-{i}", k, "", "", None if k == "edge" else "", at) for k, ts in times.items() for i, at in enumerate(ts)]
    events = spark.createDataFrame(data, "event_id string, cve_id string, affected_package string, ecosystem string, affected_version_range string, ingested_at timestamp")
    got = V.dedup_first_24h(events, fold_limit=fold_limit)
    # records without a time can't be placed and all pass
    want = [(k, at) for k, ts in times.items() for at in brute_force_24h([t for t in ts if t]) + [t for t in ts if not t]]
    assert sorted(map(str, [(r.cve_id, r.ingested_at) for r in got.collect()])) == sorted(map(str, want))


def test_a_missing_score_overwrites_nothing(spark):
    osv = cves(spark, [(0, "C1", "a", "< 2"), (0, "C2", "b", "< 2"), (0, "C3", "c", "< 2")])
    feed = lambda cve, at, score: osv.limit(1).withColumns({
        "event_id": F.lit(f"{cve}-{at}"), "source": F.lit("nvd"), "cve_id": F.lit(cve), "ingested_at": F.lit(hours(at)), "cvss_score": F.lit(score)})
    nvd = feed("C1", 1, 9.8).unionByName(feed("C1", 5, 0.0)).unionByName(feed("C2", 1, 0.0)).unionByName(feed("C3", 1, 9.8)).unionByName(feed("C3", 2, 5.0))
    assert rows(V.cvss_enrich(osv, nvd), "cve_id", "cvss_score", "severity_tier") == [("C1", 9.8, "CRITICAL"), ("C2", 5.0, "MEDIUM"), ("C3", 5.0, "MEDIUM")]


def test_records_after_the_moment_do_not_count_as_live(spark):
    c = cves(spark, [(0, "old", "a", ""), (10, "live", "a", ""), (30, "at", "a", ""), (31, "later", "a", "")])
    assert rows(V.within_ttl(c, F.lit(hours(30)), 24), "cve_id") == [("at",), ("live",)]
    assert V.within_ttl(c, F.lit(hours(30))).count() == 4


def test_every_package_of_a_cve_stays_and_scores_only_enrich(spark):
    osv = cves(spark, [(0, "C1", "a", "< 2"), (1, "C1", "b", "< 3"), (2, "C1", "a", "< 2")])
    nvd = osv.limit(1).select("*").withColumns({"event_id": F.lit("n"), "source": F.lit("nvd"), "cvss_score": F.lit(9.8), "cwe_id": F.lit("CWE-1"),
                                                "affected_package": F.lit(""), "affected_version_range": F.lit(""), "cve_id": F.lit("C1")})
    enriched = V.cvss_enrich(V.latest_record(osv), nvd)
    assert rows(enriched, "affected_package", "cvss_score", "severity_tier", "cwe_id") == [("a", 9.8, "CRITICAL", "CWE-1"), ("b", 9.8, "CRITICAL", "CWE-1")]


# --- matching ---------------------------------------------------------------------------------------


def detected(df):
    return rows(df, "cve_id", "service_id", "package", "version", "detected_at")


def test_either_side_may_come_first(spark):
    o = ops(spark, [(10, "s", "a", "added", "1.0"), (30, "s", "a", "updated", "3.0"), (5, "t", "A", "added", "1.0")])
    c = cves(spark, [(0, "early", "a", "< 2"), (20, "between", "A", "< 2"), (30, "atend", "a", "< 2"), (40, "late", "a", ">= 3")])
    assert detected(match.match_both_orders(graph.validity_intervals(o), c)) == sorted([
        ("early", "s", "a", "1.0", hours(10)), ("between", "s", "a", "1.0", hours(20)), ("late", "s", "a", "3.0", hours(40)),
        ("early", "t", "A", "1.0", hours(5)), ("between", "t", "A", "1.0", hours(20)), ("atend", "t", "A", "1.0", hours(30))])
    seen = match.match_asof(graph.states(o), o, c)
    assert detected(seen) == [("early", "s", "a", "1.0", hours(10)), ("early", "t", "A", "1.0", hours(5))]


def test_ecosystem_wildcard_lists_holes_and_repeated_records(spark):
    o = ops(spark, [(0, "s", "a", "added", "1.5"), (0, "s", "a", "added", "1.5", "npm"), (0, "s", "b", "added", "weird")])
    c = cves(spark, [(3, "W", "a", "< 2", [], ""), (1, "N", "a", "< 2", [], "npm"), (1, "H", "a", "< 2, != 1.5"), (1, "L", "b", "", ["weird"]),
                     (9, "R", "a", "< 2"), (4, "R", "a", "< 3"), (1, "X", "a", ""), (1, "Y", "", "< 9")])
    found = match.match_pins(graph.current_pins(o), c)
    assert rows(found, "cve_id", "ecosystem", "ingested_at") == [("L", "pypi", hours(1)), ("N", "npm", hours(1)), ("R", "pypi", hours(4)),
                                                                  ("W", "npm", hours(3)), ("W", "pypi", hours(3))]
    assert rows(match.listed_versions(graph.current_pins(o), c), "package") == [("b",)]
    anywhere = cves(spark, [(1, "L", "b", "", ["weird"], ""), (1, "M", "b", "", ["weird"], "pypi"), (1, "N", "a", "", ["1.5"], "npm"), (1, "O", "a", "", ["9"], "")])
    assert rows(match.listed_versions(graph.current_pins(o), anywhere), "package", "ecosystem") == [("a", "npm"), ("b", "pypi")]


def test_auto_resolve_joins_adjacent_affected_intervals(spark):
    o = ops(spark, [(0, "s", "a", "added", "1.0"), (10, "s", "a", "updated", "1.1"), (20, "s", "a", "updated", "2.0"), (30, "s", "a", "updated", "1.0"),
                    (0, "t", "a", "added", "1.0"), (5, "t", "a", "removed", None)])
    c = cves(spark, [(7, "C", "a", "< 2")])
    expected = [("C", "s", hours(7), hours(20)), ("C", "s", hours(30), hours(99))]
    for crowded in (None, crowded_keys(o, graph.PIN, limit=3)):
        got = lookups.auto_resolve(o, c, crowded)
        assert rows(got, "cve_id", "service_id", "detected_at", F.coalesce("resolved_at", F.lit(hours(99)))) == expected


def test_gate_and_upgrade(spark):
    o = ops(spark, [(0, "s", "bad", "added", "1.0"), (0, "s", "meh", "added", "1.0"), (0, "s", "fine", "added", "1.0")])
    c = cves(spark, [(0, "C1", "bad", "< 1.10"), (0, "C2", "bad", "< 1.9"), (0, "C3", "meh", "< 2")]).withColumn(
        "severity_tier", F.when(F.col("cve_id") == "C2", "HIGH").otherwise("LOW")).withColumn(
        "safe_version", F.regexp_extract("affected_version_range", r"< (.*)", 1))
    assert rows(lookups.pr_risk_gate(o, c), "package", "verdict", "cves") == [("bad", "BLOCK", 2), ("fine", "APPROVE", 0), ("meh", "WARN", 1)]
    assert rows(lookups.remediation_path(graph.current_pins(o), c), "package", "upgrade_to") == [("bad", "1.10"), ("meh", "2")]


def test_an_upgrade_is_itself_unaffected(spark):
    o = ops(spark, [(0, "s", p, "added", "1.0") for p in ("jump", "stuck", "none", "down", "Case")] + [(0, "s", "jump", "added", "1.0", "npm")])
    c = cves(spark, [(0, "A", "jump", "< 1.5"), (0, "B", "jump", ">= 1.5, < 1.10"), (0, "C", "stuck", "< 2"), (0, "D", "stuck", ">= 2"),
                     (0, "E", "none", ">= 0.1"), (0, "F", "down", "== 1.0"), (0, "G", "case", "< 3", [], "")])
    fixes = {"A": "1.5", "B": "1.10", "C": "2", "E": "", "F": "0.9", "G": "3"}
    safe = F.lit(None).cast("string")
    for cve, fix in fixes.items():
        safe = F.when(F.col("cve_id") == cve, fix).otherwise(safe)
    got = lookups.remediation_path(graph.current_pins(o), c.withColumn("safe_version", safe))
    assert rows(got, "package", "ecosystem", F.coalesce("upgrade_to", F.lit("-")), "reason") == [
        ("Case", "pypi", "3", "fixed"), ("down", "pypi", "-", "every fix is affected"), ("jump", "pypi", "1.10", "fixed"),
        ("none", "pypi", "-", "no fix known"), ("stuck", "pypi", "-", "every fix is affected")]


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_remediation_reads_its_requests_once_and_counts_a_vulnerability_once(spark):
    o = ops(spark, [(0, "s", "a", "added", v) for v in ("1.0",)] + [(0, "t", "a", "added", "2.0"), (0, "u", "A", "added", "1.5"), (0, "v", "a", "added", "odd")])
    c = cves(spark, [(0, "A", "a", "< 1.4"), (1, "A", "a", "< 1.2"), (0, "B", "a", "< 2.5", ["odd"])])
    fix = F.when(F.col("cve_id") == "B", "2.5").when(F.col("affected_version_range") == "< 1.4", "1.4").otherwise("2.50")
    got = lookups.remediation_path(graph.current_pins(o), c.withColumn("safe_version", fix))
    assert "max_by" not in planned(got)
    assert rows(got, "package", "version", F.coalesce("upgrade_to", F.lit("-")), "cves") == [
        ("A", "1.5", "2.5", 1), ("a", "1.0", "2.5", 2), ("a", "2.0", "2.5", 1), ("a", "odd", "-", 1)]


def test_unknown_service_gets_defaults_and_new_packages_a_second_topic(spark):
    registry = spark.createDataFrame([("known", "core", True, True, False, None, True)], "service_id string, team string, is_customer_facing boolean, pci_scope boolean, hipaa_scope boolean, soc2_scope boolean, pii_handler boolean")
    m = spark.createDataFrame([("known", 5.9, T0, True), ("else", 5.9, T0, False)], "service_id string, cvss_score double, detected_at timestamp, is_new_dependency boolean")
    routed = scoring.route(scoring.score(scoring.registry_enrich(m, registry)))
    assert rows(routed, "service_id", "team", "score", "topic", "sla_deadline") == [
        ("else", "unknown", 0.236, "vuln.matches.low", hours(720)), ("known", "core", 0.836, "deps.risk.prs", hours(4)),
        ("known", "core", 0.836, "vuln.matches.critical", hours(4))]


# --- the rest ---------------------------------------------------------------------------------------


def test_closure_ends_on_cycles_and_takes_the_shortest_path(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("x", "x"), ("q", "r")]
    edges = spark.createDataFrame([("npm", a, b, f"1.{b}") for a, b in pairs] + [("pypi", "d", "e", "9")], "ecosystem string, package string, depends_on string, version string")
    got = rows(closure.transitive_closure(edges).filter("package = 'a'"), "depends_on", "depth", "path", "version")
    assert got == [("b", 1, "a>b", "1.b"), ("c", 1, "a>c", "1.c"), ("d", 2, "a>c>d", "1.d")]
    start = spark.createDataFrame([("npm", "b")], "ecosystem string, package string")
    assert rows(closure.transitive_closure(edges, start), "package", "depends_on") == [("b", "a"), ("b", "c"), ("b", "d")]
    assert closure.transitive_closure(edges, max_depth=1).agg(F.max("depth")).first()[0] == 1


def test_indirect_dependencies_stay_in_their_ecosystem_and_reach_matching(spark):
    edges = spark.createDataFrame([("npm", "a", "x", "1.0"), ("pypi", "b", "x", "2.0"), ("npm", "x", "y", "3.0")],
                                  "ecosystem string, package string, depends_on string, version string")
    o = ops(spark, [(0, "s", "a", "added", "1", "npm"), (0, "s", "b", "added", "1"), (0, "t", "x", "added", "5", "npm"), (0, "t", "a", "added", "1", "npm")])
    pins = closure.transitive_pins(graph.current_pins(o), edges)
    assert rows(pins.filter("package IN ('x', 'y')"), "service_id", "ecosystem", "package", "version", "is_transitive", "transitive_path") == [
        ("s", "npm", "x", "1.0", True, "a>x"), ("s", "npm", "y", "3.0", True, "a>x>y"), ("s", "pypi", "x", "2.0", True, "b>x"),
        ("t", "npm", "x", "5", False, "x"), ("t", "npm", "y", "3.0", True, "x>y")]
    c = cves(spark, [(0, "C", "x", "< 2", [], ""), (0, "D", "y", ">= 3", [], "npm")])
    found = closure.transitive_exposure(graph.current_pins(o), edges, c)
    assert rows(found, "service_id", "cve_id", "ecosystem", "transitive_path") == [
        ("s", "C", "npm", "a>x"), ("s", "D", "npm", "a>x>y"), ("t", "D", "npm", "x>y")]


def test_indirect_dependencies_read_the_pins_once(spark):
    edges = spark.createDataFrame([("npm", "a", "x", "1.0")], "ecosystem string, package string, depends_on string, version string")
    pins = closure.transitive_pins(graph.current_pins(ops(spark, [(0, "s", "a", "added", "1", "npm")])), edges)
    assert "max_by" not in planned(pins) and pins.count() == 2


def test_neighbours_follow_one_order(spark):
    df = spark.createDataFrame([("k", i, (i * 7) % 11) for i in range(11)], "k string, id int, at int")
    crowded = crowded_keys(df, ["k"], limit=5)
    for split in (None, crowded):
        got = rows(with_neighbours(df, ["k"], ["at"], ["id"], F.col("at") % 1 + F.floor(F.col("at") / 3), split), "at", F.col("prev.at"), F.col("next.at"))
        assert [r[0] for r in got] == list(range(11))
        assert all(p == a - 1 for a, p, _ in got if p is not None) and all(n == a + 1 for a, _, n in got if n is not None)
        assert sum(p is None for _, p, _ in got) == sum(n is None for _, _, n in got) == 1


def test_tables_are_conformed_and_upserts_keep_known_rows(spark, tmp_path):
    path = str(tmp_path / "registry")
    first = spark.createDataFrame([("a", "one")], "service_id string, team string")
    stored.append_table(first, "service_registry", path)
    more = spark.createDataFrame([("a", "two"), ("b", "x"), ("b", "y")], "service_id string, team string")
    stored.upsert_registry(more, tables.read_registry(spark, path), path)
    back = tables.read_registry(spark, path)
    assert rows(back, "service_id", "team") == [("a", "one"), ("b", "x")]
    assert back.schema.fieldNames() == schemas.struct_of(schemas.SERVICE_REGISTRY).fieldNames()


def test_topic_options_and_keys(spark):
    assert topics.kafka_options("b:1")["startingOffsets"] == "earliest"
    assert out.producer_options()["kafka.acks"] == "all"
    m = spark.createDataFrame([("s", "vuln.matches.low", 1)], "service_id string, topic string, x int")
    assert [tuple(r) for r in out.keyed_matches(m).collect()] == [("vuln.matches.low", "s", '{"service_id":"s","x":1}')]


def test_vectors_rank_by_the_exact_similarity(spark):
    query = [1.0, 2.0, 3.0]
    near = [1.0, 2.0, 3.0 + 1e-5]
    vectors = spark.createDataFrame([(1, near, 0), (9, query, 0), (5, [3.0, 2.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    assert [tuple(r) for r in search.search(vectors, query, 2).collect()] == [(9, 1.0), (1, 1.0)]
    queries = spark.createDataFrame([(0, query)], "label int, query array<double>")
    ranked = search.topk_per_collection(vectors, queries, 2).orderBy("rank").collect()
    assert [(r.vec_id, r.similarity) for r in ranked] == [(9, 1.0), (1, 1.0)]


def test_package_urls_and_documents_are_valid(spark):
    o = ops(spark, [(0, "s", "@scope/name", "added", "1", "npm"), (0, "s", "My_Pkg", "added", "2"), (0, "s", "org.x:y", "added", "3", "maven")])
    pins = graph.current_pins(o)
    assert rows(pins.select(sbom.package_url().alias("purl")), "purl") == [("pkg:maven/org.x/y@3",), ("pkg:npm/%40scope/name@1",), ("pkg:pypi/my-pkg@2",)]
    import json

    document = json.loads(sbom.spdx(pins, F.lit("2024-01-01T00:00:00Z")).first().document)
    assert document["documentNamespace"] and document["creationInfo"]["creators"] and len(document["packages"]) == 3


def test_a_feed_never_read_starts_a_day_back(spark):
    stored = spark.createDataFrame([("a", hours(3)), ("a", hours(5))], "feed string, cursor timestamp")
    feeds = spark.createDataFrame([("a",), ("b",)], "feed string")
    assert rows(cursors.poll_start(stored, feeds, F.lit(hours(48))), "feed", "cursor") == [("a", hours(5)), ("b", hours(24))]


def test_manifests_tell_pins_from_ranges_and_other_sections(spark):
    texts = {
        "requirements.txt": "a==1.0 # x\nb[extra] == 2.0 ; python_version>'3'\nc>=1,<2\nd\ne==1.*\n-r other.txt\nf===3",
        "package.json": '{"version":"1.0.0","dependencies":{"a":"1.2.3","b":"^1.2.3","c":"*","d":"https://x/y.tgz","@s/e":"=2.0.0-rc.1"}}',
        "go.mod": "module m\nrequire x/y v1.2.3\nrequire (\n\tp v0.1.0 // indirect\n)\nexclude (\n\tbad v9.0.0\n)\nexclude worse v8.0.0\nreplace q => r v7.0.0",
        "Cargo.toml": '[package]\nname = "n"\nversion = "0.1.0"\n[dependencies]\na = "=1.0.0"\nb = { version = "1.2", features = ["f"] }\nc = { path = "../c" }\n[dev-dependencies.d]\nversion = "=3.1"\n[features]\nx = "1"',
        "pom.xml": "<project><version>9</version><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1.0</version></dependency>"
                   "<dependency><groupId>g</groupId><artifactId>b</artifactId><version>[1.0,2.0)</version></dependency></dependencies></project>",
    }
    rows_ = [("s", "e", name, text) for name, text in texts.items()] + [("s", "e", "other.lock", "a==1"), ("s", "e", "go.mod", None), ("s", "e", "package.json", "no json")]
    frame = spark.createDataFrame(rows_, "service_id string, ecosystem string, manifest_file string, content string")
    found = manifests.requirements(frame).withColumns({"version": F.coalesce("version", F.lit("-")), "version_range": F.coalesce("version_range", F.lit("-"))})
    assert rows(found, "manifest_file", "package", "version", "version_range") == sorted([
        ("requirements.txt", "a", "1.0", "-"), ("requirements.txt", "b", "2.0", "-"), ("requirements.txt", "c", "-", ">=1,<2"),
        ("requirements.txt", "e", "-", "==1.*"), ("requirements.txt", "f", "3", "-"),
        ("package.json", "a", "1.2.3", "-"), ("package.json", "b", "-", "^1.2.3"), ("package.json", "c", "-", "*"),
        ("package.json", "d", "-", "https://x/y.tgz"), ("package.json", "@s/e", "2.0.0-rc.1", "-"),
        ("go.mod", "x/y", "1.2.3", "-"), ("go.mod", "p", "0.1.0", "-"),
        ("Cargo.toml", "a", "1.0.0", "-"), ("Cargo.toml", "b", "-", "1.2"), ("Cargo.toml", "d", "3.1", "-"),
        ("pom.xml", "g:a", "1.0", "-"), ("pom.xml", "g:b", "-", "[1.0,2.0)")])
    assert manifests.manifest_pins(frame).count() == 10


def test_a_package_in_two_spellings_is_one_finding(spark):
    from pinwatch.plans.exposure import exposure

    o = ops(spark, [(0, "s", "PyYAML", "added", "1.0"), (1, "s", "pyyaml", "added", "1.0"), (2, "t", "pyyaml", "added", "1.0"),
                    (2, "u", "Other", "added", "1.0"), (3, "s", "pyyaml", "added", "1.0", "npm")])
    c = cves(spark, [(0, "C", "pyyaml", "< 2", [], ""), (0, "D", "other", "< 2")])
    registry = spark.createDataFrame([], "service_id string, team string, is_customer_facing boolean, pci_scope boolean, hipaa_scope boolean, soc2_scope boolean, pii_handler boolean")
    found = exposure(o, c, registry, mark_new=True)
    assert rows(found, "service_id", "ecosystem", "cve_id", "detected_at", "is_new_dependency") == [
        ("s", "npm", "C", hours(3), True), ("s", "pypi", "C", hours(0), True), ("t", "pypi", "C", hours(2), True), ("u", "pypi", "D", hours(2), True)]


def test_spellings_with_other_versions_or_times_keep_their_findings(spark):
    from pinwatch.plans.exposure import exposure

    o = ops(spark, [
        (0, "later", "PyYAML", "added", "6.0"), (1, "later", "PyYAML", "removed", "6.0"), (2, "later", "pyyaml", "added", "5.1"),
        (0, "both", "PyYAML", "added", "6.0"), (0, "both", "pyyaml", "added", "5.1"),
        (0, "again", "PyYAML", "added", "5.1"), (3, "again", "PyYAML", "removed", "5.1"), (5, "again", "pyyaml", "added", "5.1"),
        (0, "chain", "PyYAML", "added", "5.1"), (4, "chain", "PyYAML", "removed", "5.1"), (2, "chain", "pyyaml", "added", "5.1"), (8, "chain", "pyyaml", "removed", "5.1"),
        (6, "chain", "PyYaml", "added", "5.1"), (9, "chain", "PyYaml", "removed", "5.1"),
        (0, "touch", "PyYAML", "added", "5.1"), (3, "touch", "PyYAML", "removed", "5.1"), (3, "touch", "pyyaml", "added", "5.1")])
    c = cves(spark, [(0, "C", "pyyaml", "< 5.4"), (1, "D", "PyYAML", "< 5.4")])
    registry = spark.createDataFrame([], "service_id string, team string, is_customer_facing boolean, pci_scope boolean, hipaa_scope boolean, soc2_scope boolean, pii_handler boolean")
    found = exposure(o, c, registry, mark_new=True)
    got = sorted((r.service_id, r.cve_id, r.detected_at, r.left_at, r.matched_version, r.is_new_dependency) for r in found.collect())
    want = []
    for cve, known in (("C", 0), ("D", 1)):
        want += [("later", cve, hours(2), None), ("both", cve, hours(known), None), ("again", cve, hours(known), hours(3)),
                 ("again", cve, hours(5), None), ("chain", cve, hours(known), hours(9)), ("touch", cve, hours(known), hours(3)), ("touch", cve, hours(3), None)]
    assert got == sorted((*w, "5.1", True) for w in want)
    assert found.select("match_id").distinct().count() == len(want)


def test_broken_manifests_are_listed_and_end_no_job(spark):
    texts = [
        ("pom.xml", "<project><dependencies><dependency><groupId>g</groupId>"), ("pom.xml", "no xml & at all"), ("pom.xml", ""),
        ("pom.xml", "<project><!-- <dependency><groupId>no</groupId><artifactId>no</artifactId><version>1</version></dependency> --><dependency><groupId> g </groupId>"
                    "<artifactId>a&amp;b</artifactId><exclusions><exclusion><groupId>x</groupId><artifactId>y</artifactId></exclusion></exclusions><version>1.0</version></dependency>"
                    "<dependency><groupId>only</groupId><version>1</version></dependency><dependency><groupId>g</groupId><artifactId>open</artifactId></dependency></project>"),
        ("package.json", "{"), ("package.json", '{"optionalDependencies":{"o":"1.0.0"},"peerDependencies":{"p":"2.0.0"},"dependencies":null}'),
        ("requirements.txt", None), ("poetry.lock", "x"),
    ]
    frame = spark.createDataFrame([(f"s{i}", "e", *t) for i, t in enumerate(texts)], "service_id string, ecosystem string, manifest_file string, content string")
    assert rows(manifests.broken_manifests(frame), "service_id", "reason") == [
        ("s0", "not xml"), ("s1", "not xml"), ("s2", "not xml"), ("s4", "not json"), ("s6", "no content"), ("s7", "unknown kind")]
    found = manifests.requirements(frame).fillna("-", ["version", "version_range"])
    assert rows(found, "service_id", "package", "version", "version_range") == [("s3", "g:a&b", "1.0", "-"), ("s5", "o", "1.0.0", "-"), ("s5", "p", "-", "2.0.0")]


def test_package_urls_are_escaped_and_documents_describe_all_packages(spark):
    import json

    o = ops(spark, [(0, "s", "@a/b", "added", "1.0+x y", "npm"), (0, "s", "github.com/X/Y", "added", "v1", "go"), (0, "s", "foo_bar", "added", "1!2.0", "pypi"),
                    (0, "s", "x~y*z", "added", "1:2~3", "cargo")])
    pins = graph.current_pins(o)
    assert rows(pins.select(sbom.package_url().alias("purl")), "purl") == [
        ("pkg:cargo/x~y%2Az@1:2~3",), ("pkg:golang/github.com/x/y@v1",), ("pkg:npm/%40a/b@1.0%2Bx%20y",), ("pkg:pypi/foo-bar@1%212.0",)]
    document = json.loads(sbom.spdx(pins, F.lit("2024-01-01T00:00:00Z")).first().document)
    assert {(r["spdxElementId"], r["relationshipType"], r["relatedSpdxElement"]) for r in document["relationships"]} == {
        ("SPDXRef-DOCUMENT", "DESCRIBES", p["SPDXID"]) for p in document["packages"]}
    for package in document["packages"]:
        assert set(package) == {"SPDXID", "name", "versionInfo", "downloadLocation", "externalRefs"}
        assert package["externalRefs"][0]["referenceType"] == "purl"
    bom = json.loads(sbom.cyclonedx(pins, F.lit("2024-01-01T00:00:00Z")).first().document)
    assert {(c["type"], c["name"], c["version"], c["purl"]) for c in bom["components"]} == {
        ("library", r.package, r.version, r.purl) for r in pins.withColumn("purl", sbom.package_url()).collect()}
