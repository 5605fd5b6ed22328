"""Vulnerabilities, dependency state, matching, scoring and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pinwatch import schemas
from pinwatch.catalog.feeds import as_of
from pinwatch.catalog.registry import query
from pinwatch.catalog.views import AS_OF, Tables
from pinwatch.operators import closure, graph, lookups, manifests, match, posture, sbom, scoring, vulnerabilities as V
from pinwatch.plans import exposure as plan
from pinwatch.functions.scalars import match_id
from pinwatch.session import scratch_path, stored_table
from pinwatch.sinks import tables as stored, topics as out
from pinwatch.sources.tables import conform, read_table

_RECORD = "cve_id, affected_package, ecosystem, affected_version_range"


def osv(t: Tables) -> DataFrame:
    return t.vulns.filter("source = 'osv'")


def cves(t: Tables) -> DataFrame:
    return plan.known_vulnerabilities(t.vulns)


# --- records ----------------------------------------------------------------------------------------


@query("union_sources", "SELECT event_id, cve_id, source, affected_package, cvss_score FROM vuln_events")
def union_sources(t: Tables) -> DataFrame:
    nvd = t.vulns.filter("source = 'nvd'").drop("affected_list")
    return V.union_sources(osv(t), nvd).select("event_id", "cve_id", "source", "affected_package", "cvss_score")


@query("dedup_first_ever", f"""SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY {_RECORD}
 ORDER BY ingested_at, event_id) AS rn FROM vuln_events) x WHERE rn = 1""")
def dedup_first_ever(t: Tables) -> DataFrame:
    return V.dedup_first_ever(t.vulns).select("event_id")


@query("dedup_first_24h", f"""WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY {_RECORD} ORDER BY ingested_at, event_id) AS rn
 FROM vuln_events), walk AS (SELECT event_id, {_RECORD}, rn, ingested_at AS accepted_at, true AS kept FROM ranked WHERE rn = 1
 UNION ALL SELECT r.event_id, r.cve_id, r.affected_package, r.ecosystem, r.affected_version_range, r.rn,
 CASE WHEN r.ingested_at >= w.accepted_at + INTERVAL 24 HOUR THEN r.ingested_at ELSE w.accepted_at END,
 r.ingested_at >= w.accepted_at + INTERVAL 24 HOUR FROM walk w JOIN ranked r ON r.cve_id = w.cve_id
 AND r.affected_package = w.affected_package AND r.ecosystem = w.ecosystem
 AND r.affected_version_range = w.affected_version_range AND r.rn = w.rn + 1) SELECT event_id FROM walk WHERE kept""")
def dedup_first_24h(t: Tables) -> DataFrame:
    return V.dedup_first_24h(t.vulns).select("event_id")


@query("cve_state_lww", f"""SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY {_RECORD}
 ORDER BY ingested_at DESC, event_id DESC) AS rn FROM vuln_events) x WHERE rn = 1""")
def cve_state_lww(t: Tables) -> DataFrame:
    return V.latest_record(t.vulns).select("event_id")


@query("cve_ttl_24h", """SELECT event_id FROM vuln_events WHERE ingested_at > TIMESTAMP '1995-03-05' - INTERVAL 24 HOUR
 AND ingested_at <= TIMESTAMP '1995-03-05'""")
def cve_ttl_24h(t: Tables) -> DataFrame:
    return V.within_ttl(t.vulns, F.lit("1995-03-05").cast("timestamp"), hours=24).select("event_id")


@query("cvss_enrich", "SELECT event_id, cvss_score, severity_tier, cwe_id FROM cves")
def cvss_enrich(t: Tables) -> DataFrame:
    return cves(t).select("event_id", "cvss_score", "severity_tier", "cwe_id")


@query("classify_cwe", """SELECT cve_id, cwe_id, 'access_control' AS category FROM cves
 WHERE cwe_id IN ('CWE-284', 'CWE-285', 'CWE-862')""")
def classify_cwe(t: Tables) -> DataFrame:
    return lookups.classify_weakness(cves(t)).select("cve_id", "cwe_id", "category")


# --- dependency state -------------------------------------------------------------------------------


@query("dep_graph_current", "SELECT service_id, ecosystem, package, version, since FROM pins")
def dep_graph_current(t: Tables) -> DataFrame:
    from pinwatch.sources.changes import explode_changes

    return graph.current_pins(explode_changes(t.dep_events))


_MAP = "string_agg(package || '=' || version, ',' ORDER BY package || '=' || version)"


def _as_text(maps: DataFrame) -> DataFrame:
    entries = F.transform(F.map_entries("dependencies"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return maps.withColumn("dependencies", F.array_join(F.sort_array(entries), ","))


@query("dep_graph_map", f"SELECT service_id, ecosystem, {_MAP} AS dependencies FROM pins GROUP BY 1, 2")
def dep_graph_map(t: Tables) -> DataFrame:
    return _as_text(graph.snapshot_maps(t.ops)).select("service_id", "ecosystem", "dependencies")


_HISTORY = """SELECT e.service_id, o.ecosystem, o.package, o.version, e.event_id AS trigger_event_id, e.occurred_at AS snapshot_at
 FROM (SELECT DISTINCT service_id, event_id, occurred_at FROM dep_ops) e JOIN ops_next o ON e.service_id = o.service_id
 WHERE o.op <> 'removed' AND (o.occurred_at, o.event_id) <= (e.occurred_at, e.event_id)
 AND (o.next_at IS NULL OR (e.occurred_at, e.event_id) < (o.next_at, o.next_event))"""


@query("dep_snapshot_history", f"""SELECT service_id, ecosystem, trigger_event_id, snapshot_at, {_MAP} AS dependencies
 FROM ({_HISTORY}) h GROUP BY 1, 2, 3, 4""")
def dep_snapshot_history(t: Tables) -> DataFrame:
    return _as_text(graph.snapshot_history(t.ops_once, t.ops_once, graph.crowded_pins(t.ops_once)))


@query("scd2_dependencies", "SELECT service_id, ecosystem, package, version, valid_from, valid_to, from_event FROM scd2")
def scd2_dependencies(t: Tables) -> DataFrame:
    return graph.validity_intervals(t.ops_once, graph.crowded_pins(t.ops_once))


_LAST_EVENT = "SELECT service_id, max((occurred_at, event_id)) AS m FROM dep_ops GROUP BY 1"


def store_quarters(ops: DataFrame, path: str) -> None:
    """Snapshots as they stood at the end of each quarter of the time that ``ops`` cover, of the services
    with events in it; a service left without pins has an empty one."""
    at = F.unix_micros("occurred_at")
    first, last = ops.agg(F.min(at), F.max(at)).first()
    ends = [None, *[(first or 0) + ((last or 0) - (first or 0)) * n // 4 for n in range(1, 5)]]
    for start, end in zip(ends, ends[1:], strict=False):
        known = ops.filter(at <= end)
        events = known if start is None else known.filter(at > start)
        snapshots = graph.stored_snapshots(graph.latest_state(known, events)).unionByName(graph.empty_snapshots(known, events))
        stored.append_table(snapshots, "dep_graph_snapshots", path)


@query("latest_snapshot", f"""WITH h AS ({_HISTORY}) SELECT h.service_id, h.ecosystem, h.trigger_event_id, h.snapshot_at, {_MAP} AS dependencies
 FROM h JOIN ({_LAST_EVENT}) l ON h.service_id = l.service_id AND (h.snapshot_at, h.trigger_event_id) = l.m GROUP BY 1, 2, 3, 4""")
def latest_snapshot(t: Tables) -> DataFrame:
    """From stored snapshots of several moments; a service whose newest one is empty has no rows."""
    path = scratch_path(t.spark, "dep_graph_snapshots")
    store_quarters(stored_table(t.ops, "ops"), path)  # read several times for each quarter
    newest = graph.latest_snapshot(read_table(t.spark, "dep_graph_snapshots", path)).filter("size(dependencies) > 0")
    return _as_text(newest).select("service_id", "ecosystem", F.col("snapshot_id").alias("trigger_event_id"), "snapshot_at", "dependencies")


@query("get_dependency_graph", "SELECT service_id, ecosystem, package, version FROM pins")
def get_dependency_graph(t: Tables) -> DataFrame:
    return graph.current_pins(t.ops).select("service_id", "ecosystem", "package", "version")


_SETTLED = """SELECT *, lag(op) OVER (PARTITION BY service_id, ecosystem, package ORDER BY occurred_at, event_id) AS prev_op
 FROM (SELECT * FROM dep_ops QUALIFY row_number() OVER (PARTITION BY service_id, ecosystem, package, occurred_at, event_id
 ORDER BY op_rank DESC, pos DESC) = 1) s"""
_NEW = f"""SELECT service_id, ecosystem, package, version, event_id, occurred_at FROM ({_SETTLED}) n
 WHERE op <> 'removed' AND (prev_op IS NULL OR prev_op = 'removed')"""


@query("new_dependencies", _NEW)
def new_dependencies(t: Tables) -> DataFrame:
    return graph.new_dependencies(t.ops_once, graph.crowded_pins(t.ops_once))


# --- matching ---------------------------------------------------------------------------------------

_PIN_HITS = "JOIN hits h ON p.ecosystem = h.ecosystem AND lower(p.package) = h.pk AND p.version = h.version"


@query("cve_dep_join", f"""SELECT p.service_id, p.ecosystem, p.package, p.version, h.cve_id, h.affected_package, h.cvss_score
 FROM pins p {_PIN_HITS}""")
def cve_dep_join(t: Tables) -> DataFrame:
    joined = match.match_pins(graph.current_pins(t.ops_once), cves(t), versions_from=t.ops_once)
    return joined.select("service_id", "ecosystem", "package", "version", "cve_id", "affected_package", "cvss_score")


@query("eco_wildcard", f"""SELECT p.ecosystem, h.cve_id, count(*) AS pins FROM pins p {_PIN_HITS}
 JOIN cves c ON c.cve_id = h.cve_id WHERE c.ecosystem = '' GROUP BY 1, 2""")
def eco_wildcard(t: Tables) -> DataFrame:
    anywhere = cves(t).filter("ecosystem = ''")
    pins = stored_table(graph.current_pins(t.ops), "pins")  # read for versions, for crowded ones, and for the join
    return match.match_pins(pins, anywhere, ["cve_id"]).groupBy("ecosystem", "cve_id").agg(F.count("*").alias("pins"))


@query("pkg_case_insensitive", f"""WITH spelled AS (SELECT service_id, ecosystem, min(package) AS package FROM
 (SELECT service_id, ecosystem, package FROM pins UNION ALL SELECT service_id, ecosystem, upper(package) FROM pins) a
 GROUP BY service_id, ecosystem, lower(package)) SELECT s.service_id, s.package, h.affected_package AS matched_package, h.cve_id
 FROM spelled s JOIN pins p ON s.service_id = p.service_id AND s.ecosystem = p.ecosystem AND lower(s.package) = lower(p.package) {_PIN_HITS}""")
def pkg_case_insensitive(t: Tables) -> DataFrame:
    pins = graph.current_pins(t.ops_once)
    both = pins.unionByName(pins.withColumn("package", F.upper("package")))
    joined = match.match_pins(match.one_spelling(both), cves(t), versions_from=t.ops_once)
    return joined.select("service_id", "package", F.col("affected_package").alias("matched_package"), "cve_id")


@query("version_in_list", """SELECT p.service_id, p.package, p.version FROM pins p WHERE EXISTS (SELECT 1 FROM cves c
 WHERE c.ecosystem IN (p.ecosystem, '') AND c.pk = lower(p.package) AND list_contains(c.listed, p.version))""")
def version_in_list(t: Tables) -> DataFrame:
    return match.listed_versions(graph.current_pins(t.ops), cves(t)).select("service_id", "package", "version")


@query("version_range_join", "SELECT ecosystem, pk AS package_key, version, cve_id, ingested_at FROM hits")
def version_range_join(t: Tables) -> DataFrame:
    return match.affected_versions(t.pins_ever, cves(t), ["cve_id", "ingested_at"])


@query("match_both_orders", """SELECT service_id, ecosystem, package, version, cve_id, valid_from, valid_to, detected_at FROM timed_hits""")
def match_both_orders(t: Tables) -> DataFrame:
    rows = match.match_both_orders(graph.validity_intervals(t.ops_once, graph.crowded_pins(t.ops_once)), cves(t), versions_from=t.ops_once)
    return rows.select("service_id", "ecosystem", "package", "version", "cve_id", "valid_from", "valid_to", "detected_at")


@query("match_asof_reference", f"""SELECT h.cve_id, p.service_id, p.ecosystem, p.package, p.version, min(p.snapshot_at) AS detected_at
 FROM ({_HISTORY}) p {_PIN_HITS} WHERE h.ingested_at <= p.snapshot_at GROUP BY 1, 2, 3, 4, 5""")
def match_asof_reference(t: Tables) -> DataFrame:
    return match.match_asof(graph.states(t.ops_once, graph.crowded_pins(t.ops_once)), t.ops_once, cves(t))


_IDEMPOTENT = """SELECT cve_id, service_id, version AS matched_version, min(detected_at) AS detected_at FROM timed_hits GROUP BY 1, 2, 3"""


def _idempotent(t: Tables) -> DataFrame:
    rows = plan.exposure(t.ops_once, t.vulns, t.registry)
    # Whole rows would cross the network; stored, those that made them are gone before these cross.
    return match.match_idempotent(stored_table(rows.select("cve_id", "service_id", "matched_version", "detected_at"), "matches", compact=True))


@query("match_idempotent", _IDEMPOTENT)
def match_idempotent(t: Tables) -> DataFrame:
    return _idempotent(t)


@query("agent_dedup", """SELECT cve_id, service_id, matched_version, min(detected_at) AS detected_at,
 arg_min(match_id, (detected_at, match_id)) AS match_id FROM vulnerability_matches GROUP BY 1, 2, 3""")
def agent_dedup(t: Tables) -> DataFrame:
    """Every match is reported twice more, a little later: the agent hears of it once."""
    again = lambda n: t.matches.withColumns({
        "match_id": F.concat("match_id", F.lit(f"-{n}")), "detected_at": F.col("detected_at") + F.make_dt_interval(hours=F.lit(n))
    })
    heard = t.matches.unionByName(again(1)).unionByName(again(30))
    return match.match_idempotent(heard).select("cve_id", "service_id", "matched_version", "detected_at", "match_id")


@query("auto_resolve", """WITH v AS (SELECT s.*, h.cve_id, h.ingested_at FROM scd2 s JOIN hits h ON s.ecosystem = h.ecosystem
 AND lower(s.package) = h.pk AND s.version = h.version), g AS (SELECT *, CASE WHEN valid_from = lag(valid_to) OVER w THEN 0 ELSE 1 END AS fresh
 FROM v WINDOW w AS (PARTITION BY cve_id, service_id, ecosystem, package ORDER BY valid_from)), i AS (SELECT *, sum(fresh) OVER
 (PARTITION BY cve_id, service_id, ecosystem, package ORDER BY valid_from) AS island FROM g), f AS (SELECT cve_id, service_id,
 ecosystem, package, min(ingested_at) AS seen, min(valid_from) AS starts, CASE WHEN count(*) = count(valid_to) THEN max(valid_to) END AS resolved_at
 FROM i GROUP BY cve_id, service_id, ecosystem, package, island) SELECT cve_id, service_id, ecosystem, package,
 greatest(seen, starts) AS detected_at, resolved_at FROM f WHERE resolved_at IS NULL OR seen < resolved_at""")
def auto_resolve(t: Tables) -> DataFrame:
    return lookups.auto_resolve(t.ops_once, cves(t), graph.crowded_pins(t.ops_once))


@query("pr_risk_gate", f"""WITH n AS ({_NEW}), found AS (SELECT ecosystem, pk, version, count(DISTINCT cve_id) AS cves,
 max(CASE WHEN severity_tier IN ('CRITICAL', 'HIGH') THEN 1 ELSE 0 END) AS severe FROM hits GROUP BY 1, 2, 3)
 SELECT n.service_id, n.event_id, n.ecosystem, n.package, n.version, coalesce(f.cves, 0) AS cves,
 CASE WHEN f.severe = 1 THEN 'BLOCK' WHEN f.cves > 0 THEN 'WARN' ELSE 'APPROVE' END AS verdict FROM n LEFT JOIN found f
 ON n.ecosystem = f.ecosystem AND lower(n.package) = f.pk AND n.version = f.version""")
def pr_risk_gate(t: Tables) -> DataFrame:
    return lookups.pr_risk_gate(t.ops_once, cves(t), graph.crowded_pins(t.ops_once))


@query("get_remediation_path", """WITH tried AS (SELECT DISTINCT k.ecosystem, k.pk, c.safe_version AS fix,
 list_transform(string_split(c.safe_version, '.'), lambda x: CAST(x AS INT)) AS v FROM catalogue k JOIN cves c ON c.pk = k.pk
 AND (c.ecosystem = '' OR c.ecosystem = k.ecosystem) WHERE c.safe_version <> ''),
 clean AS (SELECT * FROM tried t WHERE NOT EXISTS (SELECT 1 FROM cves c WHERE c.pk = t.pk AND (c.ecosystem = '' OR c.ecosystem = t.ecosystem)
 AND (list_contains(c.listed, t.fix) OR (c.hi IS NOT NULL AND t.v < c.hi AND (c.lo IS NULL OR t.v >= c.lo))))),
 found AS (SELECT ecosystem, pk, version, count(DISTINCT cve_id) AS cves, bool_or(coalesce(safe_version, '') = '') AS unfixed FROM hits GROUP BY 1, 2, 3),
 best AS (SELECT f.ecosystem, f.pk, f.version, arg_min(c.fix, c.v) AS upgrade_to FROM found f JOIN clean c ON c.pk = f.pk AND c.ecosystem = f.ecosystem
 AND c.v >= list_transform(string_split(f.version, '.'), lambda x: CAST(x AS INT)) WHERE NOT unfixed GROUP BY 1, 2, 3)
 SELECT f.ecosystem, f.pk AS package, f.version, upgrade_to, cves, CASE WHEN unfixed THEN 'no fix known' WHEN upgrade_to IS NULL
 THEN 'every fix is affected' ELSE 'fixed' END AS reason FROM found f LEFT JOIN best b ON b.ecosystem = f.ecosystem AND b.pk = f.pk AND b.version = f.version""")
def get_remediation_path(t: Tables) -> DataFrame:
    return lookups.remediation_path(t.pins_ever.select("ecosystem", "package", "version").distinct(), cves(t))


# --- scoring and routing ----------------------------------------------------------------------------


@query("registry_enrich", """SELECT m.match_id, meta.* FROM vulnerability_matches m JOIN meta ON m.service_id = meta.service_id""")
def registry_enrich(t: Tables) -> DataFrame:
    return scoring.registry_enrich(t.matches, t.registry).select("match_id", "service_id", "team", *scoring.FLAGS)


_NEW_PINS = f"SELECT DISTINCT service_id, ecosystem, package, version, event_id AS from_event FROM ({_NEW}) fresh"


@query("exposure_by_topic", f"""WITH routed AS (SELECT 'vuln.matches.' || lower(tier) AS topic, * FROM tiered UNION ALL
 SELECT 'deps.risk.prs', t.* FROM tiered t SEMI JOIN ({_NEW_PINS}) n USING (service_id, ecosystem, package, version, from_event))
 SELECT topic, count(*) AS matches, count(DISTINCT service_id) AS services,
 count(DISTINCT cve_id) AS cves, count(*) FILTER (valid_to IS NULL) AS still_there, min(detected_at) AS first_detected,
 round(avg(score), 4) AS mean_score FROM routed GROUP BY 1""")
def exposure_by_topic(t: Tables) -> DataFrame:
    return by_topic(plan.routed_exposure(t.ops_once, t.vulns, t.registry))


def by_topic(routed: DataFrame) -> DataFrame:
    return routed.groupBy("topic").agg(
        F.count("*").alias("matches"),
        F.count_distinct("service_id").alias("services"),
        F.count_distinct("cve_id").alias("cves"),
        F.count(F.when(F.col("left_at").isNull(), 1)).alias("still_there"),
        F.min("detected_at").alias("first_detected"),
        F.round(F.avg("score"), 4).alias("mean_score"),
    )


_SCORED = """SELECT cve_id, service_id, team, ecosystem, affected_package AS matched_package, version AS matched_version, cvss_score,
 severity_tier, score, tier AS blast_radius_tier, detected_at, detected_at + INTERVAL 1 HOUR * CASE tier WHEN 'CRITICAL' THEN 4
 WHEN 'HIGH' THEN 24 WHEN 'MEDIUM' THEN 168 ELSE 720 END AS sla_deadline FROM tiered"""


@query("exposure_matches", _SCORED)
def exposure_matches(t: Tables) -> DataFrame:
    return plan.exposure(t.ops_once, t.vulns, t.registry).drop("match_id", "left_at")


_CURRENT_TIERED = f"""SELECT p.service_id, p.package, h.cve_id, lower(CASE WHEN s >= 0.75 THEN 'CRITICAL' WHEN s >= 0.5 THEN 'HIGH'
 WHEN s >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END) AS tier, n.event_id IS NOT NULL AS is_new FROM pins p {_PIN_HITS}
 LEFT JOIN service_registry r ON p.service_id = r.service_id, LATERAL (SELECT round(least(h.cvss_score, 10.0) / 10.0 * 0.4
 + CASE WHEN r.is_customer_facing THEN 0.25 ELSE 0 END + CASE WHEN r.pci_scope OR r.hipaa_scope OR r.soc2_scope THEN 0.2 ELSE 0 END
 + CASE WHEN r.pii_handler THEN 0.15 ELSE 0 END, 6) AS s) z LEFT JOIN ({_NEW}) n ON n.service_id = p.service_id
 AND n.ecosystem = p.ecosystem AND n.package = p.package AND n.version = p.version AND n.occurred_at = p.since"""
_ROUTED = f"""SELECT service_id, cve_id, 'vuln.matches.' || tier AS topic FROM ({_CURRENT_TIERED}) x
 UNION ALL SELECT service_id, cve_id, 'deps.risk.prs' FROM ({_CURRENT_TIERED}) x WHERE is_new"""


def current_routed(t: Tables) -> DataFrame:
    """Matches of the current pins; a pin whose last change introduced the package counts as new."""
    pins = scoring.registry_enrich(graph.current_pins(t.ops_once), t.registry)
    fresh = graph.new_dependencies(t.ops_once, graph.crowded_pins(t.ops_once)).select(
        *graph.PIN, "version", F.col("occurred_at").alias("since"), F.lit(True).alias("is_new_dependency")
    )
    # Read for versions, for crowded ones, and for the join.
    marked = stored_table(pins.join(fresh, [*graph.PIN, "version", "since"], "left"), "pins")
    found = match.match_pins(marked, cves(t)).withColumn("detected_at", F.greatest("ingested_at", "since"))
    return scoring.route(scoring.score(found)).select("service_id", "cve_id", "package", "version", "topic")


@query("split_by_topic", f"SELECT topic, count(*) AS matches FROM ({_ROUTED}) y GROUP BY topic")
def split_by_topic(t: Tables) -> DataFrame:
    frames = scoring.split_by_topic(current_routed(t))
    counts = [f.agg(F.count("*").alias("matches")).select(F.lit(topic).alias("topic"), "matches") for topic, f in frames.items()]
    merged = counts[0]
    for other in counts[1:]:
        merged = merged.unionByName(other)
    return merged.filter("matches > 0")


# --- outputs ----------------------------------------------------------------------------------------


@query("sink_tier_topics", f"SELECT topic, count(*) AS messages, count(DISTINCT service_id) AS keys FROM ({_ROUTED}) y GROUP BY topic")
def sink_tier_topics(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "topics")
    out.write_topic_files(out.keyed_matches(current_routed(t)), path)
    written = t.spark.read.parquet(path)
    return written.groupBy("topic").agg(F.count("*").alias("messages"), F.count_distinct("key").alias("keys"))


@query("sink_keyed_publish", f"SELECT service_id AS key, topic, count(*) AS messages FROM ({_ROUTED}) y GROUP BY 1, 2")
def sink_keyed_publish(t: Tables) -> DataFrame:
    messages = out.keyed_matches(current_routed(t))
    from_value = F.from_json("value", "service_id STRING")["service_id"]
    return messages.filter(from_value == F.col("key")).groupBy("key", "topic").agg(F.count("*").alias("messages"))


@query("sink_snapshots", f"SELECT service_id AS key, ecosystem, count(*) AS pins FROM pins GROUP BY 1, 2")
def sink_snapshots(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "snapshots")
    out.write_topic_files(out.keyed_snapshots(graph.snapshot_maps(t.ops)), path)
    body = F.from_json("value", "ecosystem STRING, dependencies MAP<STRING, STRING>")
    rows = t.spark.read.parquet(path).select("key", body.alias("b"))
    return rows.select("key", "b.ecosystem", F.size("b.dependencies").cast("bigint").alias("pins"))


@query("sink_registry_upsert", """SELECT service_id, max(team) AS team FROM (SELECT service_id, team FROM service_registry
 UNION ALL SELECT DISTINCT service_id, 'found' FROM dep_ops WHERE service_id NOT IN (SELECT service_id FROM service_registry)) x GROUP BY 1""")
def sink_registry_upsert(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "registry")
    stored.append_table(t.registry, "service_registry", path)
    seen = t.ops.select("service_id", F.lit("found").alias("team"))
    stored.upsert_registry(seen, read_table(t.spark, "service_registry", path), path)
    return read_table(t.spark, "service_registry", path).select("service_id", "team")


@query("sink_tables", "SELECT match_id, cve_id, service_id, blast_radius, status, sla_deadline, detected_at, resolved_at FROM vulnerability_matches")
def sink_tables(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "matches")
    stored.append_table(t.matches, "vulnerability_matches", path)
    return read_table(t.spark, "vulnerability_matches", path).select(
        "match_id", "cve_id", "service_id", "blast_radius", "status", "sla_deadline", "detected_at", "resolved_at"
    )


def _written(t: Tables, name: str, rows: DataFrame) -> DataFrame:
    path = scratch_path(t.spark, name)
    stored.append_table(rows, name, path)
    return read_table(t.spark, name, path)


@query("sink_vulnerabilities", """SELECT cve_id, source, affected_package, ecosystem, affected_version_range, safe_version, cwe_id,
 severity_tier, CAST(cvss_score AS DOUBLE) AS cvss_score FROM cves""")
def sink_vulnerabilities(t: Tables) -> DataFrame:
    return _written(t, "vulnerabilities", cves(t)).select(
        "cve_id", "source", "affected_package", "ecosystem", "affected_version_range", "safe_version", "cwe_id", "severity_tier",
        F.col("cvss_score").cast("double").alias("cvss_score"),
    )


@query("sink_triage_reports", "SELECT report_id, match_id, exploitability, CAST(confidence_score AS DOUBLE) AS confidence_score FROM triage_reports")
def sink_triage_reports(t: Tables) -> DataFrame:
    return _written(t, "triage_reports", t.view("triage_reports")).select(
        "report_id", "match_id", "exploitability", F.col("confidence_score").cast("double").alias("confidence_score")
    )


@query("sink_dep_graph_snapshots", f"""SELECT service_id, ecosystem, event_id AS snapshot_id, {_MAP} AS dependencies
 FROM pins JOIN (SELECT service_id, m[2] AS event_id FROM ({_LAST_EVENT}) x) l USING (service_id) GROUP BY 1, 2, 3""")
def sink_dep_graph_snapshots(t: Tables) -> DataFrame:
    rows = graph.stored_snapshots(graph.latest_state(t.ops_once, t.ops_once))
    return _as_text(_written(t, "dep_graph_snapshots", rows)).select("service_id", "ecosystem", "snapshot_id", "dependencies")


@query("check_fk_reports", "SELECT report_id, match_id FROM triage_reports WHERE match_id NOT IN (SELECT match_id FROM open_matches)")
def check_fk_reports(t: Tables) -> DataFrame:
    """Reports whose match is no longer open, as if only open matches were stored."""
    still_open = t.matches.filter(posture.is_open(AS_OF))
    found = stored.violations("triage_reports", t.view("triage_reports"), {"vulnerability_matches": still_open})
    return found["match_id"].select("report_id", "match_id")


@query("sink_audit_log", "SELECT CAST(date_trunc('month', detected_at) AS DATE) AS event_date, count(*) AS entries FROM vulnerability_matches GROUP BY 1")
def sink_audit_log(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "audit")
    monthly_run = F.date_trunc("month", "detected_at")
    stored.append_audit(stored.audit_rows(t.matches, monthly_run), path)
    return t.spark.read.parquet(path).groupBy("event_date").agg(F.count("*").alias("entries"))


@query("check_fk", "SELECT match_id, cve_id FROM vulnerability_matches WHERE cve_id NOT IN (SELECT cve_id FROM osv_first)")
def check_fk(t: Tables) -> DataFrame:
    found = stored.violations("vulnerability_matches", t.matches, {"vulnerabilities": osv(t)})
    return found["cve_id"].select("match_id", "cve_id")


_PURL = """'pkg:' || CASE ecosystem WHEN 'go' THEN 'golang' WHEN 'rubygems' THEN 'gem' ELSE ecosystem END || '/' || package || '@' || version"""


@query("sbom_export", f"""SELECT service_id, CAST(count(*) AS INT) AS components, string_agg({_PURL}, ',' ORDER BY {_PURL}) AS purls
 FROM pins GROUP BY 1""")
def sbom_export(t: Tables) -> DataFrame:
    documents = sbom.cyclonedx(graph.current_pins(t.ops), F.lit(AS_OF))
    path = scratch_path(t.spark, "sbom")
    sbom.write_sboms(documents, path, AS_OF[:10])
    back = t.spark.read.schema("service_id STRING, components INT, document STRING").json(path)
    listed = F.from_json("document", "components ARRAY<STRUCT<purl: STRING>>")["components"]["purl"]
    return back.select("service_id", "components", F.array_join(F.sort_array(listed), ",").alias("purls"))


@query("sbom_export_spdx", f"""SELECT service_id, CAST(count(*) AS INT) AS packages, string_agg({_PURL}, ',' ORDER BY {_PURL}) AS purls,
 string_agg(package || '=' || version, ',' ORDER BY package || '=' || version) AS named, 'SPDX-2.3' AS kind, true AS valid FROM pins GROUP BY 1""")
def sbom_export_spdx(t: Tables) -> DataFrame:
    documents = sbom.spdx(graph.current_pins(t.ops), F.lit(AS_OF))
    shape = """spdxVersion STRING, documentNamespace STRING, creationInfo STRUCT<created: STRING, creators: ARRAY<STRING>>,
        packages ARRAY<STRUCT<SPDXID: STRING, name: STRING, versionInfo: STRING, externalRefs: ARRAY<STRUCT<referenceLocator: STRING>>>>"""
    d = F.from_json("document", shape)
    purls = F.transform(d["packages"], lambda p: p["externalRefs"][0]["referenceLocator"])
    named = F.transform(d["packages"], lambda p: F.concat_ws("=", p["name"], p["versionInfo"]))
    ids = F.transform(d["packages"], lambda p: p["SPDXID"])
    text = lambda values: F.array_join(F.sort_array(values), ",")
    valid = d["documentNamespace"].isNotNull() & (F.size(d["creationInfo"]["creators"]) > 0) & (F.size(F.array_distinct(ids)) == F.size(ids))
    return documents.select("service_id", "packages", text(purls).alias("purls"), text(named).alias("named"), d["spdxVersion"].alias("kind"), valid.alias("valid"))


# --- manifests, indirect dependencies -----------------------------------------------------------------


def manifest_texts(t: Tables) -> DataFrame:
    """Current pins written back as each ecosystem's manifest, with comments and noise lines."""
    line = F.expr("""CASE ecosystem WHEN 'pypi' THEN package || '==' || version || '  # pinned' WHEN 'go' THEN '\t' || package || ' v' || version
        WHEN 'rubygems' THEN '    ' || package || ' (' || version || ')' WHEN 'cargo' THEN package || CASE WHEN version LIKE '%0' THEN ' = { version = "=' || version || '", optional = true }' ELSE ' = "=' || version || '"' END
        WHEN 'npm' THEN '"' || package || '":"' || version || '"'
        ELSE '<dependency><groupId>org</groupId><artifactId>' || package || '</artifactId><version>' || version || '</version></dependency>' END""")
    lines = graph.current_pins(t.ops).groupBy("service_id", "ecosystem").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    grouped = lines.withColumn("body", F.expr(r"array_join(lines, if(ecosystem = 'npm', ',', '\n'))"))
    file = F.expr("""CASE ecosystem WHEN 'pypi' THEN 'requirements.txt' WHEN 'go' THEN 'go.mod' WHEN 'rubygems' THEN 'Gemfile.lock'
        WHEN 'cargo' THEN 'Cargo.toml' WHEN 'npm' THEN 'package.json' ELSE 'pom.xml' END""")
    content = F.expr("""CASE ecosystem WHEN 'npm' THEN '{"name":"x","version":"9.9.9","dependencies":{' || body || '},"devDependencies":{"loose":"^1.2.3","any":"*"}}'
        WHEN 'maven' THEN '<project><dependencies>' || body || '</dependencies></project>' WHEN 'go' THEN 'module m\ngo 1.21\nrequire (\n' || body || '\n)\nexclude (\n\tbad v1.0.0\n)\nreplace old => new v2.0.0'
        WHEN 'pypi' THEN '# header\nloose>=1.0\n' || body WHEN 'rubygems' THEN 'GEM\n  specs:\n' || body || '\n\nDEPENDENCIES\n  x'
        ELSE '[package]\nname = "x"\nversion = "0.1.0"\nedition = "2021"\n[dependencies]\nloose = "1.2"\n' || body || '\n[profile.release]\nopt = "3"' END""")
    return grouped.select("service_id", "ecosystem", file.alias("manifest_file"), content.alias("content"))


@query("manifest_pins", """SELECT service_id, ecosystem, CASE WHEN ecosystem = 'maven' THEN 'org:' ELSE '' END || package AS package, version FROM pins""")
def manifest_pins(t: Tables) -> DataFrame:
    return manifests.manifest_pins(manifest_texts(t)).drop("manifest_file")


@query("manifest_ranges", """SELECT DISTINCT service_id, ecosystem, 'loose' AS package, CASE ecosystem WHEN 'pypi' THEN '>=1.0' WHEN 'npm' THEN '^1.2.3'
 ELSE '1.2' END AS version_range FROM pins WHERE ecosystem IN ('pypi', 'npm', 'cargo')
 UNION ALL SELECT DISTINCT service_id, ecosystem, 'any', '*' FROM pins WHERE ecosystem = 'npm'""")
def manifest_ranges(t: Tables) -> DataFrame:
    open_ = manifests.requirements(manifest_texts(t)).filter("version IS NULL")
    return open_.select("service_id", "ecosystem", "package", "version_range")


_CLOSURE = """WITH RECURSIVE e AS (SELECT ecosystem, package, depends_on, min(version) AS version FROM package_edges
 WHERE package <> depends_on GROUP BY 1, 2, 3),
 walk AS (SELECT ecosystem, package, depends_on, 1 AS depth, package || '>' || depends_on AS path, version FROM e
 UNION ALL SELECT w.ecosystem, w.package, e.depends_on, w.depth + 1, w.path || '>' || e.depends_on, e.version FROM walk w JOIN e
 ON w.depends_on = e.package AND w.ecosystem = e.ecosystem WHERE w.package <> e.depends_on),
 closed AS (SELECT ecosystem, package, depends_on, min(depth) AS depth, arg_min(path, (depth, path)) AS path,
 arg_min(version, (depth, path)) AS version FROM walk GROUP BY 1, 2, 3)"""
_ALL_PINS = f"""{_CLOSURE}, reached AS (SELECT service_id, ecosystem, package, version, false AS is_transitive, package AS path, 0 AS depth FROM pins
 UNION ALL SELECT p.service_id, p.ecosystem, c.depends_on, c.version, true, c.path, c.depth FROM (SELECT DISTINCT service_id, ecosystem, package FROM pins) p
 JOIN closed c ON p.package = c.package AND p.ecosystem = c.ecosystem), all_pins AS (SELECT service_id, ecosystem, package,
 arg_min(version, (depth, path)) AS version, arg_min(is_transitive, (depth, path)) AS is_transitive,
 arg_min(path, (depth, path)) AS transitive_path FROM reached GROUP BY 1, 2, 3)"""


@query("transitive_closure_maintained", f"{_CLOSURE} SELECT * FROM closed")
def transitive_closure_maintained(t: Tables) -> DataFrame:
    """The closure of some edges and others that are wrong, then with the rest added and the wrong ones removed."""
    edges = t.view("package_edges")
    number = F.pmod(F.xxhash64("package", "depends_on"), F.lit(20))
    wrong = edges.filter(number == 1).select("ecosystem", F.col("depends_on").alias("package"), F.col("package").alias("depends_on"), F.lit("0").alias("version"))
    wrong = wrong.join(edges, ["ecosystem", "package", "depends_on"], "left_anti")
    start = stored_table(edges.filter(number != 0).select(wrong.columns).unionByName(wrong), "early-edges")
    before = stored_table(closure.transitive_closure(start), "early-closure")
    after, _ = closure.updated_closure(before, start, edges.filter(number == 0), wrong)
    return after


@query("transitive_closure", f"{_CLOSURE} SELECT * FROM closed")
def transitive_closure(t: Tables) -> DataFrame:
    return closure.transitive_closure(t.view("package_edges"))


@query("transitive_pins", f"{_ALL_PINS} SELECT * FROM all_pins")
def transitive_pins(t: Tables) -> DataFrame:
    return closure.transitive_pins(graph.current_pins(t.ops), t.view("package_edges"))


@query("transitive_exposure", f"""{_ALL_PINS}, wanted AS (SELECT DISTINCT ecosystem, lower(package) AS pk, version,
 list_transform(string_split(version, '.'), lambda x: CAST(x AS INT)) AS v FROM all_pins),
 found AS (SELECT DISTINCT k.ecosystem, k.pk, k.version, c.cve_id FROM wanted k JOIN cves c ON k.pk = c.pk AND c.ecosystem IN ('', k.ecosystem)
 WHERE list_contains(c.listed, k.version) OR (c.hi IS NOT NULL AND k.v < c.hi AND (c.lo IS NULL OR k.v >= c.lo)))
 SELECT p.service_id, p.ecosystem, p.package, p.version, f.cve_id, p.is_transitive, p.transitive_path FROM all_pins p
 JOIN found f ON f.ecosystem = p.ecosystem AND f.pk = lower(p.package) AND f.version = p.version""")
def transitive_exposure(t: Tables) -> DataFrame:
    rows = closure.transitive_exposure(graph.current_pins(t.ops), t.view("package_edges"), cves(t))
    return rows.select("service_id", "ecosystem", "package", "version", "cve_id", "is_transitive", "transitive_path")
