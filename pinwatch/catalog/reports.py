"""Posture figures, lookups, text and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pinwatch.catalog.exposure import cves
from pinwatch.catalog.registry import query
from pinwatch.catalog.views import AS_OF, Tables
from pinwatch.operators import lookups, posture, posture_state, search
from pinwatch.session import scratch_path, stored_table
from pinwatch.sinks.layout import append_clustered, merge_files, only, read_clustered
from pinwatch.sinks.tables import append_table
from pinwatch.sources.tables import read_table

_AT = f"TIMESTAMP '{AS_OF}'"
_OPEN_BY_TIER = ", ".join(
    f"count(*) FILTER (blast_radius = '{tier}') AS open_{tier.lower()}" for tier in ("CRITICAL", "HIGH", "MEDIUM", "LOW")
)
_DIFF_MINUTES = "(epoch_us(detected_at) - epoch_us(published_at)) / 1e6 / 60.0"
_DIFF_DAYS = "(epoch_us(resolved_at) - epoch_us(detected_at)) / 1e6 / 86400.0"


@query("posture_open_counts", f"SELECT {_OPEN_BY_TIER} FROM open_matches")
def posture_open_counts(t: Tables) -> DataFrame:
    return posture.open_counts(t.matches, AS_OF)


@query("posture_breakdown", """WITH m AS (SELECT v.*, meta.team FROM vulnerability_matches v JOIN meta ON v.service_id = meta.service_id)
 SELECT 'tier' AS dimension, blast_radius AS value, count(*) AS findings FROM m GROUP BY 2
 UNION ALL SELECT 'service', service_id, count(*) FROM m GROUP BY 2 UNION ALL SELECT 'team', team, count(*) FROM m GROUP BY 2
 UNION ALL SELECT 'status', status, count(*) FROM m GROUP BY 2""")
def posture_breakdown(t: Tables) -> DataFrame:
    return posture.breakdown(t.matches, t.registry)


@query("posture_past_sla", f"SELECT count(*) AS past_sla_count FROM open_matches WHERE sla_deadline < {_AT}")
def posture_past_sla(t: Tables) -> DataFrame:
    return posture.past_sla(t.matches, AS_OF)


@query("mttd_minutes", f"SELECT round(avg({_DIFF_MINUTES}), 2) AS mttd_minutes FROM vulnerability_matches")
def mttd_minutes(t: Tables) -> DataFrame:
    return posture.mttd_minutes(t.matches)


@query("mttr_days", f"SELECT round(avg({_DIFF_DAYS}), 2) AS mttr_days FROM vulnerability_matches WHERE resolved_at <= {_AT}")
def mttr_days(t: Tables) -> DataFrame:
    return posture.mttr_days(t.matches, AS_OF)


def _window(days: str, prefix: str = "") -> str:
    return (
        f"count(*) FILTER (detected_at > {_AT} - INTERVAL 1 DAY * {days} AND detected_at <= {_AT}) AS {prefix}current_n, "
        f"count(*) FILTER (detected_at > {_AT} - INTERVAL 1 DAY * 2 * {days} AND detected_at <= {_AT} - INTERVAL 1 DAY * {days}) "
        f"AS {prefix}previous_n"
    )


_DIRECTION = "CASE WHEN current_n > previous_n THEN 'worsening' WHEN current_n < previous_n THEN 'improving' ELSE 'stable' END"


@query("posture_trend", f"""SELECT days, current_n, previous_n, {_DIRECTION} AS direction FROM (SELECT days, {_window('days')}
 FROM vulnerability_matches, (VALUES (7), (30), (90)) d(days) GROUP BY days) x""")
def posture_trend(t: Tables) -> DataFrame:
    return posture.trend(t.matches, AS_OF)


@query("team_exposure_agg", f"""SELECT meta.team, {_OPEN_BY_TIER.replace('(blast_radius', '(o.blast_radius')} FROM
 (SELECT DISTINCT team FROM meta) meta LEFT JOIN (SELECT o.*, m.team FROM open_matches o JOIN meta m ON o.service_id = m.service_id) o
 ON o.team = meta.team GROUP BY 1""")
def team_exposure_agg(t: Tables) -> DataFrame:
    return posture.team_exposure(t.matches, t.registry, AS_OF)


@query("blast_radius_heatmap", f"""SELECT s.service_id, {_OPEN_BY_TIER} FROM (SELECT DISTINCT service_id FROM vulnerability_matches) s
 LEFT JOIN open_matches o ON s.service_id = o.service_id GROUP BY 1""")
def blast_radius_heatmap(t: Tables) -> DataFrame:
    return posture.blast_radius_heatmap(t.matches, AS_OF)


@query("sla_compliance_by_team", f"""SELECT team, count(*) AS resolved, count(*) FILTER (resolved_at <= sla_deadline) AS in_time,
 round(count(*) FILTER (resolved_at <= sla_deadline) / count(*), 4) AS compliance FROM vulnerability_matches m
 JOIN meta ON m.service_id = meta.service_id WHERE resolved_at <= {_AT} GROUP BY 1""")
def sla_compliance_by_team(t: Tables) -> DataFrame:
    return posture.sla_compliance_by_team(t.matches, t.registry, AS_OF)


@query("cve_match_rate", """SELECT strftime(seen, '%Y-%m') AS period, count(*) AS cves, count(*) FILTER (hit) AS matched,
 round(count(*) FILTER (hit) / count(*), 4) AS match_rate FROM (SELECT cve_id, min(ingested_at) AS seen,
 cve_id IN (SELECT cve_id FROM vulnerability_matches) AS hit FROM vuln_events GROUP BY cve_id) x GROUP BY 1""")
def cve_match_rate(t: Tables) -> DataFrame:
    return posture.cve_match_rate(t.vulns, t.matches)


@query("detections_by_ecosystem", """SELECT ecosystem, CAST(seen AS DATE) AS day, count(*) AS new_cves FROM (SELECT ecosystem, cve_id,
 min(ingested_at) AS seen FROM vuln_events WHERE source = 'osv' GROUP BY 1, 2) x GROUP BY 1, 2""")
def detections_by_ecosystem(t: Tables) -> DataFrame:
    return posture.detections_by_ecosystem(t.vulns.filter("source = 'osv'"))


@query("confidence_histogram", """SELECT CAST(least(floor(confidence_score * 10) + 1, 10) AS BIGINT) AS bucket, count(*) AS reports
 FROM triage_reports GROUP BY 1""")
def confidence_histogram(t: Tables) -> DataFrame:
    return posture.confidence_histogram(t.view("triage_reports"))


@query("mttd_rolling_30d", f"""WITH d AS (SELECT CAST(detected_at AS DATE) AS day, sum({_DIFF_MINUTES}) AS m, count(*) AS n
 FROM vulnerability_matches GROUP BY 1) SELECT day, round(sum(m) OVER w / sum(n) OVER w, 4) AS mttd_minutes FROM d
 WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)""")
def mttd_rolling_30d(t: Tables) -> DataFrame:
    return posture.mttd_rolling(t.matches)


@query("open_over_time", """WITH c AS (SELECT blast_radius, CAST(detected_at AS DATE) AS day, 1 AS delta FROM vulnerability_matches
 WHERE status <> 'accepted_risk' UNION ALL SELECT blast_radius, CAST(resolved_at AS DATE), -1 FROM vulnerability_matches
 WHERE status <> 'accepted_risk' AND resolved_at IS NOT NULL), d AS (SELECT blast_radius, day, sum(delta) AS delta FROM c GROUP BY 1, 2)
 SELECT blast_radius, day, CAST(sum(delta) OVER (PARTITION BY blast_radius ORDER BY day) AS BIGINT) AS open_findings FROM d""")
def open_over_time(t: Tables) -> DataFrame:
    return posture.open_over_time(t.matches)


_REPORT = f"""SELECT 30 AS period_days, (SELECT count(*) FROM open_matches WHERE blast_radius = 'CRITICAL') AS open_critical,
 (SELECT count(*) FROM open_matches WHERE blast_radius = 'HIGH') AS open_high,
 (SELECT count(*) FROM open_matches WHERE blast_radius = 'MEDIUM') AS open_medium,
 (SELECT count(*) FROM open_matches WHERE blast_radius = 'LOW') AS open_low,
 (SELECT count(*) FROM open_matches WHERE sla_deadline < {_AT}) AS past_sla_count,
 (SELECT round(avg({_DIFF_MINUTES}), 2) FROM vulnerability_matches) AS mttd_minutes,
 (SELECT round(avg({_DIFF_DAYS}), 2) FROM vulnerability_matches WHERE resolved_at <= {_AT}) AS mttr_days,
 (SELECT {_DIRECTION} FROM (SELECT {_window('30')} FROM vulnerability_matches) x) AS trend_direction"""


_TOTALS = """, (SELECT string_agg(team || '=' || n, ',' ORDER BY team) FROM (SELECT meta.team, CAST(count(*) AS VARCHAR) AS n FROM open_matches o
 JOIN meta ON o.service_id = meta.service_id GROUP BY 1) x) AS team_exposure,
 (SELECT 'hipaa=' || count(*) FILTER (hipaa_scope) || ',pci_dss=' || count(*) FILTER (pci_scope) || ',soc2=' || count(*) FILTER (soc2_scope)
 FROM open_matches o JOIN meta ON o.service_id = meta.service_id) AS compliance_gaps"""


def _maps_as_text(rows: DataFrame) -> DataFrame:
    entry = lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    text = lambda c: F.array_join(F.sort_array(F.transform(F.map_entries(c), entry)), ",")
    return rows.withColumns({c: text(c) for c in ("team_exposure", "compliance_gaps")})


@query("posture_report", _REPORT + _TOTALS)
def posture_report(t: Tables) -> DataFrame:
    return _maps_as_text(posture.report(t.matches, AS_OF, registry=t.registry)).drop("report_id", "generated_at")


@query("posture_report_maintained", _REPORT + _TOTALS)
def posture_report_maintained(t: Tables) -> DataFrame:
    """The same from a stored state that findings, then the later ones, then late resolutions came into."""
    known = t.matches.withColumn("resolved_at", F.lit(None).cast("timestamp"))
    middle = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(days=F.lit(90))
    early, late = known.filter(F.col("detected_at") < middle), known.filter(~F.coalesce(F.col("detected_at") < middle, F.lit(False)))
    resolved = t.matches.filter("resolved_at IS NOT NULL")
    unresolved = resolved.withColumn("resolved_at", F.lit(None).cast("timestamp"))
    state = t.spark.createDataFrame([], posture_state.STATE)
    for changes in (posture_state.deltas(early), posture_state.deltas(late), posture_state.change_deltas(unresolved, resolved)):
        state = stored_table(posture_state.advanced(state, changes, AS_OF[:10]), "posture-state")
    return _maps_as_text(posture_state.report(state, AS_OF, registry=t.registry)).drop("report_id", "generated_at")


@query("get_security_posture_summary", _REPORT + _TOTALS)
def get_security_posture_summary(t: Tables) -> DataFrame:
    """The newest of the stored reports."""
    path = scratch_path(t.spark, "posture_reports")
    for at in ("2000-01-01 00:00:00", AS_OF):
        append_table(posture.report(t.matches, at, registry=t.registry), "posture_reports", path)
    newest = posture.latest_report(read_table(t.spark, "posture_reports", path))
    shown = _maps_as_text(newest).drop("report_id", "generated_at", "executive_summary")
    numbers = {c: F.col(c).cast("double") for c in ("mttd_minutes", "mttr_days")}
    counts = {c: F.col(c).cast("bigint") for c in shown.columns if c.startswith("open_") or c == "past_sla_count"}
    return shown.withColumns(numbers | counts)


# --- lookups ----------------------------------------------------------------------------------------


@query("get_vulnerability_exposure", """SELECT match_id, cve_id, service_id, blast_radius, status, sla_deadline, assigned_to,
 match_id IN (SELECT match_id FROM triage_reports) AS triaged FROM open_matches""")
def get_vulnerability_exposure(t: Tables) -> DataFrame:
    return lookups.vulnerability_exposure(t.matches, t.view("triage_reports"), AS_OF)


_FIRST_SERVICE = "(SELECT min(service_id) FROM vulnerability_matches)"
_FIRST_CVE = "(SELECT min(cve_id) FROM vulnerability_matches)"


@query("lookup_by_service", f"""SELECT match_id, cve_id, service_id, blast_radius, status, sla_deadline, assigned_to,
 match_id IN (SELECT match_id FROM triage_reports) AS triaged FROM open_matches WHERE service_id = {_FIRST_SERVICE}""")
def lookup_by_service(t: Tables) -> DataFrame:
    """One service, from tables laid out by service and by finding."""
    path = scratch_path(t.spark, "lookup")
    append_clustered(t.matches, "vulnerability_matches", f"{path}/matches")
    append_clustered(t.view("triage_reports"), "triage_reports", f"{path}/reports")
    matches = read_clustered(t.spark, "vulnerability_matches", f"{path}/matches")
    service = t.matches.agg(F.min("service_id")).first()[0]
    return lookups.vulnerability_exposure(matches, read_clustered(t.spark, "triage_reports", f"{path}/reports"), AS_OF, service)


@query("lookup_by_vulnerability", f"""SELECT cve_id, match_id, service_id, blast_radius, status FROM vulnerability_matches WHERE cve_id = {_FIRST_CVE}""")
def lookup_by_vulnerability(t: Tables) -> DataFrame:
    """One vulnerability, from the same table laid out by vulnerability, its files merged."""
    path, merged = scratch_path(t.spark, "lookup"), scratch_path(t.spark, "lookup-merged")
    for part in range(3):
        append_clustered(t.matches.filter(F.pmod(F.xxhash64("match_id"), F.lit(3)) == part), "vulnerability_matches", path)
    merge_files(t.spark, "vulnerability_matches", path, merged)
    cve = t.matches.agg(F.min("cve_id")).first()[0]
    rows = only(read_clustered(t.spark, "vulnerability_matches", merged, "cve_id"), "cve_id", cve)
    return rows.select("cve_id", "match_id", "service_id", "blast_radius", "status")


@query("get_cve_details", """SELECT c.cve_id, m.match_id, m.service_id, c.cvss_score, c.severity_tier, m.blast_radius, r.exploitability,
 r.confidence_score FROM cves c JOIN vulnerability_matches m ON c.cve_id = m.cve_id LEFT JOIN triage_reports r ON m.match_id = r.match_id""")
def get_cve_details(t: Tables) -> DataFrame:
    return lookups.cve_details(cves(t), t.matches, t.view("triage_reports"))


@query("get_affected_services", f"""SELECT cve_id, service_id, blast_radius, blast_radius_score, sla_deadline,
 CASE WHEN sla_deadline < {_AT} THEN 'breached' ELSE 'within' END AS sla_state FROM open_matches""")
def get_affected_services(t: Tables) -> DataFrame:
    return lookups.affected_services(t.matches, AS_OF)


_QUEUE = """SELECT meta.team, o.match_id, o.cve_id, o.service_id, o.blast_radius, o.sla_deadline FROM open_matches o
 JOIN meta ON o.service_id = meta.service_id"""


@query("team_sla_queue", f"{_QUEUE} ORDER BY sla_deadline, match_id")
def team_sla_queue(t: Tables) -> DataFrame:
    return lookups.team_sla_queue(t.matches, t.registry, AS_OF)


@query("get_team_exposure", f"{_QUEUE} WHERE meta.team = 'machinery' ORDER BY sla_deadline, match_id")
def get_team_exposure(t: Tables) -> DataFrame:
    return lookups.team_sla_queue(t.matches, t.registry, AS_OF, team="machinery")


@query("top_critical_open", """SELECT match_id, cve_id, service_id, sla_deadline FROM open_matches WHERE blast_radius = 'CRITICAL'
 ORDER BY sla_deadline, match_id LIMIT 5""")
def top_critical_open(t: Tables) -> DataFrame:
    return lookups.top_critical_open(t.matches, AS_OF)


@query("get_compliance_gaps", """SELECT o.match_id, o.cve_id, o.service_id, o.blast_radius, f.framework, f.control FROM open_matches o
 JOIN meta ON o.service_id = meta.service_id JOIN (VALUES ('pci_dss', '6.3'), ('pci_dss', '12.3.2'), ('hipaa', '164.306'),
 ('hipaa', '164.312'), ('soc2', 'CC7.1'), ('soc2', 'CC7.2')) f(framework, control) ON (f.framework = 'pci_dss' AND pci_scope)
 OR (f.framework = 'hipaa' AND hipaa_scope) OR (f.framework = 'soc2' AND soc2_scope)""")
def get_compliance_gaps(t: Tables) -> DataFrame:
    return lookups.compliance_gaps(t.matches, t.registry, AS_OF)


# --- text and vectors -------------------------------------------------------------------------------


@query("chunk_documents", """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS t FROM documents),
 s AS (SELECT doc_id, t, unnest(range(0, greatest(len(t) - 65, 0) + 1, 448)) AS start FROM w WHERE len(t) > 0)
 SELECT doc_id, CAST(start // 448 AS BIGINT) AS chunk_no, CAST(len(t[start + 1:start + 512]) AS BIGINT) AS tokens,
 array_to_string(t[start + 1:start + 512], ' ') AS chunk FROM s""")
def chunk_documents(t: Tables) -> DataFrame:
    return search.chunk_documents(t.base("documents"))


_SIMILARITY = """list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))"""
_MEANS = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
 p AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM e),
 a AS (SELECT label, pos, avg(x) AS x FROM p GROUP BY 1, 2), m AS (SELECT label, list(x ORDER BY pos) AS q FROM a GROUP BY 1)"""


@query("embedding_topk", f"""WITH {_MEANS} SELECT label, vec_id, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER
 (PARTITION BY label ORDER BY exact DESC, vec_id) AS rank, round(exact, 6) AS similarity FROM (SELECT e.label, vec_id, {_SIMILARITY} AS exact
 FROM e JOIN m ON e.label = m.label) s) r WHERE rank <= 5""")
def embedding_topk(t: Tables) -> DataFrame:
    vectors = t.base("embeddings")
    return search.topk_per_collection(vectors, search.mean_vector(vectors))


_QUERY_VECTOR = [(i % 7 - 3) / 4.0 for i in range(64)]


@query("search_vulnerabilities", f"""SELECT vec_id, round(exact, 6) AS similarity FROM (SELECT vec_id, {_SIMILARITY} AS exact FROM (SELECT vec_id,
 list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, {_QUERY_VECTOR}::DOUBLE[] AS q FROM embeddings) x) y
 ORDER BY exact DESC, vec_id LIMIT 5""")
def search_vulnerabilities(t: Tables) -> DataFrame:
    return search.search(t.base("embeddings"), _QUERY_VECTOR)


@query("search_indexed_exhaustive", f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
 q AS (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id % 20 = 0)
 SELECT query_id, vec_id, round(exact, 6) AS similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER
 (PARTITION BY query_id ORDER BY exact DESC, vec_id) AS rank FROM (SELECT query_id, vec_id, {_SIMILARITY} AS exact FROM e, q) s) r WHERE rank <= 5""")
def search_indexed_exhaustive(t: Tables) -> DataFrame:
    """Every twentieth vector against all through the index, with all lists probed: the exact search."""
    from pinwatch.operators import vector_index  # needs numpy, which nothing else here does

    path, queries = _indexed(t)
    return vector_index.indexed_search(t.spark, path, queries, probes=vector_index.MOST_LISTS)


@query("search_index_recall", "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 20 = 0")
def search_index_recall(t: Tables) -> DataFrame:
    """Whether the fewest probes that a sample of the queries asks for find nine tenths of the exact results, over all
    queries and vectors."""
    from pinwatch.operators import vector_index

    path, queries = _indexed(t)
    probes = vector_index.tuned_probes(t.spark, path, queries, target=0.92)
    exact = stored_table(vector_index.indexed_search(t.spark, path, queries, probes=vector_index.MOST_LISTS), "exact")
    reached = vector_index.recall(vector_index.indexed_search(t.spark, path, queries, probes=probes), exact) >= 0.9
    return queries.agg(F.count("*").alias("queries")).withColumn("reached", F.lit(reached))


def _indexed(t: Tables) -> tuple[str, DataFrame]:
    from pinwatch.operators import vector_index

    path, vectors = scratch_path(t.spark, "vector-index"), t.base("embeddings")
    vector_index.build_index(vectors, path)
    return path, vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
