"""Sources, scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from pinwatch import schemas
from pinwatch.catalog.registry import CHECKS, query
from pinwatch.catalog.views import AS_OF, Tables
from pinwatch.functions import scalars as S
from pinwatch.operators import cursors, vulnerabilities as V
from pinwatch.operators.scoring import nonempty, registry_enrich, route, score
from pinwatch.session import scratch_path
from pinwatch.sources import changes, feeds, tables, topics

EMPTY = "CAST(NULL AS STRING)"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# --- stored files derived from the tables -----------------------------------------------------------


def nvd_bodies(t: Tables) -> str:
    """Score-feed responses, one body per line, twenty items in each."""
    path = scratch_path(t.spark, "nvd")
    item = F.expr("""struct(struct('CVE-2024-' || (10000 + p_partkey) AS id,
        date_format(timestamp'1995-01-01' + make_dt_interval(cast(p_partkey % 2400 as int)), "yyyy-MM-dd'T'HH:mm:ss.SSS") AS published,
        array(struct('de' AS lang, 'Teil' AS value), struct('en' AS lang, p_name AS value)) AS descriptions,
        struct(if(p_type = 'LARGE', null, array(struct(struct(p_size / 5.0D AS baseScore) AS cvssData))) AS cvssMetricV31) AS metrics,
        if(p_type = 'SMALL', null, array(struct(array(struct('CWE-' || p_size AS value)) AS description))) AS weaknesses) AS cve)""")
    bodies = t.base("part").groupBy(F.floor(F.col("p_partkey") / 20).alias("page")).agg(
        F.count("*").alias("totalResults"), F.collect_list(item).alias("vulnerabilities")
    )
    bodies.select(F.to_json(F.struct("totalResults", "vulnerabilities"))).write.text(path)
    return path


def osv_files(t: Tables) -> str:
    """Advisories as JSON lines, one directory per ecosystem, with unreadable entries among them."""
    path = scratch_path(t.spark, "osv")
    record = F.expr("""struct('GHSA-' || p_partkey AS id,
        date_format(timestamp'2001-01-01' + make_dt_interval(0, cast(p_partkey % 900 as int)), "yyyy-MM-dd'T'HH:mm:ss'Z'") AS modified,
        '1999-05-05T00:00:00Z' AS published,
        if(p_type = 'PROMO', array('X-1'), array('X-1', 'CVE-2024-' || (10000 + p_partkey), 'CVE-0')) AS aliases,
        if(p_type = 'SMALL', '', p_name) AS summary, p_brand AS details,
        array(struct(struct('Pkg-' || p_partkey AS name, eco AS ecosystem) AS package,
                array(struct('GIT' AS type, array(struct('0' AS introduced, '9.9' AS fixed)) AS events),
                      struct('ECOSYSTEM' AS type, array(struct('0' AS introduced, cast(null as string) AS fixed),
                        struct(cast(null as string) AS introduced, '1.' || (p_partkey % 8) || '.0' AS fixed)) AS events)) AS ranges,
                array('1.0.0') AS versions),
              struct(struct('' AS name, eco AS ecosystem) AS package, null AS ranges, null AS versions),
              struct(struct('Alt-' || p_partkey AS name, 'NuGet' AS ecosystem) AS package, null AS ranges,
                array('2.0') AS versions)) AS affected)""")
    eco = "element_at(array('PyPI','npm','Maven','Go','crates.io','RubyGems'), cast(p_partkey % 6 + 1 as int))"
    lines = t.base("part").withColumn("eco", F.expr(eco)).select(
        "eco",
        F.when(F.col("p_brand") == "Brand#3", F.lit("{broken")).otherwise(F.to_json(record)).alias("value"),
    )
    lines.write.partitionBy("eco").text(path)
    return path


def archive_files(t: Tables) -> str:
    """Gzip lines below one directory per archive hour (two hours a day here)."""
    path = scratch_path(t.spark, "archive")
    lines = t.view("archive_lines").select(
        F.col("line").alias("value"),
        F.concat(F.date_format("ts", "yyyy-MM-dd-"), (F.floor(F.hour("ts") / 12) * 12).cast("string"), F.lit(".json"))
        .alias("stamp"),
    )
    lines.repartition("stamp").write.partitionBy("stamp").option("compression", "gzip").text(path)
    return path


def index_files(t: Tables) -> str:
    path = scratch_path(t.spark, "index")
    t.view("titles").select(F.concat_ws(",", "stamp", F.concat(F.lit("ID-"), F.col("event_id")))).write.text(path)
    return path


def pull_request_files(t: Tables) -> str:
    """One JSON array of closed requests per line, a directory per repository."""
    path = scratch_path(t.spark, "pulls")
    request = F.expr("""struct(cast(event_id as int) AS number, title,
        if(user_id % 5 = 0, null, stamp) AS merged_at, struct(if(user_id % 3 = 0, 'alice', 'Dependabot[bot]') AS login) AS user,
        struct(ref) AS head)""")
    arrays = t.view("titles").groupBy((F.col("user_id") % 20).alias("r"), F.floor(F.col("event_id") / 50)).agg(
        F.to_json(F.collect_list(request)).alias("value")
    )
    arrays.select(F.concat(F.lit("org-"), F.col("r").cast("string")).alias("repo"), "value").write.partitionBy("repo").text(path)
    return path


# --- sources ----------------------------------------------------------------------------------------

_NVD_SQL = """SELECT 'CVE-2024-' || CAST(10000 + p_partkey AS VARCHAR) AS cve_id,
 TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * CAST(p_partkey % 2400 AS INT) AS published_at,
 CASE WHEN p_type = 'LARGE' THEN 0.0 ELSE p_size / 5.0 END AS cvss_score,
 CASE WHEN p_type = 'SMALL' THEN NULL ELSE 'CWE-' || CAST(p_size AS VARCHAR) END AS cwe_id, p_name AS description"""


@query("src_nvd_json", f"SELECT cve_id, cwe_id, description FROM ({_NVD_SQL} FROM part) x")
def src_nvd_json(t: Tables) -> DataFrame:
    items = feeds.read_nvd(t.spark, nvd_bodies(t), multi_line=False)
    return items.select(
        F.col("id").alias("cve_id"),
        F.expr("weaknesses[0].description[0].value").alias("cwe_id"),
        F.expr("descriptions[1].value").alias("description"),
    )


@query("nvd_normalise", f"""SELECT cve_id, published_at, CAST(cvss_score AS DOUBLE) AS cvss_score, cwe_id, description,
 CASE WHEN cvss_score >= 9 THEN 'CRITICAL' WHEN cvss_score >= 7 THEN 'HIGH' WHEN cvss_score >= 4 THEN 'MEDIUM' ELSE 'LOW' END
 AS severity_tier, 0 AS listed FROM ({_NVD_SQL} FROM part) x""")
def nvd_normalise(t: Tables) -> DataFrame:
    rows = V.nvd_normalise(feeds.read_nvd(t.spark, nvd_bodies(t), multi_line=False), as_of())
    return rows.select("cve_id", "published_at", "cvss_score", "cwe_id", "description", "severity_tier",
                       F.size("affected_versions").alias("listed"))


_OSV_SQL = """SELECT *, CASE p_partkey % 6 WHEN 0 THEN 'PyPI' WHEN 1 THEN 'npm' WHEN 2 THEN 'Maven' WHEN 3 THEN 'Go'
 WHEN 4 THEN 'crates.io' ELSE 'RubyGems' END AS eco, CASE p_partkey % 6 WHEN 0 THEN 'pypi' WHEN 1 THEN 'npm' WHEN 2 THEN 'maven'
 WHEN 3 THEN 'go' WHEN 4 THEN 'cargo' ELSE 'rubygems' END AS canonical,
 TIMESTAMP '2001-01-01' + INTERVAL 1 HOUR * CAST(p_partkey % 900 AS INT) AS modified_at
 FROM part WHERE p_brand <> 'Brand#3'"""


@query("src_osv_corpus", f"""SELECT 'GHSA-' || CAST(p_partkey AS VARCHAR) AS id, eco AS feed_ecosystem, modified_at,
 CAST(3 AS BIGINT) AS packages FROM ({_OSV_SQL}) x""")
def src_osv_corpus(t: Tables) -> DataFrame:
    records = feeds.readable(feeds.read_osv(t.spark, osv_files(t)))
    return records.select("id", "feed_ecosystem", "modified_at", F.size("affected").cast("bigint").alias("packages"))


@query("osv_normalise", f"""SELECT CASE WHEN p_type = 'PROMO' THEN 'GHSA-' || CAST(p_partkey AS VARCHAR)
 ELSE 'CVE-2024-' || CAST(10000 + p_partkey AS VARCHAR) END AS cve_id,
 CASE WHEN p_type = 'SMALL' THEN p_brand ELSE p_name END AS description,
 CASE WHEN k = 0 THEN 'Pkg-' ELSE 'Alt-' END || CAST(p_partkey AS VARCHAR) AS affected_package,
 CASE WHEN k = 0 THEN canonical ELSE 'nuget' END AS ecosystem,
 CASE WHEN k = 0 THEN '< 1.' || CAST(p_partkey % 8 AS VARCHAR) || '.0' ELSE '' END AS affected_version_range,
 CASE WHEN k = 0 THEN '1.0.0' ELSE '2.0' END AS listed, 'MEDIUM' AS severity_tier
 FROM ({_OSV_SQL}) x, (VALUES (0), (1)) v(k)""")
def osv_normalise(t: Tables) -> DataFrame:
    rows = V.osv_normalise(feeds.readable(feeds.read_osv(t.spark, osv_files(t))), as_of())
    return rows.select("cve_id", "description", "affected_package", "ecosystem", "affected_version_range",
                       F.array_join("affected_versions", ",").alias("listed"), "severity_tier")


@query("osv_safe_version", f"""SELECT 'Pkg-' || CAST(p_partkey AS VARCHAR) AS affected_package,
 '1.' || CAST(p_partkey % 8 AS VARCHAR) || '.0' AS safe_version FROM ({_OSV_SQL}) x
 UNION ALL SELECT 'Alt-' || CAST(p_partkey AS VARCHAR), NULL FROM ({_OSV_SQL}) x""")
def osv_safe_version(t: Tables) -> DataFrame:
    affected = feeds.readable(feeds.read_osv(t.spark, osv_files(t))).select(F.explode("affected").alias("a"))
    return affected.filter("a.package.name <> ''").select(
        F.col("a.package.name").alias("affected_package"), V.osv_safe_version(F.col("a.ranges")).alias("safe_version")
    )


_INDEX_SQL = """SELECT 'ID-' || CAST(event_id AS VARCHAR) AS id, date_trunc('second', ts) AS modified_at FROM events WHERE event_id % 4 = 0"""


@query("src_osv_modified_index", _INDEX_SQL)
def src_osv_modified_index(t: Tables) -> DataFrame:
    return feeds.read_osv_index(t.spark, index_files(t))


@query("modified_since", f"SELECT * FROM ({_INDEX_SQL}) x WHERE modified_at > TIMESTAMP '2024-01-15 00:00:00'")
def modified_since(t: Tables) -> DataFrame:
    index = feeds.read_osv_index(t.spark, index_files(t))
    return cursors.modified_since(index, F.lit("2024-01-15 00:00:00").cast("timestamp"))


@query("changed_ids_fetch", """SELECT p_partkey, p_name FROM part WHERE p_partkey IN
 (SELECT 10000 + p_partkey - 10000 FROM part WHERE p_size > 25)""")
def changed_ids_fetch(t: Tables) -> DataFrame:
    part = t.base("part")
    corpus = part.withColumn("id", F.concat(F.lit("GHSA-"), F.col("p_partkey")))
    changed = part.filter("p_size > 25").select(F.concat(F.lit("GHSA-"), F.col("p_partkey")).alias("id"))
    return cursors.changed_ids_fetch(corpus, changed).select("p_partkey", "p_name")


_ARCHIVE_DAY = "CAST(ts AS DATE) AS archive_day, CAST(floor(hour(ts) / 12) * 12 AS INT) AS archive_hour"


@query("src_archive_ndjson", f"SELECT {_ARCHIVE_DAY}, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM archive_lines GROUP BY 1, 2")
def src_archive_ndjson(t: Tables) -> DataFrame:
    lines = changes.read_archive(t.spark, archive_files(t))
    return lines.groupBy("archive_day", "archive_hour").agg(
        F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars")
    )


@query("date_floor", "SELECT event_id, greatest(CAST(ts AS DATE) - 10, DATE '2024-01-01') AS start_day FROM events")
def date_floor(t: Tables) -> DataFrame:
    start = F.date_sub(F.to_date("ts"), 10)
    return t.base("events").select("event_id", changes.date_floor(start).alias("start_day"))


@query("replay_counts", f"""WITH hourly AS (SELECT {_ARCHIVE_DAY}, count(*) AS events FROM archive_lines GROUP BY 1, 2)
 SELECT archive_day, archive_hour, events, sum(events) OVER (PARTITION BY archive_day)::BIGINT AS day_events,
 sum(events) OVER (ORDER BY archive_day, archive_hour)::BIGINT AS total_events FROM hourly""")
def replay_counts(t: Tables) -> DataFrame:
    return cursors.replay_counts(changes.read_archive(t.spark, archive_files(t)))


_BUMP_FIELDS = """regexp_extract(title, '(?i)bump ([\\w\\-./]+) from ([\\d.]+) to ([\\d.]+)', 1) AS package,
 regexp_extract(title, '(?i)bump ([\\w\\-./]+) from ([\\d.]+) to ([\\d.]+)', 2) AS from_version,
 regexp_extract(title, '(?i)bump ([\\w\\-./]+) from ([\\d.]+) to ([\\d.]+)', 3) AS to_version"""
# Branch prefixes of the update bots, and the manifest file of each ecosystem.
_BRANCH = "CASE " + " ".join(
    f"WHEN starts_with(ref, '{prefix}') THEN '{eco}'"
    for prefix, eco in [
        ("dependabot/pip/", "pypi"), ("dependabot/npm_and_yarn/", "npm"), ("dependabot/go_modules/", "go"),
        ("dependabot/maven/", "maven"), ("dependabot/cargo/", "cargo"), ("dependabot/bundler/", "rubygems"),
        ("dependabot/uv/", "pypi"), ("renovate/pip/", "pypi"), ("renovate/npm/", "npm"), ("renovate/go/", "go"),
        ("renovate/maven/", "maven"), ("renovate/cargo/", "cargo"), ("renovate/rubygems/", "rubygems"),
    ]
) + " ELSE '' END"
_MANIFEST = """CASE ecosystem WHEN 'pypi' THEN 'requirements.txt' WHEN 'npm' THEN 'package.json' WHEN 'go' THEN 'go.mod'
 WHEN 'maven' THEN 'pom.xml' WHEN 'cargo' THEN 'Cargo.toml' WHEN 'rubygems' THEN 'Gemfile' ELSE 'unknown' END"""


@query("src_pr_list", """SELECT 'org-' || CAST(user_id % 20 AS VARCHAR) AS repo, CAST(event_id AS INT) AS number, title,
 stamp AS merged_at FROM titles WHERE user_id % 5 <> 0""")
def src_pr_list(t: Tables) -> DataFrame:
    return changes.read_pull_requests(t.spark, pull_request_files(t)).select("repo", "number", "title", "merged_at")


@query("pr_bump_events", f"""SELECT repo AS service_id, pr_number, author, ecosystem, {_MANIFEST} AS manifest_file, package, to_version,
 occurred_at FROM (SELECT 'org-' || CAST(user_id % 20 AS VARCHAR) AS repo, CAST(event_id AS INT) AS pr_number, 'Dependabot[bot]' AS author,
 {_BRANCH} AS ecosystem, {_BUMP_FIELDS},
 CASE WHEN event_id % 4 = 0 THEN date_trunc('second', ts) ELSE TIMESTAMP '{AS_OF}' END AS occurred_at
 FROM titles WHERE user_id % 5 <> 0 AND user_id % 3 <> 0) x WHERE ecosystem <> '' AND package <> ''""")
def pr_bump_events(t: Tables) -> DataFrame:
    events = changes.pr_bump_events(changes.read_pull_requests(t.spark, pull_request_files(t)), as_of())
    update = F.col("updated")[0]
    return events.select("service_id", "pr_number", "author", "ecosystem", "manifest_file",
                         update["package"].alias("package"), update["to_version"].alias("to_version"), "occurred_at")


_ARCHIVE_BUMPS = """SELECT 'org/repo-' || CAST(user_id AS VARCHAR) AS service_id, CAST(event_id AS INT) AS pr_number,
 CASE WHEN user_id % 3 = 0 THEN 'renovate[bot]' ELSE 'dependabot[bot]' END AS author,
 CASE event_id % 4 WHEN 0 THEN 'pypi' WHEN 1 THEN 'npm' ELSE 'rubygems' END AS ecosystem,
 'pkg-' || CAST(event_id % 97 AS VARCHAR) AS package, '1.0.' || CAST(event_id % 5 AS VARCHAR) AS from_version,
 '1.' || CAST(event_id % 8 AS VARCHAR) || '.0' AS to_version, TIMESTAMP '2024-02-15 11:45:22' AS occurred_at FROM events
 WHERE event_type IN ('click', 'view') AND event_id % 11 <> 0 AND event_id % 7 <> 0 AND event_id % 13 <> 0
 AND user_id % 3 <> 2 AND event_id % 4 <> 3"""


def _flat(events: DataFrame) -> DataFrame:
    update = F.col("updated")[0]
    return events.select("service_id", "pr_number", "author", "ecosystem", update["package"].alias("package"),
                         update["from_version"].alias("from_version"), update["to_version"].alias("to_version"), "occurred_at")


@query("archive_bump_events", _ARCHIVE_BUMPS)
def archive_bump_events(t: Tables) -> DataFrame:
    return _flat(changes.archive_bump_events(t.view("archive_lines")))


@query("union_dep_sources", f"""SELECT 'gh_archive' AS source, service_id, ecosystem, occurred_at FROM ({_ARCHIVE_BUMPS}) a
 UNION ALL SELECT 'manifest', service_id, ecosystem, occurred_at FROM (SELECT DISTINCT event_id, service_id, ecosystem, occurred_at FROM dep_ops) m""")
def union_dep_sources(t: Tables) -> DataFrame:
    archive = changes.archive_bump_events(t.view("archive_lines"))
    direct = t.dep_events.withColumn("source", F.lit("manifest"))
    return changes.union_dep_sources(archive, direct).select("source", "service_id", "ecosystem", "occurred_at")


@query("explode_changes", """SELECT event_id, service_id, ecosystem, package, coalesce(version, '') AS version, op, op_rank, occurred_at FROM dep_ops""")
def explode_changes(t: Tables) -> DataFrame:
    ops = changes.explode_changes(t.dep_events)
    return ops.select("event_id", "service_id", "ecosystem", "package", F.coalesce("version", F.lit("")).alias("version"),
                      "op", "op_rank", "occurred_at")


@query("src_registry", "SELECT service_id, team, ecosystem, is_customer_facing, pii_handler FROM service_registry")
def src_registry(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "registry")
    tables.conform(t.registry, schemas.SERVICE_REGISTRY).write.parquet(path)
    return tables.read_registry(t.spark, path).select("service_id", "team", "ecosystem", "is_customer_facing", "pii_handler")


# --- scalars ----------------------------------------------------------------------------------------


@query("eco_normalise", """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'pypi' WHEN 1 THEN 'npm' WHEN 2 THEN 'maven' WHEN 3 THEN 'go'
 WHEN 4 THEN 'cargo' WHEN 5 THEN 'rubygems' WHEN 6 THEN 'nuget' ELSE 'pub' END AS ecosystem FROM part""")
def eco_normalise(t: Tables) -> DataFrame:
    raw = F.expr("""element_at(array('PyPI','npm','Maven','Go','crates.io','RubyGems','NuGet','Pub'), cast(p_partkey % 8 + 1 as int))""")
    return t.base("part").select("p_partkey", S.canonical_ecosystem(raw).alias("ecosystem"))


_SEVERITY = "CASE WHEN {0} >= 9 THEN 'CRITICAL' WHEN {0} >= 7 THEN 'HIGH' WHEN {0} >= 4 THEN 'MEDIUM' ELSE 'LOW' END"


@query("severity_from_cvss", f"SELECT event_id, {_SEVERITY.format('cvss_score')} AS tier FROM vuln_events")
def severity_from_cvss(t: Tables) -> DataFrame:
    return t.vulns.select("event_id", S.severity_from_cvss(F.col("cvss_score")).alias("tier"))


@query("fill_severity", f"SELECT event_id, coalesce(severity_tier, {_SEVERITY.format('cvss_score')}) AS tier FROM vuln_events")
def fill_severity(t: Tables) -> DataFrame:
    none = F.lit(None).cast("double")
    return t.vulns.select("event_id", S.fill_severity(F.col("severity_tier"), F.col("cvss_score"), none).alias("tier"))


@query("fill_ingested_at", f"""SELECT event_id, CASE WHEN source = 'nvd' THEN TIMESTAMP '{AS_OF}' ELSE ingested_at END AS ingested_at
 FROM vuln_events""")
def fill_ingested_at(t: Tables) -> DataFrame:
    given = F.when(F.col("source") == "osv", F.col("ingested_at"))
    return t.vulns.select("event_id", S.fill_ingested_at(given, as_of()).alias("ingested_at"))


@query("ecosystem_from_branch", f"SELECT event_id, {_BRANCH} AS ecosystem FROM titles")
def ecosystem_from_branch(t: Tables) -> DataFrame:
    return t.view("titles").select("event_id", S.ecosystem_from_branch(F.col("ref")).alias("ecosystem"))


@query("manifest_for_ecosystem", f"""SELECT event_id, {_MANIFEST} AS manifest FROM
 (SELECT event_id, {_BRANCH} AS ecosystem FROM titles) x""")
def manifest_for_ecosystem(t: Tables) -> DataFrame:
    return t.view("titles").select(
        "event_id", S.manifest_for_ecosystem(S.ecosystem_from_branch(F.col("ref"))).alias("manifest")
    )


@query("parse_bump_title", f"SELECT event_id, {_BUMP_FIELDS} FROM titles")
def parse_bump_title(t: Tables) -> DataFrame:
    return t.view("titles").select("event_id", S.bump_title(F.col("title")).alias("b")).select("event_id", "b.*")


@query("parse_bump_title_ext", f"""SELECT event_id, CASE WHEN package <> '' THEN package ELSE
 regexp_extract(title, '(?i)update ([\\w\\-.]+) requirement from .* to .*?([\\d.]+)\\s*$', 1) END AS package,
 from_version, CASE WHEN to_version <> '' THEN to_version ELSE
 regexp_extract(title, '(?i)update ([\\w\\-.]+) requirement from .* to .*?([\\d.]+)\\s*$', 2) END AS to_version
 FROM (SELECT *, {_BUMP_FIELDS} FROM titles) x""")
def parse_bump_title_ext(t: Tables) -> DataFrame:
    return t.view("titles").select("event_id", S.bump_title_extended(F.col("title")).alias("b")).select("event_id", "b.*")


@query("dedup_key", """SELECT event_id, sha256(cve_id || ':' || affected_package || ':' || ecosystem || ':' || affected_version_range) AS key
 FROM vuln_events""")
def dedup_key(t: Tables) -> DataFrame:
    return t.vulns.select("event_id", S.dedup_key(*[F.col(c) for c in V.RECORD_KEY]).alias("key"))


_SCORE_ROWS = """SELECT m.match_id, m.detected_at, round(least(coalesce(n.cvss_score, 0), 10.0) / 10.0 * 0.4
 + CASE WHEN is_customer_facing THEN 0.25 ELSE 0 END + CASE WHEN pci_scope OR hipaa_scope OR soc2_scope THEN 0.2 ELSE 0 END
 + CASE WHEN pii_handler THEN 0.15 ELSE 0 END, 6) AS score FROM vulnerability_matches m
 JOIN meta ON m.service_id = meta.service_id LEFT JOIN nvd_last n ON m.cve_id = n.cve_id"""
_TIER = "CASE WHEN score >= 0.75 THEN 'CRITICAL' WHEN score >= 0.5 THEN 'HIGH' WHEN score >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END"


def _scored(t: Tables) -> DataFrame:
    newest = V.latest_record(t.vulns.filter("source = 'nvd' AND cvss_score > 0"), ["cve_id"]).select("cve_id", "cvss_score")
    return score(registry_enrich(t.matches.join(newest, "cve_id", "left"), t.registry))


@query("compute_score", f"SELECT match_id, score FROM ({_SCORE_ROWS}) x")
def compute_score(t: Tables) -> DataFrame:
    return _scored(t).select("match_id", "score")


@query("tier_from_score", f"SELECT match_id, {_TIER} AS tier FROM ({_SCORE_ROWS}) x")
def tier_from_score(t: Tables) -> DataFrame:
    return _scored(t).select("match_id", F.col("blast_radius_tier").alias("tier"))


@query("sla_deadline", f"""SELECT match_id, detected_at + INTERVAL 1 HOUR * CASE {_TIER} WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 24
 WHEN 'MEDIUM' THEN 168 ELSE 720 END AS sla_deadline FROM ({_SCORE_ROWS}) x""")
def sla_deadline(t: Tables) -> DataFrame:
    return _scored(t).select("match_id", "sla_deadline")


@query("nonempty_match", "SELECT match_id FROM vulnerability_matches WHERE status <> 'accepted_risk'")
def nonempty_match(t: Tables) -> DataFrame:
    # Accepted risks stand in for matches whose detection time, and so deadline, is missing.
    detected = F.when(F.col("status") != "accepted_risk", F.col("detected_at"))
    scored = score(registry_enrich(t.matches.withColumns({"cvss_score": F.lit(5.0), "detected_at": detected}), t.registry))
    return nonempty(scored).select("match_id")


@query("route_topic", """SELECT match_id, 'vuln.matches.' || CASE WHEN status = 'accepted_risk' THEN 'low' ELSE lower(blast_radius) END AS topic
 FROM vulnerability_matches""")
def route_topic(t: Tables) -> DataFrame:
    # Accepted risks carry a tier no topic exists for, which goes to the low topic.
    tier = F.when(F.col("status") == "accepted_risk", "NONE").otherwise(F.col("blast_radius"))
    return route(t.matches.withColumn("blast_radius_tier", tier)).select("match_id", "topic")


@query("parse_ts_lenient", """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN date_trunc('second', ts) END AS at FROM events""")
def parse_ts_lenient(t: Tables) -> DataFrame:
    at = S.lenient_timestamp(F.col("stamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return t.view("titles").select("event_id", at.alias("at"))


# --- JSON, validity ---------------------------------------------------------------------------------

_VALID = "p_partkey % 8 >= 4"


@query("filter_valid_vuln", f"""SELECT 'CVE-2024-' || CAST(10000 + p_partkey AS VARCHAR) AS cve_id, p_size / 5.0 AS cvss_score,
 CASE WHEN p_partkey % 8 = 5 THEN 'MEDIUM' ELSE {_SEVERITY.format('(p_size / 5.0)')} END AS severity_tier FROM part WHERE {_VALID}""")
def filter_valid_vuln(t: Tables) -> DataFrame:
    return topics.vulnerability_events(t.view("raw_records"), as_of()).select("cve_id", "cvss_score", "severity_tier")


@query("quarantine_bad", f"""SELECT value AS raw, CASE p_partkey % 8 WHEN 0 THEN 'not json' WHEN 3 THEN 'no cve id' WHEN 1 THEN 'no cve id'
 ELSE 'unknown source' END AS reason FROM raw_records WHERE NOT ({_VALID})""")
def quarantine_bad(t: Tables) -> DataFrame:
    return topics.quarantine(t.view("raw_records"))


@query("poll_summary", f"""SELECT s AS source, count(*) AS fetched, count(*) FILTER ({_VALID}) AS published,
 count(*) FILTER (NOT ({_VALID})) AS skipped FROM (SELECT *, p_brand AS s FROM part) x GROUP BY 1""")
def poll_summary(t: Tables) -> DataFrame:
    raw = t.view("raw_records").join(t.base("part").select("p_partkey", F.col("p_brand").alias("source")), "p_partkey")
    parsed = topics.parse_vulnerabilities(raw)
    return cursors.poll_summary(parsed, F.coalesce(topics.valid_vulnerability(), F.lit(False)))


@query("poll_summary_observed", "SELECT p_brand FROM part WHERE false")
def poll_summary_observed(t: Tables) -> DataFrame:
    """The same figures, observed while the records are written."""
    raw = t.view("raw_records").join(t.base("part").select("p_partkey", F.col("p_brand").alias("source")), "p_partkey")
    sources = [r.p_brand for r in t.base("part").select("p_brand").distinct().collect()]  # the feeds, known beforehand in use
    seen = Observation("poll")
    parsed = cursors.observed_poll(topics.parse_vulnerabilities(raw), topics.valid_vulnerability(), sources, seen)
    parsed.select("source", "raw").write.parquet(scratch_path(t.spark, "polled"))
    return t.spark.createDataFrame(cursors.observed_summary([seen.get], sources), "source string, fetched bigint, published bigint, skipped bigint")


CHECKS["poll_summary_observed"] = CHECKS["poll_summary"]


@query("json_parse", "SELECT event_id, cve_id, cvss_score, affected_version_range, ingested_at FROM vuln_events")
def json_parse(t: Tables) -> DataFrame:
    text = t.vulns.select(F.to_json(F.struct("event_id", "cve_id", "source", "cvss_score", "affected_version_range",
                                             "ingested_at")).alias("value"))
    return topics.vulnerability_events(text, as_of()).select(
        "event_id", "cve_id", "cvss_score", "affected_version_range", "ingested_at"
    )


@query("json_emit", """SELECT event_id, '{"event_id":"' || event_id || '","package":"' || affected_package || '","range":"'
 || affected_version_range || '"}' AS value FROM vuln_events""")
def json_emit(t: Tables) -> DataFrame:
    body = F.struct("event_id", F.col("affected_package").alias("package"), F.col("affected_version_range").alias("range"))
    return t.vulns.select("event_id", F.to_json(body).alias("value"))


# --- loads ------------------------------------------------------------------------------------------


@query("bulk_load_stats", f"""SELECT coalesce(canonical, '*') AS ecosystem, count(*) AS records, max(modified_at) AS max_modified
 FROM ({_OSV_SQL}) x GROUP BY ROLLUP (canonical)""")
def bulk_load_stats(t: Tables) -> DataFrame:
    records = feeds.readable(feeds.read_osv(t.spark, osv_files(t)))
    return cursors.bulk_load_stats(records.withColumn("ecosystem", S.canonical_ecosystem(F.col("feed_ecosystem"))))


@query("next_cursor", f"""SELECT e.ecosystem, coalesce(m.newest, TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS cursor
 FROM (SELECT DISTINCT ecosystem FROM service_registry UNION SELECT 'hex') e LEFT JOIN
 (SELECT canonical, max(modified_at) AS newest FROM ({_OSV_SQL}) x GROUP BY 1) m ON e.ecosystem = m.canonical""")
def next_cursor(t: Tables) -> DataFrame:
    records = feeds.readable(feeds.read_osv(t.spark, osv_files(t)))
    wanted = t.registry.select("ecosystem").unionByName(t.sql("SELECT 'hex' AS ecosystem"))
    return cursors.next_cursor(records.withColumn("ecosystem", S.canonical_ecosystem(F.col("feed_ecosystem"))), wanted, as_of())


@query("poll_start", f"""SELECT e.ecosystem AS feed, coalesce(m.newest, TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS cursor
 FROM (SELECT DISTINCT ecosystem FROM service_registry UNION SELECT 'hex') e LEFT JOIN
 (SELECT canonical, max(modified_at) AS newest FROM ({_OSV_SQL}) x GROUP BY 1) m ON e.ecosystem = m.canonical""")
def poll_start(t: Tables) -> DataFrame:
    records = feeds.readable(feeds.read_osv(t.spark, osv_files(t)))
    cursors_ = records.select(S.canonical_ecosystem(F.col("feed_ecosystem")).alias("feed"), F.col("modified_at").alias("cursor"))
    wanted = t.registry.select(F.col("ecosystem").alias("feed")).unionByName(t.sql("SELECT 'hex' AS feed"))
    return cursors.poll_start(cursors_, wanted, as_of())
