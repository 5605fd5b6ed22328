"""Domain-shaped views over the given tables. The same SQL runs on Spark and on DuckDB.

Every view covers its tables whole. What varies between rows (ecosystem, layout, validity) is
computed from the row; nothing is left out to make a check cheaper.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from pinwatch.session import prepare, stored_table

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

AS_OF = "2001-08-02 00:00:00"


def _ecosystem(number: str) -> str:
    return (
        f"CASE ({number}) % 6 WHEN 0 THEN 'pypi' WHEN 1 THEN 'npm' WHEN 2 THEN 'maven' WHEN 3 THEN 'go' "
        f"WHEN 4 THEN 'cargo' ELSE 'rubygems' END"
    )


def _whole(expression: str) -> str:
    return f"CAST(floor({expression}) AS BIGINT)"


# Twenty vulnerabilities per package and about a hundred and twenty services per package at every
# scale, so that results grow with the tables; package 0 is the one that a share of all services use.
_VULN_PACKAGE = _whole("p_partkey / 20")
_OP_PACKAGE = f"CASE WHEN l_partkey % 8 = 0 THEN 0 ELSE {_whole('o_custkey / 15')} + l_partkey % 8 END"
_SERVICE = "CASE WHEN o_orderpriority = '5-LOW' THEN 'job-' ELSE 'svc-' END || CAST(o_custkey AS STRING)"
_HOURS = "CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 24 WHEN '3-MEDIUM' THEN 168 ELSE 720 END"


def _advisory(repeat: int, where: str = "") -> str:
    return f"""SELECT 'osv-' || CAST(p_partkey AS STRING) || '-{repeat}' AS event_id,
 'CVE-2024-' || CAST(10000 + p_partkey AS STRING) AS cve_id, 'osv' AS source,
 CAST('1995-01-01' AS TIMESTAMP) + INTERVAL '1' DAY * CAST(p_partkey % 2400 AS INT)
   + INTERVAL '1' HOUR * CAST({repeat} * (6 + 14 * (p_partkey % 2)) AS INT) AS ingested_at,
 0.0E0 AS cvss_score, 'MEDIUM' AS severity_tier, CAST(NULL AS STRING) AS cwe_id,
 'Pkg-' || CAST({_VULN_PACKAGE} AS STRING) AS affected_package,
 CASE WHEN p_brand = 'Brand#7' THEN '' ELSE {_ecosystem(_VULN_PACKAGE)} END AS ecosystem,
 CASE WHEN p_type = 'PROMO' THEN '' WHEN p_partkey % 3 = 0
   THEN '>= 1.2, < 1.' || CAST(p_partkey % 8 + 3 AS STRING) || '.0' ELSE '< 1.' || CAST(p_partkey % 8 AS STRING) || '.0' END
   AS affected_version_range,
 CASE WHEN p_type = 'PROMO' THEN '' WHEN p_partkey % 3 = 0
   THEN '1.' || CAST(p_partkey % 8 + 3 AS STRING) || '.0' ELSE '1.' || CAST(p_partkey % 8 AS STRING) || '.0' END
   AS safe_version,
 CASE WHEN p_type IN ('PROMO', 'LARGE')
   THEN '1.' || CAST(p_partkey % 7 + 1 AS STRING) || '.' || CAST(p_size AS STRING) || ',1.1.' || CAST(p_size AS STRING)
   ELSE '' END AS affected_list
 FROM part {where}"""


VIEWS = {
    "service_registry": f"""SELECT 'svc-' || CAST(c_custkey AS STRING) AS service_id, lower(c_mktsegment) AS team,
 {_ecosystem('c_custkey')} AS ecosystem, 'org/svc-' || CAST(c_custkey AS STRING) AS repo,
 c_custkey % 3 = 0 AS is_customer_facing, c_custkey % 4 = 0 AS pci_scope, c_custkey % 10 = 0 AS hipaa_scope,
 c_custkey % 2 = 0 AS soc2_scope, c_custkey % 5 = 0 AS pii_handler, c_name AS description FROM customer""",
    # Small parts were re-published twice, 6 or 20 hours apart; one brand has no score record, and
    # another a later one without a score.
    "vuln_events": f"""{_advisory(0)}
 UNION ALL {_advisory(1, 'WHERE p_size <= 10')}
 UNION ALL {_advisory(2, 'WHERE p_size <= 10')}
 UNION ALL SELECT 'nvd-' || CAST(p_partkey AS STRING), 'CVE-2024-' || CAST(10000 + p_partkey AS STRING), 'nvd',
 CAST('1995-01-01' AS TIMESTAMP) + INTERVAL '1' DAY * CAST(p_partkey % 2400 AS INT) + INTERVAL '1' HOUR * 2,
 p_size / 5.0E0, CAST(NULL AS STRING),
 CASE p_type WHEN 'ECONOMY' THEN 'CWE-284' WHEN 'SMALL' THEN 'CWE-285' WHEN 'MEDIUM' THEN 'CWE-862' ELSE 'CWE-79' END,
 '', '', '', '', '' FROM part WHERE p_brand <> 'Brand#9'
 UNION ALL SELECT 'nvd0-' || CAST(p_partkey AS STRING), 'CVE-2024-' || CAST(10000 + p_partkey AS STRING), 'nvd',
 CAST('1995-01-01' AS TIMESTAMP) + INTERVAL '1' DAY * CAST(p_partkey % 2400 + 3 AS INT), 0.0E0, CAST(NULL AS STRING),
 CAST(NULL AS STRING), '', '', '', '', '' FROM part WHERE p_brand IN ('Brand#3', 'Brand#9')""",
    "dep_ops": f"""SELECT 'ev-' || CAST(o_orderkey AS STRING) AS event_id, {_SERVICE} AS service_id,
 {_ecosystem(_OP_PACKAGE)} AS ecosystem, 'pkg-' || CAST({_OP_PACKAGE} AS STRING) AS package,
 CASE WHEN l_returnflag = 'R' THEN NULL
   ELSE '1.' || CAST(l_linenumber AS STRING) || '.' || CAST(CAST(l_quantity AS INT) AS STRING) END AS version,
 CASE l_returnflag WHEN 'N' THEN 'added' WHEN 'R' THEN 'removed' ELSE 'updated' END AS op,
 CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 0 ELSE 2 END AS op_rank,
 l_linenumber * 1000 + CAST(l_quantity AS INT) AS pos,
 CAST(o_orderdate AS TIMESTAMP) AS occurred_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "vulnerability_matches": f"""SELECT 'm-' || CAST(o_orderkey AS STRING) AS match_id,
 'CVE-2024-' || CAST(10000 + {_whole('o_orderkey / 7')} AS STRING) AS cve_id, {_SERVICE} AS service_id,
 '1.' || CAST(o_orderkey % 7 AS STRING) || '.0' AS matched_version,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM'
   ELSE 'LOW' END AS blast_radius,
 CASE WHEN o_orderstatus = 'F' THEN 'resolved' WHEN o_orderstatus = 'O' THEN 'open'
   WHEN o_totalprice > 250000 THEN 'accepted_risk' ELSE 'in_progress' END AS status,
 CAST(o_orderdate AS TIMESTAMP) AS detected_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' HOUR * {_HOURS} AS sla_deadline,
 CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY * CAST(o_orderkey % 40 AS INT) END
   AS resolved_at,
 CAST(o_orderdate AS TIMESTAMP) - INTERVAL '1' MINUTE * CAST(o_orderkey % 600 AS INT) AS published_at,
 CASE WHEN o_orderstatus <> 'O' THEN 'eng-' || CAST(o_custkey % 50 AS STRING) END AS assigned_to,
 CAST(o_orderkey % 101 AS DOUBLE) / 100.0E0 AS blast_radius_score FROM orders""",
    "triage_reports": f"""SELECT 'r-' || CAST(o_orderkey AS STRING) AS report_id, 'm-' || CAST(o_orderkey AS STRING) AS match_id,
 CASE WHEN o_totalprice < 60000 THEN 'theoretical' WHEN o_totalprice < 150000 THEN 'likely' ELSE 'active' END AS exploitability,
 CAST({_whole('o_totalprice')} % 101 AS DOUBLE) / 100.0E0 AS confidence_score
 FROM orders WHERE o_orderstatus <> 'O'""",
    "archive_lines": """SELECT event_id, ts, '{"type":"' || CASE WHEN event_type IN ('click','view') THEN 'PullRequestEvent' ELSE 'PushEvent' END
 || '","actor":{"login":"' || CASE WHEN user_id % 3 = 0 THEN 'Renovate[bot]' WHEN user_id % 3 = 1 THEN 'dependabot[bot]' ELSE 'alice' END
 || '"},"repo":{"name":"org/repo-' || CAST(user_id AS STRING) || '"},"payload":{"action":"'
 || CASE WHEN event_id % 11 = 0 THEN 'opened' ELSE 'closed' END || '","pull_request":{"number":' || CAST(event_id AS STRING)
 || ',"title":"Bump pkg-' || CAST(event_id % 97 AS STRING) || ' from 1.0.' || CAST(event_id % 5 AS STRING) || ' to 1.'
 || CAST(event_id % 8 AS STRING) || '.0","merged":' || CASE WHEN event_id % 7 = 0 THEN 'false' ELSE 'true' END
 || ',"merged_at":"' || CASE WHEN event_id % 13 = 0 THEN '2023-12-31T23:59:59Z' ELSE '2024-02-15T11:45:22Z' END
 || '","head":{"ref":"' || CASE event_id % 4 WHEN 0 THEN 'dependabot/pip/x' WHEN 1 THEN 'renovate/npm/x'
 WHEN 2 THEN 'dependabot/bundler/x' ELSE 'feature/x' END || '"}}}}' AS line FROM events""",
    # Package p needs p/2 and p/3, in its own ecosystem: the depth grows with the logarithm of the table.
    "package_edges": f"""SELECT {_ecosystem('p_partkey')} AS ecosystem, 'pkg-' || CAST(p_partkey AS STRING) AS package,
 'pkg-' || CAST({_whole('p_partkey / 2')} AS STRING) AS depends_on,
 '1.' || CAST(p_partkey % 7 + 1 AS STRING) || '.' || CAST(p_size AS STRING) AS version FROM part
 UNION ALL SELECT {_ecosystem('p_partkey')}, 'pkg-' || CAST(p_partkey AS STRING), 'pkg-' || CAST({_whole('p_partkey / 3')} AS STRING),
 '1.2.' || CAST(p_size AS STRING) FROM part
 UNION ALL SELECT {_ecosystem('p_partkey + 1')}, 'pkg-' || CAST(p_partkey AS STRING), 'pkg-' || CAST({_whole('p_partkey / 2')} AS STRING),
 '1.3.' || CAST(p_size AS STRING) FROM part""",
    "titles": """SELECT event_id, CASE event_id % 7
 WHEN 0 THEN 'Bump requests from 2.28.' || CAST(event_id % 30 AS STRING) || ' to 2.31.0'
 WHEN 1 THEN 'chore(deps): bump lib.core/http from 1.' || CAST(event_id % 9 AS STRING) || ' to 1.10'
 WHEN 2 THEN 'build(deps): BUMP pkg-' || CAST(user_id AS STRING) || ' from 1.0 to 2.0.0rc1'
 WHEN 3 THEN 'Bump @scope/name from 1.0 to 2.0'
 WHEN 4 THEN 'Update django requirement from >=4.0 to >=4.' || CAST(event_id % 9 AS STRING)
 WHEN 5 THEN 'Fix ' || event_type ELSE 'chore(deps-dev): bump x from 1 to 2' END AS title,
 CASE event_id % 16 WHEN 0 THEN 'dependabot/pip/' WHEN 1 THEN 'dependabot/npm_and_yarn/' WHEN 2 THEN 'dependabot/go_modules/'
 WHEN 3 THEN 'dependabot/maven/' WHEN 4 THEN 'dependabot/cargo/' WHEN 5 THEN 'dependabot/bundler/' WHEN 6 THEN 'dependabot/uv/'
 WHEN 7 THEN 'renovate/pip/' WHEN 8 THEN 'renovate/npm/' WHEN 9 THEN 'renovate/go/' WHEN 10 THEN 'renovate/maven/'
 WHEN 11 THEN 'renovate/cargo/' WHEN 12 THEN 'renovate/rubygems/' WHEN 13 THEN 'feature/' WHEN 14 THEN 'dependabot/pip'
 ELSE 'x/dependabot/pip/' END || event_type AS ref,
 CASE event_id % 4 WHEN 0 THEN strftime_z ELSE strftime_n END AS stamp, ts, user_id
 FROM (SELECT *, replace(substring(CAST(ts AS STRING), 1, 19), ' ', 'T') || 'Z' AS strftime_z,
 CASE event_id % 4 WHEN 1 THEN replace(substring(CAST(ts AS STRING), 1, 19), ' ', 'T') || '.000'
   WHEN 2 THEN 'yesterday' ELSE substring(CAST(ts AS STRING), 1, 10) END AS strftime_n FROM events) t""",
    # Records as they arrive on a topic: valid ones of both feeds, and four ways of being unusable.
    "raw_records": """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'not-json'
 WHEN 1 THEN '{"source":"osv","cvss_score":5.0}'
 WHEN 2 THEN '{"event_id":"x","cve_id":"CVE-1","source":"unknown"}'
 WHEN 3 THEN '{"event_id":"x","cve_id":"","source":"nvd"}'
 ELSE '{"event_id":"e-' || CAST(p_partkey AS STRING) || '","cve_id":"CVE-2024-' || CAST(10000 + p_partkey AS STRING)
   || '","source":"' || CASE p_partkey % 8 WHEN 4 THEN 'NVD' WHEN 5 THEN 'osv' ELSE 'nvd' END
   || '","' || CASE WHEN p_partkey % 8 = 6 THEN 'cvss' ELSE 'cvss_score' END || '":' || CAST(p_size / 5.0E0 AS STRING)
   || CASE WHEN p_partkey % 8 = 5 THEN ',"severity_tier":"MEDIUM"' ELSE '' END || '}' END AS value FROM part""",
}

# Shared steps of the checking SQL. DuckDB only.
STEPS = {
    "ops_next": """SELECT *, lead(occurred_at) OVER w AS next_at, lead(event_id) OVER w AS next_event, lag(op) OVER w AS prev_op
 FROM dep_ops WINDOW w AS (PARTITION BY service_id, ecosystem, package ORDER BY occurred_at, event_id, op_rank, pos)""",
    "pins": "SELECT service_id, ecosystem, package, version, occurred_at AS since FROM ops_next WHERE next_event IS NULL AND op <> 'removed'",
    "scd2": """SELECT service_id, ecosystem, package, version, occurred_at AS valid_from, next_at AS valid_to, event_id AS from_event
 FROM ops_next WHERE op <> 'removed' AND (next_at IS NULL OR occurred_at < next_at)""",
    "osv_first": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cve_id, affected_package, ecosystem,
 affected_version_range ORDER BY ingested_at, event_id) AS rn FROM vuln_events WHERE source = 'osv') WHERE rn = 1""",
    "nvd_last": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY ingested_at DESC, event_id DESC) AS rn
 FROM vuln_events WHERE source = 'nvd' AND cvss_score > 0) WHERE rn = 1""",
    "cves": """SELECT o.* EXCLUDE (cvss_score, severity_tier, cwe_id), coalesce(n.cvss_score, o.cvss_score, 0.0) AS cvss_score,
 CASE WHEN n.cvss_score IS NULL THEN o.severity_tier WHEN n.cvss_score >= 9 THEN 'CRITICAL' WHEN n.cvss_score >= 7 THEN 'HIGH'
   WHEN n.cvss_score >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity_tier, coalesce(n.cwe_id, o.cwe_id) AS cwe_id,
 lower(o.affected_package) AS pk, string_split(o.affected_list, ',') AS listed,
 CASE WHEN o.affected_version_range LIKE '%>=%' THEN list_transform(string_split(regexp_extract(o.affected_version_range,
   '>= ([0-9.]+)', 1), '.'), lambda x: CAST(x AS INT)) END AS lo,
 CASE WHEN o.affected_version_range LIKE '%<%' THEN list_transform(string_split(regexp_extract(o.affected_version_range,
   '< ([0-9.]+)', 1), '.'), lambda x: CAST(x AS INT)) END AS hi
 FROM osv_first o LEFT JOIN nvd_last n ON o.cve_id = n.cve_id""",
    "catalogue": """SELECT DISTINCT ecosystem, lower(package) AS pk, version,
 list_transform(string_split(version, '.'), lambda x: CAST(x AS INT)) AS v FROM dep_ops WHERE op <> 'removed'""",
    "hits": """SELECT k.ecosystem, k.pk, k.version, c.* EXCLUDE (ecosystem, pk, listed, lo, hi) FROM catalogue k JOIN cves c ON k.pk = c.pk
 WHERE (c.ecosystem = '' OR c.ecosystem = k.ecosystem)
 AND (list_contains(c.listed, k.version) OR (c.hi IS NOT NULL AND k.v < c.hi AND (c.lo IS NULL OR k.v >= c.lo)))""",
    "timed_hits": """SELECT s.*, h.cve_id, h.affected_package, h.cvss_score, h.severity_tier, h.ingested_at,
 greatest(h.ingested_at, s.valid_from) AS detected_at FROM scd2 s JOIN hits h
 ON s.ecosystem = h.ecosystem AND lower(s.package) = h.pk AND s.version = h.version
 WHERE s.valid_to IS NULL OR h.ingested_at < s.valid_to""",
    "scored": """SELECT b.*, coalesce(r.team, 'unknown') AS team,
 round(least(cvss_score, 10.0) / 10.0 * 0.4 + CASE WHEN r.is_customer_facing THEN 0.25 ELSE 0 END
 + CASE WHEN r.pci_scope OR r.hipaa_scope OR r.soc2_scope THEN 0.2 ELSE 0 END + CASE WHEN r.pii_handler THEN 0.15 ELSE 0 END, 6) AS score
 FROM timed_hits b LEFT JOIN service_registry r ON b.service_id = r.service_id""",
    "tiered": """SELECT *, CASE WHEN score >= 0.75 THEN 'CRITICAL' WHEN score >= 0.5 THEN 'HIGH' WHEN score >= 0.25 THEN 'MEDIUM'
 ELSE 'LOW' END AS tier FROM scored""",
    "open_matches": f"""SELECT * FROM vulnerability_matches WHERE detected_at <= TIMESTAMP '{AS_OF}' AND status <> 'accepted_risk'
 AND (resolved_at IS NULL OR resolved_at > TIMESTAMP '{AS_OF}')""",
    "meta": """SELECT s.service_id, coalesce(r.team, 'unknown') AS team, coalesce(r.is_customer_facing, false) AS is_customer_facing,
 coalesce(r.pci_scope, false) AS pci_scope, coalesce(r.hipaa_scope, false) AS hipaa_scope, coalesce(r.soc2_scope, false) AS soc2_scope,
 coalesce(r.pii_handler, false) AS pii_handler FROM (SELECT DISTINCT service_id FROM vulnerability_matches) s
 LEFT JOIN service_registry r ON s.service_id = r.service_id""",
}


def _mentions(sql: str, names) -> list[str]:
    words = set(re.findall(r"\w+", sql))
    return [n for n in names if n in words]


def oracle(sql: str) -> str:
    """Checking SQL with the views and steps it needs put in front, in dependency order."""
    parts = {**VIEWS, **STEPS}
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in _mentions(text, parts):
            if name not in ordered:
                need(parts[name]) if parts[name] is not text else None
                if name not in ordered:
                    ordered.append(name)

    own = sql.lstrip()
    need(own)
    ctes = ", ".join(f"{name} AS ({parts[name]})" for name in ordered)
    if own.upper().startswith("WITH "):
        body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", own, flags=re.I)
        return f"WITH RECURSIVE {ctes}{', ' if ctes else ''}{body}"
    return f"WITH {ctes} {own}" if ctes else own


class Tables:
    """The given tables and the views over them, as DataFrames of one session."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        for name in _mentions(text, BASE):
            self.base(name).createOrReplaceTempView(name)
        for name in _mentions(text, VIEWS):
            self.view(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        for table in _mentions(text, BASE):
            self.base(table).createOrReplaceTempView(table)
        return self.spark.sql(text)

    @property
    def registry(self) -> DataFrame:
        return self.view("service_registry")

    @property
    def ops(self) -> DataFrame:
        return self.view("dep_ops")

    @cached_property
    def ops_once(self) -> DataFrame:
        """The operations stored, for queries that read them several times: the view joins two large tables."""
        return stored_table(self.ops, "ops")

    @property
    def pins_ever(self) -> DataFrame:
        return self.ops.filter("op <> 'removed'")

    @property
    def vulns(self) -> DataFrame:
        listed = F.filter(F.split("affected_list", ","), lambda v: v != "")
        return self.view("vuln_events").withColumn("affected_versions", listed)

    @property
    def matches(self) -> DataFrame:
        return self.view("vulnerability_matches")

    @property
    def dep_events(self) -> DataFrame:
        """The operations again as change events, one per order and ecosystem."""
        # Gathered once: a list per kind of operation would be three in every step of the aggregate.
        listed = F.sort_array(F.collect_list(F.struct("pos", "package", "version", "op")))
        grouped = self.ops.groupBy("event_id", "service_id", "ecosystem", "occurred_at").agg(listed.alias("pins"))
        of = lambda op: F.filter("pins", lambda x: x["op"] == op)
        grouped = grouped.withColumns({"a": of("added"), "r": of("removed"), "u": of("updated")})
        pins = lambda c: F.transform(c, lambda x: F.struct(x["package"].alias("package"), x["version"].alias("version")))
        ups = F.transform("u", lambda x: F.struct(
            x["package"].alias("package"), F.lit(None).cast("string").alias("from_version"), x["version"].alias("to_version")))
        return grouped.select("event_id", "service_id", "ecosystem", "occurred_at", pins("a").alias("added"),
                              pins("r").alias("removed"), ups.alias("updated"))
