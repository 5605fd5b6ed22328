"""Record types as DDL, which readers and ``from_json`` take as it is."""

from pyspark.sql import types as T


def struct_of(ddl: str) -> T.StructType:
    """The parsed schema; needs a running session."""
    return T.StructType.fromDDL(ddl)


VULNERABILITY = """
    event_id STRING, cve_id STRING, source STRING, published_at TIMESTAMP, ingested_at TIMESTAMP,
    cvss_score DOUBLE, severity_tier STRING, cwe_id STRING, description STRING,
    affected_package STRING, ecosystem STRING, affected_version_range STRING, safe_version STRING,
    affected_versions ARRAY<STRING>
"""

# As produced: both spellings of the score occur, times are text of varying layout.
VULNERABILITY_JSON = """
    event_id STRING, cve_id STRING, source STRING, published_at STRING, ingested_at STRING,
    cvss_score DOUBLE, cvss DOUBLE, severity_tier STRING, cwe_id STRING, description STRING,
    affected_package STRING, ecosystem STRING, affected_version_range STRING, safe_version STRING,
    affected_versions ARRAY<STRING>
"""

PINS = "array<struct<package: string, version: string>>"
UPDATES = "array<struct<package: string, from_version: string, to_version: string>>"

DEPENDENCY_CHANGE = """
    event_id STRING, source STRING, repo STRING, service_id STRING, pr_number INT, author STRING,
    ecosystem STRING, manifest_file STRING,
    added ARRAY<STRUCT<package: STRING, version: STRING>>,
    removed ARRAY<STRUCT<package: STRING, version: STRING>>,
    updated ARRAY<STRUCT<package: STRING, from_version: STRING, to_version: STRING>>,
    occurred_at TIMESTAMP, ingested_at TIMESTAMP
"""

SNAPSHOT = """
    service_id STRING, ecosystem STRING, dependencies MAP<STRING, STRING>, snapshot_at TIMESTAMP,
    trigger_event_id STRING
"""

SERVICE_REGISTRY = """
    service_id STRING, team STRING, ecosystem STRING, repo STRING, is_customer_facing BOOLEAN,
    pci_scope BOOLEAN, hipaa_scope BOOLEAN, soc2_scope BOOLEAN, pii_handler BOOLEAN,
    description STRING, code_owners ARRAY<STRING>
"""

NVD_RESPONSE = """
    totalResults INT,
    vulnerabilities ARRAY<STRUCT<cve: STRUCT<
        id: STRING, published: STRING,
        descriptions: ARRAY<STRUCT<lang: STRING, value: STRING>>,
        metrics: STRUCT<cvssMetricV31: ARRAY<STRUCT<cvssData: STRUCT<baseScore: DOUBLE>>>>,
        weaknesses: ARRAY<STRUCT<description: ARRAY<STRUCT<value: STRING>>>>>>>
"""

OSV_RECORD = """
    id STRING, modified STRING, published STRING, aliases ARRAY<STRING>, summary STRING,
    details STRING,
    affected ARRAY<STRUCT<
        package: STRUCT<name: STRING, ecosystem: STRING>,
        ranges: ARRAY<STRUCT<type: STRING, events: ARRAY<STRUCT<introduced: STRING, fixed: STRING>>>>,
        versions: ARRAY<STRING>>>
"""

OSV_INDEX = "modified STRING, id STRING"

ARCHIVE_EVENT = """
    type STRING, actor STRUCT<login: STRING>, repo STRUCT<name: STRING>,
    payload STRUCT<action: STRING, pull_request: STRUCT<
        number: DOUBLE, title: STRING, merged: BOOLEAN, merged_at: STRING, head: STRUCT<ref: STRING>>>
"""

PULL_REQUEST = """
    number INT, title STRING, merged_at STRING, user STRUCT<login: STRING>, head STRUCT<ref: STRING>
"""

TOPIC_RECORD = "key STRING, value STRING, topic STRING, timestamp TIMESTAMP"

# Stored tables.
TABLES = {
    "vulnerabilities": """
        cve_id STRING, cvss_score DECIMAL(3,1), severity_tier STRING, description STRING,
        affected_package STRING, ecosystem STRING, affected_version_range STRING,
        safe_version STRING, cwe_id STRING, published_at TIMESTAMP, source STRING,
        created_at TIMESTAMP
    """,
    "vulnerability_matches": """
        match_id STRING, cve_id STRING, service_id STRING, matched_version STRING,
        blast_radius STRING, status STRING, sla_deadline TIMESTAMP, assigned_to STRING,
        assigned_team STRING, detected_at TIMESTAMP, resolved_at TIMESTAMP
    """,
    "triage_reports": """
        report_id STRING, match_id STRING, exploitability STRING, exploitability_rationale STRING,
        blast_radius_rationale STRING, remediation_action STRING, is_breaking_change BOOLEAN,
        estimated_effort_hours DECIMAL(4,1), confidence_score DECIMAL(3,2),
        sources_cited ARRAY<STRING>, generated_at TIMESTAMP
    """,
    "service_registry": SERVICE_REGISTRY,
    "dep_graph_snapshots": """
        snapshot_id STRING, service_id STRING, ecosystem STRING,
        dependencies MAP<STRING, STRING>, snapshot_at TIMESTAMP
    """,
    "posture_reports": """
        report_id STRING, generated_at TIMESTAMP, period_days INT, open_critical INT,
        open_high INT, open_medium INT, open_low INT, past_sla_count INT,
        mttd_minutes DECIMAL(8,2), mttr_days DECIMAL(8,2), trend_direction STRING,
        executive_summary STRING, compliance_gaps MAP<STRING, BIGINT>,
        team_exposure MAP<STRING, BIGINT>
    """,
    "audit_log": """
        log_id STRING, event_type STRING, entity_id STRING, actor STRING, action STRING,
        metadata MAP<STRING, STRING>, created_at TIMESTAMP
    """,
}
