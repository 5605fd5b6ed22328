"""End-to-end cases: who is exposed, with which score, and what closes a finding."""

from pyspark.sql import functions as F
import pytest

from pinwatch.operators import graph, lookups
from pinwatch.plans.exposure import exposure
from tests.test_operators import cves, hours, ops, rows

# Service, team, customer facing, pci, hipaa, soc2, personal data.
SERVICES = [
    ("checkout-api", "payments", True, True, False, True, True),
    ("payment-processor", "payments", False, True, False, True, True),
    ("fraud-detector", "payments", False, True, False, True, False),
    ("auth-service", "auth", True, True, True, True, True),
    ("secrets-manager", "platform", False, True, False, True, False),
    ("log-aggregator", "platform", False, False, False, True, False),
    ("user-api", "product", True, False, False, True, True),
    ("notification-worker", "product", False, False, False, False, True),
    ("data-pipeline", "data", False, False, False, False, True),
    ("legacy-billing", "payments", False, True, False, True, True),
    ("document-processor", "platform", False, False, False, False, False),
]


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(SERVICES, "service_id string, team string, is_customer_facing boolean, pci_scope boolean, "
                                           "hipaa_scope boolean, soc2_scope boolean, pii_handler boolean")


def vulns(spark, advisories, scores):
    osv = cves(spark, advisories)
    nvd = cves(spark, [(0, cve, "", "") for cve in scores]).withColumn("source", F.lit("nvd"))
    score = F.lit(0.0)
    for cve, value in scores.items():
        score = F.when(F.col("cve_id") == cve, value).otherwise(score)
    return osv.withColumn("cvss_score", F.lit(0.0)).unionByName(nvd.withColumn("cvss_score", score).withColumn("event_id", F.concat(F.lit("n"), "event_id")))


def run(spark, registry, changes, advisories, scores):
    return exposure(ops(spark, changes), vulns(spark, advisories, scores), registry)


RCE = [(1, "CVE-2024-35195", "requests", "< 2.32.0")]


def test_remote_code_execution(spark, registry):
    services = ["checkout-api", "payment-processor", "auth-service"]
    got = run(spark, registry, [(0, s, "requests", "added", "2.28.0") for s in services], RCE, {"CVE-2024-35195": 5.9})
    assert rows(got, "service_id", "score", "blast_radius_tier") == [
        ("auth-service", 0.836, "CRITICAL"), ("checkout-api", 0.836, "CRITICAL"), ("payment-processor", 0.586, "HIGH")]


def test_mass_exposure(spark, registry):
    flags = {"checkout-api": 0.6, "auth-service": 0.6, "user-api": 0.6, "data-pipeline": 0.15, "log-aggregator": 0.2,
             "notification-worker": 0.15, "secrets-manager": 0.2, "fraud-detector": 0.2}
    got = run(spark, registry, [(0, s, "cryptography", "added", "41.0.0") for s in flags], [(1, "C", "cryptography", "< 42.0.4")], {"C": 7.5})
    assert rows(got, "service_id", "score") == sorted((s, round(f + 0.3, 6)) for s, f in flags.items())


def test_supply_chain_addition_is_blocked_whatever_its_spelling(spark, registry):
    changes = [(0, "checkout-api", "PyYAML", "added", "5.3.1")]
    got = run(spark, registry, changes, [(1, "C", "pyyaml", "< 5.4")], {"C": 9.8})
    assert rows(got, "service_id", "matched_package") == [("checkout-api", "pyyaml")]
    severe = cves(spark, [(1, "C", "pyyaml", "< 5.4")]).withColumn("severity_tier", F.lit("CRITICAL"))
    assert rows(lookups.pr_risk_gate(ops(spark, changes), severe), "verdict") == [("BLOCK",)]


def test_two_vulnerabilities_in_a_legacy_service(spark, registry):
    changes = [(0, "legacy-billing", "log4j:log4j", "added", "1.2.17", "maven"),
               (0, "legacy-billing", "org.springframework:spring-webmvc", "added", "5.3.0", "maven"),
               (0, "document-processor", "log4j:log4j", "added", "1.2.17", "maven")]
    advisories = [(1, "L", "log4j:log4j", "< 2.0", [], "maven"), (1, "S", "org.springframework:spring-webmvc", "< 5.3.18", [], "maven")]
    got = run(spark, registry, changes, advisories, {"L": 9.8, "S": 9.8})
    assert rows(got, "cve_id", "service_id") == [("L", "document-processor"), ("L", "legacy-billing"), ("S", "legacy-billing")]


def test_safe_upgrades_fire_nothing_and_close_what_was_open(spark, registry):
    names = [s[0] for s in SERVICES]
    upgrades = [(9, s, "requests", "updated", "2.32.1") for s in names]
    assert run(spark, registry, upgrades, RCE, {}).count() == 0
    before = [(0, s, "requests", "added", "2.28.0") for s in names]
    closed = lookups.auto_resolve(ops(spark, before + upgrades), cves(spark, RCE))
    assert rows(closed, "service_id", "detected_at", "resolved_at") == sorted((s, hours(1), hours(9)) for s in names)


def test_harmless_addition_is_approved(spark, registry):
    changes = [(0, "checkout-api", "httpx", "added", "0.27.0")]
    assert run(spark, registry, changes, RCE, {}).count() == 0
    assert rows(lookups.pr_risk_gate(ops(spark, changes), cves(spark, RCE)), "verdict") == [("APPROVE",)]
    assert rows(graph.new_dependencies(ops(spark, changes)), "package") == [("httpx",)]
