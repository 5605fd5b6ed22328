"""Parameterised lookups over the stored tables. Without a parameter a lookup covers everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pinwatch import constants as K
from pinwatch.functions.versions import version_key
from pinwatch.operators.match import VERSION, affected_versions, match_pins, package_key
from pinwatch.operators.posture import is_open
from pinwatch.operators.graph import PIN, new_dependencies, validity_intervals
from pinwatch.operators.scoring import registry_enrich
from pinwatch.plans.timeline import crowded_keys, with_neighbours
from pinwatch.session import stored_table
from pinwatch.sinks.layout import only


def vulnerability_exposure(matches: DataFrame, reports: DataFrame, as_of, service_id: str | None = None) -> DataFrame:
    """Open findings with deadline, status, assignee and whether a triage report exists."""
    rows = only(matches, "service_id", service_id).filter(is_open(as_of))
    named = reports.select("match_id")
    if service_id is not None:
        # A service has few findings; only reports on these are told apart.
        named = named.join(rows.select("match_id"), "match_id", "left_semi")
    triaged = named.distinct().withColumn("triaged", F.lit(True))
    return rows.join(triaged, "match_id", "left").select(
        "match_id", "cve_id", "service_id", "blast_radius", "status", "sla_deadline", "assigned_to",
        F.coalesce("triaged", F.lit(False)).alias("triaged"),
    )


def cve_details(vulnerabilities: DataFrame, matches: DataFrame, reports: DataFrame, cve_id: str | None = None) -> DataFrame:
    """Vulnerability with its matches and their triage reports."""
    rows = only(vulnerabilities, "cve_id", cve_id).join(only(matches, "cve_id", cve_id), "cve_id")
    return rows.join(reports, "match_id", "left").select(
        "cve_id", "match_id", "service_id", "cvss_score", "severity_tier", "blast_radius",
        "exploitability", "confidence_score",
    )


def remediation_path(requests: DataFrame, cves: DataFrame) -> DataFrame:
    """For each affected (ecosystem, package, version): the lowest fix of the package, not below the
    version, that no record of the package affects. NULL, with the reason, where a vulnerability has no
    fix or every fix is affected itself. Unaffected requests have no row.

    Fixes are few per package and are tested like versions in use, once each.
    """
    # Read several times, and as a rule made of all operations.
    wanted = stored_table(requests.select("ecosystem", "package", "version").distinct(), "requests")
    # A version meets a vulnerability once, so rows count vulnerabilities, and only their sums leave the join.
    unfixed = F.max((F.coalesce("safe_version", F.lit("")) == "").cast("int")).alias("unfixed")
    found = affected_versions(wanted, cves, ["cve_id", "safe_version"]).groupBy(*VERSION).agg(F.count("cve_id").alias("cves"), unfixed)
    found = stored_table(found, "affected-requests")
    fixes = cves.filter("safe_version <> ''").select(
        package_key("affected_package").alias("package_key"), F.coalesce("ecosystem", F.lit("")).alias("_of"), F.col("safe_version").alias("version")
    ).distinct()
    packages = wanted.select("ecosystem", package_key().alias("package_key")).distinct()
    tried = packages.join(fixes, "package_key").filter("_of = '' OR _of = ecosystem")
    tried = tried.select("ecosystem", F.col("package_key").alias("package"), "version").distinct()
    affected = affected_versions(tried, cves, ["cve_id"]).select("ecosystem", F.col("package_key").alias("package"), "version")
    clean = tried.join(affected, ["ecosystem", "package", "version"], "left_anti").select(
        "ecosystem", F.col("package").alias("package_key"), F.col("version").alias("fix"), version_key(F.col("version")).alias("_fix_key")
    )
    # A fix below the version is no upgrade; the least of the others is the next one in the order of versions.
    open_ = found.filter("unfixed = 0").select(*VERSION, version_key(F.col("version")).alias("_key"), F.lit(None).cast("string").alias("fix"))
    both = open_.unionByName(clean.select("ecosystem", "package_key", F.lit(None).cast("string").alias("version"), F.col("_fix_key").alias("_key"), "fix"))
    onwards = Window.partitionBy("ecosystem", "package_key").orderBy(F.desc("_key"), F.desc_nulls_last("fix")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = both.withColumn("upgrade_to", F.last("fix", ignorenulls=True).over(onwards)).filter("version IS NOT NULL AND _key IS NOT NULL")
    best = best.select(*VERSION, "upgrade_to")
    reason = F.when(F.col("unfixed") == 1, "no fix known").when(F.col("upgrade_to").isNull(), "every fix is affected").otherwise("fixed")
    told = found.join(best, VERSION, "left").select(*VERSION, "upgrade_to", "cves", reason.alias("reason"))
    return wanted.withColumn("package_key", package_key()).join(told, VERSION).select("ecosystem", "package", "version", "upgrade_to", "cves", "reason")


def affected_services(matches: DataFrame, as_of, cve_id: str | None = None) -> DataFrame:
    rows = only(matches, "cve_id", cve_id).filter(is_open(as_of))
    overdue = F.col("sla_deadline") < F.lit(as_of).cast("timestamp")
    return rows.select("cve_id", "service_id", "blast_radius", "blast_radius_score", "sla_deadline",
                       F.when(overdue, "breached").otherwise("within").alias("sla_state"))


def team_sla_queue(matches: DataFrame, registry: DataFrame, as_of, team: str | None = None) -> DataFrame:
    """Open findings, most urgent first."""
    rows = only(registry_enrich(matches.filter(is_open(as_of)), registry), "team", team)
    return rows.select("team", "match_id", "cve_id", "service_id", "blast_radius", "sla_deadline").orderBy(
        "sla_deadline", "match_id"
    )


def top_critical_open(matches: DataFrame, as_of, k: int = 5) -> DataFrame:
    rows = matches.filter(is_open(as_of) & (F.col("blast_radius") == "CRITICAL"))
    return rows.orderBy("sla_deadline", "match_id").limit(k).select("match_id", "cve_id", "service_id", "sla_deadline")


def compliance_gaps(matches: DataFrame, registry: DataFrame, as_of, framework: str | None = None) -> DataFrame:
    """Open findings of services in scope of a framework, with the controls concerned. A framework
    without a scope flag has no findings. The controls are a fixed table, written into the plan."""
    wanted = [row for row in K.FRAMEWORK_CONTROLS if framework in (None, row[0])]
    controls = F.array(*[
        F.struct(F.lit(name).alias("framework"), F.lit(control).alias("control"),
                 (F.col(flag) if flag else F.lit(False)).alias("in_scope"))
        for name, flag, control in wanted
    ])
    rows = registry_enrich(matches.filter(is_open(as_of)), registry)
    exploded = rows.select("match_id", "cve_id", "service_id", "blast_radius", F.inline(controls))
    return exploded.filter("in_scope").drop("in_scope")


def pr_risk_gate(ops: DataFrame, cves: DataFrame, crowded: DataFrame | None = None) -> DataFrame:
    """Verdict per newly introduced package: BLOCK on a critical or high vulnerability, WARN on any
    other, else APPROVE. Vulnerabilities are summed up per version before they meet the changes."""
    fresh = new_dependencies(ops, crowded)
    severe = F.max(F.col("severity_tier").isin("CRITICAL", "HIGH"))
    found = affected_versions(ops, cves, ["cve_id", "severity_tier"]).groupBy(
        "ecosystem", "package_key", "version"
    ).agg(F.count_distinct("cve_id").alias("cves"), severe.alias("severe"))
    joined = fresh.withColumn("package_key", package_key()).join(
        found, ["ecosystem", "package_key", "version"], "left"
    )
    verdict = F.when(F.col("severe"), "BLOCK").when(F.col("cves") > 0, "WARN").otherwise("APPROVE")
    return joined.select("service_id", "event_id", "ecosystem", "package", "version",
                         F.coalesce("cves", F.lit(0)).alias("cves"), verdict.alias("verdict"))


def auto_resolve(ops: DataFrame, cves: DataFrame, crowded: DataFrame | None = None) -> DataFrame:
    """Findings with the time they closed: the first later change that leaves the affected range.

    Adjacent intervals that are all affected are one finding; its end is the end of the last. A finding
    has at most the intervals of its pin, so the crowded pins are the ones to split here too. An interval that
    touches no other of its pin is a finding by itself for each vulnerability, and meets no neighbours.
    """
    key = ["cve_id", "service_id", "ecosystem", "package"]
    hour = F.date_trunc("hour", "valid_from")
    opens = F.col("prev").isNull() | (F.col("prev.valid_to") < F.col("valid_from"))
    closes = F.col("next").isNull() | (F.col("next.valid_from") > F.col("valid_to"))
    intervals = with_neighbours(validity_intervals(ops, crowded), PIN, ["valid_from"], ["valid_to"], hour, crowded)
    alone = F.coalesce(opens & closes & F.col("service_id").isNotNull(), F.lit(False))
    held = stored_table(intervals.select(*PIN, "version", "valid_from", "valid_to", alone.alias("alone")), "intervals", compact=True)
    untimed = stored_table(held.filter("valid_from IS NULL").select(*PIN, F.lit(True).alias("_untimed")).distinct(), "untimed-pins")
    if not untimed.isEmpty():  # what comes after an interval without a time can't be told from its neighbours
        held = held.join(untimed, PIN, "left").withColumn("alone", F.col("alone") & F.col("_untimed").isNull()).drop("_untimed")
    hits = match_pins(held, cves, ["cve_id", "ingested_at"], versions_from=held)
    hits = hits.withColumn("alone", F.col("alone") & F.col("cve_id").isNotNull()).filter(
        "NOT alone OR valid_to IS NULL OR ingested_at < valid_to"
    )
    hits = stored_table(hits.select(*key, "ingested_at", "valid_from", "valid_to", "alone"), "affected-intervals", compact=True)
    chained = hits.filter("NOT alone").drop("alone")
    crowded = crowded_keys(chained, PIN) if crowded is None else crowded
    if crowded is None:
        # Findings of a pin differ in little but the vulnerability: together they are far smaller in an exchange.
        chained = chained.repartition(*PIN)
    linked = with_neighbours(chained, key, ["valid_from"], ["valid_to"], hour, crowded).select(
        *key, "ingested_at", "valid_from", "valid_to", opens.alias("opens"), closes.alias("closes")
    )
    edges = with_neighbours(linked.filter("opens OR closes"), key, ["valid_from"], ["valid_to"], hour, crowded)
    findings = edges.filter("opens").select(
        *key,
        "ingested_at",
        "valid_from",
        F.when(F.col("closes"), F.col("valid_to")).otherwise(F.col("next.valid_to")).alias("resolved_at"),
    )
    findings = findings.unionByName(hits.filter("alone").select(*key, "ingested_at", "valid_from", F.col("valid_to").alias("resolved_at")))
    return findings.filter("resolved_at IS NULL OR ingested_at < resolved_at").select(
        *key, F.greatest("ingested_at", "valid_from").alias("detected_at"), "resolved_at"
    )


def classify_weakness(cves: DataFrame, category: str | None = None) -> DataFrame:
    """Vulnerabilities of a weakness category. The categories are a fixed table in the plan."""
    label = F.lit(None).cast("string")
    for cwe, name in K.WEAKNESS_CATEGORIES:
        label = F.when(F.col("cwe_id") == cwe, name).otherwise(label)
    return only(cves.withColumn("category", label).filter("category IS NOT NULL"), "category", category)
