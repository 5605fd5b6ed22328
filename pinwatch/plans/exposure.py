"""The composed job: operations and vulnerability records in, routed matches out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pinwatch.functions.scalars import exposure_id
from pinwatch.operators.graph import crowded_pins, validity_intervals
from pinwatch.operators.match import match_both_orders, merge_spellings, package_key, several_spellings
from pinwatch.operators.scoring import nonempty, registry_enrich, route, score
from pinwatch.operators.vulnerabilities import cvss_enrich, dedup_first_ever
from pinwatch.session import stored_table


def known_vulnerabilities(events: DataFrame) -> DataFrame:
    """Advisories, first sight of each, with the scores of the score feed."""
    osv = dedup_first_ever(events.filter("source = 'osv'"))
    return cvss_enrich(osv, events.filter("source = 'nvd'"))


def exposure(
    ops: DataFrame, vulnerability_events: DataFrame, registry: DataFrame, mark_new: bool = False
) -> DataFrame:
    """Scored matches; with ``mark_new`` they say whether the pin's package was new to the service.
    Matches that differ in the spelling of the package alone are one while their validity overlaps.

    The operations are read once: the intervals made of them are stored, and versions in use and spellings are
    taken from these. Metadata joins the intervals, before vulnerabilities multiply them, so the rows that
    cross the network for it are the few. Only packages that a service spells in several ways are merged.
    """
    intervals = stored_table(validity_intervals(ops, crowded_pins(ops), mark_new), "intervals")
    several = stored_table(several_spellings(intervals), "spellings")
    mixed = not several.isEmpty()
    named = intervals
    if mixed:
        package = ["service_id", "ecosystem", "package_key"]
        flagged = several.withColumn("_several", F.lit(True))
        named = intervals.withColumn("package_key", package_key()).join(flagged, package, "left").drop("package_key").fillna(False, ["_several"])
    cves = known_vulnerabilities(vulnerability_events)
    matches = match_both_orders(registry_enrich(named, registry), cves, versions_from=intervals)
    if mixed:
        apart = matches.filter("NOT _several").drop("_several")
        matches = apart.unionByName(merge_spellings(matches.filter("_several").drop("_several")))
    matches = score(matches)
    return matches.select(
        exposure_id().alias("match_id"),
        "cve_id",
        "service_id",
        "team",
        "ecosystem",
        F.col("affected_package").alias("matched_package"),
        F.col("version").alias("matched_version"),
        "cvss_score",
        "severity_tier",
        "score",
        "blast_radius_tier",
        "detected_at",
        "sla_deadline",
        F.col("valid_to").alias("left_at"),
        *(["is_new_dependency"] if mark_new else []),
    )


def routed_exposure(ops: DataFrame, vulnerability_events: DataFrame, registry: DataFrame) -> DataFrame:
    """Matches by topic: the tier's, and the review topic where the package was new. What can't be routed, for want
    of an id, a score or a deadline, is left out."""
    return route(nonempty(exposure(ops, vulnerability_events, registry, mark_new=True)))
