"""Vulnerability records: normalise, union, de-duplicate, enrich."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from pinwatch import constants as K
from pinwatch.functions.scalars import (
    canonical_ecosystem,
    lenient_timestamp,
    match_id,
    severity_from_cvss,
)
from pinwatch.plans.timeline import crowded_keys, pick, successors
from pinwatch.session import cut_lineage

RECORD_KEY = ["cve_id", "affected_package", "ecosystem", "affected_version_range"]


def nvd_normalise(items: DataFrame, ingested_at: Column) -> DataFrame:
    """Score-feed items in the canonical schema. They name no package; that is the advisories' part."""
    english = F.filter("descriptions", lambda d: d["lang"] == "en")
    score = F.coalesce(F.get(F.col("metrics.cvssMetricV31"), F.lit(0))["cvssData"]["baseScore"], F.lit(0.0))
    weakness = F.get(F.get(F.col("weaknesses"), F.lit(0))["description"], F.lit(0))["value"]
    empty = F.lit("")
    return items.filter("id <> ''").select(
        match_id(F.lit("nvd"), F.col("id"), F.col("published")).alias("event_id"),
        F.col("id").alias("cve_id"),
        F.lit("nvd").alias("source"),
        F.try_to_timestamp("published", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")).alias("published_at"),
        ingested_at.alias("ingested_at"),
        score.alias("cvss_score"),
        severity_from_cvss(score).alias("severity_tier"),
        F.nullif(weakness, empty).alias("cwe_id"),
        F.coalesce(F.get(english, F.lit(0))["value"], empty).alias("description"),
        empty.alias("affected_package"),
        empty.alias("ecosystem"),
        empty.alias("affected_version_range"),
        F.lit(None).cast("string").alias("safe_version"),
        F.array().cast("array<string>").alias("affected_versions"),
    )


def osv_safe_version(ranges: Column) -> Column:
    """Last non-empty fix over the ranges of type ECOSYSTEM; NULL without one."""
    of_type = F.filter(F.coalesce(ranges, F.array().cast(
        "array<struct<type: string, events: array<struct<introduced: string, fixed: string>>>>")),
        lambda r: r["type"] == "ECOSYSTEM")
    events = F.flatten(F.transform(of_type, lambda r: F.coalesce(
        r["events"], F.array().cast("array<struct<introduced: string, fixed: string>>"))))
    fixes = F.filter(F.transform(events, lambda e: e["fixed"]), lambda f: f != "")
    return F.try_element_at(fixes, F.lit(-1))


def osv_normalise(records: DataFrame, ingested_at: Column) -> DataFrame:
    """One canonical row per affected package of an advisory."""
    cve_alias = F.get(F.filter(F.coalesce("aliases", F.array().cast("array<string>")),
                               lambda a: a.startswith("CVE-")), F.lit(0))
    affected = records.select("*", F.explode("affected").alias("a")).filter("a.package.name <> ''")
    safe = osv_safe_version(F.col("a.ranges"))
    text = F.coalesce(F.nullif("summary", F.lit("")), F.col("details"), F.lit(""))
    return affected.select(
        match_id(F.lit("osv"), F.col("id"), F.col("modified"), F.col("a.package.name"),
                 F.col("a.package.ecosystem")).alias("event_id"),
        F.coalesce(cve_alias, F.col("id")).alias("cve_id"),
        F.lit("osv").alias("source"),
        lenient_timestamp(F.col("published")).alias("published_at"),
        ingested_at.alias("ingested_at"),
        F.lit(0.0).alias("cvss_score"),
        F.lit("MEDIUM").alias("severity_tier"),
        F.lit(None).cast("string").alias("cwe_id"),
        text.alias("description"),
        F.col("a.package.name").alias("affected_package"),
        canonical_ecosystem(F.coalesce("a.package.ecosystem", F.lit(""))).alias("ecosystem"),
        F.coalesce(F.concat(F.lit("< "), safe), F.lit("")).alias("affected_version_range"),
        safe.alias("safe_version"),
        F.coalesce("a.versions", F.array().cast("array<string>")).alias("affected_versions"),
    )


def union_sources(*feeds: DataFrame) -> DataFrame:
    first, *rest = feeds
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def dedup_first_ever(events: DataFrame, keys: list[str] = RECORD_KEY) -> DataFrame:
    return pick(events, keys, ["ingested_at", "event_id"])


def latest_record(events: DataFrame, keys: list[str] = RECORD_KEY) -> DataFrame:
    """Last write wins, per record rather than per CVE id, so that every package of a CVE stays."""
    return pick(events, keys, ["ingested_at", "event_id"], last=True)


def within_ttl(cves: DataFrame, at: Column, hours: int | None = None) -> DataFrame:
    """Optional expiry: keep records that are known at ``at`` and younger than ``hours`` then; by default
    no record expires."""
    if hours is None:
        return cves
    return cves.filter((F.col("ingested_at") > at - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ingested_at") <= at))


def cvss_enrich(osv: DataFrame, nvd: DataFrame) -> DataFrame:
    """Advisories take score and weakness of the newest score record of the same CVE that has a score.
    The feed writes 0 for none, so 0 says nothing and overwrites nothing."""
    newest = pick(nvd.filter("cvss_score > 0"), ["cve_id"], ["ingested_at", "event_id"], last=True).select(
        "cve_id", F.col("cvss_score").alias("_score"), F.col("cwe_id").alias("_cwe")
    )
    joined = osv.join(newest, "cve_id", "left")
    return joined.select(
        *[c for c in osv.columns if c not in ("cvss_score", "severity_tier", "cwe_id")],
        F.coalesce("_score", "cvss_score", F.lit(0.0)).alias("cvss_score"),
        F.when(F.col("_score").isNotNull(), severity_from_cvss(F.col("_score")))
        .otherwise(F.col("severity_tier")).alias("severity_tier"),
        F.coalesce("_cwe", "cwe_id").alias("cwe_id"),
    ).select(*osv.columns)


# --- first record per 24 hours, counted from the last accepted one --------------------------------


def dedup_first_24h(
    events: DataFrame,
    keys: list[str] = RECORD_KEY,
    hours: int = K.DEDUP_HOURS,
    fold_limit: int = 20_000,
) -> DataFrame:
    """Accept the first record of a key, drop its copies for ``hours``, then accept again.

    Of records at one time the smallest event id counts. Records without a time can't be placed and all
    pass. Whether a record is accepted depends on the one accepted before it, so a key is a chain of
    times. Chains of up to ``fold_limit`` records are folded in one expression, longer ones walked by
    doubled pointers; only times are gathered, under 128 bits of hashes of the key, and both give the same
    ones. The records meet the accepted times of their key once.
    """
    own = ["_one", "_two"]
    hashed = {name: F.xxhash64(F.lit(name), *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]) for name in own}
    timed = events.filter("ingested_at IS NOT NULL").withColumns({**hashed, "at": F.unix_micros("ingested_at")})
    times = timed.select(*own, "at")
    crowded = crowded_keys(times, own, fold_limit)
    if crowded is None:
        found = _at_accepted(timed, _accepted_by_fold(times, own, hours), own)
    else:
        small, large = times.join(crowded, own, "left_anti"), times.join(crowded, own, "left_semi").distinct()
        some = timed.join(_accepted_by_jumps(large, own, hours), [*own, "at"], "left_semi")
        found = _at_accepted(timed, _accepted_by_fold(small, own, hours), own).unionByName(some)
    kept = pick(found, [*own, "at"], ["event_id"])
    return kept.select(*events.columns).unionByName(events.filter("ingested_at IS NULL"))


def _at_accepted(timed: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    return timed.join(accepted, keys).filter(F.array_contains("_accepted", F.col("at"))).drop("_accepted")


def _accepted_by_fold(times: DataFrame, keys: list[str], hours: int) -> DataFrame:
    """``keys, _accepted``: the accepted times; a key's times are one array of numbers."""
    grouped = times.groupBy(*keys).agg(F.sort_array(F.collect_set("at")).alias("_times"))
    window = hours * 3_600_000_000
    kept = F.aggregate(
        "_times",
        F.array().cast("array<bigint>"),
        lambda acc, at: F.when((F.size(acc) == 0) | (at >= F.element_at(acc, -1) + window), F.concat(acc, F.array(at))).otherwise(acc),
    )
    return grouped.select(*keys, kept.alias("_accepted"))


def _accepted_by_jumps(times: DataFrame, keys: list[str], hours: int) -> DataFrame:
    """Every time points to the first one at least ``hours`` later; accepted are those reachable from
    the first of the key. Pointers are doubled each round, so the rounds are the logarithm of the chain
    length, and the work is spread by (key, time). A key is one hash here, so that missing parts join."""
    named = times.select(F.sha2(F.to_json(F.struct(*keys)), 256).alias("_key"), *keys, "at")
    nodes = cut_lineage(named.select("_key", "at"))
    aims = nodes.withColumn("aim", F.col("at") + F.lit(hours * 3_600_000_000))
    jump = cut_lineage(successors(nodes, aims.select("_key", F.col("aim").alias("at")), ["_key"]))
    jump = cut_lineage(aims.join(jump.select("_key", F.col("at").alias("aim"), "to"), ["_key", "aim"]).select("_key", "at", "to"))
    span = jump.agg(F.max("at") - F.min("at")).first()[0] or 0
    longest_chain = span // (hours * 3_600_000_000) + 2
    reached = cut_lineage(nodes.groupBy("_key").agg(F.min("at").alias("at")))
    for _ in range(math.ceil(math.log2(longest_chain)) + 1):
        hop = reached.join(jump, ["_key", "at"]).select("_key", F.col("to").alias("at"))
        reached = cut_lineage(reached.unionByName(hop).distinct())
        far = jump.select("_key", F.col("at").alias("to"), F.col("to").alias("_far"))
        jump = cut_lineage(jump.join(far, ["_key", "to"]).select("_key", "at", F.col("_far").alias("to")))
    return named.join(reached, ["_key", "at"], "left_semi").select(*keys, "at")
