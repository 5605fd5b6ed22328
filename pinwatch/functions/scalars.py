"""Column expressions on single values. Everything here stays inside Spark SQL expressions."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, functions as F

from pinwatch import constants as K


def _lookup(table: dict[str, str], key: Column) -> Column:
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(literal, key)


def _tiered(value: Column, floors, default: str) -> Column:
    (name, floor), *rest = floors
    branches = reduce(
        lambda acc, item: acc.when(value >= item[1], item[0]), rest, F.when(value >= floor, name)
    )
    return branches.otherwise(default)


def severity_from_cvss(score: Column) -> Column:
    return _tiered(score, K.SEVERITY_FLOORS, K.SEVERITY_DEFAULT)


def fill_severity(tier: Column, cvss_score: Column, cvss: Column) -> Column:
    """Keep a given tier; derive a missing one from whichever score field is present."""
    derived = severity_from_cvss(F.coalesce(cvss_score, cvss, F.lit(0.0)))
    return F.when(F.coalesce(tier, F.lit("")) == "", derived).otherwise(tier)


def fill_ingested_at(ingested_at: Column, as_of: Column) -> Column:
    return F.coalesce(ingested_at, as_of)


def canonical_ecosystem(feed_name: Column) -> Column:
    return F.coalesce(_lookup(K.FEED_ECOSYSTEMS, feed_name), F.lower(feed_name))


def ecosystem_from_branch(ref: Column) -> Column:
    """Every known prefix ends at the second slash, so the prefix is a lookup key."""
    prefix = F.concat(F.substring_index(ref, "/", 2), F.lit("/"))
    complete = F.length(F.substring_index(ref, "/", 2)) < F.length(ref)
    return F.coalesce(F.when(complete, _lookup(K.BRANCH_ECOSYSTEMS, prefix)), F.lit(""))


def manifest_for_ecosystem(ecosystem: Column) -> Column:
    return F.coalesce(_lookup(K.MANIFESTS, ecosystem), F.lit(K.MANIFEST_DEFAULT))


def bump_title(title: Column) -> Column:
    """Struct (package, from_version, to_version); empty strings when the title does not match."""
    return F.struct(
        *[
            F.regexp_extract(title, K.BUMP_TITLE, group).alias(name)
            for group, name in enumerate(("package", "from_version", "to_version"), start=1)
        ]
    )


def bump_title_extended(title: Column) -> Column:
    """As ``bump_title``, with the prefixed and the "update ... requirement" layouts."""

    def first(*candidates: Column) -> Column:
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(title, pattern, group)

    return F.struct(
        first(part(K.BUMP_TITLE, 1), part(K.CHORE_TITLE, 1), part(K.REQUIREMENT_TITLE, 1)).alias("package"),
        first(part(K.BUMP_TITLE, 2), part(K.CHORE_TITLE, 2)).alias("from_version"),
        first(part(K.BUMP_TITLE, 3), part(K.CHORE_TITLE, 3), part(K.REQUIREMENT_TITLE, 2)).alias("to_version"),
    )


def dedup_key(cve_id: Column, package: Column, ecosystem: Column, version_range: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (cve_id, package, ecosystem, version_range)]
    return F.sha2(F.concat_ws(":", *parts), 256)


def exposure_score(
    cvss: Column, customer_facing: Column, pci: Column, hipaa: Column, soc2: Column, pii: Column
) -> Column:
    """Weighted score, rounded so that tier bounds do not hang on the order of float additions."""

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("double")

    in_scope = F.coalesce(pci, F.lit(False)) | F.coalesce(hipaa, F.lit(False)) | F.coalesce(soc2, F.lit(False))
    base = F.least(F.coalesce(cvss, F.lit(0.0)), F.lit(10.0)) / 10.0
    return F.round(
        base * K.WEIGHT_CVSS
        + flag(customer_facing) * K.WEIGHT_CUSTOMER_FACING
        + in_scope.cast("double") * K.WEIGHT_COMPLIANCE
        + flag(pii) * K.WEIGHT_PII,
        6,
    )


def tier_from_score(score: Column) -> Column:
    return _tiered(score, K.TIER_FLOORS, K.TIER_DEFAULT)


def sla_deadline(base: Column, tier: Column) -> Column:
    hours = F.create_map(*[F.lit(x) for x in chain.from_iterable(K.SLA_HOURS.items())])
    allowed = F.coalesce(F.try_element_at(hours, tier), F.lit(K.SLA_HOURS[K.TIER_DEFAULT]))
    return base + F.make_dt_interval(hours=allowed)


def topic_for_tier(tier: Column) -> Column:
    return F.coalesce(_lookup(K.TIER_TOPICS, tier), F.lit(K.TOPIC_DEFAULT))


def rfc3339(text: Column) -> Column:
    layout = r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
    return F.when(text.rlike(layout), F.try_to_timestamp(text))


def lenient_timestamp(text: Column, *layouts: str) -> Column:
    """RFC 3339 first, then the given layouts; NULL when none fits."""
    return F.coalesce(rfc3339(text), *[F.try_to_timestamp(text, F.lit(layout)) for layout in layouts])


def match_id(*parts: Column) -> Column:
    """A repeatable id, so that a replay writes the same keys."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def exposure_id() -> Column:
    """The id of a match, whatever the spelling of its package."""
    return match_id(*[F.col(c) for c in ("cve_id", "service_id", "ecosystem")], F.lower("package"), F.col("version"), F.col("detected_at"))
