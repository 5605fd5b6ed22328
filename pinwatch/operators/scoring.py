"""Service metadata, score, tier, deadline and topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pinwatch import constants as K
from pinwatch.functions.scalars import exposure_score, sla_deadline, tier_from_score, topic_for_tier

FLAGS = ["is_customer_facing", "pci_scope", "hipaa_scope", "soc2_scope", "pii_handler"]


def registry_enrich(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach service metadata; unknown services get team ``unknown`` and no flags.

    No broadcast hint: Spark broadcasts the registry while its measured size allows, and joins by
    shuffle once it has outgrown that.
    """
    known = registry.select("service_id", "team", *FLAGS)
    joined = rows.join(known, "service_id", "left")
    filled = {"team": F.coalesce("team", F.lit("unknown"))}
    filled.update({flag: F.coalesce(flag, F.lit(False)) for flag in FLAGS})
    return joined.withColumns(filled)


def score(matches: DataFrame) -> DataFrame:
    """Score, tier and deadline of enriched matches; the deadline counts from the detection."""
    value = exposure_score(*[F.col(c) for c in ("cvss_score", *FLAGS)])
    return (
        matches.withColumn("score", value)
        .withColumn("blast_radius_tier", tier_from_score(F.col("score")))
        .withColumn("sla_deadline", sla_deadline(F.col("detected_at"), F.col("blast_radius_tier")))
    )


def nonempty(scored: DataFrame) -> DataFrame:
    """Only matches that were scored and can be routed."""
    return scored.filter("cve_id <> '' AND service_id <> '' AND score IS NOT NULL AND sla_deadline IS NOT NULL")


def route(matches: DataFrame) -> DataFrame:
    """One row per output topic: the tier's, and the review topic for newly added packages."""
    tier_topic = topic_for_tier(F.coalesce("blast_radius_tier", F.lit(K.TIER_DEFAULT)))
    if "is_new_dependency" not in matches.columns:
        return matches.withColumn("topic", tier_topic)
    is_new = F.coalesce("is_new_dependency", F.lit(False))
    topics = F.when(is_new, F.array(tier_topic, F.lit(K.PR_RISK_TOPIC))).otherwise(F.array(tier_topic))
    return matches.withColumn("topic", F.explode(topics))


def split_by_topic(routed: DataFrame, topics=(*K.TIER_TOPICS.values(), K.PR_RISK_TOPIC)) -> dict[str, DataFrame]:
    """Separate frames, only for sinks that really differ by topic."""
    return {topic: routed.filter(F.col("topic") == topic) for topic in topics}
