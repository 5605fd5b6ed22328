"""Streaming twins of the batch operators.

Built-in operators wherever they carry the meaning: the dependency state is a streaming aggregation,
metadata a stream-static join, routing a column. Only the two orders-of-arrival questions need own
state.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from pinwatch import constants as K
from pinwatch.functions.scalars import exposure_id, severity_from_cvss
from pinwatch.functions.versions import in_range, located, specifier
from pinwatch.operators.graph import ORDER, PIN
from pinwatch.operators.match import CVE_COLUMNS, package_key
from pinwatch.operators.scoring import nonempty, registry_enrich, route, score
from pinwatch.operators.vulnerabilities import RECORD_KEY
from pinwatch.sinks.topics import keyed_matches
from pinwatch.sources.changes import listed_changes
from pinwatch.streaming import processors
from pinwatch.streaming.processors import (
    CANDIDATE,
    SCORED,
    SNAPSHOT,
    FirstPerWindow,
    MatchesMeetScores,
    PinsMeetVulnerabilities,
    SnapshotPerEvent,
)

# The process that sets up a stateful step is not given the files of the application, so the
# processors travel whole.
cloudpickle.register_pickle_by_value(processors)

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Fixed value: how many checkpoints stay restorable.
    "spark.sql.streaming.minBatchesToRetain": "3",
}
# Fixed value: trigger interval of a continuously running query.
TRIGGER = "60 seconds"


def stream_dedup(events: DataFrame, hours: int = K.DEDUP_HOURS, expire: bool = False) -> DataFrame:
    """First record per key and ``hours``. With ``expire`` state goes after as much wall time, which
    suits live topics; without it only event times decide, which suits back-fills."""
    schema = events.schema
    return (
        events.withColumns({c: F.coalesce(c, F.lit("")) for c in RECORD_KEY})
        .withColumn("_at", F.unix_micros("ingested_at"))
        .groupBy(*RECORD_KEY)
        .transformWithState(
            FirstPerWindow(hours, expire),
            outputStructType=schema,
            outputMode="Append",
            timeMode="ProcessingTime" if expire else "None",
        )
    )


def stream_dep_graph(ops: DataFrame) -> DataFrame:
    """Live dependency state as a streaming aggregation (update mode): the newest operation per pin.
    The order columns are part of the state, so an operation that arrives late changes nothing."""
    newest = F.max_by(F.struct("op", "version", *ORDER), F.struct(*ORDER))
    return ops.groupBy(*PIN).agg(newest.alias("s")).select(*PIN, "s.*")


def stream_static_enrich(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Metadata from the stored registry; a file source is listed anew in every trigger."""
    return registry_enrich(rows, registry)


def stream_route(matches: DataFrame) -> DataFrame:
    return route(matches)


def stream_snapshots(events: DataFrame) -> DataFrame:
    """The full state of a service after each of its change events, one row per ecosystem: the stream of
    what :func:`pinwatch.operators.graph.snapshot_history` makes of all events."""
    rows = listed_changes(events).withColumn("at", F.unix_micros("occurred_at"))
    found = rows.groupBy("service_id").transformWithState(
        SnapshotPerEvent(), outputStructType=SNAPSHOT, outputMode="Append", timeMode="None"
    )
    return found.select(
        "service_id", "trigger_event_id", F.timestamp_micros("snapshot_at").alias("snapshot_at"), "ecosystem", "dependencies"
    )


def stream_symmetric_join(
    ops: DataFrame, cves: DataFrame, pin_shares: int = 16, cve_shares: int = 1, held_pins: int = 20_000,
    hours: int | None = None, delay: str = "1 hour",
) -> DataFrame:
    """Matches whichever side arrives second, with state on both sides.

    A package is a grid of ``pin_shares`` x ``cve_shares`` keys: each pin goes to one row of it and
    each vulnerability to one column, so every pair meets exactly once, and a package that very many
    services use (or that very many vulnerabilities name) is spread over the grid. Vulnerabilities
    are few beside pins, hence one column by default.

    With ``hours`` a vulnerability meets only pins that arise less than so long after it became known, and
    its state goes when the watermark has passed that; rows later than ``delay`` behind it are then left
    out. The batch twin is ``match_both_orders`` with the same ``hours``.
    """
    none = F.lit(None)
    columns = "package_key pin_share cve_share is_cve at event_id op_rank pos service_id package version position".split()
    cve_columns = "record cve_id ecosystem low high ranged listed special payload".split()
    shares = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Parsed in a step of its own: names of nested fields are lost beside an explode.
    pins = ops.withColumn("here", located(F.col("version"))).select(
        package_key().alias("package_key"),
        F.pmod(F.xxhash64("service_id"), F.lit(pin_shares)).cast("int").alias("pin_share"),
        shares(cve_shares).alias("cve_share"),
        F.lit(False).alias("is_cve"),
        F.unix_micros("occurred_at").alias("at"),
        "event_id",
        F.col("op_rank").cast("int").alias("op_rank"),
        F.col("pos").cast("int").alias("pos"),
        "service_id",
        "package",
        F.when(F.col("op") != "removed", F.col("version")).alias("version"),
        F.when(F.col("op") != "removed", F.col("here.position")).alias("position"),
        none.cast("string").alias("record"),
        none.cast("string").alias("cve_id"),
        "ecosystem",
        none.cast("string").alias("low"),
        none.cast("string").alias("high"),
        F.lit(False).alias("ranged"),
        F.array().cast("array<string>").alias("listed"),
        F.lit(False).alias("special"),
        none.cast("string").alias("payload"),
    )
    named = cves.filter("affected_package <> ''").withColumn("spec", specifier(F.col("affected_version_range")))
    record = F.concat_ws(":", *RECORD_KEY)
    news = named.select(
        package_key("affected_package").alias("package_key"),
        shares(pin_shares).alias("pin_share"),
        F.pmod(F.xxhash64(record), F.lit(cve_shares)).cast("int").alias("cve_share"),
        F.lit(True).alias("is_cve"),
        F.unix_micros("ingested_at").alias("at"),
        "event_id",
        F.lit(0).alias("op_rank"),
        F.lit(0).alias("pos"),
        *[none.cast("string").alias(c) for c in ("service_id", "package", "version", "position")],
        record.alias("record"),
        "cve_id",
        F.coalesce("ecosystem", F.lit("")).alias("ecosystem"),
        F.col("spec.low").alias("low"),
        F.col("spec.high").alias("high"),
        F.col("spec").isNotNull().alias("ranged"),
        F.coalesce("affected_versions", F.array().cast("array<string>")).alias("listed"),
        F.coalesce("spec.special", F.lit(False)).alias("special"),
        F.to_json(F.struct(*CVE_COLUMNS, "affected_version_range", "affected_versions")).alias("payload"),
    )
    both = pins.select(*columns, *cve_columns).unionByName(news.select(*columns, *cve_columns))
    if hours is not None:
        both = both.withColumn("event_time", F.timestamp_micros("at")).withWatermark("event_time", delay)
    candidates = both.groupBy("package_key", "pin_share", "cve_share").transformWithState(
        PinsMeetVulnerabilities(held_pins, hours), outputStructType=CANDIDATE, outputMode="Append",
        timeMode="None" if hours is None else "EventTime",
    )
    # The state compares bounds; clauses beyond bounds are settled here, on what is left.
    body = F.from_json(
        "payload",
        "affected_package STRING, cvss_score DOUBLE, severity_tier STRING, safe_version STRING, "
        "ingested_at TIMESTAMP, affected_version_range STRING, affected_versions ARRAY<STRING>",
    )
    # Nearly all ranges are bounds alone, and were settled in the state.
    parsed = candidates.withColumn("c", body).withColumn("here", F.when(F.col("special"), located(F.col("version")))).withColumn(
        "spec", F.when(F.col("special"), specifier(F.col("c.affected_version_range")))
    )
    listed = F.coalesce(F.array_contains("c.affected_versions", F.col("version")), F.lit(False))
    exact = ~F.col("special") | listed | in_range(F.col("here"), F.col("spec"), F.col("version"))
    return parsed.filter(exact).select(
        "cve_id", "service_id", "ecosystem", "package", "version",
        F.timestamp_micros("detected_at").alias("detected_at"),
        "since",
        "is_new_dependency",
        F.col("c.affected_package").alias("matched_package"),
        F.col("c.cvss_score").alias("cvss_score"),
        F.col("c.severity_tier").alias("severity_tier"),
    )


def stream_scores(matches: DataFrame, scores: DataFrame, shares: int = 4) -> DataFrame:
    """Matches with the newest score of their vulnerability, whichever arrives first. A score that changes
    sends the matches of its vulnerability again; of messages with one ``match_id`` the one with the
    highest ``revision`` counts. A score of 0 says nothing.

    Matches of a vulnerability are dealt by service to ``shares`` keys, each of which gets all its scores.
    """
    none = lambda kind: F.lit(None).cast(kind)
    parts = ["service_id", "ecosystem", "package", "version"]
    found = matches.select(
        "cve_id", F.pmod(F.xxhash64("service_id"), F.lit(shares)).cast("int").alias("share"), F.lit(False).alias("is_score"),
        none("bigint").alias("at"), none("string").alias("event_id"), none("double").alias("score"), *parts, package_key().alias("package_key"),
        F.unix_micros("detected_at").alias("detected_at"), "since", "is_new_dependency", "matched_package",
        F.col("cvss_score").alias("own_score"), F.col("severity_tier").alias("own_tier"),
    )
    said = scores.filter("cvss_score > 0").select(
        "cve_id", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(True).alias("is_score"),
        F.unix_micros("ingested_at").alias("at"), "event_id", F.col("cvss_score").alias("score"),
        *[none("string").alias(c) for c in (*parts, "package_key")], none("bigint").alias("detected_at"), none("bigint").alias("since"),
        none("boolean").alias("is_new_dependency"), none("string").alias("matched_package"), none("double").alias("own_score"), none("string").alias("own_tier"),
    )
    scored = found.unionByName(said).groupBy("cve_id", "share").transformWithState(
        MatchesMeetScores(), outputStructType=SCORED, outputMode="Append", timeMode="None"
    )
    tier = F.when(F.col("score").isNotNull(), severity_from_cvss(F.col("score"))).otherwise(F.col("own_tier"))
    return scored.select(
        "cve_id", *parts, F.timestamp_micros("detected_at").alias("detected_at"), "is_new_dependency", "matched_package",
        F.coalesce("score", "own_score", F.lit(0.0)).alias("cvss_score"), tier.alias("severity_tier"), "revision",
    )


def stream_exposure(
    ops: DataFrame, advisories: DataFrame, scores: DataFrame, registry: DataFrame, pin_shares: int = 16
) -> DataFrame:
    """Operations, advisories and scores in, keyed messages with their topic out: de-duplicate, match, take
    scores, enrich, score, route. ``registry`` is a stored table, the others are streams.

    A message is final once nothing newer comes; :func:`pinwatch.sinks.topics.latest_messages` reads the last of each match.
    """
    matches = stream_scores(stream_symmetric_join(ops, stream_dedup(advisories), pin_shares), scores)
    scored = score(registry_enrich(matches, registry)).withColumn("match_id", exposure_id())
    return keyed_matches(stream_route(nonempty(scored)))


def start(stream: DataFrame, sink, state_partitions: int | None = None, settings: dict | None = None):
    """Start ``sink(stream)`` with the state settings; their number of partitions is fixed for the
    life of the checkpoint, so it is given rather than taken from the session."""
    spark = stream.sparkSession
    wanted = {**STATE_SETTINGS, **(settings or {})}
    wanted["spark.sql.shuffle.partitions"] = str(state_partitions or spark.sparkContext.defaultParallelism)
    previous = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        return sink(stream).start()
    finally:
        for key, value in previous.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
