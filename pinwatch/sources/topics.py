"""Message topics as streams, and a file stand-in with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pinwatch import constants as K, schemas
from pinwatch.functions.scalars import fill_ingested_at, fill_severity, lenient_timestamp

RATE_OPTION = {"kafka": "maxOffsetsPerTrigger", "files": "maxFilesPerTrigger"}


def kafka_options(servers: str, topics=K.INPUT_TOPICS, max_per_trigger: int | None = None) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": "earliest",
        "failOnDataLoss": "true",
    }
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def read_topics(spark: SparkSession, servers: str, topics=K.INPUT_TOPICS, max_per_trigger=None) -> DataFrame:
    """Live topics; needs the Kafka connector on the class path."""
    stream = spark.readStream.format("kafka").options(**kafka_options(servers, topics, max_per_trigger)).load()
    return stream.select(
        F.col("key").cast("string"), F.col("value").cast("string"), "topic", "timestamp"
    )


def read_topic_files(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same columns from parquet files, for back-fills and tests."""
    reader = spark.readStream.schema(schemas.TOPIC_RECORD)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def parse_vulnerabilities(records: DataFrame) -> DataFrame:
    """Parse once. ``raw`` keeps the text, ``parsed`` is NULL where it is not a JSON object."""
    return records.select(
        "*",
        F.col("value").alias("raw"),
        F.from_json(
            "value",
            f"{schemas.VULNERABILITY_JSON}, _bad STRING",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"},
        ).alias("parsed"),
    )


def valid_vulnerability():
    p = F.col("parsed")
    known_source = F.lower(F.coalesce(p["source"], F.lit(""))).isin(*K.VULN_SOURCES)
    return p.isNotNull() & p["_bad"].isNull() & known_source & (F.coalesce(p["cve_id"], F.lit("")) != "")


def vulnerability_events(records: DataFrame, as_of) -> DataFrame:
    """Valid records in the canonical schema; a missing tier comes from the score, a missing
    ingestion time from ``as_of``."""
    p = F.col("parsed")
    filled = {
        "published_at": lenient_timestamp(p["published_at"], "yyyy-MM-dd'T'HH:mm:ss.SSS"),
        "ingested_at": fill_ingested_at(lenient_timestamp(p["ingested_at"], "yyyy-MM-dd'T'HH:mm:ss.SSS"), as_of),
        "cvss_score": F.coalesce(p["cvss_score"], p["cvss"], F.lit(0.0)),
        "severity_tier": fill_severity(p["severity_tier"], p["cvss_score"], p["cvss"]),
    }
    valid = parse_vulnerabilities(records).filter(valid_vulnerability())
    return valid.select(
        *[filled.get(f.name, p[f.name]).alias(f.name) for f in schemas.struct_of(schemas.VULNERABILITY).fields]
    )


def quarantine(records: DataFrame) -> DataFrame:
    """What ``vulnerability_events`` leaves out, with the reason."""
    p = F.col("parsed")
    # A JSON object with a value of the wrong type is JSON all the same.
    readable = F.get_json_object("raw", "$").startswith("{")
    broken = p.isNull() | p["_bad"].isNotNull()
    unknown = ~F.lower(F.coalesce(p["source"], F.lit(""))).isin(*K.VULN_SOURCES)
    reason = (
        F.when(broken & F.coalesce(readable, F.lit(False)), "bad field").when(broken, "not json").when(unknown, "unknown source").otherwise("no cve id")
    )
    bad = parse_vulnerabilities(records).filter(~F.coalesce(valid_vulnerability(), F.lit(False)))
    return bad.select("raw", reason.alias("reason"))


def judged_changes(records: DataFrame) -> DataFrame:
    """Records with the change event each holds, ``e``, parsed once: as a generated row it is no expression that every
    later step would evaluate anew. NULL where the text is no change event."""
    parsed = records.select("*", F.explode(F.array(F.from_json("value", schemas.DEPENDENCY_CHANGE))).alias("_e"))
    return parsed.withColumn("e", F.when(F.col("_e.event_id").isNotNull(), F.col("_e"))).drop("_e")


def taken_changes(judged: DataFrame) -> DataFrame:
    return judged.filter("e IS NOT NULL").select("e.*")


def refused_changes(judged: DataFrame) -> DataFrame:
    return judged.filter("e IS NULL").select(F.col("value").alias("raw"), F.lit("not a change event").alias("reason"))


def change_events(records: DataFrame) -> DataFrame:
    """Dependency changes in the canonical schema; text that does not parse is dropped."""
    return taken_changes(judged_changes(records))


def change_quarantine(records: DataFrame) -> DataFrame:
    return refused_changes(judged_changes(records))
