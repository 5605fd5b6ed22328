"""Publishing matches and snapshots, keyed by entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pinwatch import constants as K
from pinwatch.session import write_compact


def keyed(rows: DataFrame, key: str, topic: Column | None = None) -> DataFrame:
    """(topic, key, value): the key keeps an entity's messages in order, the value is the row as JSON."""
    payload = F.to_json(F.struct(*[c for c in rows.columns if c != "topic"]))
    return rows.select(
        (F.col("topic") if topic is None else topic).alias("topic"),
        F.col(key).cast("string").alias("key"),
        payload.alias("value"),
    )


def keyed_matches(routed: DataFrame) -> DataFrame:
    return keyed(routed, "service_id")


def keyed_snapshots(snapshots: DataFrame) -> DataFrame:
    return keyed(snapshots, "service_id", F.lit(K.SNAPSHOT_TOPIC))


def latest_messages(messages: DataFrame) -> DataFrame:
    """The last word on each match: of the messages with one ``match_id`` those of the highest revision, in the
    topics that these went to."""
    named = messages.withColumn("_said", F.from_json("value", "match_id STRING, revision INT")).filter("_said.match_id IS NOT NULL")
    named = named.select("topic", "key", "value", _short(F.col("_said.match_id")).alias("_match"), F.coalesce("_said.revision", F.lit(0)).alias("_revision"))
    # One exchange by match and one order do: the newest come first, and what says the same again is beside it. No row
    # is held in a table of groups, and texts go along only if read.
    match = Window.partitionBy("_match").orderBy(F.desc("_revision"), "topic", "key")
    told = {"_newest": F.first("_revision").over(match), "_seen": F.lag(F.lit(True)).over(match)}
    told |= {f"_{c}": F.lag(c).over(match) for c in ("topic", "key")}
    again = F.col("_seen").isNotNull() & F.col("_topic").eqNullSafe(F.col("topic")) & F.col("_key").eqNullSafe(F.col("key"))
    return named.withColumns(told).filter((F.col("_revision") == F.col("_newest")) & ~again).select(*messages.columns)


def _short(name: Column) -> Column:
    """A text that is nothing but lower-case hexadecimal digits, as hashes are, in half its bytes; the first byte tells it
    from others."""
    digits = (F.length(name) % 2 == 0) & name.rlike("^[0-9a-f]+$")
    return F.when(digits, F.concat(F.unhex(F.lit("01")), F.unhex(name))).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(name, "UTF-8")))


def write_topic_files(messages: DataFrame, path: str) -> None:
    """One directory per topic; the topic column partitions, so no topic is filtered separately."""
    write_compact(messages, path, "append", ("topic",))


def write_topics(messages: DataFrame, servers: str, **options: str) -> None:
    """All topics through one writer, by the row's topic column; needs the Kafka connector."""
    writer = messages.write.format("kafka").option("kafka.bootstrap.servers", servers)
    writer.options(**producer_options(**options)).save()


def producer_options(**options: str) -> dict[str, str]:
    # Producer settings.
    base = {
        "kafka.enable.idempotence": "true",
        "kafka.acks": "all",
        "kafka.compression.type": "snappy",
        "kafka.linger.ms": "10",
    }
    return {**base, **options}


def stream_topic_files(messages: DataFrame, path: str, checkpoint: str):
    return (
        messages.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("topic")
        .outputMode("append")
    )


def stream_topics(messages: DataFrame, servers: str, checkpoint: str, **options: str):
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .options(**producer_options(**options))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
