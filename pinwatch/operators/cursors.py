"""Load bookkeeping: what changed since a cursor, where the next load starts, what was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F


def modified_since(index: DataFrame, cursor: Column) -> DataFrame:
    """Strictly newer than the cursor."""
    return index.filter(F.col("modified_at") > cursor)


def changed_ids_fetch(corpus: DataFrame, changed: DataFrame) -> DataFrame:
    """Full records of the changed ids."""
    return corpus.join(changed.select("id"), "id", "left_semi")


def bulk_load_stats(records: DataFrame) -> DataFrame:
    """Records and newest change per ecosystem, and over all of them (ecosystem ``*``)."""
    stats = records.rollup("ecosystem").agg(
        F.count("*").alias("records"), F.max("modified_at").alias("max_modified"),
        F.grouping("ecosystem").alias("_total"),
    )
    name = F.when(F.col("_total") == 1, F.lit("*")).otherwise(F.col("ecosystem"))
    return stats.select(name.alias("ecosystem"), "records", "max_modified")


def next_cursor(records: DataFrame, ecosystems: DataFrame, as_of: Column, fallback_days: int = 30) -> DataFrame:
    """Start of the next load per ecosystem: its newest change, or ``fallback_days`` back where
    nothing was loaded."""
    newest = records.groupBy("ecosystem").agg(F.max("modified_at").alias("newest"))
    joined = ecosystems.select("ecosystem").distinct().join(newest, "ecosystem", "left")
    fallback = as_of - F.make_dt_interval(days=F.lit(fallback_days))
    return joined.select("ecosystem", F.coalesce("newest", fallback).alias("cursor"))


def poll_start(cursors: DataFrame, feeds: DataFrame, as_of: Column, fallback_hours: int = 24) -> DataFrame:
    """Where an incremental poll starts: the stored cursor of the feed, or ``fallback_hours`` back for a
    feed that was never read."""
    stored = cursors.groupBy("feed").agg(F.max("cursor").alias("stored"))
    joined = feeds.select("feed").distinct().join(stored, "feed", "left")
    return joined.select("feed", F.coalesce("stored", as_of - F.make_dt_interval(hours=F.lit(fallback_hours))).alias("cursor"))


def replay_counts(lines: DataFrame) -> DataFrame:
    """Events per archive hour with the running total of the replay. The window sees one row per
    hour, not the events."""
    hourly = lines.groupBy("archive_day", "archive_hour").agg(F.count("*").alias("events"))
    by_day = F.sum("events").over(Window.partitionBy("archive_day"))
    running = Window.orderBy("archive_day", "archive_hour").rowsBetween(Window.unboundedPreceding, 0)
    return hourly.select("archive_day", "archive_hour", "events", by_day.alias("day_events"),
                         F.sum("events").over(running).alias("total_events"))


def observed_poll(rows: DataFrame, published: Column, sources: list[str], observation: Observation | str) -> DataFrame:
    """``rows`` with the figures of ``poll_summary`` as observed metrics: whoever writes the rows gets them from the
    same pass. ``observation`` is that of a batch, or the name under which a stream reports them for every trigger.
    The sources are known, since metrics have names."""
    taken = F.coalesce(published, F.lit(False))
    metrics = []
    for source in sources:
        own = F.col("source") == source
        metrics.append(F.count(F.when(own, 1)).alias(f"{source}_fetched"))
        metrics.append(F.count(F.when(own & taken, 1)).alias(f"{source}_published"))
    return rows.observe(observation, *metrics)


def observed_summary(metrics: list[dict[str, int]], sources: list[str]) -> list[tuple[str, int, int, int]]:
    """(source, fetched, published, skipped) from the metrics of a write, or of the triggers of a stream; sources
    without records are left out."""
    total = {source: [sum(m[f"{source}_{kind}"] for m in metrics) for kind in ("fetched", "published")] for source in sources}
    return [(source, fetched, published, fetched - published) for source, (fetched, published) in total.items() if fetched]


def poll_summary(rows: DataFrame, published: Column) -> DataFrame:
    """Fetched, published and skipped per source."""
    return rows.groupBy("source").agg(
        F.count("*").alias("fetched"),
        F.count(F.when(published, F.lit(1))).alias("published"),
        F.count(F.when(~F.coalesce(published, F.lit(False)), F.lit(1))).alias("skipped"),
    )
