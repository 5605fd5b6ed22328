"""Dependency state per service: current pins, validity intervals, snapshots.

Input everywhere is the operation stream of ``explode_changes``: service_id, ecosystem, package,
version, op, occurred_at, event_id, op_rank, pos. The last four order it completely. The ecosystem
belongs to the pin, not to the service, so a service may hold several. ``crowded`` is the result of
``crowded_pins``: the pins with too many operations for one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pinwatch.plans.timeline import KEY_LIMIT, crowded_keys, marked, pick, with_neighbours
from pinwatch.session import stored_table

# Events of one service that meet all its intervals.
EVENT_LIMIT = 256
PIN = ["service_id", "ecosystem", "package"]
ORDER = ["occurred_at", "event_id", "op_rank", "pos"]


def current_pins(ops: DataFrame) -> DataFrame:
    """What each service has now: the last operation per package, removals dropped."""
    last = ops.groupBy(*PIN).agg(F.max(F.struct(*ORDER, "op", "version")).alias("s"))
    return last.filter("s.op <> 'removed'").select(
        *PIN, F.col("s.version").alias("version"), F.col("s.occurred_at").alias("since")
    )


def settled(ops: DataFrame) -> DataFrame:
    """One row per event and package: the state the event leaves behind."""
    return pick(ops, [*PIN, "occurred_at", "event_id"], ["op_rank", "pos"], last=True)


def timeline(ops: DataFrame, crowded: DataFrame | None = None) -> DataFrame:
    """Operations with their neighbours on the same pin."""
    return with_neighbours(ops, PIN, ORDER, ["op", "version"], F.date_trunc("hour", "occurred_at"), crowded)


def crowded_pins(ops: DataFrame, limit: int = KEY_LIMIT) -> DataFrame | None:
    return crowded_keys(ops, PIN, limit)


def validity_intervals(ops: DataFrame, crowded: DataFrame | None = None, mark_new: bool = False) -> DataFrame:
    """``[valid_from, valid_to)`` per pin and version; an open interval has no end. States that an
    operation at the same time replaces never became visible and are left out. With ``mark_new`` they say whether
    the package was absent before the event, whatever the event does step by step."""
    rows = timeline(ops, crowded)
    marks = []
    if mark_new:
        # Partitioned as the timeline is already; what stood before the event's first operation counts.
        event = Window.partitionBy(*PIN, "occurred_at", "event_id").orderBy("op_rank", "pos")
        rows = rows.withColumn("_before", F.first("prev.op").over(event))
        marks = [(F.col("_before").isNull() | (F.col("_before") == "removed")).alias("is_new_dependency")]
    return (
        rows.filter("op <> 'removed'")
        .select(
            *PIN,
            "version",
            F.col("occurred_at").alias("valid_from"),
            F.col("next.occurred_at").alias("valid_to"),
            F.col("event_id").alias("from_event"),
            *marks,
        )
        .filter("valid_to IS NULL OR valid_from < valid_to")
    )


def new_dependencies(ops: DataFrame, crowded: DataFrame | None = None) -> DataFrame:
    """Pins an event introduced: present after it, absent before it. What is left by the event's last operation on the
    pin, and what stood before its first, are both in the timeline, so the operations are exchanged once."""
    event = [*PIN, "occurred_at", "event_id"]
    before = F.first("prev").over(Window.partitionBy(*event).orderBy("op_rank", "pos", "op", "version"))
    same = [F.col(c).eqNullSafe(F.col(f"next.{c}")) for c in ("occurred_at", "event_id")]
    return (
        timeline(ops, crowded)
        .withColumns({"_before": before, "_settled": F.col("next").isNull() | ~(same[0] & same[1])})
        .filter("_settled AND op <> 'removed' AND (_before IS NULL OR _before.op = 'removed')")
        .select(*PIN, "version", "event_id", "occurred_at")
    )


# --- snapshots ------------------------------------------------------------------------------------


def states(ops: DataFrame, crowded: DataFrame | None = None) -> DataFrame:
    """Pins from the event that made them (``start``) up to the one that ended them (``stop``), in the
    order of events, so that a state which another event replaces at the same time is there too."""
    return timeline(ops, crowded).filter("op <> 'removed'").select(
        *PIN,
        "version",
        F.struct("occurred_at", "event_id").alias("start"),
        F.when(F.col("next").isNotNull(), F.struct("next.occurred_at", "next.event_id")).alias("stop"),
    ).filter("stop IS NULL OR start < stop")


def snapshot_rows(ops: DataFrame, events: DataFrame, crowded: DataFrame | None = None) -> DataFrame:
    """The full state after every event, one row per pin."""
    return _by_month(ops, events, crowded).drop("month")


def _by_month(ops: DataFrame, events: DataFrame, crowded: DataFrame | None, limit: int | None = None) -> DataFrame:
    """``snapshot_rows`` with the piece of the service's time, ``month``, in which they were found.

    The events of a service with up to ``limit`` meet all its intervals, each of which travels once. Where there are
    more, an event meets only the intervals that touch its month, so a long history does not multiply into event x
    interval pairs. Sequence is (time, event id), hence events at the same time see each other's effect in order.
    """
    moments = events.filter("occurred_at IS NOT NULL").select("service_id", "event_id", "occurred_at").distinct()
    moments = stored_table(moments, "moments")
    busy = crowded_keys(moments, ["service_id"], limit or EVENT_LIMIT)
    live = states(ops, crowded).filter("start.occurred_at IS NOT NULL")
    if busy is None:
        live, moments = (df.withColumn("last_seen", F.lit(None).cast("timestamp")) for df in (live, moments))
    else:
        seen = moments.join(busy, "service_id", "left_semi").groupBy("service_id").agg(F.max("occurred_at").alias("last_seen"))
        seen = stored_table(seen, "busy-services")
        live, moments = (marked(df, seen, ["service_id"]) for df in (live, moments))
    whole = F.lit("1970-01-01").cast("timestamp")
    month = lambda c: F.when(F.col("last_seen").isNotNull(), F.date_trunc("month", c)).otherwise(whole)
    until = F.coalesce(F.col("stop.occurred_at"), F.greatest("last_seen", "start.occurred_at"))
    months = F.sequence(month("start.occurred_at"), month(until), F.expr("INTERVAL 1 MONTH"))
    by_month = live.select("*", F.explode(months).alias("month")).drop("last_seen")
    at = F.struct("occurred_at", "event_id")
    return (
        moments.withColumn("month", month("occurred_at")).drop("last_seen").join(by_month, ["service_id", "month"])
        .filter((F.col("start") <= at) & (F.col("stop").isNull() | (at < F.col("stop"))))
        .select("service_id", "ecosystem", "package", "version",
                F.col("event_id").alias("trigger_event_id"), F.col("occurred_at").alias("snapshot_at"), "month")
    )


def _maps(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pins -> one map per key and ecosystem. A map is one value and holds what one service holds; rows
    per pin (``current_pins``, ``snapshot_rows``) are the form for anything larger than a message."""
    entries = F.sort_array(F.collect_list(F.struct("package", "version")))
    return rows.groupBy(*keys, "ecosystem").agg(F.map_from_entries(entries).alias("dependencies"))


def snapshot_maps(ops: DataFrame) -> DataFrame:
    """Current state of a service as package -> version maps, one per ecosystem."""
    return _maps(current_pins(ops), ["service_id"])


def snapshot_history(ops: DataFrame, events: DataFrame, crowded: DataFrame | None = None) -> DataFrame:
    # With the month the rows of a map are together already.
    return _maps(_by_month(ops, events, crowded), ["service_id", "month", "trigger_event_id", "snapshot_at"]).drop("month")


def latest_state(ops: DataFrame, events: DataFrame) -> DataFrame:
    """What the snapshots after each service's last event hold, one row per pin: the current pins with
    that event. Two aggregates; no earlier snapshot is built."""
    last = pick(events.select("service_id", "event_id", "occurred_at"), ["service_id"], ["occurred_at", "event_id"], last=True)
    return current_pins(ops).drop("since").join(last, "service_id").select(
        *PIN, "version", F.col("event_id").alias("trigger_event_id"), F.col("occurred_at").alias("snapshot_at")
    )


def stored_snapshots(states: DataFrame) -> DataFrame:
    """Snapshot rows in the shape of the stored table: one row per snapshot and ecosystem."""
    maps = _maps(states, ["service_id", "trigger_event_id", "snapshot_at"])
    return maps.select(F.col("trigger_event_id").alias("snapshot_id"), "service_id", "ecosystem", "dependencies", "snapshot_at")


def empty_snapshots(ops: DataFrame, events: DataFrame) -> DataFrame:
    """The stored snapshots of services whose last event leaves no pin: without ecosystem and empty, so
    that no older one counts as their newest."""
    last = pick(events.select("service_id", "event_id", "occurred_at"), ["service_id"], ["occurred_at", "event_id"], last=True)
    return last.join(current_pins(ops), "service_id", "left_anti").select(
        F.col("event_id").alias("snapshot_id"), "service_id", F.lit("").alias("ecosystem"),
        F.create_map().cast("map<string, string>").alias("dependencies"), F.col("occurred_at").alias("snapshot_at"),
    )


def latest_snapshot(snapshots: DataFrame, service_id: str | None = None) -> DataFrame:
    """Newest stored snapshot per service, or of one service: all rows of it, one per ecosystem."""
    if service_id is not None:
        snapshots = snapshots.filter(F.col("service_id") == service_id)
    newest = snapshots.groupBy("service_id").agg(F.max(F.struct("snapshot_at", "snapshot_id")).alias("_newest"))
    newest = newest.select("service_id", "_newest.snapshot_at", "_newest.snapshot_id")
    return snapshots.join(newest, ["service_id", "snapshot_at", "snapshot_id"], "left_semi")
