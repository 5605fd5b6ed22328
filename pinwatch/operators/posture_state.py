"""Posture kept up to date: signed changes by service, tier and day in place of a pass over all findings.

A finding changes the figures on few days: when it is detected, when its deadline passes, when it is
resolved. A change of a finding, such as a late resolution, adds what it says now and takes back what it
said before. The state holds one row per service, tier and day, days long past summed into one; a new
day's report needs the state and the changes that came in. Days are midnights: a report at a midnight
counts what happened up to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pinwatch import constants as K
from pinwatch.operators.posture import _direction
from pinwatch.operators.scoring import registry_enrich

KEY = ["service_id", "blast_radius", "day"]
FIGURES = ["open", "overdue", "detected", "detect_micros", "detect_n", "resolve_micros", "resolve_n"]
STATE = ", ".join([f"{KEY[0]} STRING, {KEY[1]} STRING, {KEY[2]} DATE", *[f"{f} BIGINT" for f in FIGURES]])


def _first_midnight(moment: Column) -> Column:
    """The first midnight at or after a moment."""
    day = F.to_date(moment)
    return F.when(moment > day.cast("timestamp"), F.date_add(day, 1)).otherwise(day)


def deltas(matches: DataFrame) -> DataFrame:
    """What findings add to the figures, by service, tier and day. Figures that hold from the start of a
    finding on any day, such as the time to its detection, are on the day of its detection, and on a day
    before all others where it has none."""
    ever = F.lit("0001-01-01").cast("date")
    seen = _first_midnight(F.col("detected_at"))
    gone = _first_midnight(F.greatest("resolved_at", "detected_at"))
    due = F.greatest(seen, F.date_add(F.to_date("sla_deadline"), 1))
    counted = F.coalesce(F.col("status") != "accepted_risk", F.lit(False)) & F.col("detected_at").isNotNull()
    resolved = F.col("resolved_at").isNotNull()
    late = counted & F.col("sla_deadline").isNotNull() & (~resolved | (due < gone))
    took = lambda later, earlier: F.unix_micros(later) - F.unix_micros(earlier)
    found = took("detected_at", "published_at")
    closed = took("resolved_at", "detected_at")
    nothing = {f: F.lit(0).cast("bigint") for f in FIGURES}

    def entry(day: Column, holds: Column, **figures) -> Column:
        values = {**nothing, **{name: F.coalesce(value.cast("bigint"), F.lit(0)) for name, value in figures.items()}}
        return F.when(holds, F.struct(day.alias("day"), *[values[f].alias(f) for f in FIGURES]))

    one = F.lit(1)
    entries = F.array(
        entry(F.coalesce(seen, ever), F.lit(True), open=F.when(counted, one), detected=F.when(seen.isNotNull(), one), detect_micros=found, detect_n=F.when(found.isNotNull(), one)),
        entry(gone, counted & resolved, open=-one),
        entry(due, late, overdue=one),
        entry(gone, late & resolved, overdue=-one),
        entry(_first_midnight(F.col("resolved_at")), resolved, resolve_micros=closed, resolve_n=F.when(closed.isNotNull(), one)),
    )
    rows = matches.select("service_id", "blast_radius", F.inline(F.filter(entries, lambda e: e.isNotNull())))
    return _summed(rows)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(*[F.sum(f).alias(f) for f in FIGURES])


def change_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed findings add: their rows as they are now, less their rows as they were."""
    taken = deltas(before).select(*KEY, *[(-F.col(f)).alias(f) for f in FIGURES])
    return _summed(deltas(after).unionByName(taken))


def advanced(state: DataFrame, changes: DataFrame, day: str, keep_days: int = 180) -> DataFrame:
    """The state with changes taken in, and days more than ``keep_days`` before ``day`` summed into one. Later days
    are kept apart, since deadlines lie ahead."""
    floor = F.date_sub(F.lit(day).cast("date"), keep_days)
    rows = state.unionByName(changes.select(*state.columns))
    return _summed(rows.withColumn("day", F.greatest("day", floor))).filter(" OR ".join(f"{f} <> 0" for f in FIGURES))


def report(state: DataFrame, as_of: str, period_days: int = 30, registry: DataFrame | None = None) -> DataFrame:
    """The row that :func:`pinwatch.operators.posture.report` makes of all findings, from the state. ``as_of`` is a
    midnight, and twice the period lies within the days that the state keeps apart."""
    at = F.lit(as_of).cast("date")
    by_service = state.groupBy("service_id", "blast_radius").agg(
        *[F.coalesce(F.sum(F.when(F.col("day") <= at, F.col(f))), F.lit(0)).alias(f) for f in ("open", "overdue", "resolve_micros", "resolve_n")],
        *[F.sum(f).alias(f) for f in ("detect_micros", "detect_n")],
        *[F.coalesce(F.sum(F.when((F.col("day") > F.date_sub(at, start)) & (F.col("day") <= F.date_sub(at, end)), F.col("detected"))), F.lit(0)).alias(name)
          for name, start, end in (("_c", period_days, 0), ("_p", 2 * period_days, period_days))],
    )
    tiers = [F.coalesce(F.sum(F.when(F.col("blast_radius") == tier, F.col("open"))), F.lit(0)).alias(f"open_{tier.lower()}") for tier in K.TIERS]
    mean = lambda micros, n, unit: F.round(F.sum(micros) / F.when(F.sum(n) > 0, F.sum(n)) / F.lit(unit), 2)
    row = by_service.agg(
        *tiers, F.coalesce(F.sum("overdue"), F.lit(0)).alias("past_sla_count"), mean("detect_micros", "detect_n", 6e7).alias("mttd_minutes"),
        mean("resolve_micros", "resolve_n", 8.64e10).alias("mttr_days"), F.coalesce(F.sum("_c"), F.lit(0)).alias("_c"), F.coalesce(F.sum("_p"), F.lit(0)).alias("_p"),
    )
    moment = F.lit(as_of).cast("timestamp")
    row = row.select(
        F.sha2(F.concat_ws("|", moment.cast("string"), F.lit(period_days)), 256).alias("report_id"), moment.alias("generated_at"),
        F.lit(period_days).alias("period_days"), *[f"open_{tier.lower()}" for tier in K.TIERS], "past_sla_count", "mttd_minutes", "mttr_days",
        _direction(F.col("_c"), F.col("_p")).alias("trend_direction"),
    )
    if registry is None:
        return row
    open_now = registry_enrich(by_service.groupBy("service_id").agg(F.sum("open").alias("n")), registry)
    flags = {name: flag for name, flag, _ in K.FRAMEWORK_CONTROLS if flag}
    gaps = open_now.agg(*[F.coalesce(F.sum(F.when(F.col(flag), F.col("n"))), F.lit(0)).alias(name) for name, flag in flags.items()])
    gaps = gaps.select(F.create_map(*[x for name in flags for x in (F.lit(name), F.col(name))]).alias("compliance_gaps"))
    teams = open_now.groupBy("team").agg(F.sum("n").alias("n")).filter("n > 0")
    teams = teams.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("team", "n")))).alias("team_exposure"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(row).join(one(gaps), "_one").join(one(teams), "_one").drop("_one")


def open_over_time(state: DataFrame, days: int, as_of: str) -> DataFrame:
    """Open findings by tier at each of the last ``days`` midnights up to ``as_of``, from the state."""
    at = F.lit(as_of).cast("date")
    midnights = F.explode(F.sequence(F.date_sub(at, days - 1), at))
    daily = state.groupBy("blast_radius", "day").agg(F.sum("open").alias("open"))
    # A tier has one row per day kept apart, which meets the few midnights after it.
    reached = daily.withColumn("midnight", midnights).filter("day <= midnight")
    return reached.groupBy("blast_radius", F.col("midnight").alias("day")).agg(F.sum("open").alias("open_findings"))
