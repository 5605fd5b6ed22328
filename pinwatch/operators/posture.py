"""Posture figures over the stored matches. ``as_of`` is always given, never the clock.

Aggregates combine before their shuffle. Windows run over daily totals only, whose number is the
number of days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pinwatch import constants as K
from pinwatch.operators.scoring import registry_enrich
from pinwatch.plans.timeline import pick


def _moment(as_of: str | Column) -> Column:
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of


def _seconds(later: str, earlier: str) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def is_open(as_of) -> Column:
    """Detected by then, not accepted as a risk, and not resolved until after it."""
    at = _moment(as_of)
    unresolved = F.col("resolved_at").isNull() | (F.col("resolved_at") > at)
    return (F.col("detected_at") <= at) & unresolved & (F.col("status") != "accepted_risk")


def _resolved(as_of) -> Column:
    return F.coalesce(F.col("resolved_at") <= _moment(as_of), F.lit(False))


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def _open_by_tier(as_of) -> list[Column]:
    return [
        _count_if(is_open(as_of) & (F.col("blast_radius") == tier)).alias(f"open_{tier.lower()}") for tier in K.TIERS
    ]


def _past_sla(as_of) -> Column:
    return _count_if(is_open(as_of) & (F.col("sla_deadline") < _moment(as_of))).alias("past_sla_count")


def _mttd() -> Column:
    return F.round(F.avg(_seconds("detected_at", "published_at") / 60.0), 2).alias("mttd_minutes")


def _mttr(as_of) -> Column:
    days = F.when(_resolved(as_of), _seconds("resolved_at", "detected_at") / 86400.0)
    return F.round(F.avg(days), 2).alias("mttr_days")


def open_counts(matches: DataFrame, as_of) -> DataFrame:
    return matches.agg(*_open_by_tier(as_of))


def past_sla(matches: DataFrame, as_of) -> DataFrame:
    return matches.agg(_past_sla(as_of))


def mttd_minutes(matches: DataFrame) -> DataFrame:
    return matches.agg(_mttd())


def mttr_days(matches: DataFrame, as_of) -> DataFrame:
    return matches.agg(_mttr(as_of))


def breakdown(matches: DataFrame, registry: DataFrame) -> DataFrame:
    """Counts by tier, by service, by team and by status, in one pass over the matches.

    The dimension table meets the per-service totals, not the matches.
    """
    totals = matches.groupBy("service_id", "blast_radius", "status").agg(F.count("*").alias("n"))
    rows = registry_enrich(totals, registry)
    dims = {"tier": "blast_radius", "service": "service_id", "team": "team", "status": "status"}
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(v).alias("value")) for k, v in dims.items()])
    return rows.select("n", F.inline(pairs)).groupBy("dimension", "value").agg(F.sum("n").alias("findings"))


def _window_counts(as_of, days: int) -> tuple[Column, Column]:
    at = _moment(as_of)
    start, before = (at - F.make_dt_interval(days=F.lit(d)) for d in (days, 2 * days))
    current = _count_if((F.col("detected_at") > start) & (F.col("detected_at") <= at))
    previous = _count_if((F.col("detected_at") > before) & (F.col("detected_at") <= start))
    return current, previous


def _direction(current: Column, previous: Column) -> Column:
    return F.when(current > previous, "worsening").when(current < previous, "improving").otherwise("stable")


def trend(matches: DataFrame, as_of) -> DataFrame:
    """Detections of the last 7, 30 and 90 days against the same span before."""
    figures = []
    for days in K.TREND_DAYS:
        current, previous = _window_counts(as_of, days)
        figures.append(F.struct(F.lit(days).alias("days"), current.alias("current_n"), previous.alias("previous_n")))
    rows = matches.agg(F.array(*figures).alias("f")).select(F.inline("f"))
    return rows.withColumn("direction", _direction(F.col("current_n"), F.col("previous_n")))


def _per_service_tier(matches: DataFrame, as_of) -> DataFrame:
    return matches.groupBy("service_id").agg(*_open_by_tier(as_of))


def team_exposure(matches: DataFrame, registry: DataFrame, as_of) -> DataFrame:
    """Open findings by team and tier; per-service totals first, so the join is small."""
    rows = registry_enrich(_per_service_tier(matches, as_of), registry)
    columns = [f"open_{tier.lower()}" for tier in K.TIERS]
    return rows.groupBy("team").agg(*[F.sum(c).alias(c) for c in columns])


def blast_radius_heatmap(matches: DataFrame, as_of) -> DataFrame:
    return _per_service_tier(matches, as_of)


def sla_compliance_by_team(matches: DataFrame, registry: DataFrame, as_of) -> DataFrame:
    """Share of resolved findings that met their deadline."""
    resolved = matches.filter(_resolved(as_of))
    per_service = resolved.groupBy("service_id").agg(
        F.count("*").alias("resolved"), _count_if(F.col("resolved_at") <= F.col("sla_deadline")).alias("in_time")
    )
    teams = registry_enrich(per_service, registry).groupBy("team").agg(
        F.sum("resolved").alias("resolved"), F.sum("in_time").alias("in_time")
    )
    return teams.withColumn("compliance", F.round(F.col("in_time") / F.col("resolved"), 4))


def cve_match_rate(vulnerabilities: DataFrame, matches: DataFrame) -> DataFrame:
    """Per month of publication, the share of vulnerabilities with at least one match."""
    first_seen = vulnerabilities.groupBy("cve_id").agg(F.min("ingested_at").alias("seen"))
    matched = matches.select("cve_id").distinct().withColumn("hit", F.lit(1))
    joined = first_seen.join(matched, "cve_id", "left")
    monthly = joined.groupBy(F.date_format("seen", "yyyy-MM").alias("period")).agg(
        F.count("*").alias("cves"), F.count("hit").alias("matched")
    )
    return monthly.withColumn("match_rate", F.round(F.col("matched") / F.col("cves"), 4))


def detections_by_ecosystem(vulnerabilities: DataFrame) -> DataFrame:
    """New vulnerabilities per ecosystem and day of first sight."""
    first_seen = vulnerabilities.groupBy("ecosystem", "cve_id").agg(F.min("ingested_at").alias("seen"))
    return first_seen.groupBy("ecosystem", F.to_date("seen").alias("day")).agg(F.count("*").alias("new_cves"))


def confidence_histogram(reports: DataFrame, buckets: int = 10) -> DataFrame:
    """Counts over equal-width buckets of [0, 1]; 1.0 falls into the last one."""
    bucket = F.least(F.width_bucket("confidence_score", F.lit(0.0), F.lit(1.0), F.lit(buckets)), F.lit(buckets))
    return reports.groupBy(bucket.cast("bigint").alias("bucket")).agg(F.count("*").alias("reports"))


def mttd_rolling(matches: DataFrame, days: int = 30) -> DataFrame:
    """Mean time to detect over the trailing ``days``, per day with detections."""
    daily = matches.groupBy(F.to_date("detected_at").alias("day")).agg(
        F.sum(_seconds("detected_at", "published_at") / 60.0).alias("minutes"), F.count("*").alias("n")
    )
    trailing = Window.orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    mean = F.sum("minutes").over(trailing) / F.sum("n").over(trailing)
    return daily.select("day", F.round(mean, 4).alias("mttd_minutes"))


def open_over_time(matches: DataFrame) -> DataFrame:
    """Open findings by tier at the end of each day on which the number changed hands."""
    changes = matches.filter("status <> 'accepted_risk'").select(
        "blast_radius",
        F.explode(
            F.array(
                F.struct(F.to_date("detected_at").alias("day"), F.lit(1).alias("delta")),
                F.struct(F.to_date("resolved_at").alias("day"), F.lit(-1).alias("delta")),
            )
        ).alias("c"),
    )
    daily = changes.filter("c.day IS NOT NULL").groupBy("blast_radius", "c.day").agg(F.sum("c.delta").alias("delta"))
    running = Window.partitionBy("blast_radius").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("blast_radius", "day", F.sum("delta").over(running).alias("open_findings"))


def team_totals(matches: DataFrame, registry: DataFrame, as_of) -> DataFrame:
    """One row: open findings by team, as a map."""
    rows = team_exposure(matches, registry, as_of)
    total = sum((F.col(f"open_{tier.lower()}") for tier in K.TIERS), F.lit(0)).cast("bigint")
    entries = F.sort_array(F.collect_list(F.struct(F.col("team"), total.alias("n"))))
    return rows.filter(total > 0).agg(F.map_from_entries(entries).alias("team_exposure"))


def framework_totals(matches: DataFrame, registry: DataFrame, as_of) -> DataFrame:
    """One row: open findings of services in scope by framework, as a map. Per-service totals first."""
    rows = registry_enrich(_per_service_tier(matches, as_of), registry)
    total = sum((F.col(f"open_{tier.lower()}") for tier in K.TIERS), F.lit(0)).cast("bigint")
    flags = dict((name, flag) for name, flag, _ in K.FRAMEWORK_CONTROLS if flag)
    sums = rows.agg(*[F.coalesce(F.sum(F.when(F.col(flag), total)), F.lit(0)).alias(name) for name, flag in flags.items()])
    return sums.select(F.create_map(*[x for name in flags for x in (F.lit(name), F.col(name))]).alias("compliance_gaps"))


def report(matches: DataFrame, as_of, period_days: int = 30, registry: DataFrame | None = None) -> DataFrame:
    """One row in the shape of the stored posture reports, from a single pass over the matches; with the
    registry also the open findings by team and by framework."""
    current, previous = _window_counts(as_of, period_days)
    figures = matches.agg(
        *_open_by_tier(as_of), _past_sla(as_of), _mttd(), _mttr(as_of), current.alias("_c"), previous.alias("_p")
    )
    return figures.select(
        F.sha2(F.concat_ws("|", _moment(as_of).cast("string"), F.lit(period_days)), 256).alias("report_id"),
        _moment(as_of).alias("generated_at"),
        F.lit(period_days).alias("period_days"),
        *[f"open_{tier.lower()}" for tier in K.TIERS],
        "past_sla_count",
        "mttd_minutes",
        "mttr_days",
        _direction(F.col("_c"), F.col("_p")).alias("trend_direction"),
    ) if registry is None else _with_totals(report(matches, as_of, period_days), matches, registry, as_of)


def _with_totals(row: DataFrame, matches: DataFrame, registry: DataFrame, as_of) -> DataFrame:
    """Three single rows side by side, joined on a constant."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    teams, gaps = team_totals(matches, registry, as_of), framework_totals(matches, registry, as_of)
    return one(row).join(one(gaps), "_one").join(one(teams), "_one").drop("_one")


def latest_report(reports: DataFrame) -> DataFrame:
    return pick(reports.withColumn("_all", F.lit(1)), ["_all"], ["generated_at", "report_id"], last=True).drop("_all")
