"""Dependency changes from event archives and pull-request lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pinwatch import constants as K, schemas
from pinwatch.functions.scalars import (
    bump_title,
    ecosystem_from_branch,
    manifest_for_ecosystem,
    match_id,
    rfc3339,
)


def read_archive(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Hourly gzip files named ``YYYY-MM-DD-H.json.gz`` -> (line, archive_day, archive_hour).

    A gzip file is one task, so the hour files are the unit of parallelism; pass ``partitions`` to
    spread the rows when there are fewer files than cores. A file that vanishes is skipped.
    """
    stamp = r"(\d{4}-\d{2}-\d{2})-(\d{1,2})\.json"
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("ignoreMissingFiles", True)
        .text(path)
        .select(
            F.col("value").alias("line"),
            F.to_date(F.regexp_extract("_metadata.file_path", stamp, 1)).alias("archive_day"),
            F.regexp_extract("_metadata.file_path", stamp, 2).cast("int").alias("archive_hour"),
        )
    )
    return lines.repartition(partitions) if partitions else lines


def date_floor(start: Column) -> Column:
    """No archive day before the floor is worth reading."""
    return F.greatest(start, F.lit(K.ARCHIVE_FLOOR).cast("date"))


def archive_window(lines: DataFrame, start: str, end: str) -> DataFrame:
    """Days of a replay, both ends included, the start clamped to the floor."""
    first = date_floor(F.lit(start).cast("date"))
    return lines.filter(F.col("archive_day").between(first, F.lit(end).cast("date")))


def read_pull_requests(spark: SparkSession, path: str, repo_from: str = r"repo=([^/]+)") -> DataFrame:
    """Closed pull requests, one JSON array per file or line; requests never merged are dropped."""
    requests = spark.read.schema(schemas.PULL_REQUEST).option("recursiveFileLookup", True).json(path)
    repo = F.regexp_replace(F.regexp_extract("_metadata.file_path", repo_from, 1), "%2F", "/")
    return requests.withColumn("repo", repo).filter(F.col("merged_at").isNotNull())


def _change_event(source: str, repo: Column, number: Column, author: Column, ecosystem: Column,
                  bump: Column, occurred_at: Column, ingested_at: Column) -> list[Column]:
    updated = F.array(
        F.struct(
            bump["package"].alias("package"),
            bump["from_version"].alias("from_version"),
            bump["to_version"].alias("to_version"),
        )
    )
    no_pins = F.array().cast(schemas.PINS)
    return [
        match_id(F.lit(source), repo, number, bump["package"], bump["to_version"], occurred_at).alias("event_id"),
        F.lit(source).alias("source"),
        repo.alias("repo"),
        repo.alias("service_id"),
        number.cast("int").alias("pr_number"),
        author.alias("author"),
        ecosystem.alias("ecosystem"),
        manifest_for_ecosystem(ecosystem).alias("manifest_file"),
        no_pins.alias("added"),
        no_pins.alias("removed"),
        updated.alias("updated"),
        occurred_at.alias("occurred_at"),
        ingested_at.alias("ingested_at"),
    ]


def _by_update_bot(login: Column) -> Column:
    lowered = F.lower(F.coalesce(login, F.lit("")))
    return lowered.contains(K.UPDATE_BOTS[0]) | lowered.contains(K.UPDATE_BOTS[1])


def _is_bump(found: Column) -> Column:
    return (found["ecosystem"] != "") & (found["bump"]["package"] != "") & (found["bump"]["to_version"] != "")


def archive_bump_events(lines: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Merged dependency updates of the bots among archive lines, as change events.

    The text test runs before the JSON parse, so nearly all lines are never parsed.
    """
    event = (
        lines.filter(F.col("line").contains("PullRequestEvent"))
        .select(F.from_json("line", schemas.ARCHIVE_EVENT).alias("e"))
        .filter("e.type = 'PullRequestEvent' AND e.payload.action = 'closed' AND e.payload.pull_request.merged")
        .select("e.actor.login", F.col("e.repo.name").alias("repo"), "e.payload.pull_request.*")
        .withColumn("merged_at", rfc3339(F.col("merged_at")))
        .filter(F.col("merged_at") >= F.lit(K.ARCHIVE_FLOOR).cast("timestamp"))
        .filter(_by_update_bot(F.col("login")))
    )
    found = event.withColumn(
        "found",
        F.struct(
            ecosystem_from_branch(F.coalesce("head.ref", F.lit(""))).alias("ecosystem"),
            bump_title(F.coalesce("title", F.lit(""))).alias("bump"),
        ),
    ).filter(_is_bump(F.col("found")))
    return found.select(
        *_change_event(
            "gh_archive",
            F.coalesce("repo", F.lit("")),
            F.coalesce(F.col("number").cast("int"), F.lit(0)),
            F.lower("login"),
            F.col("found.ecosystem"),
            F.col("found.bump"),
            F.col("merged_at"),
            F.col("merged_at") if ingested_at is None else ingested_at,
        )
    )


def pr_bump_events(requests: DataFrame, as_of: Column) -> DataFrame:
    """The same for pull-request lists: the author keeps its case, there is no date floor, and a
    merge time that does not parse becomes ``as_of``."""
    found = (
        requests.filter(F.col("merged_at").isNotNull())
        .filter(_by_update_bot(F.col("user.login")))
        .withColumn(
            "found",
            F.struct(
                ecosystem_from_branch(F.coalesce("head.ref", F.lit(""))).alias("ecosystem"),
                bump_title(F.coalesce("title", F.lit(""))).alias("bump"),
            ),
        )
        .filter(_is_bump(F.col("found")))
    )
    return found.select(
        *_change_event(
            "github_events_api",
            F.col("repo"),
            F.col("number"),
            F.col("user.login"),
            F.col("found.ecosystem"),
            F.col("found.bump"),
            F.coalesce(rfc3339(F.col("merged_at")), as_of),
            as_of,
        )
    )


def union_dep_sources(*events: DataFrame) -> DataFrame:
    first, *rest = events
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def listed_changes(events: DataFrame) -> DataFrame:
    """Change events with their operations as one array, ``changes``.

    Inside an event removals apply first, then additions, then updates (``op_rank`` 0, 1, 2), each
    in array order (``pos``). Entries without a package, or without a version where one is needed,
    change nothing and are left out.
    """

    def ops(field: str, kind: str, rank: int, op: str, version: str | None) -> Column:
        return F.transform(
            F.coalesce(F.col(field), F.array().cast(kind)),
            lambda item, i: F.struct(
                F.lit(rank).alias("op_rank"),
                i.alias("pos"),
                F.lit(op).alias("op"),
                item["package"].alias("package"),
                (item[version] if version else F.lit(None).cast("string")).alias("version"),
            ),
        )

    changes = F.concat(
        ops("removed", schemas.PINS, 0, "removed", None),
        ops("added", schemas.PINS, 1, "added", "version"),
        ops("updated", schemas.UPDATES, 2, "updated", "to_version"),
    )
    return events.select(
        F.coalesce("service_id", F.lit("unknown")).alias("service_id"),
        F.coalesce("ecosystem", F.lit("")).alias("ecosystem"),
        "event_id",
        "occurred_at",
        F.filter(changes, lambda c: (c["package"] != "") & ((c["op"] == "removed") | (c["version"] != ""))).alias("changes"),
    )


def explode_changes(events: DataFrame) -> DataFrame:
    """Change events -> one row per operation."""
    rows = listed_changes(events).select("service_id", "ecosystem", "event_id", "occurred_at", F.explode("changes").alias("c"))
    return rows.select("service_id", "ecosystem", "event_id", "occurred_at", "c.*")
