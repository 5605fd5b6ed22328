"""Indirect dependencies from an edge table (ecosystem, package, depends_on, version): the package pulls in
``depends_on`` at ``version``. Names mean something within their ecosystem only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pinwatch.operators.match import CVE_COLUMNS, match_pins
from pinwatch.session import scratch_path, stored_table

PAIR = ["ecosystem", "package", "depends_on"]


def transitive_closure(edges: DataFrame, start: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(ecosystem, package, depends_on, depth, path, version): everything reachable with its shortest
    path, the smallest of equally short ones, and the version its last step asks for. ``start`` (ecosystem,
    package) limits it to what these packages reach, which is what a service needs.

    Each round extends only the pairs found in the round before and drops pairs already known, so it
    ends on cyclic graphs. All rounds are one table to which a round is a new partition: the plan stays
    the same at any depth, and a lost executor costs at most a round.
    """
    steps = edges.filter("package <> depends_on").groupBy(*PAIR).agg(F.min("version").alias("version"))
    steps = stored_table(steps, "edges")
    first = steps if start is None else steps.join(start.select("ecosystem", "package").distinct(), ["ecosystem", "package"], "left_semi")
    folder, depth = scratch_path(edges.sparkSession, "closure"), 1
    frontier = first.select(*PAIR, F.concat_ws(">", "package", "depends_on").alias("path"), "version")
    schema = frontier.schema
    step = steps.select("ecosystem", F.col("package").alias("depends_on"), F.col("depends_on").alias("to"), F.col("version").alias("_version"))
    while True:
        frontier.write.parquet(f"{folder}/depth={depth}")
        known = edges.sparkSession.read.schema(schema.simpleString()[7:-1].replace(":", " ") + ", depth int").parquet(folder)
        last = edges.sparkSession.read.schema(schema).parquet(f"{folder}/depth={depth}")
        if last.isEmpty() or depth == max_depth:
            return known.select(*PAIR, "depth", "path", "version")
        reached = last.drop("version").join(step, ["ecosystem", "depends_on"]).filter("package <> to")
        shortest = reached.groupBy("ecosystem", "package", F.col("to").alias("depends_on")).agg(
            F.min(F.struct(F.concat_ws(">", "path", "to").alias("path"), F.col("_version").alias("version"))).alias("_best")
        )
        frontier = shortest.select(*PAIR, "_best.path", "_best.version").join(known.select(*PAIR), PAIR, "left_anti")
        depth += 1


def updated_closure(closure: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The closure after edges were added to and removed from those it was made of, and the edges then.

    Only packages from which a changed edge can be reached have other paths than before: its own package, and
    those that reached this one in the old closure (the first changed edge on a path is reached by old
    ones). What these reach is derived anew, all other rows stay as they are. An edge is its package, what it
    depends on and the version; removing one that is not there changes nothing, and an edge that is both added
    and removed stays. ``closure`` has no depth limit.
    """
    edge = [*PAIR, "version"]
    added, removed = added.select(*edge).distinct(), removed.select(*edge).distinct()
    gone = edges.select(*edge).join(removed, edge, "left_semi").join(added, edge, "left_anti").distinct()
    new = added.join(edges.select(*edge), edge, "left_anti")
    changed = stored_table(gone.unionByName(new).select("ecosystem", "package").distinct(), "changed-packages")
    after = stored_table(edges.select(*edge).join(gone, edge, "left_anti").unionByName(new), "edges-after")
    before = closure.join(changed.withColumnRenamed("package", "depends_on"), ["ecosystem", "depends_on"], "left_semi")
    affected = stored_table(before.select("ecosystem", "package").unionByName(changed).distinct(), "affected-packages")
    again = transitive_closure(after, affected)
    stays = closure.join(affected, ["ecosystem", "package"], "left_anti")
    return stays.unionByName(again.select(*closure.columns)), after


def transitive_pins(pins: DataFrame, edges: DataFrame) -> DataFrame:
    """Pins of a service plus what they pull in, with ``is_transitive`` and ``transitive_path``.
    A package the service also holds directly counts as direct, with the version it holds."""
    # Read three times, and as a rule made of all operations.
    pins = stored_table(pins.select("service_id", "ecosystem", "package", "version"), "direct-pins")
    held = pins.select("ecosystem", "package").distinct()
    closure = transitive_closure(edges, held)
    direct = pins.select(
        "service_id", "ecosystem", "package", "version", F.lit(False).alias("is_transitive"), F.col("package").alias("transitive_path"), F.lit(0).alias("depth")
    )
    indirect = pins.select("service_id", "ecosystem", "package").distinct().join(closure, ["ecosystem", "package"]).select(
        "service_id",
        "ecosystem",
        F.col("depends_on").alias("package"),
        "version",
        F.lit(True).alias("is_transitive"),
        F.col("path").alias("transitive_path"),
        "depth",
    )
    best = F.min(F.struct("is_transitive", "depth", "transitive_path", "version")).alias("_best")
    rows = direct.unionByName(indirect).groupBy("service_id", "ecosystem", "package").agg(best)
    return rows.select("service_id", "ecosystem", "package", "_best.version", "_best.is_transitive", "_best.transitive_path")


def transitive_exposure(pins: DataFrame, edges: DataFrame, cves: DataFrame) -> DataFrame:
    """Vulnerabilities of what a service holds, directly or through others, with the way there."""
    everything = stored_table(transitive_pins(pins, edges), "all-pins")
    return match_pins(everything, cves, CVE_COLUMNS)
