"""Connected components of an edge table, round by round in stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pinwatch.session import stored_table


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (LONG columns ``u, v``); the label is the component's
    smallest node.

    Every round takes the smallest label among the neighbours and then the label of that label, so
    long chains shrink by more than half. Labels are minima, which combine before they are shuffled;
    each round is a table in the shared folder, so neither the plan nor what a lost executor costs grows.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = stored_table(both.filter("u <> v").distinct(), "edges")
    labels = stored_table(
        both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near")).select("node", F.least("node", "near").alias("label")), "labels"
    )
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = stored_table(lower, "labels")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = lower.join(jump, "label").select("node", "old", F.least("label", "further").alias("label"))
        moved = stored_table(moved, "labels")
        labels = moved.select("node", "label")
        if moved.filter("label <> old").isEmpty():
            return labels
