"""Ordered operators that survive one key holding a large share of the rows.

A plain window over a key puts all its rows into one task. Keys small enough for that are ordered
that way, in one exchange. Crowded keys, which ``crowded_keys`` finds by a count that combines on the
map side, are ordered inside (key, time bucket) instead, and each bucket gets the last record of the
bucket before it and the first of the one after as marker rows. Per key there are only as many markers
as buckets in the covered time. Both ways give the same rows. ``spread_join`` does for joins what this
does for windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pinwatch.session import stored_table

# Rows of one key that a task orders without trouble.
KEY_LIMIT = 1_000_000
# Pairs of one key that a task compares without trouble.
PAIR_LIMIT = 50_000_000
# Crowded keys are at most rows / KEY_LIMIT; up to this many of them are broadcast.
BROADCAST_ROWS = 100_000


def _crowded_counts(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    if df.count() <= limit:
        return None
    # Counted by a number first, which is a few bytes for each key; keys are told apart only where a number has too many.
    number = F.xxhash64(*keys)
    counts = df.groupBy(number.alias("_number")).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    likely = stored_table(counts.select("_number"), "crowded-numbers")
    if likely.isEmpty():
        return None
    named = df.withColumn("_number", number).join(likely, "_number", "left_semi").groupBy(*keys).agg(F.count("*").alias("_n"))
    stored = stored_table(named.filter(F.col("_n") > limit), "crowded-keys")
    return None if stored.isEmpty() else stored


def crowded_keys(df: DataFrame, keys: list[str], limit: int = KEY_LIMIT) -> DataFrame | None:
    """Keys with more than ``limit`` rows, as a stored table; None when there are none."""
    counts = _crowded_counts(df, keys, limit)
    return None if counts is None else counts.select(*keys)


def marked(df: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the marks of its crowded keys; they are broadcast if counted to be few."""
    return df.join(F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks, keys, "left")


def shares_by_rows(sized: DataFrame, keys: list[str], limit: int = KEY_LIMIT) -> DataFrame | None:
    """Shares of about ``limit`` rows for the keys that have more; None when there are none."""
    counts = _crowded_counts(sized, keys, limit)
    if counts is None:
        return None
    return counts.select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_shares"))


def shares_by_pairs(left: DataFrame, right: DataFrame, keys: list[str], limit: int = PAIR_LIMIT) -> DataFrame | None:
    """Shares of about ``limit`` pairs for the keys whose rows of both sides make more."""
    lefts = left.groupBy(*keys).agg(F.count("*").cast("double").alias("_l"))
    rights = right.groupBy(*keys).agg(F.count("*").cast("double").alias("_r"))
    pairs = F.col("_l") * F.col("_r")
    many = lefts.join(rights, keys).filter(pairs > limit)
    stored = stored_table(many.select(*keys, F.least(F.ceil(pairs / limit), "_l").cast("int").alias("_shares")), "shares")
    return None if stored.isEmpty() else stored


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], shares: DataFrame | None) -> DataFrame:
    """Inner join on ``keys`` in which no key is one task's alone.

    Each left row of a key with shares goes to one of them, each right row to all of them, so every
    pair still meets exactly once. All other keys have a single share.
    """
    if shares is None:
        return left.join(right, keys)
    number = F.coalesce("_shares", F.lit(1))
    one = marked(left, shares, keys).withColumn("_share", F.pmod(F.xxhash64(*left.columns), number).cast("int"))
    every = marked(right, shares, keys).withColumn("_share", F.explode(F.sequence(F.lit(0), number - 1)))
    return one.drop("_shares").join(every.drop("_shares"), [*keys, "_share"]).drop("_share")


def with_neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    carry: list[str],
    bucket: Column,
    crowded: DataFrame | None = None,
) -> DataFrame:
    """Add ``prev`` and ``next``: structs of the order and carried columns of the adjacent rows.

    ``crowded`` lists the keys (or leading parts of keys) to be split by ``bucket``.
    """
    record = list(dict.fromkeys([*order, *carry]))
    if crowded is None:
        # Taken column by column: a struct would be made before the exchange, and cross it beside its own columns.
        whole = Window.partitionBy(*keys).orderBy(*order, *carry)
        beside = lambda move: F.when(move(F.lit(True)).over(whole), F.struct(*[move(c).over(whole).alias(c) for c in record]))
        return df.withColumns({"prev": beside(F.lag), "next": beside(F.lead)})
    rows = df.withColumn("_rec", F.struct(*record))
    flagged = crowded.withColumn("_crowded", F.lit(True))
    rows = marked(rows, flagged, crowded.columns).withColumn("_bucket", F.when(F.col("_crowded"), bucket)).drop("_crowded")
    split = rows.filter("_bucket IS NOT NULL")
    edges = split.groupBy(*keys, "_bucket").agg(F.min("_rec").alias("_first"), F.max("_rec").alias("_last"))
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    markers = (
        edges.withColumn("_before", F.lag("_last").over(by_bucket))
        .withColumn("_after", F.lead("_first").over(by_bucket))
        .select(*keys, "_bucket", F.explode(F.array("_before", "_after")).alias("_rec"))
        .filter("_rec IS NOT NULL")
        .withColumn("_marker", F.lit(True))
    )
    everything = rows.withColumn("_marker", F.lit(False)).unionByName(markers, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_rec")
    return (
        everything.withColumn("prev", F.lag("_rec").over(inside))
        .withColumn("next", F.lead("_rec").over(inside))
        .filter("NOT _marker")
        .drop("_bucket", "_rec", "_marker")
    )


def pick(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """First (or last) row per key as an aggregate, which reduces before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if set(rest) <= set(order) and not set(order) & set(keys):
        chosen = df.groupBy(*keys).agg((F.max if last else F.min)(F.struct(*order)).alias("_row"))  # the order says it all
    else:
        chooser = F.max_by if last else F.min_by
        chosen = df.groupBy(*keys).agg(chooser(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def successors(targets: DataFrame, probes: DataFrame, keys: list[str], width: int = 3_600_000_000) -> DataFrame:
    """(keys, at, to) for the distinct ``probes`` (keys, at) that have one: the first of ``targets`` at or
    after. Times are numbers; the search runs inside blocks of ``width``, each of which knows the first
    target after it, so no key is one task's alone."""
    block = lambda c: F.floor(c / F.lit(width)).alias("block")
    none = F.lit(None).cast("bigint")
    data = targets.select(*keys, "at").distinct().select(*keys, block(F.col("at")), F.col("at").alias("t"), F.col("at").alias("target"), none.alias("origin"))
    asked = probes.select(*keys, "at").distinct().select(*keys, block(F.col("at")), F.col("at").alias("t"), none.alias("target"), F.col("at").alias("origin"))
    both = data.unionByName(asked)
    heads = both.groupBy(*keys, "block").agg(F.min("target").alias("head"))
    later = Window.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    markers = heads.withColumn("target", F.last("head", ignorenulls=True).over(later)).filter("target IS NOT NULL").select(
        *keys, "block", F.col("target").alias("t"), "target", none.alias("origin")
    )
    # Descending, so that the nearest later target is the last one seen; targets precede equal probes.
    backwards = (
        Window.partitionBy(*keys, "block")
        .orderBy(F.desc("t"), F.col("origin").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    linked = both.unionByName(markers).withColumn("to", F.last("target", ignorenulls=True).over(backwards))
    return linked.filter("origin IS NOT NULL AND to IS NOT NULL").select(*keys, F.col("origin").alias("at"), "to")
