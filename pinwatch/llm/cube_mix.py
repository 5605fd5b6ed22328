"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is ``r`` times its size takes every document ``floor(r)`` times, and some of them
once more: each document carries ``r - floor(r)`` as its probability to be among these. The flight phase
moves these probabilities until they are 0 or 1. Each move stays in the null space of the constraints,
the source's total of words and its number of documents, which therefore keep their expected values;
a random choice between both ends of the way keeps each document's own probability.

Two constraints leave a way for any three documents. Documents of a source are dealt by a hash into
buckets, and each bucket leaves at most two documents open; these meet in further rounds, until a
source has at most two. This last landing problem is solved by words: the mix takes that part of the open documents'
words that their probabilities say. So a source's words differ from its target by rounding alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pinwatch.llm import blocks
from pinwatch.llm.blocks import _U
from pinwatch.session import stored_table

#: Weights of the sources in order, again and again.
WEIGHTS = (5, 2, 1)
#: Words of the mix in percent of all words, and the most that a source gives, in times its size.
SHARE, MOST_TIMES = 100, 3
#: Documents of a bucket, about; and sources of a partition of their ranking.
BUCKET, RANKED = 2048, 100_000
#: Probabilities this close to 0 or 1 are taken for these.
_SMALL = 1e-9


def _move(sizes: list[int], chances: list[float], draw: float) -> list[float]:
    """One step along the null space of ``sizes`` and ones, to either end of the way."""
    if len(sizes) == 3 and not sizes[0] == sizes[1] == sizes[2]:
        way = [sizes[1] - sizes[2], sizes[2] - sizes[0], sizes[0] - sizes[1]]
    else:
        way = [1, -1, *[0] * (len(sizes) - 2)]
    up = min((1 - c) / w if w > 0 else -c / w for c, w in zip(chances, way, strict=True) if w)
    down = min(c / w if w > 0 else (c - 1) / w for c, w in zip(chances, way, strict=True) if w)
    step = up if draw * (up + down) < down else -down
    moved = [c + step * w for c, w in zip(chances, way, strict=True)]
    return [0.0 if c < _SMALL else 1.0 if c > 1 - _SMALL else c for c in moved]


def flight(sizes: np.ndarray, chances: np.ndarray, seed: int) -> np.ndarray:
    """Chances moved until at most two are neither 0 nor 1. Their sum and their sum weighted by ``sizes``
    stay as they are, and the mean over seeds of each is what it was."""
    out = chances.astype(np.float64).copy()
    draws = (blocks.mix(np.arange(2 * len(sizes) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed & (1 << 64) - 1)) >> _U(11)) * 2.0**-53
    coming = iter(np.flatnonzero((out > 0) & (out < 1)).tolist())
    held: list[int] = []
    for draw in draws.tolist():
        while len(held) < 3 and (i := next(coming, None)) is not None:
            held.append(i)
        if len(held) < 2 or len(held) == 2 and sizes[held[0]] != sizes[held[1]]:
            break
        for i, c in zip(held, _move([int(sizes[i]) for i in held], [float(out[i]) for i in held], draw), strict=True):
            out[i] = c
        held = [i for i in held if 0 < out[i] < 1]
    return out


def word_sizes(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """``doc_id, source, size``: how many words each row's text has."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(blocks.word_counts(batch.column(2)), pa.int64())], names=["doc_id", "source", "size"])

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[source_column].cast("string").alias("source"), docs[text_column].cast("string").alias("text"))
    return narrow.mapInArrow(rows, "doc_id long, source string, size long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST_TIMES) -> DataFrame:
    """``source, place, source_size, documents, target`` from ``source, size``: words each source gives.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` percent of all sizes.
    A target stops at ``most`` times its source's size; the excess is shared again by weight, until none is
    above. ``documents`` counts those with words.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("documents"))
    totals = stored_table(totals, "source-sizes")
    # Ranks without a global window: ranges of sources, each numbered for itself from where the last one ends.
    parts = max(1, -(-totals.count() // RANKED))
    ranged = totals.repartitionByRange(parts, F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id())
    ranged = stored_table(ranged, "ranged-sources")
    before, starts = 0, []
    for row in ranged.groupBy("part").count().orderBy("part").collect():  # one row per range
        starts.append((row.part, before))
        before += row["count"]
    starts = totals.sparkSession.createDataFrame(starts, "part int, before long")
    number = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    placed = ranged.withColumn("number", number).join(starts, "part").withColumn("place", F.col("before") + F.col("number"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    placed = stored_table(placed.select("source", "place", "source_size", "documents", weight.alias("weight")), "placed-sources")
    cap = F.col("source_size") * most
    all_words = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n * share / 100
    full, above = -1, F.lit(False)
    while True:  # until no further source is above
        found = placed.agg(
            F.count(F.when(above, 1)).alias("full"), F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        shared = F.lit(float(all_words - found.words)) * F.col("weight") / F.lit(found.weight or 1.0)
        if found.full == full:
            break
        full, above = found.full, above | (shared > cap)
    target = F.when(above, cap.cast("double")).otherwise(shared)
    return placed.select("source", "place", "source_size", "documents", target.alias("target"))


def _flown(open_units: DataFrame, seed: int) -> DataFrame:
    """``place, unit, size, chance`` after a flight in each ``place, bucket``."""

    def fly(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("unit", "ascending"), ("doc_id", "ascending"), ("size", "ascending"), ("copy", "ascending")])
        start = int(blocks.mix(np.array([key[0].as_py() * 1_000_003 + key[1].as_py() + seed], dtype=np.int64).view(_U))[0])
        chances = flight(np.asarray(rows.column("size")), np.asarray(rows.column("chance")), start)
        return rows.set_column(rows.column_names.index("chance"), "chance", pa.array(chances))

    return open_units.groupBy("place", "bucket").applyInArrow(fly, open_units.schema)


def mixed_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST_TIMES, seed: int = 0, bucket: int = BUCKET,
    id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``.

    ``copies`` is how often the mix takes the whole text, ``taken`` how many words it takes, which for at most two
    documents of a source includes a part of the text. Null ids and sources are values like others, null
    and empty texts have no words and give none, texts of any length are counted whole. Repeated rows are
    documents of their own. Which documents are taken depends on ids, sources, sizes and ``seed`` alone, not
    on how the rows are dealt out. Other columns are not read; an empty table gives no rows.
    """
    sizes = stored_table(word_sizes(docs, id_column, source_column, text_column), "word-sizes")
    targets = stored_table(source_targets(sizes, weights, share, most), "source-targets")
    # Rows that are alike are told apart by a number, so that no key holds many rows.
    alike = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    units = alike.join(targets.withColumnRenamed("source", "its_source"), F.col("source").eqNullSafe(F.col("its_source")))
    units = units.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("whole", F.floor(times)).withColumn("chance", F.when(F.col("size") > 0, times - F.floor(times)).otherwise(0.0))
    units = units.withColumn("unit", F.xxhash64(F.lit(seed), "doc_id", "size", "copy"))
    kept = ["doc_id", "source", "size", "source_size", "target", "whole", "chance"]
    units = stored_table(units.select(*kept, "place", "copy", "unit", "documents"), "mix-units")
    open_units = units.filter("chance > 0")
    done, crowd, turn = [units.filter("chance = 0").select(*kept)], "documents", 0
    while True:
        buckets = F.ceil(F.col(crowd) / F.lit(bucket)).cast("long")
        dealt = open_units.withColumn("bucket", F.pmod("unit", buckets)).drop(crowd)
        flown = stored_table(_flown(dealt, seed + turn), "flown-units").drop("bucket")
        done.append(flown.filter("chance = 0 OR chance = 1").select(*kept))
        left = flown.filter("chance > 0 AND chance < 1")
        crowds = stored_table(left.groupBy("place").agg(F.count("*").alias("crowd")), "open-units")
        left = left.join(crowds, "place")
        done.append(left.filter("crowd <= 2").select(*kept))
        if crowds.filter("crowd > 2").isEmpty():
            break
        open_units, crowd, turn = left.filter("crowd > 2"), "crowd", turn + 1
    mixed = reduce(DataFrame.unionByName, done)
    copies = (F.col("whole") + F.floor("chance")).cast("int")
    taken = F.col("whole") * F.col("size") + F.round(F.col("chance") * F.col("size")).cast("long")
    return mixed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), taken.alias("taken"))
