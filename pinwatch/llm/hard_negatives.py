"""Hard negatives: rows of another label that score within a window below an anchor's positives.

Scores are inner products of integer vectors, anchors by candidates. Tasks multiply tiles of both by
Strassen's recursion in 64-bit integers: odd sides get a row or column of zeros, and sums and products
are exact in the ring of 64-bit integers, so the recursion gives what the plain product gives. Every
task keeps the best positives of each anchor, and in a second pass the best rows of each window; what
the tasks kept is merged by anchor and by window.

Anchors are the stated query set. They meet all rows in blocks of bounded size, one pass over the
stored vectors for each block and kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pinwatch.llm.heaps import BestRows
from pinwatch.session import scratch_path, stored_table

#: Components are multiplied by this and rounded down.
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of its positive's.
LOW, HIGH = 30, 90
#: Vectors of anchors that meet the candidates in one pass, and rows of a candidate partition.
ANCHOR_BYTES, PARTITION_ROWS = 32 << 20, 1 << 16
#: Rows of anchors and of candidates in a tile, and the side at which the recursion ends.
ANCHOR_TILE, CANDIDATE_TILE, LEAF = 1024, 512, 32


def _padded(m: np.ndarray) -> np.ndarray:
    n, k = m.shape
    return np.pad(m, ((0, n % 2), (0, k % 2))) if n % 2 or k % 2 else m


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` in 64-bit integers."""
    if min(*a.shape, b.shape[1]) <= leaf:
        return a @ b
    rows, columns = a.shape[0], b.shape[1]
    a, b = _padded(a), _padded(b)
    (n, k), m = (s // 2 for s in a.shape), b.shape[1] // 2
    top, low, left, right = a[:n], a[n:], b[:, :m], b[:, m:]
    a11, a12, a21, a22 = top[:, :k], top[:, k:], low[:, :k], low[:, k:]
    b11, b21, b12, b22 = left[:k], left[k:], right[:k], right[k:]
    both = strassen(a11 + a22, b11 + b22, leaf)
    lower = strassen(a21 + a22, b11, leaf)
    across = strassen(a11, b12 - b22, leaf)
    down = strassen(a22, b21 - b11, leaf)
    upper = strassen(a11 + a12, b22, leaf)
    out = np.empty((2 * n, 2 * m), dtype=np.int64)
    out[:n, :m] = both + down - upper + strassen(a12 - a22, b21 + b22, leaf)
    out[:n, m:] = across + upper
    out[n:, :m] = lower + down
    out[n:, m:] = both - lower + across + strassen(a21 - a11, b11 + b12, leaf)
    return out[:rows, :columns]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A row per list, zeros after its end; what lies beyond ``width`` is left out."""
    sizes = np.asarray(lists.value_lengths())
    values = np.asarray(lists.flatten())
    out = np.zeros((len(sizes), width), dtype=np.int64)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = place < width
    out[np.repeat(np.arange(len(sizes)), sizes)[inside], place[inside]] = values[inside]
    return out


def _share(score: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``score * percent / 100`` rounded down, and up."""
    whole, rest = np.divmod(score, 100)
    return whole * percent + rest * percent // 100, whole * percent - (-rest * percent // 100)


@dataclass
class Anchors:
    """Anchors of a block: row numbers, ids, labels and vectors."""

    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    vectors: np.ndarray

    def tiles(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """Scores of all anchors with the candidates of a batch, by ranges of both."""
        vectors = _matrix(batch.column(3), self.vectors.shape[1])
        for c in range(0, len(vectors), CANDIDATE_TILE):
            some = slice(c, c + CANDIDATE_TILE)
            across = vectors[some].T
            for a in range(0, len(self.row), ANCHOR_TILE):
                these = slice(a, a + ANCHOR_TILE)
                yield these, some, strassen(self.vectors[these], across)


def _candidate(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.asarray(batch.column(i)) for i in range(3))


def _positives(vectors: DataFrame, anchors, most: int) -> DataFrame:
    """``anchor, score, vec_id, row``: each task's best rows of the anchors' labels, other than the anchors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = anchors.value
        best = BestRows(len(block.row), most)
        for batch in batches:
            row, vec_id, label = _candidate(batch)
            for these, some, scores in block.tiles(batch):
                fits = (block.label[these][:, None] == label[some]) & (block.row[these][:, None] != row[some])
                a, c = np.nonzero(fits & (scores >= best.threshold()[these][:, None]))
                best.add(a + these.start, scores[a, c], vec_id[some][c], row[some][c])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.entries()], names=["anchor", "score", "vec_id", "row"])

    return vectors.mapInArrow(rows, "anchor long, score long, vec_id long, row long")


def _negatives(vectors: DataFrame, anchors, positives, most: int, low: int, high: int) -> DataFrame:
    """Each task's best rows of other labels in the window of every positive. ``positives`` has, for the
    pairs in order of anchors, the anchor, the positive's row and id, and the score."""
    names = ["pair", "score", "vec_id", "row", "anchor_id", "positive_id", "positive_score"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (owner, _, positive_id, score) = anchors.value, positives.value
        least, greatest = _share(score, low)[1], _share(score, high)[0]
        first = np.searchsorted(owner, np.arange(len(block.row) + 1))
        best = BestRows(len(owner), most)
        for batch in batches:
            row, vec_id, label = _candidate(batch)
            for these, some, scores in block.tiles(batch):
                other = block.label[these][:, None] != label[some]
                begin, end = first[:-1][these], first[1:][these]
                for k in range(int((end - begin).max(initial=0))):
                    own = np.flatnonzero(begin + k < end)
                    pair = begin[own] + k
                    from_score = np.maximum(least[pair], best.threshold()[pair])
                    found = scores[own]
                    a, c = np.nonzero(other[own] & (found >= from_score[:, None]) & (found <= greatest[pair][:, None]))
                    best.add(pair[a], found[a, c], vec_id[some][c], row[some][c])
        pair, *kept = best.entries()
        told = [block.vec_id[owner[pair]], positive_id[pair], score[pair]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pair, *kept, *told)], names=names)

    return vectors.mapInArrow(rows, ", ".join(f"{n} long" for n in names))


def _first(rows: DataFrame, group: str, most: int) -> DataFrame:
    """The best ``most`` rows of each group, with their place in ``rank``."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), "vec_id", "row")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def integer_vectors(rows: DataFrame, vectors: Column, ids: Column, labels: Column, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part, components multiplied and rounded down."""
    fits = F.forall(vectors, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < float(1 << 62)))
    kept = rows.select(ids.cast("long").alias("vec_id"), labels.cast("long").alias("label"), F.when(fits, vectors).alias("vector"))
    kept = kept.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    return kept.withColumn("vector", F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("long")))


def hard_negatives(
    rows: DataFrame, anchor_every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: int = SCALE, anchor_bytes: int = ANCHOR_BYTES, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``anchor_every``. An anchor's positives are the first rows
    of its label other than itself, higher scores first, ties by smaller id. For each positive the first
    rows of other labels follow whose score lies between ``low`` and ``high`` percent of the positive's; a
    negative positive score has no such rows, and one of zero only those of zero.

    Rows with a null id, label or vector, with a null, infinite or undefined component, or with one beyond
    2^62 after scaling take no part. Shorter vectors count as ending in zeros, empty ones as zeros. Scores
    are 64-bit integers and wrap around beyond them. Repeated rows are rows of their own: each is other
    than the anchor it copies, and each copy of an anchor is an anchor. Other columns are not read; an
    empty table gives no rows.
    """
    spark = rows.sparkSession
    kept = integer_vectors(rows, rows[vector_column], rows[id_column], rows[label_column], scale)
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // PARTITION_ROWS))
    # Few bytes of vectors are much work, so the rows are dealt out to all tasks.
    kept = kept.repartition(parts).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "vector")
    vectors = stored_table(kept, "integer-vectors")
    chosen = vectors.filter(F.col("vec_id") % anchor_every == 0)
    size = chosen.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    count = max(1, -(-size.n * max(size.width, 1) * 8 // anchor_bytes))
    path = scratch_path(spark, "hard-negatives")
    for number in range(count):
        block = chosen.filter(F.pmod(F.xxhash64("row"), F.lit(count)) == number).toArrow().combine_chunks()
        row, vec_id, label = (np.asarray(block.column(i)) for i in range(3))
        anchors = spark.sparkContext.broadcast(Anchors(row, vec_id, label, _matrix(block.column(3).combine_chunks(), size.width)))
        best = _first(_positives(vectors, anchors, positives), "anchor", positives).toArrow()  # a few rows for each anchor
        best = best.sort_by([("anchor", "ascending"), ("rank", "ascending")])
        pairs = spark.sparkContext.broadcast(tuple(np.asarray(best.column(c)) for c in ("anchor", "row", "vec_id", "score")))
        found = _first(_negatives(vectors, anchors, pairs, negatives, low, high), "pair", negatives)
        found.select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        ).write.mode("append").parquet(path)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(path)
