"""Ranked lexical search: the best documents for each item, scored once per class of equal bags.

A document's bag is how often it holds each term of the items' vocabulary. Two documents with one bag
and one length term ``m`` score alike for every item, so they form a class: a hash brings candidates
together, and the bag's bytes and ``m`` decide. Classes are scored once, by the task that reads them,
which keeps the best of them for each item. Only the classes that win are expanded into members, by
ascending id.

Items are the stated query set. They meet all documents in blocks whose text is bounded; a block's
vocabulary and its terms' items are all that is sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pinwatch.llm import blocks
from pinwatch.llm.blocks import Pieces, byte_pieces
from pinwatch.llm.heaps import BestRows
from pinwatch.session import scratch_path, stored_table

MOST = 10
#: A document's length counts this many hundredths in ``m``, and ``m`` this many times in a term's share.
LENGTH_SHARE, SATURATION = 90, 8
#: Text and number of the items of a block, and cells of the table of scores worked on at once.
BLOCK_BYTES, BLOCK_ITEMS, CELLS = 16 << 20, 10_000, 1 << 20

#: Bytes that end a term: ASCII other than digits and letters.
_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[128:] = False
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def term_runs(column: pa.Array) -> Iterator[tuple[int, int, blocks.Words]]:
    """Lower-cased terms of runs of rows of a string column."""
    data, offsets = blocks.text_bytes(column)
    for first, last in blocks.document_runs(offsets):
        yield first, last, blocks.words(data, offsets[first : last + 1], lower=True, spaces=_BETWEEN)


@dataclass
class Vocabulary:
    """Terms in order of their hashes; a term's number is its place. A hash finds a term, its bytes decide."""

    hashes: np.ndarray
    pieces: Pieces
    salt: int

    @classmethod
    def of(cls, terms: list[bytes]) -> tuple[Vocabulary, list[bytes]]:
        """The vocabulary of different terms, and these in its order."""
        ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
        data = np.frombuffer(b"".join(terms), dtype=np.uint8)
        pieces = byte_pieces(data, ends - np.array([len(t) for t in terms], dtype=np.int64), ends)
        salt = 0
        while len(np.unique(hashes := pieces.hashes(salt))) < len(terms):
            salt += 1
        order = np.argsort(hashes)
        return cls(hashes[order], pieces.take(order), salt), [terms[i] for i in order.tolist()]

    def numbers(self, words: blocks.Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and the terms' numbers."""
        hashes = words.pieces().hashes(self.salt) if self.salt else words.hashes
        if not len(self.hashes):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        place = np.flatnonzero(self.hashes[at] == hashes)
        at = at[place]
        theirs, own = byte_pieces(words.data, words.starts[place], words.ends[place]), self.pieces.take(at)
        same = theirs.lengths == own.lengths
        theirs, own = theirs.take(np.flatnonzero(same)), own.take(np.flatnonzero(same))
        wrong = np.concatenate([[0], np.cumsum(theirs.values != own.values)])
        ends = np.cumsum(own.counts)
        same[same] = wrong[ends] == wrong[ends - own.counts]
        return place[same], at[same]


@dataclass
class Items:
    """Items of a block: ids, and for every term of their vocabulary the items that hold it, one term after
    the other."""

    ids: list
    first: np.ndarray
    items: np.ndarray
    weights: np.ndarray

    @classmethod
    def read(cls, rows: pa.Table) -> tuple[Items, Vocabulary]:
        holders: dict[bytes, list[int]] = {}
        column = rows.column("text").combine_chunks()
        for start, _, words in term_runs(column):
            body, owners = words.data.tobytes(), (words.documents() + start).tolist()
            for owner, a, b in zip(owners, words.starts.tolist(), words.ends.tolist(), strict=True):
                held = holders.setdefault(body[a:b], [])
                if not held or held[-1] != owner:
                    held.append(owner)
        vocabulary, terms = Vocabulary.of(list(holders))
        first = np.concatenate([[0], np.cumsum([len(holders[t]) for t in terms], dtype=np.int64)])
        items = np.array([i for t in terms for i in holders[t]], dtype=np.int64)
        return cls(rows.column("item_id").to_pylist(), first, items, np.zeros(len(terms), dtype=np.int64)), vocabulary


def _bags(docs: DataFrame, vocabulary) -> DataFrame:
    """``doc_id, n, bag`` of every row: all terms with repeats, and the vocabulary's terms with how often each
    occurs, as pairs of 32-bit integers in order of the terms."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary.value.hashes)
        for batch in batches:
            for first, last, words in term_runs(batch.column(1)):
                place, number = vocabulary.value.numbers(words)
                owner = np.searchsorted(words.firsts, place, side="right") - 1
                codes, times = np.unique(owner * size + number, return_counts=True)
                pairs = np.stack([codes % max(size, 1), times], axis=1).astype("<u4")
                ends = 8 * np.searchsorted(codes, np.arange(last - first + 1) * size)
                bags = pa.Array.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(pairs.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(words.counts(), pa.int64()), bags.cast(pa.binary())], names=["doc_id", "n", "bag"]
                )

    return docs.mapInArrow(rows, "doc_id long, n long, bag binary")


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every entry of the bags."""
    bags = column.cast(pa.large_binary())
    offsets = np.frombuffer(bags.buffers()[1], dtype=np.int64)[bags.offset : bags.offset + len(bags) + 1]
    body = np.frombuffer(bags.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    pairs = np.frombuffer(body.tobytes(), dtype="<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(bags)), np.diff(offsets) // 8), pairs[:, 0], pairs[:, 1]


def _document_frequencies(bags: DataFrame, size: int) -> np.ndarray:
    """In how many rows each term occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_pairs(batch.column(0))[1], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    found = bags.select("bag").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, dtype=np.int64)  # a row per term of the block
    out[np.asarray(found.column("term"))] = np.asarray(found.column("n"))
    return out


def _scored(classes: DataFrame, items, most: int) -> DataFrame:
    """``item, item_id, score, first, class_id``: for each item the best classes of each task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = items.value
        best = BestRows(len(query.ids), most)
        step = max(1, CELLS // max(1, len(query.ids)))
        for batch in batches:
            class_id, m = (np.asarray(batch.column(i)) for i in (0, 2))
            # A class of null ids alone comes last.
            first = np.asarray(batch.column(3).fill_null(np.iinfo(np.int64).max))
            owner, term, times = _pairs(batch.column(1))
            share = query.weights[term] * ((1_000_000_000 * times) // (1000 * times + SATURATION * m[owner]))
            for start in range(0, len(m), step):
                a, b = np.searchsorted(owner, [start, start + step])
                order = a + np.argsort(term[a:b], kind="stable")
                terms, begins = np.unique(term[order], return_index=True)
                scores = np.zeros((len(query.ids), min(step, len(m) - start)), dtype=np.int64)
                for t, i, j in zip(terms.tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)], strict=True):
                    these = order[i:j]
                    scores[query.items[query.first[t] : query.first[t + 1], None], owner[these] - start] += share[these]
                item, place = np.nonzero(scores >= np.maximum(best.threshold(), 1)[:, None])
                best.add(item, scores[item, place], first[start + place], class_id[start + place])
        item, score, _, class_id = best.entries()
        own = pa.array([query.ids[i] for i in item.tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(item), own, pa.array(score), pa.array(class_id)], names=["item", "item_id", "score", "class_id"])

    return classes.select("class_id", "bag", "m", "first").mapInArrow(rows, "item long, item_id long, score long, class_id long")


def _top(rows: DataFrame, groups: list[str], order: list, most: int, rank: str = "rank") -> DataFrame:
    window = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= most)


def _answers(docs: DataFrame, rows: pa.Table, most: int) -> DataFrame:
    """``item_id, rank, doc_id, score`` of a block of items."""
    spark = docs.sparkSession
    items, vocabulary = Items.read(rows)
    bags = stored_table(_bags(docs, spark.sparkContext.broadcast(vocabulary)), "bags")
    total = bags.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.greatest(F.sum("n"), F.lit(1)).alias("terms")).first()
    df = _document_frequencies(bags, len(items.weights))
    n, terms = total.documents, total.terms or 1
    items.weights = np.floor(1000.0 * np.log((2.0 * n + 2.0) / (2.0 * df + 1.0))).astype(np.int64)
    known = bags.filter(F.length("bag") > 0).withColumn("m", F.lit(100 - LENGTH_SHARE) + F.expr(f"({LENGTH_SHARE}L * n * {n}L) DIV {terms}L"))
    known = known.select("doc_id", "bag", "m", F.xxhash64("m", "bag").alias("hash"))
    classes = known.groupBy("hash", "m", "bag").agg(F.min("doc_id").alias("first"))
    classes = stored_table(classes.withColumn("class_id", F.monotonically_increasing_id()), "bag-classes")
    scored = _scored(classes, spark.sparkContext.broadcast(items), most).join(classes.select("class_id", "first"), "class_id")
    best = stored_table(_top(scored, ["item"], [F.desc("score"), F.asc_nulls_last("first"), "class_id"], most), "best-classes")
    chosen = stored_table(classes.join(best.select("class_id").distinct(), "class_id", "left_semi"), "chosen-classes")
    # At most ``most`` classes of each of the block's items: a list of bounded size.
    likely = known.join(F.broadcast(chosen.select("hash", "m").distinct()), ["hash", "m"], "left_semi")
    members = _top(likely, ["hash", "m", "bag"], [F.asc_nulls_last("doc_id")], most, "place")
    members = members.join(chosen, ["hash", "m", "bag"]).select("class_id", "doc_id")
    found = best.select("item", "item_id", "score", "class_id").join(members, "class_id")
    return _top(found, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], most).select("item_id", "rank", "doc_id", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, most: int = MOST, block_bytes: int = BLOCK_BYTES, id_column: str = "doc_id", text_column: str = "text",
    item_id_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: for every item the ``most`` documents of the highest score above 0.

    Equal scores come by ascending id, null ids last. Null and empty texts have no terms: such documents
    are found by nothing and such items find nothing; a document of other terms only counts in the
    statistics. Texts of any length are read whole. Rows that share an id are documents, or items, of
    their own. Other columns are not read. An empty table of either kind gives no rows.
    """
    spark = docs.sparkSession
    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    queries = items.select(items[item_id_column].cast("long").alias("item_id"), items[item_text_column].cast("string").alias("text"))
    queries = stored_table(queries.filter("text <> ''").withColumn("number", F.monotonically_increasing_id()), "items")
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    count = max(-(-size.bytes // block_bytes), -(-size.n // BLOCK_ITEMS))
    path = scratch_path(spark, "ranked-search")
    schema = "item_id long, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for number in range(count):
        block = queries.filter(F.pmod(F.xxhash64("number"), F.lit(count)) == number).select("item_id", "text").toArrow()
        _answers(narrow, block, most).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
