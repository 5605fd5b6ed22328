"""Passages that occur more than once: a count-min prefilter, then exact grouping of what it lets through.

A window is ``size`` consecutive words of one document. Every window has an anchor, the smallest of the
hashes of the eight-word runs in it: equal windows have equal anchors at equal places, so an anchor
occurs at least as often as each window that has it. Each task sketches how often anchors occur; the
sketches are merged into one bit per cell, "twice or more". That can only overestimate, so a window
is certainly unique if a cell of its anchor, in either of two rows, says "once". The others are grouped exactly, in two steps.

Neighbouring windows with one anchor form a stretch, and most stretches of a copied passage are equal
as a whole. Stretches are grouped first, by 128 bits of hashes of their words: where one occurs twice,
all its windows do. Only below anchors that have several different stretches, some of them single, are
windows grouped one by one. Documents then learn which of their stretches and windows are repeated.

Documents are told apart by 128 bits of hashes of their word sequence: copies share them and are
decided together, which holds whatever their ids are. Both halves of every key come from hashes of the
words that are independent of each other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pinwatch.llm import blocks
from pinwatch.llm.blocks import _U, Words, signed
from pinwatch.llm.bloom import build_bloom
from pinwatch.llm.names import plain, spare
from pinwatch.session import stored_table

WINDOW = 35
ANCHOR = 8
#: Cells in each of the sketch's two rows, a power of two. The merged sketch that workers hold has one
#: bit for each (32 MB); more cells let fewer unique windows through on larger corpora, and never change
#: the result.
CELLS, ROWS = 1 << 27, 2
SEGMENTS = 256
_PENDING = 4_000_000


def anchors(words: Words, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For every window that lies in one document: its place, and the place and hash of its anchor.

    Of equal smallest hashes the first is taken, so the choice depends on the window's words alone.
    """
    valid = np.flatnonzero(blocks.window_valid(words.firsts, size, len(words.hashes)))
    if not len(valid):
        return valid, valid, valid.astype(_U)
    gram = min(ANCHOR, size)
    grams = blocks.window_hashes(words.hashes, gram)
    low = (grams >> _U(32) << _U(32)) | np.arange(len(grams), dtype=_U)
    span, reach = size - gram + 1, 1
    while 2 * reach <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: -(span - reach)], low[span - reach :])
    place = (low[valid] & _U(0xFFFFFFFF)).astype(np.int64)
    return valid, place, grams[place]


def _cells_of(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each hash in either row; the second row follows the first."""
    shift = _U(64 - (cells.bit_length() - 1))
    return (hashes >> shift).astype(np.int64), (blocks.mix(hashes) >> shift).astype(np.int64) + cells


def _document_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each document's sequence of words."""
    ends = words.firsts[:-1], words.firsts[1:]
    return blocks.span_hashes(words.hashes, *ends), blocks.span_hashes(words.second, *ends)


@dataclass
class Stretches:
    """Runs of neighbouring windows with one anchor: first window, one past the last, and anchor."""

    words: Words
    size: int
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray

    def owners(self) -> np.ndarray:
        return np.searchsorted(self.words.firsts, self.first, side="right") - 1

    def spans(self) -> np.ndarray:
        """A hash of all words of each stretch."""
        return blocks.span_hashes(self.words.hashes, self.first, self.last + (self.size - 1))

    def halves(self) -> np.ndarray:
        """Another one, independent of it."""
        return blocks.span_hashes(self.words.second, self.first, self.last + (self.size - 1))

    def some(self, chosen: np.ndarray) -> Stretches:
        return Stretches(self.words, self.size, self.first[chosen], self.last[chosen], self.anchor[chosen])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows of the stretches, and which stretch each belongs to."""
        sizes = self.last - self.first
        shift = self.first - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
        return np.arange(int(sizes.sum())) + np.repeat(shift, sizes), np.repeat(np.arange(len(sizes)), sizes)


def stretches(words: Words, size: int, bitmap: np.ndarray | None = None) -> Stretches:
    """All stretches of the documents, or those whose anchor the sketch takes for repeated."""
    valid, place, hashes = anchors(words, size)
    begins = np.flatnonzero(np.concatenate([[True], np.diff(place) != 0])) if len(place) else place
    first, anchor = valid[begins], hashes[begins]
    found = Stretches(words, size, first, first + np.diff(np.append(begins, len(valid))), anchor)
    if bitmap is None:
        return found
    some = np.ones(len(anchor), dtype=bool)
    for cell in _cells_of(anchor, len(bitmap) * 8 // ROWS):
        some &= (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return found.some(some)


def _runs(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    data, offsets = blocks.text_bytes(column)
    for first, last in blocks.document_runs(offsets):
        yield first, last, blocks.words(data, offsets[first : last + 1])


class _Counts:
    """Cells a task has seen, once or more often."""

    def __init__(self, cells: int):
        self.cells, self.pending, self.size = cells, [], 0
        self.seen, self.often = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)

    def add(self, cells: np.ndarray) -> None:
        self.pending.append(cells)
        self.size += len(cells)
        if self.size > _PENDING:
            self.settle()

    def settle(self) -> None:
        new, times = np.unique(np.concatenate([*self.pending, self.seen]), return_counts=True)
        often = times > 1
        often[np.searchsorted(new, self.seen[self.often])] = True
        self.seen, self.often, self.pending, self.size = new, often, [], 0

    def segments(self) -> Iterator[tuple[int, bytes]]:
        self.settle()
        width = self.cells // SEGMENTS
        cuts = np.searchsorted(self.seen, np.arange(SEGMENTS + 1) * width)
        for s in range(SEGMENTS):
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                codes = ((self.seen[a:b] - s * width) * 2 + self.often[a:b]).astype(np.uint32)
                yield s, b"S" + zlib.compress(np.diff(codes, prepend=np.uint32(0)).tobytes(), 1)


def _bits(sketch: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the cells seen and seen twice or more, of a task's or of a merged sketch."""
    body = np.frombuffer(zlib.decompress(sketch[1:]), dtype=np.uint32 if sketch[:1] == b"S" else np.uint8)
    if sketch[:1] == b"D":
        return body[: width // 8], body[width // 8 :]
    codes = np.cumsum(body, dtype=np.uint32)
    seen, often = np.zeros(width, dtype=bool), np.zeros(width, dtype=bool)
    seen[codes >> 1] = True
    often[(codes >> 1)[codes & 1 == 1]] = True
    return np.packbits(seen, bitorder="little"), np.packbits(often, bitorder="little")


def repeated_cells(texts: DataFrame, size: int = WINDOW, cells: int = CELLS) -> np.ndarray:
    """The merged sketch of the column ``text``: a bitmap of the cells that anchors fall on at least twice.

    Tasks put out what they have seen in segments; sixty-four sketches of a segment at most meet in one
    step of the merge, so no step holds more than that, however many tasks there are.
    """
    total = ROWS * cells
    width = total // SEGMENTS

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(total)
        for batch in batches:
            for _, _, words in _runs(batch.column(0)):
                _, place, hashes = anchors(words, size)
                if len(place):
                    once = np.concatenate([[True], np.diff(place) != 0])
                    counts.add(np.concatenate(_cells_of(hashes[once], cells)))
        rows = list(counts.segments())
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in rows], pa.int32()), pa.array([part] * len(rows), pa.int64()), pa.array([b for _, b in rows], pa.binary())],
            names=["segment", "part", "sketch"],
        )

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(width // 8, dtype=np.uint8)
        often = np.zeros(width // 8, dtype=np.uint8)
        for body in rows["sketch"]:
            a, b = _bits(body, width)
            often |= b | (seen & a)
            seen |= a
        dense = b"D" + zlib.compress(seen.tobytes() + often.tobytes(), 1)
        return pd.DataFrame({"segment": [rows["segment"].iloc[0]], "part": [rows["part"].iloc[0]], "sketch": [dense]})

    schema = "segment int, part long, sketch binary"
    merged = texts.select("text").mapInArrow(sketch, schema)
    for step in (6, 12, 63):
        merged = merged.groupBy("segment", F.shiftright("part", step).alias("group")).applyInPandas(merge, schema)
    bitmap = np.zeros(total // 8, dtype=np.uint8)
    for row in merged.select("segment", "sketch").toLocalIterator():  # SEGMENTS rows of fixed size
        bitmap[row.segment * (width // 8) : (row.segment + 1) * (width // 8)] = _bits(bytes(row.sketch), width)[1]
    return bitmap


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the different rows of ``columns``, and how often each occurs, counted up to two."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for column in columns:
        new[1:] |= np.diff(column[order]) != 0
    firsts = np.flatnonzero(new)
    return order[firsts], np.minimum(np.diff(np.append(firsts, len(order))), 2).astype(np.int8)


def _suspect_stretches(texts: DataFrame, sketch, size: int) -> DataFrame:
    """``key, key2, anchor, span, half, times``: the stretches that the sketch lets through, of each document,
    and how often they are there, counted up to two. Copies in a batch are reported once, as two."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, words in _runs(batch.column(0)):
                found = stretches(words, size, sketch.value)
                if len(found.first):
                    owner = found.owners()
                    parts.append((*[k[owner] for k in _document_keys(words)], found.anchor, found.spans(), found.halves()))
            if parts:
                key, key2, anchor, span, half = (np.concatenate(x) for x in zip(*parts, strict=True))
                at, times = _distinct(half, span, key2, key)
                columns = [*[signed(c[at]) for c in (key, key2, anchor, span, half)], times]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "key2", "anchor", "span", "half", "times"])

    return texts.select("text").mapInArrow(rows, "key long, key2 long, anchor long, span long, half long, times byte")


def _open_windows(texts: DataFrame, anchors_open, size: int) -> DataFrame:
    """``low, high, span, half, times``: the windows below the anchors of a Bloom filter, by stretch. Equal
    stretches in a batch are reported once, as two."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, words in _runs(batch.column(0)):
                found = stretches(words, size)
                chosen = np.flatnonzero(anchors_open.value.may_hold(found.anchor)) if len(found.first) else found.first
                if len(chosen):
                    found = found.some(chosen)
                    place, owner = found.windows()
                    low = blocks.window_hashes(words.hashes, size)[place]
                    high = blocks.window_hashes(words.second, size)[place]
                    parts.append((low, high, found.spans()[owner], found.halves()[owner]))
            if parts:
                low, high, span, half = (np.concatenate(x) for x in zip(*parts, strict=True))
                at, times = _distinct(half, span, high, low)
                columns = [*[signed(c[at]) for c in (low, high, span, half)], times]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["low", "high", "span", "half", "times"])

    return texts.select("text").mapInArrow(rows, "low long, high long, span long, half long, times byte")


def _texts_of(texts: DataFrame, keys) -> DataFrame:
    """``key, key2, text`` of the documents whose key the Bloom filter may hold, once per batch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_document_keys(words) for _, _, words in _runs(batch.column(0))]
            if found:
                key, key2 = (np.concatenate(x) for x in zip(*found, strict=True))
                place = np.flatnonzero(keys.value.may_hold(key))
                place = place[_distinct(key2[place], key[place])[0]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key[place])), pa.array(signed(key2[place])), batch.column(0).take(pa.array(place))], names=["key", "key2", "text"]
                )

    return texts.select("text").mapInArrow(rows, "key long, key2 long, text string")


def repeated_parts(texts: DataFrame, size: int = WINDOW, cells: int = CELLS) -> DataFrame:
    """``key, key2, spans, lows``: for each word sequence with repeated windows, hashes of its stretches that are
    repeated whole and of its single repeated windows."""
    spark = texts.sparkSession
    sketch = spark.sparkContext.broadcast(repeated_cells(texts, size, cells))
    suspects = stored_table(_suspect_stretches(texts, sketch, size), "suspect-stretches")
    spans = suspects.groupBy("span", "half", "anchor").agg(F.sum("times").alias("times"))
    spans = stored_table(spans, "stretch-counts")
    mixed = spans.groupBy("anchor").agg(F.count("*").alias("n"), F.min("times").alias("least")).filter("n > 1 AND least = 1")
    anchors_open = spark.sparkContext.broadcast(build_bloom(stored_table(mixed.select(F.col("anchor").alias("hash")), "open-anchors")))
    windows = stored_table(_open_windows(texts, anchors_open, size), "open-windows")
    repeated = windows.groupBy("low", "high").agg(F.sum("times").alias("times")).filter("times > 1").select("low", "high")
    repeated = stored_table(repeated, "repeated-windows")
    parts = windows.join(repeated, ["low", "high"], "left_semi").groupBy("span", "half").agg(F.collect_set("low").alias("lows"))
    # Stretches that occur once, with nothing repeated in them, take no part from here on.
    whole = spans.filter("times > 1").select("span", "half", F.lit(True).alias("whole"))
    some = parts.join(whole, ["span", "half"], "left_anti").withColumn("whole", F.lit(False))
    status = stored_table(whole.unionByName(some, allowMissingColumns=True), "stretch-status")
    marks = suspects.select("key", "key2", "span", "half").join(status, ["span", "half"])
    return marks.groupBy("key", "key2").agg(
        F.collect_set(F.when(F.col("whole"), F.col("span"))).alias("spans"), F.flatten(F.collect_set("lows")).alias("lows")
    )


def _among(values: np.ndarray, owners: np.ndarray, lists: pa.ListArray, first: int, last: int) -> np.ndarray:
    """Whether each value is in the list of the row that owns it."""
    sizes = np.asarray(lists.value_lengths())[first:last]
    wanted = np.asarray(lists.slice(first, last - first).flatten()).view(_U)
    rows = np.repeat(np.arange(last - first, dtype=_U), sizes)
    return np.isin(values ^ blocks.mix(owners.astype(_U)), wanted ^ blocks.mix(rows))


def cleaned_texts(texts: DataFrame, size: int = WINDOW, cells: int = CELLS) -> DataFrame:
    """``key, key2, n_removed, kept`` for the word sequences that lose words: how many, and what is left, joined
    by single spaces. ``texts`` has a column ``text``."""
    parts = stored_table(repeated_parts(texts, size, cells), "repeated-parts")
    keys = texts.sparkSession.sparkContext.broadcast(build_bloom(parts.select(F.col("key").alias("hash"))))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for first, last, words in _runs(batch.column(2)):
                found = stretches(words, size)
                place, _ = found.some(_among(found.spans(), found.owners(), batch.column(3), first, last)).windows()
                low = blocks.window_hashes(words.hashes, size)
                valid = np.flatnonzero(blocks.window_valid(words.firsts, size, len(words.hashes)))
                owner = np.searchsorted(words.firsts, valid, side="right") - 1
                place = np.union1d(place, valid[_among(low[valid], owner, batch.column(4), first, last)])
                edge = np.zeros(len(words.hashes) + 1, dtype=np.int64)
                edge[place] += 1
                edge[place + size] -= 1
                stays = np.cumsum(edge[:-1]) == 0
                body, starts, ends = words.data.tobytes(), words.starts.tolist(), words.ends.tolist()
                for k in range(last - first):
                    a, b = words.firsts[k], words.firsts[k + 1]
                    left = (np.flatnonzero(stays[a:b]) + a).tolist()
                    kept.append(b" ".join(body[starts[i] : ends[i]] for i in left).decode())
                    removed.append(int(b - a) - len(left))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["key", "key2", "n_removed", "kept"]
            )

    found = _texts_of(texts, keys).join(parts, ["key", "key2"]).dropDuplicates(["key", "key2"])
    return found.select("key", "key2", "text", "spans", "lows").mapInArrow(clean, "key long, key2 long, n_removed long, kept string")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, key2, counts = [], [], []
        for _, _, words in _runs(batch.column(1)):
            for own, half in zip((key, key2), _document_keys(words), strict=True):
                own.append(signed(half))
            counts.append(words.counts())
        data, offsets = blocks.text_bytes(batch.column(1))
        body = data.tobytes()
        spans = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        sha = [hashlib.sha256(b" ".join(body[a:b].split())).hexdigest() for a, b in spans]
        join = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), join(key), join(key2), join(counts), pa.array(sha, pa.string())], names=["doc_id", "key", "key2", "n_words", "own_sha256"]
        )


def substring_duplicates(docs: DataFrame, size: int = WINDOW, cells: int = CELLS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs``.

    A word is removed if a window that covers it has words that also start anywhere else, in the same
    document or another. Null texts count as empty; texts shorter than a window keep all their words.
    Repeated rows are copies of each other, so they lose what is a window long. Texts of any length are read
    whole. Null ids stay null; other columns are not read. An empty table gives no rows.
    """
    texts = docs.select(docs[text_column].cast("string").alias("text"))
    cleaned = cleaned_texts(texts, size, cells).select("key", "key2", "n_removed", F.sha2("kept", 256).alias("cut_sha256"))
    cleaned = stored_table(cleaned, "cleaned-texts")
    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    rows = narrow.mapInArrow(_keyed, "doc_id long, key long, key2 long, n_words long, own_sha256 string").join(cleaned, ["key", "key2"], "left")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("cut_sha256", "own_sha256").alias("kept_sha256"),
    )


def without_repeated_passages(docs: DataFrame, size: int = WINDOW, cells: int = CELLS, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """``docs`` with the repeated passages cut out of their texts; a text that loses nothing stays as it
    is, white space included. ``length_column``, if there, follows the text."""
    texts = docs.select(docs[text_column].cast("string").alias("text"))
    cleaned = stored_table(cleaned_texts(texts, size, cells), "cleaned-texts")
    own = {name: spare(name, docs.columns) for name in ("key", "key2", "n_removed", "kept")}
    cleaned = cleaned.select(*[F.col(c).alias(own[c]) for c in own])
    place = docs.columns.index(text_column)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_document_keys(words) for _, _, words in _runs(batch.column(place))]
            keys = [pa.array(signed(np.concatenate(k))) for k in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns, *keys], names=[f"c{i}" for i in range(len(batch.columns))] + ["k", "k2"])

    fields = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)]
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(keyed, ", ".join([*fields, "k long", "k2 long"]))
    rows = numbered.toDF(*docs.columns, own["key"], own["key2"]).join(cleaned, [own["key"], own["key2"]], "left")
    kept, touched = F.col(own["kept"]), F.col(own["kept"]).isNotNull()
    columns = []
    for name, column in zip(docs.columns, plain(docs), strict=True):
        if name == text_column:
            column = F.coalesce(kept, column).alias(name)
        elif name == length_column:
            column = F.when(touched, F.length(kept).cast(docs.schema[name].dataType)).otherwise(column).alias(name)
        columns.append(column)
    return rows.select(*columns)
