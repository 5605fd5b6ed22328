"""Sum-of-squares online packing of token sequences into windows of fixed size.

Every task packs the documents it reads, in the order it reads them, without a shuffle. A level array
counts the partially filled windows by how full they are. A document's whole windows are cut off
first; what remains goes to the fill level (or to a new window) after which the sum of the squared
counts is smallest. A balanced level array is what lets later documents complete windows. When a task
ends, its emptiest windows are cut up to fill the others, so that one window at most stays partial.

A task holds at most one window per open place of the level array; the rest has been put out. Window
numbers join the task's number and a count, so a repeated task puts out the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pinwatch.llm.encoders import byte_level

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = [(name, pa.int64()) for name in PIECES.replace(" long", "").split(", ")]

#: (doc_id, first id within the document, ids, all ids of the document)
Piece = tuple[int | None, int, np.ndarray, int]


class LevelArray:
    """Partially filled windows by fill level, and the placement rule."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, dtype=np.int64)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(size + 1)]

    def best_level(self, length: int) -> int:
        """The fill level to add ``length`` ids to; 0 opens a window. Of equal ones the fullest.

        Moving a window from level h to h + length changes the sum of squares by
        2 (count[h + length] - count[h] + 1), a new window by 2 count[length] + 1, and one that becomes
        full by 1 - 2 count[h].
        """
        counts, size = self.counts, self.size
        change = 2 * (counts[length:] - counts[: size - length + 1] + 1)
        change[-1] = 1 - 2 * counts[size - length]
        usable = counts[: size - length + 1] > 0
        change[~usable] = np.iinfo(np.int64).max
        change[0] = 2 * counts[length] + 1 if length < size else 1
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece away; returns its window if that is now full."""
        length = len(piece[2])
        level = self.best_level(length)
        window = self.windows[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        window.append(piece)
        if level + length == self.size:
            return window
        self.counts[level + length] += 1
        self.windows[level + length].append(window)
        return None

    def close(self) -> Iterator[list[Piece]]:
        """All open windows, filled up with pieces cut from the emptiest of them."""
        full = [w for level in range(self.size, 0, -1) for w in self.windows[level]]
        first, last = 0, len(full) - 1
        while first < last:
            room = self.size - sum(len(p[2]) for p in full[first])
            while room and first < last:
                doc, start, ids, tokens = full[last].pop()
                kept = max(0, len(ids) - room)
                full[first].append((doc, start + kept, ids[kept:], tokens))
                room -= len(ids) - kept
                if kept:
                    full[last].append((doc, start, ids[:kept], tokens))
                if not full[last]:
                    last -= 1
            first += 1
        yield from full[: last + 1]


class _Output:
    def __init__(self, with_ids: bool):
        self.with_ids, self.rows = with_ids, []
        self.next = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40

    def add(self, window: list[Piece]) -> None:
        offset = 0
        for doc, start, ids, tokens in window:
            row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()), tokens, self.next, offset)
            self.rows.append((*row, ids) if self.with_ids else row)
            offset += len(ids)
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * (len(_FIELDS) + self.with_ids)
        arrays = [pa.array(c, type=t) for c, (_, t) in zip(columns, _FIELDS, strict=False)]
        names = [name for name, _ in _FIELDS]
        if self.with_ids:
            arrays.append(pa.array([x.tolist() for x in columns[-1]], type=pa.list_(pa.int32())))
            names.append("ids")
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, names=names)


def pack(
    docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0,
    id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row per piece: which ids of which document lie where in which window.

    A document is its ids from the tokenizer file followed by ``end_id``. Null and empty texts are that
    id alone. A null id stays null; repeated rows are packed each for itself; other columns are not
    read, whatever their names. An empty table gives no rows. Texts of any length are cut every
    ``size`` ids. ``with_ids`` adds the ids of each piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, levels, out = byte_level(tokenizer_path, added_tokens=True), LevelArray(size), _Output(with_ids)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, ids, bounds in encoder.encode(batch.column(1)):
                for k in range(len(bounds) - 1):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id))
                    whole = len(own) // size * size
                    for start in range(0, whole, size):
                        out.add([(names[first + k], start, own[start : start + size], len(own))])
                    if whole < len(own):
                        window = levels.place((names[first + k], whole, own[whole:].copy(), len(own)))
                        if window:
                            out.add(window)
                yield out.batch()
        for window in levels.close():
            out.add(window)
        yield out.batch()

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return narrow.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def padding(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """Windows, ids and padding of a packed table. A window is padded unless it is a power of two long."""
    from pyspark.sql import functions as F

    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("ids"))
    power = F.col("ids").bitwiseAND(F.col("ids") - 1) == 0
    return filled.agg(
        F.count("*").alias("windows"), F.sum("ids").alias("ids"),
        F.sum(F.when(power, 0).otherwise(size - F.col("ids"))).alias("padding"),
    )
