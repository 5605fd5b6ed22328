"""Text columns as byte arrays: words, word hashes and hashes of word windows, without a Python loop.

A block is a run of whole documents. Words are runs of bytes other than space and 0x09-0x0D, which in
UTF-8 are exactly the characters other than those. Hashes are 64 bits wide, depend on content alone
and are the same in every task, so they can be shuffled and compared across the cluster. None is a sum
of powers of a base: such sums are equal for certain different inputs whatever the base.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
#: Salt of the second half of 128-bit hashes.
SECOND = 0x2545F4914F6CDD1D


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Of eight bytes read at once, those that belong to a span with so many left.
_LEFT = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=_U)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``start, start + 1, ...`` of each range, one range after the other, and the places in them."""
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(starts, counts) + place, place


@dataclass
class Pieces:
    """Byte spans cut into pieces of eight bytes, as integers: equal spans have equal pieces and lengths."""

    values: np.ndarray
    counts: np.ndarray
    lengths: np.ndarray

    def hashes(self, salt: int = 0) -> np.ndarray:
        """A hash of each span. Each piece is mixed with its place before the sum, so that no arrangement
        of pieces cancels out, as it may in a polynomial modulo 2^64."""
        if not len(self.values):
            return mix(self.lengths.astype(_U) * _U(_ODD) + _U(salt))
        firsts = np.cumsum(self.counts) - self.counts
        place = np.arange(len(self.values)) - np.repeat(firsts, self.counts)
        keys = mix(np.arange(1, int(self.counts.max()) + 1, dtype=_U) * _U(_ODD) + _U(salt))
        total = np.zeros(len(self.values) + 1, dtype=_U)
        np.cumsum(mix(self.values ^ keys[place]), out=total[1:])
        return mix(total[firsts + self.counts] - total[firsts] + self.lengths.astype(_U) * _U(_ODD))

    def take(self, which: np.ndarray) -> Pieces:
        firsts = np.cumsum(self.counts) - self.counts
        at, _ = _ranges(firsts[which], self.counts[which])
        return Pieces(self.values[at], self.counts[which], self.lengths[which])


def byte_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Pieces:
    """The spans of ``data`` from each of ``starts`` up to each of ``ends``, in pieces."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    lengths = ends - starts
    counts = (lengths + 7) // 8
    _, place = _ranges(starts, counts)
    done = 8 * place
    left = np.minimum(np.repeat(lengths, counts) - done, 8)
    return Pieces(eights[np.repeat(starts, counts) + done] & _LEFT[left], counts, lengths)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of every row, and of the end; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8), offsets


def document_runs(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


@dataclass
class Words:
    """Words of consecutive documents: byte ranges, hashes, and the first word of every document."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    firsts: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.firsts) - 1), self.counts())

    def document(self, k: int) -> Words:
        """The words of one document."""
        a, b = self.firsts[k], self.firsts[k + 1]
        alone = Words(self.data, self.starts[a:b], self.ends[a:b], self.hashes[a:b], np.array([0, b - a]))
        alone.second = self.second[a:b]
        return alone

    def pieces(self) -> Pieces:
        return byte_pieces(self.data, self.starts, self.ends)

    @cached_property
    def second(self) -> np.ndarray:
        """Other hashes of the words, independent of the first ones: together they have 128 bits."""
        return self.pieces().hashes(SECOND)


def word_bounds(data: np.ndarray, bounds: np.ndarray, spaces: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word of the documents between ``bounds``, and one past its last. ``spaces`` says
    of each byte whether it stands between words."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~spaces[data]
    begins = inside[1:-1] & ~inside[:-2]
    finishes = inside[1:-1] & ~inside[2:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[1:-1][cuts]
    finishes[cuts - 1] = inside[1:-1][cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(finishes) + 1


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, spaces: np.ndarray = _SPACE) -> Words:
    """Words of the documents whose bytes lie between consecutive ``offsets`` of ``data``."""
    base = int(offsets[0])
    data, bounds = data[base : int(offsets[-1])], offsets - base
    if lower:
        data = _LOWER[data]
    starts, ends = word_bounds(data, bounds, spaces)
    hashes = byte_pieces(data, starts, ends).hashes()
    return Words(data, starts, ends, hashes, np.searchsorted(starts, bounds))


def word_counts(column: pa.Array) -> np.ndarray:
    """How many words each row of a string column has."""
    data, offsets = text_bytes(column)
    counts = [np.zeros(0, dtype=np.int64)]
    for first, last in document_runs(offsets):
        bounds = offsets[first : last + 1] - offsets[first]
        starts, _ = word_bounds(data[offsets[first] : offsets[last]], bounds)
        counts.append(np.diff(np.searchsorted(starts, bounds)))
    return np.concatenate(counts)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of each pair of values; for one of them fixed, different others give different hashes."""
    x = a ^ (a >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x += b
    x ^= x >> _U(32)
    x *= _U(0xA24BAED4963EE407)
    x ^= x >> _U(29)
    return x


def window_hashes(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values, whatever documents they belong to: of halves
    joined to wholes, so that runs of any length take few steps."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    power, run, found, reach = 1, mix(hashes ^ _U(salt)) if salt else hashes, None, 0
    while True:
        if size & power:
            part = run[reach : reach + n]
            found = part if found is None else _joined(found, part)
            reach += power
        if reach == size:
            return mix(found + _U(size))
        run = _joined(run[:-power], run[power:])
        power *= 2


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the values from each of ``starts`` up to each of ``ends``: each value is mixed with its place
    in the span before the sum."""
    at, place = _ranges(starts, ends - starts)
    firsts = np.cumsum(ends - starts) - (ends - starts)
    total = np.zeros(len(at) + 1, dtype=_U)
    np.cumsum(mix(hashes[at] + (place.astype(_U) + _U(1)) * _U(_ODD) + _U(salt)), out=total[1:])
    return mix(total[firsts + (ends - starts)] - total[firsts] + (ends - starts).astype(_U) * _U(_ODD) + _U(salt))


def window_valid(firsts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Whether the run of ``size`` words at every place lies in one document."""
    if n < size:
        return np.zeros(0, dtype=bool)
    owners = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    return owners[: n - size + 1] == owners[size - 1 :]


def signed(values: np.ndarray) -> np.ndarray:
    """The same bits as Spark's LONG."""
    return values.astype(_U, copy=False).view(np.int64)
