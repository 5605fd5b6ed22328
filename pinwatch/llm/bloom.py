"""A blocked Bloom filter: all bits of a key lie in one block of 512 bits, so a test reads one cache line.

Spark builds it: keys become (word, mask) pairs that are combined with a bitwise OR. Its size follows
from the number of keys up to a fixed bound, so it can be sent to every worker whatever the table;
beyond the bound it only lets more keys through, which the exact step after it sorts out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pinwatch.llm.blocks import _U, mix

BITS_PER_KEY, MOST_BYTES, BITS_SET, BLOCK_WORDS = 16, 8 << 20, 6, 8


def _block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return (hashes >> _U(32)) % _U(blocks)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Six bit numbers from 0 to 511 for each key, from a second hash."""
    second = mix(hashes ^ _U(0x5851F42D4C957F2D))
    return np.stack([(second >> _U(9 * i)) & _U(511) for i in range(BITS_SET)], axis=1)


@dataclass
class BlockedBloom:
    words: np.ndarray

    @property
    def blocks(self) -> int:
        return len(self.words) // BLOCK_WORDS

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """For every 64-bit hash whether its key may have been listed; never false for a listed one."""
        if not len(hashes):
            return np.zeros(0, dtype=bool)
        hashes = hashes.view(_U)
        start = _block(hashes, self.blocks) * _U(BLOCK_WORDS)
        found = np.ones(len(hashes), dtype=bool)
        for bit in _bits(hashes).T:
            found &= (self.words[start + (bit >> _U(6))] >> (bit & _U(63))) & _U(1) == 1
        return found


def build_bloom(keys: DataFrame, most_bytes: int = MOST_BYTES) -> BlockedBloom:
    """The filter of the LONG column ``hash`` of ``keys``; nulls are passed over."""
    keys = keys.select("hash").filter("hash IS NOT NULL")
    wanted = keys.count() * BITS_PER_KEY // 64
    words = max(BLOCK_WORDS, min(wanted, most_bytes // 8) // BLOCK_WORDS * BLOCK_WORDS)
    blocks = words // BLOCK_WORDS

    def pairs(batches):
        import pyarrow as pa

        for batch in batches:
            hashes = np.asarray(batch.column(0)).view(_U)
            bits = _bits(hashes)
            word = _block(hashes, blocks)[:, None] * _U(BLOCK_WORDS) + (bits >> _U(6))
            mask = _U(1) << (bits & _U(63))
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.ravel().astype(np.int64)), pa.array(mask.ravel().view(np.int64))], names=["word", "mask"]
            )

    merged = keys.mapInArrow(pairs, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    filled = np.zeros(words, dtype=_U)
    table = merged.toArrow()  # at most most_bytes / 8 rows
    filled[np.asarray(table["word"], dtype=np.int64)] = np.asarray(table["mask"], dtype=np.int64).view(_U)
    return BlockedBloom(filled)
