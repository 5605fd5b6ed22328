"""Token ids of whole documents with the tokenizers library, encoding every distinct chunk once.

A byte-level BPE never merges over the place where a space follows a character that is no white
space, so a text may be cut there and its ids are those of its chunks, one after the other. Most
chunks repeat; a block of documents hands the library only chunks it has not seen, many to a line,
and the ids are put together with array operations. A hash finds a chunk among those seen, and its
bytes decide whether it is that chunk. Tests hold the result against the library's own
encoding of whole texts.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from pinwatch.llm.blocks import _U, Pieces, byte_pieces, document_runs, text_bytes

#: Bytes of text encoded at once; how many chunks a worker remembers, and how many pieces of eight of their
#: bytes, before it starts anew.
ENCODE_BYTES, REMEMBERED, REMEMBERED_PIECES = 2 << 20, 750_000, 3_000_000
#: Characters of distinct chunks that go to the library as one line.
LINE_BYTES = 2_000

def _solid(data: np.ndarray) -> np.ndarray:
    """Whether each byte ends a character that is surely no white space: a visible ASCII character or
    a two-byte one beyond U+00BF. Other characters count as unsure, which only makes chunks longer."""
    solid = (data > 0x20) & (data < 0x7F)
    solid[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    return solid


def chunk_starts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every chunk of the documents between ``bounds``, and which bytes are solid."""
    solid = _solid(data)
    begins = np.zeros(len(data), dtype=bool)
    begins[1:] = (data[1:] == 0x20) & solid[:-1]
    heads = bounds[:-1][np.diff(bounds) > 0]
    begins[heads] = True
    return np.flatnonzero(begins), solid


class _Pool:
    """Values that only grow, one addition after the other."""

    def __init__(self, kind):
        self.values, self.used = np.zeros(1 << 16, dtype=kind), 0

    def add(self, values: np.ndarray) -> int:
        """Append; gives the place of the first."""
        at, self.used = self.used, self.used + len(values)
        if self.used > len(self.values):
            self.values = np.concatenate([self.values, np.zeros(max(len(values), len(self.values)), dtype=self.values.dtype)])
        self.values[at : self.used] = values
        return at


class ChunkEncoder:
    """Ids of documents from a tokenizer whose tokens never cross a chunk's start.

    ``token_bytes[id]`` is the number of bytes of normalised text a token stands for.
    """

    def __init__(self, tokenizer, token_bytes: np.ndarray):
        self.tokenizer, self.token_bytes = tokenizer, token_bytes
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=_U)
        self.place = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int32)
        self.pool = _Pool(np.uint32)
        self.bytes = _Pool(np.uint64)
        self.byte_place = np.zeros(0, dtype=np.int64)
        self.byte_length = np.zeros(0, dtype=np.int32)

    def normalised(self, chunk: bytes) -> bytes:
        """The text whose bytes the tokens of a chunk add up to."""
        return chunk

    def chunk_ids(self, chunks: list[bytes], joinable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after the other, and how many each has. Joinable chunks share lines."""
        order = np.argsort(~joinable, kind="stable")
        lines, line, room = [], [], LINE_BYTES
        for i in order.tolist():
            if not joinable[i] or room <= 0:
                if line:
                    lines.append(b"".join(line).decode("utf-8", "replace"))
                line, room = [], LINE_BYTES
            line.append(chunks[i])
            room -= len(chunks[i])
        lines.append(b"".join(line).decode("utf-8", "replace"))
        encoded = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.asarray(e.ids, dtype=np.uint32) for e in encoded])
        reach = np.cumsum(self.token_bytes[ids])
        ends = np.cumsum([len(self.normalised(chunks[i])) for i in order.tolist()])
        last = np.searchsorted(reach, ends)
        if len(ids) and not np.array_equal(reach[last], ends):
            raise ValueError("a token crosses the start of a chunk; this tokenizer can't be used by chunks")
        counts = np.diff(np.concatenate([[0], last + 1])) if len(ids) else np.zeros(len(chunks), dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return _gather(ids, starts[back], counts[back]), counts[back]

    def _learn(self, hashes: np.ndarray, chunks: list[bytes], pieces: Pieces, joinable: np.ndarray) -> np.ndarray:
        """Remember chunks under their sorted hashes; gives the places where these were put in."""
        ids, counts = self.chunk_ids(chunks, joinable)
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.place = np.insert(self.place, at, self.pool.add(ids) + np.cumsum(counts) - counts)
        self.length = np.insert(self.length, at, counts)
        self.byte_place = np.insert(self.byte_place, at, self.bytes.add(pieces.values) + np.cumsum(pieces.counts) - pieces.counts)
        self.byte_length = np.insert(self.byte_length, at, pieces.lengths)
        return at

    def _same(self, entry: np.ndarray, pieces: Pieces) -> np.ndarray:
        """Whether each entry holds the very bytes of the chunk beside it."""
        same = self.byte_length[entry] == pieces.lengths
        counts = np.where(same, pieces.counts, 0)
        held = _gather(self.bytes.values, self.byte_place[entry], counts)
        wrong = np.concatenate([[0], np.cumsum(held != _gather(pieces.values, np.cumsum(pieces.counts) - pieces.counts, counts))])
        ends = np.cumsum(counts)
        return same & (wrong[ends] == wrong[ends - counts])

    def _entries(self, data: np.ndarray, starts: np.ndarray, solid: np.ndarray) -> np.ndarray:
        """The entry of each chunk. A chunk whose hash belongs to other bytes gets another hash."""
        if len(self.known) > REMEMBERED or self.bytes.used > REMEMBERED_PIECES:
            self._forget()
        ends = np.append(starts[1:], len(data))
        pieces, raw = byte_pieces(data, starts, ends), None
        hashes, salt, left, own = pieces.hashes(), 0, np.arange(len(starts)), pieces
        while True:
            distinct, first, which = np.unique(hashes[left], return_index=True, return_inverse=True)
            fresh = np.flatnonzero(~np.isin(distinct, self.known, assume_unique=True))
            if len(fresh):
                at = left[first[fresh]]
                raw = raw or data.tobytes()
                chunks = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                self._learn(distinct[fresh], chunks, pieces.take(at), (data[starts[at]] == 0x20) & solid[ends[at] - 1])
            entry = np.searchsorted(self.known, distinct)[which]
            wrong = np.flatnonzero(~self._same(entry, own))
            if not len(wrong):
                return entry if len(entry) == len(hashes) else np.searchsorted(self.known, hashes)
            left = left[wrong]
            salt, own = salt + 1, pieces.take(left)
            hashes[left] = own.hashes(salt)

    def encode_block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents between ``bounds`` and the offset of every document's first id."""
        ids, before, _ = self.encode_chunks(data, bounds)
        return ids, before

    def encode_chunks(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same and every chunk's entry."""
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(bounds), dtype=np.int64), np.zeros(0, dtype=np.int64)
        starts, solid = chunk_starts(data, bounds)
        entry = self._entries(data, starts, solid)
        lengths = self.length[entry]
        ids = _gather(self.pool.values, self.place[entry], lengths)
        before = np.concatenate([[0], np.cumsum(lengths)])
        return ids, before[np.searchsorted(starts, bounds)], entry

    def encode(self, column: pa.Array):
        """For runs of rows of a string column: first row, ids, and the offset of every row's first id."""
        data, offsets = text_bytes(column)
        for first, last in document_runs(offsets, ENCODE_BYTES):
            base = offsets[first]
            ids, bounds = self.encode_block(data[base : offsets[last]], offsets[first : last + 1] - base)
            yield first, ids, bounds


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` that begin at ``starts``, one after the other."""
    total = int(lengths.sum())
    shift = starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(starts) else starts
    return pool[np.arange(total) + np.repeat(shift, lengths)]


@lru_cache(maxsize=4)
def byte_level(path: str, added_tokens: bool = False) -> ChunkEncoder:
    """The encoder of a byte-level BPE file of the tokenizers library. With ``added_tokens`` a text that
    quotes an added token of the file, such as a special one, gets its id, as the library does by
    default; without, such strings are ordinary text. Kept for the life of a Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added_tokens
    content = json.loads(tokenizer.to_str())
    lengths = {number: len(token) for token, number in content["model"]["vocab"].items()}
    for token in content["added_tokens"]:
        # Chunks start at spaces, and a token has to stand for its own bytes alone.
        if added_tokens and (" " in token["content"] or token["lstrip"] or token["rstrip"]):
            raise ValueError(f"the added token {token['content']!r} may hold or take in spaces; this tokenizer can't be used by chunks")
        lengths[token["id"]] = len(token["content"].encode())
    sizes = np.zeros(max(lengths) + 1, dtype=np.int64)
    sizes[list(lengths)] = list(lengths.values())
    return ChunkEncoder(tokenizer, sizes)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
