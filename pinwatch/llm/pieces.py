"""SentencePiece models on the tokenizers library: encoding, decoding, and parity with the original.

The model file is read as a protocol buffer, field by field. From it come the vocabulary with its
scores (unigram) or its merges in order of score (BPE), the normaliser, the marker that stands for a
space, and the bytes that unknown characters fall back to. Batches are encoded on as many threads as
asked for.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pinwatch.llm.blocks import document_runs, text_bytes
from pinwatch.llm.encoders import ENCODE_BYTES, ChunkEncoder, _gather, chunk_starts

MARK = "▁"
# Fixed values of the public model format: field numbers, kinds of models, kinds of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a message: integers, or the bytes of anything else."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"unknown wire type {kind}: this is no model file")
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        model = cls()
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL, **dict(_fields(value))}
                model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
            elif number == 2:
                trainer = dict(_fields(value))
                model.kind = trainer.get(3, UNIGRAM)
                model.byte_fallback = bool(trainer.get(35, 0))
            elif number == 3:
                normaliser = dict(_fields(value))
                model.charsmap = normaliser.get(2, b"")
                model.dummy_prefix = bool(normaliser.get(3, 1))
                model.trim_spaces = bool(normaliser.get(4, 1))
                model.escape_spaces = bool(normaliser.get(5, 1))
        return model

    def unknown_id(self) -> int:
        return next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that form a piece, the best-scored piece first."""
        number = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = []
        for piece, i in number.items():
            pairs = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in number and piece[k:] in number]
            found += [(-self.pieces[i][1], i, number[a], number[b], (a, b)) for a, b in pairs]
        return [pair for *_, pair in sorted(found)]

    def core(self):
        from tokenizers import models

        vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        if self.kind == UNIGRAM:
            return models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown_id(), self.byte_fallback)
        if self.kind == BPE:
            unknown = self.pieces[self.unknown_id()][0]
            return models.BPE(vocabulary, self.merges(), unk_token=unknown, fuse_unk=True, byte_fallback=self.byte_fallback)
        raise ValueError("only unigram and BPE models can be rebuilt")

    def normaliser(self, whole: bool):
        """The model's normaliser for whole texts, or that part of it which applies within them."""
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim_spaces:
            steps += [normalizers.Strip()] * whole + [normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix and whole:
            steps.append(normalizers.Prepend(" "))
        if self.escape_spaces:
            steps.append(normalizers.Replace(" ", MARK))
        return normalizers.Sequence(steps)

    def tokenizer(self, whole: bool = True):
        """The model as a tokenizer of whole texts, or of chunks that bring their leading spaces."""
        from tokenizers import Regex, Tokenizer, decoders, pre_tokenizers

        tokenizer = Tokenizer(self.core())
        tokenizer.normalizer = self.normaliser(whole)
        if self.splittable():
            tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        if whole and self.dummy_prefix:
            steps.append(decoders.Strip(" ", 1, 0))
        tokenizer.decoder = decoders.Sequence(steps)
        return tokenizer

    def splittable(self) -> bool:
        """Whether no piece goes on after a space that follows something else, so that texts may be cut
        before such spaces."""
        return all(MARK not in p.lstrip(MARK) for p, _, kind in self.pieces if kind == NORMAL)

    def by_chunks(self) -> bool:
        """Whether chunks can be encoded apart: cuts are safe and normalising changes nothing but spaces."""
        return self.splittable() and not self.charsmap and not self.trim_spaces and self.escape_spaces and self.byte_fallback


class PieceEncoder(ChunkEncoder):
    """Ids by the rebuilt tokenizer; every distinct chunk is also encoded by the original library and
    decoded again, and remembered as faithful if both agree."""

    def __init__(self, model: PieceModel, path: str):
        import sentencepiece

        self.original = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = model
        spelled = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.encode() for p, _, kind in model.pieces]
        super().__init__(model.tokenizer(whole=False), np.array([len(b) for b in spelled]))
        plain = [b.replace(MARK.encode(), b" ") for b in spelled]
        self.spelling = np.frombuffer(b"".join(plain), dtype=np.uint8)
        self.spelling_size = np.array([len(b) for b in plain])
        self.spelling_start = np.concatenate([[0], np.cumsum(self.spelling_size)[:-1]])

    def normalised(self, chunk: bytes) -> bytes:
        return chunk.replace(b" ", MARK.encode())

    def chunk_ids(self, chunks, joinable):
        ids, counts = super().chunk_ids(chunks, joinable)
        bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
        texts = [c.decode("utf-8", "replace") for c in chunks]
        listed, faithful = ids.tolist(), np.zeros(len(chunks), dtype=bool)
        # The original puts the space before a text itself, unless the model says otherwise. A chunk that is
        # a space alone stands at a text's end.
        ours = [[i for i, t in enumerate(texts) if (t == " ") == alone and (t.startswith(" ") or not self.model.dummy_prefix)] for alone in (False, True)]
        skip = 1 if self.model.dummy_prefix else 0
        for i, theirs in zip(ours[0], self.original.encode([texts[i][skip:] for i in ours[0]], num_threads=1), strict=True):
            faithful[i] = listed[bounds[i] : bounds[i + 1]] == theirs
        if ours[1]:
            theirs = self.original.encode("a ")[len(self.original.encode("a")) :]
            for i in ours[1]:
                faithful[i] = listed[bounds[i] : bounds[i + 1]] == theirs
        if not np.array_equal(self.spelled(ids), np.frombuffer(b"".join(chunks), dtype=np.uint8)):
            decoded = self.tokenizer.decode_batch([listed[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], skip_special_tokens=False)
            faithful &= np.array([a == b for a, b in zip(decoded, texts, strict=True)])
        self.faithful_chunks = faithful
        return ids, counts

    def _learn(self, hashes, chunks, pieces, joinable):
        at = super()._learn(hashes, chunks, pieces, joinable)
        self.faithful = np.insert(self.faithful, at, self.faithful_chunks)
        return at

    def _forget(self):
        super()._forget()
        self.faithful = np.zeros(0, dtype=bool)

    def encode_checked(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, offsets, and which of the documents between ``bounds`` consist of faithful chunks."""
        ids, before, entry = self.encode_chunks(data, bounds)
        if not len(data):
            return ids, before, np.ones(len(bounds) - 1, dtype=bool)
        odd = np.concatenate([[0], np.cumsum(~self.faithful[entry])])
        places = np.searchsorted(chunk_starts(data, bounds)[0], bounds)
        return ids, before, odd[places[1:]] == odd[places[:-1]]

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for, one after the other."""
        return _gather(self.spelling, self.spelling_start[ids], self.spelling_size[ids])


@lru_cache(maxsize=4)
def load(path: str, threads: int = 1) -> tuple[PieceModel, object]:
    """The model at ``path`` and its encoder, once per Python worker: by chunks where that is exact, else
    the tokenizer of whole texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    with open(path, "rb") as file:
        model = PieceModel.parse(file.read())
    return model, PieceEncoder(model, path) if model.by_chunks() else model.tokenizer()


def _prefixed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents with a space before each that is not empty."""
    some = (np.diff(offsets) > 0).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.diff(offsets) + some)])
    out = np.full(bounds[-1], 0x20, dtype=np.uint8)
    rows = np.repeat(np.cumsum(some), np.diff(offsets))
    out[np.arange(len(data)) + rows] = data
    return out, bounds


def _encoded(column: pa.Array, path: str, threads: int) -> Iterator[tuple[int, list[np.ndarray], list[bool], list[str]]]:
    """For runs of rows: first row, ids, faithfulness and decoded text of every row."""
    model, encoder = load(path, threads)
    data, offsets = text_bytes(column)
    for first, last in document_runs(offsets, ENCODE_BYTES):
        base, bounds = int(offsets[first]), offsets[first : last + 1] - offsets[first]
        body = data[base : int(offsets[last])]
        if isinstance(encoder, PieceEncoder):
            if model.dummy_prefix:
                body, bounds = _prefixed(body, bounds)
            ids, places, faithful = encoder.encode_checked(body, bounds)
            rows = [ids[places[k] : places[k + 1]] for k in range(last - first)]
            skip = 1 if model.dummy_prefix else 0
            texts = [encoder.spelled(r).tobytes()[skip:].decode("utf-8", "replace") for r in rows]
            yield first, rows, faithful.tolist(), texts
        else:
            import sentencepiece

            original = sentencepiece.SentencePieceProcessor(model_file=path)
            texts = [bytes(body[bounds[k] : bounds[k + 1]]).decode() for k in range(last - first)]
            found = [e.ids for e in encoder.encode_batch(texts, add_special_tokens=False)]
            theirs = original.encode(texts, num_threads=threads)
            yield first, [np.array(f, dtype=np.uint32) for f in found], [a == b for a, b in zip(found, theirs, strict=True)], encoder.decode_batch(found)


def encode_pieces(docs: DataFrame, model_path: str, threads: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids, parity`` for every row of ``docs``; ``parity`` says that the original library gives the
    same ids for all parts of the text. Null and empty texts have no ids. Null ids of rows stay null,
    repeated rows are encoded each for itself, texts of any length whole; other columns are not read. An empty
    table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, faithful, _ in _encoded(batch.column(1), model_path, threads):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(rows)), pa.array([r.tolist() for r in rows], pa.list_(pa.int32())), pa.array(faithful, pa.bool_())],
                    names=["doc_id", "ids", "parity"],
                )

    return _narrow(docs, id_column, text_column).mapInArrow(run, "doc_id long, ids array<int>, parity boolean")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``. A null or empty list is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(model_path, "rb") as file:
            tokenizer = PieceModel.parse(file.read()).tokenizer()
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            texts = tokenizer.decode_batch(lists, skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_report(docs: DataFrame, model_path: str, threads: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_ids, ids_crc32, parity, round_trip, decoded_sha256``: digests of the ids and of the text
    that they decode to, and whether both agree with the original library and the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for first, rows, faithful, decoded in _encoded(texts, model_path, threads):
                own = texts.slice(first, len(rows)).to_pylist()
                raw = [d.encode() for d in decoded]
                columns = [
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()),
                    pa.array(faithful, pa.bool_()),
                    pa.array([d == (t or "") for d, t in zip(decoded, own, strict=True)], pa.bool_()),
                    pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(rows)), *columns],
                    names=["doc_id", "n_ids", "ids_crc32", "parity", "round_trip", "decoded_sha256"],
                )

    schema = "doc_id long, n_ids long, ids_crc32 long, parity boolean, round_trip boolean, decoded_sha256 string"
    return _narrow(docs, id_column, text_column).mapInArrow(run, schema)


def _narrow(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
