"""Different texts that sums of powers of a base can't tell apart, whatever the base; and weak hashes."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pinwatch.llm import blocks
from pinwatch.llm.encoders import byte_level, vocabulary_path
from pinwatch.llm.jaccard import shingle_components
from pinwatch.llm.packing import pack
from pinwatch.llm.pieces import piece_report
from pinwatch.llm.substrings import substring_duplicates
from tests.llm.helpers import frame, prose

SWAP = str.maketrans("ab", "ba")


def mirrored(steps):
    """A sequence of two letters in which each half mirrors the other, and its mirror image."""
    text = "a"
    for _ in range(steps):
        text += text.translate(SWAP)
    return text, text.translate(SWAP)


ONE, OTHER = mirrored(10)


def rows(*texts):
    return [(i, t, None, None, None) for i, t in enumerate(texts)]


def test_hashes_tell_mirrored_words_windows_and_spans_apart():
    data = np.frombuffer(f"{ONE} {OTHER}".encode(), dtype=np.uint8)
    words = blocks.words(data, np.array([0, len(data)]))
    assert words.hashes[0] != words.hashes[1] and words.second[0] != words.second[1]
    letters = np.frombuffer((ONE + OTHER).encode(), dtype=np.uint8).astype(np.uint64)
    n = len(ONE)
    assert blocks.window_hashes(letters, n)[0] != blocks.window_hashes(letters, n)[n]
    first, second = blocks.span_hashes(letters, np.array([0, n]), np.array([n, 2 * n]))
    assert first != second


@pytest.mark.parametrize("size", range(1, 40))
def test_a_window_hash_depends_on_its_values_alone(size):
    values = np.array([7, 3, 9, 1, 5] * 24, dtype=np.uint64)
    found = blocks.window_hashes(values, size)
    assert len(found) == len(values) - size + 1
    seen = {}
    for i, h in enumerate(found.tolist()):
        assert seen.setdefault(tuple(values[i : i + size].tolist()), h) == h
    assert len(set(found.tolist())) == len(seen)


def test_packing_gives_mirrored_texts_their_own_ids(spark):
    path = vocabulary_path()
    tokenizer = Tokenizer.from_file(path)
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in pack(frame(spark, rows(ONE, OTHER)).coalesce(1), path).filter("start = 0").collect()}
    for i, text in enumerate((ONE, OTHER)):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        assert got[i][0] == len(ids)
        if len(ids) <= 1024:
            assert got[i][1] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_documents_of_mirrored_words_are_not_linked(spark):
    found = shingle_components(frame(spark, rows(ONE, OTHER, f"x {ONE} y", f"x {OTHER} y")), size=3, percent=90).collect()
    assert {(r.doc_id, r.component_id, r.class_id) for r in found} == {(i, i, i) for i in range(4)}


def test_windows_that_differ_in_one_mirrored_word_do_not_repeat(spark):
    rng = random.Random(5)
    left, right = prose(rng, 17), prose(rng, 17)
    texts = [f"{left} {w} {right}" for w in (ONE, OTHER)]
    # Word sequences that mirror each other have keys of their own as well.
    texts += [" ".join(mirrored(9)[0]), " ".join(mirrored(9)[1])]
    got = {r.doc_id: r for r in substring_duplicates(frame(spark, rows(*texts))).collect()}
    for i in (0, 1):
        assert got[i].n_removed == 0
        assert got[i].kept_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()


def test_pieces_of_mirrored_texts_agree_with_the_library(spark):
    found = piece_report(frame(spark, rows(ONE, OTHER, f"x {ONE}", f"x {OTHER} ")), vocabulary_path("piece_bpe_32k.model")).collect()
    assert all(r.parity and r.round_trip for r in found)


def test_chunks_with_equal_hashes_keep_their_own_ids(monkeypatch):
    """With eight bits of hash nearly all chunks collide; ids are still those of the library."""
    strong = blocks.Pieces.hashes
    monkeypatch.setattr(blocks.Pieces, "hashes", lambda self, salt=0: strong(self, salt) & np.uint64(0xFF))
    path = vocabulary_path()
    byte_level.cache_clear()
    rng = random.Random(3)
    texts = [prose(rng, 40, 60), "", ONE, prose(rng, 40, 60), OTHER]
    encoder = byte_level(path, added_tokens=True)
    tokenizer = Tokenizer.from_file(path)
    body = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in body])])
    ids, offsets = encoder.encode_block(np.frombuffer(b"".join(body), dtype=np.uint8), bounds)
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    byte_level.cache_clear()
