import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pinwatch.llm.encoders import byte_level, vocabulary_path
from pinwatch.llm.packing import LevelArray, pack, padding
from tests.llm.helpers import awkward_rows, awkward_texts, frame


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_ids_are_those_of_the_library(library):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "日", "'s", "1", ",", " ", "　", "\x1c", "​", "<|endoftext|>", "🙂", "word", "\x85"]
    texts = [t or "" for t in awkward_texts()] + ["".join(rng.choices(parts, k=rng.randrange(1, 50))) for _ in range(3_000)]
    encoder, seen = byte_level(vocabulary_path()), 0
    for first, ids, bounds in encoder.encode(pa.array(texts)):
        for k in range(len(bounds) - 1):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(texts[first + k], add_special_tokens=False).ids
            seen += 1
    assert seen == len(texts)


def test_a_worker_that_forgets_encodes_alike(library, monkeypatch):
    from pinwatch.llm import encoders

    monkeypatch.setattr(encoders, "REMEMBERED", 10)
    monkeypatch.setattr(encoders, "ENCODE_BYTES", 500)
    texts = [t or "" for t in awkward_texts()]
    got = [ids[b[k] : b[k + 1]].tolist() for _, ids, b in byte_level(vocabulary_path()).encode(pa.array(texts)) for k in range(len(b) - 1)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_id_lies_in_one_piece(spark, crowded, library):
    rows = pack(crowded, vocabulary_path(), with_ids=True).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and len(r.ids) == r.length > 0
        sequences[r.sequence_id].append(r)
        documents[r.doc_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    expected = defaultdict(Counter)
    for doc_id, text, *_ in awkward_rows():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        expected[doc_id].update(enumerate(ids))
    assert set(documents) == set(expected)
    for doc_id, pieces in documents.items():
        assert Counter((r.start + i, x) for r in pieces for i, x in enumerate(r.ids)) == expected[doc_id]


def test_little_padding_and_an_empty_table(docs, nothing):
    total = padding(pack(docs.coalesce(1), vocabulary_path())).first()
    assert total.padding < 1024
    assert pack(nothing, vocabulary_path()).count() == 0


def test_placement_is_the_least_sum_of_squares():
    rng, size = random.Random(5), 16
    levels = LevelArray(size)
    for i in range(2_000):
        length = rng.randrange(1, size)

        def squares(level):
            counts = levels.counts.copy()
            if level:
                counts[level] -= 1
            if level + length < size:
                counts[level + length] += 1
            return int((counts[1:size] ** 2).sum())

        usable = [h for h in range(size - length + 1) if h == 0 or levels.counts[h]]
        best = min(usable, key=lambda h: (squares(h), -h))
        assert squares(levels.best_level(length)) == squares(best)
        levels.place((i, 0, np.arange(length), length))
        assert all(len(w) == c for w, c in zip(levels.windows, levels.counts, strict=True))


def test_open_windows_are_filled_up():
    levels, rng, ids = LevelArray(64), random.Random(1), 0
    full = []
    for i in range(300):
        n = rng.randrange(1, 64)
        ids += n
        window = levels.place((i, 0, np.arange(n), n))
        full += [window] if window else []
    full += list(levels.close())
    sizes = [sum(len(p[2]) for p in w) for w in full]
    assert sum(sizes) == ids and sum(s < 64 for s in sizes) <= 1
    seen = Counter((p[0], int(x)) for w in full for p in w for x in p[2])
    assert max(seen.values()) == 1
    assert all(int(p[2][0]) == p[1] for w in full for p in w)


def test_the_same_input_gives_the_same_rows(docs, spark):
    one = frame(spark, awkward_rows()).coalesce(2)
    runs = [sorted(map(str, pack(one, vocabulary_path()).collect())) for _ in range(2)]
    assert runs[0] == runs[1]


def test_quoted_special_tokens_have_the_ids_of_the_library(spark):
    from pinwatch.llm.token_rollup import counted

    plain, rng = Tokenizer.from_file(vocabulary_path()), random.Random(4)
    parts = [" ", "  ", "\n", "a", "é", "日", "'s", ",", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "word", " word"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a  <|endoftext|><|endoftext|> b"]
    texts += ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(1_000)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    rows = frame(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])
    got = defaultdict(dict)
    for r in pack(rows, vocabulary_path(), with_ids=True).collect():
        got[r.doc_id].update(enumerate(r.ids, r.start))
        assert r.doc_tokens == len(want[r.doc_id]) + 1
    assert [[x for _, x in sorted(got[i].items())][:-1] for i in range(len(texts))] == want
    sizes = {r.doc_id: r.text_ids for r in counted(rows.select("doc_id", "text"), vocabulary_path(), ("text",)).collect()}
    assert sizes == {i: len(ids) for i, ids in enumerate(want)}
