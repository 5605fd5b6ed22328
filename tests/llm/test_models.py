"""LM scores, token rollups, SentencePiece and license scans."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pinwatch.llm import licenses, lm_score, pieces, token_rollup
from pinwatch.llm.encoders import vocabulary_path
from pinwatch.session import scratch_path
from tests.llm.helpers import awkward_rows, awkward_texts, frame, prose, words

PIECES = vocabulary_path("piece_bpe_32k.model")

# scores


def expected_scores(rows, targets, size, weight):
    texts = [words(r[1]) for r in rows]
    times = Counter(w for t in texts for w in t)
    known = set(sorted(times, key=lambda w: (-times[w], w.encode()))[:size])
    coded = [["<s>"] + [w if w in known else "" for w in t] for t in texts]

    def model(chosen):
        pairs = Counter((a, b) for t in chosen for a, b in zip(t, t[1:], strict=False))
        before, single = Counter(), Counter()
        for (a, b), n in pairs.items():
            before[a] += n
            single[b] += n
        total = sum(single.values()) + len(known) + 1

        def loss(a, b):
            p = (single[b] + 1) / total
            return -math.log(weight * pairs[a, b] / before[a] + (1 - weight) * p) if before[a] else -math.log(p)

        return loss

    target, background = model([c for r, c in zip(rows, coded, strict=True) if r[0] in targets]), model(coded)
    out = []
    for r, c in zip(rows, coded, strict=True):
        n = len(c) - 1
        means = [sum(m(a, b) for a, b in zip(c, c[1:], strict=False)) / n if n else None for m in (target, background)]
        out.append((r[0], n, *means))
    return out


@pytest.mark.parametrize(("size", "targets"), [(2048, {8, 20, 30, 31}), (20, {3, 8, 40}), (50, set())])
def test_scores(spark, crowded, size, targets):
    ids = spark.createDataFrame([(i,) for i in targets] * 2 + [(None,)], "doc_id long")
    got = lm_score.cross_entropy_difference(crowded, ids, size).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    want = sorted(expected_scores(awkward_rows(), targets, size, lm_score.BIGRAM_WEIGHT), key=key)
    for r, w in zip(sorted([tuple(r) for r in got], key=key), want, strict=True):
        assert r[:2] == w[:2]
        if w[1]:
            assert r[2] == pytest.approx(w[2], abs=2e-6) and r[3] == pytest.approx(w[3], abs=2e-6) and r[4] == pytest.approx(w[2] - w[3], abs=2e-6)
        else:
            assert r[2:] == (None, None, None)


@pytest.mark.parametrize(("limit", "targets"), [(1_000_000, {8, 20, 30, 31}), (50, {8, 20}), (1_000_000, set())])
def test_scores_with_all_words(spark, crowded, limit, targets, monkeypatch):
    monkeypatch.setattr(lm_score._scored_by_all_words, "__defaults__", (limit,))
    rows = awkward_rows()
    ids = spark.createDataFrame([(i,) for i in targets] * 2 + [(None,)], "doc_id long")
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    got = sorted([tuple(r) for r in lm_score.cross_entropy_difference(crowded, ids, None).collect()], key=key)
    want = sorted(expected_scores(rows, targets, len({w for r in rows for w in words(r[1])}), lm_score.BIGRAM_WEIGHT), key=key)
    for r, w in zip(got, want, strict=True):
        assert r[:2] == w[:2]
        assert r[2:] == ((None,) * 3 if not w[1] else (pytest.approx(w[2], abs=2e-6), pytest.approx(w[3], abs=2e-6), pytest.approx(w[2] - w[3], abs=2e-6)))


def test_scores_tell_the_target(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(("fish" if i % 2 else "fowl") + str(rng.randrange(30)) for _ in range(80)), "en", "s", 1) for i in range(60)]
    ids = spark.createDataFrame([(i,) for i in range(1, 40, 2)], "doc_id long")
    got = {r.doc_id: r.difference for r in lm_score.cross_entropy_difference(frame(spark, rows), ids).collect()}
    assert max(got[i] for i in range(41, 60, 2)) < min(got[i] for i in range(40, 60, 2))


def test_no_documents_to_score(nothing, spark):
    assert lm_score.cross_entropy_difference(nothing, spark.createDataFrame([], "doc_id long")).count() == 0


# token counts


def test_history_of_a_corpus(spark, docs):
    library = Tokenizer.from_file(vocabulary_path())
    count = {"words-1": lambda t: len(words(t)), "byte_bpe_50k": lambda t: len(library.encode(t, add_special_tokens=False).ids)}
    groups = defaultdict(list)
    for r in awkward_rows():
        groups[r[1] or ""].append(r)
    want = Counter()
    for text, rows in groups.items():
        stays = min(rows, key=lambda r: (r[0] is None, r[0] or 0))
        for version, size in count.items():
            key = (stays[3], stays[2], version)
            want[(*key, "documents")] += 1
            want[(*key, "tokens")] += size(" ".join(words(text)))
    rollup = token_rollup.TokenRollup(spark, scratch_path(spark, "test-rollup"))
    rows = token_rollup.corpus_history(docs, rollup, vocabulary_path()).collect()
    got = {(r.source, r.lang, r.tokenizer, kind): r[kind] for r in rows for kind in ("documents", "tokens")}
    # rows with the same text and id differ in nothing else here, so whichever stays is the same
    assert got == dict(want)


def test_many_sources_are_written_by_several_tasks(spark):
    path, rows = scratch_path(spark, "test-rollup"), [(f"host{i}", "en", "v", 1, i) for i in range(200)]
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "4"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rollup = token_rollup.TokenRollup(spark, path)
        rollup.commit("a", spark.createDataFrame(rows, token_rollup.TOTALS))
        rollup.compact()
        for folder in ("deltas/a", "bases/1/totals"):
            assert len(spark.read.parquet(f"{path}/{folder}").inputFiles()) > 1
        assert {tuple(r) for r in rollup.totals().collect()} == set(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_batches_count_once(spark):
    schema = "source string, lang string, tokenizer string, documents long, tokens long"
    changes = lambda *rows: spark.createDataFrame(list(rows), schema)
    path = scratch_path(spark, "test-rollup")
    rollup = token_rollup.TokenRollup(spark, path)
    assert rollup.totals().count() == 0
    assert rollup.commit("a/1", changes(("s", "en", "v", 2, 30), ("s", None, "v", 1, 5), (None, None, None, 1, 1)))
    assert not rollup.commit("a/1", changes(("s", "en", "v", 100, 100)))
    # a batch that broke off before its marker: its rows lie there but don't count, and are replaced
    changes(("s", "en", "v", 7, 7)).write.parquet(f"{path}/deltas/b")
    totals = lambda: {tuple(r) for r in token_rollup.TokenRollup(spark, path).totals().collect()}
    assert ("s", "en", "v", 2, 30) in totals()
    assert rollup.commit("b", changes(("s", "en", "v", -1, -12), ("s", None, "v", -1, -5), ("s", "en", "v", 0, 4)))
    want = {("s", "en", "v", 1, 22), (None, None, None, 1, 1)}
    assert totals() == want
    rollup.compact()
    assert totals() == want
    assert not rollup.commit("b", changes(("s", "en", "v", 9, 9)))
    assert rollup.commit("c", changes(("s", "en", "v", 1, 1)))
    assert totals() == {("s", "en", "v", 2, 23), (None, None, None, 1, 1)}
    rollup.compact()
    assert rollup.commit("empty", changes()) and totals() == {("s", "en", "v", 2, 23), (None, None, None, 1, 1)}


# pieces


@pytest.fixture(scope="module")
def original():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def odd_texts():
    rng = random.Random(8)
    parts = [" ", "  ", "\n", "\t", "a", "the", "é", "日", "1", ",", "▁", "🙂", "word", "<s>", "<unk>", "<0x0A>", "\u00a0", "ß"]
    return [t or "" for t in awkward_texts()] + ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(800)]


def test_rebuilt_tokenizer_agrees_on_whole_texts(original):
    model = pieces.PieceModel.parse(open(PIECES, "rb").read())
    texts = [t for t in odd_texts() if len(t) < 5_000 and "▁" not in t]
    rebuilt = model.tokenizer()
    assert [e.ids for e in rebuilt.encode_batch(texts, add_special_tokens=False)] == original.encode(texts)
    assert rebuilt.decode_batch(original.encode(texts), skip_special_tokens=False) == texts


def test_encoding_by_chunks(spark, original):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, None, 0)], "doc_id long, text string, ids int").repartition(3)
    encoded = pieces.encode_pieces(docs, PIECES, threads=2)
    rows = encoded.collect()
    for r in rows:
        want = original.encode(texts[r.doc_id] if r.doc_id is not None else "")
        assert not r.parity or r.ids == want
    assert sum(not r.parity for r in rows) <= sum("▁" in t for t in texts)
    decoded = {r.doc_id: r.text for r in pieces.decode_pieces(encoded, PIECES).collect()}
    for i, t in enumerate(texts):
        assert decoded[i] == t.replace("▁", " ")
    report = {r.doc_id: r for r in pieces.piece_report(docs, PIECES).collect()}
    for r in rows:
        p = report[r.doc_id]
        assert (p.n_ids, p.ids_crc32, p.parity) == (len(r.ids), zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()), r.parity)
        text = texts[r.doc_id] if r.doc_id is not None else ""
        assert p.round_trip == ("▁" not in text)
        if p.round_trip:
            assert p.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert pieces.piece_report(docs.filter("false"), PIECES).count() == 0


def test_unigram_model_from_its_file(tmp_path):
    """A model file written by hand: scores, byte fallback, and a normaliser that trims spaces."""

    def varint(n):
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    def message(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    def piece(text, score, kind):
        import struct

        return message(1, message(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + varint(3 << 3) + varint(kind))

    entries = [("<unk>", 0, 2), *[(f"<0x{i:02X}>", -20, 6) for i in range(256)], ("▁", -3, 1), ("▁a", -2, 1), ("b", -4, 1), ("ab", -3, 1), ("a", -5, 1), ("▁ab", -6, 1)]
    data = b"".join(piece(*e) for e in entries) + message(2, varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1)) + message(3, varint(3 << 3) + varint(1) + varint(4 << 3) + varint(1))
    path = tmp_path / "unigram.model"
    path.write_bytes(data)
    model = pieces.PieceModel.parse(data)
    assert (model.kind, model.byte_fallback, model.trim_spaces, len(model.pieces)) == (pieces.UNIGRAM, True, True, len(entries))
    original = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["ab", "abab", " a  b ", "az", "", "é ab", "a b ab aab"]
    assert [e.ids for e in model.tokenizer().encode_batch(texts, add_special_tokens=False)] == original.encode(texts)
    assert not model.by_chunks()
    for first, rows, faithful, _ in pieces._encoded(pa.array(texts), str(path), 1):
        assert first == 0 and all(faithful) and [r.tolist() for r in rows] == original.encode(texts)


# licenses


def license_shingles(text):
    import re

    w = re.findall("[0-9a-z]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def expected_licenses(rows, contained=0.8):
    out = Counter()
    for doc_id, text, *_ in rows:
        found = license_shingles(text)
        for i, (name, notice) in enumerate(licenses.TEMPLATES):
            tokens = set(license_shingles(notice))
            width, best = licenses.width_of(len(tokens)), (0, 0)
            for s in range(0, len(found), width // 2):
                both = len(tokens & set(found[s : s + width]))
                if both > best[0]:
                    best = (both, s)
            if best[0] >= contained * len(tokens) and best[0]:
                out[(doc_id, name, i, best[1], round(best[0] / len(tokens), 6))] += 1
    return out


def licensed_rows():
    rng, rows = random.Random(6), []
    for i, (_, notice) in enumerate(licenses.TEMPLATES):
        w = notice.split(" ")
        for k in (0, 3, 17, 40, 200):
            rows.append((len(rows), f"{prose(rng, k)} {notice} {prose(rng, k)} {notice.upper()}", "en", "s", 1))
        rows.append((len(rows), " ".join([*w[:-1], "other"]), "en", "s", 1))
        rows.append((len(rows), " ".join(w[: len(w) // 2]), "en", "s", 1))
        rows.append((len(rows), "\n * ".join(w), "en", "s", i))
    return rows + awkward_rows() + [rows[0]]


def test_licenses(spark):
    rows = licensed_rows()
    table = frame(spark, rows).selectExpr("*", "1 AS license", "2 AS held").repartition(3)
    got = licenses.scan_licenses(table, licenses.template_table(spark)).collect()
    assert Counter(tuple(r) for r in got) == expected_licenses(rows)


def test_license_bands():
    b = licenses.bands_for(0.8, 1e-6)
    least = 0.8 * 0.25 / (1 + 0.2 * 0.25)
    assert (1 - least) ** b <= 1e-6 < (1 - least) ** (b - 1)
    for n in range(1, 200):
        assert n <= licenses.width_of(n) / 2 and (n == 1 or n > licenses.width_of(n) / 4)


def test_nothing_licensed(spark, nothing):
    templates = licenses.template_table(spark)
    assert licenses.scan_licenses(nothing, templates).count() == 0
    assert licenses.scan_licenses(frame(spark, licensed_rows()[:5]), templates.filter("false")).count() == 0
    short = licenses.template_table(spark, [("X", "too short"), ("Y", "")])
    assert short.count() == 0
