"""The pipeline's stages against plain Python on a small corpus, and its parts' contract."""

import random
from collections import Counter

import corpus_pipeline
from pinwatch.llm import token_rollup
from pinwatch.llm.encoders import vocabulary_path
from pinwatch.session import scratch_path
from tests.llm.helpers import awkward_rows, frame, prose
from tests.llm.test_dedup import expected_components, expected_cuts, near_copies
from tests.llm.test_quality import expected_signals


def corpus():
    rows = [r for r in awkward_rows() if r[0] is not None]
    near = [(1000 + r[0], *r[1:]) for r in near_copies(9)]
    return rows + near


def test_stages_by_hand(spark, tmp_path):
    folder = str(tmp_path)
    frame(spark, corpus()).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), corpus()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = Counter((r.doc_id, r.text) for r in docs.collect()) if "text" in docs.columns else docs.collect()
        assert docs.columns == before or name == "packing"

    def passes(text):
        n, _, _, _, _, repeats = expected_signals(text)
        return n >= 10 and 100 * repeats <= 20 * n

    kept = [r for r in kept if passes(r[1])]
    assert seen["quality rules"] == Counter((r[0], r[1]) for r in kept)
    best = {}
    for r in kept:
        best[r[1]] = max(best.get(r[1], r), r, key=lambda r: r[0])
    kept = list(best.values())
    assert seen["exact dedup"] == Counter((r[0], r[1]) for r in kept)
    stays = {d for d, _, c in expected_components(kept, 5, 80) if d == c}
    kept = [r for r in kept if r[0] in stays]
    assert seen["n-gram jaccard join"] == Counter((r[0], r[1]) for r in kept)
    kept = [(r[0], cut if gone else r[1]) for r, (_, _, gone, cut) in zip(kept, expected_cuts(kept), strict=True)]
    assert seen["substring dedup"] == Counter(kept)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    sizes = {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in kept}
    packed = Counter()
    for r in seen["packing"]:
        packed[r.doc_id] += r.length
        assert r.doc_tokens == sizes[r.doc_id]
    assert packed == Counter(sizes)
    assert Counter((r.doc_id, r.length) for r in corpus_pipeline.run(spark, folder).collect()).total() > 0


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram jaccard join", "substring dedup", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_certified_cutoffs_take_effect_in_the_pipeline(spark, tmp_path):
    rng = random.Random(12)
    good = [(i, prose(rng, 40, 100_000), "en", "s", 0) for i in range(900)]
    bad = [(2000 + i, prose(rng, 40, 100_000) + " ####" * 20, "en", "s", 0) for i in range(150)]
    clean = [(5000 + i, prose(rng, 40, 100_000), "en", "s", 0) for i in range(50)]
    folder = str(tmp_path)
    frame(spark, good + bad + clean + [(6000, "$$$$ " * 30 + prose(rng, 40, 100_000), "en", "s", 0)]).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    packed = {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()}
    # neither the labelled bad ones, nor an unlabelled one like them; the good ones and their like stay
    assert not packed & {r[0] for r in bad} and 6000 not in packed
    assert {r[0] for r in clean} <= packed and len(packed & {r[0] for r in good}) >= 0.98 * len(good)


def test_stages_keep_columns_of_any_name(spark, tmp_path, crowded):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    crowded.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert {(r.token, r["two"], r.digest) for r in docs.collect()} == {(1, 3, 4)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0


def test_an_empty_corpus_gives_nothing(spark, tmp_path, nothing):
    folder = str(tmp_path)
    nothing.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_counts_of_an_empty_table_and_of_columns_of_any_name(spark, docs, crowded, nothing):
    rollup = lambda: token_rollup.TokenRollup(spark, scratch_path(spark, "test-rollup"))
    assert token_rollup.corpus_history(nothing, rollup(), vocabulary_path()).count() == 0
    names = {"n_words": "old", "kept": "new", "ids": "row", "stratum": "tokens"}
    clashing = crowded.withColumnsRenamed(names)
    got, want = (Counter(map(tuple, token_rollup.corpus_history(d, rollup(), vocabulary_path()).collect())) for d in (clashing, docs))
    assert got == want
