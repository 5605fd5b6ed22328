"""The packed bigram models against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinwatch.llm import blocks, lm_counts
from tests.llm.helpers import awkward_rows, frame, prose, words


def expected_losses(rows, targets, added=lm_counts.ADDED):
    split = [(r[0], words(r[1])) for r in rows]
    counts, contexts = [Counter(), Counter()], [Counter(), Counter()]
    for doc_id, own in split:
        for h, w in zip([" ", *own], [*own, ""], strict=True) if own else []:
            for model in (0, 1) if doc_id in targets else (1,):
                counts[model][(h, w)] += 1
                contexts[model][h] += 1
    size = len({w for _, own in split for w in own}) + 1
    loss = lambda model, pair: -math.log((counts[model][pair] + added) / (contexts[model][pair[0]] + added * size))
    for doc_id, own in split:
        if not own:
            yield doc_id, 0, None, None, None
            continue
        pairs = list(zip([" ", *own], [*own, ""], strict=True))
        target, background = (sum(loss(m, p) for p in pairs) / len(pairs) for m in (0, 1))
        yield doc_id, len(own), target, background, target - background


def compared(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    got, want = sorted([tuple(r) for r in got], key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=2e-6)


@pytest.mark.parametrize(("segment", "chunk"), [(1 << 21, 1 << 21), (2_000, 700), (40, 3_000)])
def test_losses(spark, crowded, monkeypatch, segment, chunk):
    monkeypatch.setattr(lm_counts, "CHUNK", chunk)
    targets = {7, 8, 16, 21, 30, 31, 32, 9999}
    ids = spark.createDataFrame([(i,) for i in [*targets, 7, None]], "doc_id long")
    got = lm_counts.loss_difference(crowded, ids, segment=segment).select("doc_id", "n_tokens", "target_loss", "background_loss", "difference")
    compared(got.collect(), expected_losses(awkward_rows(), targets))


def test_text_like_the_target_scores_lower(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 80, 40) if i % 2 else prose(rng, 80, 4000), "en", "s", 1) for i in range(200)]
    ids = spark.createDataFrame([(i,) for i in range(1, 101, 2)], "doc_id long")
    got = {r.doc_id: r.difference for r in lm_counts.loss_difference(frame(spark, rows), ids).collect()}
    held_out = [got[i] for i in range(101, 200, 2)]
    assert max(held_out) < min(got[i] for i in range(100, 200, 2))


def test_without_targets_the_target_model_is_uniform(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long")
    size = len({w for r in awkward_rows() for w in words(r[1])}) + 1
    got = lm_counts.loss_difference(docs, none).filter("n_tokens > 0").select("target_loss").distinct().collect()
    assert [r[0] for r in got] == [pytest.approx(math.log(size), abs=1e-6)]
    assert lm_counts.loss_difference(nothing, none).count() == 0
    assert {tuple(r) for r in lm_counts.loss_difference(docs.withColumn("text", F.lit(" ")), none).drop("doc_id").collect()} == {(0, None, None, None)}


def test_predictions_and_planes():
    text = b"a b  c" + b"" + b"  " + b"d"
    found = blocks.words(np.frombuffer(text, dtype=np.uint8), np.array([0, 6, 6, 8, 9]))
    context, word, owner = lm_counts.predictions(found)
    a, b, c, d = found.hashes.tolist()
    assert list(zip(context.tolist(), word.tolist(), owner.tolist(), strict=True)) == [
        (0, a, 0), (a, b, 0), (b, c, 0), (c, 1, 0), (0, d, 3), (d, 1, 3),
    ]
    values = np.array([0, 1, 65535, 65536, (1 << 32) - 1])
    assert lm_counts._wide(lm_counts._narrow(values)).tolist() == values.tolist()
