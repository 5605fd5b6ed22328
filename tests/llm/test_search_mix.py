"""Ranked search, source mixing and hard negatives against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pinwatch.llm import blocks, cube_mix, hard_negatives, ranked_search
from pinwatch.llm.heaps import BestRows
from tests.llm.helpers import awkward_rows, frame, prose, words

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ranked search


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def expected_answers(docs, items, most=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in counted if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for doc_id, c in held:
            m = 10 + 90 * sum(c.values()) * n // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, null, doc_id) in enumerate(sorted(scores)[:most], 1):
            out[(item, rank, None if null else doc_id, -score)] += 1
    return out


ITEMS = [(1, "w1 w2 w3 W3 cödé"), (2, None), (3, ""), (4, "  ,.;  "), (5, "one two three"), (5, "w7 line end"), (None, "w5 the X"), (8, "unknown"), (9, prose(random.Random(2), 200))]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("bag", F.lit(1)).withColumn("score", F.lit("x"))


def answers(found):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect())


def test_ranked_search(crowded, items):
    found = ranked_search.ranked_search(crowded, items)
    assert answers(found) == expected_answers([(r[0], r[1]) for r in awkward_rows()], ITEMS)


def test_ranked_search_in_several_blocks(docs, items):
    assert answers(ranked_search.ranked_search(docs, items, block_bytes=300)) == expected_answers([(r[0], r[1]) for r in awkward_rows()], ITEMS)


def test_a_class_of_many_copies_is_scored_once_and_expanded_by_id(spark):
    rows = [(i, "alpha beta alpha", "en", "s", 1) for i in range(300, 0, -1)] + [(900 + i, prose(random.Random(i), 30), "en", "s", 1) for i in range(60)]
    queries = [(1, "alpha"), (2, "beta w1")]
    docs = frame(spark, rows).repartition(7)
    found = ranked_search.ranked_search(docs, spark.createDataFrame(queries, "item_id long, text string"))
    assert answers(found) == expected_answers([(r[0], r[1]) for r in rows], queries)


def test_ranked_search_of_nothing(docs, items, nothing):
    assert ranked_search.ranked_search(nothing, items).count() == 0
    assert ranked_search.ranked_search(docs, items.filter("false")).count() == 0
    assert ranked_search.ranked_search(docs.withColumn("text", F.lit(" , ")), items).count() == 0


def test_terms_with_one_hash_stay_apart(monkeypatch):
    strong = blocks.Pieces.hashes
    weak = lambda self, salt=0: strong(self, salt) & np.uint64(0x3F if salt == 0 else 0xFFFFFFFFFFFFFFFF)
    monkeypatch.setattr(blocks.Pieces, "hashes", weak)
    listed = [f"term{i}".encode() for i in range(200)]
    vocabulary, order = ranked_search.Vocabulary.of(listed)
    assert vocabulary.salt > 0 and sorted(order) == sorted(listed)
    data = np.frombuffer(b" ".join([*listed, b"term200", b"x" * 40, b"term1"]), dtype=np.uint8)
    place, number = vocabulary.numbers(blocks.words(data, np.array([0, len(data)])))
    assert place.tolist() == [*range(200), 202]
    assert [order[i] for i in number] == [*listed, b"term1"]


# source mixing


def expected_targets(sizes, weights=(5, 2, 1), share=100, most=3):
    totals = Counter()
    for source, size in sizes:
        totals[source] += size
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = sum(totals.values()) * share / 100, set(order), {}
    while True:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > most * totals[s]}
        if not above:
            return totals, out | {s: left * weight[s] / total for s in free}
        for s in above:
            out[s] = float(most * totals[s])
            left -= out[s]
        free -= above
        if not free:
            return totals, out


def mix_rows():
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randrange(1, 90)), "en", rng.choice(["a", "b", "b", "b", "z", "é", None, ""]), 0) for i in range(700)]
    rows += [(5, "same words again", "en", "hot", 0)] * 900 + [(None, "no id here", "en", "hot", 0)] * 40
    return rows + [(7001, None, "en", "a", 0), (7002, "", None, "void", 0), (7003, " \n ", None, "void", 0), (7004, "long " * 30_000, None, "one", 0)] + awkward_rows()


@pytest.fixture(scope="module")
def mixed(spark):
    return cube_mix.mixed_sources(frame(spark, mix_rows()).repartition(5).withColumn("size", F.lit("x")).withColumn("chance", F.lit(1)), bucket=64).collect()


def test_targets_are_met_by_words(mixed):
    rows = [(r[0], r[3], len(words(r[1]))) for r in mix_rows()]
    assert Counter((r.doc_id, r.source, r["size"]) for r in mixed) == Counter(rows)
    totals, targets = expected_targets([(s, n) for _, s, n in rows])
    taken = Counter()
    for r in mixed:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(targets[r.source], rel=1e-12)
        assert 0 <= r.taken <= 3 * r["size"] and r.copies * r["size"] <= r.taken <= (r.copies + 1) * r["size"]
        taken[r.source] += r.taken
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 2


def test_documents_are_balanced_and_few_are_cut(mixed):
    by_source = defaultdict(list)
    for r in mixed:
        if r["size"]:
            by_source[r.source].append(r)
    for rows in by_source.values():
        cut = sum(r.taken != r.copies * r["size"] for r in rows)
        assert cut <= 2
        times = rows[0].target / rows[0].source_size
        assert abs(sum(r.copies for r in rows) - times * len(rows)) <= 2


def test_the_mix_does_not_depend_on_partitions(spark, mixed):
    again = cube_mix.mixed_sources(frame(spark, mix_rows()).coalesce(1), bucket=64).collect()
    assert Counter(again) == Counter(mixed)
    other = cube_mix.mixed_sources(frame(spark, mix_rows()), bucket=64, seed=1).collect()
    assert Counter(other) != Counter(mixed)


def test_mix_of_nothing(nothing, docs):
    assert cube_mix.mixed_sources(nothing).count() == 0
    assert {(r.taken, r.target) for r in cube_mix.mixed_sources(docs.withColumn("text", F.lit(None).cast("string"))).collect()} == {(0, 0.0)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.sampled_from([0.0, 0.25, 0.5, 0.9, 1.0])), max_size=40), st.integers(0, 1 << 40))
def test_flight_keeps_totals(units, seed):
    sizes, chances = np.array([u[0] for u in units], dtype=np.int64), np.array([u[1] for u in units], dtype=float)
    moved = cube_mix.flight(sizes, chances, seed)
    assert ((moved >= 0) & (moved <= 1)).all() and ((moved > 0) & (moved < 1)).sum() <= 2
    assert moved.sum() == pytest.approx(chances.sum(), abs=1e-6)
    assert (moved * sizes).sum() == pytest.approx((chances * sizes).sum(), abs=1e-4)
    assert (moved[chances == 0] == 0).all() and (moved[chances == 1] == 1).all()


def test_flight_keeps_each_chance_on_average():
    sizes = np.array([3, 9, 4, 40, 7, 7, 1, 200, 12, 5], dtype=np.int64)
    chances = np.array([0.2, 0.2, 0.5, 0.7, 0.4, 0.4, 0.9, 0.3, 0.6, 0.5])
    mean = np.mean([cube_mix.flight(sizes, chances, seed) for seed in range(4000)], axis=0)
    assert np.abs(mean - chances).max() < 0.03


# hard negatives


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 40), st.integers(0, 1000), st.integers(1, 5))
def test_strassen_is_the_plain_product(n, k, m, seed, leaf):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(1 << 62), 1 << 62, (n, k)), rng.integers(-5, 5, (k, m))
    assert np.array_equal(hard_negatives.strassen(a, b, leaf), a @ b)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-4, 4), st.integers(0, 3)), max_size=60), st.integers(1, 5), st.integers(1, 9))
def test_best_rows_merge(rows, most, step):
    whole = BestRows(4, most)
    parts = []
    for start in range(0, len(rows), step):
        part = [np.array(c, dtype=np.int64) for c in zip(*[(g, s, t, start + i) for i, (g, s, t) in enumerate(rows[start : start + step])], strict=True)]
        own = BestRows(4, most)
        own.add(*part)
        whole.add(*part)
        parts.append(own)
    merged = BestRows(4, most)
    for own in parts:
        merged.add(*own.entries())
    expected = []
    for g in range(4):
        mine = sorted((-s, t, i) for i, (h, s, t) in enumerate(rows) if h == g)[:most]
        expected += [(g, -s, t, i) for s, t, i in mine]
    for found in (whole, merged):
        assert [tuple(int(x) for x in e) for e in zip(*found.entries(), strict=True)] == expected


def vectors():
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0.15, 0.4) for _ in range(9)], rng.randrange(4)) for i in range(430)]
    rows += [(100, [0.5] * 9, 1), (100, [0.5] * 9, 1), (200, [0.0] * 9, 2), (203, [0.0] * 9, 2), (300, [], 0), (400, [1.0, 2.0], 3)]
    rows += [(431, None, 1), (432, [0.1, None], 1), (433, [float("nan")] * 9, 1), (434, [float("inf")] + [0.0] * 8, 1), (435, [0.2] * 9, None), (None, [0.3] * 9, 1)]
    return rows + [(500, [1e300] * 9, 1), (600, [0.4] * 9, 77), (-100, [0.3] * 9, 0), (411, [0.5] * 12, 3)] + [(440 + i % 3, [0.25] * 9, 3) for i in range(30)]


def expected_negatives(rows):
    kept = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) or abs(x * 256) >= 2**62 for x in vector):
            continue
        kept.append((vec_id, [math.floor(256 * x) for x in vector], label))
    score = lambda a, b: sum(x * y for x, y in zip(a[1], b[1], strict=False))
    out = Counter()
    for a in kept:
        if a[0] % 100:
            continue
        scored = sorted(((-score(a, b), b[0], b[2]) for b in kept if b is not a), key=lambda r: r[:2])
        for s, positive, _ in [r for r in scored if r[2] == a[2]][:5]:
            fits = [(n, i) for n, i, label in scored if label != a[2] and 30 * -s <= 100 * -n <= 90 * -s]
            for rank, (n, i) in enumerate(fits[:10], 1):
                out[(a[0], positive, rank, i, -s, -n)] += 1
    return out


@pytest.mark.parametrize("anchor_bytes", [1 << 20, 72])
def test_hard_negatives(spark, anchor_bytes):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int").repartition(3).withColumn("row", F.lit(1)).withColumn("score", F.lit("x"))
    found = hard_negatives.hard_negatives(df, anchor_bytes=anchor_bytes)
    got = Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found.collect())
    assert got == expected_negatives(vectors()) and len(got) > 100


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int")
    assert hard_negatives.hard_negatives(df.filter("false")).count() == 0
    assert hard_negatives.hard_negatives(df.filter("vec_id % 100 <> 0")).count() == 0
    assert hard_negatives.hard_negatives(df.filter("vec_id IN (100, 600)").withColumn("label", F.lit(1))).count() == 0
