"""Exact, near and substring duplicates against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pinwatch.llm import jaccard
from pinwatch.llm.components import connected_components
from pinwatch.llm.exact import DigestIndex, exact_duplicates, without_copies
from pinwatch.llm.jaccard import one_of_each_group, shingle_components
from pinwatch.llm.substrings import substring_duplicates, without_repeated_passages
from pinwatch.session import scratch_path
from tests.llm.helpers import awkward_rows, frame, prose, words


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def as_counter(rows, columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


# exact


def expected_exact(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[sha(text)].append(doc_id)
    out = Counter()
    for digest, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is not None, i), reverse=True)):
            out[(i, best, len(ids), k == 0, digest)] += 1
    return out


def test_exact_duplicates(crowded):
    got = exact_duplicates(crowded).collect()
    assert as_counter(got, ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]) == expected_exact(awkward_rows())


def test_one_row_of_each_text_stays_with_its_columns(crowded):
    left = without_copies(crowded)
    assert left.columns == crowded.columns
    rows = left.collect()
    assert Counter(sha(r.text) for r in rows) == Counter({sha(r[1]): 1 for r in awkward_rows()})
    kept = {(d, t) for d, _, _, k, t in expected_exact(awkward_rows()) if k}
    assert {(r.doc_id, sha(r.text)) for r in rows} == kept


def test_an_index_takes_each_text_once(spark):
    path = scratch_path(spark, "test-index")
    first = frame(spark, [(1, "a", None, None, 1), (5, "a", None, None, 1), (2, "b", None, None, 1)])
    second = frame(spark, [(9, "b", None, None, 1), (8, "c", None, None, 1), (7, "c", None, None, 1)])
    columns = ["doc_id", "keep_id", "group_size", "kept"]
    assert as_counter(DigestIndex(spark, path, 4).add_batch(first, "one").collect(), columns) == Counter({(1, 5, 2, False): 1, (5, 5, 2, True): 1, (2, 2, 1, True): 1})
    want = Counter({(9, 2, 1, False): 1, (8, 8, 2, True): 1, (7, 8, 2, False): 1})
    for _ in range(2):  # a batch that comes again changes nothing
        index = DigestIndex(spark, path, 4)
        assert as_counter(index.add_batch(second, "two").collect(), columns) == want
        assert index.rows().count() == 3


def test_the_index_is_not_shuffled(spark):
    index = DigestIndex(spark, scratch_path(spark, "test-index"), 4)
    groups = frame(spark, [(1, "a", None, None, 1)]).selectExpr("unhex(sha2(text, 256)) digest", "doc_id keep_id")
    plan = index.unseen(groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_exact_on_nothing(nothing):
    assert exact_duplicates(nothing).count() == 0 and without_copies(nothing).count() == 0


# near


def shingles(text, size):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def expected_components(rows, size, percent):
    sets = [shingles(r[1], size) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return Counter((r[0], len(sets[i]), smallest[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows))


def near_copies(seed, groups=12, most_edits=14):
    """Groups around a text and its edits, from few to many, so that links are near the threshold and
    chains of links occur; passages that many texts share; frequent words."""
    rng, rows = random.Random(seed), []
    passage = prose(rng, 40, 50)
    for g in range(groups):
        base = prose(rng, rng.choice([8, 30, 60, 120]), 300).split(" ")
        for _ in range(rng.randrange(2, 18)):
            text = list(base)
            for _ in range(rng.randrange(most_edits) * len(text) // 150 + rng.randrange(2)):
                k = rng.randrange(len(text))
                text[k : k + 1] = rng.choice([[], [f"e{rng.randrange(9999)}"], [text[k], "the"]])
            rows.append((len(rows), " ".join(text), "en", "s", 1))
        rows.append((len(rows), f"{passage} {prose(rng, 80)}", "en", "s", 1))
        rows.append((len(rows), f"{prose(rng, 5)} {passage}", "en", "s", 1))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_components_of_near_copies(spark, size, percent, seed):
    rows = near_copies(seed)
    got = shingle_components(frame(spark, rows).repartition(3), size, percent).collect()
    assert as_counter(got, ["doc_id", "n_shingles", "component_id"]) == expected_components(rows, size, percent)


def test_components_of_awkward_rows(crowded):
    got = shingle_components(crowded, 3, 90).collect()
    assert as_counter(got, ["doc_id", "n_shingles", "component_id"]) == expected_components(awkward_rows(), 3, 90)


def test_a_pair_must_share_more_where_prefixes_are_longer(spark):
    sketch = jaccard.Frequencies(np.full((2, jaccard.SKETCH_CELLS), 3, dtype=np.uint32))
    sketch.rows[:, :1000] = 40_000
    common, rare = np.arange(1000, dtype=np.uint64) * np.uint64((1 << 32) + 1), np.arange(5000, 6000, dtype=np.uint64)
    mixed = np.sort(np.concatenate([common[:950], rare[:50]]))
    sets = jaccard.Sets(np.concatenate([rare, common, mixed]), np.array([0, 0, 1000, 2000, 3000]), np.zeros(4))
    places, sizes, needs = sketch.prefixes(sets, 90)
    assert sizes.tolist()[:3] == [0, 101, 100 + jaccard.MOST_NEED] and needs.tolist()[:3] == [1, 1, jaccard.MOST_NEED]
    assert set(rare[:50].tolist()) <= set(sets.shingles[places[-sizes[3] :][:50]].tolist())  # the rare ones come first
    rng, rows = random.Random(12), []
    base = prose(rng, 100).split(" ")
    for i in range(150):
        text = list(base)
        for _ in range(i % 9):
            text[rng.randrange(100)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(text), "en", "s", 1))
    got = shingle_components(frame(spark, rows), 3, 90).collect()
    assert as_counter(got, ["doc_id", "n_shingles", "component_id"]) == expected_components(rows, 3, 90)


def test_one_document_of_each_group(crowded, nothing):
    left = one_of_each_group(crowded, 3, 90)
    assert left.columns == crowded.columns
    want = Counter()
    for doc_id, n, component in expected_components(awkward_rows(), 3, 90).elements():
        if n == 0:
            want[(doc_id, "empty")] += 1
        elif doc_id == component:
            want[(doc_id, "text")] = 1
    assert Counter((r.doc_id, "text" if words(r.text) else "empty") for r in left.collect()) == want
    assert one_of_each_group(nothing).count() == 0 and shingle_components(nothing).count() == 0


def test_long_chains_of_links(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5000, 1001)], "u long, v long")
    got = {r.node: r.label for r in connected_components(edges.repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000, 5000: 1000}


# substrings


def expected_cuts(rows, size=35):
    places = Counter()
    for r in rows:
        w = words(r[1])
        places.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for r in rows:
        w = words(r[1])
        gone = set()
        for i in range(len(w) - size + 1):
            if places[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((r[0], len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("cells", [1 << 27, 1 << 11])
def test_repeated_passages(crowded, cells):
    """With a sketch that is far too small as well: then every window is grouped exactly."""
    got = substring_duplicates(crowded, cells=cells).collect()
    want = Counter((d, n, k, sha(kept)) for d, n, k, kept in expected_cuts(awkward_rows()))
    assert as_counter(got, ["doc_id", "n_words", "n_removed", "kept_sha256"]) == want


def test_overlapping_and_touching_passages(spark):
    rng = random.Random(11)
    a, b = prose(rng, 70), prose(rng, 36)
    texts = [f"{a} x {b}", f"{b} {a}", f"y {a[: len(a) // 2]}", " ".join(a.split()[:34]), f"{a} {a}", prose(rng, 200, 2), prose(rng, 34)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = substring_duplicates(frame(spark, rows).repartition(4)).collect()
    want = Counter((d, n, k, sha(kept)) for d, n, k, kept in expected_cuts(rows))
    assert as_counter(got, ["doc_id", "n_words", "n_removed", "kept_sha256"]) == want


def test_texts_keep_what_is_left(crowded, nothing):
    left = without_repeated_passages(crowded)
    assert left.columns == crowded.columns
    want = Counter()
    for row, (doc_id, _, gone, kept) in zip(awkward_rows(), expected_cuts(awkward_rows()), strict=True):
        text = kept if gone else row[1]
        want[(doc_id, text, len(text) if gone else row[4])] += 1
    assert Counter((r.doc_id, r.text, r.n_chars) for r in left.collect()) == want
    assert without_repeated_passages(nothing).count() == 0 and substring_duplicates(nothing).count() == 0
