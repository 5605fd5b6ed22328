import math
import random

import pytest

from pinwatch.llm import quality
from tests.llm.helpers import awkward_rows, frame, prose, words


def expected_signals(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {k for places in windows.values() if len(places) > 1 for i in places for k in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered))


def test_signals(crowded):
    got = quality.signals(crowded).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    columns = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    want = [(r[0], *expected_signals(r[1])) for r in awkward_rows()]
    assert sorted([(r.doc_id, *[r[c] for c in columns]) for r in got], key=key) == sorted(want, key=key)


def cdf(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


@pytest.mark.parametrize("rate", [0.005, 0.05, 0.3])
def test_error_bounds_are_exact(spark, rate):
    from pyspark.sql import functions as F

    cases = [(n, level) for n in (0, 1, 30, 200, 900) for level in (0.05, 0.003)]
    rows = spark.createDataFrame(cases, "n long, level double")
    for r in rows.select("n", "level", quality.most_errors(F.col("n"), rate, F.col("level")).alias("k")).collect():
        want = max([k for k in range(int(r.n * rate) + 1) if cdf(k, r.n, rate) <= r.level], default=-1)
        assert r.k == want


def test_large_samples_do_not_underflow(spark):
    from pyspark.sql import functions as F

    k = spark.range(1).select(quality.most_errors(F.lit(500_000).cast("long"), 0.005, F.lit(0.001)).alias("k")).first().k
    # near the normal approximation: mean 2500, deviation 49.9, 3.09 of it below
    assert abs(k - (2500 - 3.09 * 49.9)) < 5


def labelled(n=6_000, seed=1):
    """Good documents, a few with a symbol; bad ones full of them, in one stratum only."""
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        good, lang = i % 3 > 0, "en" if i % 2 else "de"
        text = prose(rng, 40)
        if not good and lang == "en":
            text = text.replace(" ", "# ")
        elif i % 30 == 1:
            text += "#"
        docs.append((i, text, lang, "s", len(text)))
        labels.append((i, int(good), 0))
    docs += [(n, "## ## ## ## ## ## ## ## ## ##", "xx", "s", 3), (n + 1, prose(rng, 40), None, None, None)]
    return docs, labels


def test_cutoffs_keep_the_promised_rate(spark):
    docs, labels = labelled()
    labels += [(None, 0, 0), (5, None, None), (7, 1, 0), (7, 1, 1)]
    table, marks = frame(spark, docs).repartition(4), frame(spark, labels, "doc_id long, quality int, toxic int")
    counts = quality.signals(table)
    cuts = {(r.stratum, r.rule): r.cutoff for r in quality.certified_cutoffs(counts, marks).collect()}
    assert ("en", "symbols") in cuts and not any(s in ("xx", "") for s, _ in cuts)
    verdicts = {r.doc_id: r for r in quality.quality_rules(table, marks).collect()}
    assert len(verdicts) == len(docs)
    good = [i for i, q, _ in labels[:6000] if q and i % 2]
    assert sum(not verdicts[i].kept for i in good) <= quality.ALLOWED_RATE * len(good)
    assert not any(verdicts[i].kept for i in range(6000) if i % 3 == 0 and i % 2)
    assert verdicts[6000 + 1].kept  # a stratum without labels loses nothing beyond the base rules


def test_few_labels_certify_nothing(spark):
    docs, labels = labelled(60)
    cuts = quality.certified_cutoffs(quality.signals(frame(spark, docs)), frame(spark, labels, "doc_id long, quality int, toxic int"))
    assert cuts.count() == 0
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    rows = quality.quality_rules(frame(spark, docs), none).collect()
    assert len(rows) == len(docs) and all(r.kept != r.base_failed for r in rows)


def test_cutoffs_are_those_of_a_plain_search(spark):
    docs, labels = labelled(7_000, 4)
    table, marks = frame(spark, docs), frame(spark, labels, "doc_id long, quality int, toxic int")
    counts = quality.signals(table)
    rows = {r.doc_id: r.asDict() for r in counts.collect()}
    graded = {i: q for i, q, _ in labels}
    strata = {r["stratum"] for i, r in rows.items() if i in graded and r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"]}
    want = {}
    for stratum in strata:
        held = [(rows[i], q) for i, q in graded.items() if rows[i]["stratum"] == stratum and rows[i]["n_words"] >= 10 and 100 * rows[i]["n_repeat_words"] <= 20 * rows[i]["n_words"]]
        n = sum(q for _, q in held)
        for rule in quality.RULES:
            best = None
            for place, cut in enumerate(rule.cutoffs):
                hits = [q for r, q in held if 100 * r[rule.numerator] > cut * r[rule.denominator]]
                wrong, right = sum(hits), len(hits) - sum(hits)
                if cdf(wrong, n, quality.ALLOWED_RATE / len(quality.RULES)) > quality.ERROR_LEVEL / (len(strata) * len(quality.RULES)):
                    break
                best = max(best or (0, 0, 0), (right - quality.GOOD_WEIGHT * wrong, -place, cut))
            if best and best[0] > 0:
                want[(stratum, rule.name)] = best[2]
    got = {(r.stratum, r.rule): r.cutoff for r in quality.certified_cutoffs(counts, marks).collect()}
    assert got == want and want


def test_passing_documents_have_their_columns(crowded, nothing, spark):
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    left = quality.passing_documents(crowded, none)
    assert left.columns == crowded.columns
    passes = lambda t: (s := expected_signals(t))[0] >= 10 and 100 * s[5] <= 20 * s[0]
    want = sorted(str((r[0], r[1])) for r in awkward_rows() if passes(r[1]))
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == want
    assert quality.passing_documents(nothing, none).count() == 0


def test_no_python_runs(docs, spark):
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    plan = quality.quality_rules(docs, none)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
