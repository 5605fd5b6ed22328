"""Results kept up to date are what a full pass gives, and the vector index finds what the exact search finds."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pinwatch.operators import closure, posture, posture_state, search, vector_index
from pinwatch.session import scratch_path, stored_table
from tests.test_operators import rows

EDGE = "ecosystem string, package string, depends_on string, version string"


@pytest.mark.parametrize("seed", [1, 2])
def test_an_updated_closure_is_the_full_one(spark, seed):
    rng = random.Random(seed)
    some = lambda n: {(e, a, b, f"{rng.randrange(3)}.0") for e, a, b in [(rng.choice("xy"), f"p{rng.randrange(12)}", f"p{rng.randrange(12)}") for _ in range(n)]}
    frame = lambda edges: spark.createDataFrame(sorted(edges), EDGE)
    edges = some(16)
    held = stored_table(closure.transitive_closure(frame(edges)), "closure")
    for _ in range(3):
        added, removed = some(2), set(rng.sample(sorted(edges), 3)) | some(1)
        held, after = closure.updated_closure(held, frame(edges), frame(added), frame(removed))
        held = stored_table(held, "closure")
        edges = (edges - removed) | added
        assert rows(after, "ecosystem", "package", "depends_on", "version") == sorted(edges)
        columns = ["ecosystem", "package", "depends_on", "depth", "path", "version"]
        assert rows(held, *columns) == rows(closure.transitive_closure(frame(edges)), *columns)


def test_a_small_change_derives_little_anew(spark, monkeypatch):
    chains = [("x", f"c{i}-{j}", f"c{i}-{j + 1}", "1") for i in range(30) for j in range(5)]
    held = stored_table(closure.transitive_closure(spark.createDataFrame(chains, EDGE)), "closure")
    derived = []
    whole = closure.transitive_closure
    monkeypatch.setattr(closure, "transitive_closure", lambda edges, start=None: derived.append(start.count()) or whole(edges, start))
    closure.updated_closure(held, spark.createDataFrame(chains, EDGE), spark.createDataFrame([("x", "c3-2", "new", "1")], EDGE), spark.createDataFrame([], EDGE))
    assert derived == [3]  # of 150 packages


MATCH = "match_id string, service_id string, blast_radius string, status string, published_at timestamp, detected_at timestamp, sla_deadline timestamp, resolved_at timestamp"
START = datetime(2024, 1, 1)


def findings(rng, n):
    out = []
    for i in range(n):
        seen = START + timedelta(hours=rng.randrange(24 * 150))
        late = lambda days: seen + timedelta(hours=rng.randrange(24 * days))  # noqa: E731, B023
        out.append([f"m{i}", f"s{rng.choice([0, 0, 0, 1, 2])}", rng.choice(["CRITICAL", "HIGH", "MEDIUM", "LOW"]), rng.choice(["open", "open", "accepted_risk"]),
                    rng.choice([None, seen - timedelta(minutes=rng.randrange(9000))]), rng.choice([seen] * 9 + [None, seen.replace(hour=0)]),
                    rng.choice([None, late(20), late(60), late(3).replace(hour=0)]), None])
    return out


def test_a_maintained_report_is_the_full_one(spark):
    rng = random.Random(5)
    registry = spark.createDataFrame([("s0", "red", True, True, False, False, False), ("s1", "blue", False, False, True, True, False)],
                                     "service_id string, team string, is_customer_facing boolean, pci_scope boolean, hipaa_scope boolean, soc2_scope boolean, pii_handler boolean")
    now, state = findings(rng, 300), spark.createDataFrame([], posture_state.STATE)
    state = posture_state.advanced(state, posture_state.deltas(spark.createDataFrame(now, MATCH)), "2024-03-01")
    sizes = []
    for day in ("2024-03-01", "2024-04-10", "2024-05-20"):
        before = [list(m) for m in rng.sample(now, 40)]
        changed = []
        for m in before:
            after = list(m)
            after[7] = None if m[7] else (m[5] or START) + timedelta(hours=rng.randrange(-30, 24 * 80))
            after[3] = rng.choice(["open", "accepted_risk", m[3]])
            changed.append(after)
        by_id = {m[0]: m for m in changed}
        now = [by_id.get(m[0], m) for m in now]
        delta = posture_state.change_deltas(spark.createDataFrame(before, MATCH), spark.createDataFrame(changed, MATCH))
        state = stored_table(posture_state.advanced(state, delta, day, keep_days=60), "state")
        full, at = spark.createDataFrame(now, MATCH), f"{day} 00:00:00"
        assert posture_state.report(state, at, 30, registry).first() == posture.report(full, at, 30, registry).first()
        sizes.append(state.filter(F.col("day") < F.date_sub(F.lit(day).cast("date"), 60)).count())
        last = posture_state.open_over_time(state, 5, day).filter(F.col("day") == F.lit(day).cast("date"))
        tiers = posture.open_counts(full, at).first()
        assert {r.blast_radius: r.open_findings for r in last.collect()} == {t: tiers[f"open_{t.lower()}"] for t in ("CRITICAL", "HIGH", "MEDIUM", "LOW")}
    assert sizes == [0, 0, 0]
    assert posture_state.report(spark.createDataFrame([], posture_state.STATE), "2024-03-01 00:00:00").first().open_high == 0


def vectors(spark, n=1500):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(25)]
    made = [(i, [x + rng.gauss(0, 0.35) for x in centres[i % 25]]) for i in range(n)]
    return spark.createDataFrame([*made, (n, [0.0] * 12), (n + 1, None), (n + 2, []), (n + 3, made[0][1])], "vec_id long, embedding array<double>")


def test_the_index_reaches_its_recall_with_few_lists(spark):
    table, path = vectors(spark), scratch_path(spark, "test-index")
    vector_index.build_index(table, path)
    queries = table.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = stored_table(vector_index.indexed_search(spark, path, queries, 5, vector_index.MOST_LISTS), "exact")
    assert vector_index.indexed_vectors(spark, path).count() == table.filter("embedding IS NOT NULL").count()
    probes = vector_index.tuned_probes(spark, path, queries, 5, 0.9)
    found = vector_index.indexed_search(spark, path, queries, 5, probes)
    assert vector_index.recall(found, exact) >= 0.85  # tuned to 0.9 on the same queries
    assert vector_index.share_read(spark, path, queries, probes) < 0.5
    best = {r.query_id: r.vec_id for r in exact.filter("rank = 1 AND query_id > 0 AND query_id < 1500").collect()}
    assert all(q == v for q, v in best.items())


def test_an_empty_index_finds_nothing(spark):
    path = scratch_path(spark, "test-index")
    vector_index.build_index(vectors(spark).filter("false"), path)
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query array<double>")
    assert vector_index.indexed_search(spark, path, queries).count() == 0


@pytest.mark.parametrize("probes", [2, vector_index.MOST_LISTS])
def test_queries_meet_the_lists_in_blocks_and_rank_as_the_plain_join(spark, probes):
    nan, inf = float("nan"), float("inf")
    odd = [[nan] * 12, [inf] + [1.0] * 11, [1e200] * 12, [1e-200] * 12, [1.0] * 5, [None] + [1.0] * 11, [0.0] * 12]
    copies = [(3000 + i, [0.5, -1.0] * 6) for i in range(40)]
    extra = spark.createDataFrame([(2000 + i, v) for i, v in enumerate(odd)] + copies + [(None, [0.5, -1.0] * 6)], "vec_id long, embedding array<double>")
    table, path = vectors(spark, 400).unionByName(extra), scratch_path(spark, "test-index")
    vector_index.build_index(table, path, lists=9)
    queries = table.filter("vec_id % 20 = 0 OR vec_id >= 2000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    met = vector_index.indexed_vectors(spark, path).join(vector_index.probed_lists(spark, path, queries, probes), "list")
    scored = met.select("query_id", "vec_id", search.cosine(F.col("embedding"), F.col("query")).alias("similarity"))
    scored.createOrReplaceTempView("scored")
    plain = spark.sql("""SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER
        (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM scored) WHERE rank <= 5""")
    columns = ["query_id", "vec_id", "similarity", "rank"]
    told = lambda df: sorted(map(str, df.select(columns).collect()))
    assert told(vector_index.indexed_search(spark, path, queries, 5, probes, block_bytes=2000)) == told(plain)


def test_a_search_puts_out_few_rows_for_a_query(spark):
    table, path = vectors(spark), scratch_path(spark, "test-index")
    vector_index.build_index(table, path)
    queries = table.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = vector_index.indexed_search(spark, path, queries)
    # No query is joined with the rows of its lists.
    assert "Join" not in found._jdf.queryExecution().toString()
    assert found.count() == 5 * queries.filter("query IS NOT NULL").count()
