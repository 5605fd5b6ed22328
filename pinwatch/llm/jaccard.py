"""Similarity join on word shingles by adaptive multi-match prefixes, and its components.

A document is the set of its word shingles, kept as 64-bit hashes in one global order: classes of
estimated frequency first, hash next. Two sets with ``100 * both >= percent * either`` must share at
least ``need`` of their first ``n - ceil(percent n / 100) + need`` shingles. The longer a document's prefix
(``need`` of 1 to 4), the more shared shingles a pair must show before it is verified. ``need`` follows
from the estimated number of candidates of the plain prefix, from a count-min sketch of all shingles.
Documents may differ in ``need``; a pair has to show the smaller one.

Copies are one class and are joined once. Pairs are verified in two rounds, so that a large group of
near copies costs its size and not its square. First every document meets one hub per shared prefix
shingle, the document that has it earliest: near copies of a text meet that text. Then only pairs of
documents that are still in different components, and can still pass the count and position bounds,
are verified. A pair left out lies in one component already, so components are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pinwatch.llm import blocks
from pinwatch.llm.blocks import _U, signed
from pinwatch.llm.bloom import build_bloom
from pinwatch.llm.components import connected_components
from pinwatch.llm.names import plain, spare
from pinwatch.session import stored_table

#: Words in a shingle, and the least similarity of linked documents, where a caller does not say.
SHINGLE, PERCENT = 5, 80
MOST_NEED = 4
#: Each time the estimated candidates of a prefix grow by this factor, one more match is asked for.
NEED_STEP = 32
#: The sketch: two rows of this many counters, in segments that are merged apart.
SKETCH_CELLS, SKETCH_SEGMENTS = 1 << 20, 32


@dataclass
class Sets:
    """Distinct shingles of the documents of a block, sorted within each document, by two independent
    hashes."""

    shingles: np.ndarray
    bounds: np.ndarray
    text_keys: np.ndarray
    second: np.ndarray | None = None

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def of(self, k: int) -> np.ndarray:
        return self.shingles[self.bounds[k] : self.bounds[k + 1]]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that identify each set: two sums over members hashed apart; 0 for the empty one."""
        some = np.diff(self.bounds) > 0
        keys = []
        for salt, members in ((0x1D8E4E27C47D124F, self.shingles), (0x6A09E667F3BCC909, self.second)):
            key = np.zeros(len(some), dtype=_U)
            if some.any():
                sums = np.add.reduceat(blocks.mix(members ^ _U(salt)), self.bounds[:-1][some])
                key[some] = blocks.mix(sums) | _U(1)
            keys.append(signed(key))
        return keys[0], keys[1]

    def histograms(self) -> np.ndarray:
        """How many shingles begin with each byte, up to 255. The histograms of two sets differ by no more
        than the sets do, since a cut-off count differs by no more than the count."""
        cells = self.owners() * 256 + (self.shingles >> _U(56)).astype(np.int64)
        counts = np.bincount(cells, minlength=256 * (len(self.bounds) - 1))
        return np.minimum(counts, 255).astype(np.uint8).reshape(-1, 256)


def _text_keys(words: blocks.Words) -> np.ndarray:
    return signed(blocks.span_hashes(words.hashes, words.firsts[:-1], words.firsts[1:]))


def shingle_sets(words: blocks.Words, size: int) -> Sets:
    """Sets of a block. Texts with fewer words than a shingle are one shingle; texts without words have
    none."""
    counts, n = words.counts(), len(words.hashes)
    sizes = np.maximum(counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(counts)), sizes)
    place = words.firsts[:-1][owner] + np.arange(bounds[-1]) - bounds[owner]
    long = counts >= size
    inside = long[owner]
    shingles, second = np.zeros(bounds[-1], dtype=_U), np.zeros(bounds[-1], dtype=_U)
    for hashes, out in ((words.hashes, shingles), (words.second, second)):
        out[inside] = blocks.window_hashes(hashes, size)[place[inside]]
        for length in range(1, size):
            short = np.flatnonzero(counts == length)
            if len(short):
                out[bounds[short]] = blocks.window_hashes(hashes, length)[words.firsts[short]]
    order = np.arange(bounds[-1])
    for a, b in zip(bounds[:-1][long].tolist(), bounds[1:][long].tolist(), strict=True):
        order[a:b] = np.argsort(shingles[a:b]) + a
    shingles, second = shingles[order], second[order]
    new = np.ones(len(shingles), dtype=bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    kept = np.concatenate([[0], np.cumsum(new)])
    return Sets(shingles[new], kept[bounds], _text_keys(words) if n else np.zeros(len(counts), dtype=np.int64), second[new])


def _word_runs(column: pa.Array) -> Iterator[tuple[int, int, blocks.Words]]:
    data, offsets = blocks.text_bytes(column)
    for first, last in blocks.document_runs(offsets):
        yield first, last, blocks.words(data, offsets[first : last + 1], lower=True)


def _cells(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = _U(SKETCH_CELLS - 1)
    return (shingles & mask).astype(np.int64), ((shingles >> _U(32)) & mask).astype(np.int64)


@dataclass
class Frequencies:
    """A count-min sketch of the number of documents with each shingle, and what is noise in it."""

    rows: np.ndarray

    def __post_init__(self):
        self.noise = max(1.0, 2.0 * float(self.rows[0].mean()))

    def excess(self, shingles: np.ndarray) -> np.ndarray:
        """Estimated documents beyond what other shingles in the same cells account for."""
        a, b = _cells(shingles)
        return np.maximum(0.0, np.minimum(self.rows[0][a], self.rows[1][b]) - self.noise)

    def prefixes(self, sets: Sets, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every set the places of the shingles it puts out, in global order, one set after the other;
        how many each puts out; and how many of them a pair must share."""
        excess = self.excess(sets.shingles)
        rank = np.log2(1.0 + excess / self.noise).astype(np.int64)
        n = np.diff(sets.bounds)
        base = n - -(-percent * n // 100) + (n > 0)
        ranked = np.maximum.reduceat(np.append(rank, 0), np.minimum(sets.bounds[:-1], len(rank))) > 0
        places, needs = [], np.ones(len(n), dtype=np.int8)
        for k, (a, b, m) in enumerate(zip(sets.bounds[:-1].tolist(), sets.bounds[1:].tolist(), base.tolist(), strict=True)):
            if a == b or not ranked[k]:
                places.append(np.arange(a, a + m))
                continue
            order = a + np.argsort(rank[a:b], kind="stable")
            candidates = float(excess[order[:m]].sum())
            needs[k] = min(1 + int(np.log(1.0 + candidates) / np.log(NEED_STEP)), MOST_NEED)
            places.append(order[: m + int(needs[k]) - 1])
        sizes = np.array([len(p) for p in places], dtype=np.int64)
        return np.concatenate(places) if places else np.zeros(0, dtype=np.int64), sizes, needs


_SURVEY = "doc_id long, n long, one long, two long, text_key long, histogram binary, segment int, part long, counts binary"


def survey(docs: DataFrame, size: int) -> DataFrame:
    """One reading of ``doc_id, text`` that makes both a row per document (size, identity and histogram of
    its set) and each task's sketch of shingle counts, in segments (``segment`` is null in the former)."""
    width = SKETCH_CELLS // SKETCH_SEGMENTS
    names = [f.split(" ")[0] for f in _SURVEY.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((2, SKETCH_CELLS), dtype=np.uint32)
        for batch in batches:
            for first, last, words in _word_runs(batch.column(1)):
                sets = shingle_sets(words, size)
                for row, cells in zip(sketch, _cells(sets.shingles), strict=True):
                    row += np.bincount(cells, minlength=SKETCH_CELLS).astype(np.uint32)
                one, two = sets.keys()
                found = [pa.array(np.diff(sets.bounds), pa.int64()), pa.array(one), pa.array(two), pa.array(sets.text_keys)]
                found.append(pa.array([h.tobytes() for h in sets.histograms()], pa.binary()))
                none = [pa.nulls(last - first, t) for t in (pa.int32(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *found, *none], names=names)
        packed = [zlib.compress(sketch[:, s * width : (s + 1) * width].tobytes(), 1) for s in range(SKETCH_SEGMENTS)]
        none = [pa.nulls(SKETCH_SEGMENTS, t) for t in (*[pa.int64()] * 5, pa.binary())]
        own = [pa.array(range(SKETCH_SEGMENTS), pa.int32()), pa.array([TaskContext.get().partitionId()] * SKETCH_SEGMENTS, pa.int64()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, *own], names=names)

    return docs.select("doc_id", "text").mapInArrow(rows, _SURVEY)


def merged_frequencies(sketches: DataFrame) -> Frequencies:
    """The sketch of all documents; tasks' sketches meet sixty-four at a time."""
    width = SKETCH_CELLS // SKETCH_SEGMENTS
    schema = "segment int, part long, counts binary"

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(2 * width, dtype=np.uint64)
        for body in rows["counts"]:
            total += np.frombuffer(zlib.decompress(body), dtype=np.uint32)
        total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        return pd.DataFrame({"segment": [rows["segment"].iloc[0]], "part": [rows["part"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    merged = sketches.select("segment", "part", "counts")
    for step in (6, 12, 63):
        merged = merged.groupBy("segment", F.shiftright("part", step).alias("group")).applyInPandas(merge, schema)
    rows = np.zeros((2, SKETCH_CELLS), dtype=np.uint32)
    for row in merged.select("segment", "counts").toLocalIterator():  # SKETCH_SEGMENTS rows of fixed size
        at = row.segment * width
        rows[:, at : at + width] = np.frombuffer(zlib.decompress(bytes(row.counts)), dtype=np.uint32).reshape(2, width)
    return Frequencies(rows)


def _prefixes(texts: DataFrame, frequencies, size: int, percent: int) -> DataFrame:
    """``token, one, n, place, need``: the prefix of every set, once per batch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for _, _, words in _word_runs(batch.column(0)):
                sets = shingle_sets(words, size)
                one, two = sets.keys()
                fresh = []
                for k, key in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                    if sets.bounds[k] < sets.bounds[k + 1] and key not in seen:
                        seen.add(key)
                        fresh.append(k)
                places, sizes, need = frequencies.value.prefixes(sets, percent)
                chosen = np.zeros(len(sizes), dtype=bool)
                chosen[fresh] = True
                rows = np.repeat(chosen, sizes)
                sizes = sizes[chosen]
                place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                spread = lambda values, kind: np.repeat(values[chosen].astype(kind), sizes)
                columns = [signed(sets.shingles[places[rows]]), spread(one, np.int64), spread(np.diff(sets.bounds), np.int32), place.astype(np.int32), spread(need, np.int8)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "one", "n", "place", "need"])

    return texts.select("text").mapInArrow(rows, "token long, one long, n int, place int, need byte")


def _held(rows: DataFrame, column: str, bloom) -> DataFrame:
    """Rows whose ``column`` a Bloom filter may hold."""
    place = rows.columns.index(column)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom.value.may_hold(np.asarray(batch.column(place))), pa.bool_()))

    return rows.mapInArrow(some, rows.schema)


def _least_overlap(n: str, m: str, percent: int) -> str:
    """The smallest overlap that links sets of these sizes."""
    return f"(({percent} * (CAST({n} AS BIGINT) + {m}) + {99 + percent}) DIV {100 + percent})"


_ENDS = [f"{side}_{c}" for side in "ab" for c in ("one", "two", "text_key")]


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose histograms leave room for the overlap they need, with both keys and a text of
    each. ``pairs`` has the first halves of the keys, ``a, b``."""
    side = lambda name: classes.select(*[F.col(c).alias(f"{name}_{c}") for c in ("one", "two", "text_key", "n", "histogram")])
    joined = pairs.join(side("a"), F.col("a") == F.col("a_one")).join(side("b"), F.col("b") == F.col("b_one"))
    joined = joined.select(*_ENDS, (F.col("a_n") + F.col("b_n")).alias("n"), "a_histogram", "b_histogram")

    def room(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, 256).astype(np.int16) for c in (7, 8))
            n = np.asarray(batch.column(6))
            least = -(-percent * n // (100 + percent))
            yield batch.select(_ENDS).filter(pa.array(np.abs(a - b).sum(axis=1) <= n - 2 * least, pa.bool_()))

    return joined.mapInArrow(room, ", ".join(f"{c} long" for c in _ENDS))


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``a_one, a_two, b_one, b_two`` of the linked ones among :func:`plausible` pairs.

    Only documents in some pair, and what a Bloom filter of bounded size lets through besides, send
    their sets. Both joins may be split where a document is in very many pairs.
    """
    keys = pairs.select(F.col("a_text_key").alias("hash")).unionByName(pairs.select(F.col("b_text_key").alias("hash"))).distinct()
    bloom = texts.sparkSession.sparkContext.broadcast(build_bloom(keys))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int, int], bytes] = {}
            for _, _, words in _word_runs(batch.column(0)):
                if not len(words.hashes):
                    continue
                own = _text_keys(words)
                some = np.flatnonzero(bloom.value.may_hold(own) & (words.counts() > 0))
                for k in some.tolist():
                    alone = shingle_sets(words.document(k), size)
                    one, two = alone.keys()
                    found.setdefault((int(own[k]), int(one[0]), int(two[0])), alone.shingles.tobytes())
            keys = [pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*keys, pa.array(list(found.values()), pa.binary())], names=[*identity, "shingles"])

    identity = ["text_key", "one", "two"]
    stored = texts.select("text").mapInArrow(sets, "text_key long, one long, two long, shingles binary").dropDuplicates(identity)
    stored = stored_table(stored, "shingle-sets")
    side = lambda name: stored.select(*[F.col(c).alias(f"{name}_{c}") for c in (*identity, "shingles")])
    joined = pairs
    for name in "ab":
        joined = joined.join(side(name), [f"{name}_{c}" for c in identity])
    ends = ["a_one", "a_two", "b_one", "b_two"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column(4), batch.column(5), strict=True):
                a, b = np.frombuffer(a.as_buffer(), dtype=_U), np.frombuffer(b.as_buffer(), dtype=_U)
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(ends).filter(pa.array(linked, pa.bool_()))

    return joined.select(*ends, "a_shingles", "b_shingles").mapInArrow(check, ", ".join(f"{c} long" for c in ends))


def _as_edges(links: DataFrame, classes: DataFrame) -> DataFrame:
    side = lambda name, node: classes.select(F.col("one").alias(f"{name}_one"), F.col("two").alias(f"{name}_two"), F.col("number").alias(node))
    return links.join(side("a", "u"), ["a_one", "a_two"]).join(side("b", "v"), ["b_one", "b_two"]).select("u", "v")


def shingle_components(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` for every row of ``docs``, and the set's key.

    ``component_id`` is the smallest id that links lead to, the row's own included; ``class_id`` the
    smallest with the same set. Null and empty texts, and those of white space, have an empty set and are
    linked with nothing. Null ids count for nothing in minima; a component of them alone has a null id.
    Repeated rows have one set and so one component. Texts of any length are read whole. Other columns are
    not read; an empty table gives no rows.
    """
    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    texts = narrow.select("text")
    spark = docs.sparkSession
    surveyed = stored_table(survey(narrow, size), "survey")
    members = surveyed.filter("segment IS NULL").select("doc_id", "n", "one", "two")
    # Copies of a set have one size and histogram; any of their texts stands for the set.
    classes = surveyed.filter("n > 0").groupBy("one", "two").agg(
        F.min("doc_id").alias("class_id"), F.min("text_key").alias("text_key"), F.max("n").alias("n"), F.first("histogram").alias("histogram")
    )
    classes = stored_table(classes.withColumn("number", F.monotonically_increasing_id()), "set-classes")
    frequencies = spark.sparkContext.broadcast(merged_frequencies(surveyed.filter("segment IS NOT NULL")))

    prefixes = stored_table(_prefixes(texts, frequencies, size, percent), "prefixes")
    # Most shingles are in one document only. The lowest and highest key tell, in plain sums of longs.
    several = prefixes.groupBy("token").agg(F.min("one").alias("low"), F.max("one").alias("high")).filter("low < high").select("token")
    several = stored_table(several, "shared-tokens")
    bloom = spark.sparkContext.broadcast(build_bloom(several.select(F.col("token").alias("hash"))))
    shared = stored_table(_held(prefixes, "token", bloom).join(several, "token", "left_semi"), "shared-prefixes")
    hubs = shared.groupBy("token").agg(F.min(F.struct("place", "n", "one")).alias("hub"))
    hubs = stored_table(hubs.select("token", F.col("hub.one").alias("b"), F.col("hub.n").alias("m"), F.col("hub.place").alias("q")), "hubs")

    near = shared.join(hubs, "token").filter("one <> b").filter(
        f"least(place, q) + least(n - place, m - q) >= {_least_overlap('n', 'm', percent)}"
    )
    first = stored_table(near.select(F.col("one").alias("a"), "b").distinct(), "hub-pairs")
    likely = stored_table(plausible(first, classes, percent), "likely-hub-pairs")
    links = stored_table(verified(likely, texts, size, percent), "hub-links")
    edges = stored_table(_as_edges(links, classes), "hub-edges")
    labels = connected_components(edges)

    joined = classes.join(labels, classes["number"] == labels["node"]).select("one", F.col("label").alias("part"))
    parted = stored_table(shared.join(stored_table(joined, "hub-parts"), "one", "left"), "parted-prefixes")
    # A shingle whose documents are all in one component has nothing left to say.
    mixed = parted.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("part").alias("parted"), F.count("*").alias("all"))
    mixed = stored_table(mixed.filter("all > 1 AND (parted < all OR low < high)").select("token"), "mixed-tokens")
    rest = parted.join(mixed, "token", "left_semi")
    left = rest.select("token", F.col("one").alias("a"), F.col("n").alias("n"), F.col("place").alias("p"), F.col("need").alias("s"), F.col("part").alias("e"))
    right = rest.select("token", F.col("one").alias("b"), F.col("n").alias("m"), F.col("place").alias("q"), F.col("need").alias("t"), F.col("part").alias("f"))
    # The c-th shared shingle of a linked pair leaves room for all but c - 1 of the overlap after it.
    room = f"{_least_overlap('n', 'm', percent)} - least(s, t) + 1"
    apart = left.join(right, "token").filter(
        f"(n < m OR (n = m AND a < b)) AND coalesce(e <> f, true) AND 100 * n >= {percent} * m AND n - p >= {room} AND m - q >= {room}"
    )
    second = apart.groupBy("a", "b").agg(F.count("*").alias("both"), F.max(F.least("s", "t")).alias("need")).filter("both >= need")
    second = second.select("a", "b").join(first.select(F.col("a"), F.col("b")), ["a", "b"], "left_anti")
    second = second.join(first.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    second = stored_table(plausible(second, classes, percent), "apart-pairs")
    more = stored_table(_as_edges(verified(second, texts, size, percent), classes), "apart-edges")
    # Components of the first round are nodes now.
    spanning = labels.select(F.col("node").alias("u"), F.col("label").alias("v"))
    labels = connected_components(spanning.unionByName(more))

    numbered = classes.join(labels, classes["number"] == labels["node"], "left").select(
        "one", "two", "class_id", F.coalesce("label", "number").alias("label")
    )
    numbered = stored_table(numbered, "set-labels")
    smallest = numbered.groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = stored_table(numbered.join(smallest, "label").select("one", "two", "class_id", "component_id"), "set-components")
    rows = members.join(named, ["one", "two"], "left")
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "one", "two",
    )


def one_of_each_group(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The documents of ``docs``, with all columns, that have the smallest id of their component. Of rows
    with one id and text one stays; documents without words all stay."""
    own = {name: spare(name, docs.columns) for name in ("id", "no_id", "one", "two")}
    place, at = docs.columns.index(text_column), len(docs.columns)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words in _word_runs(batch.column(place)):
                keys = [pa.array(k) for k in shingle_sets(words, size).keys()]
                rows = [c.slice(first, last - first) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*rows, *keys], names=[f"c{i}" for i in range(at)] + ["one", "two"])

    def ids(number):
        return [F.coalesce(number, F.lit(0)).alias(own["id"]), number.isNull().alias(own["no_id"])]

    found = shingle_components(docs, size, percent, id_column, text_column)
    stays = found.filter("n_shingles > 0 AND doc_id <=> component_id")
    stays = stays.select(*ids(F.col("doc_id")), F.col("one").alias(own["one"]), F.col("two").alias(own["two"])).distinct()
    fields = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)]
    rows = docs.toDF(*[f"c{i}" for i in range(at)]).mapInArrow(keyed, ", ".join([*fields, "one long", "two long"]))
    rows = rows.toDF(*docs.columns, own["one"], own["two"]).select("*", *ids(F.col(f"`{id_column}`").cast("long")))
    empty = (F.col(own["one"]) == 0) & (F.col(own["two"]) == 0)
    keys = list(own.values())
    kept = rows.filter(~empty).join(stays, keys, "left_semi").dropDuplicates(keys)
    return kept.select(*plain(docs)).unionByName(rows.filter(empty).select(*plain(docs)))
