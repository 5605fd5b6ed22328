"""Cross-entropy difference over all words: two bigram models with one vocabulary, counted in packed segments.

The target model counts the documents a caller names, the background model all of them. Both predict each
word, and the end of the text, from the word before or from the text's beginning; both add the same
amount to every count, over the same vocabulary, which is every word of all documents.

A task packs what it reads, some millions of predictions at a time, into one row of arrays for each segment
of contexts: the different bigrams, and for each the documents that hold it. So a bigram of a document
costs some nine bytes on its way. A segment holds every occurrence of its contexts, hence all counts
that their losses need; it adds up its losses for each document and sends these sums back. Contexts that are too
frequent for a segment, and the beginning of a text, are spread by the word that follows. How often they
occur is known from the count of words, which also gives the vocabulary's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pinwatch.llm import blocks
from pinwatch.llm.blocks import _U, signed
from pinwatch.llm.bloom import BlockedBloom, build_bloom
from pinwatch.session import stored_table

#: What is added to each count of either model.
ADDED = 0.01
#: Predictions packed at once by a task, and about as many to a segment. A context with more than a
#: quarter of that is spread.
CHUNK, SEGMENT = 1 << 20, 1 << 20
#: Segments that one task has at hand.
BUNDLE = 4
#: What stands before a text's first word, and what follows its last one.
_BEGIN, _END = _U(0), _U(1)

_PACKED = "segment int, chunk long, contexts binary, followers binary, words binary, holders binary, rows binary, times binary, ids array<long>, sizes array<long>"
_SUMS = "chunk long, rows binary, sums binary, ids array<long>, sizes array<long>"


def predictions(words: blocks.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and word of every prediction of the documents that have words, and the document."""
    counts = words.counts()
    some = np.flatnonzero(counts)
    n = len(words.hashes) + len(some)
    ends = np.cumsum(counts[some] + 1)
    word, context = np.full(n, _END, dtype=_U), np.full(n, _BEGIN, dtype=_U)
    inside = np.ones(n, dtype=bool)
    inside[ends - 1] = False
    word[inside] = words.hashes
    inside = np.ones(n, dtype=bool)
    inside[ends - counts[some] - 1] = False
    context[inside] = words.hashes
    return context, word, np.repeat(some, counts[some] + 1)


def _tallied(texts: DataFrame, tally) -> DataFrame:
    """``word, n`` of the column ``text``: what ``tally`` gives of each block of words, added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [np.zeros(0, dtype=_U)], 0

        def settle() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(pending), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(signed(word)), pa.array(n)], names=["word", "n"])

        for batch in batches:
            data, offsets = blocks.text_bytes(batch.column(0))
            for first, last in blocks.document_runs(offsets):
                pending.append(tally(blocks.words(data, offsets[first : last + 1])))
                size += len(pending[-1])
                if size > CHUNK:
                    yield settle()
                    pending, size = [], 0
        if pending:
            yield settle()

    return texts.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def context_counts(texts: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """``word, n``: how often each word, by its hash, is a context, which is wherever it occurs; the beginning of
    a text is a context of each text with words. ``among`` are the contexts to count, sorted, else all."""

    def tally(words: blocks.Words) -> np.ndarray:
        found = np.concatenate([words.hashes, np.full(np.count_nonzero(words.counts()), _BEGIN, dtype=_U)])
        if among is None:
            return found
        return found[among[np.minimum(np.searchsorted(among, found), len(among) - 1)] == found]

    return _tallied(texts, tally)


def likely_targets(docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, BlockedBloom]:
    """``doc_id, is_target, text`` of those rows of ``doc_id, text, hash`` that a Bloom filter takes for targets, and the
    filter. Only their texts meet the list of ids."""
    spark = docs.sparkSession
    wanted = stored_table(targets.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct(), "target-ids")
    bloom = build_bloom(wanted.select(F.xxhash64("doc_id").alias("hash")))
    shared = spark.sparkContext.broadcast(bloom)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = shared.value.may_hold(np.asarray(batch.column(2)))
            yield batch.select(["doc_id", "text"]).filter(pa.array(held, pa.bool_()))

    named = docs.mapInArrow(some, "doc_id long, text string").join(wanted.withColumn("is_target", F.lit(True)), "doc_id", "left")
    return stored_table(named.select("doc_id", F.coalesce("is_target", F.lit(False)).alias("is_target"), "text"), "likely-targets"), bloom


class Frequent:
    """Contexts that are spread over the segments: sorted hashes, and both models' counts of each."""

    def __init__(self, context: np.ndarray, counts: np.ndarray):
        self.context, self.counts = context, counts

    def find(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which values are among them, and their places."""
        at = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        return self.context[at] == context, at

    def keys(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """What deals a prediction to a segment: its context, or context and word together. With the word it
        tells the context either way."""
        return np.where(self.find(context)[0], context ^ blocks.mix(word), context)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """First places of the runs of equal rows."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _narrow(values: np.ndarray) -> bytes:
    """Small integers as two planes of 16 bits, of which the upper one is nearly all zeros."""
    return (values & 0xFFFF).astype("<u2").tobytes() + (values >> 16).astype("<u2").tobytes()


def _wide(data) -> np.ndarray:
    planes = np.frombuffer(data, dtype="<u2").reshape(2, -1)
    return planes[0] | planes[1].astype(np.uint32) << np.uint32(16)


def packed(rows: DataFrame, frequent, segments: int, part: int, apart=None) -> DataFrame:
    """Predictions of ``doc_id, is_target, text`` in rows of arrays, one for each chunk and segment; and for each
    chunk a row with the ids and word counts of its documents. ``part`` tells the chunks of two calls apart. Rows
    whose ``hash`` the filter ``apart`` holds are left out."""
    names = [f.split(" ")[0] for f in _PACKED.split(", ")]
    width = -(-(1 << 32) // segments)

    def chunk_rows(chunk: int, parts: list, ids: list, sizes: list) -> Iterator[pa.RecordBatch]:
        key, word, owner = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((owner, word, key))
        key, word, owner = key[order], word[order], owner[order]
        entry = _heads(key, word, owner)
        times = np.diff(np.append(entry, len(key)))
        key, word, owner = key[entry], word[entry], owner[entry]
        pair = _heads(key, word)
        context = _heads(key[pair])
        segment = (key[pair[context]] >> _U(32)).astype(np.int64) // width
        present, first = np.unique(segment, return_index=True)
        from_context = np.append(first, len(context))
        from_pair = np.append(context, len(pair))[from_context]
        from_entry = np.append(pair, len(key))[from_pair]
        followers, holders = np.diff(np.append(context, len(pair))), np.diff(np.append(pair, len(key)))
        for k, s in enumerate(present.tolist()):
            c, p, e = (slice(x[k], x[k + 1]) for x in (from_context, from_pair, from_entry))
            body = [key[pair[context[c]]].tobytes(), _narrow(followers[c]), word[pair[p]].tobytes(), _narrow(holders[p]), _narrow(owner[e]), _narrow(times[e])]
            yield [s, chunk, *body, None, None]
        yield [segments + chunk % segments, chunk, *[None] * 6, ids, np.concatenate(sizes).tolist()]

    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6, *[pa.list_(pa.int64())] * 2]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 1 | part) << 24
        parts, ids, sizes, held, documents = [], [], [], 0, 0
        for batch in batches:
            if apart is not None:
                batch = batch.filter(pa.array(~apart.value.may_hold(np.asarray(batch.column(3))), pa.bool_()))
            flags = np.asarray(batch.column(1)).astype(np.int64)
            data, offsets = blocks.text_bytes(batch.column(2))
            for first, last in blocks.document_runs(offsets):
                words = blocks.words(data, offsets[first : last + 1])
                context, word, owner = predictions(words)
                parts.append((frequent.value.keys(context, word), word, (owner + documents) * 2 + flags[first:last][owner]))
                ids += batch.column(0).slice(first, last - first).to_pylist()
                sizes.append(words.counts())
                held, documents = held + len(word) + last - first, documents + last - first
                if held > CHUNK:
                    yield batch_of(list(chunk_rows(number, parts, ids, sizes)))
                    number, parts, ids, sizes, held, documents = number + 1, [], [], [], 0, 0
        if documents:
            yield batch_of(list(chunk_rows(number, parts, ids, sizes)))

    return rows.select("doc_id", "is_target", "text", *(["hash"] if apart is not None else [])).mapInArrow(pack, _PACKED)


def _losses(body: dict[str, list], frequent: Frequent, vocabulary: int, added: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the packed rows of one segment its documents and the sums of both models' losses."""
    read = lambda name: np.concatenate([np.frombuffer(b, dtype="<u8") for b in body[name]])
    small = lambda name: np.concatenate([_wide(b) for b in body[name]])
    key_of, word = np.repeat(read("contexts"), small("followers")), read("words")
    # Bigrams of the chunks, in one order.
    order = np.lexsort((word, key_of))
    heads = _heads(key_of[order], word[order])
    bigram = np.empty(len(order), dtype=np.int32)
    bigram[order] = np.repeat(np.arange(len(heads), dtype=np.int32), np.diff(np.append(heads, len(order))))
    distinct = order[heads]
    key_of, word = key_of[distinct], word[distinct]
    del order, distinct
    of_entry = np.repeat(bigram, small("holders"))
    owner, times, size = small("rows"), small("times"), len(heads)
    both = [np.bincount(of_entry, times if model else times * (owner & np.uint32(1)), size) for model in (0, 1)]
    heads = _heads(key_of)
    context = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, size)))
    spread, at = frequent.find(key_of ^ blocks.mix(word))
    loss = []
    for model, counts in enumerate(both):
        before = np.bincount(context, counts, len(heads))[context]
        before[spread] = frequent.counts[at[spread], model]
        loss.append(-np.log((counts + added) / (before + added * vocabulary)))
    first = 0
    for rows in body["rows"]:
        part = slice(first, first + len(rows) // 4)
        first = part.stop
        document, which = np.unique(owner[part] >> np.uint32(1), return_inverse=True)
        yield document, np.stack([np.bincount(which, times[part] * one[of_entry[part]], len(document)) for one in loss])


def segment_losses(rows: DataFrame, frequent, vocabulary: int, added: float = ADDED) -> DataFrame:
    """Sums of both models' losses, for each chunk and bundle of segments; rows with ids pass through. A task has a
    bundle at hand and works on one segment of it at a time, so a document's sums of several segments travel as one."""

    def losses(key: tuple, table: pa.Table) -> pa.Table:
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = [f.split(" ")[0] for f in _SUMS.split(", ")]
        segment, chunk, ids, sizes = (table.column(c).to_pylist() for c in ("segment", "chunk", "ids", "sizes"))
        out = [(c, None, None, i, n) for c, i, n in zip(chunk, ids, sizes, strict=True) if i is not None]
        totals: dict[int, np.ndarray] = {}
        for one in sorted({s for s, i in zip(segment, ids, strict=True) if i is None}):
            some = sorted((k for k, s in enumerate(segment) if s == one and ids[k] is None), key=chunk.__getitem__)
            body = {c: [table.column(c)[k].as_buffer() for k in some] for c in ("contexts", "followers", "words", "holders", "rows", "times")}
            for k, (document, sums) in zip(some, _losses(body, frequent.value, vocabulary, added), strict=True):
                total = totals.get(chunk[k], np.zeros((2, 0)))
                if total.shape[1] <= document[-1]:
                    total = np.pad(total, ((0, 0), (0, int(document[-1]) + 1 - total.shape[1])))
                total[:, document] += sums
                totals[chunk[k]] = total
        for number, total in totals.items():
            document = np.flatnonzero(total[1])  # every loss is above 0
            out.append((number, document.astype("<u4").tobytes(), total[:, document].astype("<f8").tobytes(), None, None))
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.groupBy(F.floor(F.col("segment") / BUNDLE)).applyInArrow(losses, _SUMS)


def document_losses(sums: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss`` of every document: means over its predictions."""

    def collect(key: tuple, table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in table.column_names}
        own = next(k for k, ids in enumerate(columns["ids"]) if ids is not None)
        sizes = np.array(columns["sizes"][own], dtype=np.int64)
        total = np.zeros((2, len(sizes)))
        # In order of the segments' sums, so that a rerun adds up alike.
        for rows, part in sorted((r, s) for r, s in zip(columns["rows"], columns["sums"], strict=True) if r is not None):
            document = np.frombuffer(rows, dtype="<u4")
            total[:, document] += np.frombuffer(part, dtype="<f8").reshape(2, -1)
        mean, none = total / (sizes + 1), sizes == 0
        found = [pa.array(columns["ids"][own], pa.int64()), pa.array(sizes), *[pa.array(m, mask=none) for m in mean]]
        return pa.Table.from_arrays(found, names=["doc_id", "n_tokens", "target_loss", "background_loss"])

    return sums.groupBy("chunk").applyInArrow(collect, "doc_id long, n_tokens long, target_loss double, background_loss double")


def loss_difference(
    docs: DataFrame, targets: DataFrame, added: float = ADDED, segment: int = SEGMENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, difference`` for every row of ``docs``.

    ``targets`` has the ids of the target documents in a column ``doc_id``, any number of times; null ids
    are no target. Losses are nats per prediction: each word, and the text's end. A low difference means
    close to the target. Texts that are null, empty or white space have no words and null losses, and count
    in neither model. Texts of any length are read whole. Without any target document the target
    model is uniform. Rows that share an id are scored, and counted, each for itself. Other columns are
    not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    hashed = narrow.withColumn("hash", F.xxhash64("doc_id"))
    likely, bloom = likely_targets(hashed, targets)
    words = stored_table(context_counts(narrow), "context-counts")
    begin = int(signed(np.array([_BEGIN]))[0])
    size = words.agg(F.count(F.when(F.col("word") != begin, 1)).alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("predictions")).first()
    # At most four contexts for each segment, and the beginning.
    often = words.filter((F.col("n") > segment // 4) | (F.col("word") == begin)).toArrow()
    contexts = np.union1d(np.asarray(often.column("word")).astype(np.int64).view(_U), [_BEGIN])
    counts = np.zeros((len(contexts), 2))
    for model, found in enumerate((context_counts(likely.filter("is_target"), contexts).toArrow(), often)):
        at = np.searchsorted(contexts, np.asarray(found.column("word")).astype(np.int64).view(_U))
        counts[at, model] = np.asarray(found.column("n"))
    frequent = spark.sparkContext.broadcast(Frequent(contexts, counts))
    segments = max(1, -(-size.predictions // segment))
    others = packed(hashed.withColumn("is_target", F.lit(False)), frequent, segments, 0, spark.sparkContext.broadcast(bloom))
    sums = segment_losses(others.unionByName(packed(likely, frequent, segments, 1)), frequent, size.words + 1, added)
    found = document_losses(sums).withColumn("difference", F.col("target_loss") - F.col("background_loss"))
    return found.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "difference")])
