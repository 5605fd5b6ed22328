"""Cross-entropy difference: per-token loss under a target and a background bigram model.

Both models share one vocabulary, the most frequent words of all documents with one entry for every
other word, and one form: bigram relative frequencies mixed with add-one smoothed unigram ones. The
background model counts every document, the target model those a caller names. Counts are exact
and made by all tasks; what reaches the workers is a pair of tables whose size the vocabulary bounds.

Without a bound on the vocabulary every word keeps its own counts. These are then tables that grow with
the corpus: they stay in Spark, and the bigrams of the documents meet their losses in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pinwatch.llm import blocks
from pinwatch.llm.bloom import build_bloom
from pinwatch.llm.quality import SPACE_CHARS, SPACE_PATTERN
from pinwatch.plans.timeline import KEY_LIMIT, spread_join
from pinwatch.session import stored_table

#: Words with an entry of their own, and the weight of bigram frequencies.
VOCABULARY, BIGRAM_WEIGHT = 2048, 0.7
_PENDING = 4_000_000


@dataclass
class Vocabulary:
    """Word hashes in order; the number of a word is its place, other words are ``size - 1``, and what
    stands before a document's first word is ``size``."""

    hashes: np.ndarray

    @property
    def size(self) -> int:
        return len(self.hashes) + 1

    def bigrams(self, words: blocks.Words) -> np.ndarray:
        """``previous * size + word`` for every word."""
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == words.hashes if len(self.hashes) else np.zeros(len(words.hashes), dtype=bool)
        number = np.where(known, at, self.size - 1)
        before = np.concatenate([[self.size], number[:-1]])[: len(number)]
        firsts = words.firsts[:-1][words.counts() > 0]
        before[firsts] = self.size
        return before * self.size + number


def most_frequent_words(texts: DataFrame, most: int = VOCABULARY) -> DataFrame:
    """``word, times`` of the most frequent words of the column ``text``; of equally frequent ones the
    smaller in UTF-8 order."""
    words = texts.select(F.explode(F.split(F.btrim("text", F.lit(SPACE_CHARS)), SPACE_PATTERN)).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "word").limit(most)


def shared_vocabulary(texts: DataFrame, most: int = VOCABULARY) -> Vocabulary:
    found = [row.word.encode() for row in most_frequent_words(texts, most).select("word").collect()]
    if not found:
        return Vocabulary(np.zeros(0, dtype=blocks._U))
    data = np.frombuffer(b" ".join(found), dtype=np.uint8)
    return Vocabulary(np.sort(blocks.words(data, np.array([0, len(data)])).hashes))


def bigram_counts(texts: DataFrame, vocabulary) -> DataFrame:
    """``bigram, times`` over the column ``text``; tasks add up their own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [], 0

        def settle() -> pa.RecordBatch:
            codes, times = np.unique(np.concatenate(pending), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(times)], names=["bigram", "times"])

        for batch in batches:
            data, offsets = blocks.text_bytes(batch.column(0))
            for first, last in blocks.document_runs(offsets):
                codes = vocabulary.value.bigrams(blocks.words(data, offsets[first : last + 1]))
                pending.append(codes)
                size += len(codes)
            if size > _PENDING:
                yield settle()
                pending, size = [], 0
        if pending:
            yield settle()

    return texts.select("text").mapInArrow(count, "bigram long, times long").groupBy("bigram").agg(F.sum("times").alias("times"))


def losses(counts: np.ndarray, weight: float = BIGRAM_WEIGHT) -> np.ndarray:
    """Negative log probability of each word after each context, from counts of contexts by words."""
    words = counts.sum(axis=0)
    single = (words + 1.0) / (words.sum() + len(words))
    contexts = counts.sum(axis=1, keepdims=True)
    double = np.divide(counts, contexts, out=np.zeros_like(counts, dtype=np.float64), where=contexts > 0)
    share = np.where(contexts > 0, weight, 0.0)
    return -np.log(share * double + (1.0 - share) * single)


def _table(counts: DataFrame, size: int) -> np.ndarray:
    """Counts as an array; at most ``(size + 1) * size`` rows, whatever the corpus."""
    table, found = np.zeros((size + 1) * size), counts.toArrow()
    table[np.asarray(found["bigram"], dtype=np.int64)] = np.asarray(found["times"], dtype=np.int64)
    return table.reshape(size + 1, size)


#: What stands before a document's first word, as a word's hash.
_START = blocks._U(0)


def _hashed_bigrams(words: blocks.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the word before, and of the bigram, for every word."""
    before = np.concatenate([[_START], words.hashes[:-1]])[: len(words.hashes)]
    before[words.firsts[:-1][words.counts() > 0]] = _START
    return before, blocks.mix(blocks.mix(before) + words.hashes)


def all_bigrams(texts: DataFrame) -> DataFrame:
    """``bigram, before, word, times`` over the column ``text``, by hashes; tasks add up their own. A bigram
    may come in several rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [], 0

        def settle() -> pa.RecordBatch:
            before, word, bigram = (np.concatenate(c) for c in zip(*pending, strict=True))
            codes, first, times = np.unique(bigram, return_index=True, return_counts=True)
            columns = [blocks.signed(codes), blocks.signed(before[first]), blocks.signed(word[first]), times]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bigram", "before", "word", "times"])

        for batch in batches:
            data, offsets = blocks.text_bytes(batch.column(0))
            for first, last in blocks.document_runs(offsets):
                words = blocks.words(data, offsets[first : last + 1])
                before, bigram = _hashed_bigrams(words)
                pending.append((before, words.hashes, bigram))
                size += len(bigram)
                if size > _PENDING:
                    yield settle()
                    pending, size = [], 0
        if pending:
            yield settle()

    return texts.select("text").mapInArrow(count, "bigram long, before long, word long, times long")


def document_bigrams(rows: DataFrame) -> DataFrame:
    """``row, doc_id, bigram, n``: the distinct bigrams of every row of ``row, doc_id, text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = blocks.text_bytes(batch.column(2))
            for first, last in blocks.document_runs(offsets):
                words = blocks.words(data, offsets[first : last + 1])
                owners, bigram = words.documents() + first, _hashed_bigrams(words)[1]
                order = np.lexsort((bigram, owners))
                owners, bigram = owners[order], bigram[order]
                fresh = np.ones(len(order), dtype=bool)
                fresh[1:] = (owners[1:] != owners[:-1]) | (bigram[1:] != bigram[:-1])
                heads = np.flatnonzero(fresh)
                at = pa.array(owners[heads])
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(blocks.signed(bigram[heads])), pa.array(np.diff(np.append(heads, len(order))))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "bigram", "n"])

    return rows.select("row", "doc_id", "text").mapInArrow(count, "row long, doc_id long, bigram long, n long")


def _shares(counts: DataFrame, key: str, limit: int) -> DataFrame | None:
    """Shares for the keys whose ``_n`` is above the limit; None when there are none."""
    shares = stored_table(counts.filter(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_shares")), "shares")
    return None if shares.isEmpty() else shares


def bigram_losses(counts: DataFrame, weight: float = BIGRAM_WEIGHT, limit: int = KEY_LIMIT) -> DataFrame:
    """``bigram, target_loss, background_loss`` from ``bigram, before, word, target, background``. A word or a
    context with more than ``limit`` bigrams is joined in shares."""
    models = ("target", "background")

    def totals(key: str) -> DataFrame:
        return stored_table(counts.groupBy(key).agg(F.count("*").alias("_n"), *[F.sum(m).alias(f"{key}_{m}") for m in models]), f"{key}-counts")

    words, contexts = totals("word"), totals("before")
    size = words.agg(F.count("*").alias("words"), *[F.coalesce(F.sum(f"word_{m}"), F.lit(0)).alias(m) for m in models]).first()
    known = spread_join(counts, words.drop("_n"), ["word"], _shares(words, "word", limit))
    known = spread_join(known, contexts.drop("_n"), ["before"], _shares(contexts, "before", limit))

    def loss(model: str) -> Column:
        single = (F.col(f"word_{model}") + 1.0) / F.lit(float(size[model] + size["words"] + 1))
        double = F.col(model) / F.col(f"before_{model}")
        return -F.log(F.when(F.col(f"before_{model}") > 0, weight * double + (1.0 - weight) * single).otherwise(single))

    return known.select("bigram", *[loss(m).alias(f"{m}_loss") for m in models])


def _scored_by_all_words(narrow: DataFrame, target: DataFrame, weight: float, limit: int = KEY_LIMIT) -> DataFrame:
    none = F.lit(0).cast("long")
    both = all_bigrams(narrow).select("bigram", "before", "word", none.alias("target"), F.col("times").alias("background")).unionByName(
        all_bigrams(target).select("bigram", "before", "word", F.col("times").alias("target"), none.alias("background"))
    )
    counts = both.groupBy("bigram").agg(*[F.min(c).alias(c) for c in ("before", "word")], *[F.sum(c).alias(c) for c in ("target", "background")])
    counts = stored_table(counts, "bigram-counts")
    rows = narrow.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # A bigram is in no more documents than it has occurrences.
    shares = _shares(counts.select("bigram", F.col("background").alias("_n")), "bigram", limit)
    found = spread_join(document_bigrams(rows), bigram_losses(counts, weight, limit), ["bigram"], shares)
    mean = lambda c: (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c)
    scored = found.groupBy("row", "doc_id").agg(F.sum("n").alias("n_tokens"), mean("target_loss"), mean("background_loss"))
    scored = scored.select("doc_id", "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("difference"))
    nothing = [F.lit(None).cast("double").alias(c) for c in ("target_loss", "background_loss", "difference")]
    return scored.unionByName(narrow.filter(F.btrim("text", F.lit(SPACE_CHARS)) == "").select("doc_id", none.alias("n_tokens"), *nothing))


def cross_entropy_difference(
    docs: DataFrame, targets: DataFrame, vocabulary_size: int | None = VOCABULARY, weight: float = BIGRAM_WEIGHT,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, difference`` for every row of ``docs``.

    ``targets`` has the ids of the target documents in a column ``doc_id``, any number of times; null ids
    are no target. Losses are nats per token; a low difference means close to the target. Texts that are
    null, empty or white space have no tokens and null losses. Without any target document the target
    model is uniform. Rows that share an id are scored, and counted, each for itself. Texts of any length are
    read whole. Other columns are not read; an empty table gives no rows. With ``vocabulary_size`` None every word has an entry.
    """
    spark = docs.sparkSession
    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    wanted = stored_table(targets.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct(), "target-ids")
    bloom = spark.sparkContext.broadcast(build_bloom(wanted.select(F.xxhash64("doc_id").alias("hash"))))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = bloom.value.may_hold(np.asarray(batch.column(2)))
            yield batch.select(["doc_id", "text"]).filter(pa.array(keep, pa.bool_()))

    # The filter leaves few others, so the join shuffles little more than the target's own texts.
    some = narrow.select("doc_id", "text", F.xxhash64("doc_id").alias("hash")).mapInArrow(likely, "doc_id long, text string")
    chosen = some.join(wanted, "doc_id", "left_semi")
    rounded = [F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "difference")]
    if vocabulary_size is None:
        return _scored_by_all_words(narrow, chosen, weight).select("doc_id", "n_tokens", *rounded)
    vocabulary = shared_vocabulary(narrow, vocabulary_size)
    shared = spark.sparkContext.broadcast(vocabulary)
    target = _table(bigram_counts(chosen, shared), vocabulary.size)
    background = _table(bigram_counts(narrow, shared), vocabulary.size)
    models = spark.sparkContext.broadcast(np.stack([losses(target, weight).ravel(), losses(background, weight).ravel()]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = blocks.text_bytes(batch.column(1))
            tokens, sums = [], []
            for first, last in blocks.document_runs(offsets):
                words = blocks.words(data, offsets[first : last + 1])
                codes = shared.value.bigrams(words)
                n = words.counts()
                total = np.zeros((2, len(n)))
                if len(codes):
                    some = n > 0
                    total[:, some] = np.add.reduceat(models.value[:, codes], words.firsts[:-1][some], axis=1)
                tokens.append(n)
                sums.append(total)
            n = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64)
            means = np.concatenate(sums, axis=1) / np.maximum(n, 1) if sums else np.zeros((2, 0))
            none = n == 0
            columns = [means[0], means[1], means[0] - means[1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *[pa.array(c, mask=none) for c in columns]],
                names=["doc_id", "n_tokens", "target_loss", "background_loss", "difference"],
            )

    schema = "doc_id long, n_tokens long, target_loss double, background_loss double, difference double"
    scored = narrow.mapInArrow(score, schema)
    return scored.select("doc_id", "n_tokens", *rounded)
