"""Token totals kept up to date by signed changes, each batch of which counts once.

The rollup is a folder. A batch reduces its changes to one row per source, language and tokenizer
version, with signed documents and tokens, and writes them below its own name; then a marker commits
it. Totals add up the committed batches. A batch that is committed already is passed over, and one that
broke off before its marker is written anew in its own place, so repeating a batch is always safe.
Compaction folds committed batches into a base that names them. Each batch name has one writer.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pinwatch.llm import blocks
from pinwatch.llm.encoders import byte_level
from pinwatch.session import stored_table

KEYS = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, documents long, tokens long"


def summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class TokenRollup:
    """The rollup at ``path``, in any file system Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _mark(self, path: str) -> None:
        fs, target = self._fs(path)
        fs.create(target, True).close()

    def committed(self) -> list[str]:
        return self._names("commits")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Take in ``changes`` (keys, signed ``documents`` and ``tokens``) under the name ``batch``; False if
        it was committed before. Null keys are a group of their own."""
        name = quote(batch, safe="")
        if name in self.committed():
            return False
        summed(changes).write.mode("overwrite").parquet(f"{self.path}/deltas/{name}")
        self._mark(f"{self.path}/commits/{name}")
        return True

    def _base(self) -> tuple[DataFrame | None, set[str]]:
        done = [int(n) for n in self._names("bases-done")]
        if not done:
            return None, set()
        base = f"{self.path}/bases/{max(done)}"
        held = {r.batch for r in self.spark.read.schema("batch string").parquet(f"{base}/batches").collect()}
        return self.spark.read.schema(TOTALS).parquet(f"{base}/totals"), held

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, documents, tokens``; groups that came down to nothing are left out."""
        base, held = self._base()
        paths = [f"{self.path}/deltas/{name}" for name in self.committed() if name not in held]
        parts = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        return summed(parts if base is None else parts.unionByName(base)).filter("documents <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Write a new base of everything committed so far; earlier files stay until they are removed."""
        names = self.committed()
        number = max([int(n) for n in self._names("bases-done")], default=0) + 1
        base = f"{self.path}/bases/{number}"
        self.totals().write.mode("overwrite").parquet(f"{base}/totals")
        self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{base}/batches")
        self._mark(f"{self.path}/bases-done/{number}")


def inserts(counts: DataFrame) -> DataFrame:
    """Changes for new documents; ``counts`` has the keys and ``tokens``."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("documents"), "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    """Changes for documents that go, with the tokens they had."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("documents"), (-F.col("tokens")).alias("tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """Changes for documents that stay with other counts: ``tokens`` before, ``new_tokens`` after."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("documents"), (F.col("new_tokens") - F.col("tokens")).alias("tokens"))


def counted(docs: DataFrame, tokenizer_path: str, texts: tuple[str, ...]) -> DataFrame:
    """``docs`` without the columns ``texts``; for each of them, ``<name>_words`` and ``<name>_ids``: words
    between white space, and ids of the tokenizer file. Null texts have none of either."""
    others = [c for c in docs.columns if c not in texts]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    schema += "".join(f", {t}_words long, {t}_ids long" for t in texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level(tokenizer_path, added_tokens=True)
        for batch in batches:
            columns = [batch.column(c) for c in others]
            for text in texts:
                data, offsets = blocks.text_bytes(batch.column(text))
                words = [blocks.words(data, offsets[a : b + 1]).counts() for a, b in blocks.document_runs(offsets)]
                ids = [np.diff(bounds) for _, _, bounds in encoder.encode(batch.column(text))]
                for parts in (words, ids):
                    columns.append(pa.array(np.concatenate(parts) if parts else [], pa.int64()))
            names = [*others, *[f"{t}_{kind}" for t in texts for kind in ("words", "ids")]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*others, *texts).mapInArrow(run, schema)


def corpus_history(docs: DataFrame, rollup: TokenRollup, tokenizer_path: str, versions=("words-1", "byte_bpe_50k")) -> DataFrame:
    """Totals after the history of a corpus: all documents come in, copies go, white space is evened out.

    ``load`` inserts every row. ``copies`` deletes, of equal texts, all but the row with the smallest id.
    ``spaces`` revises the rows that stay to texts with single spaces. Then ``copies`` arrives a second
    time, which changes nothing. Null texts count as empty, texts of any length are counted whole, null
    languages and sources are groups of their own, and of rows that share text and id one stays. Other
    columns are not read. An empty table leaves the totals as they are.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    even = F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(" "))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"),
        F.unhex(F.sha2(text, 256)).alias("digest"), F.monotonically_increasing_id().alias("row"), text.alias("old"), even.alias("new"),
    )
    counts = stored_table(counted(rows, tokenizer_path, ("old", "new")), "token-counts")
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    first = stored_table(counts.groupBy("digest").agg(F.min(place).alias("first")).select("digest", F.col("first.row").alias("first_row")), "first-rows")
    counts = counts.join(first, "digest").withColumn("stays", F.col("row") == F.col("first_row"))
    kinds = F.array(*[
        F.struct(F.lit(version).alias("tokenizer"), F.col(f"old_{kind}").alias("tokens"), F.col(f"new_{kind}").alias("new_tokens"))
        for version, kind in zip(versions, ("words", "ids"), strict=True)
    ])
    each = counts.select("source", "lang", "stays", F.inline(kinds))
    rollup.commit("load", inserts(each))
    rollup.commit("copies", deletes(each.filter("NOT stays")))
    rollup.commit("spaces", revisions(each.filter("stays AND tokens <> new_tokens")))
    rollup.commit("copies", deletes(each.filter("NOT stays")))
    return rollup.totals()
