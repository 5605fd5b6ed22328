"""Exact duplicates against a persistent digest index, with DataFrame operations alone.

The index is a table with one row per distinct text, bucketed and sorted by digest. A batch of
documents is reduced to digests, pre-aggregated to one row per digest, and sort-merge anti-joined
with the index; what is new is appended. Bucketed by the join key, the index is never shuffled, and
both sides of the anti-join hold a digest once, so no digest can crowd a task. The assignment of
documents to the row that stays joins two stored tables that adaptive execution may split.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pinwatch.llm.names import plain, spare
from pinwatch.session import scratch_path, stored_table

INDEX_COLUMNS = "digest BINARY, keep_id BIGINT, batch STRING"


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text as hexadecimal digits; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class DigestIndex:
    """The bucketed table at ``path``; an existing one is opened with its contents."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({INDEX_COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Rows of ``groups`` whose digest the index lacks, by sort-merge anti-join on its buckets."""
        return groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, fresh: DataFrame, batch: str) -> None:
        rows = fresh.select("digest", "keep_id", F.lit(batch).alias("batch"))
        rows.repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def add_batch(self, docs: DataFrame, batch: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """Take in ``docs``; returns per row its id, the row that stays, and whether it is this one.

        Of equal texts in a batch the row with the largest id stays, of rows that also share the id one
        of them; a text that an earlier batch brought keeps that row. A batch may be repeated: its own
        rows in the index count as its own, so the second run appends nothing and says the same.
        Null texts count as empty, null ids lose against any other, texts of any length are digested whole.
        Other columns are not read; an empty batch gives no rows and appends none.
        """
        digests = stored_table(
            docs.select(
                docs[id_column].cast("long").alias("doc_id"), text_digest(docs[text_column]).alias("text_sha256")
            ).select(
                "doc_id", F.unhex("text_sha256").alias("digest"),
                F.monotonically_increasing_id().alias("row_mark"),
            ),
            "digests",
        )
        best = F.max(F.struct("doc_id", "row_mark"))
        groups = stored_table(
            digests.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size")).select(
                "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row_mark").alias("keep_row"), "group_size"
            ),
            "digest-groups",
        )
        self.append(self.unseen(groups), batch)
        kept = groups.join(
            self.rows().select("digest", F.col("keep_id").alias("index_id"), F.col("batch").alias("from_batch")).hint("merge"),
            "digest",
        )
        own = F.col("from_batch") == batch
        kept = stored_table(
            kept.select("digest", F.col("index_id").alias("keep_id"), F.when(own, F.col("keep_row")).alias("keep_row"), "group_size"),
            "digest-kept",
        )
        return digests.join(kept, "digest").select(
            "doc_id", "keep_id", "group_size",
            F.coalesce(F.col("row_mark") == F.col("keep_row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_duplicates(docs: DataFrame, buckets: int = 32) -> DataFrame:
    """``add_batch`` on an index of its own."""
    spark = docs.sparkSession
    return DigestIndex(spark, scratch_path(spark, "digest-index"), buckets).add_batch(docs, "first")


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", buckets: int = 32) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows are matched by digest and id, so copies of one text are spread by their ids before they are
    dropped; of rows that agree in both, one stays.
    """
    spark = docs.sparkSession
    index = DigestIndex(spark, scratch_path(spark, "digest-index"), buckets)
    own = [spare(name, docs.columns) for name in ("digest", "id", "no_id")]
    keys = lambda digest, number: [
        F.unhex(digest).alias(own[0]), F.coalesce(number, F.lit(0)).alias(own[1]), number.isNull().alias(own[2])
    ]
    stays = index.add_batch(docs, "first", id_column, text_column).filter("kept")
    stays = stays.select(*keys(F.col("text_sha256"), F.col("doc_id")))
    marked = docs.select("*", *keys(text_digest(docs[text_column]), docs[id_column].cast("long")))
    return marked.join(stays, own, "left_semi").dropDuplicates(own).select(*plain(docs))
