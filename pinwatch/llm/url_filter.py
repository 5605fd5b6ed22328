"""URL rules and listed URLs: a blocked Bloom filter in front of an exact hash join.

A rule is a host with a path start; a listed URL is a canonical URL. Both are keys of one list. Every
distinct URL yields the keys that could be listed for it: its own canonical form, and every suffix of
its host joined with every start of its path that has the length of some rule's path. The filter
passes nearly only listed keys; these alone are joined with the list, by value, which removes the
filter's false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pinwatch.llm.bloom import build_bloom
from pinwatch.session import stored_table

#: Rules of the query, as stated: verdict and host with path start.
STATED_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without ``.html`` and slashes at its end; scheme, query and fragment
    dropped. Null where the URL has no host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/+$", ""), r"\.html$", "")
    return F.when(host != "", F.concat(host, path))


def rule_table(spark, rules=STATED_RULES) -> DataFrame:
    """``verdict, rule``: a rule is a host followed by the start of a path."""
    return spark.createDataFrame(list(rules), "verdict string, rule string")


def _candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every rule that could fit: suffixes of the host at its dots, with starts of the path."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    starts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))
    return F.when(host != "", F.transform(keys, lambda k: F.concat(F.lit("rule "), k))).otherwise(F.array().cast("array<string>"))


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``page_id, host, path, rule, listed, verdict`` for every row of ``pages``.

    ``rules``: ``verdict, rule``; a rule fits its host and all subdomains if the path starts with its
    path. The longest fitting rule decides, the longer host first; of equal rules with different
    verdicts ``block``. Where none fits, a URL whose canonical form is in ``listed`` (column
    ``canonical``, any number of rows) is blocked and any other allowed. Null URLs and URLs without a
    host fit nothing and are allowed; rules without a slash, and nulls in either list, fit nothing.
    Repeated rows are judged alike, URLs of any length whole; other columns are not read. An empty table
    gives no rows, and without rules or list every URL is allowed.
    """
    known = rules.filter("rule IS NOT NULL AND instr(rule, '/') > 0").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    known = known.withColumn("rule_path", F.expr("substr(rule, instr(rule, '/'))"))
    lengths = sorted(r[0] for r in known.select(F.length("rule_path")).distinct().collect())
    entries = known.select(F.concat(F.lit("rule "), "rule").alias("key"), "rule", "verdict").unionByName(
        listed.filter("canonical IS NOT NULL").select(F.concat(F.lit("url "), "canonical").alias("key")).distinct()
        .select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"))
    )
    entries = stored_table(entries, "url-entries")
    spark = pages.sparkSession
    bloom = spark.sparkContext.broadcast(build_bloom(entries.select(F.xxhash64("key").alias("hash"))))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = batch.column(1), batch.column(2)
            owners = np.asarray(pc.list_parent_indices(keys))
            hit = np.flatnonzero(bloom.value.may_hold(np.asarray(hashes.flatten())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owners[hit])), keys.flatten().take(pa.array(hit))], names=["url", "key"]
            )

    url = pages[url_column].cast("string")
    urls = pages.select(url.alias("url")).filter("url IS NOT NULL").distinct()
    keyed = urls.select(
        "url",
        F.concat(
            _candidates(host_of(F.col("url")), path_of(F.col("url")), lengths),
            F.array_compact(F.array(F.concat(F.lit("url "), canonical(F.col("url"))))),
        ).alias("keys"),
    ).select("url", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("hashes"))
    hits = keyed.mapInArrow(possible, "url string, key string").join(entries, "key")
    rank = F.when(F.col("rule").isNotNull(), F.struct(F.expr("instr(rule, '/')").alias("host"), F.length("rule").alias("all"), "rule", "verdict"))
    judged = hits.groupBy("url").agg(F.max(rank).alias("best"), F.max(F.col("rule").isNull()).alias("listed"))
    judged = stored_table(judged.select("url", "best.rule", F.col("best.verdict").alias("ruled"), "listed"), "url-verdicts")
    rows = pages.select(pages[id_column].cast("long").alias("page_id"), url.alias("url")).join(judged, "url", "left")
    on_list = F.coalesce("listed", F.lit(False))
    return rows.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", on_list.alias("listed"),
        F.coalesce("ruled", F.when(on_list, "block").otherwise("allow")).alias("verdict"),
    )


def pages_of_toxic_documents(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The list of the query: canonical URLs of pages whose document, the number that ends their
    path, carries a toxic label."""
    number = F.regexp_extract(canonical(F.col("url")), r"/([0-9]{1,18})$", 1)
    named = pages.select(canonical(F.col("url")).alias("canonical"), F.when(number != "", number).cast("long").alias("doc_id"))
    toxic = labels.filter("toxic = 1").select(F.col("doc_id").cast("long"))
    return named.join(toxic, "doc_id", "left_semi").select("canonical")
