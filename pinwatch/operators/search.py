"""Text chunks and similarity search on stored vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pinwatch import constants as K


def chunk_documents(documents: DataFrame, size: int = K.CHUNK_TOKENS, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """Whole texts cut into overlapping runs of white-space tokens, numbered per document."""
    tokens = F.filter(F.split("text", r"[ \t\r\n]+"), lambda t: t != "")
    step = size - overlap
    counted = documents.select("doc_id", tokens.alias("tokens")).withColumn("n", F.size("tokens")).filter("n > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - overlap - 1, F.lit(0)), F.lit(step))
    cut = counted.select("doc_id", "tokens", F.explode(starts).alias("start"))
    piece = F.slice("tokens", F.col("start") + 1, F.lit(size))
    return cut.select(
        "doc_id",
        F.floor(F.col("start") / step).cast("bigint").alias("chunk_no"),
        F.size(piece).cast("bigint").alias("tokens"),
        F.array_join(piece, " ").alias("chunk"),
    )


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm).otherwise(F.lit(0.0))


def mean_vector(vectors: DataFrame, collection: str = "label") -> DataFrame:
    """Mean vector per collection, summed per position so that no task gathers a collection."""
    parts = vectors.select(collection, F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy(collection, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(collection).agg(F.transform(ordered, lambda e: e["x"]).alias("query"))


def search(vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The ``k`` stored vectors nearest to one query vector; only what is put out is rounded."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("vec_id", cosine(F.col("embedding"), literal).alias("similarity"))
    nearest = scored.orderBy(F.desc("similarity"), "vec_id").limit(k)
    return nearest.withColumn("similarity", F.round("similarity", 6))


def topk_per_collection(vectors: DataFrame, queries: DataFrame, k: int = 5, collection: str = "label") -> DataFrame:
    """For the query of each collection its ``k`` nearest members.

    The rank limit is applied on the map side first, so at most ``k`` rows per task and collection
    are shuffled, however large a collection is.
    """
    scored = vectors.join(queries, collection).select(
        collection, "vec_id", cosine(F.col("embedding"), F.col("query")).alias("similarity")
    )
    nearest = Window.partitionBy(collection).orderBy(F.desc("similarity"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.withColumn("similarity", F.round("similarity", 6))
