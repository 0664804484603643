"""Vector search over stored vectors, its merge with keyword hits, and result unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.vectors import cosine_similarity
from larkspan.runtime import checkpoint

THRESHOLD, LIMIT, ALPHA = 0.1, 50, 0.4
POOL, PER_DOCUMENT, MOST = 4, 2, 4096


def with_chunks(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors with the text and place of their chunk; a vector without one keeps an empty text and place -1."""
    meta = chunks.select("chunk_key", "doc_id", "chunk_idx", "chunk_text").dropDuplicates(["chunk_key"])
    return vectors.join(meta, "chunk_key", "left").select(*vectors.columns, F.coalesce("doc_id", "chunk_key").alias("doc_id"), F.coalesce("chunk_idx", F.lit(-1)).alias("chunk_idx"), F.coalesce("chunk_text", F.lit("")).alias("chunk_text"))


def hits_with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same for the few hits of a search (at most MOST): their chunks are picked by a broadcast of the hits' keys, so
    neither table is shuffled."""
    hits = checkpoint(hits.drop("embedding"))
    meta = chunks.join(F.broadcast(hits.select("chunk_key")), "chunk_key", "left_semi")
    return with_chunks(hits, meta)


def knn(vectors: DataFrame, query: list[float], k: int, user_id: int = 0, threshold: float = THRESHOLD, key: str = "vec_id", metric: str = "cosine") -> DataFrame:
    """The ``k`` most similar vectors of the user and of everyone (user 0), at least ``threshold`` similar.

    The owner filter and the threshold come before the top-k, which is partial in each partition.
    """
    if not 0 < k <= MOST:
        raise ValueError(f"k must be between 1 and {MOST}")
    if metric != "cosine":
        raise ValueError("metric must be cosine")
    q = F.lit([float(x) for x in query])
    owner: Column = F.col("user_id") == 0 if user_id == 0 else F.col("user_id").isin(user_id, 0)
    hits = vectors.filter(owner).withColumn("similarity", F.round(cosine_similarity(F.col("embedding"), q), 6)).filter((F.col("similarity") >= threshold) & ~F.isnan("similarity"))
    return hits.orderBy(F.desc("similarity"), key).limit(k)


def best_chunks(hits: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Of each document the highest similarity and the text of that chunk (the earlier chunk on a tie)."""
    return hits.groupBy(doc).agg(F.max("similarity").alias("similarity"), F.min_by("chunk_text", F.struct(-F.col("similarity"), F.col("chunk_idx"))).alias("chunk_text"), F.count("*").alias("chunks"))


def merge_groups(groups: list[DataFrame], k: int) -> DataFrame:
    """Results of several owners' groups: the best of each (document, chunk), then the top k."""
    every = groups[0]
    for g in groups[1:]:
        every = every.unionByName(g)
    best = every.groupBy("doc_id", "chunk_idx").agg(F.max("similarity").alias("similarity"), F.max_by("chunk_text", "similarity").alias("chunk_text"))
    return best.orderBy(F.desc("similarity"), "doc_id", "chunk_idx").limit(k)


def diversify(hits: DataFrame, documents: int, per_document: int = PER_DOCUMENT) -> DataFrame:
    """At most ``per_document`` chunks each of the ``documents`` most similar documents, from a pool that the caller
    limits to POOL times that many rows (so the windows see a bounded input)."""
    pool = hits.orderBy(F.desc("similarity"), "doc_id", "chunk_idx").limit(POOL * documents)
    within = Window.partitionBy("doc_id").orderBy(F.desc("similarity"), "chunk_idx")
    ranked = pool.withColumn("n", F.row_number().over(within))
    docs = ranked.filter("n = 1").orderBy(F.desc("similarity"), "doc_id").limit(documents).select("doc_id")
    return ranked.filter(F.col("n") <= per_document).join(F.broadcast(docs), "doc_id", "left_semi").drop("n")


def hybrid(keyword: DataFrame, semantic: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Full outer merge on the id: ``(1 - alpha) * score / max(best score, 1) + alpha * similarity``, with its origin."""
    keyword = checkpoint(keyword.select("id", "score"))  # narrow; scoring is not done twice
    top = keyword.agg(F.greatest(F.coalesce(F.max("score"), F.lit(0.0)), F.lit(1.0)).alias("top")).first()["top"]
    both = keyword.select("id", "score").join(semantic.select("id", "similarity"), "id", "full")
    value = (1 - alpha) * F.coalesce("score", F.lit(0.0)) / F.lit(float(top)) + alpha * F.coalesce("similarity", F.lit(0.0))
    origin = F.when(F.col("score").isNull(), "semantic").when(F.col("similarity").isNull(), "keyword").otherwise("both")
    return both.select("id", "score", "similarity", F.round(value, 6).alias("hybrid_score"), origin.alias("origin"))


def only_semantic(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    """Semantic hits flagged by whether the keyword hits already show them."""
    shown = keyword.select("id").distinct().withColumn("shown", F.lit(True))
    return semantic.join(shown, "id", "left").withColumn("semantic_only", F.col("shown").isNull()).drop("shown")


def ordered_union(sources: list[DataFrame], key: str = "url") -> DataFrame:
    """Rows of several sources in their order, each key from the first source that has it. Sources have ``key``, ``rank``."""
    every = sources[0].withColumn("source_no", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        every = every.unionByName(s.withColumn("source_no", F.lit(i)))
    w = Window.partitionBy(key).orderBy("source_no", "rank")
    return every.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def hash_embedding(tokens: list[str], dimensions: int = 64) -> list[float]:
    """A deterministic embedding without a model: signed hashed counts, unit length."""
    import hashlib
    import math

    v = [0.0] * dimensions
    for t in tokens:
        h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
        v[h % dimensions] += 1.0 if h >> 63 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v
