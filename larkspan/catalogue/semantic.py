"""Vectors: stored chunks, nearest vectors, merging, diversification, scalar functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from larkspan.catalogue import entry
from larkspan.functions import vectors as V
from larkspan.operators import semantic
from larkspan.runtime import table


def vectors(spark, d):
    """Usable stored vectors."""
    return table(spark, d, "chunk_vectors").filter((F.size("embedding") == 64) & ~F.exists("embedding", lambda x: F.isnan(x)) & F.exists("embedding", lambda x: x != 0))


def chunks(spark, d):
    return table(spark, d, "chunk_meta")


def query_vector(spark, d, vec_id: int = 2) -> list[float]:
    row = table(spark, d, "chunk_vectors").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row["embedding"])


def knn(spark, d, k=50, user=0, threshold=0.1):
    """The top k comes before the chunks: only its rows are joined."""
    return semantic.hits_with_chunks(semantic.knn(vectors(spark, d), query_vector(spark, d), k, user, threshold), chunks(spark, d))


def best(spark, d):
    return semantic.best_chunks(knn(spark, d)).select("doc_id", "similarity")


@entry("j05_vectors_with_chunks", "SELECT vec_id, user_id, doc_id, chunk_idx, chunk_text FROM vecs", "vecs")
def j05(spark, d):
    return semantic.with_chunks(vectors(spark, d).drop("embedding"), chunks(spark, d)).select("vec_id", "user_id", "doc_id", "chunk_idx", "chunk_text")


@entry("t17_knn_own_and_global", "SELECT vec_id, similarity FROM sims WHERE user_id IN (1, 0) AND similarity >= 0.1 ORDER BY similarity DESC, vec_id LIMIT 50", "sims")
def t17(spark, d):
    return knn(spark, d, user=1).select("vec_id", "similarity")


@entry("t18_semantic_defaults", "SELECT vec_id, similarity FROM sims WHERE user_id = 0 AND similarity >= 0.1 ORDER BY similarity DESC, vec_id LIMIT 50", "sims")
def t18(spark, d):
    return knn(spark, d).select("vec_id", "similarity")


@entry("t20_global_only", "SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT * FROM sims WHERE user_id = 0 AND similarity >= 0.3)", "sims")
def t20(spark, d):
    return knn(spark, d, 4096, 0, 0.3).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@entry("o12_top_k", "SELECT vec_id, similarity FROM sims WHERE user_id IN (1, 0) AND similarity >= -1 ORDER BY similarity DESC, vec_id LIMIT 200", "sims")
def o12(spark, d):
    return knn(spark, d, 200, 1, -1.0).select("vec_id", "similarity")


@entry("o13_k_limits")
def o13(spark, d):
    verdicts = []
    for k in (0, 1, 4096, 4097):
        try:
            semantic.knn(vectors(spark, d), [0.0] * 64, k)
            verdicts.append((k, "ok"))
        except ValueError as e:
            verdicts.append((k, str(e)))
    return spark.createDataFrame(verdicts, "k int, verdict string")


@entry("a13_best_chunk", "SELECT doc_id, max(similarity) AS similarity, count(*) AS chunks FROM (SELECT * FROM sims WHERE user_id = 0 AND similarity >= 0.1 ORDER BY similarity DESC, vec_id LIMIT 50) GROUP BY doc_id", "sims")
def a13(spark, d):
    return semantic.best_chunks(knn(spark, d)).select("doc_id", "similarity", "chunks")


MERGED = """SELECT doc_id, chunk_idx, max(similarity) AS similarity FROM (
  (SELECT * FROM sims WHERE user_id = 1 AND similarity >= 0.1 ORDER BY similarity DESC, vec_id LIMIT 50) UNION ALL
  (SELECT * FROM sims WHERE user_id = 0 AND similarity >= 0.1 ORDER BY similarity DESC, vec_id LIMIT 50))
GROUP BY doc_id, chunk_idx ORDER BY similarity DESC, doc_id, chunk_idx LIMIT 50"""


def _merged(spark, d):
    v, q = vectors(spark, d), query_vector(spark, d)
    own = semantic.knn(v.filter("user_id = 1").withColumn("user_id", F.lit(0).cast("long")), q, 50)
    groups = [semantic.hits_with_chunks(g, chunks(spark, d)) for g in (own, semantic.knn(v, q, 50))]
    return semantic.merge_groups(groups, 50).select("doc_id", "chunk_idx", "similarity")


entry("a14_merge_groups", MERGED, "sims")(_merged)
entry("u02_own_and_global", MERGED, "sims")(_merged)

DIVERSE = """, pool AS (SELECT * FROM sims WHERE similarity >= 0.1 AND user_id IN (1, 0) ORDER BY similarity DESC, vec_id LIMIT 400),
p AS (SELECT * FROM pool ORDER BY similarity DESC, doc_id, chunk_idx LIMIT 80),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, chunk_idx) AS n FROM p),
docs AS (SELECT doc_id FROM r WHERE n = 1 ORDER BY similarity DESC, doc_id LIMIT 20)
SELECT doc_id, chunk_idx, similarity FROM r WHERE n <= 2 AND doc_id IN (SELECT doc_id FROM docs)"""


@entry("n01_diversify", DIVERSE, "sims")
def n01(spark, d):
    return semantic.diversify(knn(spark, d, 400, 1), 20).select("doc_id", "chunk_idx", "similarity")


@entry("f35_owner_partition", "SELECT user_id, count(*) AS n FROM chunk_vectors WHERE user_id >= 1 AND user_id < 10 AND user_id != 5 GROUP BY 1")
def f35(spark, d):
    return table(spark, d, "chunk_vectors").filter("user_id >= 1 and user_id < 10 and user_id != 5").groupBy("user_id").agg(F.count("*").alias("n"))


@entry("f36_metadata_constraints", "SELECT vec_id, similarity FROM sims WHERE user_id = 0 AND chunk_idx IN (1, 2, 3) AND length(chunk_text) > 200 AND similarity >= 0.1 ORDER BY similarity DESC, vec_id LIMIT 20", "sims")
def f36(spark, d):
    keys = chunks(spark, d).filter(F.col("chunk_idx").isin(1, 2, 3) & (F.length("chunk_text") > 200)).select("chunk_key")
    return semantic.knn(vectors(spark, d).join(keys, "chunk_key", "left_semi"), query_vector(spark, d), 20).select("vec_id", "similarity")


@entry("f37_allowed_ids", "SELECT vec_id, similarity FROM sims WHERE user_id = 0 AND similarity >= 0.1 AND doc_id IN (SELECT id FROM corpus WHERE type = 0) ORDER BY similarity DESC, vec_id LIMIT 20", "sims corpus")
def f37(spark, d):
    from larkspan.catalogue.searching import corpus

    allowed = corpus(spark, d).filter("type = 0").select(F.col("id").alias("doc_id"))
    keys = chunks(spark, d).select("chunk_key", "doc_id").join(allowed, "doc_id", "left_semi").select("chunk_key")
    return semantic.knn(vectors(spark, d).join(keys, "chunk_key", "left_semi"), query_vector(spark, d), 20).select("vec_id", "similarity")


@entry("s22_vector_point", "SELECT vec_id, chunk_key FROM chunk_vectors WHERE vec_id = 2")
def s22(spark, d):
    return table(spark, d, "chunk_vectors").filter("vec_id = 2").select("vec_id", "chunk_key")


@entry("s23_vector_elements", "SELECT vec_id, (unnest(range(len(embedding))))::INTEGER AS pos, unnest(embedding) AS value FROM embeddings")
def s23(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.elements(F.col("embedding")))


# ---------------------------------------------------------------- scalar functions, against the vector 0

PAIRED = "FROM (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings) x, (SELECT embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id = 0) y"


def scalar(name: str, f, sql: str):
    def run(spark, d):
        e = table(spark, d, "embeddings")
        q = F.lit([float(x) for x in e.filter("vec_id = 0").first()["embedding"]])
        return e.select("vec_id", f(F.col("embedding"), q).alias("value"))

    entry(name, sql)(run)


R = lambda c: F.round(c, 6)
scalar("v01_distance_cosine", lambda a, b: R(V.cosine_distance(a, b)), f"SELECT vec_id, round(1 - list_cosine_similarity(a, b), 6) AS value {PAIRED}")
scalar("v02_distance_l2", lambda a, b: R(V.l2_distance(a, b)), f"SELECT vec_id, round(list_distance(a, b), 6) AS value {PAIRED}")
scalar("v03_distance_l1", lambda a, b: R(V.l1_distance(a, b)), f"SELECT vec_id, round(list_sum([abs(a[i] - b[i]) FOR i IN range(1, 65)]), 6) AS value {PAIRED}")
scalar("v04_distance_hamming", lambda a, b: V.hamming_distance(V.quantize_binary(a), V.quantize_binary(b)), f"SELECT vec_id, list_sum([CASE WHEN (a[i] > 0) <> (b[i] > 0) THEN 1 ELSE 0 END FOR i IN range(1, 65)])::INTEGER AS value {PAIRED}")
scalar("v05_length", lambda a, b: V.dimension(a), "SELECT vec_id, len(embedding)::INTEGER AS value FROM embeddings")
scalar("v06_type", lambda a, b: V.element_type(a), "SELECT vec_id, 'float32' AS value FROM embeddings")
scalar("v07_text_round_trip", lambda a, b: R(F.aggregate(V.from_text(V.to_text(a)), F.lit(0.0), lambda s, x: s + x)), "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS value FROM embeddings")
scalar("v08_add", lambda a, b: V.rounded(V.add(a.cast("array<double>"), b)), f"SELECT vec_id, [round(a[i] + b[i], 6) FOR i IN range(1, 65)] AS value {PAIRED}")
scalar("v08_subtract", lambda a, b: V.rounded(V.subtract(a.cast("array<double>"), b)), f"SELECT vec_id, [round(a[i] - b[i], 6) FOR i IN range(1, 65)] AS value {PAIRED}")
scalar("v09_slice", lambda a, b: V.part(a, 8, 16), "SELECT vec_id, embedding[9:16] AS value FROM embeddings")
scalar("v10_normalize", lambda a, b: V.rounded(V.normalize(a)), f"SELECT vec_id, [round(x / sqrt(list_dot_product(a, a)), 6) FOR x IN a] AS value {PAIRED}")
scalar("v11_quantize_binary", lambda a, b: V.quantize_binary(a), f"SELECT vec_id, [list_sum([CASE WHEN a[i * 8 + j + 1] > 0 THEN (1 << j) ELSE 0 END FOR j IN range(8)])::SMALLINT FOR i IN range(8)] AS value {PAIRED}")
scalar("v12_quantize_int8", lambda a, b: V.quantize_int8(a), f"SELECT vec_id, [trunc((x + 1) / (2.0 / 255)::DOUBLE - 128)::TINYINT FOR x IN a] AS value {PAIRED}")
scalar("v13_from_text", lambda a, b: V.dimension(V.from_text(V.to_text(a))), "SELECT vec_id, len(embedding)::INTEGER AS value FROM embeddings")


@entry("w19_delete_vectors", "SELECT count(*) AS n FROM chunk_vectors WHERE NOT (user_id = 1)")
def w19(spark, d):
    return table(spark, d, "chunk_vectors").filter("not (user_id = 1)").agg(F.count("*").alias("n"))


@entry("t15_hash_embedding")
def t15(spark, d):
    from larkspan.operators.chunking import tokens

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([semantic.hash_embedding(tokens(x or "")) for x in s], dtype=object)

    return table(spark, d, "documents").select("doc_id", run("text").alias("embedding")).select("doc_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))
