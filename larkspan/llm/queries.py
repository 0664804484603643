"""The pN_ queries, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import aqknn, bpe, langid, maincontent, mixing, neardup, sitelines, splitting, subjects
from larkspan.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aqknn.pairs(aqknn.nearest(table(spark, sf_dir, "chunk_vectors")))


def p1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aqknn.nearest(table(spark, sf_dir, "embeddings"), least=None)


def _near(spark: SparkSession, sf_dir: str):
    return neardup.similar_classes(table(spark, sf_dir, "indexed_docs"), k=3, threshold=0.7, min_words=30)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.pairs(*_near(spark, sf_dir))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(*_near(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.repeated_lines(table(spark, sf_dir, "indexed_docs"))


def _codes(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r["code"] for r in table(spark, sf_dir, "languages").select("code").collect()]  # a fixed table of a few codes


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(table(spark, sf_dir, "lang_samples"))
    return langid.wrong_labels(table(spark, sf_dir, "indexed_docs"), model, _codes(spark, sf_dir))


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(table(spark, sf_dir, "lang_samples"))
    return langid.identify(table(spark, sf_dir, "indexed_docs"), model).withColumn("confidence", F.round("confidence", 3))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maincontent.main_lines(table(spark, sf_dir, "indexed_docs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(table(spark, sf_dir, "chunk_meta"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), keep=["doc_id", "source"])


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = [r["subject"] for r in table(spark, sf_dir, "subjects").select("subject").orderBy("subject").collect()]  # a fixed table of eight
    lexicon = subjects.fit(docs, table(spark, sf_dir, "subject_labels"), names)
    return subjects.assign(docs, lexicon).select("doc_id", "subject").distinct()


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


P3_SQL = """
WITH r AS (
  SELECT rec_id, text,
    coalesce(nullif(regexp_replace(lower(trim(domain)), '^www\\.', ''), ''),
             nullif(regexp_replace(lower(regexp_extract(url, '(?i)^\\s*https?://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', ''), '')) AS src
  FROM indexed_docs WHERE text IS NOT NULL),
l AS (
  SELECT rec_id, src, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM r WHERE src IS NOT NULL),
n AS (
  SELECT rec_id, src, line_no,
    regexp_replace(lower(trim(regexp_replace(line, '[\\s\\p{Z}\\x{85}\\x{0B}]+', ' ', 'g'))), '[0-9]+', '#', 'g') AS line
  FROM l),
k AS (SELECT src, line FROM n WHERE line <> '' GROUP BY src, line HAVING count(DISTINCT rec_id) >= 8)
SELECT DISTINCT rec_id, line_no::INTEGER AS line_no FROM n JOIN k USING (src, line)
"""

P6_SQL = """
WITH c AS (SELECT DISTINCT chunk_key, chunk_text FROM chunk_meta WHERE length(chunk_text) > 1000),
s AS (
  SELECT chunk_key, unnest(regexp_split_to_array(regexp_replace(chunk_text, '([。！？])', '\\1 ', 'g'), '[\\s\\p{Z}\\x{85}\\x{0B}]+')) AS stretch
  FROM c)
SELECT chunk_key, CASE WHEN max(length(stretch)) > 1000 THEN 'hard' ELSE 'soft' END AS kind FROM s GROUP BY chunk_key
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL, "p6_found": P6_SQL}
