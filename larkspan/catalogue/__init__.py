"""The catalogue of queries: one entry for each operator, named by its inventory id, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: The moment that time filters and facets refer to, 2025-01-01T00:00:00Z.
NOW = 1_735_689_600

#: Fragments of the SQL side, by name; an entry's SQL is prefixed with those it mentions in ``uses``.
FRAGMENTS = {
    "corpus": """corpus AS (
  SELECT * EXCLUDE (n) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated DESC, ingested_at DESC, rec_id DESC) AS n
    FROM indexed_docs WHERE id IS NOT NULL) WHERE n = 1)""",
    "tok": """tok AS (
  SELECT *, regexp_extract_all(lower(coalesce(title, '')), '[\\p{L}\\p{N}]+') AS title_w,
    regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS text_w FROM corpus)""",
    "pad": """pad AS (
  SELECT *, ' ' || array_to_string(title_w, ' ') || ' ' AS title_p, ' ' || array_to_string(text_w, ' ') || ' ' AS text_p FROM tok)""",
    "hist": """hist AS (
  SELECT * EXCLUDE (n) FROM (
    SELECT *, row_number() OVER (PARTITION BY hist_id ORDER BY updated_at DESC, ingested_at DESC) AS n FROM search_history) WHERE n = 1)""",
    "urls": """urls AS (
  SELECT * EXCLUDE (n) FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id, url ORDER BY updated_at DESC NULLS LAST, crawl_id DESC) AS n FROM crawl_urls) WHERE n = 1)""",
    "chunks": """chunks AS (SELECT DISTINCT chunk_key, doc_id, chunk_idx, user_id, chunk_text FROM chunk_meta)""",
    "vecs": """vecs AS (
  SELECT v.vec_id, v.chunk_key, v.user_id, v.embedding::DOUBLE[] AS e, coalesce(c.doc_id, v.chunk_key) AS doc_id,
    coalesce(c.chunk_idx, -1) AS chunk_idx, coalesce(c.chunk_text, '') AS chunk_text
  FROM chunk_vectors v LEFT JOIN chunks c USING (chunk_key)
  WHERE v.embedding IS NOT NULL AND len(v.embedding) = 64 AND NOT list_bool_or([isnan(x) FOR x IN v.embedding]) AND list_bool_or([x <> 0 FOR x IN v.embedding]))""",
    "sims": """sims AS (
  SELECT v.*, round(list_cosine_similarity(v.e, q.e), 6) AS similarity
  FROM vecs v, (SELECT e FROM vecs WHERE vec_id = 2) q)""",
}
NEEDS = {"tok": ["corpus"], "pad": ["corpus", "tok"], "vecs": ["chunks"], "sims": ["chunks", "vecs"]}


def with_fragments(sql: str, uses: str) -> str:
    names = dict.fromkeys(n for u in uses.split() for n in [*NEEDS.get(u, []), u])
    if not names:
        return sql
    head = ",\n".join(FRAGMENTS[n] for n in names)
    return f"WITH {head}\n{sql}" if not sql.lstrip().startswith(",") else f"WITH {head}{sql.lstrip()}"


def entry(name: str, sql: str | None = None, uses: str = ""):
    def put(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_fragments(sql, uses)
        return f

    return put


def load() -> None:
    from larkspan.catalogue import history, ingest, scalars, searching, semantic  # noqa: F401
