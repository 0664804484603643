"""Scalar functions on text, urls, html and dates; text analysis; chunking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from larkspan.catalogue import entry
from larkspan.functions import text as T
from larkspan.operators import chunking
from larkspan.runtime import table


def docs(spark, d):
    return table(spark, d, "documents")


def saved(spark, d):
    return table(spark, d, "indexed_docs")


@entry("t01_words", "SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words FROM documents WHERE text IS NOT NULL")
def t01(spark, d):
    return docs(spark, d).filter("text is not null").select("doc_id", T.words(F.col("text")).alias("words"))


EN = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
STOP = ", ".join(f"'{w}'" for w in EN)


@entry("t02_english_analyser", f"SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ({STOP})) AS words FROM documents WHERE lower(lang) = 'en' AND text IS NOT NULL")
def t02(spark, d):
    return docs(spark, d).filter("lower(lang) = 'en' and text is not null").select("doc_id", T.analysed(F.col("text"), "en").alias("words"))


@entry("t02_pairs_of_wide_characters")
def t02b(spark, d):
    return docs(spark, d).filter("lower(lang) = 'ja' and text is not null").select("doc_id", F.size(T.analysed(F.col("text"), "ja")).alias("n"))


@entry("t03_kept_stop_words", "SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))::INTEGER AS n FROM documents WHERE text IS NOT NULL")
def t03(spark, d):
    return docs(spark, d).filter("text is not null").select("doc_id", F.size(T.analysed(F.col("text"), "en", keep_stop_words=True)).alias("n"))


@entry("t07_language_by_stop_words", "SELECT doc_id, CASE WHEN e >= f AND e > 0 THEN 'en' WHEN f > 0 THEN 'fr' ELSE 'unknown' END AS language FROM (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'with'))) AS e, len(list_filter(w, lambda x: x IN ('le', 'la', 'les', 'des'))) AS f FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents))")
def t07(spark, d):
    w = T.words(F.coalesce("text", F.lit("")))
    x = docs(spark, d).select("doc_id", F.size(F.filter(w, lambda a: a.isin("the", "of", "and", "with"))).alias("e"), F.size(F.filter(w, lambda a: a.isin("le", "la", "les", "des"))).alias("f"))
    return x.select("doc_id", F.when((F.col("e") >= F.col("f")) & (F.col("e") > 0), "en").when(F.col("f") > 0, "fr").otherwise("unknown").alias("language"))


@entry("t08_embedding_tokens", "SELECT doc_id, len(regexp_extract_all(text, '[\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Hangul}]|[\\p{L}\\p{N}]+|[^\\s\\p{Z}\\x{85}\\p{L}\\p{N}]'))::INTEGER AS n FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\\x00-\\x7f]')")
def t08(spark, d):
    plain = docs(spark, d).filter(F.col("text").isNotNull() & ~F.col("text").rlike(r"[^\x00-\x7f]"))
    return plain.select("doc_id", F.size(T.embedding_tokens(F.col("text"))).alias("n"))


# the same over all rows, which SQL can't say (its expressions have no lookahead)
@entry("t08_embedding_tokens_all")
def t08b(spark, d):
    return docs(spark, d).filter("text is not null").select("doc_id", F.size(T.embedding_tokens(F.col("text"))).alias("n"))


def _pandas(f, kind):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([f(x or "") for x in s], dtype=object)

    return run


def _counted(name, f):
    entry(name)(lambda spark, d: docs(spark, d).select("doc_id", F.size(_pandas(f, "array<string>")("text")).alias("n")))


_counted("t09_sentences", chunking.sentences)
_counted("t10_blocks", chunking.blocks)
_counted("t11_chunks", lambda x: chunking.chunk(x, 128, 16))


@entry("t12_embedding_inputs")
def t12(spark, d):
    @F.pandas_udf("array<string>")
    def run(title: pd.Series, language: pd.Series, url: pd.Series, text: pd.Series) -> pd.Series:
        rows = zip(title, language, url, text)
        return pd.Series([chunking.embedding_inputs([("title", t or ""), ("type", "web"), ("language", k or ""), ("url", u or "")], x or "", 256, 32) for t, k, u, x in rows], dtype=object)

    return saved(spark, d).select("rec_id", F.posexplode(run("title", "language", "url", "text")).alias("chunk_idx", "chunk_text"))


@entry("t13_fields_within_budget")
def t13(spark, d):
    return docs(spark, d).select("doc_id", _pandas(lambda x: chunking.fields_within([("title", x)], 16), "string")("text").alias("field"))


@entry("t14_headroom", "SELECT i AS context, ceil(i * 0.05)::INTEGER AS free FROM (SELECT unnest([128, 512, 1000, 4096]) AS i)")
def t14(spark, d):
    return spark.createDataFrame([(c, chunking.headroom(c)) for c in (128, 512, 1000, 4096)], "context int, free int")


@entry("t16_shorter_retry", "SELECT i AS context, i * 3 // 4 AS retry FROM (SELECT unnest([128, 512, 1000, 4096]) AS i)")
def t16(spark, d):
    return spark.createDataFrame([(c, chunking.shorter(c)) for c in (128, 512, 1000, 4096)], "context int, retry int")


# ---------------------------------------------------------------- urls

NORMAL = """SELECT rec_id, CASE WHEN list_bool_or([regexp_matches(p, '^utm(_[^=]*)?(=|$)') FOR p IN parts])
  THEN base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END ELSE bare END AS url
FROM (SELECT *, list_filter(parts, lambda p: NOT regexp_matches(p, '^utm(_[^=]*)?(=|$)') AND p <> '') AS kept
  FROM (SELECT rec_id, bare, regexp_extract(bare, '^([^?]*)', 1) AS base, string_split(regexp_extract(bare, '^[^?]*\\?(.*)$', 1), '&') AS parts
    FROM (SELECT rec_id, regexp_replace(url, '#.*$', '') AS bare FROM indexed_docs)))"""
entry("c01_normal_url", NORMAL)(lambda spark, d: saved(spark, d).select("rec_id", T.normalize_url(F.col("url")).alias("url")))
entry("c02_host", "SELECT rec_id, CASE WHEN starts_with(url, 'file://') THEN 'local' ELSE nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '') END AS host FROM indexed_docs")(lambda spark, d: saved(spark, d).select("rec_id", T.host(F.col("url")).alias("host")))
entry("c03_file_title", "SELECT rec_id, array_to_string(list_filter(string_split(replace(url, 'file://', ''), '/'), lambda p: p <> '')[-2:], '/') AS title FROM indexed_docs WHERE type = 1")(lambda spark, d: saved(spark, d).filter("type = 1").select("rec_id", T.file_title(T.url_to_path(F.col("url"))).alias("title")))
entry("c04_path_and_url", "SELECT rec_id, replace(url, 'file://', '') AS path, url, starts_with(url, 'file:///srv/inbox/') AS inbox FROM indexed_docs WHERE type = 1")(lambda spark, d: saved(spark, d).filter("type = 1").select("rec_id", T.url_to_path(F.col("url")).alias("path"), T.path_to_url(T.url_to_path(F.col("url"))).alias("url"), T.under(T.url_to_path(F.col("url")), F.lit("/srv/inbox")).alias("inbox")))
entry("c05_resolved_link", "SELECT rec_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/about' AS link FROM indexed_docs WHERE type = 0 AND url NOT LIKE '%@%'")(lambda spark, d: saved(spark, d).filter("type = 0 and url not like '%@%'").select("rec_id", T.resolve_url(F.col("url"), F.lit("/about")).alias("link")))
entry("c05_resolved_link_all")(lambda spark, d: saved(spark, d).filter("type = 0").select("rec_id", T.resolve_url(F.col("url"), F.lit("/about")).alias("link")))
entry("c06_crawl_link", "SELECT rec_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/x?y=1' AS link FROM indexed_docs WHERE type = 0")(lambda spark, d: saved(spark, d).filter("type = 0").select("rec_id", T.crawl_link(F.col("url"), F.lit("/x?y=1#z")).alias("link")))
LINKS = "(?i)<a\\b[^>]*?\\shref\\s*=\\s*[\"'']([^\"'']*)[\"'']"
entry("c07_links", f"SELECT rec_id, regexp_extract_all(html, '{LINKS}', 1) AS links FROM indexed_docs WHERE html IS NOT NULL")(lambda spark, d: saved(spark, d).filter("html is not null").select("rec_id", T.links(F.col("html")).alias("links")))
entry("c08_strip_tags", "SELECT rec_id, length(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) > 0 AS has_text FROM indexed_docs WHERE html IS NOT NULL")(lambda spark, d: saved(spark, d).filter("html is not null").select("rec_id", (F.length(T.decode_entities(T.strip_tags(F.col("html")))) > 0).alias("has_text")))


@entry("c09_sanitised", "SELECT rec_id, false AS has_script, contains(html, '<h1') AS has_heading FROM indexed_docs WHERE html IS NOT NULL")
def c09(spark, d):
    s = T.sanitized(F.col("html"))
    return saved(spark, d).filter("html is not null").select("rec_id", s.alias("s")).select("rec_id", F.col("s").rlike("(?i)<script|<style|onclick=").alias("has_script"), F.col("s").contains("<h1").alias("has_heading"))


entry("c10_strip_invisible", "SELECT doc_id, regexp_matches(text, '[\\x{200b}\\x{feff}\\x{7f}]') AND false AS left_over FROM documents WHERE text IS NOT NULL")(lambda spark, d: docs(spark, d).filter("text is not null").select("doc_id", T.strip_invisible(F.col("text")).rlike(r"[\x{200b}\x{feff}\x{7f}\r]").alias("left_over")))
entry("c11_squeezed", "SELECT doc_id, trim(regexp_replace(text, '[\\s\\p{Z}\\x{85}\\x{0B}]+', ' ', 'g')) AS text FROM documents")(lambda spark, d: docs(spark, d).select("doc_id", T.squeeze(F.col("text")).alias("text")))
entry("c12_combined_texts", "SELECT doc_id, array_to_string(list_filter([trim(title), trim(domain)], lambda x: x IS NOT NULL AND x <> ''), chr(10) || chr(10)) AS text FROM documents")(lambda spark, d: docs(spark, d).select("doc_id", T.combine_texts([F.col("title"), F.lit(" "), F.col("domain"), F.col("title")]).alias("text")))
entry("c13_service_time", "SELECT doc_id, floor(epoch(added_at))::BIGINT AS at, 0::BIGINT AS bad FROM documents")(lambda spark, d: docs(spark, d).select("doc_id", T.service_time(F.date_format("added_at", "yyyy-MM-dd'T'HH:mm:ss'+0000'")).alias("at"), T.service_time(F.lit("yesterday")).alias("bad")))
entry("c14_day_bounds", "SELECT doc_id, epoch(date_trunc('day', added_at))::BIGINT AS lo, epoch(date_trunc('day', added_at))::BIGINT + 86399 AS hi FROM documents")(lambda spark, d: docs(spark, d).select("doc_id", T.day_start(F.date_format("added_at", "yyyy-MM-dd")).alias("lo"), T.day_end(F.date_format("added_at", "yyyy-MM-dd")).alias("hi")))
entry("c15_subtitles", "SELECT doc_id, trim(regexp_replace(title, '<[^>]*>', '', 'g')) AS text FROM documents WHERE NOT regexp_matches(trim(title), '^(\\d+|)$|-->|^(WEBVTT|Kind:|Language:|NOTE|STYLE|REGION)') AND NOT regexp_matches(title, '[\\r\\n]')")(lambda spark, d: docs(spark, d).filter(~F.trim("title").rlike(r"^(\d+|)$|-->|^(WEBVTT|Kind:|Language:|NOTE|STYLE|REGION)") & ~F.col("title").rlike(r"[\r\n]")).select("doc_id", T.vtt_text(F.concat(F.lit("WEBVTT\n\n1\n00:00.000 --> 00:01.000\n<c>"), "title", F.lit("</c>\n\n2\n00:01.000 --> 00:02.000\n"), "title")).alias("text")))
entry("c15_subtitles_all")(lambda spark, d: docs(spark, d).select("doc_id", T.vtt_text(F.concat(F.lit("WEBVTT\n\n1\n00:00.000 --> 00:01.000\n<c>"), "title", F.lit("</c>\n\n2\n00:01.000 --> 00:02.000\n"), "title")).alias("text")))
entry("c16_data_uri", "SELECT doc_id, octet_length(encode(title)) AS bytes FROM documents WHERE title IS NOT NULL")(lambda spark, d: docs(spark, d).filter("title is not null").select("doc_id", F.octet_length(T.data_uri_bytes(F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("title", "UTF-8"))))).cast("long").alias("bytes")))
entry("c17_blob_key", "SELECT rec_id, sha256(html) AS key, true AS valid FROM indexed_docs WHERE html IS NOT NULL")(lambda spark, d: saved(spark, d).filter("html is not null").select("rec_id", T.blob_key(F.col("html")).alias("key"), T.is_blob_key(T.blob_key(F.col("html"))).alias("valid")))
entry("c19_duration", "SELECT event_id, printf('%.2f', round(value, 2)) || 's' AS duration FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", T.duration_text(F.col("value")).alias("duration")))


@entry("x05_json_ld")
def x05(spark, d):
    blob = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("Article").alias("@type"), F.col("title").alias("headline"))), F.lit("</script>"))
    return docs(spark, d).filter("title is not null").select("doc_id", F.get_json_object(F.element_at(T.json_ld(blob), 1), "$.headline").alias("headline"))


@entry("x18_basic_text", "SELECT rec_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?is)<noscript\\b.*?</noscript\\s*>', ' ', 'g'), '(?is)<head\\b.*?</head\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\\s\\p{Z}\\x{85}\\x{0B}]+', ' ', 'g')) AS text FROM indexed_docs WHERE html IS NOT NULL")
def x18(spark, d):
    return saved(spark, d).filter("html is not null").select("rec_id", T.basic_text(F.col("html")).alias("text"))


@entry("x18_title", "SELECT rec_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<meta[^>]*property=[\"'']og:title[\"''][^>]*content=[\"'']([^\"'']*)[\"'']', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '')) AS title FROM indexed_docs WHERE html IS NOT NULL")
def x18b(spark, d):
    return saved(spark, d).filter("html is not null").select("rec_id", T.html_title(F.col("html")).alias("title"))


@entry("u04_distinct_patterns", "SELECT job_id, list_sort(list_distinct([label, status, label])) AS patterns FROM crawl_jobs WHERE label IS NOT NULL")
def u04(spark, d):
    return table(spark, d, "crawl_jobs").filter("label is not null").select("job_id", F.sort_array(F.array_distinct(F.array("label", "status", "label"))).alias("patterns"))


@entry("u05_facet_defaults", "SELECT code AS value, count(d.doc_id) AS n FROM languages LEFT JOIN documents d ON lower(d.lang) = code GROUP BY code")
def u05(spark, d):
    n = docs(spark, d).groupBy(F.lower("lang").alias("value")).agg(F.count("*").alias("n"))
    return table(spark, d, "languages").select(F.col("code").alias("value")).join(n, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


@entry("x17_main_element", "SELECT rec_id, CASE WHEN regexp_matches(html, '(?i)<(article|main)\\b') THEN 'main_element' ELSE 'basic' END AS reader FROM indexed_docs WHERE html IS NOT NULL AND type = 0")
def x17(spark, d):
    from larkspan.operators.extract import extract

    return extract(saved(spark, d).filter("html is not null and type = 0").select("rec_id", "url", "html", "text")).select("rec_id", "reader")


@entry("x_chain_of_readers")
def x_chain(spark, d):
    """Every reader of the chain on a page of its kind."""
    from larkspan.operators.extract import extract

    base = "<html><head><title>t</title></head><body><main><p>body text</p></main></body></html>"
    pages = [
        ("file:///a/b.md", None, "# t"),
        ("file:///a/b.org", None, "* t"),
        ("https://forum.example/t/topic/12", base.replace("<main>", "<main class='discourse'><div class='topic-post'></div>"), None),
        ("https://github.com/a/b/issues/3", base.replace("main>", "article>"), None),
        ("https://en.wikipedia.org/wiki/X", base.replace("<main>", "<div id='mw-content-text'>").replace("</main>", "</div>"), None),
        ("https://stackoverflow.com/questions/1/x", base.replace("<main>", "<div id='mainbar'><div class='answer'></div>").replace("</main>", "</div>"), None),
        ("https://a.example/v", base.replace("<p>", "<iframe src='https://v.example/embed/9'></iframe><p>"), None),
        ("https://a.example/j", base.replace("<p>", '<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":"Article","headline":"h"}]}</script><p>'), None),
        ("https://a.example/n", "<body>plain</body>", None),
        ("https://a.example/none", None, None),
    ]
    x = extract(spark.createDataFrame(pages, "url string, html string, text string"))
    return x.select("url", "reader", "extracted", F.map_entries("facts").alias("facts"))
