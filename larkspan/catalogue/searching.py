"""Search: conditions, scores, orders, pages, facets, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.catalogue import NOW, entry
from larkspan.operators import search as S
from larkspan.operators import semantic
from larkspan.plans import schema
from larkspan.runtime import table


def corpus(spark, d):
    return S.current(table(spark, d, "indexed_docs"))


def word(w: str) -> str:
    return f"(list_contains(title_w, '{w}') OR list_contains(text_w, '{w}') OR coalesce(domain LIKE '%{w}%', false) OR coalesce(url ILIKE '%{w}%', false))"


def phrase(*ws: str) -> str:
    p = " ".join(ws)
    return f"(title_p LIKE '% {p} %' OR text_p LIKE '% {p} %')"


def every(*ws: str) -> str:
    return "(" + " OR ".join("(" + " AND ".join(f"list_contains({c}, '{w}')" for w in ws) + ")" for c in ("title_w", "text_w")) + ")"


def hits(name: str, text: str, where: str | None, uses: str = "pad", **kw):
    """A query for the ids that meet a text; ``where`` is the condition in SQL."""
    sql = None if where is None else f"SELECT rec_id FROM {uses.split()[-1]} WHERE {where}"
    entry(name, sql, uses)(lambda spark, d: S.matching(corpus(spark, d), S.Request(text, NOW, **kw)).select("rec_id"))


FREE2 = lambda a, b: f"(({word(a)} AND {word(b)}) OR {phrase(a, b)} OR {every(a, b)})"

# lexer and parser
hits("q01_words", "broth garlic", FREE2("broth", "garlic"))
hits("q02_quoted_unclosed", '"level playing field', phrase("level", "playing", "field"))
hits("q03_alternation_parts", "(broth| |stadium)", f"({word('broth')} OR {word('stadium')})")
hits("q04_embedded_quote", 'title:"spice mix"', "title_p LIKE '% spice mix %'")
hits("q05_unreadable_text", "(broth garlic", FREE2("broth", "garlic").replace("broth garlic", "broth garlic"))
hits("q06_sort_directive", "sort:date broth sort:visits", word("broth"))
hits("q07_alias", "!soup garlic", FREE2("broth", "garlic"), aliases={"!soup": "broth"})


@entry("q08_text_to_embed")
def q08(spark, d):
    from larkspan.plans.dsl import text_to_embed

    texts = ["broth *", "* garlic", "-* broth", "(a|*) stew", '"spice mix" pan']
    return spark.createDataFrame([(t, text_to_embed(t)) for t in texts], "query string, embedded string")


# conditions


@entry("f01_none_count", "SELECT count(*) AS n FROM indexed_docs WHERE false")
def f01(spark, d):
    return S.matching(corpus(spark, d), S.Request("  ", NOW)).agg(F.count("*").alias("n"))


hits("f02_match_all", "*", "true")
hits("f02_star_dropped", "* stadium", word("stadium"))


@entry("f03_negated_star", "SELECT count(*) AS n FROM indexed_docs WHERE false")
def f03(spark, d):
    return S.matching(corpus(spark, d), S.Request("stadium -*", NOW)).agg(F.count("*").alias("n"))


hits("f04_negated_only", "-stadium", f"NOT {word('stadium')}")
hits("f04_words_and_not", "broth -garlic", f"({word('broth')} OR {phrase('broth', 'garlic')} OR {every('broth', 'garlic')}) AND NOT {word('garlic')}")
hits("f05_two_words", "open question", FREE2("open", "question"))
hits("f07_search_term", "stadium", word("stadium"))
hits("f08_domain_term", "domain:velmora.example", "coalesce(domain = 'velmora.example', false)")
hits("f09_title_field", "title:stadium-referee", "(list_contains(title_w, 'stadium') OR list_contains(title_w, 'referee'))")
hits("f10_phrase", '"open question"', phrase("open", "question"))
hits("f10_phrase_field", 'text:"a clear plan"', "text_p LIKE '% a clear plan %'")
hits("f11_wildcard_text", "title:stad*", "list_bool_or([w LIKE 'stad%' FOR w IN title_w])")
hits("f11_wildcard_domain", "domain:*.example", "coalesce(domain LIKE '%.example', false)")
hits("f12_wildcard_url", "url:HTTPS://Velmora.*", "coalesce(url ILIKE 'https://velmora.%', false)")
hits("f12_wildcard_url_one", "url:*/note?/*", "coalesce(url ILIKE '%/note_/%', false)")


@entry("f13_path_to_file_url", "SELECT rec_id FROM corpus WHERE url = (SELECT min(url) FROM corpus WHERE url LIKE 'file:///%')", "corpus")
def f13(spark, d):
    docs = corpus(spark, d)
    first = docs.filter(F.col("url").startswith("file:///")).agg(F.min("url").alias("u")).first()["u"]
    return S.matching(docs, S.Request(f"url:{(first or 'file:///none')[7:]}", NOW)).select("rec_id")


hits("f14_type_enum", "type:local", "type >= 1 AND type < 2")
hits("f14_type_file", "type:file", "type >= 1 AND type < 3")
hits("f15_visits_exact", "visits:2", "coalesce(add_count = 2, false)")
hits("f15_visits_range", "visits:3..6", "coalesce(add_count BETWEEN 3 AND 6, false)")
hits("f15_visits_open", "add_count:8..", "coalesce(add_count >= 8, false)")
hits("f15_visits_up_to", "visits:..2", "coalesce(add_count <= 2, false)")
hits("f16_user", "user_id:1", "coalesce(user_id = 1, false)")
hits("f17_older_than", "updated:>90d", f"updated < {NOW - 90 * 86400}")
hits("f17_younger_or_equal", "updated:<=30d", f"updated >= {NOW - 30 * 86400}")
hits("f17_weeks", "added:<20w", f"added > {NOW - 20 * 7 * 86400}")
hits("f18_since_date", "updated:>=2024-09-01", "updated >= 1725148800")
hits("f18_before_date", "added:<2024-06-01", "added < 1717200000")
hits("f19_window_of_two", "updated:>=2024-06-01 updated:<2024-09-01", "updated >= 1717200000 AND updated < 1725148800")
hits("f20_metadata", "metadata.source:rss", "coalesce(metadata['source'] = 'rss', false)")
hits("f20_metadata_either", "metadata.source:(rss|browser)", "coalesce(metadata['source'] IN ('rss', 'browser'), false)")
hits("f21_field_alternation", "domain:(velmora.example|selbrivin-ba.example)", "coalesce(domain IN ('velmora.example', 'selbrivin-ba.example'), false)")
hits("f21_field_alternation_wild", "title:(stad*|broth)", "(list_bool_or([w LIKE 'stad%' FOR w IN title_w]) OR list_contains(title_w, 'broth'))")
hits("f22_alternation", "(stadium|broth)", f"({word('stadium')} OR {word('broth')})")
hits("f23_negated_phrase", 'stadium -"open question"', f"({word('stadium')} OR title_p LIKE '% stadium open question %' OR text_p LIKE '% stadium open question %' OR {every('stadium', 'open', 'question')}) AND NOT {phrase('open', 'question')}")
hits("f23_negated_field", "stadium -domain:velmora.example", f"{word('stadium')} AND NOT coalesce(domain = 'velmora.example', false)")
hits("f23_negated_value", "stadium language:-en", f"{word('stadium')} AND NOT coalesce(language = 'en', false)")
hits("f24_mixed", "stadium title:referee type:web", f"{word('stadium')} AND list_contains(title_w, 'referee') AND type = 0")
hits("f24_language_label", "language:en label:work", "coalesce(language = 'en', false) AND coalesce(label = 'work', false)")
hits("f25_owner", "*", "user_id IN (1, 0)", user_id=1)
hits("f26_dates", "*", "updated BETWEEN 1717200000 AND 1725148800", date_from=1717200000, date_to=1725148800)
hits("f26_from_until_now", "stadium", f"{word('stadium')} AND updated BETWEEN 1717200000 AND {NOW}", date_from=1717200000)
hits("f27_match_all", "ignored", "true", match_all=True)

# ---------------------------------------------------------------- scores


def tfidf(column: str, weight: float, w: str) -> str:
    idf = f"(1 + ln(n_docs / (df_{column}_{w} + 1.0)))"
    return f"coalesce({weight} * sqrt(len(list_filter({column}_w, lambda x: x = '{w}'))::DOUBLE) / nullif(sqrt(len({column}_w)::DOUBLE), 0) * {idf} * {idf}, 0)"


def stats(*ws: str) -> str:
    cols = ", ".join(f"(count(*) FILTER (WHERE list_contains({c}_w, '{w}')))::DOUBLE AS df_{c}_{w}" for c in ("title", "text") for w in ws)
    return f", st AS (SELECT count(*)::DOUBLE AS n_docs, {cols} FROM pad)"


def contained(w: str) -> str:
    return f"CASE WHEN coalesce(domain LIKE '%{w}%', false) THEN 8 ELSE 0 END + CASE WHEN coalesce(url ILIKE '%{w}%', false) THEN 4 ELSE 0 END"


def score1(w: str) -> str:
    return f"{tfidf('title', 12, w)} + {tfidf('text', 1, w)} + {contained(w)}"


ROOT = "CASE WHEN coalesce(regexp_matches(lower(url), '^https?://(www\\.)?{0}[^/]*/$'), false) THEN 100 ELSE 0 END"
SCORE_1 = f"round({score1('stadium')} + {ROOT.format('stadium')}, 6)"
SCORE_2 = f"round({score1('open')} + {score1('question')} + CASE WHEN {phrase('open', 'question')} THEN 20 ELSE 0 END + CASE WHEN {every('open', 'question')} THEN 2 ELSE 0 END, 6)"


def flagship(spark, d):
    return S.scored(corpus(spark, d), S.Request("open question", NOW)).select("rec_id", "id", "score", "updated")


entry("t04_relevance_two_words", f"{stats('open', 'question')} SELECT rec_id, id, {SCORE_2} AS score, updated FROM pad, st WHERE {FREE2('open', 'question')}", "pad")(flagship)


@entry("t04_relevance_one_word", f"{stats('stadium')} SELECT rec_id, {SCORE_1} AS score FROM pad, st WHERE {word('stadium')}", "pad")
def t04(spark, d):
    return S.scored(corpus(spark, d), S.Request("stadium", NOW)).select("rec_id", "score")


@entry("f06_root_url_boost", f"{stats('velmora')} SELECT rec_id, round({score1('velmora')} + {ROOT.format('velmora')}, 6) AS score FROM pad, st WHERE {word('velmora')}", "pad")
def f06(spark, d):
    return S.scored(corpus(spark, d), S.Request("velmora", NOW)).select("rec_id", "score")


@entry("t05_phrase_boost", f"SELECT rec_id, (CASE WHEN {phrase('open', 'question')} THEN 20 ELSE 0 END + CASE WHEN {every('open', 'question')} THEN 2 ELSE 0 END)::DOUBLE AS bonus FROM pad WHERE {FREE2('open', 'question')}", "pad")
def t05(spark, d):
    from larkspan.operators.scoring import Statistics, relevance
    from larkspan.plans.dsl import Parsed, parse

    r = S.Request("open question", NOW)
    whole = parse(r.text, NOW)
    hit = S.matching(corpus(spark, d), r)
    return hit.select("rec_id", relevance("", Parsed(whole.where, whole.whole), Statistics(1, {})).alias("bonus"))


@entry("t06_priority_boost", f"{stats('stadium')} SELECT rec_id, round({score1('stadium')} + {ROOT.format('stadium')} + CASE WHEN coalesce(regexp_matches(url, '(velmora)|(\\.test/)'), false) THEN 100 ELSE 0 END, 6) AS score FROM pad, st WHERE {word('stadium')}", "pad")
def t06(spark, d):
    return S.scored(corpus(spark, d), S.Request("stadium", NOW, priority=("velmora", r"\.test/"))).select("rec_id", "score")


# ---------------------------------------------------------------- orders and pages


def ordered(name: str, mode: str, order_sql: str, n: int = 40):
    keys = [k.lstrip("-") for k in schema.sort_keys(mode)]
    score = SCORE_1 if "score" in keys else None
    cols = ", ".join(f"{score} AS score" if k == "score" else k for k in keys)
    head = stats("stadium") if score else ""
    sql = f"{head} SELECT rec_id, {cols} FROM pad{', st' if score else ''} WHERE {word('stadium')} ORDER BY {order_sql} LIMIT {n}"
    entry(name, sql, "pad")(lambda spark, d: S.search(corpus(spark, d), S.Request("stadium", NOW, sort=mode, limit=n), ["rec_id"]).select("rec_id", *keys))


ordered("o01_relevance", "relevance", "score DESC, updated DESC, id")
ordered("o02_least_relevant", "-relevance", "score, updated, id")
ordered("o03_visits", "visits", "add_count DESC NULLS LAST, updated DESC, id")
ordered("o03_visits_up", "-visits", "add_count NULLS LAST, updated, id")
ordered("o04_date", "date", "updated DESC, id")
ordered("o04_date_up", "-date", "updated, id")
ordered("o05_domain", "domain", "domain NULLS LAST, id")
ordered("o05_domain_down", "-domain", "domain DESC NULLS LAST, id")
ordered("o06_unknown_order", "no-such-order", "score DESC, updated DESC, id")
ordered("o07_default_limit", "date", "updated DESC, id", 100)


@entry("o07_default_page_size", f"SELECT rec_id FROM pad WHERE {word('the')} ORDER BY updated DESC, id LIMIT 100", "pad")
def o07(spark, d):
    return S.search(corpus(spark, d), S.Request("sort:date the", NOW), ["rec_id"]).select("rec_id")


@entry("o08_second_page", f"SELECT rec_id, updated FROM pad WHERE {word('stadium')} ORDER BY updated DESC, id LIMIT 10 OFFSET 10", "pad")
def o08(spark, d):
    docs = corpus(spark, d)
    first = S.search(docs, S.Request("stadium", NOW, sort="date", limit=10), ["rec_id"]).collect()  # a page of ten
    key = S.page_key_of(first[-1], "date") if first else "[0, \"\"]"
    return S.search(docs, S.Request("stadium", NOW, sort="date", limit=10, page_key=key), ["rec_id"]).select("rec_id", "updated")


@entry("o08_second_page_by_domain", f"SELECT rec_id, domain FROM pad WHERE {word('stadium')} ORDER BY domain NULLS LAST, id LIMIT 15 OFFSET 15", "pad")
def o08b(spark, d):
    docs = corpus(spark, d)
    first = S.search(docs, S.Request("stadium", NOW, sort="domain", limit=15), ["rec_id"]).collect()
    return S.search(docs, S.Request("stadium", NOW, sort="domain", limit=15, page_key=S.page_key_of(first[-1], "domain")), ["rec_id"]).select("rec_id", "domain")


@entry("o11_latest_documents", "SELECT rec_id, updated FROM corpus ORDER BY updated DESC, id LIMIT 25", "corpus")
def o11(spark, d):
    return S.search(corpus(spark, d), S.Request("*", NOW, sort="date", limit=25), ["rec_id"]).select("rec_id", "updated")


# ---------------------------------------------------------------- facets

RANGES = lambda expr, ranges: " UNION ALL ".join(f"SELECT '{k}' AS bucket, count(*) FILTER (WHERE {' AND '.join(([f'{expr} >= {lo}'] if lo is not None else []) + ([f'{expr} < {hi}'] if hi is not None else []))}) AS n FROM pad WHERE {word('the')}" for k, lo, hi in ranges)


def term_sql(column: str, size: int) -> str:
    return f""", c AS (SELECT {column} AS value, count(*) AS n FROM pad WHERE {word('the')} AND {column} IS NOT NULL GROUP BY 1),
t AS (SELECT * FROM c ORDER BY n DESC, value LIMIT {size})
SELECT value, n, false AS is_other FROM t UNION ALL
SELECT NULL, ((SELECT coalesce(sum(n), 0) FROM c) - (SELECT coalesce(sum(n), 0) FROM t))::BIGINT, true"""


THE = S.Request("the", NOW)
entry("a01_facet_domains", term_sql("domain", 10), "pad")(lambda spark, d: S.facets(corpus(spark, d), THE)["domains"])
entry("a01_facet_languages", term_sql("language", 10), "pad")(lambda spark, d: S.facets(corpus(spark, d), THE)["languages"])
entry("a01_facet_size", term_sql("domain", 3), "pad")(lambda spark, d: S.facets(corpus(spark, d), THE, {"domains": 3})["domains"])
entry("a02_facet_types", RANGES("type", [("web", 0, 1), ("local", 1, 2), ("remote", 2, 3)]), "pad")(lambda spark, d: S.facets(corpus(spark, d), THE)["types"])
entry("a02_facet_visits", RANGES("add_count", [(k, a, b) for k, a, b in schema.VISIT_COUNTS]), "pad")(lambda spark, d: S.facets(corpus(spark, d), THE)["visits"])
entry("a03_facet_updated_overlapping", RANGES("updated", schema.age_ranges(NOW)), "pad")(lambda spark, d: S.facets(corpus(spark, d), THE)["updated"])


@entry("a04_facets_only", f"SELECT 'hits' AS facet, count(*) AS n FROM pad WHERE {word('the')} UNION ALL SELECT 'domains', count(DISTINCT domain) FROM pad WHERE {word('the')}", "pad")
def a04(spark, d):
    h = S.matching(corpus(spark, d), THE)
    row = h.agg(F.count("*").alias("hits"), F.count_distinct("domain").alias("domains"))
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("facet"), F.col(k).alias("n")) for k in ("hits", "domains")])))


@entry("a07_oldest", "SELECT min(updated) AS oldest FROM corpus", "corpus")
def a07(spark, d):
    return corpus(spark, d).agg(F.min("updated").alias("oldest"))


# ---------------------------------------------------------------- projections


@entry("proj1_included_fields", f"SELECT rec_id, url, title, text FROM pad WHERE {word('stadium')}", "pad")
def proj1(spark, d):
    return S.matching(corpus(spark, d), S.Request("stadium", NOW)).select("rec_id", "url", "title", "text")


@entry("proj2_metadata_keys", "SELECT rec_id, unnest(map_keys(metadata)) AS key, unnest(map_values(metadata)) AS value FROM corpus", "corpus")
def proj2(spark, d):
    return corpus(spark, d).select("rec_id", F.explode("metadata"))


@entry("proj3_snippet_marks", f"SELECT rec_id, len(list_filter(text_w, lambda x: x = 'stadium')) > 0 AS marked FROM pad WHERE {word('stadium')}", "pad")
def proj3(spark, d):
    h = S.matching(corpus(spark, d), S.Request("stadium", NOW))
    return h.select("rec_id", S.snippet("stadium").contains("<mark>").alias("marked"))


@entry("proj4_preview", "SELECT rec_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '…' ELSE text END AS preview FROM corpus", "corpus")
def proj4(spark, d):
    return corpus(spark, d).select("rec_id", S.preview("text").alias("preview"))


@entry("proj5_preview_metadata", "SELECT rec_id, metadata['author'] AS author, metadata['type'] AS type FROM corpus WHERE len(list_filter(map_keys(metadata), lambda k: k IN ('author', 'type'))) > 0", "corpus")
def proj5(spark, d):
    kept = F.map_filter("metadata", lambda k, v: k.isin("author", "type"))
    x = corpus(spark, d).select("rec_id", kept.alias("m")).filter(F.size("m") > 0)
    return x.select("rec_id", F.try_element_at("m", F.lit("author")).alias("author"), F.try_element_at("m", F.lit("type")).alias("type"))


@entry("proj6_tool_fields", f"SELECT rec_id, language, label, domain, type FROM pad WHERE {word('stadium')}", "pad")
def proj6(spark, d):
    fields = S.checked_fields(["language", "label", "domain", "type"], S.TOOL_FIELDS)
    return S.matching(corpus(spark, d), S.Request("stadium", NOW)).select("rec_id", *fields)


@entry("proj8_capabilities")
def proj8(spark, d):
    c = schema.capabilities()
    return spark.createDataFrame([(f["name"], f["kind"], f.get("facet")) for f in c["fields"]], "name string, kind string, facet string")


@entry("proj9_suggestions", f"{stats('stadium')} SELECT id, coalesce(nullif(trim(title), ''), url) AS suggestion FROM pad, st WHERE {word('stadium')} ORDER BY {SCORE_1} DESC, updated DESC, id LIMIT 10", "pad")
def proj9(spark, d):
    return S.suggestions(S.scored(corpus(spark, d), S.Request("stadium", NOW)))


# ---------------------------------------------------------------- deletion by query


@entry("w08_delete_by_query", f"SELECT rec_id FROM pad WHERE NOT ({word('stadium')} AND user_id IN (1, 0))", "pad")
def w08(spark, d):
    return S.delete_by_query(corpus(spark, d), S.Request("stadium", NOW, user_id=1))[0].select("rec_id")


@entry("w09_delete_file", "SELECT count(*) AS n FROM corpus WHERE NOT (url ILIKE 'file:///srv/notes/%')", "corpus")
def w09(spark, d):
    return S.delete_by_query(corpus(spark, d), S.Request("url:file:///srv/notes/*", NOW))[0].agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- keyword and semantic results


def semantic_hits(spark, d):
    from larkspan.catalogue.semantic import best

    return best(spark, d).withColumnRenamed("doc_id", "id")


BEST = ", b AS (SELECT doc_id AS id, max(similarity) AS similarity FROM (SELECT * FROM sims WHERE user_id = 0 AND similarity >= 0.1 ORDER BY similarity DESC, vec_id LIMIT 50) GROUP BY 1)"
KEYWORD = f", k AS (SELECT id, {SCORE_1} AS score FROM pad, st WHERE {word('stadium')})"


@entry("j07_semantic_only_flag", f"{BEST} SELECT b.id, b.similarity, NOT EXISTS (SELECT 1 FROM pad WHERE pad.id = b.id AND {word('stadium')}) AS semantic_only FROM b", "sims pad")
def j07(spark, d):
    return semantic.only_semantic(semantic_hits(spark, d), S.matching(corpus(spark, d), S.Request("stadium", NOW))).select("id", "similarity", "semantic_only")


@entry(
    "j08_hybrid_merge",
    f"""{stats('stadium')}{BEST}{KEYWORD}, t AS (SELECT greatest(coalesce(max(score), 0), 1) AS top FROM k)
SELECT coalesce(k.id, b.id) AS id, score, similarity, round((1 - 0.4) * coalesce(score, 0) / top + 0.4 * coalesce(similarity, 0), 6) AS hybrid_score,
  CASE WHEN score IS NULL THEN 'semantic' WHEN similarity IS NULL THEN 'keyword' ELSE 'both' END AS origin
FROM k FULL JOIN b ON k.id = b.id, t""",
    "sims pad",
)
def j08(spark, d):
    return semantic.hybrid(S.scored(corpus(spark, d), S.Request("stadium", NOW)), semantic_hits(spark, d))


entry("t19_hybrid_score", f"{stats('stadium')}{BEST}{KEYWORD}, t AS (SELECT greatest(coalesce(max(score), 0), 1) AS top FROM k) SELECT coalesce(k.id, b.id) AS id, round(0.2 * coalesce(score, 0) / top + 0.8 * coalesce(similarity, 0), 6) AS hybrid_score FROM k FULL JOIN b ON k.id = b.id, t", "sims pad")(lambda spark, d: semantic.hybrid(S.scored(corpus(spark, d), S.Request("stadium", NOW)), semantic_hits(spark, d), 0.8).select("id", F.round("hybrid_score", 6).alias("hybrid_score")))


@entry("a17_total_bump", f"{BEST} SELECT greatest((SELECT count(*) FROM pad WHERE {word('stadium')}), (SELECT count(*) FROM pad WHERE {word('stadium')}) + (SELECT count(*) FROM b WHERE NOT EXISTS (SELECT 1 FROM pad WHERE pad.id = b.id AND {word('stadium')}))) AS total", "sims pad")
def a17(spark, d):
    k = S.matching(corpus(spark, d), S.Request("stadium", NOW))
    extra = semantic_hits(spark, d).join(k.select("id"), "id", "left_anti")
    return k.select("id").union(extra.select("id")).agg(F.count("*").alias("total"))
