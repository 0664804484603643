"""Extraction: a chain of page readers. Enriching readers all add metadata; of the others the first that matches and
finds a text wins. A reader is a match and columns, so the whole chain is one expression, without a join.

Site-specific readers know a site by its address or by a marker in the page; what they take from it are plain facts
(the kind of page, names in the address, counts in attributes). The general readers come last.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions import text as T

URL, HTML = F.col, F.col


@dataclass(frozen=True)
class Reader:
    name: str
    match: object  # () -> Column
    metadata: dict = field(default_factory=dict)  # key -> () -> Column
    title: object = None
    text: object = None
    enrich: bool = False
    aborts: object = None  # () -> Column: reading stops with an error


def url() -> Column:
    return F.col("url")


def html() -> Column:
    return F.col("html")


def _url(pattern: str):
    return lambda: F.coalesce(url().rlike(pattern), F.lit(False))


def _in_url(pattern: str, group: int = 1):
    return lambda: F.nullif(F.regexp_extract(url(), pattern, group), F.lit(""))


def _in_html(pattern: str, group: int = 1):
    return lambda: F.nullif(F.trim(T.strip_tags(F.regexp_extract(html(), pattern, group))), F.lit(""))


def _has(marker: str):
    return lambda: F.coalesce(html().contains(marker), F.lit(False))


def _all(pattern: str):
    return lambda: F.nullif(F.array_join(F.array_distinct(F.regexp_extract_all(html(), F.lit(pattern))), ", "), F.lit(""))


def _just(value: str):
    return lambda: F.lit(value)


def _count(pattern: str):
    return lambda: F.nullif(F.regexp_count(html(), F.lit(pattern)).cast("string"), F.lit("0"))


def _both(a, b):
    return lambda: a() & b()


#: JSON-LD kinds in order of preference.
KINDS = ("Article", "NewsArticle", "BlogPosting", "Recipe", "Product", "VideoObject", "Event", "Organization", "Person", "WebPage")


def json_ld_objects() -> Column:
    """The objects of a page's JSON-LD as texts, graphs flattened."""
    blobs = T.json_ld(html())
    graph = lambda b: F.from_json(F.get_json_object(b, "$['@graph']"), "array<string>")
    listed = lambda b: F.from_json(b, "array<string>")
    return F.flatten(F.transform(blobs, lambda b: F.when(b.startswith("["), F.coalesce(listed(b), F.array().cast("array<string>"))).when(F.get_json_object(b, "$['@graph']").isNotNull(), F.coalesce(graph(b), F.array().cast("array<string>"))).otherwise(F.array(b))))


def preferred_json_ld() -> Column:
    objects = json_ld_objects()
    ranked = F.transform(objects, lambda o: F.struct(F.coalesce(F.nullif(F.array_position(F.lit(list(KINDS)), F.get_json_object(o, "$['@type']")), F.lit(0)), F.lit(99)).alias("rank"), o.alias("o")))
    return F.array_min(ranked)["o"]


def body(pattern: str):
    return lambda: F.nullif(T.basic_text(F.regexp_extract(html(), pattern, 1)), F.lit(""))


READERS = (
    Reader("markdown", _url(r"^file://.*\.(md|markdown)$"), {"type": _just("markdown")}, text=lambda: F.col("text")),
    Reader("orgmode", _url(r"^file://.*\.org$"), {"type": _just("org")}, text=lambda: F.col("text")),
    Reader("embedded_video", lambda: F.coalesce(html().rlike(r"<iframe[^>]+src=[\"'][^\"']*/(embed|video|player)/"), F.lit(False)), {"videos": lambda: F.to_json(F.array_distinct(F.regexp_extract_all(html(), F.lit(r"<iframe[^>]+src=[\"']([^\"']*/(?:embed|video|player)/[^\"']*)[\"']"))))}, enrich=True),
    Reader("discourse", _both(_url(r"/t/[^/]+/\d+"), _has("discourse")), {"type": _just("topic"), "topic_id": _in_url(r"/t/[^/]+/(\d+)"), "posts": _count(r"class=[\"'][^\"']*\btopic-post\b"), "tags": _all(r"class=[\"'][^\"']*\bdiscourse-tag\b[^\"']*[\"'][^>]*>([^<]*)<")}, text=body(r"(?is)<main\b[^>]*>(.*)</main>")),
    Reader("json_ld", _has("application/ld+json"), {"type": lambda: F.get_json_object(preferred_json_ld(), "$['@type']"), "headline": lambda: F.get_json_object(preferred_json_ld(), "$.headline"), "jsonld": preferred_json_ld}, enrich=True),
    Reader("reddit", _url(r"^https?://(?:www\.|old\.)?reddit\.com/r/[^/]+/comments/"), {"type": _just("discussion"), "comments": _count(r"<shreddit-comment\b|class=[\"'][^\"']*\bcomment\b")}, text=body(r"(?is)<(?:shreddit-post|main)\b[^>]*>(.*)</(?:shreddit-post|main)>")),
    Reader("question", _url(r"^https?://(?:[^/]+\.)?(?:stackexchange\.com|stackoverflow\.com|serverfault\.com|superuser\.com|askubuntu\.com)/questions/\d+"), {"type": _just("question"), "answers": _count(r"class=[\"'][^\"']*\banswer\b"), "score": _in_html(r"(?is)itemprop=[\"']upvoteCount[\"'][^>]*>([^<]*)<"), "tags": _all(r"class=[\"'][^\"']*\bpost-tag\b[^\"']*[\"'][^>]*>([^<]*)<")}, text=body(r"(?is)<div[^>]*id=[\"']mainbar[\"'][^>]*>(.*)</div>")),
    Reader("package_docs", _url(r"^https?://pkg\.go\.dev/"), {"type": _just("package")}, text=body(r"(?is)<main\b[^>]*>(.*)</main>")),
    Reader("code_host", _url(r"^https?://github\.com/[^/]+/[^/?#]+"), {"type": lambda: F.when(url().rlike(r"/issues/\d+"), "issue").when(url().rlike(r"/pull/\d+"), "pull request").otherwise("repository"), "repo": _in_url(r"^https?://github\.com/([^/]+/[^/?#]+)"), "topics": _all(r"class=[\"'][^\"']*\btopic-tag\b[^\"']*[\"'][^>]*>\s*([^<]*?)\s*<")}, text=body(r"(?is)<article\b[^>]*>(.*)</article>")),
    Reader("lobsters", _url(r"^https?://lobste\.rs/s/"), {"type": _just("discussion")}, text=body(r"(?is)<body\b[^>]*>(.*)</body>")),
    Reader("encyclopedia", _url(r"^https?://[a-z-]+\.(?:m\.)?wikipedia\.org/wiki/"), {"type": _just("article"), "categories": _all(r"href=[\"']/wiki/Category:[^\"']*[\"'][^>]*>([^<]*)<")}, text=body(r"(?is)<div[^>]*id=[\"']mw-content-text[\"'][^>]*>(.*)</div>")),
    Reader("toot", _has('content="Mastodon"'), {"type": _just("toot")}, text=_in_html(r"(?is)<meta[^>]*property=[\"']og:description[\"'][^>]*content=[\"']([^\"']*)[\"']")),
    Reader("skeet", _url(r"^https?://bsky\.app/profile/[^/]+/post/"), {"type": _just("post")}, text=_in_html(r"(?is)<meta[^>]*property=[\"']og:description[\"'][^>]*content=[\"']([^\"']*)[\"']")),
    Reader("tweet", _url(r"^https?://(?:www\.|mobile\.)?(?:twitter|x)\.com/[^/]+/status/"), {"type": _just("post")}, text=_in_html(r"(?is)<meta[^>]*property=[\"']og:description[\"'][^>]*content=[\"']([^\"']*)[\"']")),
    Reader("notion", _has("notion-page-content"), {}, text=body(r"(?is)<div[^>]*notion-page-content[^>]*>(.*)</div>")),
    Reader("video_page", _url(r"^https?://(?:www\.)?(?:youtube\.com/watch|youtu\.be/|vimeo\.com/\d)"), {"type": _just("video"), "duration": _in_html(r"(?is)itemprop=[\"']duration[\"'][^>]*content=[\"']([^\"']*)[\"']")}, text=_in_html(r"(?is)<meta[^>]*name=[\"']description[\"'][^>]*content=[\"']([^\"']*)[\"']")),
    Reader("main_element", lambda: F.coalesce(html().rlike(r"(?i)<(?:article|main)\b"), F.lit(False)), {"author": _in_html(r"(?is)<meta[^>]*name=[\"']author[\"'][^>]*content=[\"']([^\"']*)[\"']"), "description": _in_html(r"(?is)<meta[^>]*name=[\"']description[\"'][^>]*content=[\"']([^\"']*)[\"']")}, text=body(r"(?is)<(?:article|main)\b[^>]*>(.*)</(?:article|main)>")),
    Reader("basic", lambda: html().isNotNull(), {}, text=lambda: F.nullif(T.basic_text(html()), F.lit(""))),
)


def _map(pairs: dict) -> Column:
    keys = F.array(*[F.lit(k) for k in pairs]) if pairs else F.array().cast("array<string>")
    values = F.array(*[f().cast("string") for f in pairs.values()]) if pairs else F.array().cast("array<string>")
    return F.map_filter(F.map_from_arrays(keys, values), lambda k, v: v.isNotNull())


def register(readers: tuple[Reader, ...], new: Reader, before: str | None = None) -> tuple[Reader, ...]:
    """The chain with a reader added, before the named one or before the general ones."""
    at = next((i for i, r in enumerate(readers) if r.name == (before or "main_element")), len(readers))
    return (*readers[:at], new, *readers[at:])


def extract(pages: DataFrame, readers: tuple[Reader, ...] = READERS, start: str | None = None) -> DataFrame:
    """``pages`` (url, html, text) with ``reader``, ``extracted``, ``page_title`` and ``facts``; reader is null where none
    matched, ``error`` where one aborted. ``start`` begins the chain at a named reader."""
    if start:
        readers = readers[next(i for i, r in enumerate(readers) if r.name == start) :]
    first = [r for r in readers if not r.enrich]
    found = F.coalesce(*[F.when(r.match(), F.when(r.text().isNotNull(), F.struct(F.lit(r.name).alias("reader"), r.text().alias("extracted"), _map(r.metadata).alias("own")))) for r in first], F.lit(None).cast("struct<reader:string,extracted:string,own:map<string,string>>"))
    added = reduce(lambda m, r: F.map_concat(m, F.map_filter(F.when(r.match(), _map(r.metadata)).otherwise(F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(m, k))), [r for r in readers if r.enrich], F.create_map().cast("map<string,string>"))
    aborted = F.coalesce(*[F.when(r.match() & r.aborts(), F.lit(r.name)) for r in first if r.aborts], F.lit(None).cast("string"))
    x = pages.withColumn("__f", found).withColumn("__e", added).withColumn("error", aborted)
    own = F.coalesce("__f.own", F.create_map().cast("map<string,string>"))
    facts = F.map_concat(F.map_filter("__e", lambda k, v: ~F.map_contains_key(own, k)), own)
    return x.withColumn("reader", F.when(F.col("error").isNull(), F.col("__f.reader"))).withColumn("extracted", F.when(F.col("error").isNull(), F.col("__f.extracted"))).withColumn("page_title", T.html_title(html())).withColumn("facts", facts).drop("__f", "__e")
