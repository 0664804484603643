"""Text, url and date functions as columns."""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"([\p{L}\p{N}]+)"
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
#: Stop words of the analysers; small on purpose, a caller may pass its own.
STOP_WORDS = {
    "en": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with",
    "de": "aber als auch auf aus bei das dem den der des die ein eine einem einen einer es für im in ist mit nicht oder und von zu",
    "fr": "au aux avec ce ces dans de des du elle en et eux il la le les leur ne ou par pas pour qui que sur un une",
    "es": "al como con de del el en es la las lo los más no o para pero por que se su un una y",
}


def words(c: Column) -> Column:
    """Maximal runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD))


def analysed(c: Column, language: str = "", keep_stop_words: bool = False) -> Column:
    """Words less the language's stop words; for zh, ja and ko the overlapping pairs of characters of each run."""
    if language in ("zh", "ja", "ko"):
        # runs of the wide scripts as pairs, everything else as words
        runs = F.regexp_extract_all(F.lower(c), F.lit(rf"([{CJK}]+|(?:(?![{CJK}])[\p{{L}}\p{{N}}])+)"))
        pairs = lambda r: F.when(r.rlike(f"^[{CJK}]{{2,}}$"), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))).otherwise(F.array(r))
        return F.flatten(F.transform(runs, pairs))
    stop = [] if keep_stop_words else STOP_WORDS.get(language, "").split()
    return F.filter(words(c), lambda w: ~w.isin(stop)) if stop else words(c)


def embedding_tokens(c: Column) -> Column:
    """Units of the embedding budget: each wide character, each run of letters and digits, each other mark; no space."""
    return F.regexp_extract_all(c, F.lit(rf"(?U)([{CJK}]|(?:(?![{CJK}])[\p{{L}}\p{{Nd}}])+|[^\s\p{{L}}\p{{Nd}}])"))


def stripped(c: Column) -> Column:
    """Without leading and trailing white space, no-break spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_invisible(c: Column) -> Column:
    """Valid UTF-8, line feeds only, without control, format and private characters; runs of blanks folded, trimmed."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[\p{Cc}\p{Cf}\p{Co}&&[^\n\t]]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t\x{a0}]+", " "), r" ?\n ?", "\n"))


def combine_texts(parts: list[Column]) -> Column:
    """Trimmed, without blank and repeated ones, a blank line between them."""
    trimmed = F.transform(F.array(*parts), stripped)
    return F.array_join(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))), "\n\n")


def clean_tags(tags: Column, distinct: bool = True) -> Column:
    kept = F.filter(F.transform(tags, stripped), lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(kept) if distinct else kept


# ---------------------------------------------------------------- urls


def normalize_url(c: Column) -> Column:
    """Without fragment and without ``utm`` and ``utm_*`` parameters; the other parameters are sorted only if one of those was there."""
    bare = F.regexp_replace(c, r"(?s)#.*$", "")
    base, query = F.regexp_extract(bare, r"(?s)^([^?]*)", 1), F.regexp_extract(bare, r"(?s)^[^?]*\?(.*)$", 1)
    parts = F.split(query, "&")
    kept = F.filter(parts, lambda p: ~p.rlike(r"^utm(_[^=]*)?(=|$)") & (p != ""))
    rest = F.array_join(F.array_sort(kept), "&")
    return F.when(F.exists(parts, lambda p: p.rlike(r"^utm(_[^=]*)?(=|$)")), F.concat(base, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""))).otherwise(bare)


def host(c: Column) -> Column:
    """Host without port and user; ``local`` for file urls."""
    return F.when(c.rlike("(?i)^file://"), "local").otherwise(F.nullif(F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1)), F.lit("")))


def document_id(url: Column, user_id: Column) -> Column:
    return F.when(F.coalesce(user_id, F.lit(0)) == 0, url).otherwise(F.concat_ws(":", user_id.cast("string"), url))


def file_title(path: Column) -> Column:
    """``parent/base`` of a path."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(F.element_at(parts, -1))


def path_to_url(path: Column) -> Column:
    return F.when(path.startswith("file://"), path).otherwise(F.concat(F.lit("file://"), path))


def url_to_path(url: Column) -> Column:
    return F.regexp_replace(url, r"^file://", "")


def under(path: Column, directory: Column) -> Column:
    """Whether a path is the directory or lies in it."""
    d = F.regexp_replace(directory, "/+$", "")
    return (path == d) | path.startswith(F.concat(d, F.lit("/")))


def source_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9.-]+", "-"), r"^-+|-+$", "")


@F.pandas_udf(StringType())
def resolve_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """An absolute link; ``data:`` and ``#`` links stay as they are."""

    def one(b, k):
        if k is None:
            return None
        if k.startswith(("data:", "#")):
            return k
        try:
            return urljoin(b or "", k.strip())
        except ValueError:
            return None

    return pd.Series([one(b, k) for b, k in zip(base, link)], dtype=object)


@F.pandas_udf(StringType())
def crawl_link(base: pd.Series, link: pd.Series) -> pd.Series:
    """An absolute http(s) link without its fragment, else null."""

    def one(b, k):
        try:
            u = urlsplit(urljoin(b or "", (k or "").strip()))
        except ValueError:
            return None
        return u._replace(fragment="").geturl() if u.scheme in ("http", "https") and u.netloc else None

    return pd.Series([one(b, k) for b, k in zip(base, link)], dtype=object)


# ---------------------------------------------------------------- html


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*?\shref\s*=\s*[\"']([^\"']*)[\"']"))


def html_title(html: Column) -> Column:
    first = lambda p: F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit(""))
    return F.coalesce(first(r"(?is)<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']*)[\"']"), first(r"(?is)<meta[^>]*name=[\"']twitter:title[\"'][^>]*content=[\"']([^\"']*)[\"']"), first(r"(?is)<title[^>]*>(.*?)</title>"))


def html_url(html: Column) -> Column:
    first = lambda p: F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit(""))
    return F.coalesce(first(r"(?is)<link[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']*)[\"']"), first(r"(?is)<meta[^>]*property=[\"']og:url[\"'][^>]*content=[\"']([^\"']*)[\"']"), first(r"(?is)<meta[^>]*name=[\"']twitter:url[\"'][^>]*content=[\"']([^\"']*)[\"']"))


def basic_text(html: Column) -> Column:
    """The body without scripts, styles and tags, blanks squeezed; entities stay for ``decode_entities``."""
    body = F.regexp_replace(html, r"(?is)<(script|style|noscript|head)\b.*?</\1\s*>", " ")
    return squeeze(F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " "))


@F.pandas_udf(StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    return pd.Series([unescape(x) if x is not None and "&" in x else x for x in s], dtype=object)


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"<[^>]*>", ""))


ALLOWED_TAGS = frozenset("a b blockquote br code dd del div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img li ol p pre q s small span strong sub sup table tbody td tfoot th thead tr u ul".split())
ALLOWED_ATTRIBUTES = {"a": ("href", "title"), "img": ("src", "alt", "title"), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan")}


def sanitize_html(text: str | None) -> str | None:
    """Allowed tags and attributes only; scripts and styles with their content, handlers and unsafe links are dropped."""
    if text is None:
        return None
    from html import escape
    from html.parser import HTMLParser

    out: list[str] = []

    class Reader(HTMLParser):
        skip = 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "iframe", "object", "template"):
                self.skip += 1
            elif not self.skip and tag in ALLOWED_TAGS:
                keep = [(k, v or "") for k, v in attrs if k in ALLOWED_ATTRIBUTES.get(tag, ()) and (k not in ("href", "src") or re.match(r"(?i)\s*(https?:|mailto:|/|#|\.|[^:]*$)", v or ""))]
                out.append("<" + tag + "".join(f' {k}="{escape(v)}"' for k, v in keep) + ">")

        def handle_endtag(self, tag):
            if tag in ("script", "style", "iframe", "object", "template"):
                self.skip = max(0, self.skip - 1)
            elif not self.skip and tag in ALLOWED_TAGS and tag not in ("br", "hr", "img"):
                out.append(f"</{tag}>")

        def handle_data(self, data):
            if not self.skip:
                out.append(escape(data, quote=False))

    r = Reader(convert_charrefs=True)
    r.feed(text)
    r.close()
    return "".join(out)


@F.pandas_udf(StringType())
def sanitized(s: pd.Series) -> pd.Series:
    return pd.Series([sanitize_html(x) for x in s], dtype=object)


def json_ld(html: Column) -> Column:
    """The JSON-LD blobs of a page; a cheap test comes before the search."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"))
    return F.when(html.contains("application/ld+json"), F.transform(found, lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))


# ---------------------------------------------------------------- dates and encodings


def service_time(c: Column) -> Column:
    """RFC 3339 with a zone or a plain date as epoch seconds, else 0."""
    zoned = F.regexp_replace(c, r"([+-]\d\d)(\d\d)$", "$1:$2")
    return F.coalesce(F.unix_seconds(F.when(c.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$"), F.try_to_timestamp(zoned))), F.lit(0))


def day_start(c: Column) -> Column:
    return F.unix_seconds(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))


def day_end(c: Column) -> Column:
    return day_start(c) + 86_399


def browser_epoch(c: Column, unit: str) -> Column:
    """Epoch seconds from a browser's clock: ``ms``, ``us`` since 1970 or ``webkit`` (microseconds since 1601)."""
    c = c.cast("long")
    return {"ms": F.floor(c / 1_000), "us": F.floor(c / 1_000_000), "webkit": F.floor(c / 1_000_000) - 11_644_473_600}[unit].cast("long")


def duration_text(seconds: Column) -> Column:
    """Seconds rounded to hundredths, as ``0.01s``."""
    return F.concat(F.format_string("%.2f", F.round(seconds, 2)), F.lit("s"))


def vtt_text(c: Column) -> Column:
    """The spoken lines of a WebVTT file: no header, cues, times, numbers or tags; each line once."""
    lines = F.transform(F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"<[^>]*>", "")))
    spoken = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(WEBVTT|Kind:|Language:|NOTE|STYLE|REGION)") & ~x.contains("-->") & ~x.rlike(r"^\d+$"))
    return F.array_join(F.array_distinct(spoken), "\n")


def data_uri_bytes(c: Column) -> Column:
    return F.when(c.rlike(r"^data:[^,]*;base64,"), F.try_to_binary(F.regexp_extract(c, r"(?s)^data:[^,]*;base64,(.*)$", 1), F.lit("base64")))


def blob_key(c: Column) -> Column:
    return F.sha2(c, 256)


def is_blob_key(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")
