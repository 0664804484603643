"""Searching: condition, scope, score, order, keyset pages, facets, snippets. One lazy plan over the corpus."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators import scoring
from larkspan.operators.predicate import bordered, predicate, words
from larkspan.plans import dsl, schema
from larkspan.runtime import checkpoint, small

PAGE = 100
INCLUDED = ("text", "html")


@dataclass(frozen=True)
class Request:
    text: str
    now: int
    user_id: int = 0
    date_from: int | None = None
    date_to: int | None = None
    sort: str = ""
    limit: int | None = None
    page_key: str = ""
    match_all: bool = False
    priority: tuple[str, ...] = ()
    aliases: dict = field(default_factory=dict)

    def resolved(self) -> "Request":
        """Aliases expanded and sort directives taken out of the text (a directive beats the parameter)."""
        text, mode = dsl.split_sort(dsl.expand_aliases(self.text, self.aliases))
        return replace(self, text=text, sort=mode or self.sort, aliases={})


def current(docs: DataFrame) -> DataFrame:
    """The searchable corpus: of each id the row saved last (``rec_id`` is unique).

    Only narrow sort keys are shuffled, to find the superseded rows; those are few and are taken out by a broadcast if
    their count allows it. Texts stay where they are scanned, and filters still reach the scan.
    """
    w = Window.partitionBy("id").orderBy(F.desc("updated"), F.desc("ingested_at"), F.desc("rec_id"))
    keys = docs.filter("id is not null").select("rec_id", "id", "updated", "ingested_at")
    old = checkpoint(keys.withColumn("n", F.row_number().over(w)).filter("n > 1").select("rec_id"))
    return docs.filter("id is not null").join(small(old), "rec_id", "left_anti").select(docs.columns)


def scope(r: Request) -> Column:
    """Owner (own and global documents; user 0 sees all) and date window (inclusive at both ends; without an end, until now)."""
    out = F.lit(True)
    if r.user_id > 0:
        out = out & F.col("user_id").isin(r.user_id, 0)
    if r.date_from is not None:
        out = out & (F.col("updated") >= r.date_from) & (F.col("updated") <= (r.now if r.date_to is None else r.date_to))
    elif r.date_to is not None:
        out = out & (F.col("updated") <= r.date_to)
    return out


def matching(corpus: DataFrame, r: Request) -> DataFrame:
    """Documents that meet the request, unscored: what facets, counts and deletions use."""
    r = r.resolved()
    node = dsl.Everything() if r.match_all else dsl.parse(r.text, r.now).where
    return corpus.filter(scope(r)).filter(predicate(node))


def scored(corpus: DataFrame, r: Request, stats: scoring.Statistics | None = None) -> DataFrame:
    """Matching documents with ``score``. Corpus statistics are one aggregate unless given."""
    r = r.resolved()
    parsed = dsl.Parsed(dsl.Everything()) if r.match_all else dsl.parse(r.text, r.now)
    pairs = [] if r.match_all else scoring.scored_words(r.text)
    if stats is None:
        stats = scoring.statistics(corpus, pairs) if pairs else scoring.Statistics(0, {})
    hits = corpus.filter(scope(r)).filter(predicate(parsed.where))
    return hits.withColumn("score", scoring.relevance("" if r.match_all else r.text, parsed, stats, list(r.priority)))


def order(mode: str) -> list[Column]:
    return [F.desc_nulls_last(k[1:]) if k[0] == "-" else F.asc_nulls_last(k) for k in schema.sort_keys(mode)]


def after(mode: str, page_key: str) -> Column:
    """Rows strictly after the row whose sort values the page key holds, nulls last."""
    keys, values = schema.sort_keys(mode), json.loads(page_key)
    if len(keys) != len(values):
        raise ValueError("the page key belongs to another order")
    branches = []
    for i, (k, v) in enumerate(zip(keys, values)):
        name = k.lstrip("-")
        c = F.col(name)
        later = F.lit(False) if v is None else (c < F.lit(v) if k[0] == "-" else c > F.lit(v)) | c.isNull()
        same = [F.col(a.lstrip("-")).eqNullSafe(F.lit(b)) for a, b in zip(keys[:i], values[:i])]
        branches.append(reduce(and_, [*same, later]))
    return F.coalesce(reduce(or_, branches), F.lit(False))


def search(corpus: DataFrame, r: Request, fields: list[str] | None = None, stats: scoring.Statistics | None = None) -> DataFrame:
    """A page of hits with their ``page_key``. Only the sort keys and the asked fields are read (text and html only on request)."""
    r = r.resolved()
    keys = [k.lstrip("-") for k in schema.sort_keys(r.sort)]
    # a score that neither orders nor shows isn't computed
    hits = scored(corpus, r, stats) if "score" in keys or "score" in (fields or []) else matching(corpus, r)
    if r.page_key:
        hits = hits.filter(after(r.sort, r.page_key))
    n = PAGE if r.limit is None else r.limit
    shown = fields or [c for c in corpus.columns if c not in INCLUDED]
    out = hits.select(*dict.fromkeys([*keys, *[c for c in shown if c != "page_key"]]))
    out = out.orderBy(*order(r.sort)).limit(n)
    return out.withColumn("page_key", F.to_json(F.array(*[F.to_json(F.struct(F.col(k).alias("v"))) for k in keys])))


def page_key_of(row, mode: str) -> str:
    """The page key after ``row``."""
    return json.dumps([row[k.lstrip("-")] for k in schema.sort_keys(mode)])


# ---------------------------------------------------------------- facets


def term_facet(hits: DataFrame, column: str, size: int) -> DataFrame:
    """``(value, n)`` of the ``size`` most frequent values (ties by value), and the rest as value null with ``is_other``."""
    counts = hits.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    # the top values come from a partial top-n in each partition; the rest is the total less the top
    top = counts.orderBy(F.desc("n"), "value").limit(size)
    total = hits.agg(F.count(column).alias("n")).withColumn("sign", F.lit(1))
    other = total.select("n").union(top.select(-F.col("n"))).agg(F.sum("n").cast("long").alias("n")).select(F.lit(None).cast("string").alias("value"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.lit(True).alias("is_other"))
    return top.withColumn("is_other", F.lit(False)).unionByName(other)


def range_facet(hits: DataFrame, column: str, ranges: list[tuple[str, int | None, int | None]]) -> DataFrame:
    """``(bucket, n)`` of half-open ranges, which may overlap: conditional counts in one pass, every bucket present."""
    c = F.col(column)
    test = lambda lo, hi: reduce(and_, ([c >= lo] if lo is not None else []) + ([c < hi] if hi is not None else []))
    row = hits.agg(*[F.count_if(test(lo, hi)).alias(name) for name, lo, hi in ranges])
    pairs = F.array(*[F.struct(F.lit(name).alias("bucket"), F.col(f"`{name}`").cast("long").alias("n")) for name, _, _ in ranges])
    return row.select(F.inline(pairs))


def facets(corpus: DataFrame, r: Request, sizes: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """All facets of a request without its hits."""
    hits, sizes = matching(corpus, r), sizes or {}
    out = {name: term_facet(hits, column, sizes.get(name, n)) for name, (column, n) in schema.FACETS.items() if name in ("domains", "languages")}
    out["types"] = range_facet(hits, "type", [(k, *v) for k, v in schema.DOCUMENT_TYPES.items() if k in ("web", "local", "remote")])
    out["visits"] = range_facet(hits, "add_count", list(schema.VISIT_COUNTS))
    out["updated"] = range_facet(hits, "updated", schema.age_ranges(r.now))
    return out


# ---------------------------------------------------------------- projections


def snippet(text: str, column: str = "text", before: str = "<mark>", close: str = "</mark>", size: int = 200) -> Column:
    """A stretch of the column around the first searched word, with the searched words marked; its start if none is there."""
    ws = list(dict.fromkeys(w for c, w in scoring.scored_words(text)))
    c = F.coalesce(F.col(column), F.lit(""))
    if not ws:
        return F.substring(c, 1, size)
    pattern = "(?iu)" + bordered("|".join(map(re.escape, ws)))
    at = F.length(F.regexp_extract(c, f"(?s)^(.*?){pattern}", 1))
    start = F.when(c.rlike(pattern), F.greatest(F.lit(1), at - size // 4 + 1)).otherwise(F.lit(1))
    return F.regexp_replace(F.substr(c, start, F.lit(size)), f"({pattern})", f"{before}$1{close}")


def preview(column: str, size: int = 500) -> Column:
    c = F.col(column)
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("…"))).otherwise(c)


def checked_fields(asked: list[str], allowed: tuple[str, ...]) -> list[str]:
    """The asked fields, an unknown one being an error."""
    if unknown := [f for f in asked if f not in allowed]:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    return list(dict.fromkeys(asked))


TOOL_FIELDS = ("text", "html", "language", "label", "domain", "score", "type")


def suggestions(hits: DataFrame, n: int = 10) -> DataFrame:
    """``suggestion``: the title, or the url where the title is blank."""
    label = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("url"))
    return hits.orderBy(*order("relevance")).limit(n).select("id", label.alias("suggestion"))


def delete_by_query(corpus: DataFrame, r: Request) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes); an empty text is an error, so that nothing is deleted by accident."""
    if not r.text.strip():
        raise ValueError("a deletion needs a query")
    gone = matching(corpus, r)
    return corpus.join(gone.select("id"), "id", "left_anti"), gone


__all__ = [n for n in dir() if not n.startswith("_")]
assert words
