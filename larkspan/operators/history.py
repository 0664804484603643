"""Visit history: links of a search, suggestions, filters, fusion with documents, and timelines."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from functools import reduce
from operator import or_
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators.predicate import phrase_pattern, words

TOP_LINKS, PAGE, MOST_DAYS, RECENT_DAYS = 20, 100, 32, 7


def latest(history: DataFrame) -> DataFrame:
    """One row for each entry: the one updated last (rows are repeated and come late)."""
    w = Window.partitionBy("hist_id").orderBy(F.desc("updated_at"), F.desc("ingested_at"))
    return history.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def star(history: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(histories, links, history_links): the entries as three related tables."""
    h = history.select("user_id", "query").distinct().withColumn("history_id", F.xxhash64("user_id", "query"))
    titled = history.filter("title is not null and trim(title) != ''")
    links = history.groupBy("url").agg(F.max("updated_at").alias("seen")).join(titled.groupBy("url").agg(F.max_by("title", F.struct("updated_at", "hist_id")).alias("title")), "url", "left").withColumn("link_id", F.xxhash64("url"))
    hl = history.select("hist_id", F.xxhash64("user_id", "query").alias("history_id"), F.xxhash64("url").alias("link_id"), "count", "pinned", "updated_at")
    return h, links, hl


def links_of_query(h: DataFrame, links: DataFrame, hl: DataFrame, user_id: int, query: str, n: int = TOP_LINKS) -> DataFrame:
    """A user's links of a query: pinned first, then by count, then the latest. The one history is found before the joins."""
    own = h.filter((F.col("user_id") == user_id) & (F.col("query") == query)).select("history_id")
    rows = hl.join(own, "history_id").join(links.select("link_id", "url", "title"), "link_id")
    best = rows.groupBy("url", "title").agg(F.max("pinned").alias("pinned"), F.sum("count").alias("count"), F.max("updated_at").alias("updated_at"))
    return best.orderBy(F.desc("pinned"), F.desc("count"), F.desc("updated_at"), "url").limit(n)


def opened(h: DataFrame, links: DataFrame, hl: DataFrame, user_id: int, needle: str = "", before: tuple | None = None, n: int = PAGE) -> DataFrame:
    """A page of a user's opened links, latest first, after the cursor ``(updated_at, hist_id)`` and holding ``needle``."""
    rows = hl.join(h.filter(F.col("user_id") == user_id), "history_id").join(links.select("link_id", "url", "title"), "link_id")
    if needle:
        low = needle.lower()
        rows = rows.filter(F.lower("url").contains(low) | F.coalesce(F.lower("title").contains(low), F.lit(False)))
    if before:
        at, i = before
        at = F.lit(at).cast("timestamp_ntz")
        rows = rows.filter((F.col("updated_at") < at) | ((F.col("updated_at") == at) & (F.col("hist_id") < i)))
    return rows.orderBy(F.desc("updated_at"), F.desc("hist_id")).limit(n).select("hist_id", "query", "url", "title", "count", "pinned", "updated_at")


def suggest(history: DataFrame, prefix: str, user_id: int | None = None, n: int = 1) -> DataFrame:
    """The most used query that starts with ``prefix``, without regard to case."""
    own = history if user_id is None else history.filter(F.col("user_id") == user_id)
    counts = own.filter(F.lower("query").startswith(prefix.lower())).groupBy("query").agg(F.sum("count").alias("uses"))
    return counts.orderBy(F.desc("uses"), "query").limit(n)


def visits(events: DataFrame) -> DataFrame:
    """Visit counter: per (user, query, url) the number of events and the last time; a title is required of a new link."""
    return events.groupBy("user_id", "query", "url").agg(F.count("*").alias("count"), F.max("updated_at").alias("updated_at"))


def pin(history: DataFrame, user_id: int, query: str, url: str, pinned: bool) -> DataFrame:
    """Entries with a link pinned or unpinned; unpinning never creates an entry, pinning adds one if there is none."""
    same = (F.col("user_id") == user_id) & (F.col("query") == query) & (F.col("url") == url)
    out = history.withColumn("pinned", F.when(same, F.lit(pinned)).otherwise(F.col("pinned")))
    if pinned and not history.filter(same).limit(1).count():
        kinds = {f.name: f.dataType for f in history.schema}
        new = {"hist_id": F.xxhash64(F.lit(user_id), F.lit(query), F.lit(url)), "user_id": F.lit(user_id), "query": F.lit(query), "url": F.lit(url), "count": F.lit(0), "pinned": F.lit(True)}
        row = history.sparkSession.range(1).select(*[new.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in history.columns])
        out = out.unionByName(row)
    return out


def document_filter(docs: DataFrame, needle: str, date_from: int | None = None, date_to: int | None = None) -> DataFrame:
    """Documents whose url or title holds ``needle``; the date window is half open here, unlike a search's."""
    if needle:
        low = needle.lower()
        tests = [F.lower("url").contains(low)]
        if p := phrase_pattern(needle):
            tests.append(F.lower("title").rlike(p))
        if " " not in needle and words(needle):
            tests.append(F.exists(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), lambda w: w.contains(low)))
        docs = docs.filter(F.coalesce(reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False)))
    if date_from is not None:
        docs = docs.filter(F.col("updated") >= date_from)
    if date_to is not None:
        docs = docs.filter(F.col("updated") < date_to)
    return docs


def fuse(hits: DataFrame, visited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history rows with the document's id, documents without those the history shows)."""
    ids = hits.groupBy("url").agg(F.min("id").alias("id"))
    return visited.join(ids, "url", "left"), hits.join(visited.select("url").distinct(), "url", "left_anti")


# ---------------------------------------------------------------- timelines


def _midnight(d: date, zone: ZoneInfo) -> int:
    return int(datetime.combine(d, time(), zone).timestamp())


def timeline_buckets(now: int, oldest: int | None, zone: str = "UTC") -> list[tuple[str, int | None, int]]:
    """Seven days back from today, all before them, and the months down to the oldest (counted in both): half open
    ranges of local calendar days, so that days of 23 and 25 hours come out right."""
    z = ZoneInfo(zone)
    today = datetime.fromtimestamp(now, z).date()
    days = [today - timedelta(days=i) for i in range(RECENT_DAYS)]
    out: list[tuple[str, int | None, int]] = [(f"day:{d}", _midnight(d, z), _midnight(d + timedelta(days=1), z)) for d in days]
    end = days[-1]
    out.append(("older", None, _midnight(end, z)))
    if oldest:
        month = end.replace(day=1)
        if month == end:
            month = (end - timedelta(days=1)).replace(day=1)
        while oldest < _midnight(end, z):
            out.append((f"month:{month:%Y-%m}", _midnight(month, z), _midnight(end, z)))
            end, month = month, (month - timedelta(days=1)).replace(day=1)
    return out


def day_buckets(start: int, end: int, zone: str = "UTC") -> list[tuple[str, int, int]]:
    """The calendar days of a window, clipped to it, newest first; at most MOST_DAYS."""
    z = ZoneInfo(zone)
    out, day = [], datetime.fromtimestamp(start, z).date()
    while start < end and (a := _midnight(day, z)) < end:
        b = _midnight(day + timedelta(days=1), z)
        if max(a, start) < min(b, end):
            out.append((f"day:{day}", max(a, start), min(b, end)))
        day += timedelta(days=1)
    if len(out) > MOST_DAYS:
        raise ValueError(f"a window has at most {MOST_DAYS} days")
    return out[::-1]


def count_buckets(rows: DataFrame, column: str, buckets: list[tuple[str, int | None, int]]) -> DataFrame:
    """``(bucket, n)``, empty ones too, in one pass over the rows. Buckets overlap, so rows aren't grouped by one."""
    from larkspan.operators.search import range_facet

    return range_facet(rows, column, buckets)
