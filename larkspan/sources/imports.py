"""Imports and exports: document dumps, html files, url lists, browser histories, bookmark services; JSON, CSV and RSS."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from larkspan.functions import text as T

DOCUMENT = "url string, title string, text string, html string, added long, updated long, label string, type int, user_id long, metadata map<string,string>"


def document_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Documents of a dump with one object on each line, as an array or not: lines that start with a brace count."""
    body = F.regexp_replace(F.trim(column), r",\s*$", "")
    return lines.filter(F.trim(column).startswith("{")).select(F.from_json(body, DOCUMENT).alias("d")).select("d.*").filter("url is not null")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    return document_lines(spark.read.text(path))


def selected(docs: DataFrame, stored: DataFrame | None = None, date_from: int | None = None, date_to: int | None = None, label: str = "", flag: str = "") -> DataFrame:
    """Documents to import: in the date range, not stored yet; the label is the flag, else their own, else the fallback."""
    if date_from is not None:
        docs = docs.filter(F.col("updated") >= date_from)
    if date_to is not None:
        docs = docs.filter(F.col("updated") <= date_to)
    if stored is not None:
        docs = docs.join(stored.select("url"), "url", "left_anti")
    own = F.nullif(F.trim("label"), F.lit(""))
    return docs.withColumn("label", F.lit(flag) if flag else F.coalesce(own, F.lit(label)))


def is_dump(head: str) -> bool:
    """Whether a file begins like an array of exported documents."""
    head = head.lstrip()
    if not head.startswith("["):
        return False
    try:
        first, _ = json.JSONDecoder().raw_decode(head[1:].lstrip())
    except ValueError:
        return False
    return isinstance(first, dict) and {"url", "type", "processed"} <= first.keys()


def html_documents(pages: DataFrame, column: str = "html") -> DataFrame:
    """Saved html files as documents: url and title from the page itself; pages that name no url are dropped."""
    c = F.col(column)
    return pages.select("*", T.html_url(c).alias("page_url"), T.html_title(c).alias("page_title")).filter("page_url is not null")


def url_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """One url a line, trimmed, blank ones dropped, first of equals kept."""
    return lines.select(F.trim(column).alias("url")).filter("url != ''").distinct()


def browser_history(visits: DataFrame, unit: str, least_visits: int = 1, since: int | None = None, skip: list[str] | None = None) -> DataFrame:
    """Distinct http(s) urls of a browser's visits (url, visit_count, last_visit) from ``since``, with whether a rule skips them."""
    at = T.browser_epoch(F.col("last_visit"), unit)
    rows = visits.filter(F.col("url").rlike("^https?://") & (F.col("visit_count") >= least_visits))
    if since is not None:
        rows = rows.filter(at >= since)
    skipped = F.col("url").rlike("|".join(f"(?:{p})" for p in skip)) if skip else F.lit(False)
    return rows.select("url").distinct().withColumn("skipped", skipped)


# ---------------------------------------------------------------- bookmark services

#: Of each service: url, title, texts, tags, created, updated, and the prefix of its own keys.
SERVICES = {
    "linkding": {"url": "url", "title": "title", "texts": ("description", "notes"), "tags": "tag_names", "added": "date_added", "updated": "date_modified"},
    "karakeep": {"url": "url", "title": "title", "texts": ("summary", "note", "content"), "tags": "tags", "added": "createdAt", "updated": "modifiedAt"},
    "linkwarden": {"url": "url", "title": "name", "texts": ("description", "textContent"), "tags": "tags", "added": "createdAt", "updated": "updatedAt"},
    "readeck": {"url": "url", "title": "title", "texts": ("description", "content"), "tags": "labels", "added": "created", "updated": "updated"},
    "shaarli": {"url": "url", "title": "title", "texts": ("description",), "tags": "tags", "added": "created", "updated": "updated"},
    "wallabag": {"url": "url", "title": "title", "texts": ("content",), "tags": "tags", "added": "created_at", "updated": "updated_at"},
}


def bookmarks(records: DataFrame, service: str, column: str = "value") -> DataFrame:
    """A service's records (one JSON object a row) as documents. A url is required; ``updated`` falls back to ``added``, a
    blank title to the url; texts are combined; blank metadata are dropped."""
    m = SERVICES[service]
    names = dict.fromkeys([m["url"], m["title"], *m["texts"], m["added"], m["updated"]])
    schema = ", ".join(f"`{n}` string" for n in names) + f", `{m['tags']}` array<string>"
    r = records.select(F.from_json(column, schema).alias("r")).select("r.*")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    added = T.service_time(F.col(m["added"]))
    updated = F.coalesce(F.nullif(T.service_time(F.col(m["updated"])), F.lit(0)), added)
    tags = T.clean_tags(F.col(m["tags"]))
    meta = F.map_from_arrays(F.array(F.lit("source"), F.lit(f"{service}_tags")), F.array(F.lit(service), F.nullif(F.to_json(F.coalesce(tags, F.array().cast("array<string>"))), F.lit("[]"))))
    return r.filter(blank(F.col(m["url"])).isNotNull()).select(
        F.trim(m["url"]).alias("url"),
        F.coalesce(blank(F.col(m["title"])), F.trim(m["url"])).alias("title"),
        T.combine_texts([F.col(c) for c in m["texts"]]).alias("text"),
        added.alias("added"),
        updated.alias("updated"),
        F.map_filter(meta, lambda k, v: v.isNotNull() & (F.trim(v) != "")).alias("metadata"),
    )


def with_page_metadata(bookmark: Column, page: Column) -> Column:
    """The page's metadata fill only keys the bookmark did not set."""
    return F.map_concat(F.map_filter(page, lambda k, v: ~F.map_contains_key(bookmark, k)), bookmark)


def high_water(docs: DataFrame, source: str) -> DataFrame:
    """``since``: the newest ``updated`` imported from a source, 0 without any."""
    return docs.filter(F.try_element_at("metadata", F.lit("source")) == source).agg(F.coalesce(F.max("updated"), F.lit(0)).alias("since"))


def changes_less_deleted(feed: DataFrame) -> DataFrame:
    """Ids of a change feed (seq, id, kind) that were created or updated and never deleted, each with its first place."""
    kept = feed.filter(F.col("kind").isin("created", "updated")).groupBy("id").agg(F.min("seq").alias("seq"))
    return kept.join(feed.filter("kind = 'deleted'").select("id").distinct(), "id", "left_anti")


def updates_only(feed: DataFrame) -> DataFrame:
    """Distinct updated ids; deletions are passed over, an unknown kind fails the job."""
    kind = F.when(F.col("kind").isin("update", "delete"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown change "), F.coalesce("kind", F.lit("null")))))
    return feed.select("id", kind.alias("kind")).filter("kind = 'update'").select("id").distinct()


class _PagesReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        from pathlib import Path

        return [InputPartition(str(p)) for p in sorted(Path(self.path).glob("*.json"))]

    def read(self, partition):
        with open(partition.value, encoding="utf-8") as f:
            page = json.load(f)
        for item in page if isinstance(page, list) else page.get("results", page.get("items", [])):
            yield (json.dumps(item),)


class ServicePages(DataSource):
    """Stored pages of a service's interface (``format("service_pages")``, option ``path``): one partition for each page."""

    @classmethod
    def name(cls):
        return "service_pages"

    def schema(self):
        return "value string"

    def reader(self, schema):
        return _PagesReader(self.options)


# ---------------------------------------------------------------- exports and batches


def export_json(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def export_csv(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)


def xml_escape(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")], F.coalesce(c, F.lit("")))


def rss_items(rows: DataFrame) -> DataFrame:
    """``item`` elements of (url, title, updated)."""
    date = F.date_format(F.timestamp_seconds("updated"), "EEE, dd MMM yyyy HH:mm:ss")
    return rows.select("url", F.concat(F.lit("<item><title>"), xml_escape(F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("url"))), F.lit("</title><link>"), xml_escape(F.col("url")), F.lit("</link><pubDate>"), date, F.lit(" +0000</pubDate></item>")).alias("item"))


def pack(ops: DataFrame, key: str, seq: str, size: str, most_bytes: int, most_ops: int = 100) -> DataFrame:
    """Batch numbers for operations in order: a batch ends before it would pass the bytes or the count; an operation over
    the limit stands alone with status 413. Packing is sequential by nature, so it runs per sender (``key``) over narrow
    rows; each sender's state is one running total."""

    def run(keys, pdf):
        pdf = pdf.sort_values(seq)
        batch, used, n, out, status = 0, 0, 0, [], []
        for s in pdf[size]:
            if s > most_bytes:
                batch += n > 0
                out.append(batch), status.append(413)
                batch, used, n = batch + 1, 0, 0
                continue
            if n and (used + s > most_bytes or n >= most_ops):
                batch, used, n = batch + 1, 0, 0
            out.append(batch), status.append(0)
            used, n = used + s, n + 1
        return pdf.assign(batch=out, status=status)

    schema = f"{key} {ops.schema[key].dataType.simpleString()}, {seq} long, {size} long, batch int, status int"
    return ops.select(key, F.col(seq).cast("long").alias(seq), F.col(size).cast("long").alias(size)).groupBy(key).applyInPandas(run, schema)


def distinct_inputs(paths: DataFrame) -> DataFrame:
    """Inputs (pos, path) made absolute and distinct, each at its first place."""
    full = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), F.col("path")))
    w = Window.partitionBy("full").orderBy("pos")
    return paths.withColumn("full", F.regexp_replace(full, "/+", "/")).withColumn("n", F.row_number().over(w)).filter("n = 1").select("pos", F.col("full").alias("path"))
