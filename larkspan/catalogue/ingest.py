"""Scans, sinks, upserts, batches, imports, versions, queues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspan.catalogue import NOW, entry
from larkspan.catalogue.searching import corpus
from larkspan.functions import text as T
from larkspan.operators import chunking, ingest
from larkspan.runtime import table
from larkspan.sources import files, imports
from larkspan.streaming import queues


def saved(spark, d):
    return table(spark, d, "indexed_docs")


# ---------------------------------------------------------------- scans


@entry("s01_full_scan", "SELECT rec_id, id, (row_number() OVER (ORDER BY id) - 1) // 200 AS page FROM corpus", "corpus")
def s01(spark, d):
    """Pages of 200 in id order: a range sort, then the rank from partition offsets, so that no task sees all rows."""
    c = corpus(spark, d).select("rec_id", "id").repartitionByRange("id").sortWithinPartitions("id")
    c = c.withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id())
    sizes = c.groupBy("p").agg(F.count("*").alias("n"))
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("p", "base")
    at = F.col("base") + F.col("i").bitwiseAND(F.lit((1 << 33) - 1))
    return c.join(F.broadcast(base), "p").select("rec_id", "id", F.floor(at / 200).alias("page"))


@entry("s02_point_lookup", "SELECT rec_id, title FROM indexed_docs WHERE id = (SELECT id FROM indexed_docs WHERE rec_id = 2)")
def s02(spark, d):
    key = saved(spark, d).filter("rec_id = 2").first()["id"]
    return saved(spark, d).filter(F.col("id") == key).select("rec_id", "title")


@entry("s03_own_then_global", "SELECT url, rec_id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN user_id = 1 THEN 0 ELSE 1 END, rec_id) AS n FROM corpus WHERE user_id IN (0, 1)) WHERE n = 1", "corpus")
def s03(spark, d):
    own = corpus(spark, d).filter(F.col("user_id").isin(0, 1))
    return own.groupBy("url").agg(F.min_by("rec_id", F.struct(F.when(F.col("user_id") == 1, 0).otherwise(1), "rec_id")).alias("rec_id"))


@entry("s04_visits_of_url", "SELECT url, greatest(1, coalesce(max(add_count), 1)) AS add_count FROM indexed_docs WHERE user_id IN (0, 1) GROUP BY url")
def s04(spark, d):
    return saved(spark, d).filter(F.col("user_id").isin(0, 1)).groupBy("url").agg(F.greatest(F.lit(1), F.coalesce(F.max("add_count"), F.lit(1))).cast("long").alias("add_count"))


@entry("s05_totals", "SELECT user_id, count(*) AS n FROM corpus GROUP BY user_id", "corpus")
def s05(spark, d):
    return corpus(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))


@entry("s06_walk_rules", "SELECT rec_id FROM indexed_docs WHERE url LIKE 'file://%' AND regexp_matches(url, '\\.(txt|md)$') AND NOT regexp_matches(substring(url, 8), '/(\\.[^/]*|papers|node_modules|vendor|target|dist|build|venv|__pycache__)/') AND NOT regexp_matches(url, '/\\.[^/]*$')")
def s06(spark, d):
    local = saved(spark, d).filter(F.col("url").startswith("file://"))
    return local.filter(files.path_allowed(F.col("url"), excluded=("papers",), types=("txt", "md"))).select("rec_id")


@entry("f38_path_match", "SELECT rec_id FROM indexed_docs WHERE url LIKE 'file://%' AND regexp_matches(url, '/copy-[^/]*$') AND NOT regexp_matches(substring(url, 8), '/(\\.[^/]*|node_modules|vendor|target|dist|build|venv|__pycache__)/')")
def f38(spark, d):
    local = saved(spark, d).filter(F.col("url").startswith("file://"))
    return local.filter(files.path_allowed(F.col("url"), patterns=("copy-*",))).select("rec_id")


@entry("s07_changed_files", "SELECT rec_id FROM indexed_docs a WHERE type = 1 AND octet_length(encode(text)) BETWEEN 1 AND 1048576 AND NOT EXISTS (SELECT 1 FROM indexed_docs b WHERE b.type = 1 AND b.url = a.url AND b.updated = a.updated AND b.rec_id % 2 = 0)")
def s07(spark, d):
    local = saved(spark, d).filter("type = 1")
    now = local.select("rec_id", F.col("url").alias("path"), F.octet_length("text").alias("length"), F.timestamp_seconds("updated").alias("modificationTime"))
    return files.changed(now, local.filter("rec_id % 2 = 0").select(F.col("url").alias("path"), "updated")).select("rec_id")


@entry("s11_markdown_title", "SELECT doc_id, nullif(trim(regexp_extract('# ' || coalesce(title, '') || chr(10) || coalesce(text, ''), '(?m)^# (.*)$', 1)), '') AS title FROM documents")
def s11(spark, d):
    md = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.nullif(F.trim(F.regexp_extract(md, r"(?m)^# (.*)$", 1)), F.lit("")).alias("title"))


@entry("s13_dump_lines", "SELECT url, title, updated, type FROM indexed_docs WHERE url IS NOT NULL")
def s13(spark, d):
    line = F.concat(F.to_json(F.struct("url", "title", "text", "added", "updated", "label", "type", "user_id")), F.lit(","))
    lines = saved(spark, d).select(line.alias("value")).union(spark.createDataFrame([("[",), ("]",)], "value string"))
    return imports.document_lines(lines).select("url", "title", "updated", "type")


@entry("s14_html_url_title", "SELECT rec_id, nullif(trim(regexp_extract(html, '(?is)<link[^>]*rel=[\"'']canonical[\"''][^>]*href=[\"'']([^\"'']*)[\"'']', 1)), '') AS page_url, coalesce(nullif(trim(regexp_extract(html, '(?is)<meta[^>]*property=[\"'']og:title[\"''][^>]*content=[\"'']([^\"'']*)[\"'']', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '')) AS page_title FROM indexed_docs WHERE contains(html, 'rel=\"canonical\"')")
def s14(spark, d):
    pages = saved(spark, d).filter(F.col("html").contains('rel="canonical"'))
    return imports.html_documents(pages).select("rec_id", "page_url", "page_title")


@entry("s15_remote_url", "SELECT doc_id, 'remote-file://' || regexp_replace(regexp_replace(lower(trim(source || ' Box #1')), '[^a-z0-9.-]+', '-', 'g'), '^-+|-+$', '', 'g') || '/' || doc_id AS url FROM documents")
def s15(spark, d):
    return table(spark, d, "documents").select("doc_id", files.remote_url(F.concat("source", F.lit(" Box #1")), F.col("doc_id").cast("string")).alias("url"))


def _visits(spark, d):
    h = table(spark, d, "search_history")
    return h.select("url", F.col("count").alias("visit_count"), ((F.unix_seconds(F.col("updated_at").cast("timestamp")) + 11_644_473_600) * 1_000_000).alias("last_visit"))


BROWSER = "SELECT DISTINCT url, regexp_matches(url, '(velmora)|(\\.test/)') AS skipped FROM search_history WHERE regexp_matches(url, '^https?://') AND count >= 2 AND floor(epoch(updated_at)) >= 1717200000"
entry("s16_browser_distinct", BROWSER)(lambda spark, d: imports.browser_history(_visits(spark, d), "webkit", 2, 1717200000, ["velmora", r"\.test/"]))
entry("s17_browser_counts", f"SELECT skipped, count(*) AS n FROM ({BROWSER}) GROUP BY 1")(lambda spark, d: imports.browser_history(_visits(spark, d), "webkit", 2, 1717200000, ["velmora", r"\.test/"]).groupBy("skipped").agg(F.count("*").alias("n")))


def _records(spark, d, most=None):
    doc = table(spark, d, "documents")
    text = F.substring("text", 1, most) if most else F.col("text")
    return doc.select(F.to_json(F.struct("url", "title", text.alias("description"), text.alias("notes"), F.array("lang", F.lit(" "), "lang").alias("tag_names"), F.date_format("added_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_added")), {"ignoreNullFields": "false"}).alias("value"))


BOOKMARKS = """SELECT trim(url) AS url, coalesce(nullif(trim(title), ''), trim(url)) AS title, coalesce(regexp_replace(substring(text, 1, 80), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '') AS text,
  floor(epoch(added_at))::BIGINT AS updated FROM documents WHERE nullif(trim(url), '') IS NOT NULL"""
entry("m03_bookmark_documents", BOOKMARKS)(lambda spark, d: imports.bookmarks(_records(spark, d, 80), "linkding").select("url", "title", "text", "updated"))
WHOLE_BOOKMARKS = """SELECT trim(url) AS url, coalesce(nullif(trim(title), ''), trim(url)) AS title, coalesce(regexp_replace(text, '^[\\s\\p{Z}\\x{85}\\x{0B}]+|[\\s\\p{Z}\\x{85}\\x{0B}]+$', '', 'g'), '') AS text,
  floor(epoch(added_at))::BIGINT AS updated FROM documents WHERE nullif(trim(url), '') IS NOT NULL"""
entry("m03_bookmark_documents_whole", WHOLE_BOOKMARKS)(lambda spark, d: imports.bookmarks(_records(spark, d), "linkding").select("url", "title", "text", "updated"))
entry("s18_bookmark_sources", "SELECT 'linkding' AS source, count(*) AS n FROM documents WHERE nullif(trim(url), '') IS NOT NULL")(lambda spark, d: imports.bookmarks(_records(spark, d), "linkding").groupBy(F.try_element_at("metadata", F.lit("source")).alias("source")).agg(F.count("*").alias("n")))
entry("s19_high_water", "SELECT coalesce(max(updated), 0) AS since FROM corpus WHERE metadata['source'] = 'rss'", "corpus")(lambda spark, d: imports.high_water(corpus(spark, d), "rss"))
entry("s20_url_list", "SELECT DISTINCT trim(url) AS url FROM documents WHERE trim(url) <> ''")(lambda spark, d: imports.url_list(table(spark, d, "documents").select(F.concat(F.lit("  "), "url").alias("value"))))


@entry("m04_page_metadata", "SELECT rec_id, coalesce(metadata['source'], 'page') AS source, 'page' AS type FROM indexed_docs")
def m04(spark, d):
    page = F.create_map(F.lit("source"), F.lit("page"), F.lit("type"), F.lit("page"))
    own = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k == "source")
    m = imports.with_page_metadata(own, page)
    return saved(spark, d).select("rec_id", F.try_element_at(m, F.lit("source")).alias("source"), F.try_element_at(m, F.lit("type")).alias("type"))


def _feed(spark, d):
    kind = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "click", "updated").otherwise("created")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat_ws(":", "user_id", "props").alias("id"), kind.alias("kind"))


@entry("m05_changes_less_deleted", "SELECT user_id || ':' || props AS id, min(event_id) FILTER (WHERE event_type <> 'error') AS seq FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'error') = 0")
def m05(spark, d):
    return imports.changes_less_deleted(_feed(spark, d)).select("id", "seq")


@entry("m06_updates_only", "SELECT DISTINCT user_id || ':' || props AS id FROM events WHERE event_type <> 'error'")
def m06(spark, d):
    kinds = F.when(F.col("kind") == "deleted", "delete").otherwise("update")
    return imports.updates_only(_feed(spark, d).select("id", kinds.alias("kind")))


@entry("m07_clean_tags", "SELECT doc_id, CASE WHEN lang IS NULL OR trim(lang) = '' THEN []::VARCHAR[] ELSE [trim(lang)] END AS tags FROM documents")
def m07(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_tags(F.array(F.concat(F.lit(" "), "lang"), "lang", F.lit(" "))).alias("tags"))


@entry("m08_import_label", "SELECT rec_id, coalesce(nullif(trim(label), ''), 'imported') AS label FROM indexed_docs WHERE updated >= 1717200000")
def m08(spark, d):
    return imports.selected(saved(spark, d), date_from=1717200000, label="imported").select("rec_id", "label")


@entry("m02_distinct_inputs", "SELECT min(rec_id) AS pos, regexp_replace(CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END, '/+', '/', 'g') AS path FROM (SELECT rec_id, replace(url, 'file://', '') AS p FROM indexed_docs WHERE type = 1) GROUP BY 2")
def m02(spark, d):
    paths = saved(spark, d).filter("type = 1").select(F.col("rec_id").alias("pos"), F.replace("url", F.lit("file://"), F.lit("")).alias("path"))
    return imports.distinct_inputs(paths)


@entry("m01_packed_batches")
def m01(spark, d):
    ops = saved(spark, d).select("user_id", "rec_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    return imports.pack(ops, "user_id", "rec_id", "bytes", 5_000)


@entry("m16_dump_detector")
def m16(spark, d):
    heads = ['[{"url": "u", "type": 0, "processed": true}', "[1, 2]", "{}", "", "[{"]
    return spark.createDataFrame([(h, imports.is_dump(h)) for h in heads], "head string, is_dump boolean")


# ---------------------------------------------------------------- writes

STATE = "SELECT id, max(add_count)::BIGINT AS add_count, min(nullif(added, 0)) FILTER (WHERE added > 0) AS added, arg_min(CASE WHEN trim(label) <> '' THEN label END, (updated, rec_id)) FILTER (WHERE trim(label) <> '') AS label, count(*) AS copies FROM indexed_docs WHERE id IS NOT NULL GROUP BY id"
entry("w02_stored_state", STATE)(lambda spark, d: ingest.stored_state(saved(spark, d)).withColumn("add_count", F.col("add_count").cast("long")))

UPSERT = """, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated DESC, rec_id DESC) AS n FROM indexed_docs WHERE rec_id % 3 <> 0 AND id IS NOT NULL) WHERE n = 1),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated DESC, rec_id DESC) AS n FROM indexed_docs WHERE rec_id % 3 = 0 AND id IS NOT NULL) WHERE n = 1)
SELECT coalesce(w.id, o.id) AS id, (CASE WHEN w.id IS NOT NULL THEN coalesce(o.add_count, 0) + 1 ELSE o.add_count END)::BIGINT AS add_count,
  coalesce(least(nullif(o.added, 0), nullif(w.added, 0)), {now}) AS added,
  CASE WHEN w.id IS NOT NULL THEN coalesce(nullif(w.updated, 0), {now}) ELSE o.updated END AS updated,
  coalesce(CASE WHEN trim(w.label) <> '' THEN w.label END, o.label, w.label) AS label
FROM o FULL JOIN w ON o.id = w.id""".replace("{now}", str(NOW))


def _upserted(spark, d):
    rows = saved(spark, d)
    return ingest.upsert(rows.filter("rec_id % 3 != 0"), rows.filter("rec_id % 3 = 0"), NOW).select("id", "add_count", "added", "updated", "label")


entry("w01_upsert", UPSERT, "corpus")(_upserted)
entry("j15_stored_and_incoming", UPSERT, "corpus")(_upserted)
entry("w03_one_row_per_id", "SELECT rec_id, language FROM corpus", "corpus")(lambda spark, d: corpus(spark, d).select("rec_id", "language"))
entry("u01_union_of_languages", "SELECT count(*) AS n, count(DISTINCT id) AS ids FROM corpus", "corpus")(lambda spark, d: corpus(spark, d).filter("language is not null").unionByName(corpus(spark, d).filter("language is null")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")))


def _ops(spark, d):
    op = F.when(F.col("event_type") == "error", "delete").otherwise("add")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), op.alias("op"))


LAST = "SELECT user_id::VARCHAR AS key, max(event_id) AS seq, arg_max(CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END, event_id) AS op FROM events GROUP BY 1"
entry("w04_last_op", LAST)(lambda spark, d: ingest.last_ops(_ops(spark, d)))
entry("n02_latest_op", LAST)(lambda spark, d: ingest.last_ops(_ops(spark, d)))


@entry("w05_op_status", "SELECT rec_id AS seq, CASE WHEN regexp_matches(id, 'velmora') THEN 406 ELSE 201 END AS status FROM indexed_docs WHERE rec_id % 3 = 0 UNION ALL SELECT rec_id, CASE WHEN id IN (SELECT id FROM indexed_docs WHERE rec_id % 2 = 0) THEN 200 ELSE 404 END FROM indexed_docs WHERE rec_id % 3 <> 0")
def w05(spark, d):
    rows = saved(spark, d)
    ops = rows.select(F.col("rec_id").alias("seq"), F.when(F.col("rec_id") % 3 == 0, "add").when(F.col("rec_id") % 3 == 1, "get").otherwise("delete").alias("op"), "id", F.lit("plain").alias("text"))
    return ingest.op_status(ops, rows.filter("rec_id % 2 = 0"), ["velmora"]).select("seq", "status")


@entry("w06_extra_documents", "SELECT rec_id, (unnest(range(len(l))))::INTEGER AS pos, unnest(l) AS link FROM (SELECT rec_id, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\shref\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1) AS l FROM indexed_docs)")
def w06(spark, d):
    return saved(spark, d).select("rec_id", F.posexplode(T.links(F.col("html"))).alias("pos", "link"))


@entry("w07_delete_ids", "SELECT rec_id FROM indexed_docs WHERE id NOT IN (SELECT id FROM indexed_docs WHERE rec_id % 5 = 0)")
def w07(spark, d):
    rows = saved(spark, d)
    return rows.join(rows.filter("rec_id % 5 = 0").select("id").distinct(), "id", "left_anti").select("rec_id")


@entry("w10_blob_store", "SELECT sha256(html) AS key, octet_length(encode(any_value(html))) AS bytes, count(*) AS refs FROM indexed_docs WHERE html IS NOT NULL GROUP BY 1")
def w10(spark, d):
    return ingest.blob_table(saved(spark, d)).select("key", F.col("bytes").cast("long").alias("bytes"), "refs")


ORPHANS = "SELECT DISTINCT sha256(html) AS key FROM indexed_docs WHERE html IS NOT NULL AND sha256(html) NOT IN (SELECT sha256(html) FROM indexed_docs WHERE html IS NOT NULL AND rec_id % 4 <> 0)"


def _orphans(spark, d):
    rows = saved(spark, d).filter("html is not null")
    return ingest.orphans(ingest.blob_table(rows).select("key"), rows.filter("rec_id % 4 != 0").select(T.blob_key(F.col("html")).alias("key")))


entry("j14_orphan_blobs", ORPHANS)(_orphans)
entry("a12_blob_references", "SELECT refs, count(*) AS n FROM (SELECT sha256(html), count(*) AS refs FROM indexed_docs WHERE html IS NOT NULL GROUP BY 1) GROUP BY 1")(lambda spark, d: ingest.blob_table(saved(spark, d)).groupBy("refs").agg(F.count("*").alias("n")))

PRUNE = """SELECT id, CASE WHEN NOT starts_with(url, 'file://') THEN 'stale'
  WHEN starts_with(url, 'file:///srv/notes/') AND user_id = 1 OR starts_with(url, 'file:///srv/inbox/') THEN 'keep'
  WHEN starts_with(url, 'file:///srv/notes/') AND user_id = 0 THEN 'undecided' ELSE 'stale' END AS status FROM corpus WHERE type = 1"""
entry("w11_prune_local", PRUNE, "corpus")(lambda spark, d: ingest.prune_local(corpus(spark, d), [("/srv/notes", 1), ("/srv/inbox", 0)]))


@entry("w12_reindex", "SELECT rec_id, coalesce(nullif(updated, 0), added) AS updated FROM indexed_docs WHERE trim(url) <> '' AND NOT regexp_matches(url, 'velmora')")
def w12(spark, d):
    return ingest.reindex(saved(spark, d), ["velmora"]).select("rec_id", "updated")


@entry("w13_backfill_updated", "SELECT rec_id, coalesce(CASE WHEN rec_id % 2 = 0 THEN nullif(updated, 0) END, added) AS updated FROM indexed_docs")
def w13(spark, d):
    gaps = saved(spark, d).withColumn("updated", F.when(F.col("rec_id") % 2 == 0, F.col("updated")))
    return ingest.with_updated(gaps).select("rec_id", "updated")


@entry("w14_set_label", "SELECT rec_id, CASE WHEN id = (SELECT id FROM indexed_docs WHERE rec_id = 2) THEN 'kept' ELSE label END AS label FROM indexed_docs")
def w14(spark, d):
    key = saved(spark, d).filter("rec_id = 2").first()["id"]
    return saved(spark, d).select("rec_id", F.when(F.col("id") == key, "kept").otherwise(F.col("label")).alias("label"))


@entry("w15_export_rows", "SELECT rec_id, url FROM corpus WHERE updated BETWEEN 1717200000 AND 1725148800", "corpus")
def w15(spark, d):
    lines = corpus(spark, d).filter("updated between 1717200000 and 1725148800").select(F.to_json(F.struct("rec_id", "url")).alias("j"))
    return lines.select(F.from_json("j", "rec_id long, url string").alias("r")).select("r.*")


@entry("w16_csv_fields", "SELECT rec_id, '\"' || replace(coalesce(title, ''), '\"', '\"\"') || '\"' AS line FROM corpus WHERE title NOT LIKE '%\\%'", "corpus")
def w16(spark, d):
    field = F.concat(F.lit('"'), F.replace(F.coalesce("title", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return corpus(spark, d).filter(~F.col("title").contains("\\")).select("rec_id", field.alias("line"))


@entry("w16_csv_fields_all")
def w16b(spark, d):
    field = F.concat(F.lit('"'), F.replace(F.coalesce("title", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return corpus(spark, d).select("rec_id", field.alias("line"))


@entry("w17_rss_items", """SELECT url, '<item><title>' || esc(coalesce(nullif(trim(title), ''), url)) || '</title><link>' || esc(url) || '</link><pubDate>' || strftime(make_timestamp(updated * 1000000), '%a, %d %b %Y %H:%M:%S') || ' +0000</pubDate></item>' AS item FROM corpus""".replace("esc(coalesce(nullif(trim(title), ''), url))", "replace(replace(replace(replace(coalesce(nullif(trim(title), ''), url), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;')").replace("esc(url)", "replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;')"), "corpus")
def w17(spark, d):
    return imports.rss_items(corpus(spark, d))


@entry("w18_replaced_chunks")
def w18(spark, d):
    chunks = table(spark, d, "chunk_meta").dropDuplicates(["chunk_key"])
    docs = corpus(spark, d).filter("type = 2")
    return chunking.put_chunks(chunks, docs, most=256, overlap=32).groupBy("doc_id").agg(F.count("*").alias("n"))


@entry("w18_kept_chunks", "SELECT chunk_key FROM chunks WHERE doc_id NOT IN (SELECT id FROM corpus WHERE type = 2)", "chunks corpus")
def w18b(spark, d):
    chunks = table(spark, d, "chunk_meta").dropDuplicates(["chunk_key"])
    gone = corpus(spark, d).filter("type = 2").select(F.col("id").alias("doc_id"))
    return chunks.join(gone, "doc_id", "left_anti").select("chunk_key")


# ---------------------------------------------------------------- rules, versions, state


@entry("f31_rules", "SELECT rec_id, regexp_matches(url, '(velmora)|(/note)') AS skipped, regexp_matches(url, '(\\.test/)') AS versioned FROM indexed_docs")
def f31(spark, d):
    return saved(spark, d).select("rec_id", ingest.any_rule(F.col("url"), ["velmora", "/note"]).alias("skipped"), ingest.any_rule(F.col("url"), [r"\.test/"]).alias("versioned"))


SECRET = {"load_call": r"load_[a-z]+\(limit=\d+\)", "cloud_key": r"AKIA[0-9A-Z]{16}"}
entry("f32_sensitive", "SELECT rec_id FROM indexed_docs WHERE coalesce(regexp_matches(coalesce(html, text), '(load_[a-z]+\\(limit=\\d+\\))|(AKIA[0-9A-Z]{16})'), false) OR coalesce(regexp_matches(text, '(load_[a-z]+\\(limit=\\d+\\))|(AKIA[0-9A-Z]{16})'), false)")(lambda spark, d: saved(spark, d).filter(ingest.sensitive(F.col("html"), F.col("text"), SECRET)).select("rec_id"))


@entry("j12_first_directory", "SELECT rec_id, CASE WHEN starts_with(url, 'file:///srv/notes/') THEN 'notes' WHEN starts_with(url, 'file:///srv/') THEN 'other' END AS dir_label FROM indexed_docs WHERE type = 1")
def j12(spark, d):
    return files.first_directory(saved(spark, d).filter("type = 1"), [("/srv/notes", "notes"), ("/srv", "other")]).select("rec_id", "dir_label")


@entry("a11_version_counts", "SELECT id, count(*) AS versions FROM indexed_docs WHERE id IS NOT NULL GROUP BY id")
def a11(spark, d):
    return saved(spark, d).filter("id is not null").groupBy("id").agg(F.count("*").alias("versions"))


@entry("n04_version_chain", "SELECT rec_id, row_number() OVER (PARTITION BY id ORDER BY updated, ingested_at, rec_id)::INTEGER AS version, coalesce(lag(text) OVER (PARTITION BY id ORDER BY updated, ingested_at, rec_id), '') = coalesce(text, '') AS same FROM indexed_docs WHERE id IS NOT NULL")
def n04(spark, d):
    v = ingest.versions(saved(spark, d))
    return v.select("rec_id", "version", (F.coalesce("previous", F.lit("")) == F.coalesce("text", F.lit(""))).alias("same"))


@entry("c18_patches_undone", "SELECT rec_id, coalesce(lag(text) OVER (PARTITION BY id ORDER BY updated, ingested_at, rec_id), '') AS restored FROM indexed_docs WHERE id IN (SELECT id FROM indexed_docs GROUP BY id HAVING count(*) > 1) QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated, ingested_at, rec_id) > 1")
def c18(spark, d):
    v = ingest.versions(saved(spark, d)).filter("version > 1")
    return v.select("rec_id", ingest.undone("text", F.array("patch")).alias("restored"))


@entry("m14_index_metadata", "SELECT min(length(language)) AS version, count(DISTINCT user_id) = 1 AS agree FROM indexed_docs")
def m14(spark, d):
    return saved(spark, d).agg(F.min(F.length("language")).alias("version"), (F.count_distinct("user_id") == 1).alias("agree"))


@entry("m15_expired", "SELECT hist_id FROM hist WHERE updated_at < TIMESTAMP '2024-06-01'", "hist")
def m15(spark, d):
    from larkspan.catalogue.history import hist

    return hist(spark, d).filter("updated_at < timestamp_ntz'2024-06-01'").select("hist_id")


# ---------------------------------------------------------------- queues over finished logs


@entry("r01_debounced", "SELECT path, count(*) AS bursts, sum(changes)::BIGINT AS changes FROM (SELECT path, burst, count(*) AS changes FROM (SELECT path, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM (SELECT props AS path, ts, event_id, coalesce(ts - lag(ts) OVER (PARTITION BY props ORDER BY ts, event_id) >= INTERVAL 200 MILLISECONDS, true) AS gap FROM events)) GROUP BY 1, 2) GROUP BY 1")
def r01(spark, d):
    e = table(spark, d, "events").select(F.col("props").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("op"))
    return queues.debounced(e).groupBy("path").agg(F.count("*").alias("bursts"), F.sum("changes").alias("changes"))


@entry("r02_pending_ops", LAST)
def r02(spark, d):
    return ingest.last_ops(_ops(spark, d))


@entry("r03_removals_off", "SELECT count(*) AS n FROM events WHERE event_type <> 'error'")
def r03(spark, d):
    return queues.removals(_ops(spark, d), False).agg(F.count("*").alias("n"))


@entry("r04_embedding_queue")
def r04(spark, d):
    op = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "purchase", "done").otherwise("add")
    ops = table(spark, d, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.col("event_id").alias("seq"), op.alias("op"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return queues.replayed_queue(ops)


@entry("r05_retry_delays", "SELECT i::INTEGER AS attempt, least(60, 1 << (i - 1)::INT)::INTEGER AS seconds FROM range(1, 11) r(i)")
def r05(spark, d):
    return spark.createDataFrame([(i, queues.delay(i)) for i in range(1, 11)], "attempt int, seconds int")


@entry("r06_changed_texts", "SELECT rec_id FROM corpus WHERE text IS NULL OR (id, sha256(text)) NOT IN (SELECT (id, sha256(text)) FROM indexed_docs WHERE rec_id % 2 = 0 AND text IS NOT NULL)", "corpus")
def r06(spark, d):
    done = saved(spark, d).filter("rec_id % 2 = 0").select("id", F.sha2("text", 256).alias("text_hash"))
    return queues.changed_texts(corpus(spark, d), done).select("rec_id")


@entry("r07_visit_counts", "SELECT user_id, event_type AS query, count(*) AS visits, max(ts) AS last_at FROM events GROUP BY 1, 2")
def r07(spark, d):
    return queues.visit_counts(table(spark, d, "events").select("user_id", F.col("event_type").alias("query"), "ts"))


@entry("r10_capture_times")
def r10(spark, d):
    cases = [[0], [0, 5], [0, 5, 9, 14, 20, 26, 33, 41], [0, 100]]
    return spark.createDataFrame([(c, queues.capture_times(c)) for c in cases], "changes array<int>, captures array<int>")


@entry("ext_windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext(spark, d):
    w = queues.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day")
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
