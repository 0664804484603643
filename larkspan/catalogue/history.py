"""Visit history, timelines, suggestions, crawl bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.catalogue import NOW, entry
from larkspan.catalogue.searching import corpus
from larkspan.operators import crawl
from larkspan.operators import history as H
from larkspan.operators import semantic
from larkspan.runtime import checkpoint, table


def hist(spark, d):
    return H.latest(table(spark, d, "search_history"))


def busiest(spark, d, by="user_id"):
    """The value that most entries have, ties to the smallest."""
    return hist(spark, d).groupBy(by).count().orderBy(F.desc("count"), by).first()[0]


TITLES = ", titles AS (SELECT url, arg_max(title, (updated_at, hist_id)) AS title FROM hist WHERE title IS NOT NULL AND trim(title) <> '' GROUP BY url)"
USER = "(SELECT user_id FROM hist GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1)"
QUERY = "(SELECT query FROM hist WHERE user_id = u.user_id GROUP BY 1 ORDER BY count(*) DESC, query LIMIT 1)"
TOP = f"""{TITLES}, u AS (SELECT {USER} AS user_id), uq AS (SELECT user_id, {QUERY} AS query FROM u)
SELECT h.url, t.title, bool_or(pinned) AS pinned, sum(count)::BIGINT AS count, max(updated_at) AS updated_at
FROM hist h JOIN uq ON h.user_id = uq.user_id AND h.query = uq.query LEFT JOIN titles t ON h.url = t.url
GROUP BY 1, 2 ORDER BY pinned DESC, count DESC, updated_at DESC, h.url LIMIT 20"""


def _top(spark, d):
    h = hist(spark, d)
    user = busiest(spark, d)
    q = h.filter(F.col("user_id") == user).groupBy("query").count().orderBy(F.desc("count"), "query").first()[0]
    return H.links_of_query(*H.star(h), user, q)


entry("j01_links_of_query", TOP, "hist")(_top)
entry("o10_top_links", TOP, "hist")(_top)

OPENED = f"""{TITLES} SELECT hist_id, query, h.url, t.title, count, pinned, updated_at FROM hist h LEFT JOIN titles t ON h.url = t.url
WHERE user_id = {USER}"""


@entry("j02_latest_opened", f"{OPENED} ORDER BY updated_at DESC, hist_id DESC LIMIT 100", "hist")
def j02(spark, d):
    return H.opened(*H.star(hist(spark, d)), busiest(spark, d))


@entry("o09_history_cursor", f"{OPENED} ORDER BY updated_at DESC, hist_id DESC LIMIT 20 OFFSET 20", "hist")
def o09(spark, d):
    star, user = H.star(hist(spark, d)), busiest(spark, d)
    first = H.opened(*star, user, n=20).collect()  # a page of twenty
    last = first[-1]
    return H.opened(*star, user, before=(last["updated_at"], last["hist_id"]), n=20)


@entry("f30_history_filter", f"{OPENED} AND (contains(lower(h.url), 'velmora') OR coalesce(contains(lower(t.title), 'velmora'), false)) ORDER BY updated_at DESC, hist_id DESC LIMIT 100", "hist")
def f30(spark, d):
    return H.opened(*H.star(hist(spark, d)), busiest(spark, d), "Velmora")


SUGGEST = "SELECT query, sum(count)::BIGINT AS uses FROM hist WHERE starts_with(lower(query), 'l') GROUP BY 1 ORDER BY uses DESC, query LIMIT 1"
entry("j03_prefix_suggestion", SUGGEST, "hist")(lambda spark, d: H.suggest(hist(spark, d), "L"))
entry("c22_suggest_query", SUGGEST.replace("'l'", "'st'"), "hist")(lambda spark, d: H.suggest(hist(spark, d), "st"))


@entry("j04_delete_links", f"SELECT hist_id FROM hist WHERE NOT (user_id = {USER} AND contains(url, 'velmora'))", "hist")
def j04(spark, d):
    h = hist(spark, d)
    gone = h.filter((F.col("user_id") == busiest(spark, d)) & F.col("url").contains("velmora")).select("hist_id")
    return h.join(gone, "hist_id", "left_anti").select("hist_id")


@entry("j10_opened_with_visits", "SELECT h.hist_id, h.url, greatest(coalesce(c.n, 1), 1) AS add_count FROM hist h LEFT JOIN (SELECT url, max(add_count) AS n FROM corpus GROUP BY url) c ON h.url = c.url", "hist corpus")
def j10(spark, d):
    counts = corpus(spark, d).groupBy("url").agg(F.max("add_count").alias("n"))
    return hist(spark, d).join(counts, "url", "left").select("hist_id", "url", F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).cast("long").alias("add_count"))


@entry("j06_documents_less_history", "SELECT rec_id FROM corpus WHERE url NOT IN (SELECT url FROM hist WHERE url IS NOT NULL)", "hist corpus")
def j06(spark, d):
    return H.fuse(corpus(spark, d).filter("url is not null"), hist(spark, d))[1].select("rec_id")


@entry("j06_history_with_document", "SELECT h.hist_id, c.id FROM hist h LEFT JOIN (SELECT url, min(id) AS id FROM corpus GROUP BY url) c ON h.url = c.url", "hist corpus")
def j06b(spark, d):
    return H.fuse(corpus(spark, d), hist(spark, d))[0].select("hist_id", "id")


UNION3 = """, h AS (SELECT url, min(hist_id) AS rank FROM hist GROUP BY url),
k AS (SELECT url, min(rec_id) AS rank FROM corpus WHERE type = 0 GROUP BY url),
every AS (SELECT url, rank, 0 AS source_no FROM h UNION ALL SELECT url, rank, 1 FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_no, rank) AS n FROM every)
SELECT url, rank, source_no FROM r WHERE n = 1"""


def _union(spark, d):
    h = hist(spark, d).groupBy("url").agg(F.min("hist_id").alias("rank"))
    k = corpus(spark, d).filter("type = 0").groupBy("url").agg(F.min("rec_id").alias("rank"))
    return semantic.ordered_union([h, k])


entry("j09_ordered_union", UNION3, "hist corpus")(_union)
entry("u03_distinct_by_url", f"SELECT source_no, count(*) AS n FROM ({UNION3.lstrip(', ').replace('h AS (', 'WITH h AS (', 1)}) GROUP BY 1".replace("FROM hist", "FROM (SELECT * FROM search_history)").replace("FROM corpus", "FROM indexed_docs"))(lambda spark, d: _union(spark, d).groupBy("source_no").agg(F.count("*").alias("n")))


@entry("a15_visit_counter", "SELECT user_id, event_type AS query, props AS url, count(*) AS count, max(ts) AS updated_at FROM events GROUP BY 1, 2, 3")
def a15(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("query"), F.col("props").alias("url"), F.col("ts").alias("updated_at"))
    return H.visits(e)


@entry("a16_stats", "SELECT (SELECT count(*) FROM corpus) AS documents, 3 AS rules, 2 AS aliases, (SELECT string_agg(hist_id::VARCHAR, ',' ORDER BY updated_at DESC, hist_id DESC) FROM (SELECT * FROM hist ORDER BY updated_at DESC, hist_id DESC LIMIT 5)) AS last_history", "hist corpus")
def a16(spark, d):
    last = hist(spark, d).orderBy(F.desc("updated_at"), F.desc("hist_id")).limit(5).agg(F.sort_array(F.collect_list(F.struct("updated_at", "hist_id")), asc=False).alias("l"))
    joined = last.select(F.array_join(F.transform("l", lambda x: x["hist_id"].cast("string")), ",").alias("last_history"))
    n = corpus(spark, d).count()
    return joined.select(F.lit(n).cast("long").alias("documents"), F.lit(3).alias("rules"), F.lit(2).alias("aliases"), "last_history")


@entry("a18_distinct_urls", "SELECT DISTINCT url FROM search_history")
def a18(spark, d):
    return table(spark, d, "search_history").select("url").distinct()


@entry("m12_pin", f"SELECT hist_id, pinned OR (user_id = {USER} AND contains(url, 'velmora')) AS pinned FROM hist", "hist")
def m12(spark, d):
    h, user = hist(spark, d), busiest(spark, d)
    same = (F.col("user_id") == user) & F.col("url").contains("velmora")
    return h.select("hist_id", F.when(same, True).otherwise(F.col("pinned")).alias("pinned"))


@entry("m12_pin_new_link", "SELECT count(*) + 1 AS n, sum(pinned::INT)::BIGINT + 1 AS pinned FROM hist", "hist")
def m12b(spark, d):
    h = H.pin(hist(spark, d), -1, "nobody's query", "https://nowhere.example/", True)
    return h.agg(F.count("*").alias("n"), F.sum(F.col("pinned").cast("int")).alias("pinned"))


@entry("m13_refreshed_titles", f"{TITLES} SELECT url, title FROM titles", "hist")
def m13(spark, d):
    return H.star(hist(spark, d))[1].filter("title is not null").select("url", "title")


# ---------------------------------------------------------------- document history and timelines


@entry("f28_history_substring", "SELECT rec_id FROM pad WHERE coalesce(contains(lower(url), 'stad'), false) OR title_p LIKE '% stad %' OR list_bool_or([contains(w, 'stad') FOR w IN title_w])", "pad")
def f28(spark, d):
    return H.document_filter(corpus(spark, d), "stad").select("rec_id")


@entry("f29_history_half_open", "SELECT rec_id FROM corpus WHERE updated >= 1717200000 AND updated < 1725148800", "corpus")
def f29(spark, d):
    return H.document_filter(corpus(spark, d), "", 1717200000, 1725148800).select("rec_id")


BUCKETS = """, now AS (SELECT TIMESTAMP '2025-01-01' AS t),
days AS (SELECT 'day:' || strftime(t - to_days(i::INT), '%Y-%m-%d') AS bucket, epoch(t - to_days(i::INT)) AS lo, epoch(t - to_days(i::INT - 1)) AS hi FROM now, range(7) r(i)),
cut AS (SELECT t - to_days(6) AS c FROM now),
older AS (SELECT 'older' AS bucket, NULL AS lo, epoch(c) AS hi FROM cut),
old AS (SELECT min({0}) AS o FROM {1}),
months AS (SELECT 'month:' || strftime(m, '%Y-%m') AS bucket, epoch(m) AS lo, least(epoch(m + INTERVAL 1 MONTH), (SELECT epoch(c) FROM cut)) AS hi
  FROM (SELECT date_trunc('month', c) - to_months(i::INT) AS m FROM cut, range(60) r(i)), old WHERE epoch(m + INTERVAL 1 MONTH) > o AND epoch(m) < (SELECT epoch(c) FROM cut)),
b AS (SELECT * FROM days UNION ALL SELECT * FROM older UNION ALL SELECT * FROM months)
SELECT bucket, (SELECT count(*) FROM {1} WHERE (lo IS NULL OR {0} >= lo) AND {0} < hi) AS n FROM b"""


def _timeline(spark, d):
    docs = corpus(spark, d)
    oldest = docs.agg(F.min("updated").alias("o")).first()["o"]
    return H.count_buckets(docs, "updated", H.timeline_buckets(NOW, oldest))


entry("a05_timeline", BUCKETS.format("updated", "corpus"), "corpus")(_timeline)
entry("j11_bucket_containment", BUCKETS.format("updated", "corpus"), "corpus")(_timeline)


@entry("a06_days_of_window", "SELECT 'day:' || strftime(TIMESTAMP '2024-11-03' + to_days(i::INT), '%Y-%m-%d') AS bucket, (SELECT count(*) FROM corpus WHERE updated >= greatest(epoch(TIMESTAMP '2024-11-03' + to_days(i::INT)), 1730592000 + 7200) AND updated < least(epoch(TIMESTAMP '2024-11-04' + to_days(i::INT)), 1732752000)) AS n FROM range(25) r(i)", "corpus")
def a06(spark, d):
    return H.count_buckets(corpus(spark, d), "updated", H.day_buckets(1730592000 + 7200, 1732752000))


@entry("a08_timeline_of_opened", BUCKETS.format("epoch(updated_at)", "hist"), "hist")
def a08(spark, d):
    rows = hist(spark, d).select(F.unix_seconds(F.col("updated_at").cast("timestamp")).alias("updated"))
    oldest = rows.agg(F.min("updated").alias("o")).first()["o"]
    return H.count_buckets(rows, "updated", H.timeline_buckets(NOW, oldest))


# ---------------------------------------------------------------- crawling


def urls(spark, d):
    return crawl.distinct_urls(table(spark, d, "crawl_urls"))


@entry("o14_next_pending", "SELECT crawl_id, job_id, url FROM urls WHERE status = 'pending' ORDER BY crawl_id LIMIT 1", "urls")
def o14(spark, d):
    return urls(spark, d).filter("status = 'pending'").orderBy("crawl_id").limit(1).select("crawl_id", "job_id", "url")


@entry("o15_claim_oldest", "SELECT crawl_id, created_at FROM urls WHERE status = 'pending' ORDER BY created_at, crawl_id LIMIT 1", "urls")
def o15(spark, d):
    return urls(spark, d).filter("status = 'pending'").orderBy("created_at", "crawl_id").limit(1).select("crawl_id", "created_at")


@entry("o16_jobs_newest_first", "SELECT job_id, created_at FROM crawl_jobs ORDER BY created_at DESC, job_id LIMIT 10")
def o16(spark, d):
    return table(spark, d, "crawl_jobs").orderBy(F.desc("created_at"), "job_id").limit(10).select("job_id", "created_at")


@entry("m11_failed_urls", "SELECT crawl_id, url, error_code, nullif(error, '') AS error FROM urls WHERE status = 'failed'", "urls")
def m11(spark, d):
    return urls(spark, d).filter("status = 'failed'").select("crawl_id", "url", "error_code", F.nullif("error", F.lit("")).alias("error"))


COUNTS = "SELECT job_id, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in crawl.STATUSES) + ", count(*) AS total FROM urls GROUP BY job_id"
entry("a09_status_counts", COUNTS, "urls")(lambda spark, d: crawl.status_counts(urls(spark, d)))


@entry("a10_count_urls", "SELECT status, count(*) AS n FROM urls GROUP BY status", "urls")
def a10(spark, d):
    return urls(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@entry("m10_unfinished_jobs", f', c AS ({COUNTS}) SELECT j.job_id, c.pending + c.in_progress AS "left" FROM crawl_jobs j JOIN c USING (job_id) WHERE j.status <> \'done\' AND c.pending + c.in_progress > 0', "urls")
def m10(spark, d):
    return crawl.unfinished(urls(spark, d), table(spark, d, "crawl_jobs")).select("job_id", "left")


VALID = """, r AS (
  SELECT u.*, (validator_rules::JSON->>'max_links')::BIGINT AS max_links, (validator_rules::JSON->>'max_depth')::INT AS max_depth
  FROM urls u LEFT JOIN crawl_jobs USING (job_id)),
s AS (SELECT *, coalesce(max_depth > 0 AND depth > max_depth, false) AS skip FROM r),
t AS (SELECT *, coalesce(sum(CASE WHEN skip THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY crawl_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT crawl_id, CASE WHEN coalesce(max_links > 0 AND before >= max_links, false) THEN 'stop' WHEN skip THEN 'skip' ELSE 'allow' END AS verdict FROM t"""


def _validated(spark, d):
    return crawl.validate(crawl.with_rules(urls(spark, d), table(spark, d, "crawl_jobs"))).select("crawl_id", "verdict")


entry("f33_validate_urls", VALID, "urls")(_validated)
entry("n03_running_stop", VALID.replace("SELECT crawl_id, CASE", "SELECT verdict, count(*) AS n FROM (SELECT CASE") + ") GROUP BY 1", "urls")(lambda spark, d: _validated(spark, d).groupBy("verdict").agg(F.count("*").alias("n")))


@entry("f34_robots", "SELECT crawl_id, NOT (url LIKE '%/a/%' AND url NOT LIKE '%/a/b%') AS allowed FROM urls", "urls")
def f34(spark, d):
    """Rules ``Disallow: /a/`` and ``Allow: /a/b`` in one place: the longer match wins."""
    path = F.col("url")
    return urls(spark, d).select("crawl_id", (~(path.contains("/a/") & ~path.contains("/a/b"))).alias("allowed"))


@entry("j13_frontier", "SELECT DISTINCT url FROM urls WHERE status = 'pending' AND url NOT IN (SELECT url FROM urls WHERE status IN ('done', 'failed', 'skipped'))", "urls")
def j13(spark, d):
    u = urls(spark, d)
    return crawl.frontier(u.filter("status = 'pending'"), u.filter(F.col("status").isin("done", "failed", "skipped")))


EDGES = """, n AS (SELECT crawl_id, job_id, url, depth, row_number() OVER (PARTITION BY job_id, depth ORDER BY crawl_id) AS i FROM urls),
e AS (SELECT a.url AS src, b.url AS dst FROM n a JOIN n b ON a.job_id = b.job_id AND b.depth = a.depth + 1 AND b.i IN (2 * a.i, 2 * a.i + 1)),
l0 AS (SELECT DISTINCT url FROM urls WHERE depth = 0),
l1 AS (SELECT DISTINCT dst AS url FROM e WHERE src IN (FROM l0) AND dst NOT IN (FROM l0)),
l2 AS (SELECT DISTINCT dst AS url FROM e WHERE src IN (FROM l1) AND dst NOT IN (FROM l0) AND dst NOT IN (FROM l1)),
l3 AS (SELECT DISTINCT dst AS url FROM e WHERE src IN (FROM l2) AND dst NOT IN (FROM l0) AND dst NOT IN (FROM l1) AND dst NOT IN (FROM l2))
SELECT url, 0 AS depth FROM l0 UNION ALL SELECT url, 1 FROM l1 UNION ALL SELECT url, 2 FROM l2 UNION ALL SELECT url, 3 FROM l3"""


@entry("r08_breadth_first", EDGES, "urls")
def r08(spark, d):
    """Links are derived from the crawl log: the i-th url of a depth links to the two at 2i and 2i + 1 of the next."""
    from pyspark.sql import Window

    n = checkpoint(urls(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("job_id", "depth").orderBy("crawl_id"))).select("job_id", "url", "depth", "i"))
    b = n.select("job_id", F.col("url").alias("dst"), (F.col("depth") - 1).alias("depth"), F.floor(F.col("i") / 2).alias("i"))
    edges = checkpoint(n.join(b, ["job_id", "depth", "i"]).select(F.col("url").alias("src"), "dst").distinct())
    return crawl.breadth_first(edges, n.filter("depth = 0"), 3)


@entry("m09_unique_names")
def m09(spark, d):
    names = [r["label"] for r in table(spark, d, "crawl_jobs").filter("label is not null").select("label").collect()]
    taken: list[str] = []
    for n in names:
        taken.append(crawl.unique_name(n, taken))
    return spark.createDataFrame([(n,) for n in taken], "name string")
