"""Crawling: url validation, the frontier, breadth-first visits over a link table, status counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import text as T
from larkspan.runtime import checkpoint

STATUSES = ("pending", "in_progress", "done", "failed", "skipped")
RULES = "max_links long, max_depth int, allowed_domains array<string>, exclude_domains array<string>, allowed_patterns array<string>, exclude_patterns array<string>"


def with_rules(urls: DataFrame, jobs: DataFrame) -> DataFrame:
    """Frontier rows with the parsed rules of their job. The job table is the small side; the optimiser sizes it."""
    rules = jobs.select("job_id", F.from_json("validator_rules", RULES).alias("r")).select("job_id", "r.*")
    return urls.join(rules, "job_id", "left")


def validate(urls: DataFrame, url: str = "url", depth: str = "depth", order: str = "crawl_id", per: str = "job_id") -> DataFrame:
    """``verdict`` of each url by its job's rules, in order: ``stop`` once max_links are allowed, ``skip``, else ``allow``.

    Only the running count of allowed urls is a window, over narrow rows; limits of 0 and empty lists don't bind.
    """
    host = T.host(F.col(url))
    in_domain = lambda ds: F.exists(ds, lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))
    matches = lambda ps: F.exists(ps, lambda p: F.col(url).rlike(p) if isinstance(p, str) else F.regexp_like(F.col(url), p))
    listed = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    hit = lambda c: F.coalesce(c, F.lit(False))
    skip = (
        hit((F.col("max_depth") > 0) & (F.col(depth) > F.col("max_depth")))
        | hit(in_domain(F.col("exclude_domains")))
        | (listed(F.col("allowed_domains")) & ~hit(in_domain(F.col("allowed_domains"))))
        | hit(matches(F.col("exclude_patterns")))
        | (listed(F.col("allowed_patterns")) & ~hit(matches(F.col("allowed_patterns"))))
    )
    before = Window.partitionBy(per).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = urls.withColumn("__skip", skip)
    x = x.withColumn("__before", F.coalesce(F.sum((~F.col("__skip")).cast("long")).over(before), F.lit(0)))
    stop = hit((F.col("max_links") > 0) & (F.col("__before") >= F.col("max_links")))
    return x.withColumn("verdict", F.when(stop, "stop").when(F.col("__skip"), "skip").otherwise("allow")).drop("__skip", "__before")


def frontier(links: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Distinct new urls that haven't been seen."""
    return links.select(url).distinct().join(seen.select(url), url, "left_anti")


def breadth_first(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """``(url, depth)`` by fewest links from the roots. ``edges`` are (src, dst); each depth is one join and one anti-join
    against what is seen, its result a checkpoint."""
    seen = checkpoint(roots.select("url").distinct().withColumn("depth", F.lit(0)))
    level = seen
    for d in range(1, max_depth + 1):
        out = edges.join(level.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        level = checkpoint(out.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
        if not level.limit(1).count():
            break
        seen = seen.unionByName(level)
    return seen


def status_counts(urls: DataFrame) -> DataFrame:
    """Per job one count for each status, in one pass."""
    return urls.groupBy("job_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total"))


def unfinished(urls: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs that aren't done and have pending or running urls."""
    left = status_counts(urls).filter("pending + in_progress > 0").select("job_id", (F.col("pending") + F.col("in_progress")).alias("left"))
    return jobs.filter("status != 'done'").join(left, "job_id")


def distinct_urls(urls: DataFrame) -> DataFrame:
    """One row for each (job, url): the one changed last."""
    w = Window.partitionBy("job_id", "url").orderBy(F.desc_nulls_last("updated_at"), F.desc("crawl_id"))
    return urls.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def unique_name(base: str, taken: list[str]) -> str:
    """``base``, or the first free of base-2, base-3, ..."""
    n, name = 1, base
    while name in set(taken):
        n += 1
        name = f"{base}-{n}"
    return name


def robots_allowed(path: str, rules: list[tuple[bool, str]]) -> bool:
    """Longest matching rule (allow beats disallow on a tie); without one, allowed."""
    best = max(((len(p), allow) for allow, p in rules if p and path.startswith(p)), default=(0, True))
    return best[1]
