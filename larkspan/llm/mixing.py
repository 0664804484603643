"""Problem 8: a mixture of sources with target shares of the total size in tokens.

Method: Poisson replication. Every source's rate is its target size over its own size; a document's number of copies
inverts the distribution function of a Poisson variable, cut off at the source's largest number of repeats, at a
uniform number hashed from the document's key; the variable's parameter is set so that the cut-off mean is the rate.
Documents are exploded by their copies and put in a global random order. The draw of a document depends only on its
key and the seed, not on partitions or on other documents.

The size of the mixture is the largest at which every source that has documents can reach its share without going over
its repeats, unless ``total_tokens`` is given; then sources that can't reach theirs give all they may and the report
says so.

Scale: sizes are one map over the texts (kept as a narrow checkpoint), one combined aggregate by source, a broadcast of
the target table (counted first), and one range shuffle of the mixture; a source with most of the rows is no hot key.

Defined results: documents of a null source or one without a target are left out; null and empty texts have 0 tokens and
are drawn like any other; a target without documents is reported with 0; null or non-positive shares or repeats give
nothing; repeated rows of a key are drawn alike. Extra columns are kept by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import bpe
from larkspan.runtime import checkpoint

SEED = 20240607


def cut_mean(lam: float, cap: int) -> float:
    """Mean of a Poisson variable cut off at ``cap``."""
    p, total, mean = math.exp(-lam), 0.0, 0.0
    for k in range(cap):
        mean += k * p
        total += p
        p *= lam / (k + 1)
    return mean + cap * (1 - total)


def parameter(rate: float, cap: int) -> float:
    """The parameter whose cut-off mean is ``rate`` (below ``cap``), by bisection."""
    lo, hi = 0.0, max(1.0, rate)
    while cut_mean(hi, cap) < rate and hi < 700:
        hi *= 2
    hi = min(hi, 700.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cut_mean(mid, cap) < rate else (lo, mid)
    return hi


def steps(rate: float, cap: int) -> list[float]:
    """Distribution function at 0 .. cap - 1: a uniform number's copies are how many of these it reaches."""
    if rate >= cap * (1 - 1e-9):
        return [0.0] * cap
    lam = parameter(rate, cap)
    out, p, total = [], math.exp(-lam), 0.0
    for k in range(cap):
        total += p
        out.append(total)
        p *= lam / (k + 1)
    return out


def rates(sizes: dict[str, int], targets: list[tuple[str, float, int]], total_tokens: float | None = None) -> dict[str, float]:
    """Mean copies of a document by source."""
    use = [(s, share, cap) for s, share, cap in targets if share and share > 0 and cap and cap > 0 and sizes.get(s)]
    if not use:
        return {}
    total = total_tokens or min(sizes[s] * cap / share for s, share, cap in use)
    return {s: min(share * total / sizes[s], float(cap)) for s, share, cap in use}


def plan(counted: DataFrame, targets: DataFrame, total_tokens: float | None, source: str) -> list[tuple]:
    """(source, share, cap, documents, tokens, rate) of every target: one row for each row of the target table."""
    goal = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None]
    named = [g[0] for g in goal]
    have = {r["s"]: (r["docs"], r["tokens"]) for r in counted.filter(F.col(source).isin(named)).groupBy(F.col(source).alias("s")).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).collect()} if named else {}
    rate = rates({s: v[1] for s, v in have.items()}, goal, total_tokens)
    return [(s, share, cap, *have.get(s, (0, 0)), rate.get(s, 0.0)) for s, share, cap in goal]


def _drawn(counted: DataFrame, rows: list[tuple], doc: str, source: str, seed: int) -> DataFrame:
    spark = counted.sparkSession
    table = spark.createDataFrame([(s, steps(rate, cap)) for s, _, cap, _, _, rate in rows if rate > 0], "__s string, __steps array<double>")
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(doc)), F.lit(1 << 53)) / float(1 << 53)
    # as many rows as the target table has
    joined = counted.join(F.broadcast(table), counted[source] == table["__s"])
    return joined.withColumn("__copies", F.size(F.filter("__steps", lambda c: c <= u))).drop("__s", "__steps").filter("__copies > 0")


def mix(docs: DataFrame, targets: DataFrame, doc: str = "doc_id", source: str = "source", text: str = "text", total_tokens: float | None = None, seed: int = SEED, tokenizer: str = bpe.TOKENIZER, keep: list[str] | None = None) -> DataFrame:
    """The mixture in a global random order: ``keep`` (all columns if None), ``n_tokens``, ``copy_no`` from 1, ``mix_key``."""
    narrow = checkpoint(bpe.with_token_count(docs, [doc, source], text, tokenizer))
    rows = plan(narrow, targets, total_tokens, source)
    if keep is not None and set(keep) <= {doc, source}:
        counted = narrow
    else:
        counted = bpe.with_token_count(docs.withColumn("__t", F.col(text)), keep or docs.columns, "__t", tokenizer)
    copies = _drawn(counted, rows, doc, source, seed).withColumn("copy_no", F.explode(F.sequence(F.lit(1), "__copies"))).drop("__copies")
    return copies.withColumn("mix_key", F.xxhash64(F.lit(seed + 1), F.col(doc), "copy_no")).repartitionByRange("mix_key").sortWithinPartitions("mix_key")


def shares(docs: DataFrame, targets: DataFrame, doc: str = "doc_id", source: str = "source", text: str = "text", total_tokens: float | None = None, seed: int = SEED, tokenizer: str = bpe.TOKENIZER) -> DataFrame:
    """The report, one row for each target: what it has, the mean copies asked for, and the size and share reached."""
    counted = checkpoint(bpe.with_token_count(docs, [doc, source], text, tokenizer))
    rows = plan(counted, targets, total_tokens, source)
    used = _drawn(counted, rows, doc, source, seed).groupBy(source).agg(F.count("*").alias("used_docs"), F.sum("__copies").cast("long").alias("copies"), F.max("__copies").alias("most_copies"), F.sum(F.col("__copies") * F.col("n_tokens")).cast("long").alias("tokens"))
    goal = docs.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, source_docs long, source_tokens long, rate double")
    both = goal.join(used.withColumnRenamed(source, "__s"), goal["source"] == F.col("__s"), "left").drop("__s").na.fill(0, ["used_docs", "copies", "most_copies", "tokens"])
    total = both.agg(F.sum("tokens").alias("__total"))
    share = F.when(F.col("__total") > 0, F.col("tokens") / F.col("__total")).otherwise(0.0)
    return both.join(F.broadcast(total)).select("source", "target_share", "max_repeats", "source_docs", "source_tokens", F.round("rate", 6).alias("rate"), (F.col("rate") >= F.col("max_repeats")).alias("at_most_repeats"), "used_docs", "copies", "most_copies", "tokens", F.round(share, 6).alias("actual_share"))
