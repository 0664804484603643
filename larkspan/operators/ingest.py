"""Ingest: upserts, batches, deletions, blobs, rules, reindexing, versions."""

from __future__ import annotations

import difflib
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larkspan.functions import text as T

MOST_OPS = 100
#: Our own patterns of content that must not be stored, by name.
SENSITIVE = {
    "cloud_key": r"\bAKIA[0-9A-Z]{16}\b",
    "code_host_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "chat_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "signed_token": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "assigned_secret": r"(?i)\b(?:api[_-]?key|secret|token|password)\s*[=:]\s*[\"'][A-Za-z0-9_/+-]{16,}[\"']",
}


def any_rule(c: Column, patterns: list[str]) -> Column:
    """Whether any of the (unanchored) patterns is found; no patterns, never."""
    return F.coalesce(c.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)


def sensitive(html: Column, text: Column, patterns: dict[str, str] | None = None) -> Column:
    return any_rule(F.coalesce(html, text), list((patterns or SENSITIVE).values())) | any_rule(text, list((patterns or SENSITIVE).values()))


def stored_state(docs: DataFrame) -> DataFrame:
    """Per id over all stored copies: largest count, earliest real ``added``, first label, the languages they lie in."""
    label = F.when(F.trim("label") != "", F.col("label"))
    return docs.filter("id is not null").groupBy("id").agg(F.max("add_count").alias("add_count"), F.min(F.when(F.col("added") > 0, F.col("added"))).alias("added"), F.min_by(label, F.when(label.isNotNull(), F.struct("updated", "rec_id"))).alias("label"), F.count("*").alias("copies"))


def upsert(stored: DataFrame, incoming: DataFrame, now: int) -> DataFrame:
    """Stored documents and a batch of incoming ones, one row for each id.

    An id of the batch counts one visit more than stored (once for a batch, however often it is in there), keeps the
    earliest ``added`` and the stored label unless a new one comes; ``updated`` defaults to ``now``. Both sides are
    narrowed to one row for an id before the one full join.
    """
    last = Window.partitionBy("id").orderBy(F.desc("updated"), F.desc("rec_id"))
    one = lambda df: df.filter("id is not null").withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")
    old, new = one(stored), one(incoming)
    plain = [c for c in old.columns if c not in ("id", "add_count", "added", "updated", "label")]
    is_new = F.col("n.id").isNotNull()
    both = old.alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id"), "full")
    label = F.coalesce(F.when(F.trim("n.label") != "", F.col("n.label")), F.col("o.label"), F.col("n.label"))
    return both.select(
        F.coalesce("n.id", "o.id").alias("id"),
        F.when(is_new, F.coalesce(F.col("o.add_count"), F.lit(0)) + 1).otherwise(F.col("o.add_count")).cast("long").alias("add_count"),
        F.least(F.nullif(F.col("o.added"), F.lit(0)), F.nullif(F.col("n.added"), F.lit(0)), F.when(F.coalesce(F.nullif("o.added", F.lit(0)), F.nullif("n.added", F.lit(0))).isNull(), F.lit(now))).alias("added"),
        F.when(is_new, F.coalesce(F.nullif(F.col("n.updated"), F.lit(0)), F.lit(now))).otherwise(F.col("o.updated")).alias("updated"),
        label.alias("label"),
        *[F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in plain],
    )


def with_updated(docs: DataFrame) -> DataFrame:
    """``updated`` filled from ``added`` where it is missing."""
    return docs.withColumn("updated", F.coalesce(F.nullif("updated", F.lit(0)), F.col("added")))


def last_ops(ops: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Of each key the operation staged last."""
    return ops.groupBy(key).agg(F.max_by("op", seq).alias("op"), F.max(seq).alias(seq))


def apply_ops(docs: DataFrame, ops: DataFrame) -> DataFrame:
    """Documents less those that the last operation on them deletes."""
    return docs.join(last_ops(ops).filter("op = 'delete'").select(F.col("key").alias("id")), "id", "left_anti")


def op_status(ops: DataFrame, docs: DataFrame, skip: list[str]) -> DataFrame:
    """Status of each operation of a batch: 201 added, 406 skipped by a rule, 422 sensitive, 400 malformed, 200 found or
    deleted, 404 not there."""
    known = docs.select(F.col("id").alias("__id")).distinct()
    x = ops.join(known, ops["id"] == F.col("__id"), "left")
    status = (
        F.when(F.col("id").isNull() | (F.trim("id") == "") | ~F.col("op").isin("add", "get", "delete"), 400)
        .when(F.col("op") == "add", F.when(any_rule(F.col("id"), skip), 406).when(sensitive(F.lit(None).cast("string"), F.col("text")), 422).otherwise(201))
        .otherwise(F.when(F.col("__id").isNull(), 404).otherwise(200))
    )
    return x.select("seq", "op", "id", status.alias("status"))


def orphans(blobs: DataFrame, referring: DataFrame, key: str = "key") -> DataFrame:
    """Blobs that no document refers to."""
    return blobs.join(referring.select(key).distinct(), key, "left_anti")


def blob_table(docs: DataFrame, column: str = "html") -> DataFrame:
    """Content-addressed store of a column: ``(key, bytes, refs)``."""
    return docs.filter(F.col(column).isNotNull()).groupBy(T.blob_key(F.col(column)).alias("key")).agg(F.max(F.octet_length(column)).alias("bytes"), F.count("*").alias("refs"))


def prune_local(docs: DataFrame, directories: list[tuple[str, int]]) -> DataFrame:
    """``(id, status)`` of local documents: ``keep``, ``stale`` (no file url, or under no directory of its owner) or
    ``undecided`` (under a directory of an owner who isn't known: user 0)."""
    path = T.url_to_path(F.col("url"))
    inside = [(T.under(path, F.lit(d)), owner) for d, owner in directories]
    own = reduce(lambda a, b: a | b, [i & ((F.col("user_id") == o) | F.lit(o == 0)) for i, o in inside], F.lit(False))
    some = reduce(lambda a, b: a | b, [i for i, _ in inside], F.lit(False))
    status = F.when(~F.col("url").startswith("file://"), "stale").when(own, "keep").when(some & (F.col("user_id") == 0), "undecided").otherwise("stale")
    return docs.filter("type = 1").select("id", status.alias("status"))


def process(docs: DataFrame, skip: list[str]) -> DataFrame:
    """The document pipeline up to storage: url normalised, domain and id set, basic text where there is none, and why a
    row is rejected (``skip_rule``, ``sensitive``, ``no_url``) or null."""
    url = T.normalize_url(F.col("url"))
    text = F.coalesce(F.nullif(F.trim("text"), F.lit("")), T.basic_text(F.col("html")))
    rejected = F.when(F.coalesce(F.trim("url"), F.lit("")) == "", "no_url").when(any_rule(F.col("url"), skip), "skip_rule").when(sensitive(F.col("html"), F.col("text")), "sensitive")
    return docs.withColumn("reject", rejected).withColumn("text", text).withColumn("url", url).withColumn("domain", T.host(url)).withColumn("id", T.document_id(url, F.col("user_id")))


def reindex(docs: DataFrame, skip: list[str]) -> DataFrame:
    """All documents processed anew: rejected ones are gone, ``added`` and ``updated`` stay."""
    return process(with_updated(docs), skip).filter("reject is null").drop("reject")


# ---------------------------------------------------------------- versions


def make_patch(old: str, new: str) -> str:
    """What turns ``new`` back into ``old``: a JSON list of (start, end, text) by lines of ``new``."""
    a, b = new.split("\n"), old.split("\n")
    return json.dumps([[i1, i2, b[j1:j2]] for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal"])


def undo(new: str, patch: str) -> str:
    lines = new.split("\n")
    for i1, i2, put in reversed(json.loads(patch)):
        lines[i1:i2] = put
    return "\n".join(lines)


@F.pandas_udf(StringType())
def patch_of(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([make_patch(a or "", b or "") for a, b in zip(old, new)], dtype=object)


@F.pandas_udf(StringType())
def undone(new: pd.Series, patches: pd.Series) -> pd.Series:
    """The text before all of the patches, newest first."""
    return pd.Series([reduce(undo, ps if ps is not None else [], t or "") for t, ps in zip(new, patches)], dtype=object)


def versions(docs: DataFrame) -> DataFrame:
    """The chain of saves of each id: number, and the patch back to the save before."""
    w = Window.partitionBy("id").orderBy("updated", "ingested_at", "rec_id")
    chain = docs.filter("id is not null").select("id", "rec_id", "text", F.row_number().over(w).alias("version"), F.lag("text").over(w).alias("previous"))
    return chain.withColumn("patch", F.when(F.col("version") > 1, patch_of("previous", "text")))
