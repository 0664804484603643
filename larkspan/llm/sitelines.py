"""Problem 3: lines that one site repeats on very many of its pages.

Method: every source gets a mergeable summary of the lines it carries (hashed counters that only ever count too
much, so no frequent line can be missed); lines of heavy counters are candidates; a second pass counts those
exactly, over distinct records; confirmed lines are removed from each text with broadcast sets, or with a
shuffled join where the confirmed set is over the broadcast bound.

A line is keyed by (source, 64-bit hash of the normalised line); nothing is keyed by the source alone, so a
source with a third of all rows is spread over all tasks, and its counters are combined before the shuffle.

Defined results: records without a source (null or blank domain and no http url) and null or blank texts have no
repeated lines and keep their text; a line counts once for a record however often it occurs there; repeated rows
of a record count once. Extra columns pass through ``remove_repeated_lines`` untouched.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from larkspan.runtime import BROADCAST_ROWS, checkpoint, small, spread

MIN_RECORDS = 8
#: Counters of one source's summary. More lines than counters make the summary less selective, never wrong.
COUNTERS = 1 << 20


def source_of(domain: Column, url: Column) -> Column:
    """Domain in lower case without a leading ``www.``, else the host of an http(s) url, else null."""
    bare = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"^www\.", "")
    own = bare(F.regexp_replace(domain, r"(?U)^\s+|\s+$", ""))
    host = bare(F.regexp_extract(url, r"(?i)^\s*https?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(host, F.lit("")))


def normal_line(line: Column) -> Column:
    """Trimmed, white space to one space, lower case, digits 0-9 to ``#``."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, r"(?U)[\s\x1c-\x1f]+", " "))), "[0-9]+", "#")


def _hashed(df: DataFrame, rec: str, text: str, domain: str, url: str) -> DataFrame:
    """One row per record: its source's hash and the hashes of its lines, null for blank lines. Lines keep their places."""
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda x: F.nullif(normal_line(x), F.lit("")))
    keyed = spread(df.select(rec, text, domain, url), rec).select(F.col(rec).alias("rec"), source_of(F.col(domain), F.col(url)).alias("src"), lines.alias("lines")).filter("src is not null and lines is not null")
    return keyed.select("rec", F.xxhash64("src").alias("src"), F.transform("lines", lambda x: F.when(x.isNotNull(), F.xxhash64(x))).alias("hs"))


def _confirmed(hashed: DataFrame, min_records: int) -> DataFrame:
    """``(src, h)`` of the lines found in at least ``min_records`` distinct records of their source."""
    each = hashed.select("rec", "src", F.explode(F.array_distinct(F.array_compact("hs"))).alias("h"))
    counter = F.pmod("h", F.lit(COUNTERS)).cast("int")
    heavy = checkpoint(each.groupBy("src", counter.alias("c")).count().filter(F.col("count") >= min_records).select("src", "c"))
    candidates = each.withColumn("c", counter).join(small(heavy), ["src", "c"], "left_semi")
    return checkpoint(candidates.groupBy("src", "h").agg(F.count_distinct("rec").alias("n")).filter(F.col("n") >= min_records).select("src", "h"))


def repeated_lines(df: DataFrame, rec: str = "rec_id", text: str = "text", domain: str = "domain", url: str = "url", min_records: int = MIN_RECORDS) -> DataFrame:
    """``(rec, line_no)`` of every occurrence of a line that at least ``min_records`` records of its source have."""
    hashed = checkpoint(_hashed(df, rec, text, domain, url))
    lines = small(_confirmed(hashed, min_records))
    each = hashed.select("rec", "src", F.posexplode("hs").alias("line_no", "h")).filter("h is not null")
    return each.join(lines, ["src", "h"], "left_semi").select(F.col("rec").alias(rec), F.col("line_no").cast("int").alias("line_no")).distinct()


def remove_repeated_lines(df: DataFrame, rec: str = "rec_id", text: str = "text", domain: str = "domain", url: str = "url", min_records: int = MIN_RECORDS, out: str = "clean_text") -> DataFrame:
    """``df`` with ``out``: the text without the lines that its source repeats (null stays null)."""
    df = df.drop(out)  # a column of that name is replaced
    hashed = checkpoint(_hashed(df, rec, text, domain, url))
    confirmed = _confirmed(hashed, min_records)
    lines = F.split(F.col(text), "\n", -1)
    src = F.xxhash64(source_of(F.col(domain), F.col(url)))
    has_source = source_of(F.col(domain), F.col(url)).isNotNull()
    n = confirmed.count()
    if n <= BROADCAST_ROWS // 4:
        rows = confirmed.collect()  # at most half a million pairs of numbers, counted above
        sets: dict[int, set[int]] = {}
        for r in rows:
            sets.setdefault(r["src"], set()).add(r["h"])
        shared = df.sparkSession.sparkContext.broadcast(sets)
        part = df.withColumn("__src", F.when(has_source, src)).withColumn("__hs", F.transform(F.transform(lines, lambda x: F.nullif(normal_line(x), F.lit(""))), lambda x: F.when(x.isNotNull(), F.xxhash64(x))))

        def run(batches):
            known = shared.value
            for b in batches:
                at = {name: b.schema.get_field_index(name) for name in ("__src", "__hs", text)}
                texts = []
                for t, s, hs in zip(b.column(at[text]).to_pylist(), b.column(at["__src"]).to_pylist(), b.column(at["__hs"]).to_pylist()):
                    gone = known.get(s) if s is not None else None
                    texts.append(t if t is None or not gone else "\n".join(x for x, h in zip(t.split("\n"), hs) if h not in gone))
                keep = [i for i, f in enumerate(b.schema.names) if f not in ("__src", "__hs")]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(texts, pa.string())], names=[*(b.schema.names[i] for i in keep), out])

        schema = StructType([*df.schema.fields, StructField(out, StringType())])
        return part.mapInArrow(run, schema)
    # beyond the bound: drop the confirmed lines with a shuffled join and put each record's rest together again
    each = hashed.select("rec", "src", F.posexplode("hs").alias("line_no", "h")).filter("h is not null")
    gone = each.join(confirmed, ["src", "h"], "left_semi").groupBy(F.col("rec").alias("__rec")).agg(F.collect_set("line_no").alias("__gone"))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains("__gone", i), F.lit(False))), "\n")
    return df.join(gone, df[rec] == gone["__rec"], "left").withColumn(out, kept).drop("__rec", "__gone")
