"""Problem 6: cutting oversized items into pieces under a limit, at natural boundaries, with overlap.

Method: a recursive hierarchy of separators. A text over the limit is cut into sections (runs of two or more
blank lines, headings, form feeds), sections over the limit into paragraphs, these into sentences, these into
words, and only a stretch without any boundary into characters. The parts are packed greedily up to the limit;
each piece starts with up to ``overlap`` characters of the one before, from a natural boundary on.

Natural boundaries are white space and the place right after one of ``。！？``.

Defined results: a text within the limit, an empty, blank or null one is one piece, unchanged. The pieces without
their overlaps, put together, are the text. Rows with the same key are one item (repeated rows have the same
content). Items of a null document form one sequence. Extra columns are dropped.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1000, 100
LEVELS = ("whole", "section", "paragraph", "sentence", "word", "character")
#: Fixed value: Unicode's White_Space characters.
WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What one unit of each level looks like; every pattern tiles the text, separators staying with what they end.
UNITS = {
    "section": re.compile(r"(?s).+?(?:\f|\n[^\S\n]*\n(?:[^\S\n]*\n)+|\n(?=#{1,6} )|\n[^\S\n]*\n(?=#{1,6} )|\Z)"),
    "paragraph": re.compile(r"(?s).+?(?:\n+|\Z)"),
    "sentence": re.compile(rf"(?s).+?(?:[。！？]+[」』）\"”’]*[{WS}]*|[.!?…]+[)\]\"'”’»]*[{WS}]+|\Z)"),
    "word": re.compile(rf"[^{WS}。！？]*[。！？][{WS}]*|[^{WS}。！？]+[{WS}]*|[{WS}]+"),
}
#: Where an overlap may start: the first character of each stretch between boundaries.
_STARTS = re.compile(rf"(?<=[{WS}。！？])[^{WS}]")
_SPACE = re.compile(rf"[{WS}]+\Z")


def units(text: str, lo: int, hi: int, level: int, limit: int):
    """Spans of ``text[lo:hi]``, each within the limit, with the level at which it was cut out."""
    if hi - lo <= limit:
        yield lo, hi, level
        return
    name = LEVELS[level + 1]
    if name == "character":
        stretch = hi - lo - len(m.group()) if (m := _SPACE.search(text, lo, hi)) else hi - lo
        # white space after the stretch is a boundary at every place
        end = lo + stretch
        if stretch <= limit:
            if stretch:
                yield lo, end, level
            for i in range(end, hi, limit):
                yield i, min(i + limit, hi), level
        else:
            for i in range(lo, end, limit):
                yield i, min(i + limit, end), level + 1
            for i in range(end, hi, limit):
                yield i, min(i + limit, hi), level
        return
    for m in UNITS[name].finditer(text, lo, hi):
        yield from units(text, m.start(), m.end(), level + 1, limit)


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """Pieces as (start, end, overlap length, level of the finest cut at its ends or inside): the piece is ``text[start - overlap length:end]``.

    A level ``character`` says that a stretch without a boundary had to be cut.
    """
    if len(text) <= limit:
        return [(0, len(text), 0, "whole")]
    out: list[tuple[int, int, int, str]] = []
    start, end, carried, finest = 0, 0, 0, 0
    for lo, hi, level in units(text, 0, len(text), 0, limit):
        if end > start and hi - start + carried > limit:
            out.append((start, end, carried, LEVELS[finest]))
            room = max(0, min(overlap, limit - (hi - lo), end - start))
            hard = level == 5 and finest == 5
            carried = room if hard else next((end - m.start() for m in _STARTS.finditer(text, max(end - room, start, 0), end)), 0)
            start, finest = lo, 0
        end, finest = hi, max(finest, level)
    out.append((start, end, carried, LEVELS[finest]))
    return out


def split_oversized(df: DataFrame, key: str = "chunk_key", doc: str = "doc_id", idx: str = "chunk_idx", text: str = "chunk_text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(key, doc, piece_idx, piece_text, piece_start, overlap_len, cut_level)`` of every item; a map without a shuffle."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for i, t in enumerate(batch.column(3).to_pylist()):
                for n, (a, b, c, level) in enumerate(split(t, limit, overlap)):
                    for col, v in zip(rows, (i, n, t[a - c : b], a, c, level)):
                        col.append(v)
            at = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in range(3)), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.int32()), pa.array(rows[5], pa.string())],
                names=["key", "doc", "idx", "piece_idx", "piece_text", "piece_start", "overlap_len", "cut_level"],
            )

    base = df.select(F.col(key).cast("string").alias("key"), F.col(doc).cast("string").alias("doc"), F.col(idx).cast("int").alias("idx"), F.col(text).cast("string").alias("text"))
    big = base.filter(F.length("text") > limit).mapInArrow(run, "key string, doc string, idx int, piece_idx int, piece_text string, piece_start int, overlap_len int, cut_level string")
    rest = base.filter((F.length("text") <= limit) | F.col("text").isNull()).select("key", "doc", "idx", F.lit(0).alias("piece_idx"), F.col("text").alias("piece_text"), F.lit(0).alias("piece_start"), F.lit(0).alias("overlap_len"), F.lit("whole").alias("cut_level"))
    return big.unionByName(rest).select(F.col("key").alias(key), F.col("doc").alias(doc), F.col("idx").alias(idx), "piece_idx", "piece_text", "piece_start", "overlap_len", "cut_level")


def renumber(pieces: DataFrame, key: str = "chunk_key", doc: str = "doc_id", idx: str = "chunk_idx", block: int = 1024) -> DataFrame:
    """Pieces of distinct items with ``chunk_idx`` running through each document.

    The offset of an item is a prefix sum over the piece counts of the items before it, in two levels (within
    blocks of ``block`` items, and over blocks), so that one huge document is never sorted by a single task;
    only narrow count rows are shuffled for it.
    """
    one = pieces.groupBy(key, doc, idx).agg((F.max("piece_idx") + 1).cast("long").alias("n"))
    one = one.withColumn("blk", F.floor(F.coalesce(F.col(idx), F.lit(-1)) / block))
    inner = Window.partitionBy(doc, "blk").orderBy(idx, key)
    per_block = one.groupBy(doc, "blk").agg(F.sum("n").alias("bn"))
    outer = Window.partitionBy(doc).orderBy("blk")
    base = per_block.withColumn("base", F.sum("bn").over(outer) - F.col("bn")).drop("bn")
    offsets = one.withColumn("within", F.sum("n").over(inner) - F.col("n")).alias("o").join(base.alias("b"), F.col(f"o.{doc}").eqNullSafe(F.col(f"b.{doc}")) & (F.col("o.blk") == F.col("b.blk"))).select(F.col(f"o.{key}").alias("k"), F.col(f"o.{doc}").alias("d"), F.col(f"o.{idx}").alias("i"), (F.col("within") + F.col("base")).alias("offset"))
    distinct = pieces.dropDuplicates([key, doc, idx, "piece_idx"])
    same = distinct[key].eqNullSafe(offsets["k"]) & distinct[doc].eqNullSafe(offsets["d"]) & distinct[idx].eqNullSafe(offsets["i"])
    return distinct.join(offsets, same).select(distinct[key], distinct[doc], (F.col("offset") + F.col("piece_idx")).cast("long").alias("new_chunk_idx"), distinct[idx], "piece_idx", "piece_text", "piece_start", "overlap_len", "cut_level")


def oversized(df: DataFrame, key: str = "chunk_key", doc: str = "doc_id", idx: str = "chunk_idx", text: str = "chunk_text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(key, kind)`` of the items over the limit: ``hard`` if a stretch without a boundary had to be cut, else ``soft``."""
    pieces = split_oversized(df.filter(F.length(text) > limit), key, doc, idx, text, limit, overlap).filter(F.col("cut_level") != "whole")
    return pieces.groupBy(key).agg(F.when(F.max((F.col("cut_level") == "character").cast("int")) == 1, "hard").otherwise("soft").alias("kind"))
