"""Chunks for embedding: sentences, structural blocks, packing under a token budget, and a document's metadata chunk."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[ぁ-ヿ㐀-䶿一-鿿豈-﫿가-힯]|(?:(?![ぁ-ヿ㐀-䶿一-鿿豈-﫿가-힯])[^\W_])+|[^\w\s]|_")
_END = re.compile(r"[。！？]+[」』）”’]*|[.!?]+[\"'”’)\]]*(?=\s)|\n[^\S\n]*\n+")
_LIST = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+\S")
_HEADING = re.compile(r"#{1,6}\s")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def sentences(text: str) -> list[str]:
    out, at = [], 0
    for m in _END.finditer(text):
        out.append(text[at : m.end()].strip())
        at = m.end()
    out.append(text[at:].strip())
    return [s for s in out if s]


def blocks(text: str) -> list[str]:
    """Fenced code whole, headings and list items alone, indented code together, else paragraphs."""
    out: list[str] = []
    gathered: list[str] = []
    kind = ""

    def close() -> None:
        nonlocal kind
        if any(x.strip() for x in gathered):
            out.append("\n".join(gathered).strip("\n"))
        gathered.clear()
        kind = ""

    fence = ""
    for line in text.replace("\r\n", "\n").split("\n"):
        mark = re.match(r"\s*(```+|~~~+)", line)
        if fence:
            gathered.append(line)
            if mark and line.strip().startswith(fence):
                fence = ""
                close()
        elif mark:
            close()
            fence = mark[1]
            gathered.append(line)
        elif not line.strip():
            close()
        elif _HEADING.match(line) or _LIST.match(line):
            close()
            out.append(line.strip())
        else:
            now = "code" if line.startswith(("    ", "\t")) else "text"
            if kind and kind != now:
                close()
            kind = now
            gathered.append(line)
    close()
    return out


def _windows(text: str, most: int, overlap: int) -> list[str]:
    spans = [m.span() for m in _TOKEN.finditer(text)]
    step = max(1, most - overlap)
    return [text[spans[i][0] : spans[min(i + most, len(spans)) - 1][1]] for i in range(0, max(1, len(spans) - overlap), step)]


def chunk(text: str, most: int, overlap: int) -> list[str]:
    """A text within the budget is one chunk as it is; else its units are packed, the last units up to ``overlap`` tokens
    are repeated, and a unit over the budget is cut into windows of tokens."""
    if not text.strip():
        return []
    if len(tokens(text)) <= most:
        return [text]
    units = [u for b in blocks(text) for u in ([b] if len(tokens(b)) <= most or b.lstrip().startswith(("```", "~~~")) else sentences(b))]
    out: list[str] = []
    held: list[tuple[str, int]] = []
    fresh = False
    for u in units:
        n = len(tokens(u))
        if n > most:
            if fresh:
                out.append("\n".join(x for x, _ in held))
            held, fresh = [], False
            out += _windows(u, most, overlap)
            continue
        if held and sum(k for _, k in held) + n > most:
            if fresh:
                out.append("\n".join(x for x, _ in held))
            kept: list[tuple[str, int]] = []
            for x in reversed(held):
                if sum(k for _, k in kept) + x[1] > overlap or sum(k for _, k in kept) + x[1] + n > most:
                    break
                kept.insert(0, x)
            held = kept
        held.append((u, n))
        fresh = True
    if fresh:
        out.append("\n".join(x for x, _ in held))
    return out


def headroom(context: int, share: float = 0.05) -> int:
    """Tokens of a context that stay free."""
    return math.ceil(context * share)


def shorter(context: int, told: int | None = None) -> int:
    """The length for a retry after an overflow: nine tenths of what the endpoint names, else three quarters."""
    return int(told * 0.9) if told else context * 3 // 4


def fields_within(fields: list[tuple[str, str]], budget: int) -> str:
    """``name: value`` lines within a token budget; the last that doesn't fit is cut."""
    out: list[str] = []
    for name, value in fields:
        value = " ".join((value or "").split())
        if not value or budget <= 0:
            continue
        line = f"{name}: {value}"
        ts = tokens(line)
        if len(ts) > budget:
            line = _windows(line, budget, 0)[0]
        out.append(line)
        budget -= len(ts)
    return "\n".join(out)


def embedding_inputs(meta: list[tuple[str, str]], text: str, context: int = 512, overlap: int = 64) -> list[str]:
    """Chunk 0 is the document's metadata; body chunks carry title and language within a quarter of the budget."""
    budget = context - headroom(context)
    first = fields_within(meta, budget)
    head = fields_within([(k, v) for k, v in meta if k in ("title", "language")], budget // 4)
    room = budget - len(tokens(head))
    return ([first] if first else []) + [f"{head}\n\n{c}" if head else c for c in chunk(text or "", max(1, room), overlap)]


def chunked(text: Column, most: int = 512, overlap: int = 64) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([chunk(x or "", most, overlap) for x in s], dtype=object)

    return run(text)


def put_chunks(stored: DataFrame, docs: DataFrame, doc: str = "id", text: str = "text", most: int = 512, overlap: int = 64) -> DataFrame:
    """All chunks of the given documents replaced: the others' chunks and the new ones, keyed ``doc#idx``."""
    new = docs.select(F.col(doc).alias("doc_id"), "user_id", F.posexplode(chunked(F.col(text), most, overlap)).alias("chunk_idx", "chunk_text"))
    new = new.select(F.concat_ws("#", "doc_id", "chunk_idx").alias("chunk_key"), "doc_id", "chunk_idx", "user_id", "chunk_text")
    return stored.join(docs.select(F.col(doc).alias("doc_id")).distinct(), "doc_id", "left_anti").select(new.columns).unionByName(new)
