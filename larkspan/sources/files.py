"""Local files as documents: directory walk, decoders by type, and what changed since the last index."""

from __future__ import annotations

import fnmatch
import io
import re
import zipfile
from html import escape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import text as T

MOST_BYTES = 1 << 20
PRUNED = ("node_modules", "__pycache__", "target", "vendor", "venv", "dist", "build")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def path_allowed(path: Column, excluded: tuple[str, ...] = (), patterns: tuple[str, ...] = (), types: tuple[str, ...] = (), hidden: bool = False) -> Column:
    """Every directory above passes the pruning rules, then the name passes type, pattern and hidden filters."""
    parts = F.filter(F.split(T.url_to_path(path), "/"), lambda p: p != "")
    above, name = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, -1)
    glob = lambda c, p: c.rlike(fnmatch.translate(p).replace("\\Z", "$").replace("\\z", "$"))
    ok = ~F.exists(above, lambda p: p.isin(*PRUNED, *excluded) | (F.lit(not hidden) & p.startswith(".")))
    if not hidden:
        ok = ok & ~name.startswith(".")
    if types:
        ok = ok & F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*types)
    if patterns:
        some = F.lit(False)
        for p in patterns:
            some = some | glob(name, p)
        ok = ok & some
    return F.coalesce(ok, F.lit(False))


def walk(spark: SparkSession, root: str, **rules) -> DataFrame:
    """``(path, modificationTime, length, content)`` of the files below ``root`` that the rules allow; content is read lazily."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.withColumn("path", F.regexp_replace("path", r"^file:/+", "/")).filter(path_allowed(F.col("path"), **rules))


def changed(files: DataFrame, indexed: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Files to index: not empty, not too large, and not indexed at the same time of modification. ``indexed`` is (path, updated)."""
    sized = files.filter((F.col("length") > 0) & (F.col("length") <= most)).withColumn("updated", F.unix_seconds(F.col("modificationTime").cast("timestamp")))
    return sized.join(indexed.select("path", "updated"), ["path", "updated"], "left_anti")


def docx_text(raw: bytes) -> tuple[str, str]:
    """(title, text) of a word processor file; the title is the first paragraph styled so, else the first paragraph."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    title, paragraphs = "", []
    for p in root.iter(f"{_W}p"):
        t = "".join(x.text or "" for x in p.iter(f"{_W}t")).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        if t:
            paragraphs.append(t)
            if not title and style is not None and (style.get(f"{_W}val") or "").lower() == "title":
                title = t
    return title or (paragraphs[0] if paragraphs else ""), "\n".join(paragraphs)


def markdown_html(text: str) -> str:
    """A small renderer: headings, lists, fenced code, quotes, paragraphs, emphasis, code and links."""
    out, items, fence = [], [], None
    inline = lambda s: re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', re.sub(r"`([^`]+)`", r"<code>\1</code>", re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", re.sub(r"(?<!\*)\*([^*]+)\*(?!\*)", r"<em>\1</em>", escape(s, quote=False)))))

    def close() -> None:
        if items:
            out.append("<ul>" + "".join(f"<li>{inline(i)}</li>" for i in items) + "</ul>")
            items.clear()

    paragraph: list[str] = []

    def end() -> None:
        if paragraph:
            out.append(f"<p>{inline(' '.join(paragraph))}</p>")
            paragraph.clear()

    for line in text.split("\n"):
        if line.startswith("```"):
            end(), close()
            if fence is None:
                fence = []
            else:
                out.append("<pre><code>" + escape("\n".join(fence), quote=False) + "</code></pre>")
                fence = None
        elif fence is not None:
            fence.append(line)
        elif m := re.match(r"(#{1,6})\s+(.*)", line):
            end(), close()
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
        elif m := re.match(r"\s*[-*+]\s+(.*)", line):
            end()
            items.append(m[1])
        elif not line.strip():
            end(), close()
        else:
            close()
            paragraph.append(line.lstrip("> ").strip())
    end(), close()
    if fence:
        out.append("<pre><code>" + escape("\n".join(fence), quote=False) + "</code></pre>")
    return "\n".join(out)


def org_text(text: str) -> tuple[str, str]:
    """(title, text) of an outline file: keywords and drawers are dropped, stars and markup removed."""
    title, out = "", []
    for line in text.split("\n"):
        if m := re.match(r"#\+title:\s*(.*)", line, re.I):
            title = m[1].strip()
        elif re.match(r"#\+|\s*:[A-Z_]+:", line):
            continue
        else:
            line = re.sub(r"\[\[([^\]]+)\]\[([^\]]+)\]\]", r"\2", re.sub(r"^\*+\s+(?:TODO |DONE )?", "", line))
            out.append(re.sub(r"(?<!\w)[*/_=~+](\S(?:.*?\S)?)[*/_=~+](?!\w)", r"\1", line))
    body = "\n".join(out).strip()
    return title or body.split("\n", 1)[0], body


def decode(path: str, raw: bytes | None) -> tuple[str | None, str | None, str | None]:
    """(title, text, error) by the file's type; what isn't UTF-8 text is an error."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    try:
        if kind == "docx":
            return (*docx_text(raw or b""), None)
        if kind == "pdf":
            return None, None, "no pdf reader"
        text = (raw or b"").decode("utf-8")
    except (UnicodeDecodeError, zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None, None, "binary file"
    if "\0" in text:
        return None, None, "binary file"
    if kind in ("md", "markdown"):
        m = re.search(r"(?m)^# (.*)$", text)
        return (m[1].strip() if m else None), text, None
    if kind == "org":
        return (*org_text(text), None)
    return None, text, None


def documents(files: DataFrame) -> DataFrame:
    """Decoded files as document rows; a file that can't be read keeps its ``error``."""

    def run(batches):
        for b in batches:
            rows = [decode(p, c) for p, c in zip(b["path"], b["content"])]
            yield pd.DataFrame({"path": b["path"], "updated": b["updated"], "title": [r[0] for r in rows], "text": [r[1] for r in rows], "error": [r[2] for r in rows]})

    part = files.select("path", F.unix_seconds(F.col("modificationTime").cast("timestamp")).alias("updated"), "content")
    out = part.mapInPandas(run, "path string, updated long, title string, text string, error string")
    return out.withColumn("url", T.path_to_url(F.col("path"))).withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), T.file_title(F.col("path")))).withColumn("type", F.lit(1))


def remote_url(source: Column, path: Column) -> Column:
    return F.concat(F.lit("remote-file://"), T.source_slug(source), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def first_directory(docs: DataFrame, directories: list[tuple[str, str]]) -> DataFrame:
    """``directory`` and ``label`` of the first configured directory that a path lies in (a short list, inlined)."""
    path = T.url_to_path(F.col("url"))
    found = F.coalesce(*[F.when(T.under(path, F.lit(d)), F.struct(F.lit(d).alias("directory"), F.lit(label).alias("label"))) for d, label in directories], F.lit(None).cast("struct<directory:string,label:string>"))
    return docs.withColumn("__d", found).withColumn("directory", F.col("__d.directory")).withColumn("dir_label", F.col("__d.label")).drop("__d")
