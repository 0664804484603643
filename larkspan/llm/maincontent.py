"""Problem 5: the main body of each page, without the menus, notices, prompts and footers around it.

Method: tree scoring. The page is read into a tree of blocks. Every paragraph passes points for its length and its
commas to its parent, and half of them to its grandparent; a container's points are discounted by the share of its
text that lies in links. The best container is kept, with siblings that come near it. Within it, blocks that hang
directly in the container (or in its lists, quotations and sections) are content; a box of its own (a nested
wrapper) is content only if it holds running text on the scale of the container's paragraphs. Class names and
languages are not consulted: pages name their boxes as they like.

Reading and scoring are one map over the rows, without a shuffle; a page costs time in proportion to its length.

Defined results: null or blank html gives no content and no lines; null or blank text has no lines; unclosed and
stray tags are tolerated; a page without any paragraph keeps the container of its first heading. Repeated rows are
handled alike; extra columns pass through ``with_main_text``.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from larkspan.runtime import spread

_TOKENS = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|head)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>|<![^>]*>", re.S | re.I)
_SPACES = re.compile(r"\s+")
_WIDE = re.compile(r"[⺀-鿿가-힯豈-﫿！-｠]")
_COMMAS = re.compile(r"[,،、，;；]")
INLINE = frozenset("a em b i u s strong small sub sup mark time abbr cite q code kbd var samp font big tt del ins label bdi bdo wbr".split())
VOID = frozenset("br img hr input meta link source area base col embed track".split())
#: Blocks that end an open paragraph.
CLOSES_P = frozenset("p div ul ol dl table section article aside header footer nav main h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption form tr td th".split())
#: What an opening tag ends, and what it doesn't look past.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
PARAGRAPH = frozenset("p li pre blockquote figcaption h1 h2 h3 h4 h5 h6 dt dd caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that may group content inside a container without being a box of their own.
GROUPS = frozenset("ul ol dl blockquote pre figure li p h1 h2 h3 h4 h5 h6 figcaption dt dd caption".split())
LEAST_LENGTH = 25
SIBLING, BOX = 0.5, 0.5
#: Advantage of a container with the page's first-order heading.
TITLED = 1.5


class Page:
    """Blocks of a page in order: ``node``, ``text``, ``linked`` characters; and the tree they hang in."""

    def __init__(self, html: str):
        self.tag, self.parent, self.spanned = ["body"], [-1], [False]
        self.blocks: list[tuple[int, str, int]] = []
        stack, names = [0], ["body"]
        buffer: list[str] = []
        self.linked = in_link = 0

        def flush() -> None:
            if buffer:
                text = "".join(buffer)
                buffer.clear()
                if not text.isspace():
                    self.blocks.append((stack[-1], text, self.linked))
            self.linked = 0

        def pop_to(depth: int) -> None:
            del stack[depth:], names[depth:]

        at = 0
        for m in _TOKENS.finditer(html):
            if m.start() > at:
                text = html[at : m.start()]
                buffer.append(unescape(text) if "&" in text else text)
                if in_link:
                    self.linked += m.start() - at
            at = m.end()
            name = m.group(3)
            if name is None:
                continue
            name, closing = name.lower(), m.group(2)
            if name in INLINE:
                if name == "a":
                    in_link = 0 if closing else 1
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    if names[-1] == "pre":
                        buffer.append("\n")
                    else:
                        flush()
                continue
            if name in ("html", "body", "title", "thead", "tbody", "tfoot"):
                continue
            if name == "span" and not closing and (names[-1] in PARAGRAPH or any(not x.isspace() for x in buffer)):
                continue  # part of a running text
            if closing:
                if name in names[1:]:
                    flush()
                    pop_to(len(names) - 1 - names[::-1].index(name))
                    if name != "span":
                        in_link = 0
                continue
            flush()
            in_link = 0
            if name in CLOSES_P and "p" in names:
                pop_to(len(names) - 1 - names[::-1].index("p"))
            if name in ENDS:
                ended, bound = ENDS[name]
                for d in range(len(names) - 1, 0, -1):
                    if names[d] in bound:
                        break
                    if names[d] in ended:
                        pop_to(d)
                        break
            self.tag.append(name), self.parent.append(stack[-1])
            stack.append(len(self.tag) - 1), names.append(name)
        if at < len(html):
            buffer.append(unescape(html[at:]))
        flush()


def weight_of(text: str) -> tuple[float, float]:
    """Points of a paragraph (0 if it is too short), and its length with wide characters counted 2.5 times."""
    length = len(text) + 1.5 * len(_WIDE.findall(text))
    return (1 + len(_COMMAS.findall(text)) + min(length / 100, 3) if length >= LEAST_LENGTH else 0.0), length


def content_blocks(page: Page) -> list[bool]:
    """For each block, whether it belongs to the page's own content."""
    tag, parent, blocks = page.tag, page.parent, page.blocks
    n = len(tag)
    direct, passed, length, linked = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    weights = []
    kids_blocks = [0] * n  # nodes that hold other nodes are wrappers
    for i in range(1, n):
        kids_blocks[parent[i]] += 1
    holder = []
    for node, text, link in blocks:
        w, size = weight_of(text.strip())
        weights.append((w, size))
        # what holds the paragraph: a div with nothing but text is itself a paragraph
        h = parent[node] if node and (tag[node] in PARAGRAPH or not kids_blocks[node]) else node
        if h > 0 and tag[h] in ("blockquote", "li", "pre", "figure"):
            h = parent[h]
        holder.append(h)
        short = tag[node] == "li"
        direct[h] += w / 2 if short else w
        if h > 0:
            passed[parent[h]] += w / 4 if short else w / 2
        x = node
        while x >= 0:
            length[x] += len(text)
            linked[x] += min(link, len(text))
            x = parent[x]
    titled = {parent[node] for node, _, _ in blocks if tag[node] == "h1"}
    score = [(direct[i] + passed[i]) * (1 - (linked[i] / length[i] if length[i] else 0)) for i in range(n)]
    if not any(direct):
        first = next((node for node, _, _ in blocks if tag[node] == "h1"), None)
        if first is None:
            return [False] * len(blocks)
        best = parent[first]
    else:
        # what only inherits points (the whole page, say) isn't the container itself
        able = [i for i in range(n) if direct[i] >= passed[i]] or list(range(n))
        best = max(able, key=lambda i: (score[i] * (TITLED if i in titled else 1), -i))
        while tag[best] in GROUPS and parent[best] > 0:
            best = parent[best]
    tops = {best}
    for i in range(1, n):
        if i != best and parent[i] == parent[best] and score[i] >= SIBLING * score[best] and kids_blocks[i] and direct[i] >= SIBLING * direct[best]:
            tops.add(i)
    # running text per paragraph of the container, the scale for boxes inside it
    paragraphs = [size for (node, _, _), (w, size), h in zip(blocks, weights, holder) if h == best and w and tag[node] not in HEADINGS]
    scale = sum(paragraphs) / len(paragraphs) if paragraphs else 0.0

    def box_of(node: int) -> tuple[int, int]:
        """(container, outermost box in it), -1 for none."""
        box, x = -1, node
        while x >= 0:
            if x in tops:
                return x, box
            if tag[x] not in GROUPS and (kids_blocks[x] or tag[x] == "span"):
                box = x
            x = parent[x]
        return -1, -1

    boxes: dict[int, list[float]] = {}
    where = [box_of(node) for node, _, _ in blocks]
    for (c, box), (w, size), (node, text, link) in zip(where, weights, blocks):
        if c >= 0 and box >= 0:
            boxes.setdefault(box, []).append(0.0 if 2 * link > len(text) else size)
    good = {b for b, sizes in boxes.items() if len(sizes) >= 2 and scale and sum(sizes) / len(sizes) >= BOX * scale}
    return [c >= 0 and (box < 0 or box in good) for c, box in where]


def lines_of(page: Page, keep: list[bool]):
    """(normalised line, kept) of the page in order."""
    for (node, text, _), k in zip(page.blocks, keep):
        for part in text.split("\n") if page.tag[node] == "pre" else [text]:
            if line := _SPACES.sub(" ", part).strip():
                yield line, k


def own_lines(html: str, text: str) -> list[int]:
    """Numbers of the non-blank lines of ``text`` that belong to the page's own content, both read in order."""
    page = Page(html)
    seen = list(lines_of(page, content_blocks(page)))
    later: dict[str, list[int]] = {}
    for i, (line, _) in enumerate(seen):
        later.setdefault(line, []).append(i)
    out, at = [], 0
    for no, raw in enumerate(text.split("\n")):
        line = _SPACES.sub(" ", raw).strip()
        if not line or not (places := later.get(line)):
            continue
        place = next((p for p in places if p >= at), places[-1])
        at = max(at, place)
        if seen[place][1]:
            out.append(no)
    return out


def main_lines(df: DataFrame, rec: str = "rec_id", html: str = "html", text: str = "text") -> DataFrame:
    """``(rec, line_no)`` of the lines of ``text`` that are the page's own content."""

    def run(batches):
        for b in batches:
            recs, nos = [], []
            for i, (h, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                own = own_lines(h, t)
                recs += [i] * len(own)
                nos += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(recs, pa.int64())), pa.array(nos, pa.int32())], names=["rec", "line_no"])

    kind = df.schema[rec].dataType.simpleString()
    part = df.select(F.col(rec).alias("rec"), F.col(html).alias("h"), F.col(text).alias("t")).filter("h is not null and t is not null and trim(h) != '' and trim(t) != ''")
    return spread(part, "rec").mapInArrow(run, f"rec {kind}, line_no int").withColumnRenamed("rec", rec)


def with_main_text(df: DataFrame, html: str = "html", out: str = "main_text") -> DataFrame:
    """``df`` with ``out``: the main body of the page as lines, null where there is no html."""
    df = df.drop(out)  # a column of that name is replaced
    at = df.columns.index(html)

    def run(batches):
        for b in batches:
            texts = []
            for h in b.column(at).to_pylist():
                page = Page(h) if h and not h.isspace() else None
                texts.append("\n".join(line for line, k in lines_of(page, content_blocks(page)) if k) if page else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType())]))
