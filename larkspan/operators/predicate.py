"""Conditions of the search language as boolean columns: built-in expressions only, so filters stay in generated code.

Analysed columns are matched on words, maximal runs of letters and digits in lower case. A word is looked up with one
regular expression between word borders, which needs no token arrays. A condition on a null value doesn't hold, and its
negation does; nulls are turned into false only below a negation, so that plain comparisons still reach the scan.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.plans import dsl

CHAR = r"[\p{L}\p{N}]"
WORD = rf"{CHAR}+"
_WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def bordered(pattern: str) -> str:
    return rf"(?<!{CHAR})(?:{pattern})(?!{CHAR})"


def phrase_pattern(text: str) -> str | None:
    ws = words(text)
    return bordered(rf"[^\p{{L}}\p{{N}}]+".join(map(re.escape, ws))) if ws else None


def value_pattern(value: str, any_case: bool) -> str:
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in value)
    return f"(?s{'i' * any_case}{'u' * any_case})^{body}$"


def _all(columns) -> Column:
    return reduce(and_, columns)


def _any(columns) -> Column:
    return reduce(or_, columns)


def has_word(c: Column, word: str) -> Column:
    """A plain search comes first: most texts don't hold the word, and only the others are matched at its borders."""
    low = F.lower(c)
    return low.contains(word) & low.rlike(bordered(re.escape(word)))


def predicate(node) -> Column:
    """True where the condition holds; false or null where it doesn't."""
    if isinstance(node, dsl.Everything):
        return F.lit(True)
    if isinstance(node, dsl.Nothing):
        return F.lit(False)
    if isinstance(node, dsl.And):
        return _all([predicate(x) for x in node.of])
    if isinstance(node, dsl.Or):
        return _any([predicate(x) for x in node.of])
    if isinstance(node, dsl.Not):
        return ~F.coalesce(predicate(node.of), F.lit(False))
    return _leaf(node)


def _matches(c: Column, value: str, any_case: bool) -> Column:
    """A pattern of plain text with stars at its ends is a plain search; others are regular expressions."""
    core = value.strip("*")
    if "*" in core or "?" in core or not core:
        return c.rlike(value_pattern(value, any_case))
    if any_case:
        c, core = F.lower(c), core.lower()
    before, behind = value.startswith("*"), value.endswith("*")
    return c.contains(core) if before and behind else c.endswith(core) if before else c.startswith(core) if behind else c == core


def _leaf(node) -> Column:
    if isinstance(node, dsl.Meta):
        return F.try_element_at("metadata", F.lit(node.key)) == node.value
    c = F.col(node.column)
    if isinstance(node, dsl.Words):
        ws = list(dict.fromkeys(words(node.value)))
        if not ws:
            return F.lit(False)
        return (_all if node.every else _any)([has_word(c, w) for w in ws])
    if isinstance(node, dsl.Phrase):
        p = phrase_pattern(node.value)
        return _all([F.lower(c).contains(w) for w in words(node.value)]) & F.lower(c).rlike(p) if p else F.lit(False)
    if isinstance(node, dsl.TermPattern):
        if re.search(r"[^\w*?]|_", node.value):
            return F.lit(False)  # no word holds anything but letters and digits
        return F.lower(c).rlike(bordered("".join(f"{CHAR}*" if x == "*" else CHAR if x == "?" else x for x in node.value)))
    if isinstance(node, dsl.Equals):
        return c == F.lit(node.value)
    if isinstance(node, dsl.ValuePattern):
        return _matches(c, node.value, node.any_case)
    if isinstance(node, dsl.Range):
        parts = []
        if node.low is not None:
            parts.append(c >= node.low if node.low_in else c > node.low)
        if node.high is not None:
            parts.append(c <= node.high if node.high_in else c < node.high)
        return _all(parts)
    raise TypeError(node)
