"""Relevance: sum over fields and words of weight * sqrt(tf) / sqrt(length) * idf^2, plus fixed additions.

``idf = 1 + ln(N / (df + 1))`` per field over the whole corpus. Additions: 20 for the whole text as a phrase, 2 for all its
words in one field, the field's weight for a contained word in domain or url, 100 for the root of the named site, 100
for a url that a priority rule names. Scores are rounded to 6 places.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.operators.predicate import WORD, bordered, has_word, phrase_pattern, predicate, words
from larkspan.plans import dsl, schema

PHRASE, ALL_WORDS, ROOT, PRIORITY = 20.0, 2.0, 100.0, 100.0


@dataclass(frozen=True)
class Statistics:
    """Documents of the corpus, and how many of them hold a word in a field."""

    documents: int
    holding: dict


def scored_words(text: str) -> list[tuple[str, str]]:
    """(column, word) pairs that count: those of positive free tokens in all searched fields, bound ones in theirs."""
    out: dict[tuple[str, str], None] = {}
    try:
        tokens = dsl.tokenize(text)
    except dsl.DslError:
        tokens = [dsl.Token("word", w) for w in text.split()]
    stack = [t for t in tokens]
    while stack:
        t = stack.pop(0)
        if t.kind == "either":
            stack = list(t.parts) + stack
            continue
        if t.value.startswith("-") or "*" in t.value:
            continue
        name, colon, rest = t.value.partition(":")
        f = schema.field(name) if colon else None
        if f or (colon and name.startswith("metadata.")):
            fields = [f] if f and f.searched and not rest.startswith(("-", "(")) else []
            ws = words(rest)
        else:
            fields, ws = [x for x in schema.FIELDS if x.searched], words(t.value)
        out.update({(x.column, w): None for x in fields for w in ws})
    return list(out)


def statistics(corpus: DataFrame, pairs: list[tuple[str, str]]) -> Statistics:
    """One combined aggregate over the corpus: one row of counts, one for each scored word."""
    counts = [F.count_if(has_word(F.col(c), w)).alias(f"c{i}") for i, (c, w) in enumerate(pairs)]
    row = corpus.agg(F.count(F.lit(1)).alias("n"), *counts).first()
    return Statistics(row["n"], {p: row[f"c{i}"] for i, p in enumerate(pairs)})


def relevance(text: str, parsed: dsl.Parsed, stats: Statistics, priority: list[str] | None = None) -> Column:
    parts: list[Column] = [F.lit(0.0)]
    weight = {f.column: f.weight for f in schema.FIELDS}
    for (column, word), df in stats.holding.items():
        low = F.lower(F.coalesce(F.col(column), F.lit("")))
        tf, length = F.regexp_count(low, F.lit(bordered(re.escape(word)))), F.regexp_count(low, F.lit(WORD))
        idf = 1 + F.log(F.lit(float(stats.documents)) / F.lit(float(df + 1)))
        parts.append(F.when(low.contains(word) & (tf > 0), weight[column] * F.sqrt(tf) / F.sqrt(length) * idf * idf).otherwise(0.0))
    for t in _contained(text):
        for f in schema.FIELDS:
            if f.contained:
                pattern = dsl.ValuePattern(f.column, f"*{t}*" if f.path else f"*{t.lower()}*", any_case=f.path)
                parts.append(F.when(predicate(pattern), float(f.weight)).otherwise(0.0))
    if parsed.whole:
        searched = [f for f in schema.FIELDS if f.searched]
        if phrase_pattern(parsed.whole):
            parts.append(F.when(reduce(or_, [predicate(dsl.Phrase(f.column, parsed.whole)) for f in searched]), PHRASE).otherwise(0.0))
            parts.append(F.when(reduce(or_, [predicate(dsl.Words(f.column, parsed.whole, True)) for f in searched]), ALL_WORDS).otherwise(0.0))
    if parsed.root:
        parts.append(F.when(F.coalesce(F.lower("url").rlike(rf"^https?://(www\.)?{re.escape(parsed.root)}[^/]*/$"), F.lit(False)), ROOT).otherwise(0.0))
    if priority and not isinstance(parsed.where, dsl.Everything):
        parts.append(F.when(F.coalesce(F.col("url").rlike("|".join(f"(?:{p})" for p in priority)), F.lit(False)), PRIORITY).otherwise(0.0))
    return F.round(reduce(add, parts), 6)


def _contained(text: str) -> list[str]:
    try:
        tokens = dsl.tokenize(text)
    except dsl.DslError:
        return []
    return [t.value for t in tokens if t.kind == "word" and not t.value.startswith("-") and "*" not in t.value and not dsl.is_bound(t)]
