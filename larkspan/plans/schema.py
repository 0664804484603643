"""The search schema: one table of fields, value sets, facets and sort orders for parser, planner and capabilities."""

from __future__ import annotations

from dataclasses import asdict, dataclass

DAY = 86_400


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # text, keyword, enum, range, time, integer
    column: str
    weight: int = 1
    phrase: bool = False
    searched: bool = False  # a free word is looked up here
    contained: bool = False  # a free word may be any part of the value
    path: bool = False  # values are urls; patterns ignore case
    exact: bool = False  # kind text, but kept as one term
    values: str = ""
    hidden: bool = False


# Field names, kinds, weights, value sets and sort keys of the search interface.
FIELDS = (
    Field("domain", "keyword", "domain", 8, contained=True),
    Field("title", "text", "title", 12, phrase=True, searched=True),
    Field("url", "keyword", "url", 4, contained=True, path=True),
    Field("text", "text", "text", 1, phrase=True, searched=True),
    Field("type", "enum", "type", values="document_types"),
    Field("language", "text", "language", exact=True),
    Field("label", "text", "label", exact=True),
    Field("visits", "range", "add_count", values="visit_counts"),
    Field("updated", "time", "updated", values="time_ranges"),
    Field("added", "time", "added", values="time_ranges"),
    Field("user_id", "integer", "user_id", hidden=True),
)
ALIASES = {"add_count": "visits"}
#: Half-open ranges; None is open.
DOCUMENT_TYPES = {"web": (0, 1), "local": (1, 2), "remote": (2, 3), "remote_file": (2, 3), "file": (1, 3)}
VISIT_COUNTS = (("1", 1, 2), ("2..4", 2, 5), ("5..9", 5, 10), ("10..", 10, None))
AGES = (("last_24h", DAY), ("last_7d", 7 * DAY), ("last_30d", 30 * DAY), ("last_year", 365 * DAY))
FACETS = {"domains": ("domain", 10), "languages": ("language", 10), "types": ("type", 3), "visits": ("add_count", 4), "updated": ("updated", 5)}
#: Sort keys, a leading minus for descending; every order ends in a unique key.
SORTS = {
    "relevance": ("-score", "-updated", "id"),
    "-relevance": ("score", "updated", "id"),
    "visits": ("-add_count", "-updated", "id"),
    "-visits": ("add_count", "updated", "id"),
    "date": ("-updated", "id"),
    "-date": ("updated", "id"),
    "domain": ("domain", "id"),
    "-domain": ("-domain", "id"),
}
HIDDEN_SORTS = ("-relevance",)
DEFAULT_SORT = "relevance"
_BY_NAME = {f.name: f for f in FIELDS}


def field(name: str) -> Field | None:
    return _BY_NAME.get(ALIASES.get(name, name))


def sort_keys(mode: str | None) -> tuple[str, ...]:
    """The keys of a sort order; an unknown or empty one is the default."""
    return SORTS.get(mode or DEFAULT_SORT, SORTS[DEFAULT_SORT])


def age_ranges(now: int) -> list[tuple[str, int | None, int | None]]:
    """The (overlapping) ranges of the time facet at ``now``, with lower bounds inclusive."""
    return [(name, now - age, None) for name, age in AGES] + [("older", None, now - AGES[-1][1])]


def capabilities() -> dict:
    """What the interface can be asked: visible fields, facets and sort orders."""
    by_column = {column: name for name, (column, _) in FACETS.items()}
    fields = [{k: v for k, v in asdict(f).items() if k in ("name", "kind", "weight", "phrase")} | ({"facet": by_column[f.column]} if f.column in by_column else {}) for f in FIELDS if not f.hidden]
    return {"version": 2, "fields": fields, "facets": {k: n for k, (_, n) in FACETS.items()}, "sorts": [s for s in SORTS if s not in HIDDEN_SORTS]}
