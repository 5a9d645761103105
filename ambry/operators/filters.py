"""Facet filters: one value object, one predicate per dimension.

Values within a dimension are alternatives, dimensions are combined. An absent
or empty list is no constraint; a set list never admits a null.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTS = ("people", "kinds", "collections", "works", "topics")
DIMENSIONS = (*LISTS, "dates")
# How many entries each list may carry, and the numeric ranges.
LIST_CAPS = {"people": 20, "kinds": 10, "collections": 20, "works": 20, "topics": 20}
QUERY_LENGTH = (2, 500)
LIMIT_RANGE = (1, 50)
PAGE_RANGE = (1, 500)
CHAPTER_RANGE = (1, 150)

_ISO = re.compile(r"\d{4}-\d{2}-\d{2}")


@dataclass(frozen=True)
class Filters:
    people: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    collections: tuple[str, ...] = ()
    works: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    chapter: int | None = None
    since: str | None = None
    until: str | None = None

    @classmethod
    def from_params(cls, params: Mapping[str, str]) -> Filters:
        """Comma lists from a query string; what does not parse is left out."""
        got: dict = {k: tuple(v for v in params.get(k, "").split(",") if v) for k in LISTS}
        chapter = re.match(r"\s*(\d+)", params.get("chapter", ""))
        if got["works"] and chapter:
            got["chapter"] = int(chapter[1])
        for key in ("since", "until"):
            if _ISO.fullmatch(params.get(key, "")):
                got[key] = params[key]
        return cls(**got)

    def to_params(self) -> dict[str, str]:
        out = {k: ",".join(getattr(self, k)) for k in LISTS if getattr(self, k)}
        if self.works and self.chapter:
            out["chapter"] = str(self.chapter)
        return out | {k: getattr(self, k) for k in ("since", "until") if getattr(self, k)}

    def add(self, key: str, value: str) -> Filters:
        have = getattr(self, key)
        return self if value in have else replace(self, **{key: (*have, value)})

    def drop(self, key: str, value: str) -> Filters:
        kept = tuple(v for v in getattr(self, key) if v != value)
        chapter = None if key == "works" and not kept else self.chapter
        return replace(self, **{key: kept, "chapter": chapter})

    def with_year(self, year: int) -> Filters:
        return replace(self, since=f"{year}-01-01", until=f"{year}-12-31")

    def without_dates(self) -> Filters:
        return replace(self, since=None, until=None)

    def count(self) -> int:
        return sum(len(getattr(self, k)) for k in LISTS) + bool(self.since or self.until)

    def range_label(self) -> str | None:
        """A single year, or the bounds that are set."""
        if self.since and self.until and self.since[:4] == self.until[:4]:
            return self.since[:4]
        said = [f"de {self.since}" if self.since else "", f"até {self.until}" if self.until else ""]
        return " ".join(s for s in said if s) or None

    def chips(self, labels: Mapping[tuple[str, str], str]) -> list[tuple[str, str, str]]:
        """(dimension, value, label) of every chosen value; the chapter is shown with its work."""
        out = []
        for key in LISTS:
            for value in getattr(self, key):
                label = labels.get((key, value), value)
                out.append((key, value, f"{label} {self.chapter}" if key == "works" and self.chapter else label))
        period = self.range_label()
        return out + ([("years", period, period)] if period else [])

    def validate(self) -> Filters:
        for key, cap in LIST_CAPS.items():
            if len(getattr(self, key)) > cap:
                raise ValueError(f"at most {cap} values for {key}")
        if self.chapter is not None:
            _within("chapter", self.chapter, CHAPTER_RANGE)
        for key in ("since", "until"):
            value = getattr(self, key)
            if value is not None:
                date.fromisoformat(value)
        return self


def _within(name: str, value: int, bounds: tuple[int, int]) -> None:
    if not bounds[0] <= value <= bounds[1]:
        raise ValueError(f"{name} must lie between {bounds[0]} and {bounds[1]}")


@dataclass(frozen=True)
class SearchRequest:
    query: str
    limit: int = 10
    filters: Filters = Filters()

    def validate(self) -> SearchRequest:
        text = self.query.strip()
        _within("query length", len(text), QUERY_LENGTH)
        _within("limit", self.limit, LIMIT_RANGE)
        return replace(self, query=text, filters=self.filters.validate())


@dataclass(frozen=True)
class ListRequest:
    filters: Filters = Filters()
    sort: str = "date"
    page: int = 1

    def validate(self) -> ListRequest:
        if self.sort not in ("date", "work", "collection"):
            raise ValueError(f"unknown sort {self.sort}")
        _within("page", self.page, PAGE_RANGE)
        return replace(self, filters=self.filters.validate())


def item_predicates(f: Filters) -> dict[str, Column]:
    """Predicates on the item's own columns; only the constrained dimensions."""
    found: dict[str, Column] = {}
    for key, col in (("people", "person"), ("kinds", "kind"), ("collections", "collection")):
        if getattr(f, key):
            found[key] = F.col(col).isNotNull() & F.col(col).isin(list(getattr(f, key)))
    bounds = []
    if f.since:
        bounds.append(F.col("date") >= F.lit(f.since).cast("date"))
    if f.until:
        bounds.append(F.col("date") <= F.lit(f.until).cast("date"))
    if bounds:
        found["dates"] = reduce(lambda a, b: a & b, bounds)
    return found


def ref_predicates(f: Filters) -> dict[str, Column]:
    """Predicates on one child row; the chapter only ever narrows a work."""
    found: dict[str, Column] = {}
    if f.works:
        hit = F.col("work").isin(list(f.works))
        found["works"] = hit & (F.col("chapter") == f.chapter) if f.chapter else hit
    if f.topics:
        found["topics"] = F.col("topic").isin(list(f.topics))
    return found


def restrict(items: DataFrame, refs: DataFrame, f: Filters) -> DataFrame:
    """Items that satisfy every filter; children decide by semi-join."""
    for predicate in item_predicates(f).values():
        items = items.where(predicate)
    for predicate in ref_predicates(f).values():
        items = items.join(refs.where(predicate).select("item_id"), "item_id", "left_semi")
    return items


FILTER_FIELDS = tuple(field.name for field in fields(Filters))
