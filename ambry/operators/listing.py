"""Filtered, paged listings and their grouping for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambry.functions.text import strip_accents

PER_PAGE = 20
LEAF_CAP = 500


def list_order(sort: str) -> list[Column]:
    """Course order puts the unnumbered introduction first; all else is newest first.

    ``work`` is an accepted name without an order of its own.
    """
    if sort == "collection":
        return [F.asc_nulls_first("part"), F.asc("date"), F.asc("item_id")]
    return [F.desc("date"), F.asc("item_id")]


def page(items: DataFrame, sort: str = "date", number: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """One page of a listing with the size of the whole listing on each row.

    The page is a distributed top-k of ``number * per_page`` rows; the total is
    a scalar subquery over the same restricted items.
    """
    total = items.agg(F.count(F.lit(1)).alias("total"))
    rows = items.orderBy(*list_order(sort)).offset((number - 1) * per_page).limit(per_page)
    return rows.withColumn("total", total.scalar())


def leaf(items: DataFrame, cap: int = LEAF_CAP) -> DataFrame:
    """The newest items of one browse leaf."""
    return items.orderBy(*list_order("date")).limit(cap)


def with_references(rows: DataFrame, refs: DataFrame, works: DataFrame) -> DataFrame:
    """Listed items with their references, one row per reference.

    The references are first narrowed to the page: Spark knows its limit and
    sends the few rows to them. Items without any reference keep one row.
    """
    child = (
        refs.join(rows.select("item_id"), "item_id", "left_semi")
        .join(works, "work").select("item_id", "work", "position", "chapter").distinct()
    )
    return rows.join(child, "item_id", "left")


def number_aware(col: Column) -> Column:
    """Sort key in which digits compare by value: 'Part 9' before 'Part 10'.

    Each run of digits is led by its length without leading zeros, so numbers of any size sort right.
    """
    runs = F.regexp_extract_all(F.lower(strip_accents(col)), F.lit(r"\d+|\D+"), F.lit(0))

    def keyed(run: Column) -> Column:
        digits = F.ltrim(run, F.lit("0"))
        return F.when(run.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(run)

    return F.array_join(F.transform(runs, keyed), "")


def initial_groups(names: DataFrame, name: str = "name", total: str = "total") -> DataFrame:
    """Index letter of each name; names with exactly one item share the last group, those with none are left out."""
    letter = F.upper(F.left(strip_accents(F.col(name)), F.lit(1)))
    single = F.col(total) == 1
    return names.where(F.col(total) > 0).select(
        *[c for c in names.columns if c != total],
        F.when(single, "Avulsos").otherwise(letter).alias("initial"), single.alias("is_last"),
    )
