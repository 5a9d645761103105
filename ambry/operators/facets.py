"""Facet trees and drill-sideways counts.

Plain grouped counts: Spark aggregates map-side before it shuffles, so a value
that holds a third of all rows costs one partial row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambry.functions.names import split_honorific
from ambry.functions.text import slugify
from ambry.operators.filters import DIMENSIONS, Filters, item_predicates, ref_predicates


def work_chapters(works: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct items per work and chapter, catalogue order.

    ``count(distinct)`` is spelt as two groupings so that the shuffle is keyed
    by (work, chapter, item): a very popular chapter is spread over all tasks.
    """
    counts = (
        refs.select("work", "chapter", "item_id").distinct()
        .groupBy("work", "chapter").agg(F.count(F.lit(1)).alias("total"))
    )
    return counts.join(works, "work").select("work", "section", "position", "chapter", "total")


def work_totals(works: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct items per work: not the sum of its chapters."""
    counts = (
        refs.select("work", "item_id").distinct()
        .groupBy("work").agg(F.count(F.lit(1)).alias("total"))
    )
    return counts.join(works, "work").select("work", "section", "position", "total")


def work_tree(works: DataFrame, refs: DataFrame) -> DataFrame:
    """Works with their numbered chapters nested; chapter 0 only in the total."""
    chapters = (
        work_chapters(works, refs).where("chapter > 0").groupBy("work")
        # bounded by the chapters of one work, 150 at most
        .agg(F.array_sort(F.collect_list(F.struct("chapter", "total"))).alias("chapters"))
    )
    empty = F.array().cast("array<struct<chapter:int,total:bigint>>")
    return work_totals(works, refs).join(chapters, "work", "left").select(
        "work", "section", "position", "total", F.coalesce("chapters", empty).alias("chapters")
    )


def child_counts(parents: DataFrame, children: DataFrame, key: str, child_id: str) -> DataFrame:
    """Every parent with its number of children, zero included."""
    counts = children.groupBy(key).agg(F.count(child_id).alias("total"))
    return parents.join(counts, key, "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))


def person_counts(items: DataFrame) -> DataFrame:
    honorific, name = split_honorific(F.col("person"))
    return items.groupBy("person").agg(F.count(F.lit(1)).alias("total")).select(
        slugify(F.col("person")).alias("slug"), "person", honorific.alias("honorific"),
        name.alias("name"), "total",
    )


def month_counts(items: DataFrame) -> DataFrame:
    return items.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.count(F.lit(1)).alias("total")
    )


def year_month_tree(items: DataFrame) -> DataFrame:
    """Months with the total of their year beside them, newest first."""
    months = month_counts(items)
    years = months.groupBy("year").agg(F.sum("total").alias("year_total"))
    return months.join(years, "year").orderBy(F.desc("year"), F.desc("month"))


def kind_counts(items: DataFrame) -> DataFrame:
    return items.where(F.col("kind").isNotNull()).groupBy("kind").agg(F.count(F.lit(1)).alias("total"))


def facet_tree(
    items: DataFrame, refs: DataFrame, works: DataFrame, collections: DataFrame, topics: DataFrame
) -> dict[str, DataFrame]:
    """All facets of a catalogue, one lazy DataFrame each.

    collections (collection, ...) and topics (topic, ...) keep members without items.
    """
    labels = refs.select("item_id", "topic").distinct()
    return {
        "works": work_tree(works, refs),
        "collections": child_counts(collections, items, "collection", "item_id"),
        "people": person_counts(items),
        "dates": year_month_tree(items),
        "kinds": kind_counts(items),
        "topics": child_counts(topics, labels, "topic", "item_id"),
    }


def drill_sideways(items: DataFrame, refs: DataFrame, f: Filters) -> DataFrame:
    """(dimension, value, total): each dimension counted under all filters but its own.

    One pass: children are reduced to the distinct works and topics of an item
    (closed lists, a few dozen values at most) with the partial step on the map
    side, joined to the items once, and every item emits the values it counts
    for. The last grouping only sees partial counts.
    """
    on_item, on_ref = item_predicates(f), ref_predicates(f)
    children = refs.groupBy("item_id").agg(
        F.collect_set("work").alias("works"),
        F.collect_set("topic").alias("topics"),
        *[F.bool_or(p).alias(f"ok_{d}") for d, p in on_ref.items()],
    )
    flagged = items.join(children, "item_id", "left").select(
        "person", "kind", "collection", F.year("date").cast("string").alias("year"),
        "works", "topics",
        *[p.alias(f"ok_{d}") for d, p in on_item.items()],
        *[F.coalesce(F.col(f"ok_{d}"), F.lit(False)).alias(f"ok_{d}") for d in on_ref],
    )
    constrained = [*on_item, *on_ref]

    def passes(skip: str | None) -> Column:
        flags = [F.col(f"ok_{d}") for d in constrained if d != skip]
        return reduce(lambda a, b: a & b, flags, F.lit(True))

    def entries(dimension: str, values: Column, skip: str | None) -> Column:
        rows = F.transform(values, lambda v: F.struct(F.lit(dimension).alias("dimension"), v.alias("value")))
        return F.when(passes(skip), rows).otherwise(F.array().cast("array<struct<dimension:string,value:string>>"))

    empty = F.array().cast("array<string>")
    emitted = F.concat(
        entries("people", F.array("person"), "people"),
        entries("kinds", F.array("kind"), "kinds"),
        entries("collections", F.array("collection"), "collections"),
        entries("works", F.coalesce("works", empty), "works"),
        entries("topics", F.coalesce("topics", empty), "topics"),
        entries("years", F.array("year"), "dates"),
        entries("total", F.array(F.lit("")), None),
    )
    counted = (
        flagged.select(F.explode(emitted).alias("e"))
        .select("e.dimension", "e.value")
        .where(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("total"))
    )
    # the total is there also when nothing passes
    none = items.sparkSession.range(1).select(
        F.lit("total").alias("dimension"), F.lit("").alias("value"), F.lit(0).cast("long").alias("total")
    )
    return counted.unionByName(none).groupBy("dimension", "value").agg(F.sum("total").alias("total"))


def options(members: DataFrame, counts: DataFrame) -> DataFrame:
    """(dimension, value, label, total): every member of the tree with its current count.

    ``members`` is (dimension, value, label), ``counts`` comes from ``drill_sideways``.
    """
    return members.join(counts, ["dimension", "value"], "left").withColumn(
        "total", F.coalesce("total", F.lit(0).cast("long"))
    )


__all__ = [
    "DIMENSIONS", "child_counts", "drill_sideways", "facet_tree", "kind_counts", "month_counts",
    "options", "person_counts", "work_chapters", "work_totals", "work_tree", "year_month_tree",
]
