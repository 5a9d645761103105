"""Loading, ordering and reporting on the catalogue side of the corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ambry.functions.names import honorific_place
from ambry.functions.values import confidence, int_or_null
from ambry.operators.quality import MIN_DOWNLOADED


def reference_payload(rows: DataFrame, docs: DataFrame, works: DataFrame) -> DataFrame:
    """Reference rows as text, typed, for known documents and works only."""
    known = (
        rows.withColumn("doc_id", F.trim("doc_id")).withColumn("work", F.trim("work"))
        .join(docs.select("doc_id"), "doc_id", "left_semi").join(works.select("work"), "work", "left_semi")
    )
    source = F.trim(F.coalesce("source", F.lit("")))
    return known.select(
        "doc_id", "work", F.coalesce(int_or_null(F.col("chapter")), F.lit(0)).alias("chapter"),
        int_or_null(F.col("verse_start")).alias("verse_start"), int_or_null(F.col("verse_end")).alias("verse_end"),
        F.when(source == "", "titulo").otherwise(source).alias("source"),
        (F.trim(F.coalesce("is_primary", F.lit(""))) != "false").alias("is_primary"),
    )


def topic_payload(rows: DataFrame, docs: DataFrame, topics: DataFrame) -> DataFrame:
    known = (
        rows.withColumn("doc_id", F.trim("doc_id")).withColumn("topic", F.trim("topic"))
        .join(docs.select("doc_id"), "doc_id", "left_semi").join(topics.select("topic"), "topic", "left_semi")
    )
    return known.select("doc_id", "topic", confidence(F.col("confidence")).alias("confidence"))


def alive_flag(col: Column) -> Column:
    """Only the literal 'true' is alive."""
    return F.coalesce(F.trim(col) == "true", F.lit(False))


def discover(tracks: DataFrame, known: DataFrame) -> DataFrame:
    """Tracks (pos, id) not known yet, the oldest (last listed) first."""
    return tracks.join(known.select("id"), "id", "left_anti").orderBy(F.desc("pos"))


def first_reference(docs: DataFrame, refs: DataFrame, order: str) -> DataFrame:
    """Documents with their first reference, null without one."""
    first = refs.groupBy("item_id").agg(F.min_by("work", order).alias("first_work"))
    return docs.join(first, "item_id", "left")


def prefer(fresh: DataFrame, cached: DataFrame, key: str, value: str) -> DataFrame:
    """One value per key from either side; the fresh one wins."""
    f = fresh.select(key, F.col(value).alias("_fresh"))
    c = cached.select(key, F.col(value).alias("_cached"))
    return f.join(c, key, "full_outer").select(key, F.coalesce("_fresh", "_cached").alias(value))


def derive_report(items: DataFrame, refs: DataFrame) -> DataFrame:
    """(measure, value): items per kind, items with a reference, collections with two or more."""
    n = lambda: F.count(F.lit(1)).alias("value")
    kinds = items.groupBy(F.concat(F.lit("kind "), F.coalesce("kind", F.lit("-"))).alias("measure")).agg(n())
    # items are unique in both, so the semi-join counts each one once
    covered = items.join(refs.select("item_id"), "item_id", "left_semi").agg(n())
    repeated = items.where("collection IS NOT NULL").groupBy("collection").agg(n()).where("value >= 2").agg(n())
    return kinds.unionByName(covered.select(F.lit("with reference").alias("measure"), "value")).unionByName(
        repeated.select(F.lit("collections repeated").alias("measure"), "value")
    )


def reference_share(items: DataFrame, refs: DataFrame) -> DataFrame:
    """Share of items that have any reference."""
    marked = items.select("item_id").join(
        refs.select("item_id").distinct().withColumn("_has", F.lit(1)), "item_id", "left"
    )
    return marked.agg(F.count(F.lit(1)).alias("items"), F.count("_has").alias("covered")).withColumn(
        "percent", F.round(100 * F.col("covered") / F.col("items"), 1)
    )


def people_in_order(people: DataFrame) -> DataFrame:
    """People by honorific in display order, then by name."""
    return people.withColumn("place", honorific_place(F.col("honorific"))).orderBy("place", "name", "person")


def section_list(counts: DataFrame) -> DataFrame:
    """Works that have items, by section in catalogue order."""
    return counts.where("total > 0").orderBy("section", "position")


def leading_works(refs: DataFrame, most: int = 2) -> DataFrame:
    """(item_id, works): the first ``most`` distinct works of each item, in catalogue order.

    Merged to distinct (item, work) rows first; an item has at most as many of
    those as the catalogue has works.
    """
    pairs = refs.groupBy("item_id", "work").agg(F.min("position").alias("position"))
    listed = F.array_sort(F.collect_list(F.struct("position", "work")))
    return pairs.groupBy("item_id").agg(listed.alias("_w")).select(
        "item_id", F.array_join(F.transform(F.slice("_w", 1, most), lambda s: s["work"]), ", ").alias("works")
    )


def record_problems(records: DataFrame, max_age_days: int, today: str) -> DataFrame:
    """(rule, key) over loaded records: no text, no date, nothing recent."""
    newest = records.agg(F.max("date").alias("d")).where(F.datediff(F.lit(today).cast("date"), F.col("d")) > max_age_days)
    return (
        records.where("words <= 0").select(F.lit("no words").alias("rule"), F.col("doc_id").cast("string").alias("key"))
        .unionByName(records.where("date IS NULL").select(F.lit("no date").alias("rule"), F.col("doc_id").cast("string").alias("key")))
        .unionByName(newest.select(F.lit("newest is too old").alias("rule"), F.col("d").cast("string").alias("key")))
    )


def download_state(measured: Column, declared: Column) -> Column:
    """Is a download whole, short, or not to be judged?"""
    return (
        F.when(measured.isNull(), "unreadable")
        .when(declared.isNull() | (declared <= 0), "undeclared")
        .when(measured / F.nullif(declared, F.lit(0.0)) >= MIN_DOWNLOADED, "whole")
        .otherwise("short")
    )


def run_batch(rows: DataFrame, text: str, call: Callable[[str], str]) -> DataFrame:
    """Adds ``answer`` and ``error`` from one outside call per row; a failure is a row, not an end.

    Spark runs the calls of all partitions side by side; write the result by
    partition to keep what is done.
    """
    schema = T.StructType([
        *rows.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())
    ])

    def one(value: str) -> tuple[str | None, str | None]:
        try:
            return call(value), None
        except Exception as problem:  # the row carries the failure on
            return None, f"{type(problem).__name__}: {problem}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [one(v) for v in frame[text]]
            yield frame.assign(answer=[d[0] for d in done], error=[d[1] for d in done])

    return rows.mapInPandas(run, schema)
