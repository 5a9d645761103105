"""Integrity rules over the derived tables, and the verdict they add up to."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR, WARNING = "error", "warning"
#: rows of one table that a task sorts or groups; nearly every key is another one, so a task holds them all
ROWS_A_TASK = 1_500_000


def _problem(rows: DataFrame, severity: str, rule: str, key: Column) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")


def problems(
    docs: DataFrame,
    facets: DataFrame,
    refs: DataFrame,
    works: DataFrame,
    collections: DataFrame,
    variants: DataFrame,
    expected_works: int | None = None,
) -> DataFrame:
    """(severity, rule, key) of every violation; joins and counts only.

    docs (doc_id), facets (doc_id, raw_slug), refs (doc_id, work, chapter),
    works (work, chapters), collections (slug, parent_slug), variants
    (variant_slug, slug). Documents, facets and references are dealt by
    document once, to as many tasks as their rows need.
    """
    docs, facets, refs = docs.select("doc_id"), facets.select("doc_id", "raw_slug"), refs.select("doc_id", "work", "chapter")
    tasks = max(1, ceil(max(rows.count() for rows in (docs, facets, refs)) / ROWS_A_TASK))
    docs, facets, refs = (rows.repartition(tasks, "doc_id") for rows in (docs, facets, refs))
    found = [
        _problem(
            collections.where("parent_slug <> '' AND parent_slug <> slug").join(
                collections.select(F.col("slug").alias("parent_slug")), "parent_slug", "left_anti"
            ), ERROR, "parent collection does not exist", F.col("slug")),
        _problem(collections.where("parent_slug = slug"), ERROR, "collection is its own parent", F.col("slug")),
        _problem(facets.join(docs, "doc_id", "left_anti"), ERROR, "facets of an unknown document", F.col("doc_id")),
        _problem(_repeated(facets, "doc_id"), ERROR, "document has facets twice", F.col("doc_id")),
        _problem(docs.join(facets, "doc_id", "left_anti"), ERROR, "document without facets", F.col("doc_id")),
        _problem(refs.join(docs, "doc_id", "left_anti"), ERROR, "reference of an unknown document", F.col("doc_id")),
        _problem(refs.join(works, "work", "left_anti").select("work").distinct(), ERROR, "unknown work", F.col("work")),
        _problem(
            refs.join(works, "work").where("chapter < 0 OR chapter > chapters"), ERROR, "chapter outside its work",
            F.concat_ws("|", "doc_id", "work", "chapter")),
        _problem(
            _repeated(refs, "doc_id", "work", "chapter"), ERROR, "reference given twice",
            F.concat_ws("|", "doc_id", "work", "chapter")),
        _problem(
            facets.where("trim(raw_slug) <> ''").select(F.trim("raw_slug").alias("variant_slug")).distinct()
            .join(variants, "variant_slug", "left_anti"), WARNING, "collection not known yet", F.col("variant_slug")),
    ]
    if expected_works is not None:
        counted = works.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected_works)
        found.append(_problem(counted, ERROR, "number of works", F.col("n")))
    return reduce(DataFrame.unionByName, found)


def verdict(rows: DataFrame) -> DataFrame:
    """One row: errors, warnings, exit code 1 for errors, 2 for warnings only, else 0."""
    sums = rows.agg(
        F.count_if(F.col("severity") == ERROR).alias("errors"),
        F.count_if(F.col("severity") == WARNING).alias("warnings"),
    )
    code = F.when(F.col("errors") > 0, 1).when(F.col("warnings") > 0, 2).otherwise(0)
    return sums.withColumn("exit_code", code)


def newest(rows: DataFrame, date: str, key: str) -> DataFrame:
    """The newest record: an argmax, least key on a tie."""
    return rows.agg(F.max_by(F.struct(key, date), F.struct(date, -F.col(key))).alias("r")).select("r.*")
