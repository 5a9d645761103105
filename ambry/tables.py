"""Readers for the supplied tables and the roles they play in the engine.

The engine works on a *corpus* (documents with text), its *passages* (windows
of words), and a *catalogue* side used for browsing (dated items with a person,
a type, a collection, references into works and topics). The supplied tables
stand in for those roles; the mapping is kept here, in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambry.functions.text import title_of

NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (doc_id, title, text, lang, source)."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return docs.select(
        "doc_id", title_of(F.col("text")).alias("title"), "text", "lang", "source"
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (doc_id, embedding); vec_id and doc_id share one numbering."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as browsable items: person, type, collection, date, part."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        F.concat(F.lit("C"), F.col("o_custkey")).alias("person"),
        # one priority stands for "no type", one status for "no collection"
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("kind"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("collection"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").alias("price"),
    )


def item_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with part: work = brand, chapter = line number - 1, topic = type."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("item_id"),
        F.col("p_brand").alias("work"),
        (F.col("l_linenumber") - 1).cast("int").alias("chapter"),
        F.col("p_type").alias("topic"),
    )


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue of works: one row per brand, in the order of its number."""
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    return (
        load(spark, sf_dir, "part")
        .groupBy(F.col("p_brand").alias("work"))
        .agg(F.first(number).alias("position"))
        .withColumn("section", F.when(F.col("position") <= 12, "first").otherwise("second"))
    )
