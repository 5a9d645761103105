"""The stored text index: built once, refreshed by what changed, read by every search.

A passage is one row with its length, hash and terms: each lexeme and its
places. Texts are analysed once, for that row; all else is made from what was
written. Postings are the terms sorted by lexeme, so a search reads the row
groups of its own lexemes, while many queries at once read the passages. Titles
are indexed the same way. The frequencies of lexemes and two totals lie beside
them. All tables of a version are replaced together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambry.functions.analysis import Analyser
from ambry.functions.text import tokens
from ambry.operators import index
from ambry.operators.postings import analysed, inverted, placed
from ambry.operators.retrieval import PASSAGE_KEY
from ambry.session import cut, scratch_path
from ambry.sources.versions import Versions

TABLES = ("postings", "titles", "passages", "frequencies", "totals")


@dataclass(frozen=True)
class TextIndex:
    """The tables of one version.

    ``postings`` and ``titles`` are (lexeme, doc_id, chunk_index, length, steps), ``passages`` is (doc_id,
    chunk_index, content_hash, length, terms), ``frequencies`` (lexeme, passages), ``totals`` one row (passages, mean).
    """

    postings: DataFrame
    titles: DataFrame
    passages: DataFrame
    frequencies: DataFrame
    totals: DataFrame


def steps(places: Column) -> Column:
    """Ascending places as the first one and the distances between them."""
    return F.transform(places, lambda p, i: p - F.coalesce(F.get(places, i - 1), F.lit(0)))


def places(step_list: Column) -> Column:
    """Places from ``steps``; no places for null."""
    summed = F.transform(step_list, lambda s, i: F.aggregate(F.slice(step_list, 1, i + 1), F.lit(0), lambda a, x: a + x))
    return F.coalesce(summed, F.array().cast("array<int>"))


def _hash() -> Column:
    return index.passage_hash(F.col("doc_id"), F.col("chunk_index"), F.col("content")).alias("content_hash")


def _passages(docs: DataFrame, *keep: str) -> DataFrame:
    return index.chunk(docs, *keep, with_tokens=True).select(*PASSAGE_KEY, *keep, "tokens", _hash())


def _sorted(table: DataFrame) -> DataFrame:
    order = ("lexeme", *PASSAGE_KEY)  # a lexeme found everywhere is spread over many files
    return table.repartitionByRange(*order).sortWithinPartitions(*order)


def _publish(store: Versions, docs: DataFrame, analyser: Analyser, rows: DataFrame) -> int:
    headed = docs.select("doc_id", F.lit(0).alias("chunk_index"), tokens(F.coalesce("title", F.lit(""))).alias("tokens"))
    return store.publish({
        "passages": rows,
        "titles": _sorted(placed(headed, analyser)),
        # from what was written: a range sort reads its input twice
        "postings": lambda written: _sorted(inverted(written["passages"])),
        "frequencies": lambda written: written["postings"].groupBy("lexeme").agg(F.count(F.lit(1)).alias("passages"))
        .repartitionByRange("lexeme").sortWithinPartitions("lexeme"),
        "totals": lambda written: written["passages"].agg(F.count(F.lit(1)).alias("passages"), F.avg("length").alias("mean")),
    })


def build(store: Versions, docs: DataFrame, analyser: Analyser) -> int:
    """Indexes ``docs`` (doc_id, title, text) as a new version, whose number is returned."""
    return _publish(store, docs, analyser, analysed(_passages(docs), analyser, "content_hash"))


def open_index(store: Versions) -> TextIndex:
    row = store.current()
    if row is None:
        raise LookupError(f"nothing was indexed in {store.root}")
    return TextIndex(*[store.spark.read.parquet(f"{row.folder}/{name}") for name in TABLES])


def differences(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, state) of passages that are new, changed or gone, in one shuffle."""
    was = old.select(*PASSAGE_KEY, F.col("content_hash").alias("was"))
    both = fresh.select(*PASSAGE_KEY, F.col("content_hash").alias("now")).join(was, [*PASSAGE_KEY], "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") != F.col("now"), "changed")
    return both.select(*PASSAGE_KEY, state.alias("state")).where("state IS NOT NULL")


def refresh(store: Versions, docs: DataFrame, analyser: Analyser) -> int:
    """A version with the passages of ``docs`` as they are now.

    Only passages that are new or changed are analysed; the rows of those that
    changed or went are left out, and all others are kept as they are.
    """
    old = open_index(store)
    touched = cut(differences(old.passages, index.chunk(docs).select(*PASSAGE_KEY, _hash())))
    # a document meets the numbers of its passages before it is split: no tokens are shuffled
    numbers = touched.where("state <> 'gone'").groupBy("doc_id").agg(F.collect_set("chunk_index").alias("_again"))
    again = _passages(docs.join(numbers, "doc_id"), "_again").where("array_contains(_again, chunk_index)")
    # written, so that the join below knows how few they are and need not shuffle all passages
    path = scratch_path(store.spark, "stale")
    touched.where("state <> 'new'").select(*PASSAGE_KEY).write.parquet(path)
    kept = old.passages.join(store.spark.read.parquet(path), [*PASSAGE_KEY], "left_anti")
    return _publish(store, docs, analyser, kept.unionByName(analysed(again, analyser, "content_hash")))
