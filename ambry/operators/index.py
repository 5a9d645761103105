"""Building and refreshing the passage index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ambry.functions.paragraphs import sentences
from ambry.functions.text import tokens, words

CHUNK_WORDS = 200
OVERLAP_WORDS = 30
EMBED_BATCH = 64
MAX_PRUNE_FRACTION = 0.05


def windows(word_list: Column, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """Overlapping word windows as an array of texts.

    A later window shorter than the overlap says nothing new and is dropped;
    with the default sizes the last window is always longer than that.
    """
    stride = size - overlap
    n = F.size(word_list)
    full = F.ceil((n - size) / stride).cast("int") + 1
    tail = n - (full - 1) * stride
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(
        F.when(tail < overlap, full - 1).otherwise(full)
    )
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        at, lambda i: F.array_join(F.slice(word_list, i * stride + 1, F.lit(size)), " ")
    )


def window_at(word_list: Column, index: Column, size: int = CHUNK_WORDS,
              overlap: int = OVERLAP_WORDS) -> Column:
    """One window of a text, by its number."""
    return F.array_join(F.slice(word_list, index * (size - overlap) + 1, F.lit(size)), " ")


def chunk(docs: DataFrame, *keep: str, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS,
          with_tokens: bool = False) -> DataFrame:
    """Passages (doc_id, keep..., chunk_index, content) of whole texts; no shuffle.

    With ``with_tokens`` each passage also carries its folded tokens. They are
    made inside the generator so that Spark computes them once per passage; as
    a column added afterwards they would be inlined into every use.
    """
    split = docs.select("doc_id", *keep, words(F.col("text")).alias("_w"))
    texts = windows(F.col("_w"), size, overlap)
    if not with_tokens:
        return split.select("doc_id", *keep, F.posexplode(texts).alias("chunk_index", "content"))
    rows = F.transform(texts, lambda c: F.struct(c.alias("content"), tokens(c).alias("tokens")))
    return split.select("doc_id", *keep, F.posexplode(rows).alias("chunk_index", "_p")).select(
        "doc_id", *keep, "chunk_index", "_p.content", "_p.tokens"
    )


def sentence_chunk(docs: DataFrame, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """The older passages: whole sentences up to ``size`` words, each with the start of the next.

    Sentences are collected until they reach ``size``; a passage a quarter
    longer than that is cut into even pieces; every passage takes the first
    ``overlap`` words of its successor, and the last one, having none, is left
    out.
    """
    empty = F.struct(
        F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open")
    )

    def add(acc: Column, s: Column) -> Column:
        full = (F.size(acc["open"]) >= size) & (F.size(acc["open"]) + F.size(s) > size)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, s).otherwise(F.concat(acc["open"], s)).alias("open"),
        )

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])

    def pieces(w: Column) -> Column:
        count = F.ceil(F.size(w) / size).cast("int")
        each = F.floor(F.size(w) / count).cast("int")
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(w, i * each + 1, each))
        return F.when(F.size(w) > 1.25 * size, cut).otherwise(F.array(w))

    spoken = docs.select("doc_id", F.transform(sentences(F.col("text")), lambda s: words(s)).alias("_s"))
    packed = spoken.select("doc_id", F.aggregate("_s", empty, add, finish).alias("_p"))
    cut = packed.select("doc_id", F.flatten(F.transform("_p", pieces)).alias("_p"))
    whole = F.filter(
        F.transform("_p", lambda w, i: F.concat(w, F.slice(F.get("_p", i + 1), 1, overlap))), lambda w: w.isNotNull()
    )
    return cut.select("doc_id", F.posexplode(whole).alias("chunk_index", "_w")).select(
        "doc_id", "chunk_index", F.array_join("_w", " ").alias("content")
    )


def passage_hash(doc_id: Column, index: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws(":", doc_id.cast("string"), index.cast("string"), content), 256)


def changed(fresh: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Passages that are new or whose stored hash differs."""
    if force:
        return fresh
    old = stored.select("doc_id", "chunk_index", F.col("content_hash").alias("_old"))
    both = fresh.join(old, ["doc_id", "chunk_index"], "left")
    return both.where(~F.col("_old").eqNullSafe(F.col("content_hash"))).drop("_old")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` replace rows of ``stored`` with the same key."""
    kept = stored.join(incoming.select(*keys), keys, "left_anti")
    return kept.unionByName(incoming)


def upsert_status(stored: DataFrame, incoming: DataFrame, keys: list[str],
                  fields: list[str]) -> DataFrame:
    """Each key once with ``status`` new, fixed or same, in one shuffle.

    Fields are compared null-safely after parsing, so a difference in how a
    value was written down is not a correction.
    """
    s = stored.select(*keys, F.lit(True).alias("_s"), F.struct(*fields).alias("_sv"))
    i = incoming.select(*keys, F.lit(True).alias("_i"), F.struct(*fields).alias("_iv"))
    both = s.join(i, keys, "full_outer")
    status = (
        F.when(F.col("_s").isNull(), "new")
        .when(F.col("_i").isNotNull() & ~F.col("_sv").eqNullSafe(F.col("_iv")), "fixed")
        .otherwise("same")
    )
    value = F.when(F.col("_i").isNotNull(), F.col("_iv")).otherwise(F.col("_sv"))
    return both.select(*keys, status.alias("status"), value.alias("_v")).select(
        *keys, "status", *[F.col(f"_v.{f}").alias(f) for f in fields]
    )


def prune_plan(indexed: DataFrame, corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids in the index that the corpus no longer has."""
    return indexed.select(key).join(corpus.select(key), key, "left_anti")


def prune_check(indexed: DataFrame, corpus: DataFrame, key: str = "doc_id",
                ceiling: float = MAX_PRUNE_FRACTION) -> DataFrame:
    """One row saying how much a prune would delete and whether it is refused."""
    mark = corpus.select(key).distinct().withColumn("_kept", F.lit(1))
    totals = indexed.select(key).join(mark, key, "left").agg(
        F.count(F.lit(1)).alias("indexed"),
        F.count_if(F.col("_kept").isNull()).alias("remove"),
    )
    fraction = F.when(F.col("indexed") == 0, 0.0).otherwise(F.col("remove") / F.col("indexed"))
    return totals.select(
        "indexed", "remove", F.round(fraction, 9).alias("fraction"),
        # an empty corpus removes everything, which is over any ceiling
        (fraction > ceiling).alias("refused"),
    )


def prune(indexed: DataFrame, corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """``prune_plan`` behind its guard: raises instead of emptying the index."""
    row = prune_check(indexed, corpus, key).first()
    if row.refused:
        raise ValueError(
            f"pruning would delete {row['remove']} of {row.indexed} indexed documents; refused"
        )
    return prune_plan(indexed, corpus, key)


def cascade(children: dict[str, DataFrame], removed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Child tables without the rows of removed parents."""
    gone = removed.select(key).distinct()
    return {name: child.join(gone, key, "left_anti") for name, child in children.items()}


def embed(passages: DataFrame, model: Callable[[list[str]], list[list[float]]],
          dims: int, batch: int = EMBED_BATCH) -> DataFrame:
    """Adds a unit-length ``embedding`` per passage, a few texts per model call."""
    schema = T.StructType(
        [*passages.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[list[float]] = []
            texts = frame["content"].tolist()
            for at in range(0, len(texts), batch):
                part = model(texts[at : at + batch])
                if any(len(v) != dims for v in part):
                    raise ValueError(f"the model did not return {dims} dimensions")
                vectors += [_unit(v) for v in part]
            yield frame.assign(embedding=vectors)

    return passages.mapInPandas(run, schema)


def _unit(vec: list[float]) -> list[float]:
    length = sum(x * x for x in vec) ** 0.5
    return [x / length for x in vec] if length else list(vec)


def require_matched(read: int, matched: int, what: str) -> None:
    """Rows that were read but all filtered away mean a broken key, not no data."""
    if read > 0 and matched == 0:
        raise ValueError(f"{what}: none of {read} rows matched")
