"""Paragraphs out of running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ambry.functions.text import BLANK, count_words

TARGET_WORDS = 100
CHUNK_STRIDE = 170
_SENTENCE_GAP = rf"""(?<=[.!?…]["'”’)\]]?){BLANK}+"""


def _trim(col: Column) -> Column:
    return F.regexp_replace(col, rf"^{BLANK}+|{BLANK}+$", "")


def sentences(col: Column) -> Column:
    """Split after closing punctuation and an optional quote or bracket."""
    parts = F.transform(F.split(_trim(col), _SENTENCE_GAP), lambda s: _trim(s))
    return F.filter(parts, lambda s: s != "")


def paragraphs(sentence_list: Column, target: int = TARGET_WORDS) -> Column:
    """Sentences packed in order until a paragraph has ``target`` words; the rest is kept."""
    empty = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n")
    )

    def add(acc: Column, s: Column) -> Column:
        text = F.concat_ws(" ", acc["open"], s["text"])
        n = acc["n"] + s["n"]
        full = n >= target
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(text))).otherwise(acc["done"]).alias("done"),
            F.when(~full, text).alias("open"),
            F.when(full, 0).otherwise(n).alias("n"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    # counted beforehand: inside the fold the count would be evaluated at every mention
    counted = F.transform(sentence_list, lambda s: F.struct(s.alias("text"), count_words(s).alias("n")))
    return F.aggregate(counted, empty, add, finish)


def paragraph_sizes(paragraph_list: Column) -> Column:
    return F.transform(paragraph_list, lambda p: count_words(p))


def paragraph_at(sizes: Column, offset: Column) -> Column:
    """0-based paragraph that holds the word at ``offset``; 0 when it is out of range.

    ``sizes`` is ``paragraph_sizes``, made once per text.
    """
    start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("i"), F.lit(-1).alias("hit"))

    def step(acc: Column, n: Column) -> Column:
        here = F.when((acc["hit"] < 0) & (acc["seen"] + n > offset), acc["i"]).otherwise(acc["hit"])
        return F.struct((acc["seen"] + n).alias("seen"), (acc["i"] + 1).alias("i"), here.alias("hit"))

    found = F.aggregate(sizes, start, step, lambda acc: F.greatest(acc["hit"], F.lit(0)))
    return F.when(offset <= 0, 0).otherwise(found)
