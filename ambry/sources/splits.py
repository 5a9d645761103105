"""Quoted records from files that are read in splits.

A line break inside quotes belongs to its record, so a reader that starts in
the middle of a file cannot tell at once whether it is inside quotes. Here
every split counts its quotes, the parities are summed over the splits of a
file, one row each, and with that every line knows the record it belongs to,
also where that began in an earlier split. Only records of several lines are
put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How cells are quoted; blanks in them are kept, and a missing one is empty.
CELLS = {
    "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    "emptyValue": "", "nullValue": "", "mode": "PERMISSIVE",
}
_LINES = "file string, block long, n long, open boolean, closed_start long, open_start long, value string"


def _marked(lines: DataFrame) -> DataFrame:
    """Lines (file, block, value), in the order of their split, with what a split can tell of them.

    ``open`` says whether the quotes before a line, in its split, are odd. The
    number of the line that begins its record is given for a split that begins
    outside quotes and for one that begins inside; -1 is a record begun before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, odd, starts = None, 0, False, [-1, -1]
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("file", "block", "n", "open", "closed_start", "open_start", "value")}
            for file, block, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != (file, block):
                    key, n, odd, starts = (file, block), 0, False, [-1, -1]
                starts[odd] = n
                for name, x in zip(out, (file, block, n, odd, starts[0], starts[1], value), strict=True):
                    out[name].append(x)
                odd ^= value.count('"') % 2 == 1
                n += 1
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("open", pa.bool_()),
        ("closed_start", pa.int64()), ("open_start", pa.int64()), ("value", pa.string()),
    ])
    return lines.select("file", "block", "value").mapInArrow(run, _LINES)


def records(lines: DataFrame) -> DataFrame:
    """(file, block, n, record): the records of lines (file, block, value), by where each begins.

    ``block`` orders the splits of a file. A carriage return before the end of
    a record goes, one inside quotes stays; quotes never closed run to the end of the file.
    """
    marked = _marked(lines)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    splits = marked.groupBy("file", "block").agg(
        (F.sum(quotes) % 2 == 1).alias("odd"), F.max("closed_start").alias("closed"), F.max("open_start").alias("opened")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = splits.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    last = F.when(F.col("inside"), F.col("opened")).otherwise(F.col("closed"))
    known = known.withColumn("_last", F.when(last >= 0, F.struct("block", last.alias("n")))).select(
        F.col("file").alias("_file"), F.col("block").alias("_block"), "inside",
        F.last("_last", ignorenulls=True).over(before).alias("carried"),
    )
    placed = marked.join(known, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    own = F.when(F.col("inside"), F.col("open_start")).otherwise(F.col("closed_start"))
    begun = F.when(own >= 0, F.struct("block", own.alias("n"))).otherwise(F.col("carried"))
    within = F.col("open") != F.col("inside")
    after = within != (quotes % 2 == 1)
    told = placed.select("file", "block", "n", "value", begun.alias("begun"), (within | after).alias("several"))
    single = told.where("NOT several").select("file", "block", "n", F.col("value").alias("record"))
    parts = told.where("several").groupBy("file", F.col("begun.block").alias("_b"), F.col("begun.n").alias("_n")).agg(
        F.array_sort(F.collect_list(F.struct("block", "n", "value"))).alias("_lines")
    )
    joined = parts.select(
        "file", F.col("_b").alias("block"), F.col("_n").alias("n"), F.array_join("_lines.value", "\n").alias("record")
    )
    return single.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r\\z", ""))


def parsed(record: Column, columns: list[str]) -> Column:
    """One record's cells as a struct of texts; missing ones are ''."""
    read = F.from_csv(record, ", ".join(f"`{c}` string" for c in columns), CELLS)
    return F.struct(*[F.coalesce(read[c], F.lit("")).alias(c) for c in columns])


def _rows(found: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    cells = found.withColumn("_r", parsed(F.col("record"), columns))
    some = F.exists(F.array(*[F.col(f"_r.`{c}`") for c in columns]), lambda x: F.trim(x) != "")
    return cells.where(some).select(*keep, *[F.col(f"_r.`{c}`").alias(c) for c in columns])


def read_split_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``records.read_csv`` for files of any size: a file is read by as many tasks as it has splits.

    The first record of each file is its header. Rows without any text are dropped.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    return _rows(records(lines).where("block > 0 OR n > 0"), columns, [])


def parse_texts(texts: DataFrame, key: str, text: str, columns: list[str]) -> DataFrame:
    """(key, n, columns...): the records in a column of texts, each by the line it begins at; a text is a file of its own.

    A null or empty text has none.
    """
    lines = texts.where(F.col(text).isNotNull()).select(
        F.col(key).cast("string").alias("file"), F.lit(0).cast("long").alias("block"), F.explode(F.split(text, "\n")).alias("value")
    )
    kind = texts.schema[key].dataType
    return _rows(records(lines), columns, ["file", "n"]).select(F.col("file").cast(kind).alias(key), "n", *columns)
