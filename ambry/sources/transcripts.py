"""Transcripts, word alignments, sidecars and stored embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALIGNMENT = "segments array<struct<text:string,end:double,words:array<struct<word:string,score:double>>>>"


def file_name(path: Column) -> Column:
    return F.url_decode(F.element_at(F.split(path, "/"), -1))


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(file, text): one row per file, whole."""
    raw = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return raw.select(file_name(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("text"))


def safe_name(col: Column) -> Column:
    """A bare file name; anything that could leave its folder is null."""
    return F.when(col.rlike(r"^[^/\\\x00]+$") & ~col.isin(".", ".."), col)


def with_transcripts(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents with their text; a missing or unsafe file leaves it null."""
    named = docs.withColumn("file", safe_name(F.col("transcript_file")))
    return named.join(texts, "file", "left").drop("file")


def clean_lines(text: Column) -> Column:
    """Lines joined by blanks, without bracketed markers."""
    # without the dot-all flag a marker never reaches past its line
    bare = F.transform(F.split(text, r"\R"), lambda s: F.trim(F.regexp_replace(s, r"\[.+\]\s+", "")))
    lines = F.when(text.rlike(r"\R\z"), F.slice(bare, 1, F.size(bare) - 1)).otherwise(bare)
    return F.array_join(lines, " ")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(file, segments) from gzipped JSON, one document per file."""
    raw = spark.read.schema(ALIGNMENT).option("multiLine", True).json(path)
    return raw.select(file_name(F.col("_metadata.file_path")).alias("file"), "segments")


SIDECAR = (
    "id string, title string, description string, artist string, duration double, timestamp long, "
    "view_count long, webpage_url string"
)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(file, track fields) from one JSON document per track."""
    raw = spark.read.schema(SIDECAR).option("multiLine", True).json(path)
    return raw.select(file_name(F.col("_metadata.file_path")).alias("file"), *raw.columns)


def spoken_words(alignments: DataFrame, key: str = "file") -> DataFrame:
    """(key, words): one row per segment, as ``quality.weighted_score`` reads them."""
    return alignments.select(key, F.explode("segments").alias("s")).select(key, F.col("s.words").alias("words"))


def last_end(segments: Column) -> Column:
    return F.try_element_at(segments, F.lit(-1))["end"]


def stem_and_id(file: Column) -> tuple[Column, Column]:
    """'title [id].ext' taken apart: (title, id)."""
    pattern = r"^(.*?)\s*\[([^\[\]]+)\](?:\.[A-Za-z0-9]+)?$"
    return F.regexp_extract(file, pattern, 1), F.nullif(F.regexp_extract(file, pattern, 2), F.lit(""))


def packet_times(output: Column) -> Column:
    """Timestamps of a probe's output: the first field of every line."""
    lines = F.filter(F.split(output, r"\R"), lambda s: F.trim(s) != "")
    return F.transform(lines, lambda s: F.trim(F.get(F.split(s, ","), F.lit(0))).cast("double"))


def zip_store(metas: DataFrame, vectors: DataFrame, key: str = "file") -> DataFrame:
    """Rows of stored passages beside their vectors; files whose counts differ are left out.

    ``metas`` is (key, metas array), ``vectors`` is (key, vectors array).
    """
    both = metas.join(vectors, key).where(F.size("metas") == F.size("vectors"))
    return both.select(key, F.posexplode(F.arrays_zip("metas", "vectors")).alias("split_id", "z")).select(
        key, "split_id", F.col("z.metas").alias("meta"), F.col("z.vectors").alias("embedding")
    )
