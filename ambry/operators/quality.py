"""Corpus quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambry.operators.ordering import carry_last, grouped_median, with_position

MIN_COVERAGE = 0.90
MIN_DOWNLOADED = 0.999
MIN_FEED_ITEMS = 100
MAX_DEAD_JUMP = 0.15
# The characters that do not count towards a word's weight.
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def weighted_score(segments: DataFrame, key: str) -> DataFrame:
    """Mean word confidence per recording, 0..100, weighted by bare word length.

    ``segments`` has ``words: array<struct<word, score>>``; a missing score is 0.
    """
    spoken = segments.select(key, F.explode("words").alias("w")).select(
        key,
        F.length(F.regexp_replace("w.word", PUNCTUATION, "")).alias("weight"),
        F.coalesce("w.score", F.lit(0.0)).alias("score"),
    )
    sums = spoken.groupBy(key).agg(
        F.sum(F.round(F.col("score") * F.col("weight"), 6)).alias("s"), F.sum("weight").alias("n")
    )
    return sums.select(
        key, F.round(F.when(F.col("n") > 0, 100 * F.round(F.col("s"), 6) / F.col("n")).otherwise(0.0), 1).alias("score")
    )


def coverage(last_end: Column, declared: Column, byte_size: Column | None = None) -> Column:
    """Share of the recording the transcript reaches.

    Without a declared length, 16 kHz 16-bit mono audio with a 44-byte header
    is assumed to know its own.
    """
    duration = declared
    if byte_size is not None:
        duration = F.coalesce(F.nullif(declared, F.lit(0.0)), (byte_size - 44) / (16000 * 2))
    share = F.when(duration > 0, last_end / duration).otherwise(0.0)
    return F.coalesce(share, F.lit(0.0))


def content_seconds(stamps: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Stamps times their median interval per key; null below two stamps."""
    placed = with_position(stamps.select(key, at, tie), key, at, tie)
    gaps = carry_last(placed, [key], F.col(at), "_prev", inclusive=False)
    deltas = gaps.where("_prev IS NOT NULL").select(key, tie, (F.col(at) - F.col("_prev")).alias("delta"))
    counts = stamps.groupBy(key).agg(F.count(F.lit(1)).alias("stamps"))
    return counts.join(grouped_median(deltas, [key], "delta", tie), key, "left").select(
        key, "stamps", F.when(F.col("median") > 0, F.col("stamps") * F.col("median")).alias("seconds")
    )


USAGE_SCHEMA = (
    "usage struct<prompt_tokens:bigint,completion_tokens:bigint,cost:double,"
    "prompt_tokens_details:struct<cached_tokens:bigint>>"
)


def usage_totals(replies: DataFrame, payload: str = "payload") -> DataFrame:
    """Totals over model replies that carry a usage block; absent numbers count as 0."""
    read = replies.select(F.from_json(payload, USAGE_SCHEMA).alias("p")).where("p.usage IS NOT NULL")

    def total(path: str) -> Column:
        return F.coalesce(F.sum(F.coalesce(F.col(f"p.usage.{path}"), F.lit(0))), F.lit(0))

    sums = read.agg(
        F.count(F.lit(1)).alias("calls"),
        total("prompt_tokens").alias("prompt_tokens"),
        total("completion_tokens").alias("completion_tokens"),
        total("prompt_tokens_details.cached_tokens").alias("cached_tokens"),
        F.round(total("cost"), 6).alias("cost"),
    )
    share = F.floor(100 * F.col("cached_tokens") / F.col("prompt_tokens") + 0.5).cast("int")
    return sums.withColumn("cached_percent", F.when(F.col("prompt_tokens") > 0, share))


def dead_fraction(liveness: DataFrame) -> DataFrame:
    return liveness.agg(
        F.coalesce(F.avg((~F.col("alive")).cast("double")), F.lit(0.0)).alias("dead_fraction")
    )


def liveness_check(previous: DataFrame, fresh: DataFrame, ceiling: float = MAX_DEAD_JUMP) -> DataFrame:
    """One row: dead share before and after, and whether the jump is refused."""
    marked = previous.select("alive", F.lit(0).alias("run")).unionByName(
        fresh.select("alive", F.lit(1).alias("run"))
    )
    dead = (~F.col("alive")).cast("double")
    shares = marked.agg(
        F.count_if(F.col("run") == 0).alias("previous_rows"),
        F.coalesce(F.avg(F.when(F.col("run") == 0, dead)), F.lit(0.0)).alias("before"),
        F.coalesce(F.avg(F.when(F.col("run") == 1, dead)), F.lit(0.0)).alias("after"),
    )
    refused = (F.col("previous_rows") > 0) & (F.col("after") - F.col("before") > ceiling)
    return shares.select(
        F.round("before", 9).alias("before"), F.round("after", 9).alias("after"), refused.alias("refused")
    )


def require_live_feed(slugs: DataFrame, minimum: int = MIN_FEED_ITEMS) -> None:
    """A short feed means a broken feed; marking an archive dead needs a whole one."""
    n = slugs.count()
    if n < minimum:
        raise ValueError(f"the feed has {n} items, fewer than {minimum}; refused")
