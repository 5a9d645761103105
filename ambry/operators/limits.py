"""Fixed-window rate limiting over a log of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambry.operators.ordering import carry_last, with_position
from ambry.session import cut


def window_starts(hits: DataFrame, width: int) -> DataFrame:
    """(key, t, event) of the hits that open a window.

    A key's first hit opens one; the next is opened by the first hit at or
    after its end. Following that chain hit by hit would run a busy key in one
    task, so all hits learn their successor at once and the chain is found by
    doubling: in round k everything 2^k steps away joins in.
    """
    first = hits.groupBy("key", "t").agg(F.min("event").alias("event"))
    probes = first.select("key", (F.col("t") + width).alias("at"), F.lit(1).alias("kind"), "t")
    known = first.select("key", F.col("t").alias("at"), F.lit(0).alias("kind"), "t")
    # latest first, so the value carried to a probe is the earliest hit not before it
    both = known.unionByName(probes).withColumn("back", -F.col("at"))
    placed = with_position(both, "key", "back", "kind", "t")
    seen = carry_last(placed, ["key"], F.when(F.col("kind") == 0, F.col("at")), "next")
    jump = cut(seen.where("kind = 1 AND next IS NOT NULL").select("key", "t", "next"))
    reach = first.groupBy("key").agg(F.min("t").alias("t"))
    while not jump.isEmpty():
        step = reach.join(jump, ["key", "t"]).select("key", F.col("next").alias("t"))
        reach = cut(reach.unionByName(step))
        onward = jump.select("key", F.col("t").alias("next"), F.col("next").alias("after"))
        jump = cut(jump.join(onward, ["key", "next"]).select("key", "t", F.col("after").alias("next")))
    return first.join(reach, ["key", "t"], "left_semi")


def rate_limit(hits: DataFrame, limit: int, width: int) -> DataFrame:
    """Hits (key, t, event) with ``accepted``: at most ``limit`` per window of a key."""
    opened = window_starts(hits, width).select("event", F.lit(True).alias("_opens"))
    marked = hits.join(opened, "event", "left")
    placed = with_position(marked, "key", "t", "event")
    start = F.when(F.col("_opens"), F.col("position"))
    numbered = carry_last(placed, ["key"], start, "_start")
    return numbered.select(
        "key", "t", "event", (F.col("position") - F.col("_start") < limit).alias("accepted")
    )
