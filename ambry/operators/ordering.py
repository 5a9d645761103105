"""Ordered computations that never put one group, or everything, into one task.

A window without a partition key runs in one task, and so does a window over a
key that holds a third of the rows. Here rows are range-partitioned on their
full order, which splits any key, and only one summary row per partition is
looked at across partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ambry.session import cut


def with_position(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``position`` (0-based rank in the order) and ``_block``.

    The order must be total. The placed rows are checkpointed because range
    bounds come from a sample: evaluated twice, they could differ.
    """
    placed = cut(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_block", F.spark_partition_id())
        .withColumn(
            "_at",
            F.monotonically_increasing_id() - F.shiftleft(F.col("_block").cast("long"), 33),
        )
    )
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    offsets = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")).select(
        "_block", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_before")
    )
    return placed.join(F.broadcast(offsets), "_block").select(
        *df.columns, (F.col("_before") + F.col("_at")).alias("position"), "_block"
    )


def carry_last(placed: DataFrame, group: list[str], value: Column, out: str,
               inclusive: bool = True) -> DataFrame:
    """Latest non-null ``value`` at or before each row of its group, in position order.

    ``placed`` comes from ``with_position`` with ``group`` leading the order.
    Each block is filled on its own; what a block inherits depends only on the
    last rows of the blocks before it.
    """
    rows = placed.withColumn("_v", value)
    end = 0 if inclusive else -1
    inside = Window.partitionBy("_block", *group).orderBy("position")
    filled = rows.withColumn(
        "_in", F.last("_v", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, end))
    )
    key = F.struct(*group)
    # per block: its first group, its last group, and that group's last value
    per_group = rows.groupBy("_block", *group).agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("position"))).alias("_last"),
        F.min("position").alias("_from"),
    )
    edges = per_group.groupBy("_block").agg(
        F.min_by(key, "_from").alias("_head"),
        F.max_by(F.struct(key.alias("g"), F.col("_last").alias("v")), "_from").alias("_tail"),
    )
    marks = edges.select("_block", F.col("_head").alias("_g"), F.lit(0).alias("_kind"),
                         F.lit(None).cast(rows.schema["_v"].dataType).alias("_v")).unionByName(
        edges.select("_block", F.col("_tail.g").alias("_g"), F.lit(1).alias("_kind"),
                     F.col("_tail.v").alias("_v"))
    )
    earlier = Window.partitionBy("_g").orderBy("_block", "_kind").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        marks.withColumn("_carry", F.last("_v", ignorenulls=True).over(earlier))
        .where("_kind = 0")
        .select("_block", *[F.col(f"_g.{c}").alias(c) for c in group], "_carry")
    )
    return (
        filled.join(F.broadcast(carried), ["_block", *group], "left")
        .withColumn(out, F.coalesce("_in", "_carry"))
        .drop("_v", "_in", "_carry")
    )


def shard(df: DataFrame, count: int, *order: str) -> DataFrame:
    """Contiguous balanced slices 1..count; the first slices take the remainder."""
    placed = with_position(df, *order)
    total = placed.agg(F.count(F.lit(1)).alias("n")).scalar()
    sized = placed.withColumn("_n", total)
    base, extra = F.floor(F.col("_n") / count), F.col("_n") % count
    edge = extra * (base + 1)
    long_slice = F.floor(F.col("position") / (base + 1))
    short_slice = extra + F.floor((F.col("position") - edge) / F.greatest(base, F.lit(1)))
    part = F.when(F.col("position") < edge, long_slice).otherwise(short_slice) + 1
    return sized.withColumn("shard", part.cast("int")).drop("_n", "_block")


def spread(df: DataFrame, count: int, *order: str) -> DataFrame:
    """Every n-th row so that ``count`` rows cover the whole order evenly.

    Row p is taken when some i < count has floor(i * n / count) = p, which the
    row can tell by itself.
    """
    placed = with_position(df, *order)
    total = placed.agg(F.count(F.lit(1)).alias("n")).scalar()
    sized = placed.withColumn("_n", total)
    i = F.ceil(F.col("position") * count / F.col("_n"))
    taken = (i < count) & (F.floor(i * F.col("_n") / count) == F.col("position"))
    return sized.where(taken | (F.col("_n") <= count)).drop("_n", "_block")


def grouped_median(df: DataFrame, group: list[str], value: str, tie: str) -> DataFrame:
    """Exact median of ``value`` per group: the middle one or two rows by position.

    ``tie`` is unique, so even a value that a third of the rows share is split.
    """
    placed = with_position(df.select(*group, value, tie), *group, value, tie)
    spans = placed.groupBy(*group).agg(F.min("position").alias("_from"), F.count(F.lit(1)).alias("_n"))
    middle = F.array_distinct(
        F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))
    )
    wanted = spans.select(F.explode(middle).alias("_m"), "_from").select(
        (F.col("_from") + F.col("_m")).alias("position")
    )
    return placed.join(wanted, "position").groupBy(*group).agg(F.avg(value).alias("median"))
