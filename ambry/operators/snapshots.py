"""What changes between snapshots of a feed that shows its newest entries only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambry.session import cut

WINDOW = 500


def changes(snapshots: DataFrame) -> DataFrame:
    """(snapshot, slug, change): how each entry's presence differs from the snapshot before.

    ``snapshots`` is (snapshot, slug, place) with snapshots numbered without
    gaps and places that grow with age, over all of them. ``new`` and ``back`` entries came, the
    latter having been seen before; an entry that went has ``aged`` out if it is older than
    the oldest one still shown, and otherwise ``died``. The history is one row
    per entry and change: what stays is not repeated, and the first snapshot is all new.
    """
    held = cut(snapshots.groupBy("snapshot", "slug").agg(F.min("place").alias("place")))
    edges = held.groupBy("snapshot").agg(F.max("place").alias("oldest"))
    first = held.groupBy("slug").agg(F.min("snapshot").alias("first"))
    before = held.select((F.col("snapshot") + 1).alias("snapshot"), "slug", F.col("place").alias("was"))
    both = held.join(before, ["snapshot", "slug"], "full_outer")
    # a row per snapshot; entries of the last one have no snapshot to be gone from
    told = both.join(edges, "snapshot").join(first, "slug")
    change = (
        F.when(F.col("place").isNull(), F.when(F.col("was") > F.col("oldest"), "aged").otherwise("died"))
        .when(F.col("was").isNull(), F.when(F.col("first") < F.col("snapshot"), "back").otherwise("new"))
    )
    return told.select("snapshot", "slug", change.alias("change")).where("change IS NOT NULL")


def state(history: DataFrame) -> DataFrame:
    """(slug, change, snapshot): the last thing that happened to each entry; one row an entry, however long the history."""
    last = history.groupBy("slug").agg(F.max(F.struct("snapshot", "change")).alias("l"))
    return last.select("slug", "l.change", "l.snapshot")
