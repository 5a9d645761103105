"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambry.session import cut


def _least_neighbour(links: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours in (u, v); combined before the shuffle."""
    return cut(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))


def large_star(links: DataFrame) -> DataFrame:
    """Every node links its greater neighbours to the least of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = both.where("v > u").join(_least_neighbour(both), "u")
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Every node links itself and its lesser neighbours to the least of those."""
    found = links.join(_least_neighbour(links), "u")
    moved = found.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(found.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
    return tuple(row)


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node in the undirected ``pairs`` (a, b); root is the least node.

    Rounds go on until nothing changes; their number grows with the logarithm
    of the longest chain. Each reduction is a minimum per node, and the join
    that spreads it has plain exchanges on both sides, so a node with very many
    neighbours can be split. Null ends, loops and repeated pairs are left out;
    no pairs give no rows.
    """
    links = cut(
        pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(links)
    while state[0]:
        links = cut(small_star(cut(large_star(links))))
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
