"""Fuzzy name matching and the clusters it induces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambry.functions.names import digit_signature, edit_ratio, joined_tokens, sorted_tokens
from ambry.session import cut

THRESHOLD = 0.88
_EPS = 1e-9


def _budget(length: Column, threshold: float) -> Column:
    """Edits two strings may differ by when the longer one has ``length`` characters."""
    return F.floor(length * (1 - threshold) + _EPS).cast("int")


def _piece_start(length: Column, pieces: Column, i: Column) -> Column:
    """0-based start of piece ``i`` when a string is cut into even pieces."""
    return F.floor(i * length / pieces).cast("int")


def name_keys(names: DataFrame) -> DataFrame:
    """Distinct names with their two comparison forms and their numbers."""
    col = F.col("name")
    return names.groupBy("name").agg(F.sum("count").alias("count")).select(
        "name", "count", joined_tokens(col).alias("joined"), sorted_tokens(col).alias("ordered"),
        digit_signature(col).alias("signature"),
    )


def _pieces(keys: DataFrame, form: str, threshold: float) -> DataFrame:
    """Each string cut into one piece more than the edits it may suffer.

    Whatever string it is matched with as the shorter one, some piece survives
    unedited.
    """
    length = F.length(form)
    most = F.floor(length / threshold + _EPS)
    count = _budget(most, threshold) + 1
    base = keys.select("name", "signature", F.col(form).alias("s"), length.alias("length"), count.alias("pieces"))
    cut_up = base.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("i"))
    start = _piece_start(F.col("length"), F.col("pieces"), F.col("i"))
    stop = _piece_start(F.col("length"), F.col("pieces"), F.col("i") + 1)
    return cut_up.select(
        F.col("name").alias("a"), F.col("s").alias("sa"), "signature", "length", "i",
        F.substring("s", start + 1, stop - start).alias("piece"),
    )


def _probes(keys: DataFrame, form: str, threshold: float) -> DataFrame:
    """Every substring at which a piece of some shorter-or-equal string may sit.

    Pieces before the surviving one absorb at most i edits and those after it
    at most budget - i, which bounds how far it can have moved.
    """
    base = keys.select("name", "signature", F.col(form).alias("s"), F.length(form).alias("n"))
    least = F.ceil(F.col("n") * threshold - _EPS).cast("int")
    per_length = base.select("*", F.explode(F.sequence(least, F.col("n"))).alias("length"))
    most = F.floor(F.col("length") / threshold + _EPS)
    per_length = per_length.withColumn("pieces", _budget(most, threshold) + 1)
    per_piece = per_length.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("i"))
    start = _piece_start(F.col("length"), F.col("pieces"), F.col("i"))
    stop = _piece_start(F.col("length"), F.col("pieces"), F.col("i") + 1)
    shift, budget = F.col("n") - F.col("length"), F.col("pieces") - 1
    low = F.greatest(start - F.col("i"), start + shift - (budget - F.col("i")), F.lit(0))
    high = F.least(start + F.col("i"), start + shift + (budget - F.col("i")), F.col("n") - (stop - start))
    spots = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return per_piece.select("name", "signature", "length", "i", "s", (stop - start).alias("w"), F.explode(spots).alias("at")).select(
        F.col("name").alias("b"), F.col("s").alias("sb"), "signature", "length", "i",
        F.expr("substring(s, at + 1, w)").alias("piece"),
    )


def similar_pairs(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a < b) of names with equal numbers and similarity >= threshold.

    Exact, without comparing all names with each other: two strings within the
    edit budget share an unedited piece at nearly the same place, so pairs are
    found by an equi-join on (numbers, length, piece). Each is verified where
    it is found and only true pairs are shuffled on; a form in which a pair was
    not found is below the threshold and cannot be its maximum. Equal names
    are merged before, which is where the repetition in real data sits.
    """
    keys = cut(name_keys(names))
    found = []
    for form in ("joined", "ordered"):
        left, right = _pieces(keys, form, threshold), _probes(keys, form, threshold)
        close = edit_ratio(F.col("sa"), F.col("sb"))
        found.append(
            left.join(right, ["signature", "length", "i", "piece"])
            .where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round(close, 9).alias("similarity"))
            .where(F.col("similarity") >= threshold - _EPS)
        )
    return reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of (a, b) edges, root = least node.

    Alternates two local rewirings until nothing changes: every node links its
    larger neighbours to its least one, then its smaller ones. Both are a
    minimum per node, combined map-side, joined back to the edges; a node with
    very many neighbours is only ever a large join key, which adaptive
    execution splits. Rounds grow with the logarithm of the longest chain.
    """
    links = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct()
    )
    while True:
        # large star: over all neighbours, link the larger ones to the least
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node and its smaller neighbours are linked to the least of those
        down = cut(large)
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(joined.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        fresh = cut(small)
        settled = fresh.join(links, ["u", "v"], "left_anti").isEmpty() and links.join(
            fresh, ["u", "v"], "left_anti"
        ).isEmpty()
        links = fresh
        if settled:
            break
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def cluster_names(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(name, count, cluster, cluster_count, head): head is the most frequent spelling."""
    keys = name_keys(names).select("name", "count")
    linked = components(similar_pairs(names, threshold))
    members = keys.join(linked.withColumnRenamed("node", "name"), "name", "left").select(
        "name", "count", F.coalesce("root", "name").alias("cluster")
    )
    heads = members.groupBy("cluster").agg(
        F.sum("count").alias("cluster_count"),
        F.min_by("name", F.struct(-F.col("count"), "name")).alias("head"),
    )
    return members.join(heads, "cluster").select("name", "count", "head", "cluster_count")

