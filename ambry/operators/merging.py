"""From name clusters and decisions about them to published collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambry.functions.names import collection_kind, lenient_key
from ambry.functions.text import slugify


def stacked(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, with the columns of any; what a frame does not have is null in its rows."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def follow(links: DataFrame, hops: int = 9) -> DataFrame:
    """(id, root): where ``merge_into`` pointers lead after at most ``hops`` steps.

    A pointer counts only if its target has a row of its own; a cycle is left
    after the last step. Steps are composed by doubling: nine need four joins.
    """
    known = links.select(F.col("id").alias("merge_into"), F.lit(True).alias("_known"))
    one = links.join(known, "merge_into", "left").select(
        "id", F.when(F.col("_known"), F.col("merge_into")).otherwise(F.col("id")).alias("root")
    )

    def compose(first: DataFrame, then: DataFrame) -> DataFrame:
        onward = then.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        return first.join(onward, "root").select("id", F.col("_next").alias("root"))

    done, power, left = None, one, hops
    while left:
        if left & 1:
            done = power if done is None else compose(done, power)
        left >>= 1
        if left:
            power = compose(power, power)
    return done


def published_slugs(members: DataFrame, committed: DataFrame) -> DataFrame:
    """(id, prior): slug already published for the best-placed member of a cluster.

    ``members`` is (id, place, name), ``committed`` is (variant_slug, slug).
    """
    known = members.select("id", "place", slugify(F.col("name")).alias("variant_slug"))
    return known.join(committed, "variant_slug").groupBy("id").agg(F.min_by("slug", "place").alias("prior"))


def _placed(clusters: DataFrame, decisions: DataFrame, prior: DataFrame | None) -> DataFrame:
    """Every cluster with the name and the slug of the collection it goes to."""
    roots = follow(decisions)
    placed = clusters.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    heads = clusters.select(F.col("id").alias("root"), F.col("head").alias("root_head"))
    decided = decisions.select(F.col("id").alias("root"), F.trim("name").alias("decided"), "description", "parent")
    named = placed.join(heads, "root", "left").join(decided, "root", "left")
    name = F.coalesce(F.nullif(F.col("decided"), F.lit("")), F.col("root_head"))
    slug = slugify(F.col("name"))
    named = named.withColumn("name", name)
    if prior is not None:
        own = prior.select("id", F.col("prior").alias("own"))
        of_root = prior.select(F.col("id").alias("root"), F.col("prior").alias("of_root"))
        named = named.join(own, "id", "left").join(of_root, "root", "left")
        slug = F.coalesce("own", "of_root", slug)
    return named.withColumn("slug", slug)


def collection_variants(
    clusters: DataFrame, decisions: DataFrame, members: DataFrame, prior: DataFrame | None = None
) -> DataFrame:
    """(slug, variants): the names that went to each collection, by cluster and place, with bars between.

    ``members`` is (id, place, name). A name that several clusters bear is listed for each.
    """
    owned = members.join(_placed(clusters, decisions, prior).select("id", "slug"), "id")
    listed = F.array_sort(F.collect_list(F.struct("id", "place", "name")))
    return owned.groupBy("slug").agg(F.array_join(F.transform(listed, lambda m: m["name"]), "|").alias("variants"))


def build_collections(clusters: DataFrame, decisions: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(slug, name, kind, parent_slug, description, total), one row per collection.

    ``clusters`` is (id, head, count), ``decisions`` (id, name, description,
    parent, merge_into), ``prior`` (id, prior). Clusters with the same slug
    merge, the lowest id naming them. Parents resolve by lenient key unless
    that is the row itself, and a row used as a parent is a course head.
    """
    named = _placed(clusters, decisions, prior)
    plain = collection_kind(F.col("name"))
    kind = F.when(plain == "ebd", collection_kind(F.col("head"))).otherwise(plain)
    rows = (
        named.groupBy("slug")
        .agg(
            F.min_by(
                F.struct("name", kind.alias("kind"), F.coalesce("description", F.lit("")).alias("description"),
                         F.nullif("parent", F.lit("")).alias("parent"), F.col("id").alias("first_id")), "id"
            ).alias("r"),
            F.sum("count").alias("total"),
        )
        .select("slug", "r.*", "total")
    )
    # the last row wins a lenient key
    targets = rows.groupBy(lenient_key(F.col("name")).alias("_key")).agg(F.max_by("slug", "first_id").alias("_target"))
    linked = rows.withColumn("_key", lenient_key(F.col("parent"))).join(targets, "_key", "left")
    resolved = F.when(F.col("_target").isNotNull() & (F.col("_target") != F.col("slug")), F.col("_target"))
    linked = linked.withColumn(
        "parent_slug", F.when(F.col("parent").isNotNull(), F.coalesce(resolved, slugify(F.col("parent"))))
    )
    parents = linked.where("parent_slug IS NOT NULL").select(F.col("parent_slug").alias("slug"), F.lit(True).alias("_head")).distinct()
    return linked.join(parents, "slug", "left").select(
        "slug", "name", F.when(F.col("_head"), "cfw").otherwise(F.col("kind")).alias("kind"),
        "parent_slug", "description", "total",
    )


def variant_index(collections: DataFrame) -> DataFrame:
    """(variant_slug, slug) of every spelling of a collection; the last claim wins.

    ``collections`` is (pos, slug, variants) with variants separated by bars.
    """
    own = collections.select("pos", F.lit(-1).alias("at"), F.col("slug").alias("variant_slug"), "slug")
    spelt = collections.select("pos", "slug", F.posexplode(F.split("variants", r"\|")).alias("at", "name")).where(
        F.trim("name") != ""
    )
    claims = own.unionByName(spelt.select("pos", "at", slugify(F.trim("name")).alias("variant_slug"), "slug"))
    return claims.where("slug <> ''").groupBy("variant_slug").agg(F.max_by("slug", F.struct("pos", "at")).alias("slug"))


def resolve_collection(items: DataFrame, index: DataFrame, raw: str = "raw_slug") -> DataFrame:
    """Adds ``collection``: null where no collection claims the raw slug."""
    known = index.select(F.col("variant_slug").alias("_raw"), F.col("slug").alias("collection"))
    return items.withColumn("_raw", F.trim(raw)).join(known, "_raw", "left").drop("_raw")


def retired(committed: DataFrame, proposed: DataFrame) -> DataFrame:
    """Published slugs a new proposal would drop."""
    return committed.select("slug").join(proposed.select("slug"), "slug", "left_anti")
