"""Topic labels: cleaning them, comparing labellers, reporting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ambry.functions.text import slugify
from ambry.functions.values import clamp01
from ambry.operators.ordering import with_position
from ambry.session import cut

MAX_LABELS = 4


def label_rows(labels: DataFrame, known: DataFrame, most: int = MAX_LABELS) -> DataFrame:
    """(doc_id, topic, confidence): known topics only, first mention, at most ``most``.

    ``labels`` is (doc_id, pos, topic, confidence). Mentions are merged before
    they are ranked, so a document has at most one row per known topic there.
    """
    first = (
        labels.join(known.select("topic").distinct(), "topic", "left_semi")
        .groupBy("doc_id", "topic")
        .agg(F.min(F.struct("pos", "confidence")).alias("m"))
        .select("doc_id", "topic", "m.pos", "m.confidence")
    )
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "topic"))
    return first.withColumn("_n", nth).where(F.col("_n") <= most).select(
        "doc_id", "topic", clamp01(F.col("confidence")).alias("confidence")
    )


def taxonomy_rows(proposal: DataFrame) -> DataFrame:
    """(pos, group_slug, group_name, topic_slug, topic_name): distinct pairs, unique slugs.

    ``proposal`` is (pos, group, topic). In the order of the proposal each topic
    gets its slug, or the first of slug-2, slug-3, ... that nobody before it has.
    """
    pairs = (
        proposal.select("pos", F.trim("group").alias("group"), F.trim("topic").alias("topic"))
        .where("group <> '' AND topic <> ''")
        .groupBy("group", "topic").agg(F.min("pos").alias("pos"))
        .withColumn("base", slugify(F.col("topic")))
    )
    return unique_slugs(pairs, "base", "pos").select(
        "pos", slugify(F.col("group")).alias("group_slug"), F.col("group").alias("group_name"),
        F.col("slug").alias("topic_slug"), F.col("topic").alias("topic_name"),
    )


def unique_slugs(rows: DataFrame, base: str, order: str) -> DataFrame:
    """Adds ``slug``: the base, or the first of base-2, base-3, ... that no earlier row has.

    Every row starts with its number among those of its base, which is the
    least it can get. Where rows of different bases meet in a slug the earliest
    keeps it, and the others move on, with all later ones of their base. Rounds
    go on while any meet; only those are looked at, and a row never moves back.
    """
    placed = with_position(rows, base, order)
    firsts = placed.groupBy(base).agg(F.min("position").alias("_first"))
    held = cut(
        placed.join(firsts, base).withColumn("_i", F.col("position") - F.col("_first") + 1)
        .withColumn("_k", F.col("_i")).select(*rows.columns, "_i", "_k")
    )
    slug = F.when(F.col("_k") == 1, F.col(base)).otherwise(F.concat_ws("-", base, F.col("_k").cast("string")))
    while True:
        named = held.withColumn("slug", slug)
        met = named.groupBy("slug").agg(F.min(order).alias("_keeps"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        late = cut(
            named.join(met, "slug").where(F.col(order) > F.col("_keeps"))
            .select(F.col(base).alias("_b"), F.col("_i").alias("_from"), (F.col("_k") + 1 - F.col("_i")).alias("_lag"))
        )
        if late.isEmpty():
            return named.drop("_i", "_k")
        moved = held.join(late, (F.col(base) == F.col("_b")) & (F.col("_i") >= F.col("_from")), "left")
        lag = F.max(F.coalesce("_lag", F.lit(0)))
        held = cut(
            moved.groupBy(*rows.columns, "_i", "_k").agg(lag.alias("_m"))
            .withColumn("_k", F.greatest("_k", F.col("_i") + F.col("_m"))).select(*rows.columns, "_i", "_k")
        )


def set_overlap(labels: DataFrame, baseline: str, config: str) -> DataFrame:
    """(doc_id, shared, either, jaccard, same) between two labellers' topic sets.

    ``labels`` is (doc_id, config, topic). Two steps of plain sums: per (doc,
    topic) who used it, then per document; no set is ever collected.
    """
    used = labels.where(F.col("config").isin(baseline, config)).groupBy("doc_id", "topic").agg(
        F.bool_or(F.col("config") == baseline).alias("a"), F.bool_or(F.col("config") == config).alias("b")
    )
    sums = used.groupBy("doc_id").agg(
        F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count(F.lit(1)).alias("either")
    )
    return sums.select(
        "doc_id", "shared", "either", F.round(F.col("shared") / F.col("either"), 9).alias("jaccard"),
        (F.col("shared") == F.col("either")).alias("same"),
    )


def agreement(docs: DataFrame, labels: DataFrame, baseline: str, configs: list[str]) -> DataFrame:
    """(config, exact, jaccard, total) of each labeller against the baseline.

    A document neither labelled counts as full agreement.
    """
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = None
    for config in [c for c in configs if c != baseline]:
        row = set_overlap(labels, baseline, config).agg(
            F.count(F.lit(1)).alias("seen"), F.count_if("same").alias("same"),
            F.coalesce(F.sum("jaccard"), F.lit(0.0)).alias("sum"),
        ).withColumn("total", total)
        silent = F.col("total") - F.col("seen")
        mean = F.when(F.col("total") > 0, (F.col("sum") + silent) / F.col("total")).otherwise(0.0)
        part = row.select(
            F.lit(config).alias("config"), (F.col("same") + silent).alias("exact"),
            F.round(mean, 6).alias("jaccard"), "total",
        )
        out = part if out is None else out.unionByName(part)
    return out


def divergent(labels: DataFrame, configs: list[str]) -> DataFrame:
    """Documents on which some labeller differs from the first one."""
    used = labels.where(F.col("config").isin(configs)).groupBy("doc_id", "topic").agg(
        *[F.bool_or(F.col("config") == c).alias(f"c{i}") for i, c in enumerate(configs)]
    )
    differs = F.lit(False)
    for i in range(1, len(configs)):
        differs = differs | (F.col("c0") != F.col(f"c{i}"))
    return used.where(differs).select("doc_id").distinct()


def label_report(docs: DataFrame, labels: DataFrame, known: DataFrame) -> DataFrame:
    """(topic, total, share): labels per known topic, unused ones with 0."""
    counts = labels.groupBy("topic").agg(F.count(F.lit(1)).alias("total"))
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return known.select("topic").distinct().join(counts, "topic", "left").select(
        "topic", F.coalesce("total", F.lit(0).cast("long")).alias("total")
    ).withColumn("share", F.round(F.col("total") / n, 9))


def name_examples(rows: DataFrame, name: str, example: str, order: str, most: int = 3) -> DataFrame:
    """(name, total, example, nth): how often each name occurs, and its first examples.

    The ranking window is cut to ``most`` rows before the shuffle, so a name
    that everything carries ships three rows per task.
    """
    totals = rows.groupBy(name).agg(F.count(F.lit(1)).alias("total"))
    nth = F.row_number().over(Window.partitionBy(name).orderBy(order))
    first = rows.select(name, example, order).withColumn("nth", nth).where(F.col("nth") <= most)
    return first.join(totals, name).select(name, "total", F.col(example).alias("example"), "nth")
