"""Matching by containment, by nearest name, and by feed membership."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambry.operators.quality import liveness_check, require_live_feed
from ambry.session import cut

ANCHOR = 16
# A word start inside a text and the ANCHOR characters from there on.
_ANCHOR_PATTERN = rf"(?s)(?<=\s)(?=(\S.{{{ANCHOR - 1}}}))"
CUTOFF = 70.0


def _anchors(col: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(col, F.lit(_ANCHOR_PATTERN), F.lit(1)))


def first_containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle_id, pos): the first text, by ``pos``, that contains each needle.

    ``needles`` is (needle_id, needle), ``texts`` is (pos, text); case is
    ignored and needles found nowhere are absent. A containment test is not an
    equality, so both sides are keyed by anchors: where a needle occurs, a
    word start inside it is a word start of the text followed by the same
    characters. Each needle uses its rarest anchor, which keeps boilerplate
    from pairing everything with everything; pairs are then verified in full.
    Needles without such an anchor are keyed by their first characters.
    """
    wanted = needles.select(F.lower("needle").alias("needle")).where("needle <> ''").distinct()
    lowered = texts.select("pos", F.lower("text").alias("text"))
    keyed = cut(wanted.select("needle", _anchors(F.col("needle")).alias("anchors")))

    with_anchor = keyed.where(F.size("anchors") > 0).select("needle", F.explode("anchors").alias("anchor"))
    in_text = lowered.select("pos", F.explode(_anchors(F.col("text"))).alias("anchor"))
    pairs = _rarest_pairs(with_anchor, in_text)

    bare = keyed.where(F.size("anchors") == 0).select(
        "needle", F.left("needle", F.lit(ANCHOR)).alias("anchor")
    )
    # at most ANCHOR different sizes
    sizes = sorted(r[0] for r in bare.select(F.length("anchor")).distinct().collect())
    if sizes:
        # every stretch of such a size, read off in one pass each: the pattern looks ahead and moves by one
        stretches = F.array(*[F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)) for size in sizes])
        spots = lowered.select("pos", F.explode(F.array_distinct(F.flatten(stretches))).alias("anchor"))
        pairs = pairs.unionByName(_rarest_pairs(bare, spots))

    verified = pairs.join(lowered, "pos").where(F.col("text").contains(F.col("needle")))
    first = verified.groupBy("needle").agg(F.min("pos").alias("pos"))
    ids = needles.select("needle_id", F.lower("needle").alias("needle"))
    return ids.join(first, "needle").select("needle_id", "pos")


def _rarest_pairs(needle_anchors: DataFrame, text_anchors: DataFrame) -> DataFrame:
    """(needle, pos) sharing the needle's least frequent anchor."""
    relevant = cut(text_anchors.join(needle_anchors.select("anchor").distinct(), "anchor", "left_semi"))
    frequency = relevant.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    chosen = needle_anchors.join(frequency, "anchor").groupBy("needle").agg(
        F.min_by("anchor", F.struct("n", "anchor")).alias("anchor")
    )
    return relevant.join(chosen, "anchor").select("needle", "pos")


def indel_ratio(a: str, b: str) -> float:
    """0..100: twice the longest common subsequence over the total length."""
    total = len(a) + len(b)
    if total == 0:
        return 100.0
    rows: dict[str, int] = {}
    for i, ch in enumerate(a):
        rows[ch] = rows.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        matched = state & rows.get(ch, 0)
        state = ((state + matched) | (state - matched)) & full
    common = len(a) - state.bit_count()
    return 200.0 * common / total


#: letters from rare to common; any order keeps the join exact, this one keeps its keys small
RARE_TO_COMMON = "wkyxjzhqfgbvpcmtldunrsioea "


def _letters(col: Column) -> Column:
    """The characters of a string, each with how often it came before, rarest first: a set that stands for the multiset."""
    chars = F.filter(F.split(col, ""), lambda c: c != "")

    def numbered(c: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(chars, 1, i), lambda o: o == c))
        return F.struct((-before).alias("before"), F.instr(F.lit(RARE_TO_COMMON), c).alias("rarity"), c.alias("c"))

    return F.array_sort(F.transform(chars, numbered))


def _share(n: Column, m: Column, cutoff: float) -> Column:
    """How many characters strings of these lengths must have in common for a ratio of ``cutoff``."""
    return F.ceil((n + m) * F.lit(cutoff) / 200 - 1e-9)


def _keyed(strings: DataFrame, text: str, cutoff: float, own: str, other: str) -> DataFrame:
    """A row for each length that a partner may have and each letter of which one must be shared with it.

    Two sets that share ``t`` members share one among the first ``n - t + 1``
    of either in any common order.
    """
    n = F.length(text)
    held = strings.where(n > 0).select(text, n.alias(own), _letters(F.col(text)).alias("_l"))
    least = F.greatest(F.lit(1), F.ceil(F.col(own) * F.lit(cutoff) / (200 - F.lit(cutoff)) - 1e-9))
    most = F.floor(F.col(own) * (200 - F.lit(cutoff)) / F.lit(cutoff) + 1e-9)
    wide = held.withColumn(other, F.explode(F.sequence(least.cast("int"), most.cast("int"))))
    prefix = F.slice("_l", F.lit(1), F.greatest(F.lit(0), F.col(own) - _share(F.col(own), F.col(other), cutoff) + 1).cast("int"))
    return wide.select(text, own, other, F.explode(prefix).alias("letter"))


def nearest_names(names: DataFrame, dictionary: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(name, match, score): the closest dictionary entry of each distinct name.

    ``dictionary`` is (entry_pos, entry); the earliest entry wins a tie and
    names below the cutoff are absent. A similarity join: what two strings have
    in common as a subsequence they share as a multiset of letters, so pairs meet
    by equality of both lengths and of one of their rare letters. Pairs that
    share enough letters are measured where they lie. Only an empty name is like an empty entry.
    """
    entries = dictionary.where("entry IS NOT NULL").groupBy("entry").agg(F.min("entry_pos").alias("entry_pos"))
    distinct = names.where("name IS NOT NULL").select("name").distinct()
    met = (
        _keyed(distinct, "name", cutoff, "n", "m")
        .join(_keyed(entries, "entry", cutoff, "m", "n"), ["n", "m", "letter"])
        .select("name", "entry").distinct()
    )
    common = F.size(F.array_intersect(_letters(F.col("name")), _letters(F.col("entry"))))
    enough = met.where(common >= _share(F.length("name"), F.length("entry"), cutoff))

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    scored = enough.withColumn("score", ratio("name", "entry")).where(F.col("score") >= cutoff)
    void = distinct.where("name = ''").join(entries.where("entry = ''").select(F.col("entry").alias("name")), "name", "left_semi").select(
        "name", F.lit("").alias("entry"), F.lit(100.0).alias("score")
    )
    return scored.unionByName(void).join(entries, "entry").groupBy("name").agg(
        F.min_by("entry", F.struct(-F.col("score"), "entry_pos")).alias("match"), F.max("score").alias("score")
    )


# What is dropped from a name before it is looked up, in this order.
DROPPED = [
    "seminarista", "presb.", "pr.", "rev.", "pb.", "presb",
    "rev", "semi.", "pres.", "preb.", "pastor", "reverendo",
]


def person_candidates(description: Column, credited: Column) -> Column:
    """Where a person may be named, best first.

    A description ends in its author after a last " por ", alone or several in
    one line; the whole of that is offered before each name in it, and the
    credited name comes last.
    """
    said = F.nullif(F.regexp_extract(F.trim(description), r"(?s)^.* por (\V*)", 1), F.lit(""))
    single = F.transform(F.split(said, ",| e "), lambda n: F.nullif(F.trim(n), F.lit("")))
    several = F.coalesce(single, F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(F.concat(F.array(said), several, F.array(F.nullif(credited, F.lit(""))))))


def without_honorifics(col: Column) -> Column:
    out = F.lower(col)
    for word in DROPPED:
        out = F.replace(out, F.lit(word), F.lit(""))
    return out


def resolve_people(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, person): the first candidate of a record that matches the dictionary.

    ``records`` is (id, description, credited), ``dictionary`` is (entry_pos,
    entry, full_name) with lower-case entries.
    """
    offered = records.select(
        "id", F.posexplode(person_candidates(F.col("description"), F.col("credited"))).alias("at", "raw")
    ).select("id", "at", without_honorifics(F.col("raw")).alias("name"))
    nearest = nearest_names(offered, dictionary).select("name", F.col("match").alias("entry"))
    full = dictionary.groupBy("entry").agg(F.min_by("full_name", "entry_pos").alias("full_name"))
    hits = offered.join(nearest, "name").join(full, "entry")
    found = hits.groupBy("id").agg(F.min_by("full_name", "at").alias("person"))
    return records.select("id").join(found, "id", "left")


def feed_slugs(feeds: DataFrame, pattern: str) -> DataFrame:
    """(slug, feed, nth): distinct links of the feeds and where each was first seen.

    ``feeds`` is (feed, body); ``pattern`` has the slug as its first group.
    """
    links = feeds.select("feed", F.posexplode(F.regexp_extract_all("body", F.lit(pattern), F.lit(1))).alias("nth", "slug"))
    first = links.where("slug <> ''").groupBy("slug").agg(F.min(F.struct("feed", "nth")).alias("p"))
    return first.select("slug", "p.feed", "p.nth")


def refresh_liveness(records: DataFrame, feeds: DataFrame, previous: DataFrame, pattern: str) -> DataFrame:
    """``liveness`` behind its guards: a short feed or a sudden jump of dead links raises."""
    slugs = cut(feed_slugs(feeds, pattern))
    require_live_feed(slugs)
    fresh = cut(liveness(records, slugs))
    row = liveness_check(previous, fresh).first()
    if row.refused:
        raise ValueError(f"dead links would jump from {row.before:.1%} to {row.after:.1%}; refused")
    return fresh


def liveness(records: DataFrame, slugs: DataFrame) -> DataFrame:
    """(id, episode, alive) for records that have an episode: is a link of theirs in the feed?

    A record comes with a row for each of its links.
    """
    live = slugs.select("slug").distinct().withColumn("_live", F.lit(True))
    return (
        records.where(F.trim(F.coalesce("episode", F.lit(""))) != "")
        .join(live, "slug", "left")
        .groupBy("id", F.trim("episode").alias("episode")).agg(F.bool_or(F.coalesce("_live", F.lit(False))).alias("alive"))
    )
