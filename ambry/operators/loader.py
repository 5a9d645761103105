"""Which raw records become documents, and why the others do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambry.functions import values as V

MIN_SCORE = 50
MIN_WORDS_PER_MINUTE = 70
UNKNOWN_PERSON = "Desconhecido"

# Raw records are text throughout, as a CSV reader delivers them.
RAW_FIELDS = (
    "name processed txt artist duration_str id duration timestamp sc_suffix_url sp_suffix_url "
    "date words sentences words_min sentences_min score"
).split()


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def skip_reason() -> Column:
    """The first rule a record fails, null when it passes all of them."""
    rate = V.words_per_minute(F.col("words_min"), F.col("words"), F.col("duration"))
    return (
        F.when(~V.is_true(F.col("processed")), "not processed")
        .when(V.number_or_zero(F.col("score")) <= MIN_SCORE, "low score")
        # an unknown rate is let through
        .when(rate <= MIN_WORDS_PER_MINUTE, "too few words per minute")
        .when(_text("txt") == "", "no transcript file")
        .when(V.resolve_date(F.col("date"), F.col("timestamp")).isNull(), "unresolvable date")
    )


def judged(raw: DataFrame) -> DataFrame:
    """Raw records in loaded form, with ``reason`` for those to be skipped."""
    rate = V.words_per_minute(F.col("words_min"), F.col("words"), F.col("duration"))
    name = _text("name")
    return raw.select(
        "pos",
        F.coalesce(V.blank_to_null(F.col("id")), name).alias("doc_id"),
        name.alias("title"),
        F.coalesce(V.blank_to_null(F.col("artist")), F.lit(UNKNOWN_PERSON)).alias("person"),
        V.resolve_date(F.col("date"), F.col("timestamp")).alias("date"),
        _text("duration_str").alias("duration_str"),
        V.half_up(V.number_or_zero(F.col("duration"))).alias("duration_sec"),
        V.blank_to_null(F.col("sc_suffix_url")).alias("audio_suffix"),
        V.blank_to_null(F.col("sp_suffix_url")).alias("episode_suffix"),
        V.number_or_zero(F.col("score")).alias("score"),
        V.half_up(V.number_or_zero(F.col("words"))).alias("words"),
        V.half_up(V.number_or_zero(F.col("sentences"))).alias("sentences"),
        F.coalesce(rate, F.lit(0.0)).alias("words_min"),
        V.number_or_zero(F.col("sentences_min")).alias("sentences_min"),
        _text("txt").alias("transcript_file"),
        skip_reason().alias("reason"),
    )


def keep_best(rows: DataFrame, key: str, score: str, pos: str = "pos") -> DataFrame:
    """One row per key: the best score, the earliest on a tie.

    ``place`` is where the key was first seen, which is where the winner goes.
    An aggregate, not a window: a key with very many copies is reduced map-side.
    """
    others = [c for c in rows.columns if c != key]
    return (
        rows.groupBy(key)
        .agg(
            F.min_by(F.struct(*others), F.struct(-F.col(score), F.col(pos))).alias("_best"),
            F.min(pos).alias("place"),
        )
        .select(key, "_best.*", "place")
    )


def load_documents(raw: DataFrame) -> DataFrame:
    passed = judged(raw).where("reason IS NULL").drop("reason")
    return keep_best(passed, "transcript_file", "score")


def skipped(raw: DataFrame) -> DataFrame:
    """(pos, title, reason) of every record that is not loaded, duplicates included."""
    rows = judged(raw)
    failed = rows.where("reason IS NOT NULL").select("pos", "title", "reason")
    passed = rows.where("reason IS NULL")
    winners = load_documents(raw).select("pos")
    losers = passed.join(winners, "pos", "left_anti").select(
        "pos", "title", F.concat(F.lit("duplicate of "), "transcript_file").alias("reason")
    )
    return failed.unionByName(losers)
