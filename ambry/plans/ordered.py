"""Registered queries: shards, samples, limiter, quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambry import tables
from ambry.operators import limits, ordering, quality
from ambry.plans.registry import query

HOUR = 3_600_000_000
LIMIT, WIDTH = 3, 12 * HOUR


@query("w8_shards", """
SELECT c_custkey AS custkey, CAST(ntile(7) OVER (ORDER BY c_custkey) AS INTEGER) AS shard FROM customer""")
def w8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    return ordering.shard(rows, 7, "custkey").select("custkey", "shard")


@query("w9_spread", """
WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS total FROM documents),
picks AS (SELECT DISTINCT CAST(floor(i * total / 40.0) AS BIGINT) AS p FROM range(40) t(i), (SELECT count(*) AS total FROM documents))
SELECT doc_id, p AS position FROM n WHERE p IN (SELECT p FROM picks)""")
def w9_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.load(spark, sf_dir, "documents").select("doc_id")
    return ordering.spread(rows, 40, "doc_id").select("doc_id", "position")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return tables.load(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), at.alias("t"), F.col("event_id").alias("event")
    )


@query("t1_rate_limiter", f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s AS (
  SELECT user_id, event_id, rn, t + {WIDTH} AS resets, 1 AS used, true AS accepted FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.t >= s.resets THEN e.t + {WIDTH} ELSE s.resets END,
         CASE WHEN e.t >= s.resets THEN 1 WHEN s.used < {LIMIT} THEN s.used + 1 ELSE s.used END,
         e.t >= s.resets OR s.used < {LIMIT}
  FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
SELECT user_id, event_id, accepted FROM s""")
def t1_rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.rate_limit(hits(spark, sf_dir), LIMIT, WIDTH).select(
        F.col("key").alias("user_id"), F.col("event").alias("event_id"), "accepted"
    )


@query("a12_content_seconds", """
WITH d AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
m AS (SELECT user_id, count(*) AS stamps, median(t - p) AS med FROM d GROUP BY user_id)
SELECT user_id, stamps, CASE WHEN med > 0 THEN round(stamps * med / 1000000, 3) END AS seconds FROM m""")
def a12_content_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.content_seconds(hits(spark, sf_dir), "key", "t", "event")
    return found.select(F.col("key").alias("user_id"), "stamps", F.round(F.col("seconds") / 1e6, 3).alias("seconds"))


@query("a10_weighted_score", r"""
WITH w AS (SELECT conv_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS word FROM conversations),
s AS (SELECT conv_id, length(regexp_replace(word, '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g')) AS weight,
             (length(word) % 10) / 10.0::double AS score FROM w),
g AS (SELECT conv_id, sum(round(score * weight, 6)) AS s, sum(weight) AS n FROM s GROUP BY conv_id)
SELECT conv_id, round(CASE WHEN n > 0 THEN 100 * round(s, 6) / n ELSE 0 END, 1) AS score FROM g""")
def a10_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ambry.functions.text import words

    score = lambda w: (F.length(w) % 10) / F.lit(10.0)
    segments = tables.load(spark, sf_dir, "conversations").select(
        "conv_id", F.transform(words(F.col("text")), lambda w: F.struct(w.alias("word"), score(w).alias("score"))).alias("words")
    )
    return quality.weighted_score(segments, "conv_id")


@query("a11_coverage", """
WITH s AS (SELECT conv_id, max(turn) AS last_turn, sum(length(text)) AS chars, max_by(length(text), turn) AS tail FROM conversations GROUP BY conv_id)
SELECT conv_id, round((chars - tail) / chars, 6) AS coverage, (chars - tail) / chars >= 0.9 AS complete FROM s""")
def a11_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.length("text").cast("double")
    spoken = tables.load(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sum(length).alias("chars"), F.max_by(length, "turn").alias("tail")
    )
    share = quality.coverage(F.col("chars") - F.col("tail"), F.col("chars"))
    return spoken.select("conv_id", F.round(share, 6).alias("coverage"), (share >= quality.MIN_COVERAGE).alias("complete"))


@query("a15_usage_totals", """
WITH u AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, value FROM events),
s AS (SELECT count(*) AS calls, CAST(sum(k * 10) AS BIGINT) AS prompt_tokens, CAST(sum(k) AS BIGINT) AS completion_tokens,
      CAST(sum(CASE WHEN event_type = 'view' THEN k ELSE 0 END) AS BIGINT) AS cached_tokens,
      round(sum(CASE WHEN event_type <> 'click' THEN value ELSE 0 END), 6) AS cost FROM u WHERE event_type <> 'error')
SELECT *, CAST(floor(100.0 * cached_tokens / prompt_tokens + 0.5) AS INTEGER) AS cached_percent FROM s""")
def a15_usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    details = F.struct(F.when(kind == "view", k).alias("cached_tokens"))
    usage = F.struct(
        (k * 10).alias("prompt_tokens"), k.alias("completion_tokens"),
        F.when(kind != "click", F.col("value")).alias("cost"), details.alias("prompt_tokens_details"),
    )
    payload = F.when(kind == "error", F.lit('{"error": 1}')).otherwise(F.to_json(F.struct(usage.alias("usage"))))
    return quality.usage_totals(tables.load(spark, sf_dir, "events").select(payload.alias("payload")))
