"""Registered queries: similarity, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambry import tables
from ambry.functions import names as N
from ambry.operators import similar
from ambry.plans import sqltext as q
from ambry.plans.registry import query

# part names with a type word, a number and a rare misspelling, as free text would have
RAW = """p_name || ' ' || CASE p_type WHEN 'PROMO' THEN 'Série' WHEN 'LARGE' THEN 'serie' ELSE 'Seriee' END || ' ' ||
  CASE p_size % 5 WHEN 0 THEN 'I' WHEN 1 THEN '1' WHEN 2 THEN 'II' WHEN 3 THEN '02' ELSE 'IV' END"""
ROMANS = "MAP {'i': '1', 'ii': '2', 'iii': '3', 'iv': '4', 'v': '5', 'vi': '6', 'vii': '7', 'viii': '8', 'ix': '9', 'x': '10'}"


def _signature(expr: str) -> str:
    """Numbers of a name in SQL; leading zeros dropped."""
    mapped = (
        f"list_transform({q.tokens(expr)}, lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') "
        f"THEN CAST(CAST(t AS BIGINT) AS VARCHAR) ELSE {ROMANS}[t] END)"
    )
    return f"array_to_string(list_filter({mapped}, lambda n: n IS NOT NULL), ',')"


KEYS = f"""
raw AS (SELECT {RAW} AS name FROM part),
keys AS (SELECT name, count(*) AS count, array_to_string({q.tokens('name')}, ' ') AS j,
           array_to_string(list_sort(list_distinct({q.tokens('name')})), ' ') AS o, {_signature('name')} AS sig
         FROM raw GROUP BY name)"""
RATIO = "CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1 - levenshtein({a}, {b})::double / greatest(length({a}), length({b})) END"
SIM = f"greatest({RATIO.format(a='x.j', b='y.j')}, {RATIO.format(a='x.o', b='y.o')})"
PAIRS = f"""
pairs AS (SELECT x.name AS a, y.name AS b, round({SIM}, 9) AS similarity
          FROM keys x JOIN keys y ON x.sig = y.sig AND x.name < y.name WHERE {SIM} >= 0.88 - 1e-9)"""


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, size = F.col("p_type"), F.col("p_size") % 5
    word = F.when(kind == "PROMO", "Série").when(kind == "LARGE", "serie").otherwise("Seriee")
    number = F.when(size == 0, "I").when(size == 1, "1").when(size == 2, "II").when(size == 3, "02").otherwise("IV")
    part = tables.load(spark, sf_dir, "part")
    return part.select(F.concat_ws(" ", "p_name", word, number).alias("name"), F.lit(1).cast("long").alias("count"))


@query("f25_levenshtein", """
SELECT DISTINCT p_name AS name, p_type AS other, CAST(levenshtein(lower(p_name), lower(p_type)) AS INTEGER) AS distance,
  round(1 - levenshtein(lower(p_name), lower(p_type))::double / greatest(length(p_name), length(p_type)), 9) AS ratio FROM part""")
def f25_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.lower("p_name"), F.lower("p_type")
    return tables.load(spark, sf_dir, "part").select(
        F.col("p_name").alias("name"), F.col("p_type").alias("other"),
        F.levenshtein(a, b).alias("distance"), F.round(N.edit_ratio(a, b), 9).alias("ratio"),
    ).distinct()


@query("f26_similarity", f"""WITH {KEYS}
SELECT x.name, round({SIM.replace('y.j', 'y2.j').replace('y.o', 'y2.o')}, 9) AS similarity FROM keys x,
  LATERAL (SELECT array_to_string(list_reverse({q.tokens('x.name')}), ' ') AS j, x.o AS o) y2""")
def f26_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name beside its own words in reverse: equal once both are sorted."""
    col = F.col("name")
    turned = F.array_join(F.reverse(N.tokens(col)), " ")
    close = F.greatest(
        N.edit_ratio(N.joined_tokens(col), turned), N.edit_ratio(N.sorted_tokens(col), N.sorted_tokens(turned))
    )
    return raw_names(spark, sf_dir).select("name").distinct().select("name", F.round(close, 9).alias("similarity"))


@query("f27_digit_signature", f"WITH {KEYS} SELECT name, sig AS signature FROM keys")
def f27_digit_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_names(spark, sf_dir).select("name").distinct().select("name", N.digit_signature(F.col("name")).alias("signature"))


@query("j12_fuzzy_pairs", f"WITH {KEYS}, {PAIRS} SELECT * FROM pairs")
def j12_fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_pairs(raw_names(spark, sf_dir))


@query("c1_clusters", f"""WITH RECURSIVE {KEYS}, {PAIRS},
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
walk AS (SELECT name AS a, name AS b FROM keys UNION SELECT w.a, e.b FROM walk w JOIN edges e ON e.a = w.b),
root AS (SELECT a AS name, min(b) AS root FROM walk GROUP BY a),
m AS (SELECT k.name, k.count, r.root FROM keys k JOIN root r USING (name))
SELECT name, CAST(count AS BIGINT) AS count, first_value(name) OVER (PARTITION BY root ORDER BY count DESC, name) AS head,
  CAST(sum(count) OVER (PARTITION BY root) AS BIGINT) AS cluster_count FROM m""")
def c1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.cluster_names(raw_names(spark, sf_dir))
