"""Registered queries: titles, references, range expansion, stems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambry import tables
from ambry.functions.references import Catalogue, decision_rows, expand_chapters, find_work, parse_reference
from ambry.functions import stem as S
from ambry.functions.titles import parse_title
from ambry.operators import index, postings
from ambry.operators.retrieval import LexicalQuery
from ambry.plans import sqltext as q
from ambry.plans.registry import maybe_int, query
from ambry.session import scratch_path

CHAPTERS = 50

# Titles in five styles, written from the order, the part and the line.
TITLED = """
t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_linenumber % 5 AS k, p_name, replace(p_name, ' ', '-') AS work,
        CAST(l_quantity AS INTEGER) AS qty, strftime(o_orderdate, '%d-%m-%Y') AS day
      FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)"""


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("int").alias("qty"))
    parts = tables.load(spark, sf_dir, "part").select("p_partkey", "p_name")
    orders = tables.load(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd-MM-yyyy").alias("day"))
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.col("l_linenumber") % 5
    # never null, so that no row is asked for it; plain concatenation, as formats are parsed for every row
    amount, n, day, line = (F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("qty", "p_name", "day", "l_linenumber"))
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    title = (
        F.when(k == 0, join(day, " - EBD - ", n, " course - Aula ", amount))
        .when(k == 1, join(day, " - ", n, " ", amount, ".5-7"))
        .when(k == 2, join("IV Congresso Alfa - ", F.replace(day, F.lit("-"), F.lit("/")), " - ", n, " ", amount, " (pt 2)"))
        .when(k == 3, join(day, " - CFW 0", line, " - tema"))
        .otherwise(join(day, " - EBD - ", F.upper(n), " ", amount, ", 12 e 14"))
    )
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", title.alias("title"))


def catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    """The part names as works, one per name."""
    names = tables.load(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").cast("int").alias("position"))
    none = F.array().cast("array<string>")
    return Catalogue(names.select(
        "position", F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), F.col("p_name").alias("name"),
        F.lit(CHAPTERS).alias("chapters"), none.alias("abbrevs"), none.alias("aliases"),
    ))


KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("f5_find_reference", f"WITH {TITLED} SELECT {KEY}, CASE WHEN k <> 3 THEN work END AS work FROM t")
def f5_find_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_work(titled(spark, sf_dir), "title", catalogue(spark, sf_dir))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("ref_work").alias("work"))


@query("f7_parse_reference", f"""WITH {TITLED}
SELECT {KEY}, CASE WHEN k <> 3 THEN work END AS work, CAST(CASE WHEN k IN (1, 2, 4) AND qty <= {CHAPTERS} THEN qty END AS DOUBLE) AS chapter,
  CAST(CASE WHEN qty <= {CHAPTERS} THEN CASE k WHEN 1 THEN 5 WHEN 4 THEN 12 END END AS DOUBLE) AS verse_start,
  CAST(CASE WHEN qty <= {CHAPTERS} THEN CASE k WHEN 1 THEN 7 WHEN 4 THEN 14 END END AS DOUBLE) AS verse_end FROM t""")
def f7_parse_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = parse_reference(titled(spark, sf_dir), "title", catalogue(spark, sf_dir))
    found = read.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("ref_work").alias("work"),
        F.col("ref_chapter_start").alias("chapter"), F.col("ref_verse_start").alias("verse_start"),
        F.col("ref_verse_end").alias("verse_end"),
    )
    return maybe_int(found, "chapter", "verse_start", "verse_end")


@query("f11_parse_title", f"""WITH {TITLED}
SELECT {KEY}, CASE k WHEN 0 THEN 'ebd' WHEN 4 THEN 'ebd' WHEN 2 THEN 'congresso' ELSE 'culto' END AS kind,
  CASE k WHEN 2 THEN 'IV Congresso Alfa' END AS event,
  CASE k WHEN 0 THEN p_name || ' course' WHEN 2 THEN 'IV Congresso Alfa' WHEN 3 THEN 'CFW ' || l_linenumber END AS collection_name,
  CAST(CASE k WHEN 0 THEN qty WHEN 2 THEN 2 END AS DOUBLE) AS part, CASE WHEN k <> 3 THEN work END AS work FROM t""")
def f11_parse_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = parse_title(titled(spark, sf_dir), catalogue(spark, sf_dir))
    return maybe_int(read.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "kind", "event", "collection_name", "part",
        F.col("ref_work").alias("work"),
    ), "part")


RANGES = """
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber <> 7 THEN l_linenumber END AS s,
        CASE WHEN l_linenumber <> 7 THEN l_linenumber + CAST(l_quantity AS INTEGER) % 4 END AS e,
        CAST(l_partkey % 30 AS INTEGER) AS v1, CAST(l_suppkey % 40 AS INTEGER) AS v2 FROM lineitem)"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return tables.load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(n != 7, n).alias("chapter_start"),
        F.when(n != 7, n + F.col("l_quantity").cast("int") % 4).alias("chapter_end"),
        (F.col("l_partkey") % 30).cast("int").alias("verse_start"), (F.col("l_suppkey") % 40).cast("int").alias("verse_end"),
    )


@query("f8_expand_ranges", f"""WITH {RANGES}, x AS (SELECT *, unnest(CASE WHEN s IS NULL THEN [0] ELSE range(s, e + 1) END) AS chapter FROM r)
SELECT {KEY}, CAST(chapter AS INTEGER) AS chapter, CAST(CASE WHEN chapter = s THEN v1 END AS DOUBLE) AS verse_start, CAST(CASE WHEN chapter = e THEN v2 END AS DOUBLE) AS verse_end FROM x""")
def f8_expand_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maybe_int(expand_chapters(ranges(spark, sf_dir)), "verse_start", "verse_end")


@query("f10_decision_rows", f"""WITH {RANGES}, w AS (SELECT DISTINCT p_brand AS name, 5 AS chapters FROM part WHERE p_brand <> 'Brand#9'),
d AS (SELECT r.*, p_brand AS name FROM r JOIN part ON p_partkey = l_partkey),
c AS (SELECT d.*, chapters, least(e, chapters) AS e2 FROM d JOIN w USING (name) WHERE s IS NULL OR s <= chapters),
x AS (SELECT *, unnest(CASE WHEN s IS NULL THEN [0] ELSE range(s, e2 + 1) END) AS chapter FROM c)
SELECT l_orderkey AS doc_id, lower(name) AS work, CAST(chapter AS INTEGER) AS chapter, CAST(CASE WHEN chapter = s THEN v1 END AS DOUBLE) AS verse_start,
  CAST(CASE WHEN chapter = e2 THEN v2 END AS DOUBLE) AS verse_end FROM x""")
def f10_decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tables.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("name"))
    decisions = ranges(spark, sf_dir).join(parts, "l_partkey").withColumnRenamed("l_orderkey", "doc_id")
    works = parts.where("name <> 'Brand#9'").select("name", F.lower("name").alias("slug"), F.lit(5).alias("chapters")).distinct()
    return maybe_int(decision_rows(decisions, works), "verse_start", "verse_end")


def _ends(expr: str, endings: list[str]) -> str:
    return f"regexp_extract({expr}, '(?:{'|'.join(sorted(endings, key=len, reverse=True))})$', 0)"


def _inside(word: str, ending: str, region: str) -> str:
    return f"({ending} <> '' AND length({word}) - length({ending}) >= {region})"


def _less(word: str, ending: str) -> str:
    return f"left({word}, length({word}) - length({ending}))"


def _also(endings: list[str]) -> str:
    more = _ends("c", endings)
    return f"CASE WHEN {_inside('c', more, 'r2')} THEN {_less('c', more)} ELSE c END"


SYLLABLES = "^[^aeiou]*[aeiou]+[^aeiou]"
STEMS = f"""
words AS (SELECT DISTINCT unnest({q.tokens('content')}) AS w FROM chunks),
a AS (SELECT w, length(w) AS n, length(regexp_extract(w, '{SYLLABLES}', 0)) AS h,
  CASE WHEN NOT regexp_matches(substr(w, 2, 1), '[aeiou]') THEN length(regexp_extract(w, '^..[^aeiou]*[aeiou]', 0))
       WHEN regexp_matches(left(w, 1), '[aeiou]') THEN length(regexp_extract(w, '^..[aeiou]*[^aeiou]', 0))
       WHEN length(w) >= 3 THEN 3 ELSE 0 END AS v FROM words),
b AS (SELECT w, n, CASE WHEN h > 0 THEN h ELSE n END AS r1, CASE WHEN v > 0 THEN v ELSE n END AS rv FROM a),
d AS (SELECT *, length(regexp_extract(substr(w, r1 + 1), '{SYLLABLES}', 0)) AS h2 FROM b),
f AS (SELECT *, CASE WHEN h2 > 0 THEN r1 + h2 ELSE n END AS r2,
  {_ends('w', [*S.STANDARD, *S.LOGIC, S.ADVERB_A, S.ADVERB, *S.STATE, *S.ACTIVE, *S.AGENT])} AS e FROM d),
g AS (SELECT *, {_less('w', 'e')} AS c, {_inside('w', 'e', 'r2')} AS in2 FROM f),
one AS (SELECT *, CASE
  WHEN e IN {q.in_list(S.STANDARD)} AND in2 THEN c
  WHEN e IN {q.in_list(S.LOGIC)} AND in2 THEN c || 'log'
  WHEN e = 'amente' AND {_inside('w', 'e', 'r1')} THEN
    CASE WHEN c LIKE '%ativ' AND length(c) - 4 >= r2 THEN left(c, length(c) - 4) ELSE {_also(['iv', 'os', 'ic', 'ad'])} END
  WHEN e = 'mente' AND in2 THEN {_also(['ante'])}
  WHEN e IN {q.in_list(S.STATE)} AND in2 THEN {_also(['abil', 'ic', 'iv'])}
  WHEN e IN {q.in_list(S.ACTIVE)} AND in2 THEN {_also(['at'])}
  WHEN e IN {q.in_list(S.AGENT)} AND {_inside('w', 'e', 'rv')} AND c LIKE '%e' THEN c || 'ir' END AS s1 FROM g),
two AS (SELECT *, {_ends('substr(w, rv + 1)', S.VERB)} AS verb FROM one),
three AS (SELECT *, coalesce(s1, CASE WHEN verb <> '' THEN {_less('w', 'verb')} END) AS ch, {_ends('w', ['os', 'a', 'i', 'o'])} AS rest FROM two),
four AS (SELECT *, CASE WHEN ch IS NOT NULL THEN CASE WHEN ch LIKE '%ci' AND length(ch) - 1 >= rv THEN left(ch, length(ch) - 1) ELSE ch END
  WHEN {_inside('w', 'rest', 'rv')} THEN {_less('w', 'rest')} ELSE w END AS s FROM three),
stems AS (SELECT w AS word, CASE WHEN s LIKE '%e' AND length(s) - 1 >= rv THEN
  CASE WHEN (s LIKE '%gue' OR s LIKE '%cie') AND length(s) - 2 >= rv THEN left(s, length(s) - 2) ELSE left(s, length(s) - 1) END ELSE s END AS stem FROM four)"""


@query("r1_stems", f"WITH {q.CHUNKS}, {STEMS} SELECT * FROM stems")
def r1_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus vocabulary with its stems."""
    found = index.chunk(tables.corpus(spark, sf_dir), with_tokens=True)
    words = found.select(F.explode("tokens").alias("word")).distinct()
    return S.stem(words)


STEM_TERMS = ("tion", "heron", "que", "ueez")


@query("r2_postings_search", f"""WITH {q.CHUNKS}, {STEMS},
spoken AS (SELECT doc_id, chunk_index, unnest({q.tokens('content')}) AS word FROM chunks),
n AS (SELECT doc_id, chunk_index, count(*) AS hits FROM spoken JOIN stems USING (word) WHERE stem IN {q.in_list(list(STEM_TERMS))} GROUP BY ALL)
SELECT doc_id, chunk_index, hits, CAST(row_number() OVER (ORDER BY hits DESC, doc_id, chunk_index) AS INTEGER) AS rank FROM n ORDER BY rank LIMIT 80""")
def r2_postings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by stem over the inverted index of all passages."""
    found = index.chunk(tables.corpus(spark, sf_dir), with_tokens=True)
    stored = postings.store_postings(postings.build_postings(found), scratch_path(spark, "postings"))
    return postings.postings_arm(stored, LexicalQuery(STEM_TERMS), 80)
