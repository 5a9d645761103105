"""Registered queries: the stored text index and the searches that read it.

The index of a folder is built once in a session and read by all queries here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambry import tables
from ambry.functions.analysis import PORTUGUESE, Analyser
from ambry.operators import index, lexical, retrieval, textindex
from ambry.operators.filters import Filters, SearchRequest
from ambry.plans import sqltext as q
from ambry.plans.linking import CONTAINED, contained
from ambry.plans.registry import query
from ambry.plans.search import DISTANCE, K, NEAR, near_vector
from ambry.plans.titles import STEMS
from ambry.session import scratch_path
from ambry.sources.versions import Versions

_STORES: dict[tuple[str, str], Versions] = {}


def store(spark: SparkSession, sf_dir: str, analyser: Analyser = PORTUGUESE) -> Versions:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        held = Versions(spark, scratch_path(spark, "text-index"))
        textindex.build(held, tables.corpus(spark, sf_dir), analyser)
        _STORES[key] = held
    return _STORES[key]


def held_index(spark: SparkSession, sf_dir: str) -> textindex.TextIndex:
    return textindex.open_index(store(spark, sf_dir))


def passage_vectors(spark: SparkSession, sf_dir: str, held: textindex.TextIndex) -> DataFrame:
    return held.passages.select("doc_id", "chunk_index").join(tables.vectors(spark, sf_dir), "doc_id")


STOP = q.in_list(list(PORTUGUESE.stop))
PLACED = f"""{q.CHUNKS}, {STEMS},
spoken AS (SELECT doc_id, chunk_index, unnest(range(len(t))) AS place, unnest(t) AS word, len(t) AS length
           FROM (SELECT doc_id, chunk_index, {q.tokens('content')} AS t FROM chunks)),
lex AS (SELECT doc_id, chunk_index, place, length, stem AS lexeme FROM spoken JOIN stems USING (word) WHERE word NOT IN {STOP})"""


@query("r2_positional_index", f"""WITH {PLACED}
SELECT lexeme, doc_id, chunk_index, CAST(any_value(length) AS INTEGER) AS length, CAST(count(*) AS INTEGER) AS n,
       md5(string_agg(place, ',' ORDER BY place)) AS places FROM lex GROUP BY lexeme, doc_id, chunk_index""")
def r2_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting of the stored index, its places decoded."""
    at = F.concat_ws(",", F.transform(textindex.places(F.col("steps")), lambda p: p.cast("string")))
    return held_index(spark, sf_dir).postings.select(
        "lexeme", "doc_id", "chunk_index", "length", F.size("steps").alias("n"), F.md5(at).alias("places")
    )


@query("r2_index_totals", f"""WITH {PLACED}
SELECT lexeme, count(*) AS passages, (SELECT count(*) FROM chunks) AS all_passages,
       round((SELECT avg(len({q.tokens('content')})) FROM chunks), 9) AS mean
FROM (SELECT DISTINCT lexeme, doc_id, chunk_index FROM lex) GROUP BY lexeme""")
def r2_index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of lexemes beside the totals of the index."""
    held = held_index(spark, sf_dir)
    total = held.totals.select(F.struct("passages", "mean")).scalar()
    return held.frequencies.withColumn("_t", total).select(
        "lexeme", "passages", F.col("_t.passages").alias("all_passages"), F.round("_t.mean", 9).alias("mean")
    )


@query("r17_index_refresh", f"""WITH {PLACED}
SELECT lexeme, count(*) AS postings, CAST(sum(n) AS BIGINT) AS words, CAST(sum(last * (doc_id + chunk_index + 1)) AS BIGINT) AS mark
FROM (SELECT lexeme, doc_id, chunk_index, count(*) AS n, max(place) AS last FROM lex GROUP BY lexeme, doc_id, chunk_index) GROUP BY lexeme""")
def r17_index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of an earlier corpus, refreshed by what changed: it must be that of the corpus as it is."""
    docs = tables.corpus(spark, sf_dir)
    labels = tables.load(spark, sf_dir, "labels").select("doc_id", "toxic")
    text = F.when(F.col("toxic") == 1, F.concat(F.lit("old "), "text")).otherwise(F.col("text"))
    gone = spark.createDataFrame([(-1, "gone", "a text that is gone")], "doc_id long, title string, text string")
    earlier = docs.join(labels, "doc_id").select("doc_id", "title", text.alias("text")).unionByName(gone)
    held = Versions(spark, scratch_path(spark, "text-index"))
    textindex.build(held, earlier, PORTUGUESE)
    textindex.refresh(held, docs, PORTUGUESE)
    last = F.aggregate("steps", F.lit(0), lambda a, x: a + x)  # the steps add up to the last place
    return textindex.open_index(held).postings.groupBy("lexeme").agg(
        F.count(F.lit(1)).alias("postings"), F.sum(F.size("steps")).alias("words"),
        F.sum(last * (F.col("doc_id") + F.col("chunk_index") + 1)).alias("mark"),
    )


ASKED = 'que tion "in the" or "les de la" Heron "èn eau" -"of the" -erly'
PHRASES = 'the "in the" -tion'
WORDS_ONLY = "tion heron thsh eaeau"


def asked_sql(wanted: list[list[tuple[int, str]]], banned: list[list[tuple[int, str]]]) -> str:
    """The matches and ranks of a query given as phrases of (offset, folded word)."""
    rows = [(k, off, w) for k, phrase in enumerate([*wanted, *banned]) for off, w in phrase]
    values = ", ".join(f"({k}, {off}, '{w}')" for k, off, w in rows)
    return f"""
asked AS (SELECT alt, off, coalesce(stem, '?' || word) AS lexeme FROM (VALUES {values}) AS v(alt, off, word) LEFT JOIN stems USING (word)),
sized AS (SELECT alt, count(*) AS n, max(off) AS span, alt >= {len(wanted)} AS banned FROM asked GROUP BY alt),
begins AS (SELECT doc_id, chunk_index, alt, place - off AS a FROM TERMS JOIN asked USING (lexeme) JOIN sized USING (alt)
           GROUP BY doc_id, chunk_index, alt, place - off, n HAVING count(DISTINCT off) = n),
covers AS (SELECT DISTINCT doc_id, chunk_index, a, a + span AS b FROM begins JOIN sized USING (alt) WHERE NOT banned),
minimal AS (SELECT * FROM covers c WHERE NOT EXISTS (SELECT 1 FROM covers o WHERE o.doc_id = c.doc_id AND o.chunk_index = c.chunk_index
              AND o.a >= c.a AND o.b <= c.b AND (o.a <> c.a OR o.b <> c.b))),
entries AS (SELECT DISTINCT doc_id, chunk_index, place FROM TERMS WHERE lexeme IN (SELECT lexeme FROM asked JOIN sized USING (alt) WHERE NOT banned)),
dense AS (SELECT m.doc_id, m.chunk_index, m.a, m.b, 0.1::double / (1 + (m.b - m.a) - (count(*) - 1)) AS share
          FROM minimal m JOIN entries e ON e.doc_id = m.doc_id AND e.chunk_index = m.chunk_index AND e.place BETWEEN m.a AND m.b GROUP BY m.doc_id, m.chunk_index, m.a, m.b),
matched AS (SELECT doc_id, chunk_index, round(sum(share), 9) AS lexical_rank FROM dense
            WHERE (doc_id, chunk_index) NOT IN (SELECT (doc_id, chunk_index) FROM begins JOIN sized USING (alt) WHERE banned) GROUP BY ALL)"""


ASKED_SQL = asked_sql(
    [[(0, "tion")], [(0, "in"), (1, "the")], [(0, "les"), (2, "la")], [(0, "heron")], [(0, "en"), (1, "eau")]],
    [[(0, "of"), (1, "the")], [(0, "erly")]],
).replace("TERMS", "lex")
PHRASES_SQL = asked_sql([[(0, "the")], [(0, "in"), (1, "the")]], [[(0, "tion")]]).replace("TERMS", "lex")


@query("r5_cover_density", f"WITH {PLACED}, {ASKED_SQL} SELECT * FROM matched")
def r5_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of a compiled query: words, phrases, one with a stop word inside, and two exclusions."""
    wanted = lexical.compile_query(spark, ASKED, PORTUGUESE)
    return lexical.ranked(held_index(spark, sf_dir).postings, wanted)


@query("r5_covers_inside_phrases", f"WITH {PLACED}, {PHRASES_SQL} SELECT * FROM matched")
def r5_covers_inside_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase that holds an alternative is no cover of its own."""
    wanted = lexical.compile_query(spark, PHRASES, PORTUGUESE)
    return lexical.ranked(held_index(spark, sf_dir).postings, wanted)


BM25_TERMS = f"""
tf AS (SELECT doc_id, chunk_index, alt, count(*) AS tf FROM begins JOIN sized USING (alt) WHERE NOT banned GROUP BY ALL),
df AS (SELECT alt, count(*) AS df FROM tf GROUP BY alt),
st AS (SELECT count(*) AS n, avg(len({q.tokens('content')})) AS mean FROM chunks),
lengths AS (SELECT DISTINCT doc_id, chunk_index, length FROM spoken),
okapi AS (SELECT doc_id, chunk_index, round(sum(ln(1 + (st.n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double
        / (tf + 1.5::double * (0.25::double + 0.75::double * length / st.mean))), 9) AS bm25
      FROM tf JOIN df USING (alt) JOIN lengths USING (doc_id, chunk_index), st GROUP BY doc_id, chunk_index)"""


@query("r19_bm25_phrases", f"""WITH {PLACED}, {ASKED_SQL}, {BM25_TERMS}
SELECT doc_id, chunk_index, round(bm25, 6) AS bm25, CAST(row_number() OVER (ORDER BY bm25 DESC, doc_id, chunk_index) AS INTEGER) AS rank
FROM okapi JOIN matched USING (doc_id, chunk_index) ORDER BY rank LIMIT 30""")
def r19_bm25_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 with phrases as terms and exclusions kept, from the index alone."""
    wanted = lexical.compile_query(spark, ASKED, PORTUGUESE)
    arm = lexical.bm25_arm(held_index(spark, sf_dir), wanted, 30)
    return arm.select("doc_id", "chunk_index", F.round("bm25", 6).alias("bm25"), "rank")


def searched_sql(scope: str) -> str:
    """The three arms over the index, each within ``scope``, fused and capped."""
    return f"""
titled AS (SELECT doc_id, 0 AS chunk_index, unnest(range(len(t))) AS place, unnest(t) AS word FROM (SELECT doc_id, {q.tokens('title')} AS t FROM doc_words)),
title_lex AS (SELECT doc_id, chunk_index, place, stem AS lexeme FROM titled JOIN title_stems USING (word) WHERE word NOT IN {STOP}),
allowed AS ({scope}),
t_begins AS (SELECT doc_id, alt, place - off AS a FROM title_lex JOIN asked USING (lexeme) JOIN sized USING (alt)
           GROUP BY doc_id, alt, place - off, n HAVING count(DISTINCT off) = n),
t_rank AS (SELECT doc_id, round(count(DISTINCT a) * 0.1::double, 9) AS lexical_rank FROM t_begins GROUP BY doc_id),
qv AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = {NEAR}),
l AS (SELECT doc_id, chunk_index, row_number() OVER (ORDER BY lexical_rank DESC, doc_id, chunk_index) AS rank FROM matched JOIN allowed USING (doc_id) QUALIFY rank <= {8 * K}),
s AS (SELECT c.doc_id, c.chunk_index, row_number() OVER (ORDER BY {DISTANCE}, c.doc_id, c.chunk_index) AS rank
      FROM chunks c JOIN allowed USING (doc_id) JOIN embeddings e ON e.vec_id = c.doc_id, qv QUALIFY rank <= {8 * K}),
td AS (SELECT doc_id, row_number() OVER (ORDER BY lexical_rank DESC, doc_id) AS rank FROM t_rank JOIN allowed USING (doc_id) QUALIFY rank <= {2 * K}),
t AS (SELECT td.doc_id, td.rank, arg_min(c.chunk_index, struct_pack(h := -coalesce(m.lexical_rank, 0), i := c.chunk_index)) AS chunk_index
      FROM td JOIN chunks c USING (doc_id) LEFT JOIN matched m ON m.doc_id = c.doc_id AND m.chunk_index = c.chunk_index GROUP BY td.doc_id, td.rank),
arms AS (SELECT doc_id, chunk_index, 1.0::double / (60 + rank) AS part FROM l UNION ALL SELECT doc_id, chunk_index, 1.0::double / (60 + rank) FROM s
         UNION ALL SELECT doc_id, chunk_index, 1.5::double / (60 + rank) FROM t),
fused AS (SELECT doc_id, chunk_index, round(sum(part), 12) AS score FROM arms GROUP BY ALL),
best AS (SELECT doc_id, chunk_index, score FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_index) AS n FROM fused) WHERE n <= 2
  ORDER BY score DESC, doc_id, chunk_index LIMIT {{k}})"""


TITLE_STEMS = "title_stems AS (SELECT word, stem FROM stems)"
WORDS_SQL = asked_sql([[(0, w)] for w in WORDS_ONLY.split()], []).replace("TERMS", "lex")
BROWSED = Filters(
    works=tuple(f"Brand#{n}" for n in (11, 12, 13, 14, 15, 21, 22, 23, 24, 25)), chapter=1,
    kinds=("1-URGENT", "2-HIGH", "3-MEDIUM"), since="1993-01-01", until="1997-12-31",
)
NOBODY = Filters(people=("C-nobody",))


def scope_sql(f: Filters) -> str:
    """The documents that a set of filters allows; an item's number is its document's."""
    tests = []
    for key, col in (("people", "person"), ("kinds", "kind"), ("collections", "collection")):
        if getattr(f, key):
            tests.append(f"{col} IN {q.in_list(list(getattr(f, key)))}")
    tests += [f"date {sign} DATE '{day}'" for sign, day in ((">=", f.since), ("<=", f.until)) if day]
    if f.works:
        chapter = f" AND r.chapter = {f.chapter}" if f.chapter else ""
        tests.append(f"EXISTS (SELECT 1 FROM refs r WHERE r.item_id = items.item_id AND r.work IN {q.in_list(list(f.works))}{chapter})")
    if f.topics:
        tests.append(f"EXISTS (SELECT 1 FROM refs r WHERE r.item_id = items.item_id AND r.topic IN {q.in_list(list(f.topics))})")
    return "SELECT item_id AS doc_id FROM items WHERE " + " AND ".join(tests or ["true"])


def answer_sql(words: str, f: Filters, k: int = K) -> str:
    return f"WITH {q.ITEMS}, {PLACED}, {words}, {TITLE_STEMS}, {searched_sql(scope_sql(f)).replace('{k}', str(k))}"


def found(spark: SparkSession, sf_dir: str, text: str, filters: Filters) -> DataFrame:
    held = held_index(spark, sf_dir)
    wanted = lexical.compile_query(spark, text, PORTUGUESE)
    scope = lexical.scope_of(tables.items(spark, sf_dir), tables.item_refs(spark, sf_dir), SearchRequest(text, filters=filters))
    return lexical.hybrid(held, passage_vectors(spark, sf_dir, held), wanted, near_vector(spark, sf_dir), K, scope)


@query("r7_hybrid_facets", answer_sql(WORDS_SQL, BROWSED) + " SELECT * FROM best")
def r7_hybrid_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with a chapter, kinds and dates restrict every arm before its cut."""
    return found(spark, sf_dir, WORDS_ONLY, BROWSED)


@query("r7_hybrid_nobody", answer_sql(WORDS_SQL, NOBODY) + " SELECT * FROM best")
def r7_hybrid_nobody(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that nobody meets finds nothing, also by vector."""
    return found(spark, sf_dir, WORDS_ONLY, NOBODY)


@query("r10_filtered_search", answer_sql(WORDS_SQL, BROWSED, 10) + """,
ranked AS (SELECT doc_id, chunk_index, score, row_number() OVER (ORDER BY score DESC, doc_id, chunk_index) AS rank FROM best),
firsts AS (SELECT *, min(rank) OVER (PARTITION BY doc_id) AS f FROM ranked),
nth AS (SELECT *, dense_rank() OVER (ORDER BY f) AS n FROM firsts)
SELECT doc_id, chunk_index, score, CAST(rank AS INTEGER) AS rank, false AS reranked FROM nth WHERE n <= 5""")
def r10_filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request with filters from the query string, answered from the index."""
    held = held_index(spark, sf_dir)
    request = SearchRequest(WORDS_ONLY, limit=5, filters=Filters.from_params(BROWSED.to_params()))
    return lexical.search(
        held, passage_vectors(spark, sf_dir, held), tables.items(spark, sf_dir), tables.item_refs(spark, sf_dir), request,
        near_vector(spark, sf_dir), PORTUGUESE,
    ).select("doc_id", "chunk_index", "score", "rank", "reranked")


GOLDEN = f"""
wanted AS (SELECT DISTINCT item_id AS query_id, stem AS lexeme FROM
            (SELECT item_id, unnest({q.tokens('text')}) AS word FROM benchmark) JOIN stems USING (word) WHERE word NOT IN {STOP}),
tf AS (SELECT lexeme, doc_id, chunk_index, any_value(length) AS length, count(*) AS tf FROM lex GROUP BY lexeme, doc_id, chunk_index),
df AS (SELECT lexeme, count(*) AS df FROM tf GROUP BY lexeme),
st AS (SELECT count(*) AS n, avg(len({q.tokens('content')})) AS mean FROM chunks),
scored AS (SELECT query_id, doc_id, chunk_index, round(sum(ln(1 + (st.n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double
        / (tf + 1.5::double * (0.25::double + 0.75::double * length / st.mean))), 6) AS score
      FROM wanted JOIN tf USING (lexeme) JOIN df USING (lexeme), st GROUP BY query_id, doc_id, chunk_index),
found AS (SELECT query_id, doc_id FROM (SELECT query_id, doc_id, max(score) AS score FROM scored GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10),
expected AS ({CONTAINED}),
judged AS (SELECT b.item_id AS query_id, (SELECT count(*) FROM found f WHERE f.query_id = b.item_id) AS results,
  (SELECT count(*) FROM expected e WHERE e.needle_id = b.item_id AND NOT EXISTS
     (SELECT 1 FROM found f WHERE f.query_id = e.needle_id AND f.doc_id = e.pos)) AS missing, 3 AS min_results FROM benchmark b)"""


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text, whole, as a query to the index: does its first document come back among ten?"""
    texts = tables.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    words = texts.select("query_id", F.explode(F.array_distinct(index.tokens(F.col("text")))).alias("word"))
    lexemes = words.join(PORTUGUESE.vocabulary(words.select("word").distinct()), "word").select("query_id", "lexeme")
    best = lexical.best_of_many(held_index(spark, sf_dir), lexemes, 10)
    expected = contained(spark, sf_dir).select(F.col("needle_id").alias("query_id"), F.col("pos").alias("doc_id"))
    return retrieval.recall(best, expected, texts.select("query_id", F.lit(3).alias("min_results")))


@query("a22_recall_at_k", f"WITH {PLACED}, {GOLDEN} SELECT *, missing = 0 AND results >= min_results AS passed FROM judged")
def a22_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden(spark, sf_dir)


@query("a22_golden_overall", f"""WITH {PLACED}, {GOLDEN}
SELECT count(*) AS queries, count(*) FILTER (missing = 0 AND results >= min_results) AS passed,
       round(count(*) FILTER (missing = 0) / count(*), 9) AS recall FROM judged""")
def a22_golden_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.overall(golden(spark, sf_dir))
