"""Registered queries: retrieval over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ambry import tables
from ambry.functions.vectors import norm, normalize
from ambry.operators import index, retrieval
from ambry.operators.retrieval import LexicalQuery
from ambry.plans import sqltext as q
from ambry.plans.registry import maybe_int, query
from ambry.session import scratch_path

TERMS = LexicalQuery(("tion", "heron", "laaion", "que", "ring", "sch", "ueez"))
NEAR = 7
LANGS = ["en", "fr", "es"]
K = 10


def near_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: one row, as a client would send it."""
    row = tables.vectors(spark, sf_dir).where(F.col("doc_id") == NEAR).select("embedding").first()
    return list(row[0])


def passages(docs: DataFrame) -> DataFrame:
    return index.chunk(docs, "source", with_tokens=True)


def indexed(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The passage index of some documents, stored as the arms of a search read it.

    Texts are split and folded once; each arm then scans its own columns only.
    Vectors join the documents, before these multiply into passages.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "passages")
    found = index.chunk(docs.join(vectors, "doc_id", "left"), "embedding", with_tokens=True)
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def hits(expr: str, terms: tuple[str, ...] = TERMS.terms) -> str:
    return f"len(list_filter({expr}, lambda t: t IN {q.in_list(list(terms))}))"


DISTANCE = f"""round(1 - list_inner_product(CAST(e.embedding AS DOUBLE[]), qv.v)
  / (sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))
     * sqrt(list_inner_product(qv.v, qv.v))), 9)"""


def arms_sql(where: str) -> str:
    return f"""
WITH {q.CHUNKS.replace('FROM documents', 'FROM documents ' + where)},
toks AS (SELECT doc_id, chunk_index, source, title, {q.tokens('content')} AS toks FROM chunks),
qv AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = {NEAR}),
lex0 AS (SELECT doc_id, chunk_index, {hits('toks')} AS hits FROM toks),
lex AS (SELECT doc_id, chunk_index, hits, row_number() OVER (ORDER BY hits DESC, doc_id, chunk_index) AS rank
        FROM lex0 WHERE hits > 0 QUALIFY rank <= {8 * K}),
sem AS (SELECT t.doc_id, t.chunk_index, {DISTANCE} AS distance,
               row_number() OVER (ORDER BY {DISTANCE}, t.doc_id, t.chunk_index) AS rank
        FROM toks t JOIN embeddings e ON e.vec_id = t.doc_id, qv
        QUALIFY rank <= {8 * K}),
tdocs AS (SELECT doc_id, hits, row_number() OVER (ORDER BY hits DESC, doc_id) AS rank
          FROM (SELECT doc_id, {hits(q.tokens('title'))} AS hits FROM doc_words) WHERE hits > 0
          QUALIFY rank <= {2 * K}),
tit AS (SELECT d.doc_id, d.rank, d.hits, arg_min(l.chunk_index, struct_pack(h := -l.hits, i := l.chunk_index)) AS chunk_index
        FROM tdocs d JOIN lex0 l USING (doc_id) GROUP BY d.doc_id, d.rank, d.hits),
fused AS (
  SELECT coalesce(lex.doc_id, sem.doc_id, tit.doc_id) AS doc_id,
         coalesce(lex.chunk_index, sem.chunk_index, tit.chunk_index) AS chunk_index,
         lex.rank AS l, sem.rank AS s, tit.rank AS t,
         round(coalesce(1.0::double / (60 + lex.rank), 0) + coalesce(1.0::double / (60 + sem.rank), 0)
               + coalesce(1.5::double / (60 + tit.rank), 0), 12) AS score
  FROM lex FULL OUTER JOIN sem ON lex.doc_id = sem.doc_id AND lex.chunk_index = sem.chunk_index
  FULL OUTER JOIN tit ON tit.doc_id = coalesce(lex.doc_id, sem.doc_id)
                     AND tit.chunk_index = coalesce(lex.chunk_index, sem.chunk_index)
),
best AS (
  SELECT doc_id, chunk_index, score FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_index) AS n FROM fused)
  WHERE n <= 2 ORDER BY score DESC, doc_id, chunk_index LIMIT {K}
)
"""


def _answer(spark: SparkSession, sf_dir: str, langs: list[str] | None) -> DataFrame:
    docs = tables.corpus(spark, sf_dir)
    if langs:
        docs = docs.where(F.col("lang").isin(langs))
    found = indexed(docs, tables.vectors(spark, sf_dir))
    best = retrieval.hybrid_search(docs, found, TERMS, near_vector(spark, sf_dir), K)
    text = docs.join(F.broadcast(best), "doc_id")
    return text.select(
        "doc_id", "chunk_index", "source", "title", "score",
        F.sha2(index.window_at(index.words(F.col("text")), F.col("chunk_index")), 256).alias("content_hash"),
    )


_ANSWER_SQL = """SELECT b.doc_id, b.chunk_index, c.source, c.title, b.score, sha256(c.content) AS content_hash
FROM best b JOIN chunks c USING (doc_id, chunk_index)"""


@query("r7_hybrid_search", arms_sql("") + _ANSWER_SQL)
def r7_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, None)


@query("r7_hybrid_filtered", arms_sql(f"WHERE lang IN {q.in_list(LANGS)}") + _ANSWER_SQL)
def r7_hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answer(spark, sf_dir, LANGS)


@query("r8_rrf_three_arms", arms_sql("") + """
SELECT doc_id, chunk_index, CAST(l AS DOUBLE) AS lexical_rank, CAST(s AS DOUBLE) AS semantic_rank,
       CAST(t AS DOUBLE) AS title_rank, score FROM fused""")
def r8_rrf_three_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.corpus(spark, sf_dir)
    found = indexed(docs, tables.vectors(spark, sf_dir))
    arms = {
        "lexical": retrieval.lexical_arm(found, TERMS, retrieval.ARM_DEPTH * K),
        "semantic": retrieval.semantic_arm(found, near_vector(spark, sf_dir), retrieval.ARM_DEPTH * K),
        "title": retrieval.title_arm(docs, found, TERMS, retrieval.TITLE_DEPTH * K),
    }
    return maybe_int(retrieval.fuse(arms, retrieval.WEIGHTS), "lexical_rank", "semantic_rank", "title_rank")


@query("r9_title_arm", arms_sql("") + """
SELECT doc_id, chunk_index, CAST(rank AS INTEGER) AS rank, CAST(hits AS INTEGER) AS hits FROM tit""")
def r9_title_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.corpus(spark, sf_dir)
    return retrieval.title_arm(docs, passages(docs), TERMS, retrieval.TITLE_DEPTH * K)


@query("r4_lexical_match", f"""
WITH {q.CHUNKS}, toks AS (SELECT doc_id, chunk_index, {q.tokens('content')} AS toks FROM chunks)
SELECT doc_id, chunk_index, CAST({hits('toks')} AS INTEGER) AS hits FROM toks
WHERE {hits('toks')} > 0 AND NOT list_contains(toks, 'erly')""")
def r4_lexical_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = LexicalQuery(TERMS.terms, excluded=("erly",))
    found = passages(tables.corpus(spark, sf_dir))
    return found.select(
        "doc_id", "chunk_index", retrieval.match_positions(F.col("tokens"), wanted).alias("hits")
    ).where("hits > 0")


@query("r3_phrase_match", f"""
WITH {q.CHUNKS}, toks AS (
  SELECT doc_id, chunk_index, ' ' || array_to_string({q.tokens('content')}, '  ') || ' ' AS line FROM chunks),
n AS (SELECT doc_id, chunk_index,
        CAST(2 * ((length(line) - length(replace(line, ' in  the ', ''))) // 9) AS INTEGER) AS hits FROM toks)
SELECT doc_id, chunk_index, hits FROM n WHERE hits > 0""")
def r3_phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = retrieval.lexical_query('"in the"', lambda text: text.lower().split())
    found = passages(tables.corpus(spark, sf_dir))
    return found.select(
        "doc_id", "chunk_index", retrieval.match_positions(F.col("tokens"), wanted).alias("hits")
    ).where("hits > 0")


@query("r5_lexical_rank", arms_sql("") + """
SELECT doc_id, chunk_index, round(hits * 0.1::double, 9) AS lexical_rank, CAST(rank AS INTEGER) AS place FROM lex""")
def r5_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = retrieval.lexical_arm(passages(tables.corpus(spark, sf_dir)), TERMS, retrieval.ARM_DEPTH * K)
    return arm.select(
        "doc_id", "chunk_index", F.round(F.col("hits") * F.lit(0.1), 9).alias("lexical_rank"),
        F.col("rank").alias("place"),
    )


@query("r6_knn_cosine", f"""
WITH qv AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = {NEAR})
SELECT vec_id AS doc_id, 0 AS chunk_index, {DISTANCE} AS distance,
       CAST(row_number() OVER (ORDER BY {DISTANCE}, vec_id) AS INTEGER) AS rank
FROM embeddings e, qv ORDER BY rank LIMIT 50""")
def r6_knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.vectors(spark, sf_dir).withColumn("chunk_index", F.lit(0))
    return retrieval.semantic_arm(rows, near_vector(spark, sf_dir), 50)


@query("j18_rerank_reply", f"""
WITH qv AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = {NEAR}),
c AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {DISTANCE}, vec_id) AS rank FROM embeddings e, qv QUALIFY rank <= 50),
reply AS (SELECT p_partkey % 70 - 10 AS index, max(p_retailprice) AS score FROM part GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, rank) AS INTEGER) AS rank, score FROM c JOIN reply ON index = rank - 1""")
def j18_rerank_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty candidates in the order of a reply by position, some of whose positions are out of range."""
    rows = tables.vectors(spark, sf_dir).withColumn("chunk_index", F.lit(0))
    candidates = retrieval.semantic_arm(rows, near_vector(spark, sf_dir), 50).select("doc_id", "rank")
    reply = tables.load(spark, sf_dir, "part").select((F.col("p_partkey") % 70 - 10).alias("index"), F.col("p_retailprice").alias("score"))
    return retrieval.replied(candidates, reply).select("doc_id", "rank", "score")


@query("r13_normalize", """
WITH v AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT doc_id, e, sqrt(list_inner_product(e, e)) AS n FROM v)
SELECT doc_id, round(n, 6) AS length, round(e[1] / n, 6) AS first_value, round(e[64] / n, 6) AS last_value FROM n""")
def r13_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = normalize(F.col("embedding"))
    return tables.vectors(spark, sf_dir).select(
        "doc_id", F.round(norm(F.col("embedding")), 6).alias("length"),
        F.round(F.get(unit, F.lit(0)), 6).alias("first_value"),
        F.round(F.get(unit, F.lit(63)), 6).alias("last_value"),
    )


@query("w5_page_by_doc", arms_sql("") + """,
ranked AS (SELECT doc_id, chunk_index, row_number() OVER (ORDER BY score DESC, doc_id, chunk_index) AS rank FROM best),
firsts AS (SELECT *, min(rank) OVER (PARTITION BY doc_id) AS f FROM ranked),
nth AS (SELECT *, dense_rank() OVER (ORDER BY f) AS n FROM firsts)
SELECT doc_id, chunk_index, CAST(rank AS INTEGER) AS rank FROM nth WHERE n <= 5""")
def w5_page_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.corpus(spark, sf_dir)
    found = indexed(docs, tables.vectors(spark, sf_dir))
    best = retrieval.hybrid_search(docs, found, TERMS, near_vector(spark, sf_dir), K)
    order = Window.orderBy(F.desc("score"), "doc_id", "chunk_index")
    ranked = best.withColumn("rank", F.row_number().over(order))
    return retrieval.page_by_doc(ranked, 5).select("doc_id", "chunk_index", "rank")


BM25_SQL = f"""
WITH {q.CHUNKS}, toks AS (SELECT doc_id, chunk_index, {q.tokens('content')} AS toks FROM chunks),
tf AS (SELECT doc_id, chunk_index, len(toks) AS n, term, len(list_filter(toks, lambda t: t = term)) AS tf
       FROM toks, (SELECT unnest({list(TERMS.terms)}) AS term)),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM toks),
s AS (SELECT doc_id, chunk_index, round(sum(ln(1 + (st.n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double
        / (tf + 1.5::double * (0.25::double + 0.75::double * tf.n / st.mean))), 9) AS bm25
      FROM tf JOIN df USING (term), st GROUP BY doc_id, chunk_index)"""


@query("r19_bm25", BM25_SQL + """
SELECT doc_id, chunk_index, round(bm25, 6) AS bm25,
       CAST(row_number() OVER (ORDER BY bm25 DESC, doc_id, chunk_index) AS INTEGER) AS rank
FROM s WHERE bm25 > 0 ORDER BY rank LIMIT 30""")
def r19_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = retrieval.bm25_arm(passages(tables.corpus(spark, sf_dir)), TERMS, 30)
    return arm.select("doc_id", "chunk_index", F.round("bm25", 6).alias("bm25"), "rank")


@query("r19_bm25_rrf", BM25_SQL + f""",
lex AS (SELECT doc_id, chunk_index, row_number() OVER (ORDER BY bm25 DESC, doc_id, chunk_index) AS rank FROM s WHERE bm25 > 0 QUALIFY rank <= 30),
qv AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = {NEAR}),
sem AS (SELECT t.doc_id, t.chunk_index, row_number() OVER (ORDER BY {DISTANCE}, t.doc_id, t.chunk_index) AS rank
        FROM toks t JOIN embeddings e ON e.vec_id = t.doc_id, qv QUALIFY rank <= 30)
SELECT coalesce(lex.doc_id, sem.doc_id) AS doc_id, coalesce(lex.chunk_index, sem.chunk_index) AS chunk_index,
  CAST(lex.rank AS DOUBLE) AS lexical_rank, CAST(sem.rank AS DOUBLE) AS semantic_rank,
  round(coalesce(1.0::double / (60 + lex.rank), 0) + coalesce(1.0::double / (60 + sem.rank), 0), 12) AS score
FROM lex FULL OUTER JOIN sem ON lex.doc_id = sem.doc_id AND lex.chunk_index = sem.chunk_index
ORDER BY score DESC, 1, 2 LIMIT 30""")
def r19_bm25_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-arm variant: BM25 and vectors, 30 each, equal weights."""
    found = indexed(tables.corpus(spark, sf_dir), tables.vectors(spark, sf_dir))
    arms = {
        "lexical": retrieval.bm25_arm(found, TERMS, 30),
        "semantic": retrieval.semantic_arm(found, near_vector(spark, sf_dir), 30),
    }
    fused = retrieval.fuse(arms, {"lexical": 1.0, "semantic": 1.0})
    best = fused.orderBy(F.desc("score"), "doc_id", "chunk_index").limit(30)
    return maybe_int(best, "lexical_rank", "semantic_rank")


@query("r11_rerank", arms_sql("") + f""",
ranked AS (SELECT doc_id, chunk_index, score, row_number() OVER (ORDER BY score DESC, doc_id, chunk_index) AS rank FROM best),
words AS (SELECT r.*, list_distinct({q.words("lower(c.content)")}) AS w FROM ranked r JOIN chunks c USING (doc_id, chunk_index)),
pair AS (SELECT *, {hits('w')} / {len(TERMS.terms)}::double AS pair FROM words)
SELECT doc_id, chunk_index, CAST(row_number() OVER (ORDER BY pair DESC, rank) AS INTEGER) AS rank,
       round(pair, 9) AS score, true AS reranked FROM pair""")
def r11_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.corpus(spark, sf_dir)
    found = indexed(docs, tables.vectors(spark, sf_dir))
    best = retrieval.hybrid_search(docs, found, TERMS, near_vector(spark, sf_dir), K)
    order = Window.orderBy(F.desc("score"), "doc_id", "chunk_index")
    ranked = docs.join(F.broadcast(best.withColumn("rank", F.row_number().over(order))), "doc_id").select(
        "doc_id", "chunk_index", "score", "rank",
        index.window_at(index.words(F.col("text")), F.col("chunk_index")).alias("content"),
    )
    out = retrieval.rerank(ranked, " ".join(TERMS.terms), retrieval.overlap_scorer, 2 * K)
    return out.select("doc_id", "chunk_index", "rank", F.round("score", 9).alias("score"), "reranked")


@query("j19_label_by_vector", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
parts AS (SELECT d.lang, i, avg(e.v[i]) AS x FROM e JOIN documents d ON d.doc_id = e.vec_id, range(1, 65) AS r(i) GROUP BY ALL),
lv AS (SELECT lang AS label, list(x ORDER BY i) AS v FROM parts GROUP BY lang),
s AS (SELECT vec_id AS doc_id, label, round(list_inner_product(e.v, lv.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(lv.v, lv.v))), 6) AS similarity
      FROM e, lv),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, label) AS place FROM s WHERE similarity >= 0.05)
SELECT doc_id, CAST(place AS INTEGER) AS place, label, similarity FROM r WHERE place <= 3""")
def j19_label_by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages nearest to each vector; a language's vector is the mean of all of its documents."""
    held = tables.vectors(spark, sf_dir)
    langs = tables.corpus(spark, sf_dir).select("doc_id", "lang")
    parts = held.join(langs, "doc_id").select("lang", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("lang", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")
    )
    # a row for each label of the closed list
    labels = {r.lang: [p.x for p in r.v] for r in means.collect()}
    return retrieval.top_labels(held, labels, cutoff=0.05, digits=6)
