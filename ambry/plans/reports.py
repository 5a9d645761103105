"""Registered queries: payloads, listings in display order, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ambry import tables
from ambry.functions import values as V
from ambry.functions.vectors import vector_text
from ambry.operators import catalogue, facets, index, merging, retrieval
from ambry.operators.filters import SearchRequest
from ambry.plans import browse, search
from ambry.plans import sqltext as q
from ambry.plans.registry import maybe_int, query
from ambry.plans.texts import PARAGRAPHS

W = browse.W


@query("p8_reference_payload", """
WITH r AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, p_brand AS work, l_linenumber AS n, l_quantity AS qty, l_returnflag AS f
           FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT doc_id, work, CAST(CASE WHEN n = 7 THEN 0 ELSE n END AS BIGINT) AS chapter, CASE WHEN n <> 2 THEN CAST(floor(qty) AS DOUBLE) END AS verse_start,
  CAST(NULL AS DOUBLE) AS verse_end, CASE WHEN f = 'A' THEN 'titulo' ELSE f END AS source, f <> 'N' AS is_primary
FROM r WHERE doc_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F') AND work <> 'Brand#3'""")
def p8_reference_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference rows as a CSV delivers them: blanks, decimals, stray text."""
    lines = tables.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    parts = tables.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("work"))
    n, f = F.col("l_linenumber"), F.col("l_returnflag")
    rows = lines.join(parts, "l_partkey").select(
        F.format_string(" %d ", "l_orderkey").alias("doc_id"), "work",
        F.when(n == 7, "x").otherwise(n.cast("string")).alias("chapter"),
        F.when(n == 2, "").otherwise(F.col("l_quantity").cast("string")).alias("verse_start"),
        F.lit(None).cast("string").alias("verse_end"), F.when(f == "A", " ").otherwise(f).alias("source"),
        F.when(f == "N", "false").otherwise("yes").alias("is_primary"),
    )
    docs = tables.load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("doc_id"))
    works = parts.where("work <> 'Brand#3'").select("work").distinct()
    return maybe_int(catalogue.reference_payload(rows, docs, works), "verse_start", "verse_end")


@query("p8_topic_payload", """
WITH r AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, p_type AS topic, l_linenumber AS n, l_discount AS d FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT doc_id, topic, round(CASE WHEN n = 1 OR d = 0 THEN 1 ELSE d END, 9) AS confidence FROM r WHERE topic <> 'PROMO'""")
def p8_topic_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.load(spark, sf_dir, "lineitem")
    parts = tables.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("topic"))
    stated = F.when(F.col("l_linenumber") == 1, "n/a").otherwise(F.col("l_discount").cast("string"))
    rows = lines.join(parts, "l_partkey").select(F.col("l_orderkey").cast("string").alias("doc_id"), "topic", stated.alias("confidence"))
    docs = tables.load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"))
    known = parts.where("topic <> 'PROMO'").select("topic").distinct()
    return catalogue.topic_payload(rows, docs, known).withColumn("confidence", F.round("confidence", 9))


@query("p9_alive_flag", """
SELECT event_type = 'view' AS alive, count(*) AS total FROM events GROUP BY ALL""")
def p9_alive_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    text = F.when(kind == "view", " true").when(kind == "click", "True").when(kind == "error", "1")
    rows = tables.load(spark, sf_dir, "events").select(catalogue.alive_flag(text).alias("alive"))
    return rows.groupBy("alive").agg(F.count(F.lit(1)).alias("total"))


@query("j10_discover", "SELECT doc_id AS id, doc_id AS pos FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j10_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = tables.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"))
    known = tables.load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return catalogue.discover(tracks, known).select("id", "pos")


@query("j17_first_reference", W + """,
f AS (SELECT item_id, min(struct_pack(c := chapter, w := work)).w AS first_work FROM refs GROUP BY item_id)
SELECT i.item_id, f.first_work FROM items i LEFT JOIN f USING (item_id)""")
def j17_first_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = tables.item_refs(spark, sf_dir).withColumn("at", F.struct("chapter", "work"))
    return catalogue.first_reference(tables.items(spark, sf_dir).select("item_id"), refs, "at")


@query("u7_prefer_fresh", """
SELECT coalesce(l.doc_id, e.vec_id) AS doc_id, coalesce(l.quality, e.label) AS value
FROM labels l FULL OUTER JOIN embeddings e ON e.vec_id = l.doc_id""")
def u7_prefer_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = tables.load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("value"))
    cached = tables.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("value"))
    return catalogue.prefer(fresh, cached, "doc_id", "value")


@query("u1_union_rows", """
SELECT doc_id, 'quality' AS source, quality AS value FROM labels UNION ALL SELECT vec_id, 'label', label FROM embeddings""")
def u1_union_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = tables.load(spark, sf_dir, "labels").select("doc_id", F.lit("quality").alias("source"), F.col("quality").alias("value"))
    cached = tables.load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.lit("label").alias("source"), F.col("label").alias("value"))
    return labels.unionByName(cached)


@query("u6_union_of_columns", """
SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS brand FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, NULL, NULL FROM supplier
UNION ALL SELECT p_partkey, p_name, NULL, p_retailprice, p_brand FROM part""")
def u6_union_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three tables that have some columns in common."""
    customers = tables.load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    suppliers = tables.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    parts = tables.load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"))
    return merging.stacked(customers, suppliers, parts)


@query("u2_last_wins", """
SELECT coalesce(l.doc_id, e.vec_id) AS doc_id, coalesce(e.label, l.quality) AS value
FROM labels l FULL OUTER JOIN embeddings e ON e.vec_id = l.doc_id""")
def u2_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = tables.load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("value"))
    second = tables.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("value"))
    return index.upsert(first, second, ["doc_id"])


@query("a20_derive_report", W + """
SELECT 'kind ' || coalesce(kind, '-') AS measure, count(*) AS value FROM items GROUP BY ALL
UNION ALL SELECT 'with reference', count(*) FROM items WHERE item_id IN (SELECT item_id FROM refs)
UNION ALL SELECT 'collections repeated', count(*) FROM (SELECT collection FROM items WHERE collection IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)""")
def a20_derive_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.derive_report(tables.items(spark, sf_dir), tables.item_refs(spark, sf_dir))


@query("a24_reference_share", W + """,
s AS (SELECT count(*) AS items, count(*) FILTER (item_id IN (SELECT item_id FROM refs)) AS covered FROM items)
SELECT items, covered, round(100 * covered / items, 1) AS percent FROM s""")
def a24_reference_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.reference_share(tables.items(spark, sf_dir), tables.item_refs(spark, sf_dir))


@query("a25_topics_per_group", """
SELECT p_brand AS grp, count(DISTINCT p_type) AS topics, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS names FROM part GROUP BY p_brand""")
def a25_topics_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxonomy is a closed list of a few dozen rows once it is distinct."""
    pairs = tables.load(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), "p_type").distinct()
    return pairs.groupBy("grp").agg(
        F.count(F.lit(1)).alias("topics"), F.array_join(F.array_sort(F.collect_list("p_type")), ", ").alias("names")
    )


@query("o9_people_in_order", """
WITH p AS (SELECT DISTINCT CASE c_nationkey % 4 WHEN 0 THEN 'Pastor' WHEN 1 THEN 'Reverendo' WHEN 2 THEN 'Missionário' ELSE 'Outros' END AS honorific, c_name AS name FROM customer)
SELECT honorific, name, CASE honorific WHEN 'Reverendo' THEN 1 WHEN 'Pastor' THEN 2 WHEN 'Missionário' THEN 6 ELSE 99 END AS place FROM p""")
def o9_people_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey") % 4
    prefix = F.when(k == 0, "Pastor ").when(k == 1, "Reverendo ").when(k == 2, "Missionário ").otherwise("")
    people = tables.load(spark, sf_dir, "customer").select(F.concat(prefix, "c_name").alias("person"))
    return catalogue.people_in_order(facets.person_counts(people)).select("honorific", "name", "place")


@query("o10_section_list", W + """
SELECT w.section, w.position, w.work, count(DISTINCT r.item_id) AS total FROM works w JOIN refs r USING (work) GROUP BY ALL""")
def o10_section_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = tables.item_refs(spark, sf_dir)
    return catalogue.section_list(facets.work_totals(tables.works(spark, sf_dir), refs))


@query("o11_leading_works", W + """,
p AS (SELECT DISTINCT item_id, work, position FROM refs JOIN works USING (work)),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY position) AS n FROM p)
SELECT item_id, string_agg(work, ', ' ORDER BY n) AS works FROM n WHERE n <= 2 GROUP BY item_id""")
def o11_leading_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.leading_works(tables.item_refs(spark, sf_dir).join(tables.works(spark, sf_dir), "work"))


@query("w7_group_by_doc", search.arms_sql("") + """,
ranked AS (SELECT doc_id, chunk_index, row_number() OVER (ORDER BY score DESC, doc_id, chunk_index) AS rank FROM fused)
SELECT doc_id, CAST(min(rank) AS INTEGER) AS rank, arg_min(chunk_index, rank) AS top_chunk, count(*) - 1 AS more FROM ranked GROUP BY doc_id""")
def w7_group_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = search.r8_rrf_three_arms(spark, sf_dir)
    order = Window.orderBy(F.desc("score"), "doc_id", "chunk_index")
    return retrieval.group_by_doc(fused.withColumn("rank", F.row_number().over(order)))


@query("r10_search", search.arms_sql("").replace(f"rank <= {8 * search.K}", "rank <= 80") + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, chunk_index) AS rank FROM best),
nth AS (SELECT *, dense_rank() OVER (ORDER BY f) AS n FROM (SELECT *, min(rank) OVER (PARTITION BY doc_id) AS f FROM ranked))
SELECT doc_id, chunk_index, CAST(rank AS INTEGER) AS rank, score, md5(content) AS content_md5, false AS reranked
FROM nth JOIN chunks USING (doc_id, chunk_index) WHERE n <= 5""")
def r10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole request: five documents for a few words, without a reranker."""
    docs = tables.corpus(spark, sf_dir)
    found = search.indexed(docs, tables.vectors(spark, sf_dir))
    request = SearchRequest(" ".join(search.TERMS.terms), limit=5)
    page = retrieval.search(docs, found, request, search.near_vector(spark, sf_dir), lambda t: t.lower().split())
    return page.select("doc_id", "chunk_index", "rank", "score", F.md5("content").alias("content_md5"), "reranked")


@query("r14_vector_text", """
SELECT vec_id AS doc_id, md5('[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ',') || ']') AS text_md5 FROM embeddings""")
def r14_vector_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.vectors(spark, sf_dir).select("doc_id", F.md5(vector_text(F.col("embedding"))).alias("text_md5"))


@query("r18_sentence_chunks", f"""WITH RECURSIVE {PARAGRAPHS},
fill AS (
  SELECT doc_id, i, 0 AS chunk, n AS total FROM sw WHERE i = 1
  UNION ALL
  SELECT sw.doc_id, sw.i, CASE WHEN f.total >= 200 AND f.total + sw.n > 200 THEN f.chunk + 1 ELSE f.chunk END,
         CASE WHEN f.total >= 200 AND f.total + sw.n > 200 THEN sw.n ELSE f.total + sw.n END
  FROM fill f JOIN sw ON sw.doc_id = f.doc_id AND sw.i = f.i + 1),
whole AS (SELECT doc_id, chunk, {q.words("string_agg(sentence, ' ' ORDER BY i)")} AS w FROM fill JOIN sw USING (doc_id, i) GROUP BY ALL),
sized AS (SELECT *, CASE WHEN len(w) > 250 THEN CAST(ceil(len(w) / 200.0) AS BIGINT) ELSE 1 END AS parts FROM whole),
cut AS (SELECT doc_id, chunk, w, len(w) // parts AS each, unnest(range(parts)) AS j FROM sized),
piece AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk, j) - 1 AS idx, w[j * each + 1 : (j + 1) * each] AS w FROM cut),
paired AS (SELECT doc_id, idx, w, lead(w) OVER (PARTITION BY doc_id ORDER BY idx) AS nxt FROM piece)
SELECT doc_id, CAST(idx AS INTEGER) AS chunk_index, md5(array_to_string(list_concat(w, nxt[1:30]), ' ')) AS content_md5 FROM paired WHERE nxt IS NOT NULL""")
def r18_sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.sentence_chunk(tables.corpus(spark, sf_dir))
    return found.select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


@query("f39_json_in_reply", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS k FROM events""")
def f39_json_in_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies with the object fenced, in prose, or absent."""
    kind = F.col("event_type")
    reply = (
        F.when(kind == "error", "I cannot say.")
        .when(kind == "view", F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone {x}.")))
        .otherwise(F.concat(F.lit("Here: "), "props", F.lit(" ok")))
    )
    body = V.json_in_reply(reply)
    return tables.load(spark, sf_dir, "events").select("event_id", F.get_json_object(body, "$.k").cast("double").alias("k"))


@query("f40_client_key", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'u' || user_id WHEN 'click' THEN 'ip' || user_id ELSE 'unknown' END AS client FROM events""")
def f40_client_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    forwarded = F.when(kind == "view", F.concat(F.lit(" u"), user, F.lit(" , proxy"))).when(kind == "click", " , x")
    real = F.when(kind.isin("view", "click"), F.concat(F.lit("ip"), user)).when(kind == "error", " ")
    return tables.load(spark, sf_dir, "events").select("event_id", V.client_key(forwarded, real).alias("client"))


@query("c7_record_problems", f"""
WITH r AS (SELECT doc_id, len({q.words('text')}) AS words, CASE WHEN n_chars % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS date
           FROM documents LEFT JOIN orders ON o_orderkey = doc_id)
SELECT 'no words' AS rule, CAST(doc_id AS VARCHAR) AS key FROM r WHERE words <= 0
UNION ALL SELECT 'no date', CAST(doc_id AS VARCHAR) FROM r WHERE date IS NULL
UNION ALL SELECT 'newest is too old', CAST(max(date) AS VARCHAR) FROM r HAVING DATE '2002-01-01' - max(date) > 60""")
def c7_record_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ambry.functions.text import count_words

    dates = tables.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("d"))
    rows = tables.load(spark, sf_dir, "documents").join(dates, "doc_id", "left").select(
        "doc_id", count_words(F.col("text")).alias("words"), F.when(F.col("n_chars") % 9 != 0, F.col("d")).alias("date"))
    return catalogue.record_problems(rows, 60, "2002-01-01")


@query("c9_run_batch", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN upper(event_type) END AS answer,
  CASE WHEN event_type = 'error' THEN 'ValueError: no answer' END AS error FROM events""")
def c9_run_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    def call(kind: str) -> str:
        if kind == "error":
            raise ValueError("no answer")
        return kind.upper()

    rows = tables.load(spark, sf_dir, "events").select("event_id", "event_type")
    return catalogue.run_batch(rows, "event_type", call).select("event_id", "answer", "error")


@query("c12_download_state", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'unreadable' WHEN event_type = 'signup' THEN 'undeclared'
  WHEN event_type = 'view' THEN 'whole' ELSE 'short' END AS state FROM events""")
def c12_download_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value") + 1
    measured = F.when(kind != "error", value)
    declared = F.when(kind == "view", value * 1.0005).when(kind != "signup", value * 1.01)
    return tables.load(spark, sf_dir, "events").select("event_id", catalogue.download_state(measured, declared).alias("state"))
