"""Registered queries: passages, hashes, merges, pruning, loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambry import tables
from ambry.functions import text as T
from ambry.functions import values as V
from ambry.operators import index, loader
from ambry.plans import sqltext as q
from ambry.plans.registry import maybe_int, query

C = f"WITH {q.CHUNKS}"
HASH = "sha256(doc_id || ':' || chunk_index || ':' || content)"


@query("r15_chunks", C + "SELECT doc_id, chunk_index, md5(content) AS content_md5, CAST(length(content) AS INTEGER) AS length FROM chunks")
def r15_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.chunk(tables.corpus(spark, sf_dir))
    return found.select("doc_id", "chunk_index", F.md5("content").alias("content_md5"), F.length("content").alias("length"))


def hashed(docs: DataFrame) -> DataFrame:
    found = index.chunk(docs)
    return found.withColumn("content_hash", index.passage_hash(F.col("doc_id"), F.col("chunk_index"), F.col("content")))


@query("r16_chunk_hash", C + f"SELECT doc_id, chunk_index, {HASH} AS content_hash FROM chunks")
def r16_chunk_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(tables.corpus(spark, sf_dir)).select("doc_id", "chunk_index", "content_hash")


# The state an earlier run left behind: labelled documents, the toxic ones with an older text.
STORED = f"""
stored AS (SELECT c.doc_id, c.chunk_index, CASE WHEN l.toxic = 1 THEN 'old ' || c.content ELSE c.content END AS content
           FROM chunks c JOIN labels l USING (doc_id)),
fresh AS (SELECT doc_id, chunk_index, content, {HASH} AS content_hash FROM chunks),
old AS (SELECT doc_id, chunk_index, content, {HASH} AS content_hash FROM stored)"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = tables.load(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = index.chunk(tables.corpus(spark, sf_dir)).join(labels, "doc_id")
    content = F.when(F.col("toxic") == 1, F.concat(F.lit("old "), "content")).otherwise(F.col("content"))
    old = rows.select("doc_id", "chunk_index", content.alias("content"))
    return old.withColumn("content_hash", index.passage_hash(F.col("doc_id"), F.col("chunk_index"), F.col("content")))


@query("r17_incremental_diff", f"""{C}, {STORED}
SELECT f.doc_id, f.chunk_index, f.content_hash FROM fresh f LEFT JOIN old o USING (doc_id, chunk_index)
WHERE f.content_hash IS DISTINCT FROM o.content_hash""")
def r17_incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = hashed(tables.corpus(spark, sf_dir))
    return index.changed(fresh, stored(spark, sf_dir)).select("doc_id", "chunk_index", "content_hash")


@query("s16_chunk_merge", f"""{C}, {STORED},
diff AS (SELECT f.* FROM fresh f LEFT JOIN old o USING (doc_id, chunk_index) WHERE f.content_hash IS DISTINCT FROM o.content_hash)
SELECT doc_id, chunk_index, content_hash FROM diff
UNION ALL SELECT doc_id, chunk_index, content_hash FROM old o WHERE NOT EXISTS (
  SELECT 1 FROM diff d WHERE d.doc_id = o.doc_id AND d.chunk_index = o.chunk_index)""")
def s16_chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["doc_id", "chunk_index"]
    old = stored(spark, sf_dir).select(*key, "content_hash")
    fresh = hashed(tables.corpus(spark, sf_dir)).select(*key, "content_hash")
    return index.upsert(old, index.changed(fresh, old), key)


@query("j8_prune_plan", """
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0)""")
def j8_prune_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tables.load(spark, sf_dir, "labels").where("toxic = 0")
    return index.prune_plan(tables.load(spark, sf_dir, "documents"), kept)


@query("j8_prune_check", """
WITH k AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0),
s AS (SELECT count(*) AS indexed, count(*) FILTER (k.doc_id IS NULL) AS remove FROM labels l LEFT JOIN k USING (doc_id))
SELECT indexed, remove, round(remove / indexed, 9) AS fraction, remove / indexed > 0.05 AS refused FROM s""")
def j8_prune_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = tables.load(spark, sf_dir, "labels")
    return index.prune_check(labels, labels.where("toxic = 0"))


@query("s18_cascade_delete", f"""{C}
SELECT doc_id, count(*) AS passages FROM chunks c
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id AND l.toxic = 1) GROUP BY doc_id""")
def s18_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = tables.load(spark, sf_dir, "labels").where("toxic = 1")
    left = index.cascade({"passages": index.chunk(tables.corpus(spark, sf_dir))}, gone, "doc_id")
    return left["passages"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("passages"))


@query("s19_self_parent", """
SELECT a.c_custkey AS custkey, CAST(b.c_custkey AS DOUBLE) AS parent FROM customer a
LEFT JOIN customer b ON b.c_custkey = a.c_custkey + 900 AND b.c_custkey <> a.c_custkey""")
def s19_self_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents are set only where they exist: customer k claims k + 900."""
    keys = tables.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    claimed = keys.withColumn("parent", F.col("custkey") + 900)
    known = keys.select(F.col("custkey").alias("parent"), F.lit(True).alias("known"))
    found = claimed.join(known, "parent", "left")
    return maybe_int(found.select("custkey", F.when(F.col("known"), F.col("parent")).alias("parent")), "parent")


@query("p10_resume_filter", """
SELECT doc_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)
  AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id) ORDER BY doc_id LIMIT 100""")
def p10_resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next hundred documents neither labelled nor embedded yet."""
    todo = tables.load(spark, sf_dir, "documents").select("doc_id")
    done = tables.load(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return (
        todo.join(done, "doc_id", "left_anti")
        .join(tables.vectors(spark, sf_dir).select("doc_id"), "doc_id", "left_anti")
        .orderBy("doc_id").limit(100)
    )


@query("s20_append_or_correct", """
WITH old AS (SELECT l.doc_id, CASE WHEN quality = 1 THEN d.n_chars ELSE d.n_chars - 1 END AS n, d.source FROM labels l JOIN documents d USING (doc_id))
SELECT d.doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN (o.n, o.source) IS DISTINCT FROM (d.n_chars, d.source) THEN 'fixed' ELSE 'same' END AS status,
  d.n_chars, d.source FROM documents d LEFT JOIN old o USING (doc_id)""")
def s20_append_or_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    labels = tables.load(spark, sf_dir, "labels").select("doc_id", "quality")
    old = docs.join(labels, "doc_id").withColumn(
        "n_chars", F.when(F.col("quality") == 1, F.col("n_chars")).otherwise(F.col("n_chars") - 1)
    )
    return index.upsert_status(old, docs, ["doc_id"], ["n_chars", "source"])


# Raw records made from documents, labels and orders, every field as text.
RAW_SQL = f"""
raw AS (
  SELECT d.doc_id AS pos, 'talk ' || d.doc_id AS name,
         CASE WHEN l.toxic = 1 THEN 'False' ELSE ' True ' END AS processed,
         'f' || md5(d.text) AS hash, d.source, len({q.words('d.text')}) AS n_words, d.n_chars,
         l.quality, CAST(o.o_orderdate AS DATE) AS day
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN orders o ON o.o_orderkey = d.doc_id),
r AS (SELECT pos, name, processed, CASE WHEN n_chars % 11 = 0 THEN '' ELSE hash END AS txt,
        CASE WHEN source = 'src3' THEN '' ELSE source END AS artist,
        CASE WHEN quality = 0 THEN 50.0::double WHEN quality = 1 THEN (60 + n_chars % 40)::double ELSE 55.5::double END AS score,
        CASE WHEN n_words > 0 AND n_chars % 7 <> 0 THEN n_words / (n_chars / 12.0::double / 60) END AS rate,
        CASE WHEN year(day) + 20 BETWEEN 2015 AND 2030 THEN CAST(year(day) + 20 || strftime(day, '-%m-%d') AS DATE) END AS date
      FROM raw),
j AS (SELECT *, CASE WHEN lower(trim(processed)) <> 'true' THEN 'not processed' WHEN score <= 50 THEN 'low score'
        WHEN rate <= 70 THEN 'too few words per minute' WHEN txt = '' THEN 'no transcript file'
        WHEN date IS NULL THEN 'unresolvable date' END AS reason FROM r),
best AS (SELECT * , min(pos) OVER (PARTITION BY txt) AS place,
           row_number() OVER (PARTITION BY txt ORDER BY score DESC, pos) AS n FROM j WHERE reason IS NULL)"""


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.load(spark, sf_dir, "documents").select(
        "doc_id", "source", "n_chars", F.md5("text").alias("hash"), T.count_words(F.col("text")).alias("n_words")
    )
    labels = tables.load(spark, sf_dir, "labels")
    dates = tables.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("day"))
    rows = docs.join(labels, "doc_id", "left").join(dates, "doc_id", "left")
    n = F.col("n_chars")
    blank = F.lit("")
    later = F.concat((F.year("day") + 20).cast("string"), F.date_format("day", "-MM-dd"))
    made = {
        "name": F.concat(F.lit("talk "), "doc_id"),
        "processed": F.when(F.col("toxic") == 1, "False").otherwise(" True "),
        "txt": F.when(n % 11 == 0, blank).otherwise(F.concat(F.lit("f"), "hash")),
        "artist": F.when(F.col("source") == "src3", blank).otherwise(F.col("source")),
        "id": F.col("doc_id").cast("string"),
        "score": F.when(F.col("quality") == 0, "50").when(F.col("quality") == 1, (60 + n % 40).cast("string")).otherwise("55.5"),
        "words": F.when(n % 7 == 0, blank).otherwise(F.col("n_words").cast("string")),
        "duration": (n / 12).cast("string"),
        "date": F.coalesce(later, blank),
    }
    return rows.select(
        F.col("doc_id").alias("pos"), *[made.get(f, blank).alias(f) for f in loader.RAW_FIELDS]
    )


@query("p6_skip_reasons", f"WITH {RAW_SQL} SELECT coalesce(reason, 'kept') AS reason, count(*) AS total FROM j GROUP BY ALL")
def p6_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.coalesce(loader.skip_reason(), F.lit("kept")).alias("reason")
    return raw_records(spark, sf_dir).select(reason).groupBy("reason").agg(F.count(F.lit(1)).alias("total"))


@query("w6_dedupe_keep_best", """
SELECT doc_id, text_hash, n_chars, place FROM (
  SELECT doc_id, md5(text) AS text_hash, n_chars, min(doc_id) OVER (PARTITION BY md5(text)) AS place,
         row_number() OVER (PARTITION BY md5(text) ORDER BY length(source) DESC, doc_id) AS n FROM documents) WHERE n = 1""")
def w6_dedupe_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.load(spark, sf_dir, "documents").select(
        "doc_id", F.md5("text").alias("text_hash"), "n_chars", F.length("source").alias("score")
    )
    return loader.keep_best(rows, "text_hash", "score", "doc_id").select("doc_id", "text_hash", "n_chars", "place")


@query("c4_load", f"""WITH {RAW_SQL}
SELECT pos, place, txt AS transcript_file, coalesce(nullif(artist, ''), 'Desconhecido') AS person,
       CAST(date AS VARCHAR) AS date, score, round(coalesce(rate, 0), 6) AS words_min FROM best WHERE n = 1""")
def c4_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.load_documents(raw_records(spark, sf_dir)).select(
        "pos", "place", "transcript_file", "person", F.col("date").cast("string").alias("date"), "score",
        F.round("words_min", 6).alias("words_min"),
    )


@query("c4_skipped", f"""WITH {RAW_SQL}
SELECT pos, name AS title, reason FROM j WHERE reason IS NOT NULL
UNION ALL SELECT pos, name, 'duplicate of ' || txt FROM best WHERE n > 1""")
def c4_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loader.skipped(raw_records(spark, sf_dir))


@query("f17_resolve_date", """
WITH e AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, epoch(o_orderdate) AS s FROM orders),
d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(substr(iso, 1, 4) AS INTEGER) + 19 AS VARCHAR) || substr(iso, 5) ELSE iso END AS stated,
        CAST(s + 20 * 31557600 AS BIGINT) AS epoch FROM e)
SELECT o_orderkey AS item_id, CAST(CASE WHEN CAST(substr(stated, 1, 4) AS INTEGER) BETWEEN 2015 AND 2030 THEN try_cast(stated AS DATE) END AS VARCHAR) AS by_text,
  CAST(CASE WHEN CAST(substr(stated, 1, 4) AS INTEGER) BETWEEN 2015 AND 2030 AND try_cast(stated AS DATE) IS NOT NULL THEN try_cast(stated AS DATE)
       WHEN year(to_timestamp(epoch) AT TIME ZONE 'UTC') BETWEEN 2015 AND 2030 THEN CAST(to_timestamp(epoch) AT TIME ZONE 'UTC' AS DATE) END AS VARCHAR) AS resolved FROM d""")
def f17_resolve_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    later = F.concat((F.substring(iso, 1, 4).cast("int") + 19).cast("string"), F.substring(iso, 5, 6))
    stated = F.when(F.col("o_orderkey") % 3 == 0, later).otherwise(iso)
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 20 * 31557600
    rows = tables.load(spark, sf_dir, "orders").select("o_orderkey", stated.alias("stated"), seconds.cast("string").alias("epoch"))
    return rows.select(
        F.col("o_orderkey").alias("item_id"),
        V.resolve_date(F.col("stated"), F.lit("")).cast("string").alias("by_text"),
        V.resolve_date(F.col("stated"), F.col("epoch")).cast("string").alias("resolved"),
    )
