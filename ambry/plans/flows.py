"""Registered queries: streams, file round trips, crawler outputs, embeddings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambry import tables
from ambry.functions.text import slugify
from ambry.operators import index
from ambry.plans import browse, ordered
from ambry.plans import sqltext as q
from ambry.plans.registry import ORACLES, query
from ambry.session import scratch_path
from ambry.sources import records, site, splits, transcripts
from ambry.streaming import ingest, limiter


@query("t3_stream_upsert", """
SELECT doc_id, source, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents""")
def t3_stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive as files; labelled ones arrive again, corrected; the last version counts."""
    inbox, table = scratch_path(spark, "inbox"), scratch_path(spark, "documents")
    docs = tables.load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.lit(1).alias("version"))
    fixed = docs.join(tables.load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    steps = [docs, fixed.withColumn("n_chars", F.col("n_chars") + 1).withColumn("version", F.lit(2))]
    for step in steps:
        step.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(docs.schema).parquet(inbox)
        ingest.ingest(stream, table, f"{table}-progress").awaitTermination()
    return ingest.current(spark, table, docs.schema, ["doc_id"], "version").drop("version")


SLICES = 4


@query("t1_stream_limiter", ORACLES["t1_rate_limiter"])
def t1_stream_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same limiter live: the log arrives in time slices, one trigger each."""
    inbox, out = scratch_path(spark, "hits"), scratch_path(spark, "limited")
    hits = ordered.hits(spark, sf_dir)
    cuts = hits.approxQuantile("t", [i / SLICES for i in range(1, SLICES)], 0.01)
    slice_no = sum((F.col("t") >= c).cast("int") for c in cuts) if cuts else F.lit(0)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i in range(SLICES):
            hits.where(slice_no == i).write.mode("append").parquet(inbox)
            stream = spark.readStream.schema(hits.schema).parquet(inbox)
            decided = limiter.limited(stream, ordered.LIMIT, ordered.WIDTH)
            (
                decided.writeStream.format("parquet").option("path", out)
                .option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start().awaitTermination()
            )
    finally:
        spark.conf.set(key, before)
    rows = spark.read.schema(limiter.OUTPUT).parquet(out)
    return rows.select(F.col("key").alias("user_id"), F.col("event").alias("event_id"), "accepted")


@query("s1_csv_round_trip", """
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, md5(text || ', "' || role || '"') AS text_md5 FROM conversations""")
def s1_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with commas, quotes and line breaks through CSV and back."""
    path = scratch_path(spark, "csv")
    text = F.concat("text", F.lit(', "'), "role", F.lit('"'))
    rows = tables.load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("text"))
    records.write_csv(rows, path, rows.columns)
    return records.read_csv(spark, path, rows.columns).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("s1_split_records", """
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, md5(text || ', "' || chr(10) || role || '"' || chr(13) || chr(10) || text) AS text_md5
FROM conversations""")
def s1_split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes and line breaks, read back by splits that know nothing of each other."""
    path = scratch_path(spark, "csv")
    text = F.concat("text", F.lit(', "\n'), "role", F.lit('"\r\n'), "text")
    rows = tables.load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("text"))
    records.write_csv(rows, path, rows.columns)
    return splits.read_split_csv(spark, path, rows.columns).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("s3_parse_texts", """
SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations""")
def s3_parse_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a document of its own that holds a header and one quoted record."""
    rows = tables.load(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    quoted = F.concat(F.lit('role,text\n'), "role", F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"\n'))
    found = splits.parse_texts(rows.select("key", quoted.alias("text")), "key", "text", ["role", "text"]).where("n > 0")
    at = F.split("key", "/")
    return found.select(at[0].cast("long").alias("conv_id"), at[1].cast("long").alias("turn"), "role", F.md5("text").alias("text_md5"))


@query("s2_csv_lines", """
WITH c AS (SELECT page_id, url, '"' || replace(html, '"', '""') || '"' AS cell FROM pages)
SELECT md5(page_id || ',' || url || ',' || cell) AS line_md5 FROM c""")
def s2_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = records.csv_lines(tables.load(spark, sf_dir, "pages"), ["page_id", "url", "html"])
    return lines.select(F.md5("value").alias("line_md5"))


@query("s9_json_lines", """
SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def s9_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "rows")
    rows = tables.load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    records.append_json_lines(rows.where("turn = 0"), path)
    records.append_json_lines(rows.where("turn > 0"), path)
    back = records.read_json_lines(spark, path, rows.schema)
    kept = records.forget(back, back.where("role = 'system'"), "conv_id")
    return kept.select("conv_id", "turn", F.md5("text").alias("text_md5"))


@query("s7_read_raw", r"""
WITH l AS (SELECT doc_id, string_split(rtrim(text, chr(10)), chr(10)) AS lines FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(lines, lambda s: trim(regexp_replace('[00:01] x] ' || s, '\[.+\]\s+', '', 'g'))), ' ')) AS text_md5 FROM l""")
def s7_read_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a marker before every line, cleaned to one paragraph."""
    text = F.regexp_replace("text", r"\n+\z", "")
    marked = F.regexp_replace(text, "(?m)^", "[00:01] x] ")
    return tables.load(spark, sf_dir, "documents").select("doc_id", F.md5(transcripts.clean_lines(marked)).alias("text_md5"))


@query("s22_sitemap", browse.W + f""",
e AS (SELECT '/' AS path, NULL AS lastmod UNION ALL SELECT '/' || unnest(['biblia', 'temas', 'series', 'pregadores', 'datas']), NULL
 UNION ALL SELECT DISTINCT '/biblia/' || {q.slug('work')}, NULL FROM refs
 UNION ALL SELECT DISTINCT '/biblia/' || {q.slug('work')} || '/' || chapter, NULL FROM refs WHERE chapter > 0
 UNION ALL SELECT DISTINCT '/temas/' || {q.slug('topic')}, NULL FROM refs
 UNION ALL SELECT DISTINCT '/series/' || {q.slug('collection')}, NULL FROM items WHERE collection IS NOT NULL
 UNION ALL SELECT DISTINCT '/pregadores/' || {q.slug('person')}, NULL FROM items
 UNION ALL SELECT DISTINCT '/datas/' || year(date), NULL FROM items
 UNION ALL SELECT '/sermao/' || item_id || '%20%26', CAST(date AS VARCHAR) FROM items)
SELECT '  <url>' || chr(10) || '    <loc>https://x.example' || replace(path, '&', '&amp;') || '</loc>'
  || coalesce(chr(10) || '    <lastmod>' || lastmod || '</lastmod>', '') || chr(10) || '  </url>' AS value FROM e""")
def s22_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, refs = tables.items(spark, sf_dir), tables.item_refs(spark, sf_dir)
    one = F.lit(1).alias("total")
    rows = site.entries(
        spark,
        items.select(F.concat(F.col("item_id").cast("string"), F.lit(" &")).alias("item_id"), "date"),
        refs.select(slugify(F.col("work")).alias("work"), "chapter").distinct(),
        refs.select(slugify(F.col("topic")).alias("slug"), one).distinct(),
        items.where("collection IS NOT NULL").select(slugify(F.col("collection")).alias("slug"), one).distinct(),
        items.select(slugify(F.col("person")).alias("slug")).distinct(),
        items.select(F.year("date").alias("year")).distinct(),
    )
    return site.url_tags(rows, "https://x.example")


@query("p15_date_leaf", """
WITH o AS (SELECT o_orderkey AS item_id, o_orderkey % 3 AS k, o_orderdate + INTERVAL 6 YEAR AS d FROM orders)
SELECT item_id, CAST(CASE WHEN year(d) >= 2000 THEN CASE k WHEN 0 THEN make_date(year(d), 1, 1) WHEN 1 THEN CAST(date_trunc('month', d) AS DATE) END END AS VARCHAR) AS since,
  CAST(CASE WHEN year(d) >= 2000 THEN CASE k WHEN 0 THEN make_date(year(d), 12, 31) WHEN 1 THEN last_day(d) END END AS VARCHAR) AS until FROM o""")
def p15_date_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.expr("o_orderdate + INTERVAL 6 YEARS")
    k = F.col("o_orderkey") % 3
    sub = F.when(k == 1, F.month(day).cast("string")).when(k == 2, "13")
    rows = tables.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.year(day).cast("string").alias("slug"), sub.alias("sub"))
    since, until = site.date_leaf(F.col("slug"), F.col("sub"))
    return rows.select("item_id", since.cast("string").alias("since"), until.cast("string").alias("until"))


DIMS = 16


def hashed_vectors(texts: list[str]) -> list[list[float]]:
    """A stand-in for a remote model: word lengths and initials counted into a few bins."""
    series = pd.Series(texts).str.lower().str.split()
    out = []
    for words in series:
        bins = [0.0] * DIMS
        for w in words or []:
            bins[len(w) % DIMS] += 1.0
        out.append(bins)
    return out


@query("r12_embed_passages", f"""WITH {q.CHUNKS},
w AS (SELECT doc_id, chunk_index, unnest({q.words('content')}) AS word FROM chunks),
b AS (SELECT doc_id, chunk_index, length(word) % {DIMS} AS bin, count(*) AS n FROM w GROUP BY ALL),
n AS (SELECT doc_id, chunk_index, sqrt(sum(n * n)) AS norm, sum(CASE WHEN bin = 3 THEN n ELSE 0 END) AS third FROM b GROUP BY ALL)
SELECT doc_id, chunk_index, {DIMS} AS dims, round(third / norm, 3) AS third FROM n""")
def r12_embed_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.embed(index.chunk(tables.corpus(spark, sf_dir)), hashed_vectors, DIMS)
    return found.select(
        "doc_id", "chunk_index", F.size("embedding").alias("dims"),
        F.round(F.get("embedding", F.lit(3)).cast("double"), 3).alias("third"),
    )
