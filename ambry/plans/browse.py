"""Registered queries: facets, drill-sideways counts, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambry import tables
from ambry.operators import facets, listing
from ambry.operators.filters import Filters, restrict
from ambry.plans import sqltext as q
from ambry.plans.registry import maybe_int, query

W = f"WITH {q.ITEMS}"


@query("a1_book_chapter", W + """
SELECT w.work, w.section, w.position, r.chapter, count(DISTINCT r.item_id) AS total
FROM works w JOIN refs r USING (work) GROUP BY ALL""")
def a1_book_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.work_chapters(tables.works(spark, sf_dir), tables.item_refs(spark, sf_dir))


@query("a2_book_totals", W + """
SELECT w.work, w.section, w.position, count(DISTINCT r.item_id) AS total
FROM works w JOIN refs r USING (work) GROUP BY ALL""")
def a2_book_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.work_totals(tables.works(spark, sf_dir), tables.item_refs(spark, sf_dir))


@query("a2_book_tree", W + """,
ch AS (SELECT work, chapter, count(DISTINCT item_id) AS n FROM refs WHERE chapter > 0 GROUP BY ALL),
tot AS (SELECT work, count(DISTINCT item_id) AS total FROM refs GROUP BY ALL)
SELECT w.work, w.section, w.position, t.total, string_agg(c.chapter || ':' || c.n, ' ' ORDER BY c.chapter) AS chapters
FROM works w JOIN tot t USING (work) LEFT JOIN ch c USING (work) GROUP BY ALL""")
def a2_book_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = facets.work_tree(tables.works(spark, sf_dir), tables.item_refs(spark, sf_dir))
    text = F.transform("chapters", lambda c: F.concat_ws(":", c["chapter"].cast("string"), c["total"].cast("string")))
    return tree.withColumn("chapters", F.array_join(text, " "))


@query("a3_left_counts_zero", W + """
SELECT c.c_custkey AS custkey, c.c_name AS name, count(o.o_orderkey) AS total
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL""")
def a3_left_counts_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = tables.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"))
    orders = tables.load(spark, sf_dir, "orders")
    children = orders.select(F.col("o_custkey").alias("custkey"), "o_orderkey")
    return facets.child_counts(parents, children, "custkey", "o_orderkey")


@query("a3_collection_tree", """
SELECT n.n_name AS collection, r.r_name AS parent, count(c.c_custkey) AS total
FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY ALL""")
def a3_collection_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = tables.load(spark, sf_dir, "nation").join(
        tables.load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
    )
    parents = nations.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("collection"), F.col("r_name").alias("parent"))
    children = tables.load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), "c_custkey")
    return facets.child_counts(parents, children, "key", "c_custkey").drop("key")


@query("a4_by_person", """
WITH people AS (
  SELECT CASE o_custkey % 4 WHEN 0 THEN 'Pastor ' WHEN 1 THEN 'Presbítero ' WHEN 2 THEN 'seminárista ' ELSE '' END
         || 'C' || o_custkey AS person FROM orders),
n AS (SELECT person, count(*) AS total FROM people GROUP BY person)
SELECT """ + q.slug("person") + """ AS slug, person,
  CASE WHEN contains(person, ' ') THEN split_part(person, ' ', 1) ELSE 'Outros' END AS honorific,
  CASE WHEN contains(person, ' ') THEN split_part(person, ' ', 2) ELSE person END AS name, total FROM n""")
def a4_by_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_custkey") % 4
    prefix = F.when(kind == 0, "Pastor ").when(kind == 1, "Presbítero ").when(kind == 2, "seminárista ").otherwise("")
    people = tables.load(spark, sf_dir, "orders").select(F.concat(prefix, F.lit("C"), "o_custkey").alias("person"))
    return facets.person_counts(people)


@query("a5_year_month_tree", W + """,
m AS (SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, count(*) AS total FROM items GROUP BY ALL)
SELECT *, CAST(sum(total) OVER (PARTITION BY year) AS BIGINT) AS year_total FROM m""")
def a5_year_month_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.year_month_tree(tables.items(spark, sf_dir))


@query("a6_by_type", W + "SELECT kind, count(*) AS total FROM items WHERE kind IS NOT NULL GROUP BY kind")
def a6_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.kind_counts(tables.items(spark, sf_dir))


@query("a7_topic_groups", W + """,
topics AS (SELECT DISTINCT p_brand || '/' || p_type AS topic, p_brand AS grp FROM part),
labels AS (SELECT item_id, work || '/' || topic AS topic FROM refs)
SELECT t.topic, t.grp AS topic_group, count(l.item_id) AS total FROM topics t LEFT JOIN labels l USING (topic) GROUP BY ALL""")
def a7_topic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("/", "p_brand", "p_type")
    topics = tables.load(spark, sf_dir, "part").select(name.alias("topic"), F.col("p_brand").alias("topic_group")).distinct()
    refs = tables.item_refs(spark, sf_dir)
    labels = refs.select("item_id", F.concat_ws("/", "work", "topic").alias("topic"))
    return facets.child_counts(topics, labels, "topic", "item_id")


CHOSEN = Filters(
    kinds=("1-URGENT", "2-HIGH"), collections=("F",), works=("Brand#1", "Brand#2", "Brand#12"), chapter=3,
    topics=("PROMO", "LARGE"), since="1996-01-01", until="1999-06-30",
)
FLAGS = """
flags AS (
  SELECT i.*, coalesce(i.kind IN ('1-URGENT', '2-HIGH'), false) AS k, coalesce(i.collection IN ('F'), false) AS c,
    EXISTS (SELECT 1 FROM refs r WHERE r.item_id = i.item_id AND r.work IN ('Brand#1', 'Brand#2', 'Brand#12') AND r.chapter = 3) AS w,
    EXISTS (SELECT 1 FROM refs r WHERE r.item_id = i.item_id AND r.topic IN ('PROMO', 'LARGE')) AS t,
    i.date BETWEEN DATE '1996-01-01' AND DATE '1999-06-30' AS d
  FROM items i)"""


def sideways_sql(flags: str) -> str:
    return f"""{W}, {flags},
wk AS (SELECT DISTINCT item_id, work FROM refs), tp AS (SELECT DISTINCT item_id, topic FROM refs)
SELECT 'people' AS dimension, person AS value, count(*) AS total FROM flags WHERE k AND c AND w AND t AND d GROUP BY ALL
UNION ALL SELECT 'kinds', kind, count(*) FROM flags WHERE c AND w AND t AND d AND kind IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'collections', collection, count(*) FROM flags WHERE k AND w AND t AND d AND collection IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'works', work, count(*) FROM flags JOIN wk USING (item_id) WHERE k AND c AND t AND d GROUP BY ALL
UNION ALL SELECT 'topics', topic, count(*) FROM flags JOIN tp USING (item_id) WHERE k AND c AND w AND d GROUP BY ALL
UNION ALL SELECT 'years', CAST(year(date) AS VARCHAR), count(*) FROM flags WHERE k AND c AND w AND t GROUP BY ALL
UNION ALL SELECT 'total', '', count(*) FROM flags WHERE k AND c AND w AND t AND d"""


@query("a9_drill_sideways", sideways_sql(FLAGS))
def a9_drill_sideways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.drill_sideways(tables.items(spark, sf_dir), tables.item_refs(spark, sf_dir), CHOSEN)


@query("a9_counts_unfiltered", sideways_sql("flags AS (SELECT *, true AS k, true AS c, true AS w, true AS t, true AS d FROM items)"))
def a9_counts_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.drill_sideways(tables.items(spark, sf_dir), tables.item_refs(spark, sf_dir), Filters())


@query("f41_facet_options", f"""WITH c AS ({sideways_sql(FLAGS)}),
m AS (SELECT DISTINCT 'works' AS dimension, p_brand AS value, 'Livro ' || regexp_extract(p_brand, '([0-9]+)$', 1) AS label FROM part
      UNION ALL SELECT DISTINCT 'topics', p_type, lower(p_type) FROM part)
SELECT m.*, coalesce(c.total, 0) AS total FROM m LEFT JOIN c USING (dimension, value)""")
def f41_facet_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = tables.works(spark, sf_dir).select(
        F.lit("works").alias("dimension"), F.col("work").alias("value"),
        F.concat(F.lit("Livro "), F.col("position").cast("string")).alias("label"))
    topics = tables.load(spark, sf_dir, "part").select(
        F.lit("topics").alias("dimension"), F.col("p_type").alias("value"), F.lower("p_type").alias("label")).distinct()
    counts = facets.drill_sideways(tables.items(spark, sf_dir), tables.item_refs(spark, sf_dir), CHOSEN)
    return facets.options(works.unionByName(topics), counts)


@query("p4_restrict", f"{W}, {FLAGS} SELECT item_id, CAST(date AS VARCHAR) AS date FROM flags WHERE k AND c AND w AND t AND d")
def p4_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = restrict(tables.items(spark, sf_dir), tables.item_refs(spark, sf_dir), CHOSEN)
    return found.select("item_id", F.col("date").cast("string").alias("date"))


LISTED = Filters(collections=("F",), works=("Brand#1", "Brand#2"), since="1996-01-01")


@query("o4_list_page", f"""{W},
f AS (SELECT * FROM items i WHERE collection IN ('F') AND date >= DATE '1996-01-01'
      AND EXISTS (SELECT 1 FROM refs r WHERE r.item_id = i.item_id AND r.work IN ('Brand#1', 'Brand#2')))
SELECT item_id, CAST(date AS VARCHAR) AS date, person, (SELECT count(*) FROM f) AS total
FROM f ORDER BY f.date DESC, item_id LIMIT 20 OFFSET 20""")
def o4_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = restrict(tables.items(spark, sf_dir), tables.item_refs(spark, sf_dir), LISTED)
    return listing.page(found, number=2).select("item_id", F.col("date").cast("string").alias("date"), "person", "total")


PARTS = "CASE WHEN o_totalprice > 250000 THEN CAST(floor(o_totalprice / 10000) AS INTEGER) END"


@query("o5_course_order", f"""
WITH f AS (SELECT o_orderkey AS item_id, {PARTS} AS part, CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT item_id, CAST(part AS DOUBLE) AS part, CAST(date AS VARCHAR) AS date FROM f ORDER BY f.part ASC NULLS FIRST, f.date, item_id LIMIT 20""")
def o5_course_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.load(spark, sf_dir, "orders")
    part = F.when(F.col("o_totalprice") > 250000, F.floor(F.col("o_totalprice") / 10000).cast("int"))
    items = orders.select(F.col("o_orderkey").alias("item_id"), part.alias("part"), F.col("o_orderdate").cast("date").alias("date"))
    found = listing.page(items, "collection").select("item_id", "part", F.col("date").cast("string").alias("date"))
    return maybe_int(found, "part")


@query("o7_leaf_cap", W + """
SELECT item_id, CAST(date AS VARCHAR) AS date, person FROM items WHERE collection = 'F' ORDER BY items.date DESC, item_id LIMIT 500""")
def o7_leaf_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tables.items(spark, sf_dir).where("collection = 'F'")
    return listing.leaf(items).select("item_id", F.col("date").cast("string").alias("date"), "person")


@query("j7_nested_includes", W + """,
p AS (SELECT item_id, date, person FROM items ORDER BY date DESC, item_id LIMIT 20),
r AS (SELECT DISTINCT item_id, work, position, chapter FROM refs JOIN works USING (work))
SELECT p.item_id, p.person, r.work, r.position, r.chapter FROM p LEFT JOIN r USING (item_id)""")
def j7_nested_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.page(tables.items(spark, sf_dir)).select("item_id", "person")
    return listing.with_references(rows, tables.item_refs(spark, sf_dir), tables.works(spark, sf_dir))


@query("o8_initial_groups", """
SELECT c_name AS name, CASE WHEN count(o_orderkey) = 1 THEN 'Avulsos' ELSE upper(left(c_name, 1)) END AS initial,
  count(o_orderkey) = 1 AS is_last
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(o_orderkey) > 0""")
def o8_initial_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as collections of their orders: many have none, a few have one."""
    orders = tables.load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("total"))
    named = tables.load(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name")).join(orders, "c_custkey", "left")
    return listing.initial_groups(named.select("name", F.coalesce("total", F.lit(0)).alias("total")))


@query("a23_health", f"""WITH {q.CHUNKS}
SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS passages""")
def a23_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ambry.functions.text import count_words

    n = count_words(F.col("text"))
    # the number of windows follows from the word count, so no passage is built
    windows = F.when(n == 0, 0).when(n <= 200, 1).otherwise(1 + F.ceil((n - 200) / 170))
    docs = tables.load(spark, sf_dir, "documents")
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.sum(windows).alias("passages"))
