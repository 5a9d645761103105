"""Registered queries: containment, feeds, merges, labels, integrity, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambry import tables
from ambry.functions.text import slugify
from ambry.operators import integrity, labelling, matching, merging, snapshots
from ambry.operators.quality import liveness_check
from ambry.plans import sqltext as q
from ambry.plans.fuzzy import RAW, raw_names
from ambry.plans.registry import query

CONTAINED = """SELECT b.item_id AS needle_id, min(d.doc_id) AS pos FROM benchmark b
JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY b.item_id"""


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    needles = tables.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    texts = tables.corpus(spark, sf_dir).select(F.col("doc_id").alias("pos"), "text")
    return matching.first_containing(needles, texts)


@query("j11_contains_first_match", CONTAINED)
def j11_contains_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark, sf_dir)


@query("j11_contains_short", """
SELECT n.n_nationkey AS needle_id, min(p.p_partkey) AS pos FROM nation n
JOIN part p ON contains(lower(p.p_name || ' ' || p.p_brand), lower(replace(n.n_name, 'NATION_', '#'))) GROUP BY n.n_nationkey""")
def j11_contains_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needles too short for an anchor: '#7' in 'large gear Brand#17'... and not."""
    needles = tables.load(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("needle_id"), F.replace("n_name", F.lit("NATION_"), F.lit("#")).alias("needle")
    )
    texts = tables.load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), F.concat_ws(" ", "p_name", "p_brand").alias("text")
    )
    return matching.first_containing(needles, texts)


#: the closest entry by the longest common subsequence, its table filled row by row
NEAREST = f"""
WITH RECURSIVE names AS (SELECT DISTINCT lower({RAW}) AS name FROM part),
entries AS (SELECT p_name AS entry, min(p_partkey) AS entry_pos FROM part GROUP BY p_name),
lcs AS (
  SELECT name, entry, entry_pos, 0 AS i, list_transform(range(0, length(entry) + 1), lambda x: 0) AS line FROM names, entries
  UNION ALL
  SELECT name, entry, entry_pos, i + 1, list_transform(range(1, length(entry) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda h:
    greatest(line[h], CASE WHEN h > 1 AND substr(entry, h - 1, 1) = substr(name, i + 1, 1) THEN line[h - 1] + 1 ELSE 0 END))))
  FROM lcs WHERE i < length(name)
),
rated AS (SELECT name, entry, entry_pos, 200.0::double * line[length(entry) + 1] / (length(name) + length(entry)) AS score FROM lcs WHERE i = length(name))
SELECT name, arg_min(entry, (-score, entry_pos)) AS match, max(score) AS score FROM rated WHERE score >= 70 GROUP BY name"""


@query("j13_best_fuzzy_match", NEAREST)
def j13_best_fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text names against the distinct part names, the earliest part first."""
    entries = tables.load(spark, sf_dir, "part").groupBy(F.col("p_name").alias("entry")).agg(F.min("p_partkey").alias("entry_pos"))
    names = raw_names(spark, sf_dir).select(F.lower("name").alias("name"))
    return matching.nearest_names(names, entries)


HREF = 'href="/([^"<\\s]+)"'
FEED = f"""
links AS (SELECT page_id AS feed, unnest(regexp_extract_all(html, '{HREF}', 1)) AS slug,
            generate_subscripts(regexp_extract_all(html, '{HREF}', 1), 1) - 1 AS nth FROM pages),
slugs AS (SELECT slug, arg_min(struct_pack(feed := feed, nth := nth), struct_pack(feed := feed, nth := nth)) AS p FROM links WHERE slug <> '' GROUP BY slug)"""


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = tables.load(spark, sf_dir, "pages").select(F.col("page_id").alias("feed"), F.col("html").alias("body"))
    return matching.feed_slugs(feeds, HREF)


@query("s11_feed_slugs", f"WITH {FEED} SELECT slug, p.feed AS feed, CAST(p.nth AS INTEGER) AS nth FROM slugs")
def s11_feed_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slugs(spark, sf_dir)


LIVE = FEED + """,
said AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]')) AS slug FROM documents),
live AS (SELECT doc_id AS id, source AS episode, doc_id IN (SELECT doc_id FROM said JOIN slugs USING (slug)) AS alive
         FROM documents WHERE source <> 'src3')"""


def live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = tables.load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("source") != "src3", F.col("source")).alias("episode"),
        F.explode_outer(F.array_distinct(F.split("text", "[ \n]"))).alias("slug"),  # a link may stand anywhere in a text
    )
    return matching.liveness(records, slugs(spark, sf_dir))


@query("j15_liveness", f"WITH {LIVE} SELECT * FROM live")
def j15_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_rows(spark, sf_dir)


@query("a13_dead_fraction", f"""WITH {LIVE},
s AS (SELECT (SELECT avg(CASE WHEN quality = 1 THEN 0.0::double ELSE 1.0::double END) FROM labels) AS before,
             (SELECT avg(CASE WHEN alive THEN 0.0::double ELSE 1.0::double END) FROM live) AS after)
SELECT round(before, 9) AS before, round(after, 9) AS after, after - before > 0.15 AS refused FROM s""")
def a13_dead_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    previous = tables.load(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("alive"))
    return liveness_check(previous, live_rows(spark, sf_dir))


# Four looks at a feed of the newest 500 entries, some of which are missing from one look or another.
SNAPSHOTS = """
looks AS (SELECT unnest(range(0, 4)) AS snapshot, (SELECT max(l_orderkey) + 1 FROM lineitem) AS n),
shown AS (SELECT DISTINCT snapshot, l_orderkey AS slug, n - l_orderkey AS place FROM lineitem, looks
          WHERE l_orderkey <= n - 600 + 150 * snapshot AND (l_orderkey * 7 + snapshot * 3) % 11 <> 0),
snaps AS (SELECT * FROM shown QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY place) <= 500)"""


def feed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slug")).distinct()
    n = orders.agg((F.max("slug") + 1)).scalar()
    looks = [
        orders.withColumn("n", n).where((F.col("slug") <= F.col("n") - 600 + 150 * k) & ((F.col("slug") * 7 + 3 * k) % 11 != 0))
        .orderBy(F.desc("slug")).limit(snapshots.WINDOW).select(F.lit(k).alias("snapshot"), "slug", (F.col("n") - F.col("slug")).alias("place"))
        for k in range(4)
    ]
    return reduce(DataFrame.unionByName, looks)


@query("t2_rolling_liveness", f"""WITH {SNAPSHOTS},
firsts AS (SELECT slug, min(snapshot) AS first FROM snaps GROUP BY slug),
edges AS (SELECT snapshot, max(place) AS oldest FROM snaps GROUP BY snapshot),
came AS (SELECT s.snapshot, s.slug, CASE WHEN first < s.snapshot THEN 'back' ELSE 'new' END AS change FROM snaps s JOIN firsts USING (slug)
         WHERE NOT EXISTS (SELECT 1 FROM snaps p WHERE p.slug = s.slug AND p.snapshot = s.snapshot - 1)),
went AS (SELECT p.snapshot + 1 AS snapshot, p.slug, CASE WHEN p.place > oldest THEN 'aged' ELSE 'died' END AS change
         FROM snaps p JOIN edges e ON e.snapshot = p.snapshot + 1
         WHERE NOT EXISTS (SELECT 1 FROM snaps s WHERE s.slug = p.slug AND s.snapshot = p.snapshot + 1))
SELECT CAST(snapshot AS INTEGER) AS snapshot, slug, change FROM came UNION ALL SELECT CAST(snapshot AS INTEGER), slug, change FROM went""")
def t2_rolling_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came, came back, aged out or died between four looks at a feed of the newest 500."""
    return snapshots.changes(feed_snapshots(spark, sf_dir))


POINTERS = "CASE WHEN c_nationkey % 2 = 0 THEN c_custkey - c_nationkey WHEN c_nationkey = 7 THEN c_custkey + 1 END"


def pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, key = F.col("c_nationkey"), F.col("c_custkey")
    target = F.when(nation % 2 == 0, key - nation).when(nation == 7, key + 1)
    return tables.load(spark, sf_dir, "customer").select(key.alias("id"), target.alias("merge_into"), nation.alias("nation"))


ROOTS = f"""
p AS (SELECT c_custkey AS id, {POINTERS} AS m FROM customer),
step AS (SELECT p.id, coalesce(t.id, p.id) AS nxt FROM p LEFT JOIN p t ON t.id = p.m),
hop AS (SELECT id, nxt AS root, 1 AS n FROM step UNION ALL SELECT h.id, s.nxt, n + 1 FROM hop h JOIN step s ON s.id = h.root WHERE n < 9),
roots AS (SELECT id, root FROM hop WHERE n = 9)"""


@query("c2_merge_chain", f"WITH RECURSIVE {ROOTS} SELECT id, root FROM roots")
def c2_merge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.follow(pointers(spark, sf_dir))


PLACED = f"""WITH RECURSIVE {ROOTS},
c AS (SELECT c.c_custkey AS id, 'Curso ' || c.c_nationkey AS head, CAST(c.c_custkey % 5 + 1 AS BIGINT) AS count, r.root, d.c_nationkey AS rn
      FROM customer c JOIN roots r ON r.id = c.c_custkey JOIN customer d ON d.c_custkey = r.root),
named AS (SELECT id, head, count, CASE WHEN rn = 3 THEN 'Curso ' || rn WHEN rn = 5 THEN 'CFW ' || rn ELSE 'O Curso ' || rn END AS name,
            CASE WHEN rn % 3 = 1 THEN 'Curso ' || (rn + 1) END AS parent FROM c),
s AS (SELECT {q.slug('name')} AS slug, * FROM named)"""


@query("c2_collections", PLACED + f""",
rows AS (SELECT slug, arg_min(struct_pack(name := name, head := head, parent := parent, id := id), id) AS r, CAST(sum(count) AS BIGINT) AS total FROM s GROUP BY slug),
keyed AS (SELECT *, regexp_replace(slug, '^(a|o|as|os)-', '') AS key FROM rows),
targets AS (SELECT key, arg_max(slug, r.id) AS target FROM keyed GROUP BY key),
linked AS (SELECT k.slug, k.r, k.total, CASE WHEN k.r.parent IS NULL THEN NULL WHEN t.target IS NOT NULL AND t.target <> k.slug THEN t.target
             ELSE {q.slug('k.r.parent')} END AS parent_slug
           FROM keyed k LEFT JOIN targets t ON t.key = regexp_replace({q.slug('k.r.parent')}, '^(a|o|as|os)-', ''))
SELECT slug, r.name AS name, CASE WHEN slug IN (SELECT parent_slug FROM linked WHERE parent_slug IS NOT NULL) OR r.name LIKE 'CFW%' THEN 'cfw' ELSE 'ebd' END AS kind,
  parent_slug, '' AS description, total FROM linked""")
def c2_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.build_collections(*clusters_and_decisions(spark, sf_dir))


@query("c2_variants", PLACED + """,
m AS (SELECT id, 0 AS place, head AS name, slug FROM s UNION ALL SELECT id, 1, c_name, slug FROM s JOIN customer ON c_custkey = id)
SELECT slug, md5(string_agg(name, '|' ORDER BY id, place)) AS variants_md5, count(*) AS names FROM m GROUP BY slug""")
def c2_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names behind each collection: a cluster's head and its customer."""
    clusters, decisions = clusters_and_decisions(spark, sf_dir)
    names = tables.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("place"), F.col("c_name").alias("name"))
    members = clusters.select("id", F.lit(0).alias("place"), F.col("head").alias("name")).unionByName(names)
    return merging.collection_variants(clusters, decisions, members).select(
        "slug", F.md5("variants").alias("variants_md5"), F.size(F.split("variants", "[|]")).cast("long").alias("names")
    )


def clusters_and_decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("nation").cast("string")
    rows = pointers(spark, sf_dir)
    clusters = rows.select("id", F.concat(F.lit("Curso "), n).alias("head"), (F.col("id") % 5 + 1).alias("count"))
    name = F.when(F.col("nation") == 3, "").when(F.col("nation") == 5, F.concat(F.lit("CFW "), n)).otherwise(F.concat(F.lit("O Curso "), n))
    parent = F.when(F.col("nation") % 3 == 1, F.concat(F.lit("Curso "), (F.col("nation") + 1).cast("string")))
    return clusters, rows.select("id", name.alias("name"), F.lit("").alias("description"), parent.alias("parent"), "merge_into")


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as collections, spelt three ways, some claimed twice."""
    nation = tables.load(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    number = lambda c: c.cast("string")
    return nation.select(
        key.alias("pos"), slugify(F.col("n_name")).alias("slug"),
        F.concat_ws("|", F.concat(F.lit("País "), number(key)), F.concat(F.lit(" Terra "), number(F.floor(key / 2))), F.lit("")).alias("variants"),
        F.when(key % 4 == 0, F.concat(F.lit("nation-"), number(key + 3))).otherwise("").alias("parent_slug"),
    )


VARIANTS = f"""
cols AS (SELECT n_nationkey AS pos, {q.slug('n_name')} AS slug FROM nation),
claims AS (SELECT pos, 0 AS nth, slug AS variant_slug, slug FROM cols
  UNION ALL SELECT pos, 1, 'pais-' || pos, slug FROM cols UNION ALL SELECT pos, 2, 'terra-' || (pos // 2), slug FROM cols),
variants AS (SELECT variant_slug, arg_max(slug, struct_pack(pos := pos, nth := nth)) AS slug FROM claims GROUP BY variant_slug)"""


@query("c3_variant_index", f"WITH {VARIANTS} SELECT * FROM variants")
def c3_variant_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.variant_index(collections(spark, sf_dir))


@query("j14_resolve_collection", f"""WITH {VARIANTS}
SELECT c_custkey AS custkey, v.slug AS collection FROM customer
LEFT JOIN variants v ON v.variant_slug = CASE WHEN c_custkey % 3 = 0 THEN 'pais-' ELSE 'terra-' END || c_nationkey""")
def j14_resolve_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.when(F.col("c_custkey") % 3 == 0, " pais-").otherwise(" terra-")
    items = tables.load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), F.concat(prefix, F.col("c_nationkey").cast("string")).alias("raw_slug")
    )
    return merging.resolve_collection(items, merging.variant_index(collections(spark, sf_dir))).select("custkey", "collection")


@query("j9_retired_slugs", """
SELECT 'c' || c_custkey AS slug FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def j9_retired_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("c"), F.col(c)).alias("slug")
    urgent = tables.load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return merging.retired(tables.load(spark, sf_dir, "customer").select(name("c_custkey")), urgent.select(name("o_custkey")))


CONFIGS = ["A", "N", "R"]
LABELS = "labels3 AS (SELECT DISTINCT l_orderkey AS doc_id, l_returnflag AS config, p_type AS topic FROM lineitem JOIN part ON p_partkey = l_partkey)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tables.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("topic"))
    lines = tables.load(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("config"))
    return lines.join(parts, "l_partkey").select("doc_id", "config", "topic")


@query("u4_jaccard", f"""WITH {LABELS},
u AS (SELECT doc_id, topic, bool_or(config = 'A') AS a, bool_or(config = 'N') AS b FROM labels3 WHERE config IN ('A', 'N') GROUP BY ALL),
s AS (SELECT doc_id, count(*) FILTER (a AND b) AS shared, count(*) AS either FROM u GROUP BY doc_id)
SELECT doc_id, shared, either, round(shared / either, 9) AS jaccard, shared = either AS same FROM s""")
def u4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelling.set_overlap(labelled(spark, sf_dir), "A", "N")


@query("u5_divergent", f"""WITH {LABELS},
sets AS (SELECT doc_id, list_sort(list(topic) FILTER (config = 'A')) AS a, list_sort(list(topic) FILTER (config = 'N')) AS n,
           list_sort(list(topic) FILTER (config = 'R')) AS r FROM labels3 GROUP BY doc_id)
SELECT doc_id FROM sets WHERE a IS DISTINCT FROM n OR a IS DISTINCT FROM r""")
def u5_divergent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelling.divergent(labelled(spark, sf_dir), CONFIGS)


@query("a18_agreement", f"""WITH {LABELS}, cfg AS (SELECT unnest(['N', 'R']) AS config),
u AS (SELECT c.config AS cfg, l.doc_id, l.topic, bool_or(l.config = 'A') AS a, bool_or(l.config = c.config) AS b
      FROM cfg c JOIN labels3 l ON l.config IN ('A', c.config) GROUP BY ALL),
s AS (SELECT cfg, doc_id, count(*) FILTER (a AND b) AS shared, count(*) AS either FROM u GROUP BY ALL),
d AS (SELECT o_orderkey, c.config AS cfg, coalesce(s.shared = s.either, true) AS same, coalesce(round(s.shared / s.either, 9), 1) AS j
      FROM orders JOIN cfg c ON true LEFT JOIN s ON s.cfg = c.config AND s.doc_id = o_orderkey)
SELECT cfg AS config, count(*) FILTER (same) AS exact, round(avg(j), 6) AS jaccard, count(*) AS total FROM d GROUP BY cfg""")
def a18_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return labelling.agreement(docs, labelled(spark, sf_dir), "A", CONFIGS)


@query("f29_label_rows", """
WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber * 100000 + l_partkey AS pos, p_brand AS topic, l_discount * 12 - 0.1 AS c
           FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand <> 'Brand#7'),
f AS (SELECT doc_id, topic, min(pos) AS pos, min(struct_pack(pos := pos, c := c)).c AS c FROM l GROUP BY ALL)
SELECT doc_id, topic, round(greatest(0, least(1, c)), 9) AS confidence FROM f
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos, topic) <= 4""")
def f29_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tables.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("topic"))
    lines = tables.load(spark, sf_dir, "lineitem").join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("pos"),
        "topic", (F.col("l_discount") * 12 - 0.1).alias("confidence"),
    )
    known = parts.where("topic <> 'Brand#7'").select("topic")
    return labelling.label_rows(lines, known).withColumn("confidence", F.round("confidence", 9))


@query("f30_taxonomy_rows", f"""
WITH RECURSIVE p AS (SELECT p_partkey AS pos, p_brand AS grp,
    p_type || CASE p_size % 5 WHEN 0 THEN '!' WHEN 1 THEN ' 2' WHEN 2 THEN '-2-2' ELSE '' END AS topic FROM part),
d AS (SELECT grp, topic, min(pos) AS pos, {q.slug('topic')} AS base FROM p GROUP BY ALL),
n AS (SELECT *, row_number() OVER (ORDER BY pos) AS nth, count(*) OVER (PARTITION BY base) AS same FROM d),
taken AS (
  SELECT 0::BIGINT AS nth, []::VARCHAR[] AS used, '' AS slug
  UNION ALL
  SELECT nth, list_append(used, slug), slug FROM (SELECT n.nth, used, list_filter(
      list_transform(range(1, length(used) + 2), lambda k: CASE WHEN k = 1 THEN base ELSE base || '-' || k END),
      lambda s: NOT list_contains(used, s))[1] AS slug FROM taken JOIN n ON n.nth = taken.nth + 1)
)
SELECT pos, {q.slug('grp')} AS group_slug, grp AS group_name, slug AS topic_slug, topic AS topic_name FROM n JOIN taken USING (nth)""")
def f30_taxonomy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of several groups, some of which end in the number that another one's slug would get."""
    size = F.col("p_size") % 5
    mark = F.when(size == 0, "! ").when(size == 1, " 2").when(size == 2, "-2-2").otherwise("")
    return labelling.taxonomy_rows(tables.load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"), F.col("p_brand").alias("group"), F.concat(F.lit(" "), "p_type", mark).alias("topic")
    ))


@query("a19_label_report", """
WITH l AS (SELECT p_type AS topic FROM lineitem JOIN part ON p_partkey = l_partkey),
k AS (SELECT DISTINCT p_type AS topic FROM part UNION SELECT r_name FROM region), c AS (SELECT topic, count(*) AS total FROM l GROUP BY topic)
SELECT topic, coalesce(total, 0) AS total, round(coalesce(total, 0) / (SELECT count(*) FROM orders), 9) AS share FROM k LEFT JOIN c USING (topic)""")
def a19_label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label; the names of regions are topics that nothing was given."""
    known = tables.load(spark, sf_dir, "part").select(F.col("p_type").alias("topic")).unionByName(
        tables.load(spark, sf_dir, "region").select(F.col("r_name").alias("topic"))
    )
    return labelling.label_report(tables.load(spark, sf_dir, "orders"), labelled(spark, sf_dir), known)


@query("a16_name_examples", """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders)
SELECT o_custkey, total, o_orderkey AS example, CAST(nth AS INTEGER) AS nth FROM r WHERE nth <= 3""")
def a16_name_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("ex"), F.col("o_orderkey").alias("at"))
    return labelling.name_examples(orders, "o_custkey", "ex", "at")


INTEGRITY = f"""
docs AS (SELECT o_orderkey AS doc_id FROM orders WHERE o_totalprice >= 10000),
facets AS (SELECT o_orderkey AS doc_id, 'pais-' || (o_custkey % 30) AS raw_slug FROM orders WHERE o_orderstatus <> 'P'
           UNION ALL SELECT o_orderkey, '' FROM orders WHERE o_orderpriority = '5-LOW'),
refs AS (SELECT l_orderkey AS doc_id, p_brand AS work, l_linenumber - 1 AS chapter FROM lineitem JOIN part ON p_partkey = l_partkey),
works AS (SELECT DISTINCT p_brand AS work, 5 AS chapters FROM part WHERE p_brand <> 'Brand#9'),
cols2 AS (SELECT n_nationkey AS pos, {q.slug('n_name')} AS slug, CASE WHEN n_nationkey % 4 = 0 THEN 'nation-' || (n_nationkey + 3) ELSE '' END AS parent_slug FROM nation),
problems AS (
  SELECT 'error' AS severity, 'parent collection does not exist' AS rule, slug AS key FROM cols2 WHERE parent_slug <> '' AND parent_slug <> slug AND parent_slug NOT IN (SELECT slug FROM cols2)
  UNION ALL SELECT 'error', 'collection is its own parent', slug FROM cols2 WHERE slug = parent_slug
  UNION ALL SELECT 'error', 'facets of an unknown document', CAST(doc_id AS VARCHAR) FROM facets WHERE doc_id NOT IN (SELECT doc_id FROM docs)
  UNION ALL SELECT 'error', 'document has facets twice', CAST(doc_id AS VARCHAR) FROM facets GROUP BY doc_id HAVING count(*) > 1
  UNION ALL SELECT 'error', 'document without facets', CAST(doc_id AS VARCHAR) FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM facets)
  UNION ALL SELECT 'error', 'reference of an unknown document', CAST(doc_id AS VARCHAR) FROM refs WHERE doc_id NOT IN (SELECT doc_id FROM docs)
  UNION ALL SELECT DISTINCT 'error', 'unknown work', work FROM refs WHERE work NOT IN (SELECT work FROM works)
  UNION ALL SELECT 'error', 'chapter outside its work', doc_id || '|' || work || '|' || chapter FROM refs JOIN works USING (work) WHERE chapter > chapters
  UNION ALL SELECT 'error', 'reference given twice', doc_id || '|' || work || '|' || chapter FROM refs GROUP BY doc_id, work, chapter HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'warning', 'collection not known yet', raw_slug FROM facets WHERE raw_slug <> '' AND raw_slug NOT IN (SELECT variant_slug FROM variants)
  UNION ALL SELECT 'error', 'number of works', CAST(count(*) AS VARCHAR) FROM works HAVING count(*) <> 66)"""


def found_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.load(spark, sf_dir, "orders")
    key = F.col("o_orderkey").alias("doc_id")
    slug = F.concat(F.lit("pais-"), F.col("o_custkey") % 30)
    facets = orders.where("o_orderstatus <> 'P'").select(key, slug.alias("raw_slug")).unionByName(
        orders.where("o_orderpriority = '5-LOW'").select(key, F.lit("").alias("raw_slug"))
    )
    refs = tables.item_refs(spark, sf_dir).select(F.col("item_id").alias("doc_id"), "work", "chapter")
    works = tables.works(spark, sf_dir).where("work <> 'Brand#9'").select("work", F.lit(5).alias("chapters"))
    cols = collections(spark, sf_dir)
    # the cheapest orders play documents that were removed from the corpus
    docs = orders.where("o_totalprice >= 10000").select(key)
    return integrity.problems(docs, facets, refs, works, cols, merging.variant_index(cols), expected_works=66)


@query("c5_integrity", f"WITH {VARIANTS}, {INTEGRITY} SELECT * FROM problems")
def c5_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_problems(spark, sf_dir)


@query("c6_verdict", f"""WITH {VARIANTS}, {INTEGRITY}
SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, 1 AS exit_code FROM problems""")
def c6_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.verdict(found_problems(spark, sf_dir))


@query("a21_newest", """
SELECT o_orderkey AS item_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1""")
def a21_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = integrity.newest(tables.items(spark, sf_dir).select("item_id", "date"), "date", "item_id")
    return found.select("item_id", F.col("date").cast("string").alias("date"))
