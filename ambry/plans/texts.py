"""Registered queries: scalar text functions over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambry import tables
from ambry.functions import names as N
from ambry.functions import paragraphs as P
from ambry.functions import snippets as S
from ambry.functions import text as T
from ambry.functions import values as V
from ambry.functions.cleaning import clean_texts
from ambry.operators import index
from ambry.operators.listing import number_aware
from ambry.plans import sqltext as q
from ambry.plans.registry import query

WORDS = "laaion tionré heron queoi"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.corpus(spark, sf_dir)


@query("f1_slugify", f"SELECT doc_id, md5({q.slug('text')}) AS slug_md5 FROM documents")
def f1_slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slug of every whole text, as a digest."""
    return docs(spark, sf_dir).select("doc_id", F.md5(T.slugify(F.col("text"))).alias("slug_md5"))


@query("f2_fold", f"SELECT doc_id, md5({q.squeeze(q.fold('text'))}) AS folded_md5 FROM documents")
def f2_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.fold_squeeze(F.col("text"))).alias("folded_md5"))


@query("f14_strip_date", """
WITH t AS (SELECT o_orderkey AS item_id, strftime(o_orderdate, '%d-%m-%Y') || ' - Aula ' || o_orderpriority AS title FROM orders)
SELECT item_id, regexp_replace(title, '^[0-9]{2}-[0-9]{2}-[0-9]{4} - ', '') || ' — C' AS shown FROM t""")
def f14_strip_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit(" - Aula "), "o_orderpriority")
    rows = tables.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), title.alias("title"))
    return rows.select("item_id", V.display_title(F.col("title"), F.lit("C")).alias("shown"))


@query("f16_short_date", """
WITH m AS (SELECT ['jan','fev','mar','abr','mai','jun','jul','ago','set','out','nov','dez'] AS m)
SELECT o_orderkey AS item_id, strftime(o_orderdate, '%d') || ' ' || m[month(o_orderdate)] || ' ' || year(o_orderdate) AS shown FROM orders, m""")
def f16_short_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = tables.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), iso.alias("iso"))
    return rows.select("item_id", V.short_date(F.col("iso")).alias("shown"))


@query("f18_date_from_texts", """
WITH o AS (SELECT o_orderkey AS item_id, o_orderdate + INTERVAL 21 YEAR AS d, o_orderkey % 4 AS k FROM orders)
SELECT item_id, CAST(CASE WHEN k IN (0, 1) AND year(d) BETWEEN 2015 AND 2030 THEN CAST(d AS DATE)
  ELSE CAST(to_timestamp(1600000000 + item_id * 86400) AT TIME ZONE 'UTC' AS DATE) END AS VARCHAR) AS date FROM o""")
def f18_date_from_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in titles, on labelled lines, with a digit too many, and not at all."""
    later = F.expr("o_orderdate + INTERVAL 21 YEARS")
    k = F.col("o_orderkey") % 4
    dmy = F.date_format(later, "dd-MM-yyyy")
    title = F.when(k == 0, F.concat(dmy, F.lit(" - Tema"))).when(k == 2, F.concat(dmy, F.lit("5 - Tema"))).otherwise("Tema 3")
    text = F.when(k == 1, F.concat(F.lit("Livro: X\nData: "), F.date_format(later, "dd/MM/yyyy"), F.lit(" \nfim"))).otherwise(
        F.concat(F.lit("em "), dmy))
    rows = tables.load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), title.alias("title"), text.alias("description"),
        (1600000000 + F.col("o_orderkey") * 86400).alias("epoch"),
    )
    found = V.date_from_texts(F.col("title"), F.col("description"), F.col("epoch"))
    return rows.select("item_id", V.day_text(found).alias("date"))


@query("f28_lenient_key", f"""
SELECT DISTINCT p_name AS name, regexp_replace({q.slug("CASE WHEN p_size % 2 = 0 THEN 'Os ' ELSE 'Asa ' END || p_name")}, '^(a|o|as|os)-', '') AS key,
  CASE WHEN p_size % 3 = 0 THEN 'conferencia' WHEN p_size % 3 = 1 THEN 'cfw' ELSE 'ebd' END AS kind FROM part""")
def f28_lenient_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    article = F.when(size % 2 == 0, "Os ").otherwise("Asa ")
    label = F.when(size % 3 == 0, "IV Conferência X").when(size % 3 == 1, "cfw 12").otherwise("Diaconia e mais")
    return tables.load(spark, sf_dir, "part").select(
        F.col("p_name").alias("name"), N.lenient_key(F.concat(article, "p_name")).alias("key"),
        N.collection_kind(label).alias("kind"),
    ).distinct()


@query("f31_url_clean", """
WITH s AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN ' //chan/' WHEN page_id % 3 = 1 THEN 'chan/' ELSE '' END
             || regexp_replace(url, '^https?://[^/]*/', '') AS suffix, page_id % 2 = 0 AS alive FROM pages),
c AS (SELECT page_id, alive, nullif(regexp_replace(regexp_replace(trim(suffix), '^/+', ''), '^chan/', ''), '') AS bare FROM s)
SELECT page_id, 'https://audio.example/chan/' || bare AS audio, CASE WHEN alive THEN 'https://pod.example/' || bare END AS episode FROM c""")
def f31_url_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    prefix = F.when(k == 0, " //chan/").when(k == 1, "chan/").otherwise("")
    suffix = F.concat(prefix, F.regexp_replace("url", "^https?://[^/]*/", ""))
    rows = tables.load(spark, sf_dir, "pages").select("page_id", suffix.alias("suffix"))
    return rows.select(
        "page_id", V.audio_url(F.col("suffix"), "chan", "https://audio.example").alias("audio"),
        V.episode_url(F.col("suffix"), F.col("page_id") % 2 == 0, "chan", "https://pod.example").alias("episode"),
    )


FLAT = q.squeeze("text")


@query("f36_summarise", f"""
WITH f AS (SELECT doc_id, {FLAT} AS flat FROM documents),
c AS (SELECT doc_id, flat, left(flat, 160) AS cut, length(left(flat, 160)) - strpos(reverse(left(flat, 160)), ' ') AS last,
        strpos(left(flat, 160), ' ') > 0 AS has FROM f)
SELECT doc_id, CASE WHEN length(flat) <= 160 THEN flat
  ELSE regexp_replace(CASE WHEN has AND last > 80 THEN left(cut, last) ELSE cut END, '[\\s.,;:—–-]+$', '') || '…' END AS summary FROM c""")
def f36_summarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.summarise(F.col("text")).alias("summary"))


@query("f36_escape", """
SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS html_md5,
  md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS xml_md5 FROM pages""")
def f36_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "pages").select(
        "page_id", F.md5(T.escape_html(F.col("html"))).alias("html_md5"), F.md5(T.escape_xml(F.col("html"))).alias("xml_md5")
    )


@query("f37_url_segment", "SELECT DISTINCT p_name || ' é/' || p_brand AS name, url_encode(p_name || ' é/' || p_brand) AS encoded FROM part")
def f37_url_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" é/"), "p_brand")
    return tables.load(spark, sf_dir, "part").select(name.alias("name"), T.url_segment(name).alias("encoded")).distinct()


@query("f43_reading_time", f"""
SELECT doc_id, CAST(len({q.words('text')}) AS INTEGER) AS words,
  CAST(greatest(1, floor(len({q.words('text')}) / 200.0 + 0.5)) AS INTEGER) AS minutes FROM documents""")
def f43_reading_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = docs(spark, sf_dir).select("doc_id", T.count_words(F.col("text")).alias("words"))
    return counted.select("doc_id", "words", T.reading_minutes(F.col("words")).alias("minutes"))


@query("o8_number_aware", """
SELECT DISTINCT p_brand AS name, CAST(dense_rank() OVER (ORDER BY CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER)) AS BIGINT) AS place FROM part""")
def o8_number_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the order their numbers have; placed by counting smaller keys."""
    from ambry.operators.ordering import with_position

    names = tables.load(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    keyed = names.withColumn("key", number_aware(F.col("name")))
    return with_position(keyed, "key", "name").select("name", (F.col("position") + 1).alias("place"))


@query("o12_opening", f"SELECT doc_id, md5(array_to_string(({q.words('text')})[1:250], ' ')) AS opening_md5 FROM documents")
def o12_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.opening_words(F.col("text"), 250)).alias("opening_md5"))


@query("r24_sample", f"""
WITH w AS (SELECT doc_id, {q.words('text')} AS w FROM documents), m AS (SELECT *, CAST(floor((len(w) - 150) / 2.0) AS BIGINT) AS mid FROM w)
SELECT doc_id, md5(CASE WHEN len(w) <= 380 THEN array_to_string(w, ' ')
  ELSE array_to_string(w[1:150], ' ') || chr(10) || '[…]' || chr(10) || array_to_string(w[mid + 1 : mid + 150], ' ')
    || chr(10) || '[…]' || chr(10) || array_to_string(w[len(w) - 79 : len(w)], ' ') END) AS sample_md5 FROM m""")
def r24_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = docs(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("w"))
    return split.select("doc_id", F.md5(T.sample_text(F.col("w"), 150, 150, 80)).alias("sample_md5"))


ALT = "laaion|tionre|heron|queoi"


@query("r20_highlight", f"""
WITH d AS (SELECT doc_id, text, {q.fold('text')} AS f FROM documents)
SELECT doc_id, md5(regexp_replace(text, '(^|[^\\p{{L}}\\p{{N}}])((?i:l[aàáâäã][aàáâäã]i[oòóôöõ]n|t[iíï][oòóôöõ]nr[eèéêë]|h[eèéêë]r[oòóôöõ][nñ]|q[uùúü][eèéêë][oòóôöõ][iíï]))', '\\1<mark>\\2</mark>', 'g')) AS marked_md5
FROM d""")
def r20_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(S.highlight(F.col("text"), WORDS)).alias("marked_md5"))


@query("r21_snippet", f"""
WITH d AS (SELECT doc_id, text AS t, {q.fold('text')} AS f, length(text) AS n FROM documents),
h AS (SELECT *, CASE WHEN regexp_matches(f, '(^|[^\\p{{L}}\\p{{N}}])({ALT})')
        THEN length(regexp_extract(f, '(?s)^(.*?(?:^|[^\\p{{L}}\\p{{N}}]))(?:{ALT})', 1)) ELSE -1 END AS pos FROM d),
b AS (SELECT *, greatest(0, pos - 70) AS s0, least(n, pos + 300) AS e0 FROM h),
c AS (SELECT *, CASE WHEN strpos(substr(t, s0 + 1), ' ') > 0 THEN s0 + strpos(substr(t, s0 + 1), ' ') - 1 ELSE -1 END AS sp,
        CASE WHEN strpos(left(t, e0 + 1), ' ') > 0 THEN length(left(t, e0 + 1)) - strpos(reverse(left(t, e0 + 1)), ' ') ELSE -1 END AS ls FROM b),
e AS (SELECT *, CASE WHEN s0 > 0 AND sp >= 0 AND sp < pos THEN sp + 1 ELSE s0 END AS s1, CASE WHEN e0 < n AND ls > pos THEN ls ELSE e0 END AS e1 FROM c)
SELECT doc_id, CAST(pos AS INTEGER) AS first_hit, CASE WHEN n <= 370 OR pos < 0 THEN md5(t)
  ELSE md5(CASE WHEN s1 > 0 THEN '…' ELSE '' END || substr(t, s1 + 1, e1 - s1) || CASE WHEN e1 < n THEN '…' ELSE '' END) END AS snippet_md5 FROM e""")
def r21_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = docs(spark, sf_dir).select("doc_id", "text", S.first_hit(F.col("text"), WORDS).alias("first_hit"))
    return hit.select("doc_id", "first_hit", F.md5(S.snippet(F.col("text"), F.col("first_hit"))).alias("snippet_md5"))


PARAGRAPHS = f"""
t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?…]["''”’)\\]]?)\\s+', '\\1' || chr(1), 'g') AS body FROM documents),
s0 AS (SELECT doc_id, list_filter(list_transform(string_split(body, chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS ss FROM t),
s AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS i FROM s0),
sw AS (SELECT *, len({q.words('sentence')}) AS n FROM s),
pack AS (
  SELECT doc_id, i, 0 AS para, n AS total FROM sw WHERE i = 1
  UNION ALL
  SELECT sw.doc_id, sw.i, CASE WHEN p.total >= 100 THEN p.para + 1 ELSE p.para END, CASE WHEN p.total >= 100 THEN sw.n ELSE p.total + sw.n END
  FROM pack p JOIN sw ON sw.doc_id = p.doc_id AND sw.i = p.i + 1),
paras AS (SELECT doc_id, para, string_agg(sentence, ' ' ORDER BY i) AS body, CAST(sum(n) AS BIGINT) AS words FROM pack JOIN sw USING (doc_id, i) GROUP BY ALL)"""


JOINTS = "([,;])\\s+((?:ou|e|mas|portanto|porém|entretanto|assim|pois|logo)(?:[^\\p{L}\\p{N}]|$))"
BROKEN = f"regexp_replace(regexp_replace(s, '{JOINTS}', chr(1) || '\\2', 'g'), '{JOINTS}', chr(1) || '\\2', 'g')"


def _count_sentences(expr: str) -> str:
    marked = f"regexp_replace({expr}, '([.!?…][\"''”’)\\]]?)\\s+', '\\1' || chr(1), 'g')"
    return f"len(list_filter(string_split({marked}, chr(1)), lambda s: trim(s) <> ''))"


@query("f35_clean_metrics", f"""WITH RECURSIVE {PARAGRAPHS},
c AS (SELECT doc_id, len(ss) AS before, array_to_string(list_transform(ss, lambda s: CASE WHEN len({q.words('s')}) <= 35 THEN upper(left(s, 1)) || substr(s, 2)
  ELSE array_to_string(list_transform(string_split({BROKEN}, chr(1)), lambda p: upper(left(p, 1)) || substr(p, 2)), '. ') END), ' ') AS x FROM s0)
SELECT doc_id, md5(x) AS cleaned_md5, CAST(len({q.words('x')}) AS INTEGER) AS words, CAST(before AS INTEGER) AS sentences_before,
  CAST({_count_sentences('x')} AS INTEGER) AS sentences, round(CASE WHEN before > 0 THEN {_count_sentences('x')} / before ELSE 0 END, 9) AS sentence_ratio FROM c""")
def f35_clean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_texts(docs(spark, sf_dir)).select(
        "doc_id", F.md5("cleaned").alias("cleaned_md5"), "words", "sentences_before", "sentences",
        F.round("sentence_ratio", 9).alias("sentence_ratio"),
    )


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = docs(spark, sf_dir).select("doc_id", "text", P.sentences(F.col("text")).alias("ss"))
    return split.select("doc_id", "text", P.paragraphs(F.col("ss")).alias("ps"))


@query("r22_paragraphs", f"WITH RECURSIVE {PARAGRAPHS} SELECT doc_id, CAST(para AS INTEGER) AS para, md5(body) AS body_md5 FROM paras")
def r22_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packed(spark, sf_dir).select("doc_id", F.posexplode("ps").alias("para", "body"))
    return rows.select("doc_id", "para", F.md5("body").alias("body_md5"))


@query("r23_paragraph_at", f"""WITH RECURSIVE {q.CHUNKS}, {PARAGRAPHS},
cum AS (SELECT doc_id, para, sum(words) OVER (PARTITION BY doc_id ORDER BY para) AS seen FROM paras)
SELECT c.doc_id, c.chunk_index, CAST(CASE WHEN c.chunk_index = 0 THEN 0
  ELSE coalesce((SELECT min(para) FROM cum WHERE cum.doc_id = c.doc_id AND cum.seen > c.chunk_index * 170), 0) END AS INTEGER) AS para FROM chunks c""")
def r23_paragraph_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packed(spark, sf_dir).select("doc_id", P.paragraph_sizes(F.col("ps")).alias("sizes"), T.words(F.col("text")).alias("w"))
    # exploding an array keeps the sizes above from being recomputed per passage
    numbered = rows.select("doc_id", "sizes", F.posexplode(index.windows(F.col("w"))).alias("chunk_index", "content"))
    return numbered.select(
        "doc_id", "chunk_index", P.paragraph_at(F.col("sizes"), F.col("chunk_index") * P.CHUNK_STRIDE).alias("para")
    )
