"""Crawler outputs: the list of all addresses, and page heads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ambry.functions.text import escape_html, escape_xml, url_segment

# Browse families and the numeric ranges of their leaves.
FAMILIES = ["biblia", "temas", "series", "pregadores", "datas"]
YEARS = (2000, 2100)


def entries(
    spark: SparkSession, items: DataFrame, chapters: DataFrame, topics: DataFrame,
    collections: DataFrame, people: DataFrame, years: DataFrame,
) -> DataFrame:
    """(path, lastmod) of every page: home, families, leaves with items, items.

    chapters (work, chapter), topics and collections (slug, total), people
    (slug), years (year), items (item_id, date).
    """
    none = F.lit(None).cast("string").alias("lastmod")

    def leaf(rows: DataFrame, *parts) -> DataFrame:
        return rows.select(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("path"), none)

    fixed = spark.createDataFrame([("/",), *[(f"/{f}",) for f in FAMILIES]], "path string").select("path", none)
    work = F.col("work")
    parts = [
        fixed,
        leaf(chapters.select("work").distinct(), "/biblia/", work),
        leaf(chapters.where("chapter > 0"), "/biblia/", work, "/", F.col("chapter").cast("string")),
        leaf(topics.where("total > 0"), "/temas/", F.col("slug")),
        leaf(collections.where("total > 0"), "/series/", F.col("slug")),
        leaf(people, "/pregadores/", F.col("slug")),
        leaf(years, "/datas/", F.col("year").cast("string")),
        items.select(
            F.concat(F.lit("/sermao/"), url_segment(F.col("item_id").cast("string"))).alias("path"),
            F.col("date").cast("string").alias("lastmod"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def url_tags(rows: DataFrame, site: str) -> DataFrame:
    """(value): the entries as XML elements, ready for ``write.text``."""
    seen = F.when(F.col("lastmod").isNotNull(), F.concat(F.lit("\n    <lastmod>"), "lastmod", F.lit("</lastmod>"))).otherwise("")
    place = escape_xml(F.concat(F.lit(site), "path"))
    return rows.select(F.concat(F.lit("  <url>\n    <loc>"), place, F.lit("</loc>"), seen, F.lit("\n  </url>")).alias("value"))


def robots(site: str) -> str:
    return f"User-agent: *\nAllow: /\nDisallow: /api/\n\nSitemap: {site}/sitemap.xml\n"


def date_leaf(slug: Column, sub: Column) -> tuple[Column, Column]:
    """(since, until) of a date page '2024' or '2024/3'; null when it is no such page."""
    year = F.when(slug.rlike(r"^\d{4}$"), slug.try_cast("int"))
    year = F.when(year.between(*YEARS), year)
    month = F.regexp_extract(sub, r"^\s*(\d+)", 1).try_cast("int")
    month = F.when(month.between(1, 12), month)
    first = F.make_date(year, F.coalesce(month, F.lit(1)), F.lit(1))
    last = F.when(sub.isNull(), F.make_date(year, F.lit(12), F.lit(31))).otherwise(F.last_day(first))
    known = sub.isNull() | month.isNotNull()
    return F.when(known, first), F.when(known, last)


def page_head(title: Column, description: Column, path: Column, site: str) -> Column:
    """The head elements that describe one page to crawlers."""
    url, t, d = escape_html(F.concat(F.lit(site), path)), escape_html(title), escape_html(description)
    return F.concat_ws(
        "\n    ",
        F.concat(F.lit("<title>"), t, F.lit("</title>")),
        F.concat(F.lit('<meta name="description" content="'), d, F.lit('" />')),
        F.concat(F.lit('<link rel="canonical" href="'), url, F.lit('" />')),
        F.concat(F.lit('<meta property="og:title" content="'), t, F.lit('" />')),
        F.concat(F.lit('<meta property="og:url" content="'), url, F.lit('" />')),
    )


__all__ = ["FAMILIES", "date_leaf", "entries", "page_head", "robots", "url_tags"]
