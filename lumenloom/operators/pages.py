"""Reading landed HTML pages: titles, languages, links, text, metadata. Native regular expressions; pages.sql-checkable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import text, urls

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LANG = r"""(?i)<html[^>]*\slang=["']?([A-Za-z-]+)"""
LINK = r"""(?is)<a\s[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""
SCRIPTS = r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>"
TAG = r"(?s)<[^>]*>"


def title(html: Column) -> Column:
    return F.nullif(text.squeeze(text.decoded(F.regexp_extract(html, TITLE, 1))), F.lit(""))


def language(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(html, LANG, 1)), F.lit(""))


def meta(html: Column, name: str) -> Column:
    """The first <meta> of that name or property, its attributes in either order."""
    one = rf"""(?is)<meta\s[^>]*?(?:name|property)=["']{name}["'][^>]*?content=["']([^"']*)["']"""
    two = rf"""(?is)<meta\s[^>]*?content=["']([^"']*)["'][^>]*?(?:name|property)=["']{name}["']"""
    return F.coalesce(*[F.nullif(text.squeeze(text.decoded(F.regexp_extract(html, p, 1))), F.lit("")) for p in (one, two)])


def site_name(html: Column) -> Column:
    return F.coalesce(meta(html, "og:site_name"), meta(html, "application-name"), meta(html, "apple-mobile-web-app-title"))


def visible_text(html: Column) -> Column:
    """Text between tags, scripts and styles left out."""
    return text.squeeze(text.decoded(F.regexp_replace(F.regexp_replace(html, SCRIPTS, " "), TAG, " ")))


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, url, text: each absolute address once, where it first stands."""
    hrefs, inner = (F.regexp_extract_all("html", F.lit(LINK), F.lit(i)) for i in (1, 2))
    each = pages.select("page_id", F.col("url").alias("base"), F.posexplode(F.arrays_zip(hrefs.alias("href"), inner.alias("inner"))).alias("pos", "a"))
    found = each.select("page_id", "pos", F.col("a.href").alias("href"), urls.absolute(F.col("a.href"), F.col("base")).alias("url"), F.substring(text.squeeze(F.regexp_replace("a.inner", TAG, " ")), 1, 120).alias("text")).where("url is not null")
    first = Window.partitionBy("page_id", "url").orderBy("pos")
    return found.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def first_of_each_page(pages: DataFrame) -> DataFrame:
    """One row for each page key: the smallest page_id, with how many addresses shared the key."""
    return pages.groupBy(urls.page_key(F.col("url")).alias("key")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


def is_robot_check(page_text: Column, page_title: Column) -> Column:
    """A short page that says what robot checks say, or is titled like one."""
    said = r"(?i)click the button below to continue shopping|are you a robot|verify(ing)? you are (a )?human|enable javascript and cookies to continue|unusual traffic"
    titled = r"(?i)^(robot check|just a moment|attention required|access denied|are you a robot)"
    return (F.length(page_text) <= 2000) & (page_text.rlike(said) | F.coalesce(page_title.rlike(titled), F.lit(False)))


def merged_reads(structure: DataFrame, content: DataFrame) -> DataFrame:
    """Two reads of one site, either of which may be missing: content leads, structure fills."""
    s, c = structure.alias("s"), content.alias("c")
    both = s.join(c, F.col("s.site_id") == F.col("c.site_id"), "full_outer")
    pick = lambda n: F.coalesce(F.nullif(F.col(f"c.{n}"), F.lit("")), F.col(f"s.{n}")).alias(n)
    return both.select(F.coalesce("c.site_id", "s.site_id").alias("site_id"), *[pick(n) for n in ("title", "description", "language", "text")])
