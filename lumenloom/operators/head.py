"""Icons of a page's head, a picture's own background, palettes against each other, CSS variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import color, urls
from lumenloom.operators import references

ICON_TAG = r"(?is)(<link\s[^>]*>)"
#: Relations that an icon's tag has, image formats by their media type.
ICON_RELATIONS = ["icon", "apple-touch-icon", "apple-touch-icon-precomposed"]
FORMATS = {"image/svg+xml": "svg", "image/png": "png", "image/x-icon": "ico", "image/vnd.microsoft.icon": "ico", "image/webp": "webp", "image/gif": "gif", "image/jpeg": "jpg", "image/avif": "avif"}
ANY_SIZE = 10_000
#: A picture's edge is its background if so many of its pixels are solid, and so many of one shade.
SOLID, OF_ONE_SHADE = 0.98, 0.95


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, quoted or not; empty if it isn't there."""
    found = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    return F.concat(*[F.coalesce(F.regexp_extract(tag, found, i), F.lit("")) for i in (1, 2, 3)])


def icon_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, url, rel (array), size and format of the icon tags of each page (page_id, url, html)."""
    tags = pages.select("page_id", F.col("url").alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit(ICON_TAG), F.lit(1))).alias("pos", "tag"))
    rel = F.filter(F.split(F.lower(attribute(F.col("tag"), "rel")), r"\s+"), lambda r: r != "")
    t = tags.select("page_id", "pos", rel.alias("rel"), urls.absolute(attribute(F.col("tag"), "href"), F.col("base")).alias("url"), F.lower(attribute(F.col("tag"), "type")).alias("type"), F.lower(F.trim(attribute(F.col("tag"), "sizes"))).alias("sizes"))
    t = t.where(F.arrays_overlap("rel", F.array(*[F.lit(r) for r in ICON_RELATIONS])) & F.col("url").isNotNull())
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), F.col("type")), urls.file_format(F.col("url")))
    widths = F.transform(F.regexp_extract_all("sizes", F.lit(r"(\d{1,6})x\d+"), F.lit(1)), lambda w: w.cast("int"))
    size = F.when((kind == "svg") | (F.col("sizes") == "any"), F.lit(ANY_SIZE)).otherwise(F.coalesce(F.array_max(widths), F.lit(0)))
    return t.select("page_id", "pos", "url", "rel", size.alias("size"), kind.alias("format"))


def best_icon(icons: DataFrame) -> DataFrame:
    """page_id, url: the browser tab's icon, the largest and then the first; a phone's only if there is no other."""
    tab = F.array_contains("rel", "icon")
    return icons.groupBy("page_id").agg(F.max_by("url", F.struct(tab, "size", -F.col("pos"))).alias("url"))


def paper(edges: DataFrame, least_solid: float = SOLID, of_one: float = OF_ONE_SHADE) -> DataFrame:
    """image_id, hex: the colour that a picture's edge is filled with; no row for a picture without one.

    edges: image_id, r, g, b, a, one row for each pixel of the edge. Shades are groups of 16 levels a channel.
    """
    shade = F.when(F.col("a") >= 250, F.floor(F.col("r") / 16) * 256 + F.floor(F.col("g") / 16) * 16 + F.floor(F.col("b") / 16))
    by = edges.groupBy("image_id", shade.alias("shade")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "rgb"])
    top = F.max_by(F.struct("n", "r", "g", "b"), F.when(F.col("shade").isNotNull(), F.struct("n", -F.col("shade")))).alias("top")
    g = by.groupBy("image_id").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("shade").isNotNull(), F.col("n")).otherwise(0)).alias("solid"), top)
    whole = (F.col("solid") >= least_solid * F.col("all")) & (F.col("top.n") >= of_one * F.col("all"))
    two = lambda c: F.lpad(F.hex(F.round(F.col(f"top.{c}")).cast("long")), 2, "0")
    return g.where(whole).select("image_id", F.concat(F.lit("#"), two("r"), two("g"), two("b")).alias("hex"))


def contrast_grid(pairs: DataFrame, colours: DataFrame) -> DataFrame:
    """site_id, fg, cells: for each text colour its ratio on every background of the site in order, a dash where none was graded.

    pairs: site_id, fg, bg, ratio. colours: site_id, hex, is_background.
    """
    backs = colours.where("is_background").groupBy("site_id").agg(F.array_sort(F.collect_set("hex")).alias("backs"))
    graded = pairs.groupBy("site_id", "fg").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("bg", "ratio")))).alias("held"))
    cell = lambda b: F.coalesce(F.format_number(F.element_at("held", b), 2), F.lit("–"))
    return graded.join(backs, "site_id").select("site_id", "fg", F.transform("backs", cell).alias("cells"))


def resolved_variables(tokens: DataFrame) -> DataFrame:
    """theme, name, value with var(--other) replaced by what it stands for, over chains of any length; null where that is a circle or missing.

    tokens: theme, name, value, a name once in a theme.
    """
    target = F.nullif(F.regexp_extract("value", r"^\s*var\(\s*--([A-Za-z0-9_-]+)\s*\)\s*$", 1), F.lit(""))
    ends = references.followed(tokens.withColumn("to", target), scope="theme").withColumnRenamed("scope", "theme")
    values = tokens.select("theme", F.col("name").alias("end"), "value")
    return ends.join(values, ["theme", "end"], "left").select("theme", "name", "value")


def checked_pairs(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (fg, bg, least) in every theme with their contrast ratio and whether it is enough."""
    v = resolved_variables(tokens)
    both = pairs.join(v.select("theme", F.col("name").alias("fg"), F.col("value").alias("x")), "fg").join(v.select("theme", F.col("name").alias("bg"), F.col("value").alias("y")), ["theme", "bg"])
    ratio = color.contrast_ratio(F.upper("x"), F.upper("y"))
    return both.select("theme", "fg", "bg", ratio.alias("ratio"), (ratio >= F.col("least")).alias("enough"))
