"""Logo candidates: keys, merging of two sightings, judgement, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LOGOS, BONUS, HIDDEN, CONFIRMED_MAX = 5, 0.05, 0.15, 0.95


def fingerprint(markup: Column) -> Column:
    """Sixteen hex digits of the shapes' data, white space and order of attributes aside."""
    shapes = F.regexp_extract_all(markup, F.lit(r"""(?is)\b(?:d|points)\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return F.substring(F.sha1(F.array_join(F.transform(shapes, lambda s: F.trim(F.regexp_replace(s, r"[\s,]+", " "))), "|")), 1, 16)


def detail(markup: Column) -> Column:
    """How much drawing there is: numbers in path data, 4 for each basic shape, 100 for text."""
    numbers = F.aggregate(F.regexp_extract_all(markup, F.lit(r"""(?is)\b(?:d|points)\s*=\s*["']([^"']*)["']"""), F.lit(1)), F.lit(0), lambda n, s: n + F.regexp_count(s, F.lit(r"-?[0-9]*\.?[0-9]+")))
    return numbers + 4 * F.regexp_count(markup, F.lit("(?i)<(rect|circle|ellipse|line)\\b")) + 100 * F.regexp_count(markup, F.lit("(?i)<text\\b"))


def logo_key(element_id: Column, url: Column, svg: Column) -> Column:
    return F.coalesce(F.concat(F.lit("css:"), element_id), url, F.concat(F.lit("svg:"), fingerprint(svg)))


def merge_sightings(fetched: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates of two reads (site_id, pos, key, confidence; seen also visible): one for each key.

    The visible twin leads; being confirmed adds to the confidence up to a maximum, being hidden takes away.
    """
    f = fetched.select("site_id", "key", F.col("pos").alias("f_pos"), F.col("confidence").alias("f_conf"))
    first = Window.partitionBy("site_id", "key").orderBy(F.desc("visible"), "pos")
    s = seen.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("site_id", "key", F.col("pos").alias("s_pos"), F.col("confidence").alias("s_conf"), "visible")
    both = f.join(s, ["site_id", "key"], "full_outer")
    base = F.coalesce("f_conf", "s_conf")
    confidence = F.when(F.col("visible"), F.least(base + BONUS, F.greatest(base, F.lit(CONFIRMED_MAX)))).when(~F.col("visible"), base - HIDDEN).otherwise(base)
    return both.select("site_id", "key", F.coalesce("f_pos", F.col("s_pos") + 1000).alias("pos"), F.round(confidence, 4).alias("confidence"))


def rank_logos(candidates: DataFrame, limit: int = MAX_LOGOS) -> DataFrame:
    """site_id, key, pos, confidence, small_icon and rank: the best of each site, one for each key, the first on ties.

    The first small tab icon (small_icon) that would fall off the end keeps the last place: it is the one
    picture that is sure to be the site's own. Without a column small_icon there is none.
    """
    if "small_icon" not in candidates.columns:
        candidates = candidates.withColumn("small_icon", F.lit(False))
    row = F.struct("confidence", -F.col("pos"))
    best = candidates.groupBy("site_id", "key").agg(F.max_by("pos", row).alias("pos"), F.max("confidence").alias("confidence"), F.max_by("small_icon", row).alias("small_icon"))
    site = Window.partitionBy("site_id")
    order = [F.desc("confidence"), "pos", "key"]
    placed = best.withColumn("n", F.row_number().over(site.orderBy(*order))).withColumn("first_icon", F.min(F.when(F.col("small_icon"), F.col("n"))).over(site))
    reserved = F.coalesce(F.col("first_icon") > limit, F.lit(False))
    rank = F.when(reserved & (F.col("n") == F.col("first_icon")), F.lit(limit)).otherwise(F.col("n"))
    kept = (F.col("n") <= F.when(reserved, limit - 1).otherwise(limit)) | (reserved & (F.col("n") == F.col("first_icon")))
    return placed.where(kept).select("site_id", "key", "pos", "confidence", "small_icon", rank.alias("rank"))


def drawing_problem(loaded: Column, ink: Column, fill: Column, main_colour: Column, holes: Column) -> Column:
    """Why a drawing is no logo; null if it may be one."""
    return (
        F.when(~loaded, F.lit("not loaded"))
        .when(ink < 0.005, F.lit("blank"))
        .when((main_colour >= 0.95) & (fill >= 0.7) & (holes < 0.01), F.lit("one plain colour"))
    )


def pixel_statistics(pixels: DataFrame) -> DataFrame:
    """image_id, ink, fill, main_colour, colours from pixels (image_id, x, y, r, g, b, alpha).

    Ink is what isn't transparent; fill its share of its own box; colours are the brightest families of 4
    bits a channel with at least 3 % of the ink, at most three.
    """
    solid = pixels.where("alpha >= 128")
    size = pixels.groupBy("image_id").agg(F.count("*").alias("pixels"))
    family = F.concat_ws("-", *[F.shiftright(c, 4) for c in ("r", "g", "b")])
    code = F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in ("r", "g", "b")])
    by_code = solid.groupBy("image_id", family.alias("family"), code.alias("code")).agg(F.count("*").alias("n"))
    by_family = by_code.groupBy("image_id", "family").agg(F.sum("n").alias("n"), F.max(F.struct("n", "code")).alias("top"))
    box = solid.groupBy("image_id").agg(F.count("*").alias("ink_n"), ((F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)).alias("area"))
    top = Window.partitionBy("image_id").orderBy(F.desc("n"), "family")
    ranked = by_family.join(box, "image_id").withColumn("rank", F.row_number().over(top))
    found = ranked.groupBy("image_id", "ink_n", "area").agg(
        F.max(F.when(F.col("rank") == 1, F.col("n") / F.col("ink_n"))).alias("main_colour"),
        F.array_sort(F.collect_list(F.when((F.col("rank") <= 3) & (F.col("n") >= 0.03 * F.col("ink_n")), F.struct("rank", F.col("top.code").alias("code"))))).alias("c"),
    )
    return size.join(found, "image_id", "left").select("image_id", F.coalesce(F.col("ink_n") / F.col("pixels"), F.lit(0.0)).alias("ink"), (F.col("ink_n") / F.col("area")).alias("fill"), "main_colour", F.transform("c", lambda x: x["code"]).alias("colours"))
