"""Colour aggregation over measured page elements: uses, look-alikes, roles, contrast.

elements: site_id, pos, kind, region, x, y, w, h, chars, size, color, back, bg, border, promo, on_image
(heights in pixels; screen is the first screen's height).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import color, text
from lumenloom.sources.scratch import written

# Fixed values of the weights and thresholds.
TEXT_CAP, MIN_BUTTON, SAME, COLOURFUL, DISTINCT = 150.0, 40, 3.0, 20.0, 15.0
MIN_BRAND, BRAND_SHARE, TEXT_SHARE, MUTED_SHARE = 40.0, 0.10, 0.05, 0.10
#: Held colours in one array, and those of a site that are compared without cubes.
TOGETHER, CROWDED = 2000, 500
BROWSER_LINKS = ["#0000EE", "#551A8B", "#EE0000"]


def place(y: Column, screen: Column) -> Column:
    """What is further down counts for less."""
    return F.when(y < screen, 1.0).when(y < 3 * screen, 0.6).otherwise(0.3)


def without_stacked_copies(elements: DataFrame) -> DataFrame:
    """Of texts drawn in the same place, the last; elements without text stay."""
    spot = Window.partitionBy("site_id", "x", "y", "w", "h", "chars").orderBy(F.desc("pos"))
    return elements.withColumn("__n", F.when(F.col("chars") > 0, F.row_number().over(spot)).otherwise(1)).where("__n = 1").drop("__n")


def text_label() -> Column:
    region = F.col("region")
    return (
        F.when(F.col("kind").isin("button", "button-text"), F.lit("button text"))
        .when(F.col("kind") == "heading", F.lit("heading text"))
        .when(region.isin("header", "nav"), F.lit("navigation text"))
        .when(region == "footer", F.lit("footer text"))
        .when(F.col("kind") == "link", F.lit("link text"))
        .otherwise("body text")
    )


def background_label() -> Column:
    region = F.col("region")
    return (
        F.when((F.col("kind") == "button") & (F.col("w") >= MIN_BUTTON), F.lit("button background"))
        .when(F.col("kind") == "button", F.lit("icon background"))
        .when(region == "page", F.lit("page background"))
        .when(region == "header", F.lit("header background"))
        .when(region == "nav", F.lit("navigation background"))
        .when(region == "footer", F.lit("footer background"))
        .otherwise("section background")
    )


def colour_rows(elements: DataFrame, screen: int = 900) -> DataFrame:
    """One row for each colour of each element: site_id, hex, label, weight, on_page, link, button."""
    e = elements.where("w >= 1 and h >= 1")
    at = place(F.col("y"), F.lit(screen))
    icon = (F.col("kind") == "button") & (F.col("w") < MIN_BUTTON) & ~F.col("promo")
    button = (F.col("kind") == "button") & ~icon & ~F.col("promo")
    text_weight = F.least(F.col("chars") * F.greatest(F.col("size"), F.lit(8)) / 16, F.lit(TEXT_CAP)) * at * F.when(F.col("kind") == "heading", 1.5).otherwise(1.0)
    fill_weight = F.sqrt(F.col("w") * F.least(F.col("h"), F.lit(2 * screen))) * at * F.when(button, 3).otherwise(1)
    edge_weight = (F.col("w") + F.col("h")) / 10 * at * F.when(button, 3).otherwise(1)
    plain = ~F.col("promo") & ~F.col("on_image") & (F.col("chars") > 0)
    equal = F.upper("back") == F.upper("page_background")  # most are, and need no distance
    on_page = F.when(~plain, F.lit(False)).when(equal, F.lit(True)).otherwise(F.coalesce(color.delta_e(F.col("back"), F.col("page_background")) < SAME, F.lit(False)))
    edge_label = F.when(button, F.lit("button border")).when(icon, F.lit("icon border")).when(F.col("kind") == "input", F.lit("input border")).otherwise("border")
    row = lambda code, label, weight, page, fill: F.struct(F.upper(code).alias("hex"), label.alias("label"), weight.cast("double").alias("weight"), page.alias("on_page"), fill.alias("button"))
    no = F.lit(False)
    rows = F.array(
        F.when(F.col("color").isNotNull() & (F.col("chars") > 0), row(F.col("color"), F.when(F.col("promo"), F.lit("sale or deal text")).otherwise(text_label()), text_weight, on_page, no)),
        F.when(F.col("bg").isNotNull(), row(F.col("bg"), F.when(F.col("promo"), F.lit("sale or deal badge")).otherwise(background_label()), fill_weight, no, button)),
        F.when(F.col("border").isNotNull(), row(F.col("border"), edge_label, edge_weight, no, button)),
    )
    made = e.select("site_id", "pos", (F.col("kind") == "link").alias("is_link"), (F.col("region") == "main").alias("in_main"), F.explode(F.array_compact(rows)).alias("r"))
    return made.select("site_id", "pos", "r.*", (F.col("r.on_page") & F.col("is_link") & F.col("in_main")).alias("link"))


def colour_uses(elements: DataFrame, screen: int = 900) -> DataFrame:
    """site_id, hex, label: weight and counts of each use of each colour (partial sums combine before the shuffle)."""
    return colour_rows(elements, screen).groupBy("site_id", "hex", "label").agg(
        F.sum("weight").alias("weight"),
        F.count("*").alias("elements"),
        F.count_if("button").alias("buttons"),
        F.sum(F.when(F.col("on_page"), F.col("weight")).otherwise(0.0)).alias("text_on_page"),
        F.sum(F.when(F.col("link"), F.col("weight")).otherwise(0.0)).alias("links"),
        F.min("pos").alias("first_pos"),
    )


def by_colour(uses: DataFrame) -> DataFrame:
    """One row for each colour, its uses as a map and the weights that roles are chosen by."""
    like = lambda end: F.sum(F.when(F.endswith("label", F.lit(end)), F.col("weight")).otherwise(0.0))
    at = lambda label: F.sum(F.when(F.col("label") == label, F.col("weight")).otherwise(0.0))
    return uses.groupBy("site_id", "hex").agg(
        F.sum("weight").alias("weight"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "weight")))).alias("uses"),
        F.sum("elements").alias("elements"), F.sum("buttons").alias("buttons"), F.sum("text_on_page").alias("text_on_page"), F.sum("links").alias("links"),
        like("background").alias("background_weight"), like("border").alias("border_weight"),
        (at("button background") + 0.5 * at("button border") + 0.3 * at("button text")).alias("button_weight"),
        (at("header background") + at("navigation background")).alias("header_weight"),
        (at("sale or deal badge") + at("sale or deal text")).alias("promo_weight"), at("sale or deal badge").alias("promo_fill"),
        at("page background").alias("page_weight"), F.min("first_pos").alias("first_pos"),
    )


def merge_lookalikes(colours: DataFrame, same: float = SAME) -> DataFrame:
    """site_id, hex, kept: each colour and the heavier one it counts under, by greedy distance below `same`.

    The page background (is_background) leads, then weight falling, ties by first sight. Greedy order is a
    fold, over one site's few colours inside its row. A colour becomes a head unless an earlier head is close; then each counts
    under the first head that is close, which for a head is itself.
    """
    close = lambda heads, r: F.filter(heads, lambda h: color.distance(h["p"], r["p"]) < same)
    order = F.struct((~F.coalesce("is_background", F.lit(False))).alias("n"), F.col("weight").isNull().alias("w"), (-F.col("weight")).alias("weight"), F.col("first_pos").isNull().alias("f"), F.col("first_pos"), "hex", color.lab(F.col("hex")).alias("p"))
    rows = colours.groupBy("site_id").agg(F.array_sort(F.collect_list(order)).alias("rows"))
    rows = rows.withColumn("rows", F.transform("rows", lambda r: F.struct(r["hex"].alias("hex"), r["p"].alias("p"))))
    none = F.slice("rows", 1, 0)
    heads = F.aggregate("rows", none, lambda held, r: F.when(F.exists(held, lambda h: F.coalesce(color.distance(h["p"], r["p"]) < same, F.lit(False))), held).otherwise(F.concat(held, F.array(r))))
    kept = text.let(heads, lambda held: F.transform("rows", lambda r: F.struct(r["hex"].alias("hex"), F.coalesce(F.get(close(held, r), F.lit(0))["hex"], r["hex"]).alias("kept"))))
    return rows.select("site_id", F.explode_outer(kept).alias("r")).select("site_id", "r.hex", "r.kept")


def absorbed(colours: DataFrame, merged: DataFrame) -> DataFrame:
    """by_colour() rows where each look-alike's weights are added to the colour that it counts under."""
    sums = ["weight", "elements", "buttons", "text_on_page", "links", "background_weight", "border_weight", "button_weight", "header_weight", "promo_weight", "promo_fill", "page_weight"]
    both = colours.join(merged, ["site_id", "hex"])
    return both.groupBy("site_id", F.col("kept").alias("hex")).agg(*[F.sum(c).alias(c) for c in sums], F.min("first_pos").alias("first_pos"), F.max("is_background").alias("is_background"))


def with_page_background(colours: DataFrame) -> DataFrame:
    """by_colour() rows with is_background: the colour that most of the page is filled with, one for each site."""
    top = colours.groupBy("site_id").agg(F.max_by("hex", F.struct("page_weight", -F.col("first_pos"))).alias("hex")).withColumn("is_background", F.lit(True))
    return colours.join(top, ["site_id", "hex"], "left").withColumn("is_background", F.coalesce("is_background", F.lit(False)))


def palette(elements: DataFrame, same: float = SAME) -> DataFrame:
    """site_id, role, hex from measured elements: uses, look-alikes merged, their weights absorbed, roles chosen."""
    by = with_page_background(by_colour(colour_uses(without_stacked_copies(elements))))
    return palette_roles(absorbed(by, merge_lookalikes(by, same)))


def palette_roles(colours: DataFrame) -> DataFrame:
    """site_id, role, hex: roles picked one after the other, each from the colours not taken before.

    colours: by_colour() rows with is_background. background, text, primary, link, secondary, accent,
    text-muted, surface, border. What a pick needs (distance terms, contrast, shares) is computed by
    Spark for all sites at once; the picks depend on each other, so they are a fold over one site's
    few colours, and sites are spread over tasks.
    """
    site = Window.partitionBy("site_id")
    c = colours.withColumn("page", F.max(F.when(F.col("is_background"), F.col("hex"))).over(site)).where("page is not null")
    c = c.withColumn("text_total", F.sum("text_on_page").over(site)).where(~F.col("hex").isin(BROWSER_LINKS) | F.col("is_background"))
    c = c.withColumn("p", color.lab(F.col("hex"))).withColumn("contrast", color.contrast_ratio(F.col("hex"), F.col("page")))
    chroma, brand = F.hypot("p.a", "p.b"), F.col("weight") - F.col("page_weight")
    colourful = chroma >= COLOURFUL
    text_like = ~colourful | (F.col("p.l") < 25)
    promo = (F.col("promo_fill") > 0) | ((F.col("promo_weight") > 0) & (F.col("promo_weight") >= 0.5 * brand))
    buttons = F.col("button_weight") > 0
    tier = F.when(colourful & buttons, 1).when(text_like & buttons & (F.col("contrast") >= 3), 2).when(colourful & (F.col("header_weight") > 0), 3).when(colourful & ~promo, 4)
    read = F.col("text_on_page") > 0
    share = lambda least: text_like & read & (F.col("text_on_page") >= least * F.col("text_total"))
    # for each role the figure it is picked by, null where the colour can't have it
    ready = c.select(
        "site_id", "hex", "is_background", "first_pos", "p.l", "p.a", "p.b", colourful.alias("colourful"),
        F.when(share(TEXT_SHARE), F.col("contrast")).alias("text"), tier.alias("tier"),
        F.when(tier <= 2, F.col("button_weight")).when(tier == 3, F.col("header_weight")).when(tier == 4, brand).alias("primary"),
        F.when(colourful & ~promo & (F.col("links") > 0), F.col("links")).alias("link"),
        F.when(colourful & (brand >= MIN_BRAND), brand).alias("accent"),
        F.when(share(MUTED_SHARE), F.col("text_on_page")).alias("muted"),
        F.when(~colourful & (F.col("background_weight") > 0), F.col("background_weight")).alias("surface"),
        F.when(F.col("border_weight") > 0, F.col("border_weight")).alias("border"),
    )

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        left = sorted(rows.itertuples(), key=lambda r: (r.first_pos, r.hex))
        chosen, out = [], []

        def give(role: str, r) -> None:
            if r is not None:
                left.remove(r)
                out.append((r.site_id, role, r.hex))
                if r.colourful and role != "background":
                    chosen.append(r)

        def best(column: str, among: list):
            fit = [r for r in among if pd.notna(getattr(r, column))]
            return max(fit, key=lambda r: getattr(r, column), default=None)  # the first seen on ties

        def apart() -> list:
            return [r for r in left if all(((r.l - q.l) ** 2 + (r.a - q.a) ** 2 + (r.b - q.b) ** 2) ** 0.5 >= DISTINCT for q in chosen)]

        give("background", next(r for r in left if r.is_background))
        give("text", best("text", left))
        tiers = [r.tier for r in left if pd.notna(r.tier)]
        give("primary", best("primary", [r for r in left if r.tier == min(tiers)]) if tiers else None)
        give("link", best("link", left))
        give("secondary", best("accent", apart()))
        give("accent", best("accent", apart()))
        for role, column in (("text-muted", "muted"), ("surface", "surface"), ("border", "border")):
            give(role, best(column, left))
        return pd.DataFrame(out, columns=["site_id", "role", "hex"])

    return ready.groupBy("site_id").applyInPandas(fold, f"site_id {colours.schema['site_id'].dataType.simpleString()}, role string, hex string")


def contrast_pairs(foregrounds: DataFrame, backgrounds: DataFrame, keys: list[str]) -> DataFrame:
    """fg and bg of the same keys, unequal, each pair once: ratio cut to two digits, level on the exact ratio.

    Luminance is computed once for each colour, before the join.
    """
    fg = foregrounds.select(*keys, F.col("hex").alias("fg"), color.luminance(F.col("hex")).alias("fl")).distinct()
    bg = backgrounds.select(*keys, F.col("hex").alias("bg"), color.luminance(F.col("hex")).alias("bl")).distinct()
    ratio = color.ratio_of_luminances(F.col("fl"), F.col("bl"))
    return fg.join(bg, keys).where("fg <> bg").select(*keys, "fg", "bg", (F.floor(ratio * 100) / 100).alias("ratio"), color.wcag_level(ratio).alias("level"))


def contrast_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(
        F.count_if(F.col("level").isin("AA", "AAA")).alias("passes"), F.count_if(F.col("level") == "AA-large").alias("large_only"), F.count_if(F.col("level") == "fail").alias("fails")
    )


def first_screen(points: DataFrame) -> DataFrame:
    """Sampled points (site_id, hex or null on an image) -> counts, images apart, and shares."""
    counts = points.groupBy("site_id", "hex").count()
    return counts.withColumn("share", F.round(F.col("count") / F.sum("count").over(Window.partitionBy("site_id")), 3))


def twins(held: DataFrame, asked: DataFrame, same: float = SAME, grow: bool = True) -> DataFrame:
    """site_id, hex and twin: the held colour that each asked colour counts under.

    held: site_id, hex and place (the order in which they were first seen), asked: site_id, hex and at (their order); a colour once in a site. A colour that is held itself is its own
    twin; else the first seen one closer than `same` is. A site's held colours lie together as arrays of at most TOGETHER, those of a site with more than CROWDED
    by cubes of Lab space as wide as `same`, and an asked colour is compared inside its row; both sides are shuffled. The rest (`grow`) become held colours
    themselves, one after the other, so a later one counts under the first earlier one that is close; without `grow` their twin is null.
    """
    cube = lambda p, by=(0, 0, 0): F.concat_ws(" ", *[(F.floor(p[c] / same) + d).cast("string") for c, d in zip("lab", by)])
    crowded = held.groupBy("site_id").count().where(F.col("count") > CROWDED).select("site_id", F.lit(True).alias("crowded"))
    h = held.select("site_id", F.col("hex").alias("twin"), "place", color.lab(F.col("hex")).alias("q")).join(crowded.hint("merge"), "site_id", "left")
    a = asked.select("site_id", "hex", "at", color.lab(F.col("hex")).alias("p")).join(crowded.hint("merge"), "site_id", "left")
    around = F.array_distinct(F.array(*[cube(F.col("q"), (x, y, z)) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]))
    entered = h.select("site_id", "twin", "place", "q", F.explode(F.when(F.col("crowded"), around).otherwise(F.array(F.lit("")))).alias("cell"))
    part = F.floor((F.row_number().over(Window.partitionBy("site_id", "cell").orderBy("place", "twin")) - 1) / TOGETHER)
    packed = entered.withColumn("part", part).groupBy("site_id", "cell", "part").agg(F.collect_list(F.struct("twin", "place", "q")).alias("held")).drop("part")
    fits = F.filter("held", lambda x: (x["twin"] == F.col("hex")) | (color.distance(F.col("p"), x["q"]) < same))
    first = F.array_min(F.transform(fits, lambda x: F.struct((x["twin"] != F.col("hex")).alias("other"), x["place"].alias("place"), x["twin"].alias("twin"))))
    met = a.withColumn("cell", F.when(F.col("crowded"), cube(F.col("p"))).otherwise("")).join(packed.hint("merge"), ["site_id", "cell"], "left").select("site_id", "hex", "at", first.alias("b"))
    met = met.groupBy("site_id", "hex").agg(F.min("at").alias("at"), F.min("b").alias("b"))
    if grow:
        met = written(met, "met")
    close, left = met.where("b is not null").select("site_id", "hex", "b.twin"), met.where("b is null")
    if grow:
        new = merge_lookalikes(left.select("site_id", "hex", (-F.col("at")).cast("double").alias("weight"), F.col("at").alias("first_pos"), F.lit(False).alias("is_background")), same)
        own = new.select("site_id", "hex", F.col("kept").alias("twin"))
        return close.unionByName(own)
    return met.select("site_id", "hex", "b.twin")


def with_points(held: DataFrame, points: DataFrame, same: float = SAME) -> DataFrame:
    """site_id, hex, points and share of the colours that fill the first screen, those that no element uses among them.

    held: site_id, hex, place. points: site_id, hex, at, count: the sampled points of each colour.
    """
    found = points.join(twins(held, points, same), ["site_id", "hex"])
    own = found.groupBy("site_id", F.col("twin").alias("hex")).agg(F.sum("count").alias("points"))
    return own.withColumn("share", F.round(F.col("points") / F.sum("points").over(Window.partitionBy("site_id")), 3))


def logo_uses(held: DataFrame, logo_colours: DataFrame, same: float = SAME) -> DataFrame:
    """site_id, hex, times and only_in_logo of the logo's colourful colours, under the page's own colour where that looks the same.

    logo_colours: site_id, hex, at.
    """
    bright = logo_colours.withColumn("p", color.lab(F.col("hex"))).where(F.hypot("p.a", "p.b") >= COLOURFUL).drop("p")
    found = twins(held, bright, same, grow=False)
    return found.groupBy("site_id", F.coalesce("twin", "hex").alias("hex"), F.col("twin").isNull().alias("only_in_logo")).agg(F.count("*").alias("times"))


#: What "#RRGGBB" fills of Lab space (cubic units, roughly), how a radius grows, the one that spans the space, and how
#: many entries of held colours may be broadcast.
VOLUME, WIDER, SPAN, BROADCAST_HELD = 8.3e5, 3.0, 400.0, 50_000


def nearest(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """hex, near, de: for each colour (hex) the closest one of `held` (near), the smaller code on ties.

    Lab space is cut into cubes as wide as a radius, the first one so that a cube has one held colour on average.
    Held colours are entered in the cubes around their own, as arrays of at most TOGETHER; a colour meets the arrays
    of its cube and is compared inside its row, so pairs are never written. A colour that has one within the
    radius is settled, as nothing outside those cubes is closer. The rest is written and goes on with a larger radius.
    """
    cube = lambda lab, r, by=(0, 0, 0): F.struct(*[(F.floor(lab[c] / r) + d).alias(c) for c, d in zip("lab", by)])
    left = written(wanted.select("hex").distinct().withColumn("p", color.lab(F.col("hex"))).where("p.l is not null"), "wanted")
    held = written(held.select("near").distinct().withColumn("q", color.lab(F.col("near"))).where("q.l is not null"), "held")
    around = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    n = held.count()
    r, out = min(SPAN, (VOLUME / max(n, 1)) ** (1 / 3)), None
    while out is None or (r < SPAN and not left.isEmpty()):
        r = r if out is None else min(SPAN, WIDER * r)
        entered = held.select("near", "q", F.explode(F.array(*[cube(F.col("q"), r, by) for by in around])).alias("cube"))
        part = F.floor((F.row_number().over(Window.partitionBy("cube").orderBy("near")) - 1) / TOGETHER)
        packed = entered.withColumn("part", part).groupBy("cube", "part").agg(F.collect_list(F.struct("near", "q")).alias("held")).drop("part")
        packed = F.broadcast(packed) if n * len(around) <= BROADCAST_HELD else packed.hint("merge")
        best = text.let(
            F.transform("held", lambda h: F.struct(color.distance(F.col("p"), h["q"]).alias("de"), h["near"].alias("near"))),
            lambda all_: text.let(F.array_min(all_)["de"], lambda least: F.array_min(F.transform(F.filter(all_, lambda x: x["de"] <= least + 1e-8), lambda x: F.struct(F.round(x["de"], 9).alias("de"), x["near"].alias("near"))))),
        )
        met = left.withColumn("cube", cube(F.col("p"), r)).join(packed, "cube", "left").select("hex", "p", best.alias("b"))
        met = written(met.groupBy("hex").agg(F.first("p").alias("p"), F.min("b").alias("b")), "met")
        settled = F.coalesce(F.col("b.de") < r * 0.999, F.lit(False))
        found = met.where(settled).select("hex", "b.near", "b.de")
        out = found if out is None else out.union(found)
        left = met.where(~settled).select("hex", "p")
    return out
