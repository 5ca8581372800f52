"""Inline drawings as safe files of their own: style sheets as rows, a precedence merge for each attribute, inheritance over the element tree.

An element's look may be said by its attributes, by a class rule of the drawing's own style sheet, by its style attribute and by the paint that a browser was
seen to use; each of these is a row (drawing, element, property, value, layer, order), and of the safe values of a property the one of the highest layer, then the
last, counts. Fill, stroke and visibility pass down the tree, which is a join over the paths of its nodes. The file is put together from the kept
elements' tags in the order of their places, so there is no limit on elements or depth.

Defined results: null for a null drawing, one without an <svg>, one of more than `longest` characters as given or as written, and one in which nothing is painted where it stands;
elements that aren't allowed go with all that is in them; text outside of <text> and <tspan> goes; values that load or run anything are left out, so the one they would have
replaced stays; repeated ids count one by one if `key` tells the rows apart, so keys must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import text
from lumenloom.operators import tree
from lumenloom.sources.scratch import written

NAMESPACE = "http://www.w3.org/2000/svg"
LONGEST, LONG_VALUE, VALUE = 200_000, 150_000, 500
#: The attribute in which a measured copy of a page notes the paint that was seen: "fill:#0D0D0D;stroke:none".
PAINT = "data-mark-paint"

# Elements and attributes of SVG that only draw, by the spelling that files need; functions that values may use.
DRAWS = ["path", "rect", "circle", "ellipse", "line", "polyline", "polygon", "text"]
DEFINES = ["defs", "clipPath", "mask", "symbol", "linearGradient", "radialGradient"]
ELEMENTS = ["svg", "g", "use", "tspan", "stop", *DRAWS, *DEFINES]
GEOMETRY = [
    "viewBox", "preserveAspectRatio", "width", "height", "x", "y", "x1", "y1", "x2", "y2", "cx", "cy", "r", "rx", "ry", "fx", "fy", "fr",
    "d", "points", "transform", "id", "href", "offset", "gradientUnits", "gradientTransform", "spreadMethod", "clipPathUnits", "maskUnits", "maskContentUnits",
]
STYLES = [
    "fill", "fill-rule", "fill-opacity", "stroke", "stroke-width", "stroke-linecap", "stroke-linejoin", "stroke-miterlimit", "stroke-dasharray",
    "stroke-dashoffset", "stroke-opacity", "opacity", "clip-path", "clip-rule", "mask", "stop-color", "stop-opacity", "color", "display", "visibility",
    "font-family", "font-size", "font-weight", "font-style", "text-anchor", "letter-spacing", "dominant-baseline", "vector-effect", "paint-order", "shape-rendering",
]
FUNCTIONS = ["url", "rgb", "rgba", "hsl", "hsla", "matrix", "translate", "scale", "rotate", "skewx", "skewy"]
NEVER = r"(?i)[\\@<>&]|/\*|javascript:|data:|expression"
LOCAL_URL = r"""(?i)url\(\s*(['"]?)#[\w:.-]{1,200}\1\s*\)"""
RULE = r"([^{}]+)\{([^{}]*)\}"

ATTRIBUTE, CLASS, STYLE, SEEN = range(4)


def _as_written(name: Column, names: list[str]) -> Column:
    """The spelling of a name given in lower case, null for one that isn't in the list."""
    return F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n.lower(), n)]), name)


def without_variables(value: Column, most: int = 8) -> Column:
    """var(--x, #0D0D0D) -> #0D0D0D, also inside one another; without a fallback the value stays as it is."""
    step = lambda v, _: F.when(v.rlike(r"(?s)^var\(\s*--[\w-]+\s*,\s*.+\)$"), F.trim(F.regexp_replace(v, r"(?s)^var\(\s*--[\w-]+\s*,\s*(.+)\)$", "$1"))).otherwise(v)
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), value, step)


def is_safe(name: Column, value: Column) -> Column:
    """Whether an attribute's value can only draw, never load or run anything."""
    fits = (value != "") & (F.length(value) <= F.when(name.isin("d", "points"), LONG_VALUE).otherwise(VALUE))
    called = F.transform(F.regexp_extract_all(value, F.lit(r"(?i)([a-z-]+)\s*\("), F.lit(1)), lambda f: F.lower(f))
    plain = ~value.rlike(NEVER) & (F.size(F.array_except(called, F.array(*[F.lit(f) for f in FUNCTIONS]))) == 0) & ~F.lower(F.regexp_replace(value, LOCAL_URL, "")).contains("url(")
    return F.coalesce(fits & F.when(name == "href", value.rlike(r"^#[\w:.-]{1,200}$")).when(name == "id", value.rlike(r"^[\w:.-]{1,200}$")).otherwise(plain), F.lit(False))


def declarations(style: Column) -> Column:
    """array<struct<name, value>> of "fill: #f00; stroke: none", in order, the styles of SVG only."""
    each = F.transform(F.split(F.coalesce(style, F.lit("")), ";"), lambda d: F.struct(F.lower(F.trim(F.substring_index(d, ":", 1))).alias("name"), F.trim(F.replace(F.regexp_replace(d, "(?s)^[^:]*:?", ""), F.lit("!important"), F.lit(""))).alias("value")))
    return F.filter(each, lambda d: d["name"].isin(*STYLES) & (d["value"] != ""))


def class_rules(sheets: DataFrame, key: str) -> DataFrame:
    """key, class, name, value and place of the declarations of plain class selectors. sheets: key, at (order of the sheets) and css."""
    css = F.regexp_replace("css", r"(?s)/\*.*?\*/", "")
    rules = F.arrays_zip(F.regexp_extract_all(css, F.lit(RULE), F.lit(1)).alias("selectors"), F.regexp_extract_all(css, F.lit(RULE), F.lit(2)).alias("body"))
    one = sheets.select(key, "at", F.posexplode(rules).alias("rule", "r"))
    each = one.select(key, "at", "rule", "r.selectors", F.posexplode(declarations(F.col("r.body"))).alias("nth", "d")).select(key, "at", "rule", "nth", "d", F.explode(F.split("selectors", ",")).alias("selector"))
    name = F.regexp_extract(F.trim("selector"), r"^\.([\w-]+)$", 1)
    return each.select(key, name.alias("class"), "d.name", "d.value", F.struct("at", "rule", "nth").alias("place")).where(F.col("class") != "")


def elements(drawings: DataFrame, key: str = "drawing_id", markup: str = "svg") -> DataFrame:
    """key, n, at, end, depth, path, name, attributes of the elements of the first <svg> of each drawing that may stay, and the texts of all <style> and <text>: written."""
    given = drawings.select(key, F.col(markup).alias("html")).where(F.length("html") <= LONGEST * 3 // 2)
    # Parsing is most of the work, and a small file of many drawings is read by one or two tasks.
    # The number is given, as Spark would join small partitions again by their bytes.
    one = tree.parsed(given.repartition(int(drawings.sparkSession.conf.get("spark.sql.shuffle.partitions")), key))
    nodes = F.col("nodes")
    root = F.get(F.filter(nodes, lambda n: n["tag"] == "svg"), F.lit(0))["n"]
    names = [e.lower() for e in ELEMENTS]

    def told(n: Column) -> Column:
        around = F.filter(tree.ancestors(nodes, n), lambda a: a["n"] >= F.col("root"))
        own = (n["n"] == F.col("root")) | F.array_contains(n["path"], F.col("root"))
        stays = n["tag"].isin(*names) & F.forall(around, lambda a: a["tag"].isin(*names))
        css = F.when(n["tag"] == "style", F.regexp_extract(F.get("tokens", n["at"]), r"(?is)^<style[^>]*>(.*)</style\s*>$", 1))
        inner = F.filter(nodes, lambda m: F.get(F.reverse(m["path"]), F.lit(0)) == n["n"])
        own_texts = F.filter(F.transform(F.sequence(n["at"], n["end"]), lambda t: F.struct(t.alias("at"), F.get("tokens", t).alias("text"))), lambda t: ~t["text"].startswith("<") & ~F.exists(inner, lambda m: (m["at"] < t["at"]) & (t["at"] < m["end"])))
        return F.struct(*[n[c].alias(c) for c in ("n", "at", "end", "path", "tag", "attributes")], own.alias("own"), stays.alias("stays"), css.alias("css"), F.when(n["tag"].isin("text", "tspan"), own_texts).alias("texts"))

    rooted = one.withColumn("root", root)
    each = rooted.select(key, "root", F.explode_outer(F.transform(nodes, told)).alias("e")).select(key, "root", "e.*").where("own")
    return written(each.withColumn("path", F.filter("path", lambda p: p >= F.col("root"))), "elements")


def cascaded(found: DataFrame, key: str = "drawing_id", paint: str = PAINT) -> DataFrame:
    """key, n, name, value and layer: for each attribute of each element that may stay, the value that counts.

    found: elements(). A style attribute beats a class rule, which beats a plain attribute, and the paint that was seen beats them all.
    """
    kept = found.where("stays")
    given = kept.select(key, "n", F.explode("attributes").alias("name", "value"), F.map_contains_key("attributes", F.lit("href")).alias("linked"))
    given = given.withColumn("name", F.when((F.col("name") == "xlink:href") & ~F.col("linked"), F.lit("href")).otherwise(F.col("name")))
    known = [a.lower() for a in (*GEOMETRY, *STYLES)]
    order = lambda *parts: F.array(*[F.lit(p) if isinstance(p, int) else p.cast("int") for p in parts])
    plain = given.where(F.col("name").isin(known)).select(key, "n", "name", "value", F.lit(ATTRIBUTE).alias("layer"), order(0).alias("place"))
    classes = kept.select(key, "n", F.posexplode(F.filter(F.split(F.try_element_at("attributes", F.lit("class")), r"\s+"), lambda c: c != "")).alias("nth", "class"))
    rules = class_rules(found.where("css IS NOT NULL").select(key, "at", "css"), key)
    ruled = classes.join(rules, [key, "class"]).select(key, "n", "name", "value", F.lit(CLASS).alias("layer"), order(F.col("nth"), F.col("place.at"), F.col("place.rule"), F.col("place.nth")).alias("place"))
    said = lambda attribute, layer: kept.select(key, "n", F.posexplode(declarations(F.try_element_at("attributes", F.lit(attribute)))).alias("nth", "d")).select(key, "n", "d.name", "d.value", F.lit(layer).alias("layer"), order(F.col("nth")).alias("place"))
    every = plain.unionByName(ruled).unionByName(said("style", STYLE)).unionByName(said(paint, SEEN))
    every = every.withColumn("value", without_variables(F.trim("value"))).where(is_safe(F.col("name"), F.col("value")))
    best = every.groupBy(key, "n", "name").agg(F.max_by(F.struct("value", "layer"), F.struct("layer", "place")).alias("b"))
    return best.select(key, "n", _as_written(F.col("name"), [*GEOMETRY, *STYLES]).alias("name"), "b.value", "b.layer")


def is_zero(value: Column) -> Column:
    """An opacity of nothing: 0, 0.0 or 0%."""
    return F.coalesce(F.regexp_replace(F.trim(value), "%$", "").try_cast("double") == 0, F.lit(False))


def paints(paint: Column, opacity: Column) -> Column:
    """Whether a fill or stroke puts colour down."""
    return ~F.lower(F.trim(paint)).isin("none", "transparent", "") & ~is_zero(opacity)


def painted(found: DataFrame, looks: DataFrame, key: str = "drawing_id") -> DataFrame:
    """key and n of the elements that are painted where they stand. looks: cascaded()."""
    own = looks.groupBy(key, "n").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("look"))
    kept = found.where("stays").select(key, "n", "tag", "path").join(own, [key, "n"], "left")
    look = lambda name: F.try_element_at("look", F.lit(name))
    seen = F.lower(F.trim(look("visibility")))
    part = kept.select(
        key, F.col("n").alias("of"), look("fill").alias("fill"), look("stroke").alias("stroke"), F.when(seen.isin("visible", "hidden", "collapse"), seen).alias("seen"),
        (F.col("tag").isin(*[d.lower() for d in DEFINES]) | F.coalesce(F.lower(F.trim(look("display"))) == "none", F.lit(False)) | is_zero(look("opacity"))).alias("unseen"),
    )
    shapes = kept.where(F.col("tag").isin(*DRAWS, "use")).select(key, "n", look("fill-opacity").alias("fo"), look("stroke-opacity").alias("so"), F.posexplode(F.array_append("path", F.col("n"))).alias("depth", "of"))
    nearest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("depth")))
    met = shapes.join(part, [key, "of"]).groupBy(key, "n").agg(nearest("fill").alias("fill"), nearest("stroke").alias("stroke"), nearest("seen").alias("seen"), F.max("unseen").alias("unseen"), F.first("fo").alias("fo"), F.first("so").alias("so"))
    coloured = paints(F.coalesce("fill", F.lit("#000")), F.col("fo")) | paints(F.coalesce("stroke", F.lit("none")), F.col("so"))
    return met.where(coloured & ~F.col("unseen") & F.coalesce(F.col("seen") == "visible", F.lit(True))).select(key, "n")


def _escaped(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def _sized(look: Column, symbol_box: Column) -> Column:
    """The root's attributes with a view box and a size in pixels, as far as they can be told."""
    get = lambda name: F.try_element_at(look, F.lit(name))
    number = lambda v: F.nullif(F.regexp_extract(F.coalesce(v, F.lit("")), r"^(\d+(?:\.\d+)?)(?:px)?$", 1), F.lit(""))
    drawn = F.when(number(get("width")).isNotNull() & number(get("height")).isNotNull(), F.concat(F.lit("0 0 "), number(get("width")), F.lit(" "), number(get("height"))))
    box = F.coalesce(get("viewBox"), symbol_box, drawn)

    def told(b: Column) -> Column:
        sides = F.filter(F.split(F.translate(F.coalesce(b, F.lit("")), ",", " "), r"\s+"), lambda x: x != "")
        side = lambda name, i: F.coalesce(number(get(name)), F.when(F.size(sides) == 4, F.get(sides, F.lit(i))))
        new = F.map_from_arrays(F.array(F.lit("viewBox"), F.lit("width"), F.lit("height")), F.array(b, side("width", 2), side("height", 3)))
        rest = F.map_filter(look, lambda k, _: ~k.isin("viewBox", "width", "height"))
        return F.map_filter(F.map_concat(rest, new), lambda _, v: v.isNotNull())

    return text.let(box, told)


def clean_drawings(drawings: DataFrame, key: str = "drawing_id", markup: str = "svg", color: str | None = None, paint: str = PAINT, longest: int = LONGEST) -> DataFrame:
    """key and svg: each drawing as a safe file of its own, or null. color: a column with the colour that "currentColor" means on its page."""
    found = elements(drawings, key, markup)
    looks = written(cascaded(found, key, paint), "looks")
    own = looks.groupBy(key, "n").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("look"))
    kept = found.where("stays").join(own, [key, "n"], "left").withColumn("look", F.coalesce("look", F.create_map().cast("map<string, string>")))
    root = (F.col("n") == F.col("root"))
    # the view box that a drawing with one <use> borrows from its symbol
    uses = kept.where("tag = 'use'").groupBy(key).agg(F.count("*").alias("uses"), F.max(F.try_element_at("look", F.lit("href"))).alias("href")).where("uses = 1")
    boxes = kept.where("tag = 'symbol'").select(key, F.concat(F.lit("#"), F.try_element_at("look", F.lit("id"))).alias("href"), F.try_element_at("look", F.lit("viewBox")).alias("symbol_box"))
    borrowed = uses.join(boxes, [key, "href"]).groupBy(key).agg(F.max("symbol_box").alias("symbol_box"))
    shade = drawings.select(key, F.when(F.col(color).rlike("^#[0-9A-Fa-f]{6}$"), F.col(color)).alias("shade")) if color else None
    kept = kept.join(borrowed, key, "left")
    kept = kept.join(shade, key, "left") if shade is not None else kept.withColumn("shade", F.lit(None).cast("string"))
    tinted = F.when(F.col("shade").isNull(), F.col("look")).otherwise(F.map_concat(F.map_filter("look", lambda k, _: k != "color"), F.create_map(F.lit("color"), "shade")))
    look = F.when(root, _sized(tinted, F.col("symbol_box"))).otherwise(F.col("look"))
    names = F.array(*[F.lit(a) for a in (*GEOMETRY, *STYLES)])
    said = lambda m: F.array_join(F.transform(F.filter(names, lambda a: F.map_contains_key(m, a)), lambda a: F.concat(F.lit(" "), a, F.lit('="'), _escaped(F.element_at(m, a)), F.lit('"'))), "")
    name = _as_written(F.col("tag"), ELEMENTS)
    kept = kept.select(key, "at", "end", F.size("path").alias("depth"), "texts", name.alias("name"), F.concat(F.lit("<"), name, F.when(root, F.lit(f' xmlns="{NAMESPACE}"')).otherwise(""), text.let(look, said), F.lit(">")).alias("start"))
    piece = lambda at, first, depth, words: F.struct(at.alias("at"), F.lit(first).alias("first"), depth.alias("depth"), words.alias("words"))
    close = F.concat(F.lit("</"), F.col("name"), F.lit(">"))
    hollow = F.col("at") == F.col("end")
    mine = F.when(hollow, F.array(piece(F.col("at"), 1, F.lit(0), F.concat("start", close)))).otherwise(F.array(piece(F.col("at"), 1, F.lit(0), F.col("start")), piece(F.col("end"), 0, -F.col("depth"), close)))
    words = F.transform(F.coalesce("texts", F.array().cast("array<struct<at: int, text: string>>")), lambda t: piece(t["at"], 1, F.lit(0), _escaped(text.decoded(t["text"]))))
    whole = kept.select(key, F.explode(F.concat(mine, words)).alias("p")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["words"]), "").alias("svg"))
    shown = painted(found, looks, key).select(key).distinct()
    return drawings.select(key).join(whole.join(shown, key).where(F.length("svg") <= longest), key, "left").select(key, "svg")
