"""Browser measurements as they landed, one JSON text each, checked part by part.

A measurement that is wrong as a whole is refused with the path of the first thing wrong. In one that is used, each element, logo spot,
font and colour of the first screen is checked on its own: those in a wrong shape are left out and counted, and the first three told.
Everything stays in the measurement's row, as VARIANT, so nothing is shuffled; no schema makes a wrong part null without a word.
One pass over a measurement opens its known parts, down to the fields of each element; a field that isn't there costs no look-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import text

# The parts of a measurement (name, type, more). Types with ? may be null; ! must be there.
KINDS = ["box", "button", "button-text", "input", "code", "heading", "link", "text"]
REGIONS = ["page", "header", "nav", "footer", "main"]
ELEMENT = [
    ("tag", "text", ""), ("kind", "choice", KINDS), ("heading", "whole", ""), ("region", "choice", REGIONS), ("x", "number", ""), ("y", "number", ""), ("w", "number", ""),
    ("h", "number", ""), ("text", "whole", ""), ("color", "code?", ""), ("back", "code?", ""), ("on_image", "flag", ""), ("bg", "code?", ""), ("bg_image", "flag", ""),
    ("border", "code?", ""), ("font", "text?", 300), ("weight", "whole", ""), ("size", "number", ""), ("promo", "flag", ""),
]
LOGO = [
    ("id", "text!", ""), ("x", "number", ""), ("y", "number", ""), ("w", "number", ""), ("h", "number", ""), ("visible", "flag", ""), ("color", "code?", ""), ("src", "text", ""),
    ("current_src", "text", ""), ("nw", "whole", ""), ("nh", "whole", ""), ("broken", "flag", ""), ("background", "flag", ""),
]
FONT = [("family", "text!", 100), ("weight", "text", ""), ("style", "text", "")]
HEAD = [("url", "text!", ""), ("title", "text", ""), ("lang", "text", "")]
SIZES = [("width", "whole!", ""), ("height", "whole!", "")]
REST = [("page_height", "whole", ""), ("default_background", "flag", ""), ("page_background", "code?", ""), ("overlays_hidden", "whole", "")]
COUNTS = [("images", "whole", ""), ("total", "whole", "")]
TEXTS = [("structure", "text", ""), ("text", "text", "")]
DEFAULTS = {"kind": "box", "region": "main", "weight": 400, "style": "normal"}
FONT_DEFAULTS = {"weight": "400", "style": "normal"}
MOST = {"elements": 5000, "fonts": 500, "logos": 500, "links": 1000}
CODE = "^#[0-9A-Fa-f]{6}$"
YES, NO = ["true", "1", "1.0", "yes", "on", "t", "y"], ["false", "0", "0.0", "no", "off", "f", "n"]
TOLD = 3

_SQL = {"text": "string", "choice": "string", "code": "string", "number": "double", "whole": "bigint", "flag": "boolean"}


def _kind(part: Column) -> Column:
    """What a part of a variant is: STRING, BIGINT, OBJECT<...>, VOID for null; null where there is no such part."""
    return F.schema_of_variant(part)


def _shape(fields: list[tuple], *more: str) -> str:
    """The type that opens an object into its fields, each still a variant; null for what is no object."""
    return f"struct<{', '.join([*[f'{n}: variant' for n, _, _ in fields], *more])}>"


def _facts(opened: Column, fields: list[tuple]) -> Column:
    """Kind, text and number of each field of an object opened by _shape(), null for one that isn't there. They are asked for many times, so they are made once."""

    def fact(name: str, type_: str) -> Column:
        part, plain = opened[name], type_.rstrip("?!")
        kind = _kind(part) if plain in ("text", "choice", "code") else F.lit(None).cast("string")  # texts only: no object or list reads as a number or a flag
        said = F.try_variant_get(part, "$", "string") if plain != "number" else F.lit(None).cast("string")
        number = F.try_variant_get(part, "$", "double") if plain in ("number", "whole") else F.lit(None).cast("double")
        return F.when(part.isNotNull(), F.struct(kind.alias("kind"), said.alias("said"), number.alias("number")))

    return F.array(*[fact(n, t) for n, t, _ in fields])


def _wrong(fact: Column, name: str, type_: str, more) -> Column:
    """What is wrong with one field of an object; null if nothing is."""
    kind, said, plain = fact["kind"], fact["said"], type_.rstrip("?!")
    if plain in ("text", "choice", "code"):
        good, wanted = kind == "STRING", "not a text"
        if plain == "code":
            good, wanted = good & said.rlike(CODE), "not a colour code"
        elif plain == "choice":
            good, wanted = good & said.isin(more), "not one of the known words"
        elif more:
            good, wanted = good & (F.length(said) <= more), f"not a text of at most {more} characters"
    elif plain == "flag":
        good, wanted = F.lower(said).isin(YES + NO), "neither yes nor no"
    else:
        value = fact["number"]
        good, wanted = value.isNotNull() & ~F.isnan(value), "not a number"
        if plain == "whole":
            good, wanted = good & (value == F.floor(value)) & (F.abs(value) < 2.0**63), "not a whole number"
    if type_.endswith("?"):
        good = (kind == "VOID") | good
    missing = F.lit(f"{name}: missing") if type_.endswith("!") else F.lit(None).cast("string")
    return F.when(fact.isNull(), missing).when(F.coalesce(good, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(f"{name}: {wanted}"))


def _first_wrong(facts: Column, fields: list[tuple]) -> Column:
    return F.coalesce(*[_wrong(facts[i], *f) for i, f in enumerate(fields)])


def _typed(facts: Column, fields: list[tuple], defaults: dict) -> Column:
    """The facts of an object that may be used as a struct; parts that aren't there have their defaults."""
    out = []
    for i, (name, type_, _) in enumerate(fields):
        plain, said = type_.rstrip("?!"), facts[i]["said"]
        if plain == "flag":
            value = F.coalesce(F.lower(said).isin(YES), F.lit(False))
        elif plain in ("number", "whole"):
            value = F.coalesce(facts[i]["number"], F.lit(float(defaults.get(name, 0)))).cast(_SQL[plain])
        else:
            value = said if type_.endswith("?") else F.coalesce(said, F.lit(defaults.get(name, "")))
        out.append(value.alias(name))
    return F.struct(*out)


def _checked(items: Column, fields: list[tuple], defaults: dict) -> Column:
    """Each item of a list with its problem or, if it has none, what may be used: array<struct<at, problem, item>>. Facts never leave the item's own step."""

    def one(x: Column, at: Column) -> Column:
        told = lambda facts: text.let(
            F.when(x.isNull(), F.lit("not an object")).otherwise(_first_wrong(facts, fields)),
            lambda problem: F.struct(at.alias("at"), problem.alias("problem"), F.when(problem.isNull(), _typed(facts, fields, defaults)).alias("item")),
        )
        return text.let(_facts(x, fields), told)

    return F.transform(items, one)


def _told(checked: Column, key: str) -> Column:
    """Problems of a list with their places, the first few."""
    wrong = F.slice(F.filter(checked, lambda c: c["problem"].isNotNull()), 1, TOLD)
    return F.coalesce(F.transform(wrong, lambda c: F.concat(F.lit(f"{key}["), c["at"].cast("string"), F.lit("]: "), c["problem"])), F.array().cast("array<string>"))


def checked_measurements(landed: DataFrame, raw: str = "raw") -> DataFrame:
    """landed with `raw` (JSON text) read: error, left_out, problems, and what may be used.

    error: why a measurement can't be used, null if it can; everything else is null where it is set.
    left_out: elements, logos, fonts and colours that were left out, with how many (kinds without any aren't in the map).
    problems: the first three of elements, logos and fonts, in this order.
    elements, logos, fonts: arrays of structs, in the order given. colors: points for each code. viewport, url, title, lang,
    page_height, page_background, text, links as given. A null text, one that is no JSON, and one that is no object are refused.
    Of an object that names a key twice the reader of JSON keeps none, so it is refused as no JSON.
    """
    kept = [c for c in landed.columns if c != raw]
    lists = {"elements": ELEMENT, "logos": LOGO, "fonts": FONT}
    # A part in a wrong shape becomes null on its own; the landed text then tells whether it was there.
    shape = _shape(
        HEAD + REST + TEXTS, f"viewport: {_shape(SIZES)}", f"samples: {_shape(COUNTS, 'colors: map<string, variant>')}", "links: array<variant>",
        *[f"{k}: array<{_shape(f)}>" for k, f in lists.items()],
    )
    v, o = F.col("__v"), F.col("__o")
    there = lambda part, path: part.isNull() & F.try_variant_get(v, f"$.{path}", "variant").isNotNull()
    opened = landed.withColumn("__v", F.try_parse_json(raw)).withColumn("__o", F.try_variant_get(v, "$", shape))
    items = opened.withColumns({
        **{f"__{k}": _checked(o[k], f, FONT_DEFAULTS if k == "fonts" else DEFAULTS) for k, f in lists.items()}, "__colors": o["samples"]["colors"],
        "__head": F.when(o.isNotNull(), _facts(o, HEAD + REST + TEXTS)), "__size": F.when(o["viewport"].isNotNull(), _facts(o["viewport"], SIZES)),
        "__counts": F.when(o["samples"].isNotNull(), _facts(o["samples"], COUNTS)),
    })
    good_colors = F.map_filter(F.col("__colors"), lambda c, n: F.coalesce(c.rlike(CODE) & F.schema_of_variant(n).isin("TINYINT", "SMALLINT", "INT", "BIGINT", "BOOLEAN"), F.lit(False)))
    items = items.withColumns({**{f"__good_{k}": F.filter(f"__{k}", lambda c: c["problem"].isNull())["item"] for k in lists}, "__good_colors": good_colors})

    def list_error(key: str) -> Column:
        return F.when(there(o[key], key), F.lit(f"{key}: not a list")).when(F.size(f"__good_{key}") > MOST[key], F.lit(f"{key}: more than {MOST[key]}"))

    samples_error = (
        F.when(there(o["samples"], "samples"), F.lit("samples: not an object")).when(o["samples"].isNull(), F.lit(None).cast("string"))
        .when(there(o["samples"]["colors"], "samples.colors"), F.lit("samples.colors: not an object")).otherwise(F.concat(F.lit("samples."), _first_wrong(F.col("__counts"), COUNTS)))
    )
    links = o["links"]
    link_error = (
        F.when(there(links, "links"), F.lit("links: not a list")).when(F.size(links) > MOST["links"], F.lit(f"links: more than {MOST['links']}"))
        .when(F.exists(links, lambda x: F.coalesce(F.schema_of_variant(x), F.lit("")) != "STRING"), F.lit("links: not a list of texts"))
    )
    place = {f[0]: i for i, f in enumerate(HEAD + REST + TEXTS)}
    told_of = lambda fields: [_wrong(F.col("__head")[place[f[0]]], *f) for f in fields]
    sized = F.when(there(o["viewport"], "viewport"), F.lit("viewport: not an object")).when(o["viewport"].isNull(), F.lit("viewport: missing")).otherwise(
        F.concat(F.lit("viewport."), _first_wrong(F.col("__size"), SIZES))
    )
    parts = [*told_of(HEAD), sized, *told_of(REST), list_error("elements"), samples_error, list_error("fonts"), *told_of(TEXTS[:1]), list_error("logos"), *told_of(TEXTS[1:]), link_error]
    whole = F.when(o.isNull(), F.lit("not an object")).otherwise(F.coalesce(*parts))
    told = items.withColumn("error", F.concat(F.lit("measurement in an unexpected shape: "), whole))

    lost = lambda key: F.coalesce(F.size(f"__{key}") - F.size(f"__good_{key}"), F.lit(0)).cast("bigint")
    named = {**{k: k for k in lists}, "first-screen colours": "colors"}
    counts = F.array(*[F.struct(F.lit(n).alias("key"), F.when(F.col(f"__{k}").isNull(), F.lit(0).cast("bigint")).otherwise(lost(k)).alias("value")) for n, k in named.items()])
    points = F.transform_values("__good_colors", lambda c, n: F.coalesce(F.try_variant_get(n, "$", "bigint"), F.lit(0).cast("bigint")))
    said = lambda name: F.col("__head")[place[name]]["said"]
    out = {
        "left_out": F.map_from_entries(F.filter(counts, lambda c: c["value"] > 0)),
        "problems": F.slice(F.concat(*[_told(F.col(f"__{k}"), k) for k in lists]), 1, TOLD),
        "url": said("url"), "title": F.coalesce(said("title"), F.lit("")), "lang": F.coalesce(said("lang"), F.lit("")), "viewport": _typed(F.col("__size"), SIZES, {}),
        "page_height": F.coalesce(said("page_height").try_cast("double").cast("bigint"), F.lit(0).cast("bigint")), "page_background": said("page_background"),
        "text": F.coalesce(said("text"), F.lit("")), "links": F.coalesce(F.transform(links, lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>")),
        **{k: F.coalesce(f"__good_{k}", F.array()) for k in lists},
        "colors": F.coalesce(points, F.map_from_entries(F.array().cast("array<struct<key:string,value:bigint>>"))),
    }
    return told.select(*kept, "error", *[F.when(F.col("error").isNull(), c).alias(n) for n, c in out.items()])
