"""Brand documents as files: JSON, CSS variables, Tailwind theme, design tokens, a writing prompt.

guides: site_id, name, colors array<struct<role, hex, name>>, fonts array<struct<role, family, fallback, weights>>,
traits array<struct<name, description, quotes array<string>>>, value_props array<struct<title, quote>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import color, text


def css_string(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text.without_controls(value), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def comment(value: Column) -> Column:
    return F.replace(text.without_controls(value), F.lit("*/"), F.lit("* /"))


def markdown(value: Column) -> Column:
    return F.regexp_replace(text.squeeze(value), r"([\\`*_\[\]<>#|])", r"\\$1")


def _family(f: Column) -> Column:
    return F.concat(css_string(f["family"]), F.when(f["fallback"].isNotNull() & (f["fallback"] != ""), F.concat(F.lit(", "), f["fallback"])).otherwise(""))


def json_export() -> Column:
    return F.concat(F.to_json(F.struct("site_id", "name", "colors", "fonts", "traits", "value_props"), {"ignoreNullFields": "false", "pretty": "true"}), F.lit("\n"))


def _lines(open_: str, colour_prefix: str, font_prefix: str) -> Column:
    colours = F.transform("colors", lambda c: F.concat(F.lit(f"  --{colour_prefix}-"), c["role"], F.lit(": "), F.upper(c["hex"]), F.lit("; /* "), comment(F.coalesce(c["name"], F.lit(""))), F.lit(" */")))
    fonts = F.transform("fonts", lambda f: F.concat(F.lit(f"  --{font_prefix}-"), f["role"], F.lit(": "), _family(f), F.lit(";")))
    none = (F.size("colors") <= 0) & (F.size("fonts") <= 0)
    return F.when(~none, F.concat(F.lit("/* "), comment(F.col("name")), F.lit(f" */\n{open_} {{\n"), F.array_join(F.concat(colours, fonts), "\n"), F.lit("\n}\n")))


def css_export() -> Column:
    return _lines(":root", "color", "font")


def tailwind_export() -> Column:
    return _lines("@theme", "color-brand", "font-brand")


def tokens_export() -> Column:
    """Design tokens: components from 0 to 1 with four digits; names with braces are left out."""

    def colour(c: Column) -> Column:
        parts = F.transform(color.rgb(c["hex"]), lambda x: F.round(x / 255, 4))
        value = F.struct(F.lit("srgb").alias("colorSpace"), parts.alias("components"), F.lower(c["hex"]).alias("hex"))
        return F.struct(c["role"].alias("key"), F.struct(F.lit("color").alias("$type"), value.alias("$value")).alias("value"))

    def font(f: Column) -> Column:
        return F.struct(f["role"].alias("key"), F.struct(F.lit("fontFamily").alias("$type"), F.array(f["family"]).alias("$value")).alias("value"))

    colours = F.map_from_entries(F.transform("colors", colour))
    fonts = F.map_from_entries(F.transform(F.filter("fonts", lambda f: ~f["family"].rlike("[{}]")), font))
    return F.to_json(F.struct(colours.alias("color"), fonts.alias("font")))


def voice_export() -> Column:
    """Markdown from verified parts; empty sections are left out, no voice gives null."""
    trait = lambda t: F.concat(F.lit("- **"), markdown(t["name"]), F.lit("**: "), markdown(t["description"]), F.array_join(F.transform(t["quotes"], lambda q: F.concat(F.lit("\n  > "), markdown(q))), ""))
    prop = lambda p: F.concat(F.lit("- "), markdown(p["title"]), F.lit(": “"), markdown(p["quote"]), F.lit("”"))
    section = lambda head, col, one: F.when(F.size(col) > 0, F.concat(F.lit(f"## {head}\n\n"), F.array_join(F.transform(col, one), "\n")))
    parts = F.array_compact(F.array(F.concat(F.lit("# Write like "), markdown(F.col("name"))), section("Tone of voice", "traits", trait), section("Key messages", "value_props", prop)))
    return F.when(F.size(parts) > 1, F.concat(F.array_join(parts, "\n\n"), F.lit("\n")))


FORMATS = {"json": json_export, "css": css_export, "tailwind": tailwind_export, "tokens": tokens_export, "voice": voice_export}


def export(guides: DataFrame, fmt: str) -> DataFrame:
    """site_id, file_name, content of every guide that has something to write."""
    ending = {"json": "json", "css": "css", "tailwind": "tailwind.css", "tokens": "tokens.json", "voice": "md"}[fmt]
    name = F.coalesce(text.slug(F.col("name")), F.concat(F.lit("brand-"), F.col("site_id").cast("string")))
    return guides.select("site_id", F.concat(name, F.lit(f".{ending}")).alias("file_name"), FORMATS[fmt]().alias("content")).where("content is not null")


def write(exported: DataFrame, path: str) -> None:
    """One text row for each guide, in folders by site."""
    exported.select("site_id", F.col("content").alias("value")).write.mode("overwrite").partitionBy("site_id").text(path)
