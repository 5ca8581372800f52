"""Whole documents: what was found for each site, put together and ready for export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.operators import reading

# The order of roles in a document.
COLOUR_ROLES = ["primary", "secondary", "accent", "background", "surface", "text", "text-muted", "link", "border"]
FONT_ROLES = ["heading", "body", "ui", "mono"]
NO_TRAITS = "array<struct<name:string,description:string,quotes:array<string>>>"
NO_PROPS = "array<struct<title:string,quote:string>>"


def _in_order(rows: DataFrame, roles: list[str], out: str, *fields) -> DataFrame:
    """site_id and an array of the rows' fields in the order of their roles; unknown roles come last."""
    at = F.array_position(F.array(*[F.lit(r) for r in roles]), F.col("role"))
    known = F.when(at > 0, at).otherwise(len(roles) + 1)
    ordered = F.array_sort(F.collect_list(F.struct(known.alias("at"), F.col("role"), F.struct("role", *fields).alias("row"))))
    return rows.groupBy("site_id").agg(F.transform(ordered, lambda x: x["row"]).alias(out))


def build_guides(sites: DataFrame, palette: DataFrame, fonts: DataFrame, voice: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """One document for each site: name, colors, fonts, traits, value_props, tagline, mission, warnings and missing.

    sites: site_id, name, logo_url. palette: site_id, role, hex. fonts: site_id, role, family, weights, fallbacks.
    voice: site_id, traits, value_props, tagline, mission. warnings: site_id, warnings; several rows of a site
    follow each other. A site for which a step found nothing has an empty part, not a missing document.
    """
    colours = _in_order(palette, COLOUR_ROLES, "colors", "hex", F.lit(None).cast("string").alias("name"))
    types = _in_order(fonts, FONT_ROLES, "fonts", "family", F.coalesce(F.element_at("fallbacks", -1), F.lit("")).alias("fallback"), F.transform("weights", lambda w: w.cast("int")).alias("weights"))
    out = sites.join(colours, "site_id", "left").join(types, "site_id", "left")
    if voice is not None:
        out = out.join(voice.select("site_id", "traits", "value_props", "tagline", "mission"), "site_id", "left")
    else:
        empty = {"traits": NO_TRAITS, "value_props": NO_PROPS, "tagline": "string", "mission": "string"}
        out = out.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})
    if warnings is not None:
        told = warnings.groupBy("site_id").agg(F.flatten(F.collect_list("warnings")).alias("warnings"))
        out = out.join(told, "site_id", "left")
    else:
        out = out.withColumn("warnings", F.lit(None).cast("array<string>"))
    out = out.withColumn("missing", reading.missing_sections(out))
    parts = ("colors", "fonts", "traits", "value_props", "warnings")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in parts})
