"""Fonts by role: the family with the most text, its weights and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import labels
from lumenloom.operators.colours import place
from lumenloom.sources.scratch import written

MAX_WEIGHTS, MAX_SIZES, MAX_FALLBACKS, FOOTER = 4, 6, 6, 0.5
ROLES = ["heading", "body", "ui", "mono"]


def stack(font: Column) -> Column:
    """'"A B", sans-serif' -> [A B, sans-serif]."""
    return F.slice(F.transform(labels.font_names(font), lambda n: F.substring(n, 1, 64)), 1, 20)


def fallbacks(stack_: Column, chosen: Column) -> Column:
    """What a browser tries after the chosen family, as people know it: no stand-ins, each once, MAX_FALLBACKS at most."""
    after = F.slice(stack_, F.array_position(stack_, chosen).cast("int") + 1, F.greatest(F.size(stack_), F.lit(1)))
    shown = F.transform(F.filter(after, lambda n: ~labels.is_stand_in(n)), labels.family_name)
    return F.slice(F.array_distinct(shown), 1, MAX_FALLBACKS)


def role(kind: Column, size: Column, chars: Column, region: Column, first: Column) -> Column:
    return (
        F.when((kind == "code") | F.lower(first).isin("monospace", "ui-monospace"), F.lit("mono"))
        .when((kind == "heading") | ((size >= 28) & (chars <= 200) & (kind != "input")), F.lit("heading"))
        .when(kind.isin("button", "button-text", "input") | ((kind == "link") & region.isin("header", "nav")), F.lit("ui"))
        .otherwise("body")
    )


def typography(elements: DataFrame, loaded: DataFrame | None = None, screen: int = 900) -> DataFrame:
    """site_id, role, family (as people know it), weights, sizes, fallbacks, elements, is_webfont.

    elements also has font and weight. Amounts are compared to six digits, so that the order in which
    sums are made decides no tie. loaded: site_id, family of the page's web fonts.
    """
    e = elements.where("font is not null and chars > 0 and size > 0").withColumn("stack", stack(F.col("font"))).where("size(stack) > 0")
    if loaded is not None:
        web = loaded.groupBy("site_id").agg(F.collect_set(F.lower("family")).alias("web"))
        e = e.join(web, "site_id", "left")
        hits = F.filter("stack", lambda f: F.array_contains(F.coalesce("web", F.array().cast("array<string>")), F.lower(f)))
    else:
        hits = F.array().cast("array<string>")
    e = e.withColumn("hits", hits).withColumn("asked", F.coalesce(F.get("hits", F.lit(0)), F.get("stack", F.lit(0))))
    e = e.withColumn("family", labels.family_name(F.col("asked"))).withColumn("after", fallbacks(F.col("stack"), F.col("asked")))
    amount = F.least("chars", F.lit(300)) * place(F.col("y"), F.lit(screen)) * F.when(F.col("region") == "footer", FOOTER).otherwise(1.0)
    rows = e.select(
        "site_id", role(F.col("kind"), F.col("size"), F.col("chars"), F.col("region"), F.get("stack", F.lit(0))).alias("role"),
        "family", "after", F.col("weight").alias("font_weight"), (F.bround(F.col("size") * 2) / 2).alias("px"), amount.alias("amount"), (F.size("hits") > 0).alias("is_web"),
    )
    key = ["site_id", "role", "family"]
    # stacks are read once for each element and added up, as four sums follow
    each = rows.groupBy(*key, "after", "font_weight", "px").agg(F.sum("amount").alias("amount"), F.count("*").alias("elements"), F.bool_or("is_web").alias("is_web"))
    each = written(each, "fonts")
    total = each.groupBy(*key).agg(F.sum("amount").alias("amount"), F.sum("elements").alias("elements"), F.bool_or("is_web").alias("is_webfont"))
    best = Window.partitionBy("site_id", "role").orderBy(F.round("amount", 6).desc(), "family")
    winners = total.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "amount")

    def top(column: str, limit: int, out: str, ascending: bool) -> DataFrame:
        by_value = each.groupBy(*key, column).agg(F.sum("amount").alias("amount"))
        order = Window.partitionBy(*key).orderBy(F.round("amount", 6).desc(), column)
        kept = by_value.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit)
        return kept.groupBy(*key).agg(F.sort_array(F.collect_list(column), ascending).alias(out))

    # the family's most frequent stack, the first by its letters on ties
    stacks = each.groupBy(*key, "after").agg(F.sum("elements").alias("n")).groupBy(*key).agg(F.min_by("after", F.struct(-F.col("n"), "after")).alias("fallbacks"))
    return winners.join(stacks, key).join(top("font_weight", MAX_WEIGHTS, "weights", True), key).join(top("px", MAX_SIZES, "sizes", False), key)
