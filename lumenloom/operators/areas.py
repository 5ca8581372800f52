"""Areas that a drawing encloses: connected see-through areas inside its box that don't touch the box's edge.

A row of a picture becomes a few runs of see-through pixels, found from the ink alone, so an empty or a plain picture costs a row for each
line, whatever its width. Runs of neighbouring lines that overlap are linked by one window over both lines; areas are the components of
these links, made by stars that shrink in rounds, each round written. All runs that touch the box's edge are one node, as what they reach
is never enclosed. Nothing walks over pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.sources.scratch import written

#: A run's number: its line times this plus where it starts. Pictures are narrower.
WIDEST = 1 << 31
EDGE = -1


def components(links: DataFrame) -> DataFrame:
    """scope, node and root (the smallest node that can be reached) of all linked nodes; links: scope, a, b (long), a <> b.

    Stars to the smallest neighbour in turns, first for larger then for smaller ones, until no link changes: rounds grow with the
    logarithm of the longest way, not with the way.
    """
    e = written(links.select("scope", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = lambda: e.agg(F.count("*"), F.sum(F.xxhash64("scope", "a", "b").cast("decimal(38,0)"))).first()
    now, before = state(), None
    while now != before:
        both = e.unionByName(e.select("scope", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("scope", "a").agg(F.min("b").alias("m")).select("scope", "a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, ["scope", "a"]).select("scope", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "links")
        low = large.groupBy("scope", "a").agg(F.min("b").alias("m"))
        across = large.join(low, ["scope", "a"]).where("b <> m").select("scope", F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(low.select("scope", "a", F.col("m").alias("b")).unionByName(across).distinct(), "links")
        now, before = state(), now
    roots = e.select("scope", F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select("scope", F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def see_through_runs(ink: DataFrame, box: DataFrame) -> DataFrame:
    """image_id, y, start, end and edge (it touches the box's edge) of the see-through runs inside each picture's box."""
    line = Window.partitionBy("image_id", "y").orderBy("x")
    boxed = ink.join(box, "image_id")
    left = F.coalesce(F.lag("x").over(line) + 1, F.col("left"))
    last = F.lead("x").over(line).isNull()
    gaps = boxed.withColumns({"from": left, "last": last}).withColumn(
        "gap", F.explode(F.filter(F.array(F.struct(F.col("from").alias("start"), (F.col("x") - 1).alias("end")), F.struct((F.col("x") + 1).alias("start"), F.when(F.col("last"), F.col("right")).otherwise(F.col("x")).alias("end"))), lambda g: g["start"] <= g["end"]))
    )
    cols = ["image_id", "y", "left", "right", "top", "bottom"]
    lines = box.withColumn("y", F.explode(F.sequence("top", "bottom"))).join(ink.select("image_id", "y").distinct(), ["image_id", "y"], "left_anti")
    runs = gaps.select(*cols, F.col("gap.start").alias("start"), F.col("gap.end").alias("end")).unionByName(lines.select(*cols, F.col("left").alias("start"), F.col("right").alias("end")))
    edge = (F.col("start") == F.col("left")) | (F.col("end") == F.col("right")) | (F.col("y") == F.col("top")) | (F.col("y") == F.col("bottom"))
    return runs.select("image_id", "y", "start", "end", edge.alias("edge"))


def _node() -> Column:
    """A run's number; that of all runs at the box's edge is EDGE, the smallest."""
    return F.when(F.col("edge"), F.lit(EDGE)).otherwise(F.col("y") * WIDEST + F.col("start"))


def _links(runs: DataFrame) -> DataFrame:
    """Runs of neighbouring lines that share a column. One of two such runs starts inside the other, so each run only needs the last one
    of the other line that started before it: a sort for each pair of lines, no product."""
    side = lambda up: runs.select("image_id", (F.col("y") - up).alias("pair"), F.lit(up).alias("side"), "start", "end", _node().alias("node"))
    upto = Window.partitionBy("image_id", "pair").orderBy("start", "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda s: F.last(F.when(F.col("side") == s, F.struct("end", "node")), ignorenulls=True).over(upto)
    both = side(0).unionByName(side(1)).withColumns({"one": seen(0), "two": seen(1)})
    other = F.when(F.col("side") == 0, F.col("two")).otherwise(F.col("one"))
    return both.withColumn("other", other).where((F.col("other.end") >= F.col("start")) & (F.col("other.node") != F.col("node"))).select(F.col("image_id").alias("scope"), F.col("node").alias("a"), F.col("other.node").alias("b"))


def enclosed(ink: DataFrame) -> DataFrame:
    """image_id, ink_n (pixels), box_n (pixels of the ink's box) and hole_n: see-through pixels that can't be reached from the box's edge.

    ink: image_id, x, y (whole numbers from 0) of the pixels that aren't see-through; repeated ones count once, those with a null not at
    all. Areas touch by sides, not by corners. A picture without ink has no row.
    """
    ink = written(ink.select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).dropna().distinct(), "ink")
    box = ink.groupBy("image_id").agg(F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"), F.count("*").alias("ink_n"))
    box = written(box, "boxes")
    runs = written(see_through_runs(ink, box.drop("ink_n")), "runs")
    roots = components(_links(runs))
    numbered = runs.select(F.col("image_id").alias("scope"), _node().alias("node"), (F.col("end") - F.col("start") + 1).alias("n"), "edge")
    areas = numbered.join(roots, ["scope", "node"], "left").groupBy("scope", F.coalesce("root", "node").alias("root")).agg(F.sum("n").alias("n"), F.max("edge").alias("edge"))
    holes = areas.where("NOT edge").groupBy(F.col("scope").alias("image_id")).agg(F.sum("n").alias("hole_n"))
    size = (F.col("right") - F.col("left") + 1) * (F.col("bottom") - F.col("top") + 1)
    return box.join(holes, "image_id", "left").select("image_id", "ink_n", size.alias("box_n"), F.coalesce("hole_n", F.lit(0).cast("long")).alias("hole_n"))
