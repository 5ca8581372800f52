"""References by name inside a scope (a document, a theme), followed to a fixed point by doubling.

Every round joins what is known with itself, so that n rounds see chains of 2**n names. A round's rows are written, so the plan stays
one join deep whatever the length of a chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.sources.scratch import written


def followed(names: DataFrame, scope: str = "scope", name: str = "name", to: str = "to") -> DataFrame:
    """scope, name, end and state of names that each refer to one other or to none (null).

    state is `ends` (end: the name that the chain ends at), `missing` (a name on the way isn't there) or `circle`; end is null for the latter two.
    Of a name that is there twice any one row would count, so names must be unique in their scope.
    """
    known = names.select(F.col(scope).alias("scope"), F.col(name).alias("name"), F.col(to).alias("to"))
    there = known.select("scope", F.col("name").alias("to"), F.lit(True).alias("there"))
    met = known.join(there, ["scope", "to"], "left")
    gone = F.col("to").isNotNull() & F.col("there").isNull()
    state = F.when(F.col("to").isNull(), F.lit("ends")).when(gone, F.lit("missing"))
    rows = written(met.select("scope", "name", F.when(~gone, F.col("to")).alias("to"), F.when(F.col("to").isNull(), F.col("name")).alias("end"), state.alias("state")), "followed")
    left = rows.where("state IS NULL").count()
    while left:
        next_ = rows.select("scope", F.col("name").alias("to"), F.col("to").alias("far"), F.col("end").alias("far_end"), F.col("state").alias("far_state"))
        step = rows.where("state IS NULL").join(next_, ["scope", "to"]).select("scope", "name", F.col("far").alias("to"), F.col("far_end").alias("end"), F.col("far_state").alias("state"))
        rows = written(rows.where("state IS NOT NULL").unionByName(step), "followed")
        open_ = rows.where("state IS NULL").count()
        if open_ == left:  # every chain with an end got shorter, so only circles and what leads into them are left
            break
        left = open_
    return rows.select("scope", "name", "end", F.coalesce("state", F.lit("circle")).alias("state"))


def reached(edges: DataFrame, scope: str = "scope", name: str = "name", to: str = "to") -> DataFrame:
    """scope, name and to for every name that can be reached over one or more references; a name may refer to many.

    In a circle each name reaches itself. The rows of a scope are those of its closure, so scopes must be documents, not tables.
    """
    pairs = written(edges.select(F.col(scope).alias("scope"), F.col(name).alias("name"), F.col(to).alias("to")).where("to IS NOT NULL").distinct(), "reached")
    n, before = pairs.count(), -1
    while n != before:
        further = pairs.select("scope", F.col("name").alias("to"), F.col("to").alias("far"))
        longer = pairs.join(further, ["scope", "to"]).select("scope", "name", F.col("far").alias("to"))
        pairs = written(pairs.unionByName(longer).distinct(), "reached")
        n, before = pairs.count(), n
    return pairs
