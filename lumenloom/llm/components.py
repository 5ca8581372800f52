"""Connected components of links, without collecting them anywhere.

Each round runs union-find inside every partition, which turns its links into stars, and then links
the roots that one node got in several partitions. The links that are left join roots alone, so the
rounds shrink fast; the answers are composed on the way back. A node with very many links costs one
row for each partition, not one group. A task holds NODES nodes at most: then it writes what it has and
begins anew, which costs a few more links for the next round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import discard, materialize, tidy


NODES = 1_000_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def root(x):
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def written() -> Iterator[pa.RecordBatch]:
        nodes = list(parent)
        for at in range(0, len(nodes), 100_000):
            part = nodes[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["node", "root"])
        parent.clear()

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
            if len(parent) >= NODES:
                yield from written()
    yield from written()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node that has a link; links: two long columns."""
    levels, written = [], []
    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    while True:
        stars = materialize(links.mapInArrow(tidy(_stars), "node long, root long"), "stars")
        least = stars.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("most"))
        levels.append(least.select("node", "root"))
        torn = least.where("most <> root").select("node", F.col("root").alias("least"))
        links = stars.join(torn, "node").where("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b")).distinct()
        links = materialize(links, "links")
        written += [stars, links]
        if links.isEmpty():
            break
    found = levels.pop()
    while levels:
        up = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = levels.pop().join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    found = materialize(found.select("node", F.col("root").alias("component")), "components")
    discard(*written)
    return found
