"""A manifest of documents: Merkle trees over groups and over their roots, in tables, with a proof for every document.

A leaf is the SHA-256 of a row's fields. The leaves of a group (a source), in the order of their keys, make a tree in which up to FAN
consecutive nodes have one parent; the groups' roots, in the order of the groups' names, make the tree above. All digests are hex text.

Nodes live in tables, one for each level of a tree, in a folder of the shared store (NodeStore):

1. Leaves, a few numbers each instead of texts, are written, then dealt by ranges of (group, key) and sorted: each file is a sorted run.
   Sums of the runs' sizes give every leaf its place in its group, without any task that holds a group.
2. Level 0 holds the runs of FAN leaves by coordinate (group, place); level l+1 comes from one scan of level l. All are dealt by ranges
   and sorted by coordinate. Level l is FAN times smaller than the one below.
3. Proofs go down again: level l meets level l-1 by coordinate in a merge join, a parent's FAN runs of children at a time, and hands
   each the siblings on the way up. At the leaves the proof is hashed and folded in the row and never written.

Nothing is keyed by a group alone but one row for each group, and a key of level l has FAN rows at most, so a group with most of
the rows is spread like any other. Equal keys are ordered by their leaf, equal leaves by chance, which changes no digest.

Defined results: null fields have a sign of their own; null keys come first in their group; rows that repeat a key are leaves of their own;
rows without a group are a group of their own, the first; a group or a manifest of one leaf is that leaf; no rows give no rows; other columns
are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenloom.llm.common import discard, materialize, shared_dir

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Runs by groups up to this number are broadcast (about 50 bytes each); beyond it the same join is shuffled and sorted again.
BROADCAST_RUNS = 200_000
PATH = "array<struct<left: string, right: string>>"


class NodeStore:
    """Tables of nodes by level in one folder of the shared store."""

    def __init__(self, spark: SparkSession, tree: str) -> None:
        self.spark, self.root, self.levels = spark, f"{shared_dir(spark)}/{tree}-{uuid.uuid4().hex}", []

    def put(self, nodes: DataFrame) -> DataFrame:
        """Write the next level, sorted by coordinate, and read it back."""
        path = f"{self.root}/level={len(self.levels)}"
        nodes.sortWithinPartitions("tree", "run").write.parquet(path)
        back = self.spark.read.schema(nodes.schema).parquet(path)
        back._lumenloom_path = path
        self.levels.append(back)
        return back


def digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields: '-' for null, else the number of bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def leaf_rows(docs: DataFrame, fields: tuple[str, ...], group: str, key: str, received: tuple[Column, dict[str, Column]] | None) -> DataFrame:
    """tree (the group with a mark before it, empty for null, in the groups' own order), key, digest, forged (the leaf of what was received, else null)."""
    leaf = digest([F.col(f) for f in fields])
    forged = F.lit(None).cast("string")
    if received:
        forged = F.when(received[0], digest([received[1].get(f, F.col(f)) for f in fields]))
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col(key).alias("key"), leaf.alias("digest"), forged.alias("forged"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree and others) plus i, the place in the tree in the given order, and n, the rows of the tree."""
    by = ["tree", *order, "__salt"]
    dealt = rows.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*by).sortWithinPartitions(*by)
    runs = materialize(dealt.drop("__salt").withColumn("__at", F.monotonically_increasing_id()), "runs")
    runs = runs.withColumn("__run", F.shiftright("__at", 33))
    size = runs.groupBy("tree", "__run").agg(F.count("*").alias("m"), F.min("__at").alias("first"))
    before = Window.partitionBy("tree").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("m").over(before), F.lit(0)) - F.col("first")
    starts = materialize(size.select(F.col("tree").alias("__tree"), F.col("__run").alias("__of"), shift.alias("__shift"), F.sum("m").over(Window.partitionBy("tree")).alias("n")), "starts")
    few = starts.count() <= BROADCAST_RUNS
    met = runs.join(F.broadcast(starts) if few else starts, (F.col("tree") == F.col("__tree")) & (F.col("__run") == F.col("__of")))
    return met.withColumn("i", F.col("__at") + F.col("__shift")).drop("__tree", "__of", "__run", "__at", "__shift")


def runs_of(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """tree, run, n and members (place, digest, payload): consecutive nodes in runs of FAN, dealt by ranges of coordinates."""
    member = F.struct("i", "digest", *payload)
    at = nodes.withColumn("run", F.floor(F.col("i") / FAN)).select("tree", "run", "n", member.alias("member"))
    grouped = at.repartitionByRange("tree", "run").groupBy("tree", "run")
    return grouped.agg(F.max("n").alias("n"), F.array_sort(F.collect_list("member")).alias("members"))


def parent(members: Column) -> Column:
    return F.sha2(F.array_join(members["digest"], "").cast("binary"), 256)


def build(rows: DataFrame, order: list[str], payload: list[str], name: str) -> NodeStore:
    """The levels of all trees over rows (tree, digest and payload), leaves first."""
    store = NodeStore(rows.sparkSession, name)
    level = store.put(runs_of(placed(rows, order), payload))
    most = level.agg(F.max("n")).first()[0] or 0
    while most > FAN:
        most = -(-most // FAN)
        above = level.where(F.col("n") > FAN).select("tree", F.col("run").alias("i"), parent(F.col("members")).alias("digest"), F.ceil(F.col("n") / FAN).alias("n"))
        level = store.put(runs_of(above, []))
    return store


def tops(store: NodeStore) -> DataFrame:
    """tree and digest: the root of each tree, from the level where one run is left; a lone leaf is its own."""
    root = F.when(F.col("n") == 1, F.col("members")[0]["digest"]).otherwise(parent(F.col("members")))
    return reduce(DataFrame.unionByName, [level.where(F.col("n") <= FAN).select("tree", root.alias("digest")) for level in store.levels])


def step(members: Column, at: Column) -> Column:
    """One step of a path: the digests before and after the member at place `at` of its run."""
    others = members["digest"]
    return F.array(F.struct(F.array_join(F.slice(others, 1, at), "").alias("left"), F.array_join(F.slice(others, at + 2, F.lit(FAN)), "").alias("right")))


def paths(store: NodeStore, ends: DataFrame | None = None) -> DataFrame:
    """Level 0 plus `path`, what a run's parent meets on its way up, and the columns of ends: __tree, path and others, one row for each tree.

    Without ends there is nothing above the trees.
    """
    extra = [c for c in ends.columns if c not in ("__tree", "path")] if ends else []
    upper, stored = None, []
    for level in reversed(store.levels):
        top = level.where(F.col("n") <= FAN)
        met = top.join(ends, F.col("tree") == F.col("__tree")).drop("__tree") if ends else top.withColumn("path", F.array().cast(PATH))
        if upper is not None:
            stored.append(materialize(upper.select(F.col("tree").alias("__tree"), F.col("run").alias("__up"), F.col("members").alias("__members"), F.col("path").alias("__path"), *extra), "paths"))
            up = level.where(F.col("n") > FAN).join(stored[-1].hint("merge"), (F.col("tree") == F.col("__tree")) & (F.floor(F.col("run") / FAN) == F.col("__up")))
            path = F.concat(step(F.col("__members"), (F.col("run") % FAN).cast("int")), F.col("__path"))
            met = met.unionByName(up.withColumn("path", path).select(*met.columns))
        upper = met
    return upper


def each_member(runs: DataFrame) -> DataFrame:
    """One row for each member of a run, with its whole path."""
    one = runs.select("*", F.posexplode("members").alias("at", "member"))
    return one.withColumn("path", F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(step(F.col("members"), F.col("at")), F.col("path"))))


def proof(path: Column) -> Column:
    """The digest of all siblings, level by level from below, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda got, s: F.sha2(F.concat(s["left"], got, s["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", received: tuple[Column, dict[str, Column]] | None = None) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root and verified for each row.

    received: a condition, and the fields (as columns over docs) as they arrive where it holds; folded_root is told from these,
    everything else from docs. verified: whether folded_root is the root.
    """
    leaves = materialize(leaf_rows(docs, fields, group, key, received), "leaves")
    groups = build(leaves, ["key", "digest"], ["key", "forged"], "groups")
    discard(leaves)
    roots = build(tops(groups).select(F.lit("").alias("tree"), "digest", F.col("tree").alias("of")), ["of"], ["of"], "roots")
    top = tops(roots).first()
    ends = each_member(paths(roots)).select(F.col("member.of").alias("__tree"), "path", F.col("member.digest").alias("subroot"))
    rows = each_member(paths(groups, materialize(ends, "ends")))
    member, root = F.col("member"), F.lit(top["digest"] if top else None).cast("string")
    found = folded(F.col("path"), F.coalesce(member["forged"], member["digest"]))
    out = rows.select(member["key"].alias(key), member["digest"].alias("leaf"), "subroot", root.alias("root"), proof(F.col("path")).alias("proof_sha256"), found.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

