"""How filters interact: what each removes, in every order in which they can be applied.

All orders of the filters make a trie: an edge applies one filter to what the filters before it left. What is left doesn't
depend on their order, so prefixes with the same filters share one state: five filters have 120 orders and 600 steps, but 32 states and
80 edges. The trie is walked depth first. A state's survivors are a persisted DataFrame, made from those of the state before by one filter
and given back when the walk leaves the state; one pass over them counts what each further filter really removes from each part, and is
written as the state's edges. A state that was reached before isn't entered again.

Texts are read once: each document becomes its part, the filters that it fails and its labels (a few bytes), written in the shared
folder. Lost executors cost what their survivors held, which Spark makes again from there.

Defined results: a null text is an empty one, a null part the empty string; documents without an id are in no label and
nobody's copy, repeated ids are documents of their own, none of them a copy of another of the same id; a document with several labels has
each kind that one of them says; a filter whose condition is null removes nothing; a part has all its rows, zeros included; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.llm.common import discard, let, materialize

#: Groups of equal texts are split into so many before they meet their documents.
SALTS = 64
WORD = r"[^\x20\x09-\x0D]+"
COUNTED = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column) -> dict[str, Column]:
    """The filters on a text alone: whether it fails each."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counts = let(words, lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))
    return {
        "A": counts["all"] < 100,
        "B": 100 * counts["distinct"] < 80 * counts["all"],
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def with_copies(rows: DataFrame) -> DataFrame:
    """rows (id, digest, __row) plus E: whether a smaller id has the same digest. Salted twice, so a digest of any number of rows is spread."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__row", "digest"), F.lit(SALTS)))
    partial = salted.groupBy("digest", "__salt").agg(F.min("id").alias("least"))
    least = partial.groupBy(F.col("digest").alias("__digest")).agg(F.min("least").alias("first"))
    first = partial.join(least, F.col("digest") == F.col("__digest")).select(F.col("__digest"), F.col("__salt").alias("__of"), "first")
    met = salted.join(first, (F.col("digest") == F.col("__digest")) & (F.col("__salt") == F.col("__of")))
    return met.withColumn("E", F.coalesce(F.col("first") < F.col("id"), F.lit(False))).drop("__digest", "__salt", "__of", "first", "digest")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (id) plus good and toxic. Only labelled ids that say either come along; an id of very many rows is left to Spark's skew join."""
    said = labels.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    met = rows.join(said.where("__id IS NOT NULL AND (good OR toxic)"), F.col("id") == F.col("__id"), "left")
    return met.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}).drop("__id")


def verdicts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, A to E, good and toxic: one row for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    fails = text_filters(text)
    judged = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.monotonically_increasing_id().alias("__row"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), *(F.coalesce(c, F.lit(False)).alias(k) for k, c in fails.items()),
    )
    judged = materialize(judged, "judged")
    found = materialize(with_labels(with_copies(judged), labels).select("part", *fails, "E", "good", "toxic"), "verdicts")
    discard(judged)
    return found


class Trie:
    """The walk over the states. A state is the set of filters applied, named by their letters in order."""

    def __init__(self, names: str) -> None:
        self.names, self.edges = names, {}

    def visit(self, state: str, survivors: DataFrame) -> None:
        rest = [f for f in self.names if f not in state]
        if state in self.edges or not rest:
            return
        self.edges[state] = materialize(self.count(state, survivors, rest), "edges")
        for name in rest:
            child = "".join(f for f in self.names if f in state or f == name)
            if child in self.edges or len(child) == len(self.names):
                continue
            left = survivors.where(~F.col(name)).persist(StorageLevel.MEMORY_AND_DISK)
            self.visit(child, left)
            left.unpersist()

    @staticmethod
    def count(state: str, survivors: DataFrame, rest: list[str]) -> DataFrame:
        """state, filter, part, kept, removed, good_lost and toxic_lost: the edges out of a state, in one pass over its survivors."""
        n, edges = F.sum("weight"), []
        for name in rest:
            gone = F.sum(F.when(F.col(name), F.col("weight")).otherwise(0))
            lost = [F.sum((F.col(name) & F.col(kind)).cast("long")) for kind in ("good", "toxic")]
            edges.append(F.struct(F.lit(name).alias("filter"), (n - gone).alias("kept"), gone.alias("removed"), lost[0].alias("good_lost"), lost[1].alias("toxic_lost")))
        told = survivors.groupBy("part").agg(F.array(*edges).alias("edges"))
        return told.select(F.lit(state).alias("state"), "part", F.inline("edges"))


def steps(names: str) -> Iterator[tuple[str, int, str, str]]:
    """filter_order, step, state before it and filter of every step of every order."""
    for order in map("".join, permutations(names)):
        for i, name in enumerate(order):
            yield order, i + 1, "".join(sorted(order[:i], key=names.index)), name


def audit(verdict: DataFrame, names: str = "ABCDE") -> DataFrame:
    """The counts of every step of every order in every part: part, filter_order, step and COUNTED.

    verdict: part, a column for each name (whether the document fails it, never null), good and toxic.
    """
    seven = verdict.select("part", *names, "good", "toxic")
    #: a row of no weight that no filter removes keeps every part in every state
    no = [F.lit(False).alias(c) for c in (*names, "good", "toxic")]
    marks = seven.select("part").distinct().select("part", *no, F.lit(0).cast("long").alias("weight"))
    trie = Trie(names)
    start = seven.withColumn("weight", F.lit(1).cast("long")).unionByName(marks).persist(StorageLevel.MEMORY_AND_DISK)
    trie.visit("", start)
    start.unpersist()
    edges = reduce(DataFrame.unionByName, trie.edges.values())
    orders = verdict.sparkSession.createDataFrame(list(steps(names)), "filter_order string, step int, of string, by string")
    met = edges.join(F.broadcast(orders), (F.col("state") == F.col("of")) & (F.col("filter") == F.col("by")))
    whole = Window.partitionBy("part", "filter")  # the filter's steps in all orders: a fixed number
    fails = F.max(F.when(F.col("step") == 1, F.col("removed"))).over(whole)
    alone = F.max(F.when(F.col("step") == len(names), F.col("removed"))).over(whole)
    out = met.withColumn("redundant", fails - F.col("removed")).withColumn("unique_fails", alone).withColumn("shapley", F.sum("removed").over(whole))
    return out.select("part", "filter_order", "step", *COUNTED)
