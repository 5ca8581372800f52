"""URL filtering with a cascade of Bloom filters, DataFrame functions only.

Level 1 encodes the listed keys, level 2 the keys of the corpus that level 1 takes for listed
by mistake, level 3 the listed keys that level 2 takes for mistakes, and so on until a level
has no false positives. Over the key universe it was built for, membership is then exact: a key
is listed if the first level that rejects it is an even one (or none rejects it and the last is
odd). No join is needed to look a key up; the filters are literals in the plan, whose size is a
few bytes for each listed key, whatever the size of the corpus.

Keys of a url are host suffixes (up to the length of the longest listed host; longer ones can't be
listed) with path prefixes of the lengths that rules have, so their number depends on the rules alone.
The filters go into the plan, so a list may hold MOST_LISTED keys at most; beyond that filter_urls raises.

Level 1 has a false positive rate of about listed / universe, so that level 2 is no larger than
level 1; the later levels use one half.

Defined results: a null url, or one without "://", has an empty host and path and no rule; repeated
urls are judged alike; of rules with equal host and path the last one counts; an empty table gives an
empty table; no rule at all means the default verdict.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import let, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Listed keys at most (two bytes of filter each at a false positive rate of one in a million).
MOST_LISTED = 2_000_000


@dataclass
class Level:
    bits: int
    hashes: int
    seed: int
    words: list[int]

    def test(self, key: Column) -> Column:
        words = F.lit(np.array(self.words, dtype=np.int64))
        one = lambda p: F.getbit(F.element_at(words, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")) == 1
        tests = [one(p) for p in _positions(key, self)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        """Whether key is listed; exact for the keys of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].test(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def _positions(key: Column, level: Level) -> list[Column]:
    a = F.xxhash64(key, F.lit(2 * level.seed))
    b = F.xxhash64(key, F.lit(2 * level.seed + 1))
    return [F.pmod(F.xxhash64(a, b, F.lit(i)), F.lit(level.bits)) for i in range(level.hashes)]


def _encode(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of the column `key`: hashed and OR-ed together by Spark, collected as bits."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    level = Level(bits, max(1, round(-math.log2(rate))), seed, [])
    words = (
        keys.select(F.explode(F.array(*_positions(F.col("key"), level))).alias("p"))
        .groupBy(F.floor(F.col("p") / 64).cast("int").alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("m"))
    )
    level.words = [0] * math.ceil(bits / 64)
    for w, m in words.collect():
        level.words[w] = m
    return level


def build_cascade(listed: DataFrame, universe: DataFrame, n_universe: int, seed: int = 1) -> Cascade:
    """Exact membership in `listed` (column key) for every key of `universe` (column key, repeats allowed).

    One pass over the universe finds the false positives of level 1; the later levels work on
    those and on the listed keys alone. What the driver gets is the filters' bits.
    """
    listed = listed.select("key").where("key is not null").distinct()
    n = listed.count()
    if n == 0:
        return Cascade()
    cascade = Cascade([_encode(listed, n, min(0.5, n / (math.sqrt(2) * max(1, n_universe))), seed)])
    inside = listed
    mistaken = universe.select("key").where(F.col("key").isNotNull() & cascade.levels[0].test(F.col("key"))).distinct()
    outside = materialize(mistaken.join(listed, "key", "left_anti"), "mistaken")
    left = outside.count()
    while left:
        cascade.levels.append(_encode(outside, left, 0.5, seed + len(cascade.levels)))
        inside, outside = outside, materialize(inside.where(cascade.levels[-1].test(F.col("key"))), "mistaken")
        left = outside.count()
    return cascade


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty for null or without "://"."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER)
    return host, F.regexp_extract(url, URL, 2)


def _keys(host: Column, path: Column, widest: int, lengths: list[int]) -> Column:
    """Every (host suffix + path prefix) that a rule could be, longest first; `widest`: the longest listed host."""
    tail = F.split(F.right(host, F.lit(widest + 1)), r"\.")
    labels = F.when(F.length(host) > widest + 1, F.slice(tail, 2, F.greatest(F.size(tail) - 1, F.lit(0)))).otherwise(tail)
    suffixes = let(labels, lambda s: F.transform(s, lambda _, i: F.array_join(F.slice(s, i + 1, F.size(s)), ".")))
    wide = sorted(set(lengths), reverse=True)
    each = F.transform(F.filter(F.array(*[F.lit(n) for n in wide]), lambda n: F.length(path) >= n), lambda n: F.left(path, n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(each, lambda p: F.concat(s, p))))
    longest = F.array_sort(keys, lambda a, b: F.length(b) - F.length(a))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(longest)


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """df plus host, path, rule and verdict.

    rules: (host, path, verdict). A rule fits its host and all subdomains where the url's path
    starts with the rule's; the longest fitting rule wins. Columns of those names are replaced.
    """
    spark = df.sparkSession
    host, path = split_url(F.col(url_col))
    parts = df.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    if not rules:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    if len(rules) > MOST_LISTED:
        raise ValueError(f"{len(rules)} rules: filters of more than {MOST_LISTED} don't belong into a plan")
    rules = [(h, p, v) for (h, p), v in {(h, p): v for h, p, v in rules}.items()]
    keys = _keys(F.col("host"), F.col("path"), max(len(h) for h, _, _ in rules), [len(p) for _, p, _ in rules])
    keyed = parts.withColumn("__keys", keys)
    universe = keyed.select(F.explode("__keys").alias("key"))
    n_universe = universe.agg(F.approx_count_distinct("key")).first()[0]
    found, verdict = F.lit(None).cast("string"), F.lit(default)
    cascades = {}
    for v in sorted({v for _, _, v in rules}):
        listed = spark.createDataFrame([(h + p,) for h, p, x in rules if x == v], "key string")
        cascades[v] = build_cascade(listed, universe, n_universe)
    any_listed = lambda k: _any([c.contains(k) for c in cascades.values()])
    found = F.get(F.filter("__keys", any_listed), F.lit(0))
    judged = keyed.withColumn("rule", found).drop("__keys")
    for v, c in cascades.items():
        verdict = F.when(F.col("rule").isNotNull() & c.contains(F.col("rule")), F.lit(v)).otherwise(verdict)
    return judged.withColumn("verdict", verdict)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
