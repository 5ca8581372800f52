"""Benchmark decontamination with SimHash windows, DataFrame functions only.

1. Words are runs of letters and digits in lower case; a text is its overlapping shingles of five
   words. Texts are cut into chunks of CHUNK words that overlap by the longest item on both sides. A
   Bloom filter of the items' shingles, a literal in the plan, tells inside each chunk's row which
   positions can share a shingle with an item, so no document's words are ever shuffled.
2. Each shared shingle lays an item over the document: the window that starts so that the two
   shingles meet, as long as the item, moved inwards at the document's ends (a shorter document is
   one window). Any window that reaches the similarity shares shingles with the item, and those
   windows are the ones looked at.
3. Each window and each item get a 64-bit SimHash of their shingles, weighted by how often each
   occurs. The fingerprint is cut into BLOCKS blocks. Of two fingerprints within RADIUS bits at least
   one block differs in RADIUS // BLOCKS bits at most, so each item is entered under every value that
   close to each of its blocks, and equal blocks give every pair within the radius. Windows are compared
   with items of their size.
4. Pairs within the radius are verified by exact weighted Jaccard similarity of their shingle counts.

At similarity 0.8 the expected distance is 10 bits and its deviation 3, so RADIUS 23 leaves out one
pair in 100,000 at the threshold itself and fewer above. Two unrelated fingerprints meet in 1.2 blocks on
average, so for items of one size the blocks save nothing over comparing all; items have many sizes.

Defined results: a null or empty text has no matches, and neither has a null or empty item; an item
of fewer words than a shingle is one shingle; rows of one doc_id (or without one) are judged each by
itself and reported together, as one document; items of one item_id likewise; of several windows of one
document for one item the most similar is reported, then the first; columns other than the id and the
text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import let, materialize

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 23, 8
CHUNK = 4096
#: Item tables of at most so many shingles are broadcast; larger ones are joined by a shuffle.
BROADCAST_SHINGLES = 2_000_000
#: The filter takes 64 bits a shingle up to this; with 16 million shingles it then lets one unrelated position in 180 pass.
MAX_FILTER_BITS = 1 << 26


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(of: Column, size: Column) -> Column:
    """Hashes of the shingles of an array of words."""

    def each(w: Column) -> Column:
        count = F.size(w) - size + 1
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.array().cast("array<bigint>"))

    return let(of, each)


class _Filter:
    """A Bloom filter of 64-bit hashes as a literal: three probes, taken from the hash itself."""

    def __init__(self, hashes: DataFrame, n: int) -> None:
        self.bits = 64
        while self.bits < min(64 * n, MAX_FILTER_BITS):
            self.bits *= 2
        position = F.explode(F.array(*self._probes(F.col("h")))).alias("p")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))
        rows = hashes.select(position).groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(bit)).collect()
        held = [0] * (self.bits // 64)
        for w, m in rows:
            held[w] = m
        self.words = F.lit(np.array(held, dtype=np.int64))

    def _probes(self, h: Column) -> list[Column]:
        low = F.lit(self.bits - 1).cast("bigint")
        return [h.bitwiseAND(low), F.shiftright(h, 19).bitwiseAND(low), F.shiftright(h, 38).bitwiseAND(low)]

    def test(self, h: Column) -> Column:
        one = lambda p: F.getbit(F.get(self.words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1
        a, b, c = map(one, self._probes(h))
        return a & b & c


def _simhash(hashes: Column) -> Column:
    """Bit b is set if more than half of the hashes have it: sums of three counters of 21 bits each, and the sign bit."""
    lanes = F.lit(1 | 1 << 21 | 1 << 42).cast("bigint")
    zero, n = F.lit(0).cast("bigint"), F.size(hashes)

    def total(of) -> Column:
        return F.aggregate(hashes, zero, lambda acc, h: acc + of(h))

    def bit(count: Column, b: int) -> Column:
        value = 1 << b if b < 63 else -(1 << 63)
        return F.when(count * 2 > n, F.lit(value).cast("bigint")).otherwise(zero)

    out = bit(total(lambda h: F.getbit(h, F.lit(63)).cast("bigint")), 63)
    for j in range(21):
        packed = total(lambda h: F.shiftright(h, j).bitwiseAND(lanes))
        for lane in range(3):
            out = out.bitwiseOR(bit(F.shiftright(packed, 21 * lane).bitwiseAND(F.lit((1 << 21) - 1).cast("bigint")), j + 21 * lane))
    return out


def _blocks(fingerprint: Column) -> list[Column]:
    width = 64 // BLOCKS
    return [F.shiftright(fingerprint, width * i).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")) for i in range(BLOCKS)]


def _flips(radius: int) -> int:
    """Bits that the closest block of two fingerprints within the radius differs in, at most."""
    return radius // BLOCKS


def _entered(items: DataFrame, radius: int) -> DataFrame:
    """Each item under every value within _flips bits of each block of its fingerprint."""
    near = [m for m in range(1 << 64 // BLOCKS) if m.bit_count() <= _flips(radius)]
    blocks = items.select("item", "n", F.col("fp").alias("item_fp"), F.posexplode(F.array(*_blocks(F.col("fp")))).alias("block", "own"))
    masks = F.explode(F.lit(np.array(near, dtype=np.int64))).alias("mask")
    return blocks.select("*", masks).select("item", "n", "item_fp", "block", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))


def _common(a: str, b: str) -> Column:
    """Shingles in common, each as often as both have it."""
    times = lambda of, h: F.size(F.filter(of, lambda x: x == h))
    repeated = lambda of: let(F.array_sort(of), lambda s: F.array_distinct(F.filter(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())))
    more = F.aggregate(F.array_intersect(repeated(F.col(a)), repeated(F.col(b))), F.lit(0), lambda acc, h: acc + F.least(times(F.col(a), h), times(F.col(b), h)) - 1)
    return F.size(F.array_intersect(a, b)) + more


def _chunks(text: Column, widest: int) -> Column:
    """The words of a text in chunks: size of the text, first own position, first position held, words from there on."""

    def each(w: Column) -> Column:
        def one(i: Column) -> Column:
            base = F.greatest(i * CHUNK - widest, F.lit(0))
            return F.struct(F.size(w).alias("size"), (i * CHUNK).alias("low"), base.alias("base"), F.slice(w, base + 1, i * CHUNK - base + CHUNK + widest).alias("w"))

        return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(w) - 1, F.lit(0)) / CHUNK).cast("int")), one)

    return let(words(text), each)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start (in words), n_words and similarity of each document's best window for each item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).dropDuplicates()
    items = items.select("item_id", F.size("w").alias("n"), F.least(F.size("w"), F.lit(size)).alias("k"), "w")
    items = items.select("item_id", "n", "k", _shingles(F.col("w"), F.col("k")).alias("sh")).withColumn("fp", _simhash(F.col("sh")))
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")
    grams = items.select("n", "k", F.posexplode("sh").alias("at", "h")).distinct()
    kinds = grams.groupBy("k").agg(F.count_distinct("h"), F.count("*"), F.max("n")).collect()
    widest = max((n for *_, n in kinds), default=size)
    small = sum(c for _, _, c, _ in kinds) <= BROADCAST_SHINGLES
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    # outer explodes keep Spark from adding a filter that would do all this twice
    parts = rows.select("doc_id", "row", F.explode_outer(_chunks(F.col("text"), widest)).alias("c")).select("doc_id", "row", "c.*")
    hits = None
    for k, n in sorted((k, n) for k, n, *_ in kinds) or [(size, 0)]:
        held = _Filter(grams.where(F.col("k") == k), n)
        every = F.transform(_shingles(F.col("w"), F.lit(k)), lambda h, i: F.struct((F.col("base") + i).alias("pos"), h.alias("h")))
        own = F.filter(every, lambda x: (x["pos"] >= F.col("low")) & (x["pos"] < F.col("low") + CHUNK) & held.test(x["h"]))
        some = parts.select("doc_id", "row", "size", "base", "w", F.lit(k).alias("k"), F.explode_outer(own).alias("x"))
        some = some.where("x is not null").select("doc_id", "row", "size", "base", "w", "k", "x.pos", "x.h")
        hits = some if hits is None else hits.unionByName(some)
    hits = hits.join(F.broadcast(grams) if small else grams, ["k", "h"])
    length = F.least("n", F.col("size"))
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("size") - length))
    windows = hits.select("doc_id", "row", "n", "k", start.alias("start"), F.slice("w", start - F.col("base") + 1, length).alias("w"))
    windows = windows.groupBy("doc_id", "row", "n", "k", "start").agg(F.first("w").alias("w"))
    windows = windows.select("doc_id", "row", "n", "start", F.size("w").alias("n_words"), _shingles(F.col("w"), F.least("k", F.size("w"))).alias("sh"))
    entered = _entered(items, radius)
    looked_up = windows.withColumn("fp", _simhash(F.col("sh"))).select("*", F.posexplode(F.array(*_blocks(F.col("fp")))).alias("block", "value"))
    pairs = looked_up.join(F.broadcast(entered) if small else entered, ["n", "block", "value"])
    close = zip(_blocks(F.col("fp")), _blocks(F.col("item_fp")))
    first_close = F.coalesce(*[F.when(F.bit_count(a.bitwiseXOR(b)) <= _flips(radius), F.lit(i)) for i, (a, b) in enumerate(close)])
    near = pairs.where((F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius) & (first_close == F.col("block")))
    texts = items.select("item", "item_id", F.col("sh").alias("item_sh"))
    near = near.join(F.broadcast(texts) if small else texts, "item")
    counted = near.select("doc_id", "item_id", "start", "n_words", _common("sh", "item_sh").alias("common"), (F.size("sh") + F.size("item_sh")).alias("both"))
    judged = counted.withColumn("similarity", F.col("common") / (F.col("both") - F.col("common"))).where(F.col("similarity") >= similarity - 1e-12)
    best = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("neg"), "n_words")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.neg")).cast("long").alias("start"), F.col("b.n_words").cast("long").alias("n_words"), F.col("b.similarity").alias("similarity"))
