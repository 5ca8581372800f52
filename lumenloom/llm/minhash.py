"""Near-duplicate documents by word shingles: an LSH forest proposes pairs, full sets confirm them.

1. Each text becomes the set of its hashed shingles (64 bits; similarities are those of these sets), a
   digest of the set, VALUES MinHash values, a sketch (two bits of each value) and for each of TREES
   trees a signature of DEEP values. Texts with equal sets fall together by digest; from here on one of
   them stands for all.
2. Each tree is the documents sorted by their signatures; those that agree in the first SHALLOW values
   are a region. A document's neighbours in that order have the longest common prefixes with it: the
   NEIGHBOURS before and after it in its region are compared by their sketches, and the best one over
   all trees is checked on full sets. That joins most of each group. A region of more than REGION
   documents is split over tasks one value deeper, and each part again as long as it is too large, so
   the depth adapts to each region.
3. Then the search goes back up: documents whose region reaches further than their neighbours, and those
   that found a partner, are compared with their whole regions at SHALLOW values, by sketches, and only
   pairs in different components matter. Regions of more than REGION documents or SHINGLES shingles
   become blocks, and each two blocks are a task of their own, unless both hold one and the same
   component. A document with up to FEW candidates in a task gets those checked; the members of a task
   where one has more are sent there with their sets and compared in place, where only links come out.
   So a group of thousands of near copies never becomes rows for all its pairs, and no candidate between
   different components goes unchecked.

Two sets with similarity J share a region of one tree with probability J**3, whatever its size: with
16 trees a pair at 0.85 is missed once in 4 million times, at 0.8 once in 90,000. Sketches drop one pair
in a million at the threshold itself (five standard deviations). The work grows with the square of a
region's documents where these are near misses that no link joins.

Defined results: a null text, an empty one or white space is an empty set, linked with nothing; a text
of fewer words than a shingle is one shingle; repeated rows get equal results; rows that share an id are one
node of the components, whatever their texts, but an empty text is its own; a null id gets a null component and isn't kept; an empty table gives an empty table; columns other than the id and the text
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.llm.common import add_columns, discard, materialize, tidy, worker_cached
from lumenloom.llm.components import components

TREES, SHALLOW, DEEP, VALUES = 16, 3, 6, 128
#: Documents and shingles of a block; a larger region becomes several blocks.
REGION, SHINGLES = 4096, 4_000_000
#: Rows before and after a document in a tree that it is compared with first.
NEIGHBOURS = 16
#: Candidates in other components that a document may have in a region before the region is compared in place.
FEW = 4
#: Tables of at most so many ids (8 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_IDS = 200_000

U8 = np.uint64
BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U8(30))) * U8(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U8(27))) * U8(0x94D049BB133111EB)
    return x ^ (x >> U8(31))


#: Powers that a worker keeps; longer tables are made for one call.
POWERS = 1 << 18
#: Bytes of a text that are hashed in one go.
PIECE = 1 << 17


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.full(n, BASE, U8)
    steps[0] = 1
    powers = np.multiply.accumulate(steps)
    steps[1:] = pow(BASE, -1, 1 << 64)
    return powers, np.multiply.accumulate(steps)


def powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i below n at least."""
    return worker_cached("powers", lambda: _powers(POWERS)) if n <= POWERS else _powers(n)


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word ([^\\x20\\x09-\\x0D]+, A-Z in lower case), from prefix sums over the bytes."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= PIECE:
        return _hashes(data.lower() if lower else data)
    out, at = [], 0
    while at < len(data):
        rest = re.compile(rb"[\x20\x09-\x0d]").search(data, at + PIECE)
        end = rest.start() if rest else len(data)
        out.append(_hashes(data[at:end].lower() if lower else data[at:end]))
        at = end
    return np.concatenate(out)


def _hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = powers_upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U8)
    np.cumsum((raw.astype(U8) + U8(1)) * powers[: len(raw)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U8))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = word_hashes(text) if text else np.zeros(0, U8)
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, U8)
    for i in range(size):
        out = (out + words[i : i + n]) * U8(0xD6E8FEB86659FD93)
        out ^= out >> U8(32)
    return np.unique(_mix(out))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 63, (VALUES, 1), dtype=U8) * U8(2) + U8(1), rng.integers(0, 1 << 63, (VALUES, 1), dtype=U8)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """VALUES minima of 32 bits."""
    a, b = worker_cached("permutations", _permutations)
    low = np.full(VALUES, np.iinfo(U8).max, U8)
    for at in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[None, at : at + 4096] * a + b).min(axis=1))
    return low >> U8(32)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U8).view("i8")


def _sketch(values: np.ndarray) -> np.ndarray:
    """Two bits of each value: 4 words for each row."""
    bits = (values & U8(3)).reshape(len(values), 4, VALUES // 4)
    return (bits << (2 * np.arange(VALUES // 4, dtype=U8))).sum(axis=2, dtype=U8)


def _labels(values: np.ndarray) -> np.ndarray:
    """For each row the signature of every tree, in turn: 21 bits of each value, SHALLOW values in a number and then the deeper ones."""
    v = (values[:, : TREES * DEEP] >> U8(11)).reshape(len(values), TREES, 2, SHALLOW)
    packed = (v << np.array([42, 21, 0], U8)).sum(axis=3, dtype=U8)
    return packed.reshape(len(values), 2 * TREES)


def features(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest, labels and sketch of every document."""

    def run(texts: list[str | None]) -> list:
        sets = [shingle_set(t, size) for t in texts]
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        values = np.stack([minhash(s) for s in sets]) if sets else np.zeros((0, VALUES), U8)
        return [[len(s) for s in sets], digests, list(_signed(_labels(values))), list(_signed(_sketch(values)))]

    return add_columns(docs.select("doc_id", "text"), "text", "n_shingles long, digest binary, labels array<long>, sketch array<long>", run)


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of all rows of x with all rows of y from their sketches."""
    d = x[:, None, :] ^ y[None, :, :]
    d = (d | (d >> U8(1))) & U8(0x5555555555555555)
    return (1 - np.bitwise_count(d).sum(axis=2, dtype="i4") / VALUES - 0.25) / 0.75


def least_estimate(similarity: float) -> float:
    """What a sketch must tell of a pair that could reach the similarity: five standard deviations less."""
    agree = similarity + 0.25 * (1 - similarity)
    return similarity - 5 * (agree * (1 - agree) / VALUES) ** 0.5 / 0.75


def _region_candidates(rep, comp, size, sketch, left, cut, ratio):
    """Of one region, or of the first `left` rows with the others: pairs (i, j) of each row with its FEW best
    partners in other components; or, if some row has more, the members that have partners."""
    m, pairs, partners = len(rep), [], np.zeros(len(rep), "i4")
    top, across = (m, slice(0, m)) if left in (0, m) else (left, slice(left, m))
    step = max(1, min(top, (1 << 17) // m))
    for at in range(0, top, step):
        rows = slice(at, min(top, at + step))
        est = _agreement(sketch[rows], sketch[across])
        a, b = size[rows, None], size[None, across]
        est[(np.minimum(a, b) < ratio * np.maximum(a, b)) | (comp[rows, None] == comp[None, across])] = -1
        est[est < cut] = -1
        partners[rows] = (est > 0).sum(axis=1)
        if top < m:
            partners[across] += (est > 0).sum(axis=0, dtype="i4")
        best = np.argsort(-est, axis=1, kind="stable")[:, :FEW]
        i, j = np.repeat(np.arange(est.shape[0]), best.shape[1]), best.ravel()
        ok = est[i, j] > 0
        pairs.append((rep[rows][i[ok]], rep[across][j[ok]]))
    pairs = [np.concatenate(x) for x in zip(*pairs)]
    if (partners[:top] > FEW).any():
        return [x[:0] for x in pairs], np.flatnonzero(partners > 0)
    return pairs, np.zeros(0, "i8")


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def crowded_regions(entries: DataFrame) -> DataFrame:
    """tree, shallow, number of documents and of shingles of the regions with more than a block takes."""
    held = entries.groupBy("tree", "shallow").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    return materialize(held.where((F.col("c") > REGION) | (F.col("w") > SHINGLES)), "crowded")


def _deepened(entries: DataFrame, crowded: DataFrame) -> DataFrame:
    """entries with part: crowded regions are split one value deeper, and each part again while it is too large.

    Documents with equal signatures that are still too many are dealt out by a hash; the second step meets all their pairs."""
    region = ["tree", "shallow"]
    inside = entries.join(_few(crowded.select(*region)), region, "left_semi")
    counts = materialize(inside.groupBy(*region, "deep").agg(F.count("*").alias("c")), "depths")
    entries = entries.join(_few(crowded.select(*region, F.lit(True).alias("in0"))), region, "left")
    part = F.when(F.col("in0").isNull(), F.lit(0).cast("long"))
    for depth, shift in enumerate((42, 21, 0), 1):
        prefix = F.shiftright("deep", shift)
        full = counts.groupBy(*region, prefix.alias("prefix")).agg(F.sum("c").alias(f"in{depth}")).where(F.col(f"in{depth}") > REGION)
        entries = entries.withColumn("prefix", prefix).join(_few(materialize(full, "full")), [*region, "prefix"], "left").drop("prefix")
        part = part.when(F.col(f"in{depth}").isNull(), F.xxhash64(F.lit(depth), prefix))
    salted = F.xxhash64("deep", F.pmod(F.xxhash64("rep", "tree"), F.floor(F.col("in3") / REGION) + 1))
    return entries.withColumn("part", part.otherwise(salted))


def neighbours(entries: DataFrame, similarity: float, crowded: DataFrame) -> DataFrame:
    """i, j, estimate: each document with the best of its neighbours in a tree; a row without j for one whose part reaches further."""
    cut = least_estimate(similarity)
    entries = entries.withColumn("part", F.lit(0).cast("long")) if crowded.isEmpty() else _deepened(entries, crowded)
    key = ["tree", "shallow", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            kept = 0 if before is None else len(before[0])
            if kept:
                cols = [np.concatenate([a, b]) for a, b in zip(before, cols)]
            before = [c[-NEIGHBOURS - 1 :] for c in cols]
            rep, size, sketch = cols[4], cols[5], np.stack([c.view(U8) for c in cols[6:]], axis=1)
            best, partner = np.zeros(len(rep)), np.zeros(len(rep), "i8")
            wide = np.zeros(len(rep), bool)
            at = np.arange(len(rep))
            for k in range(1, NEIGHBOURS + 2):
                at = at[at >= k]
                at = at[np.logical_and.reduce([c[at] == c[at - k] for c in cols[:3]])]
                i = at[at >= kept]
                j = i - k
                if k > NEIGHBOURS:
                    wide[i] = wide[j] = True
                    break
                d = sketch[i] ^ sketch[j]
                d = (d | (d >> U8(1))) & U8(0x5555555555555555)
                est = (1 - np.bitwise_count(d).sum(axis=1, dtype="i4") / VALUES - 0.25) / 0.75
                ok = (est >= cut) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
                i, j, est = i[ok], j[ok], est[ok]
                for a, b in ((i, j), (j, i)):
                    more = est > best[a]
                    best[a[more]], partner[a[more]] = est[more], rep[b[more]]
            some = np.flatnonzero(best > 0)
            none = int(wide.sum())
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(partner[some]), pa.array(best[some])], names=["i", "j", "estimate"])
            yield pa.RecordBatch.from_arrays([pa.array(rep[wide]), pa.nulls(none, pa.int64()), pa.nulls(none, pa.float64())], names=["i", "j", "estimate"])

    wanted = [*key, "deep", "rep", "n", "s0", "s1", "s2", "s3"]
    ordered = entries.select(*[F.col(c).cast("long") for c in wanted]).repartition(*key).sortWithinPartitions(*key, "deep", "rep")
    return ordered.mapInArrow(tidy(run), "i long, j long, estimate double")


def _dealt(rows: DataFrame, part: str) -> DataFrame:
    """Each row once for every task that compares its block with a block: the task's number as `part`, and side 1 in the second block.

    The row's group has `blocks` blocks from the number `first` on, of `total`; `alone`: they aren't compared with each other.
    """
    of = F.col("first") + F.pmod(F.xxhash64("rep", "tree"), F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("total") - 1), lambda o: ~F.col("alone") | (o < F.col("first")) | (o >= F.col("first") + F.col("blocks")))
    rows = rows.withColumn("block", of).withColumn("other", F.explode(others))
    rows = rows.withColumn(part, F.least("block", "other") * F.col("total") + F.greatest("block", "other"))
    return rows.withColumn("side", (F.col("block") > F.col("other")).cast("int"))


def _blocks(entries: DataFrame, crowded: DataFrame) -> DataFrame:
    """entries with part and side: crowded regions as tasks that together hold each pair of different components.

    A large component has blocks of its own, so none of its own pairs are visited.
    """
    region = ["tree", "shallow"]
    per = entries.join(_few(crowded.select(*region)), region, "left_semi").groupBy(*region, "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    large = per.where((F.col("c") >= max(2, REGION // 2)) | (F.col("w") >= SHINGLES // 2) & (F.col("c") > 1))
    large = materialize(large.withColumn("alone", F.lit(True)), "large")
    gone = large.groupBy(*region).agg(F.sum("c").alias("gone"), F.sum("w").alias("gone_w"))
    rest = crowded.join(gone, region, "left").select(*region, *[(F.col(x) - F.coalesce(y, F.lit(0))).alias(x) for x, y in (("c", "gone"), ("w", "gone_w"))])
    groups = large.unionByName(rest.where("c > 0").select(*region, F.lit(0).cast("long").alias("comp"), "c", "w", F.lit(False).alias("alone")))
    groups = groups.withColumn("blocks", F.floor(F.greatest(F.col("c") / REGION, F.col("w") / SHINGLES)) + 1)
    every = Window.partitionBy(*region)
    before = every.orderBy("alone", "comp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0))).withColumn("total", F.sum("blocks").over(every)).drop("c", "w")
    groups = materialize(groups, "groups")
    own = entries.join(_few(large.select(*region, "comp", "alone")), [*region, "comp"], "left").withColumn("alone", F.coalesce("alone", F.lit(False)))
    own = own.withColumn("own", F.when(F.col("alone"), F.col("comp")).otherwise(F.lit(0).cast("long")))
    own = own.join(_few(groups.withColumnRenamed("comp", "own")), [*region, "alone", "own"], "left")
    one = own.select(*[F.coalesce(c, F.lit(v)).cast("long").alias(c) for c, v in (("blocks", 1), ("first", 0), ("total", 1))], "alone", *entries.columns)
    return _dealt(one, "part")


def candidates(entries: DataFrame, similarity: float, crowded: DataFrame) -> DataFrame:
    """i, j from entries (tree, shallow, rep, comp, n, s0..s3): the FEW best partners of each i in a task.

    Rows without j tell the members of tasks (tree, shallow, part, side) where that isn't all.
    """
    cut = least_estimate(similarity)
    region = ["tree", "shallow", "part"]
    if crowded.isEmpty():
        entries = entries.withColumn("part", F.lit(0)).withColumn("side", F.lit(0))
    else:
        entries = _blocks(entries, crowded)
    names = ["i", "j", *region, "side"]
    wanted = [*region, "side", "rep", "comp", "n", "s0", "s1", "s2", "s3"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def done(cols):
            key = np.stack(cols[:3], axis=1)
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]]))
            sketch = np.stack([c.view(U8) for c in cols[7:]], axis=1)
            found, crowds = [], []
            for lo, hi in zip(new[:-1][np.diff(new) > 1], new[1:][np.diff(new) > 1]):
                left = int((cols[3][lo:hi] == 0).sum())
                got, crowd = _region_candidates(cols[4][lo:hi], cols[5][lo:hi], cols[6][lo:hi], sketch[lo:hi], left, cut, similarity)
                found.append(got)
                crowds.append(lo + crowd)
            if not found:
                return None
            i, j = [np.concatenate(x) for x in zip(*found)]
            crowd = np.concatenate(crowds)
            none = pa.nulls(len(i), pa.int64())
            pairs = pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), none, none, none, none], names=names)
            gone = pa.nulls(len(crowd), pa.int64())
            members = pa.RecordBatch.from_arrays([pa.array(cols[4][crowd]), gone, *(pa.array(c[crowd]) for c in cols[:4])], names=names)
            return pa.Table.from_batches([pairs, members]).combine_chunks()

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)]
            if not len(cols[0]):
                continue
            key = np.stack(cols[:3], axis=1)
            last = np.flatnonzero((key != key[-1]).any(axis=1))
            at = last[-1] + 1 if len(last) else 0
            rest = [c[at:] for c in cols]
            if at and (out := done([c[:at] for c in cols])) is not None:
                yield from out.to_batches(max_chunksize=100_000)
        if rest is not None and (out := done(rest)) is not None:
            yield from out.to_batches(max_chunksize=100_000)

    ordered = entries.select(*[F.col(c).cast("long") for c in wanted]).repartition(*region).sortWithinPartitions(*region, "side", "rep")
    return ordered.mapInArrow(tidy(run), ", ".join(f"{n} long" for n in names))


def _full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """rep, shingles (the whole sorted set) of the documents with those ids."""
    wanted = docs.select("doc_id", "text").join(_few(ids), F.col("doc_id") == F.col("rep"), "left_semi")

    def run(texts: list[str | None]) -> list:
        return [[shingle_set(t, size).tobytes() for t in texts]]

    return add_columns(wanted, "text", "shingles binary", run).select(F.col("doc_id").cast("long").alias("rep"), "shingles").dropDuplicates(["rep", "shingles"])


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose full sets reach the similarity (in hundredths, by whole numbers)."""
    hundredths = round(100 * similarity)
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), U8), np.frombuffer(y.as_buffer(), U8)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= hundredths * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def _confirm_in_place(members: DataFrame, comps: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links a, b between different components among the members (i) of each task of candidates(), found on full sets."""
    hundredths = round(100 * similarity)
    region = ["tree", "shallow", "part"]
    rows = members.select(*region, "side", F.col("i").alias("rep")).join(comps.withColumnRenamed("node", "rep"), "rep", "left").join(sets, "rep")
    rows = rows.select(*region, "side", "rep", F.coalesce("component", "rep").alias("comp"), "shingles")

    def links(side, rep, comp, held) -> Iterator[tuple[int, int]]:
        sizes = np.array([len(x) for x in held])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ids = np.unique(np.concatenate(held), return_inverse=True)[1]
        mark = np.zeros(int(ids.max()) + 1, "i4")
        left = int((side == 0).sum()) % len(rep)  # 0: one block with itself
        for i in range(left or 1, len(rep)):
            n = left or i
            own = ids[starts[i] : starts[i] + sizes[i]]
            mark[own] = 1
            common = np.add.reduceat(mark[ids[: starts[n]]], starts[:n])
            mark[own] = 0
            hit = np.flatnonzero((100 * common >= hundredths * (sizes[i] + sizes[:n] - common)) & (comp[:n] != comp[i]))
            for j in hit:
                if comp[j] != comp[i]:  # one link joins two components
                    yield rep[i], rep[j]
                    comp[comp == comp[j]] = comp[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(group) -> pa.RecordBatch:
            found = list(links(*(np.array([g[k] for g in group]) for k in range(3)), [np.frombuffer(g[3], U8) for g in group]))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        key, group = None, []
        for batch in batches:
            for *k, side, rep, comp, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key and group:
                    yield done(group)
                    group = []
                key = k
                group.append((side, rep, comp, shingles))
        if group:
            yield done(group)

    return rows.repartition(*region).sortWithinPartitions(*region, "side", "rep").mapInArrow(tidy(run), "a long, b long")


def _shared_ids(made: DataFrame, reps: DataFrame) -> DataFrame:
    """Links a, b from a text's representative to an id of several texts, for each of its texts: they are one node."""
    rows = made.where("n_shingles > 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("b"), "digest")
    short = F.xxhash64("digest")  # numbers, so that Spark adds up by hashing instead of sorting
    several = rows.groupBy("b").agg(F.min(short).alias("least"), F.max(short).alias("most")).where("least <> most").select("b")
    texts = rows.join(_few(materialize(several, "shared")), "b", "left_semi").distinct()
    return texts.join(reps.select("digest", F.col("rep").alias("a")), "digest").where("a <> b").select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and kept (is that id)."""
    made = materialize(features(docs, size), "features")
    reps = (
        made.where("n_shingles > 0 and doc_id is not null")
        .groupBy("digest")
        .agg(F.min(F.col("doc_id").cast("long")).alias("rep"), F.first("n_shingles").alias("n"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch"))
    )
    reps = materialize(reps, "representatives")

    def entries(of: DataFrame) -> DataFrame:
        each = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.get("labels", 2 * t).alias("shallow"), F.get("labels", 2 * t + 1).alias("deep")))
        return of.select("rep", "comp", "n", *[F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(4)], F.explode(each).alias("e")).select("e.*", "rep", "comp", "n", "s0", "s1", "s2", "s3")

    pair = [F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")]
    each = entries(reps.withColumn("comp", F.col("rep")))
    crowded = crowded_regions(each)
    first = materialize(neighbours(each, similarity, crowded).groupBy("i").agg(F.max_by("j", "estimate").alias("j"), F.max(F.col("j").isNull()).alias("wide")), "first")
    best = first.where("j is not null")
    involved = materialize(best.select(F.col("i").alias("rep")).union(best.select(F.col("j").alias("rep"))).distinct(), "involved")
    held = [materialize(_full_sets(docs, involved, size), "sets")]
    sets = held[0]
    tested = materialize(best.select(*pair).distinct(), "pairs")
    links = materialize(_confirm(tested, sets, similarity).select("a", "b").union(_shared_ids(made, reps)), "confirmed")
    comps = components(links)
    # back up: whole regions, for those that found a partner and those that didn't meet all of their region
    again = involved.union(first.where("wide").select(F.col("i").alias("rep")))
    if not crowded.isEmpty():
        again = again.union(each.join(_few(crowded.select("tree", "shallow")), ["tree", "shallow"], "left_semi").select("rep"))
    again = materialize(again.distinct(), "again")
    active = materialize(reps.join(_few(again), "rep", "left_semi"), "active")
    now = active.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    more = materialize(candidates(entries(now), similarity, crowded), "candidates")
    late = more.select(F.col("i").alias("rep")).union(more.where("j is not null").select("j")).distinct().join(involved, "rep", "left_anti")
    late = materialize(late, "late")
    if not late.isEmpty():
        held.append(materialize(_full_sets(docs, late, size), "sets"))
        sets = sets.union(held[1])
    members = more.where("j is null")
    apart = more.where("j is not null").select(*pair).distinct().join(tested, ["a", "b"], "left_anti")
    added = materialize(_confirm(apart, sets, similarity).union(_confirm_in_place(members, comps, sets, similarity)), "confirmed")
    if not added.isEmpty():
        comps = components(links.union(added))
    discard(*held, first, involved, tested, links, again, active, more, late, added, crowded)
    of_set = reps.select("digest", "rep").join(comps, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = made.select("doc_id", "n_shingles", "digest").join(of_set, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id").cast("long"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
