"""Substring dedup: removes every word inside a window of words that also occurs elsewhere.

1. Each window of `size` words has an anchor, the gram of ANCHOR words in it with the smallest hash.
   Equal windows have equal anchors, so windows that could be equal are found under one anchor. The
   windows that share one anchor place in a document are one segment (at most 24 windows, 58 words).
2. Anchors that occur once in the corpus are dropped; no window under them can repeat. Equal segments
   (by hash of anchor and words) fall together and keep two copies at most.
3. The distinct segments are dealt into shards by anchor. A shard becomes a compressed FM-index, and its
   segments are streamed through it by backward search over the wavelet matrix: matching statistics
   give, from each end, how far to the left the words still occur twice. Every window inside such a
   stretch is a repeat. The windows of an anchor with more than CROWD distinct segments are counted
   one by one instead: equal ones are added up before the shuffle, so a passage that very many
   documents share is one row for each window, and the result goes back to their segments.
4. The repeats go back to all places of their segment, and each document drops the words they cover.

Segments carry the words themselves to the index, so it compares words. Only equal segments are told by
hashes alone, by those of their anchor and of all their words (64 bits each): two different segments
would have to agree in both. A row is known by its id and two hashes of its text (64 and 32 bits).

Defined results: a null or empty text has no words; windows never span documents; a document shorter
than a window keeps all; repeated rows, also of one id, are documents of their own, so both lose what
they share; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import discard, materialize, tidy
from lumenloom.llm.fm_index import FMIndex
from lumenloom.llm.minhash import U8, _mix, _signed, powers_upto, word_hashes

SIZE, ANCHOR = 35, 12
CROWD = 2000
#: Words that one FM-index takes, more only to keep an anchor whole.
SHARD_WORDS = 400_000
BROADCAST_ROWS = 200_000


def segments(words: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """anchor, segment hash, first window and number of windows of each segment of one document."""
    n = len(words) - size + 1
    if n <= 0:
        return (np.zeros(0, U8),) * 2 + (np.zeros(0, "i8"),) * 2
    g = np.zeros(len(words) - gram + 1, U8)
    for i in range(gram):
        g = (g + words[i : i + len(g)]) * U8(0xD6E8FEB86659FD93)
        g ^= g >> U8(32)
    g = _mix(g)
    reach = size - gram + 1
    place = np.arange(n) + np.lib.stride_tricks.sliding_window_view(g, reach).argmin(axis=1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    powers, inverse = powers_upto(len(words) + 1)
    sums = np.concatenate([np.zeros(1, U8), np.cumsum(words * powers[: len(words)], dtype=U8)])
    ends = first + count + size - 1
    own = (sums[ends] - sums[first]) * inverse[first] + (count * 1000 + place[first] - first).astype(U8)
    return g[place[first]], _mix(own), first, count


def _places(rows: DataFrame, size: int, gram: int) -> DataFrame:
    """d, h, c, anchor, segment, pos, windows: every segment of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, of = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    found.append(segments(word_hashes(text, lower=False), size, gram))
                    of.append(np.full(len(found[-1][0]), i))
            if not found:
                continue
            anchor, seg, first, count = [np.concatenate(x) for x in zip(*found)]
            take = pa.array(np.concatenate(of))
            cols = [*(batch.column(k).take(take) for k in ("d", "h", "c")), *(pa.array(c) for c in (_signed(anchor), _signed(seg), first.astype("i4"), count.astype("i4")))]
            yield pa.RecordBatch.from_arrays(cols, names=["d", "h", "c", "anchor", "segment", "pos", "windows"])

    return rows.mapInArrow(tidy(run), "d long, h long, c int, anchor long, segment long, pos int, windows int")


def _words_of(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """anchor, part, segment, off, copies, words: the words of each distinct segment, read from one place of it.

    Of crowded anchors each window is a row, with its hash as part; part is null for the rest."""
    lists = wanted.groupBy("d", "h", "c").agg(F.collect_list(F.struct("anchor", "segment", "pos", "windows", "copies", "crowded")).alias("list"))
    both = rows.join(lists, ["d", "h", "c"]).select("text", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "part", "segment", "off", "copies", "words"]
        for batch in batches:
            out = []
            for text, items in zip(batch.column("text").to_pylist(), batch.column("list").to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                for x in items:
                    at, n = x["pos"], x["windows"]
                    if x["crowded"]:
                        for k in range(n):
                            window = b" ".join(words[at + k : at + k + size])
                            part = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
                            out.append((x["anchor"], part, x["segment"], k, x["copies"], window))
                    else:
                        out.append((x["anchor"], None, x["segment"], 0, x["copies"], b" ".join(words[at : at + n + size - 1])))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    return both.mapInArrow(tidy(run), "anchor long, part long, segment long, off int, copies int, words binary").dropDuplicates(["anchor", "part", "segment", "off"])


def repeats(sequences: list[list[bytes]], copies: list[int], size: int) -> list[int]:
    """For each sequence, bits that tell which of its windows occur twice or more among all (with their copies)."""
    flat = np.array([w for s in sequences for w in s], dtype=object)
    ids = {w: i + 1 for i, w in enumerate(dict.fromkeys(flat))}
    widest = max(map(len, sequences))
    padded = np.zeros((len(sequences), widest + 1), "i8")
    for i, s in enumerate(sequences):
        padded[i, : len(s)] = [ids[w] for w in s]
    ends = np.array([len(s) for s in sequences])
    held = np.repeat(np.arange(len(sequences)), np.minimum(copies, 2))
    keep = np.arange(widest + 1)[None, :] <= ends[held, None]  # each sequence and one separator
    index = FMIndex(padded[held][keep], len(ids) + 1, widest + 2)
    masks = np.zeros(len(sequences), "i8")
    open_ = np.arange(len(sequences))
    end = ends.copy()
    while len(open_):
        length = index.longest_repeats(padded[open_], end[open_])
        e = end[open_]
        # windows that start in [e - length, e - size] are repeats; the next unsettled one starts just left of them
        low, high = e - length, e - size
        found = length >= size
        masks[open_[found]] |= (np.int64(1) << (high[found] + 1)) - (np.int64(1) << low[found])
        end[open_] = np.where(found, low - 1 + size, e - 1)
        open_ = open_[end[open_] >= size]
    return masks.tolist()


def _shards(words: DataFrame, size: int) -> DataFrame:
    """anchor, segment, mask (bit k: window k of the segment is a repeat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            masks = repeats([r[5].split() for r in rows], [r[4] for r in rows], size)
            hit = [(r[0], r[2], m) for r, m in zip(rows, masks) if m]
            return pa.RecordBatch.from_arrays([pa.array([h[i] for h in hit], pa.int64()) for i in range(3)], names=["anchor", "segment", "mask"])

        rows, n = [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if n >= SHARD_WORDS and r[0] != rows[-1][0]:
                    yield done(rows)
                    rows, n = [], 0
                rows.append(r)
                n += min(r[4], 2) * (r[5].count(b" ") + 2)
        if rows:
            yield done(rows)

    ordered = words.repartition("anchor").sortWithinPartitions("anchor", "segment")
    return ordered.mapInArrow(tidy(run), "anchor long, segment long, mask long")


def _counted(windows: DataFrame) -> DataFrame:
    """anchor, segment, mask from single windows: those whose words occur twice or more."""
    key = ["anchor", "part"]
    equal = windows.groupBy(*key, "words").agg(F.sum("copies").alias("copies"))
    kinds = materialize(equal.groupBy(*key).agg(F.count("*").alias("kinds"), F.max("copies").alias("copies")).where("kinds > 1 or copies > 1"), "windows")
    again = kinds.where("kinds = 1").select(*key)
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    hits = windows.join(again, key, "left_semi").select("anchor", "segment", "off")
    clash = kinds.where("kinds > 1").select(*key)  # different words with one hash
    if not clash.isEmpty():
        within = windows.join(clash, key, "left_semi")
        of = within.groupBy(*key, "words").agg(F.sum("copies").alias("n")).where("n > 1").select(*key, "words")
        hits = hits.union(within.join(of, [*key, "words"], "left_semi").select("anchor", "segment", "off"))
    return hits.groupBy("anchor", "segment").agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("mask"))


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the text that is left, words joined by one space)."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("h"), F.hash("text").alias("c"))
    read = rows.select("d", "h", "c", "text")
    every = materialize(_places(read, size, gram), "segments")
    shared = every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    places = materialize(every.join(shared, "anchor"), "places")
    discard(every)
    distinct = places.groupBy("anchor", "segment").agg(F.count("*").cast("int").alias("copies"), F.min(F.struct("d", "h", "c", "pos", "windows")).alias("one"))
    distinct = distinct.select("anchor", "segment", "copies", "one.*")
    distinct = materialize(distinct, "segments")
    crowds = materialize(distinct.groupBy("anchor").count().where(F.col("count") > CROWD).select("anchor", F.lit(True).alias("crowded")), "crowds")
    n_crowds = crowds.count()
    few = F.broadcast(crowds) if n_crowds <= BROADCAST_ROWS else crowds
    wanted = distinct.join(few, "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    words = _words_of(read, wanted, size)
    if n_crowds:
        words = materialize(words, "words")
        masks = materialize(_shards(words.where("part is null"), size).union(_counted(words.where("part is not null"))), "masks")
        discard(words)
    else:
        masks = materialize(_shards(words, size), "masks")
    hits = places.join(masks, ["anchor", "segment"]).groupBy("d", "h", "c").agg(F.collect_set(F.struct("pos", "mask")).alias("hits"))
    both = rows.join(hits, ["d", "h", "c"], "left").select("doc_id", "text", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digest, kept = [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                total.append(len(words))
                if found:
                    step = np.zeros(len(words) + 1, "i4")
                    for x in found:
                        at = x["pos"] + np.flatnonzero([x["mask"] >> k & 1 for k in range(x["mask"].bit_length())])
                        np.add.at(step, at, 1)
                        np.add.at(step, at + size, -1)
                    words = [w for w, c in zip(words, np.cumsum(step).tolist()) if not c]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
                digest.append(hashlib.sha256(kept[-1]).hexdigest())
            cols = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest), pa.array([k.decode("utf-8", "surrogatepass") for k in kept])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return both.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string, kept string")
