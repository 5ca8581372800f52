"""Near-duplicate embeddings: exact threshold pairs by dual traversal of cover trees.

On the unit sphere cosine >= c is distance <= sqrt(2 - 2c), so the triangle inequality holds.

1. Vectors are scaled by a power of two, which is exact; equal ones fall together, and one stands for all.
2. The top of the tree is a net: pivots chosen farthest first from a sample with a few vectors for each
   block (collected: a few hundred bytes each). Every vector goes to its nearest pivot. A cell of up to
   `block` vectors is one block; a larger one is cut into shells of halving radii, and a shell that is
   still too large by a hash. Two blocks that lie wholly inside the threshold are counted as they are.
3. Each block becomes a cover tree once: nested levels of nets with halving radii, as long as a net
   holds clearly fewer nodes than vectors. Vectors carry their nodes' numbers from there on.
4. Each two blocks that can hold a link meet once. A block is host to half of the others, VISITS of them
   in one task; a vector goes there only if it is close enough to the other block. Both trees are
   descended level by level: node pairs further apart than their covering radii and the threshold are
   dropped, those wholly inside it are counted, the rest is opened, and vectors are compared at the
   bottom, by products in single precision. What lies within the error bound of these is decided by
   the plain cosine in double precision.
5. A meeting returns, for each vector, its number of links, and the links that join components there:
   a cluster of thousands costs rows in its size, not in its pairs.

Work: where vectors have no structure (distances all alike) no covering radius can prune, and every
block meets every other one, as in any exact method: then the work is half a matrix product of all
vectors with each other, in even tasks.

Defined results: null vectors, empty or zero ones, and those with null or non-finite components link
with nothing, and neither do vectors of different lengths; equal vectors link with each other; a cosine
of exactly the threshold links; rows that share an id have links of their own, but are one node in the
components, except those that link with nothing, which are their own; a null id gets no links, a null component and isn't kept; an empty table gives an empty
table; other columns are ignored, labels too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import discard, materialize, tidy
from lumenloom.llm.components import components

BLOCK, SMALL_BLOCK = 8192, 1024
#: Blocks that the vectors are dealt into at least, as far as blocks of SMALL_BLOCK vectors allow.
SPREAD = 12
#: Other blocks that meet a host in one task.
VISITS = 4
#: Nodes with fewer vectors aren't split any further, and neither are those below the smallest radius.
LEAF, SMALLEST = 16, 0.02
#: Sampled vectors for each pivot.
DRAWS = 4
SHELLS = 6
MOST_PARTITIONS = 20_000
#: Ids of several vectors up to this number are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 200_000
SLACK = 1e-9


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def _farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """The n points chosen one by one, each furthest from those before it (fewer if points run out)."""
    chosen, far = [0], _distances(points, points[:1])[:, 0]
    while len(chosen) < n and far.max() > SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def _net(points: np.ndarray, radius: float) -> np.ndarray | None:
    """Greedy net: for each point the number of a centre that covers it; None if most points would be centres."""
    owner, n = np.full(len(points), -1), 0
    left = np.arange(len(points))
    while len(left):
        batch = left[:256]
        near = _distances(points[batch], points[batch]) <= radius
        chosen, covered = [], np.zeros(len(batch), bool)
        for i in range(len(batch)):
            if not covered[i]:
                chosen.append(batch[i])
                covered |= near[i]
        close = _distances(points[left], points[chosen])
        best = close.argmin(axis=1)
        inside = close[np.arange(len(left)), best] <= radius
        inside[: len(batch)] = True
        owner[left[inside]] = n + best[inside]
        owner[chosen] = n + np.arange(len(chosen))
        n += len(chosen)
        if 2 * n > (owner >= 0).sum():
            return None
        left = left[owner[left] < 0]
    return owner


def cover_tree(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the vectors in which each node is an interval, and in that order their nodes' numbers by level."""
    order, paths, number = [], [], 0
    stack = [(np.arange(len(unit)), 1.0, ())]
    while stack:
        members, radius, path = stack.pop()
        path, number = (*path, number), number + 1
        owner = None
        while len(members) > LEAF and radius >= SMALLEST:
            owner = _net(unit[members], radius)
            radius /= 2
            if owner is None or owner.max() > 0:
                break
        if owner is None or owner.max() == 0:
            order.append(members)
            paths.extend([path] * len(members))
            continue
        sizes = np.bincount(owner)
        for k in np.flatnonzero(sizes > 1):
            stack.append((members[owner == k], radius, path))
        single = members[sizes[owner] == 1]  # these cover nothing but themselves and stay together
        if len(single):
            order.append(single)
            paths.extend([(*path, number)] * len(single))
            number += 1
    deep = max(map(len, paths), default=1)
    return np.concatenate(order), np.array([p + p[-1:] * (deep - len(p)) for p in paths], "i4")


@dataclass
class Level:
    """The nodes of one level: intervals of vectors, centres and covering radii."""

    starts: np.ndarray
    ends: np.ndarray
    centre: np.ndarray
    radius: np.ndarray


def _levels(unit: np.ndarray, paths: np.ndarray) -> list[Level]:
    out: list[Level] = []
    for k in range(paths.shape[1]):
        starts = np.flatnonzero(np.concatenate([[True], paths[1:, k] != paths[:-1, k]]))
        if out and len(starts) == len(out[-1].starts):
            continue
        ends = np.append(starts[1:], len(unit))
        centre = np.add.reduceat(unit, starts) / (ends - starts)[:, None]
        off = unit - np.repeat(centre, ends - starts, axis=0)
        out.append(Level(starts, ends, centre, np.sqrt(np.maximum.reduceat((off * off).sum(axis=1), starts)) + SLACK))
    return out


class Block:
    def __init__(self, v: np.ndarray, weight: np.ndarray, paths: np.ndarray) -> None:
        self.v, self.weight = v, weight
        unit = _unit(v)
        self.single, self.levels = unit.astype("f4"), _levels(unit, paths)


def _children(levels: list[Level], depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of the nodes below `nodes`; a node of the last level stays itself."""
    if depth + 1 >= len(levels):
        return nodes, np.ones(len(nodes), "i8")
    level, below = levels[depth], levels[depth + 1]
    first = np.searchsorted(below.starts, level.starts[nodes])
    return first, np.searchsorted(below.starts, level.ends[nodes]) - first


class Meeting:
    """Links between two blocks, or within one; counts are weighted by the copies each vector stands for."""

    def __init__(self, x: Block, y: Block, cosine: float) -> None:
        self.x, self.y, self.cosine, self.same = x, y, cosine, x is y
        self.reach = float(np.sqrt(2 - 2 * cosine))
        self.error = (x.v.shape[1] + 8) * 6e-8  # of a product in single precision
        self.nx, self.ny = np.zeros(len(x.v), "i8"), np.zeros(len(y.v), "i8")
        self.label = np.arange(len(x.v) + (0 if self.same else len(y.v)))
        self.links: list[tuple[int, int]] = []
        self._descend()

    def _join(self, i: int, js: np.ndarray) -> None:
        """Puts row i and the columns js into one component and keeps the links that this takes."""
        at = js if self.same else js + len(self.x.v)
        labels, first = np.unique(self.label[at], return_index=True)
        new = labels != self.label[i]
        if new.any():
            every = np.append(labels, self.label[i])
            self.label[np.isin(self.label, every)] = every.min()
            self.links.extend((i, int(j)) for j in js[first[new]])

    def _compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """Vectors in the rows a against those in the rows b."""
        for at in range(0, len(a), 1024):
            rows = a[at : at + 1024]
            score = self.x.single[rows] @ self.y.single[b].T
            hit = score >= self.cosine - self.error
            if self.same:
                hit &= rows[:, None] < b[None, :]
            some = np.flatnonzero(hit.any(axis=1))
            if not len(some):
                continue
            rows, hit, score = rows[some], hit[some], score[some]
            i, j = np.nonzero(hit & (score <= self.cosine + self.error))
            for lo in range(0, len(i), 50_000):
                p, q = self.x.v[rows[i[lo : lo + 50_000]]], self.y.v[b[j[lo : lo + 50_000]]]
                plain = (p * q).sum(axis=1) / np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1))
                hit[i[lo : lo + 50_000], j[lo : lo + 50_000]] = plain >= self.cosine
            self.nx[rows] += hit @ self.y.weight[b]
            self.ny[b] += self.x.weight[rows] @ hit
            for k in np.flatnonzero(hit.any(axis=1)):
                self._join(rows[k], b[hit[k]])

    def _all(self, a: np.ndarray, b: np.ndarray, one: bool) -> None:
        """All vectors in a link with all in b; one: a and b are one node."""
        self.nx[a] += self.y.weight[b].sum() - (self.x.weight[a] if one else 0)
        if not one:
            self.ny[b] += self.x.weight[a].sum()
        self._join(a[0], b[1:] if one else b)
        for i in [] if one else a[1:]:
            self._join(i, b[:1])

    def _descend(self) -> None:
        x, y = self.x.levels, self.y.levels
        i = j = np.zeros(1, "i8")
        bottom: list[tuple] = []
        for depth in range(max(len(x), len(y))):
            a, b = x[min(depth, len(x) - 1)], y[min(depth, len(y) - 1)]
            off = a.centre[i] - b.centre[j]
            far, radii = np.sqrt((off * off).sum(axis=1)), a.radius[i] + b.radius[j]
            whole = far + radii <= self.reach - SLACK
            for k in np.flatnonzero(whole):
                left, right = np.arange(a.starts[i[k]], a.ends[i[k]]), np.arange(b.starts[j[k]], b.ends[j[k]])
                self._all(left, right, self.same and i[k] == j[k])
            open_ = ~whole & (far <= radii + self.reach + SLACK)
            i, j = i[open_], j[open_]
            (first_a, n_a), (first_b, n_b) = _children(x, depth, i), _children(y, depth, j)
            pairs = (a.ends[i] - a.starts[i]) * (b.ends[j] - b.starts[j])
            end = (n_a * n_b == 1) & (depth + 1 >= len(x)) & (depth + 1 >= len(y)) | (n_a * n_b * 256 > pairs)
            bottom.append((a.starts[i[end]], a.ends[i[end]], b.starts[j[end]], b.ends[j[end]]))
            first_a, n_a, first_b, n_b = (z[~end] for z in (first_a, n_a, first_b, n_b))
            of = np.repeat(np.arange(len(n_a)), n_a * n_b)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n_a * n_b) - n_a * n_b, n_a * n_b)
            i, j = first_a[of] + at // n_b[of], first_b[of] + at % n_b[of]
            if self.same:
                i, j = i[i <= j], j[i <= j]
        starts, ends, lows, highs = (np.concatenate(z) for z in zip(*bottom))
        order = np.lexsort((lows, ends, starts))
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(starts[order]) + np.diff(ends[order]) != 0, [True]])) if len(order) else []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            same_rows = order[lo:hi]
            columns = np.concatenate([np.arange(lows[k], highs[k]) for k in same_rows])
            self._compare(np.arange(starts[same_rows[0]], ends[same_rows[0]]), columns)


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, v (bytes of the vector times a power of two, null if it has none), dim, digest."""
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("f8")
        sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], "i8")
        ends = np.cumsum(sizes)
        out, digest = [], []
        for n, e in zip(sizes.tolist(), ends.tolist()):
            v = flat[e - n : e]
            most = np.abs(v).max() if n else 0.0
            if n and np.isfinite(most) and most > 0:
                raw = (np.ldexp(v, -int(np.frexp(most)[1])) + 0.0).tobytes()  # + 0.0: no negative zero
                out.append(raw)
                digest.append(hashlib.blake2b(raw, digest_size=16).digest())
            else:
                out.append(None)
                digest.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary())], names=["vec_id", "v", "dim", "digest"])


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(b, "f8") for b in column.to_pylist()])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each value of the key columns, which must come in order, as one table."""
    parts, last = [], None
    for batch in batches:
        cols = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        if not len(cols):
            continue
        new = np.flatnonzero(np.concatenate([[True], (cols[1:] != cols[:-1]).any(axis=1)]))
        for lo, hi in zip(new, [*new[1:], len(cols)]):
            key = tuple(cols[lo])
            if parts and key != last:
                yield pa.Table.from_batches(parts).combine_chunks()
                parts = []
            last = key
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


@dataclass
class Cells:
    """The blocks of all vectors: for each length the pivots, and for each cell and shell its blocks' first number, their number and radius."""

    pivots: dict[int, np.ndarray]
    shells: dict[tuple[int, int, int], tuple[int, int, float]]
    blocks: int

    def centres(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centre, radius and number of each block of vectors of that length."""
        of = [(c, r, b) for (d, c, _), (first, n, r) in self.shells.items() if d == dim for b in range(first, first + n)]
        cell, radius, block = zip(*of)
        return self.pivots[dim][list(cell)], np.array(radius), np.array(block)


def _shell(far: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(-np.log2(np.maximum(far, 1e-12))), 0, SHELLS).astype("i8")


def _dealt(reps: DataFrame, block: int) -> tuple[DataFrame, Cells]:
    """reps with the number of their block, and what blocks there are."""
    sizes = {dim: n for dim, n in reps.groupBy("dim").count().collect()}
    wide = {dim: max(min(block, SMALL_BLOCK), min(block, -(-n // SPREAD))) for dim, n in sizes.items()}
    drawn: dict[int, list[np.ndarray]] = {}
    draw = F.pmod(F.xxhash64("digest"), F.lit(min(wide.values(), default=1))) < DRAWS
    for r in reps.where(draw).select("dim", "v").union(reps.groupBy("dim").agg(F.min("v"))).collect():
        drawn.setdefault(r.dim, []).append(np.frombuffer(r.v, "f8"))
    pivots = {}
    for dim, found in drawn.items():
        points = np.unique(np.stack(found), axis=0)  # in an order of their own
        pivots[dim] = _farthest_first(_unit(points), -(-sizes[dim] // wide[dim]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell, far = np.zeros(len(dims), "i8"), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                u = _unit(_matrix(batch.column("v").take(pa.array(at))))
                cell[at] = (u @ pivots[int(dim)].T).argmax(axis=1)
                off = u - pivots[int(dim)][cell[at]]
                far[at] = np.sqrt((off * off).sum(axis=1))
            cols = [*batch.columns, pa.array(cell), pa.array(_shell(far)), pa.array(far)]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "cell", "shell", "far"])

    placed = materialize(reps.select("node", "rep", "copies", "v", "dim").mapInArrow(tidy(assign), "node long, rep long, copies long, v binary, dim long, cell long, shell long, far double"), "placed")
    held: dict[tuple[int, int], list] = {}
    for dim, cell, shell, n, radius in placed.groupBy("dim", "cell", "shell").agg(F.count("*"), F.max("far")).collect():
        held.setdefault((dim, cell), []).append((shell, n, radius))
    shells, number = {}, 0
    for (dim, cell), parts in sorted(held.items()):
        if (n := sum(p[1] for p in parts)) <= wide[dim]:
            parts = [(-1, n, max(p[2] for p in parts))]
        for shell, n, radius in sorted(parts):
            cuts = -(-n // wide[dim])
            shells[dim, cell, shell] = (number, cuts, radius + SLACK)
            number += cuts

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for dim, cell, shell, node in zip(*(batch.column(c).to_pylist() for c in ("dim", "cell", "shell", "node"))):
                first, cuts, _ = shells.get((dim, cell, -1)) or shells[dim, cell, shell]
                own.append(first + (node * 0x9E3779B97F4A7C15 % (1 << 64) >> 32) % cuts)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *(batch.column(c) for c in ("node", "rep", "copies", "v", "dim"))], names=["block", "node", "rep", "copies", "v", "dim"])

    return placed.mapInArrow(tidy(name), "block long, node long, rep long, copies long, v binary, dim long"), Cells(pivots, shells, number)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's vectors in the order of its cover tree, with their place and their nodes by level."""
    for rows in _runs(batches, ["block"]):
        order, paths = cover_tree(_unit(_matrix(rows.column("v"))))
        rows = rows.take(pa.array(order)).append_column("place", pa.array(np.arange(len(order), dtype="i4")))
        nodes = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype="i4") * paths.shape[1]), pa.array(paths.ravel()))
        yield from rows.append_column("nodes", nodes).to_batches(max_chunksize=10_000)


def _inside(cells: Cells, trees: DataFrame, reach: float) -> dict[int, list[tuple[int, int, int]]]:
    """For each block the blocks all whose vectors link with all of its own: number, weight (copies) and smallest id."""
    pairs: dict[int, list[int]] = {}
    for dim in cells.pivots:
        centre, radius, block = cells.centres(dim)
        for k in np.flatnonzero(radius < reach):
            off = centre - centre[k]
            near = np.sqrt((off * off).sum(axis=1)) + radius + radius[k] <= reach - SLACK
            if near.any():
                pairs[int(block[k])] = block[near].tolist()
    if not pairs:
        return {}
    held = {b: (b, w, r) for b, w, r in trees.where(F.col("block").isin(list(pairs))).groupBy("block").agg(F.sum("copies"), F.min("rep")).collect()}
    return {b: [held[o] for o in others if o in held] for b, others in pairs.items()}


def _shared_ids(units: DataFrame, reps: DataFrame) -> DataFrame:
    """Links a, b from a vector's representative to an id of several vectors, for each of its vectors: they are one node."""
    rows = units.where("digest is not null and vec_id is not null").select(F.col("vec_id").alias("b"), "digest", "dim")
    kind = F.struct("digest", "dim")
    several = materialize(rows.groupBy("b").agg(F.min(kind).alias("least"), F.max(kind).alias("most")).where("least <> most").select("b"), "shared")
    several = F.broadcast(several) if several.count() <= BROADCAST_IDS else several
    return rows.join(several, "b", "left_semi").distinct().join(reps.select("digest", "dim", F.col("rep").alias("a")), ["digest", "dim"]).where("a <> b").select("a", "b")


def linked_vectors(vectors: DataFrame, cosine: float = 0.9, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable) and kept, from vec_id and embedding."""
    reach = float(np.sqrt(2 - 2 * cosine))
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = materialize(plain.mapInArrow(tidy(_scaled), "vec_id long, v binary, dim long, digest binary"), "units")
    reps = units.where("digest is not null and vec_id is not null").groupBy("digest", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "representatives")
    dealt, cells = _dealt(reps, block)
    kinds = "block long, node long, rep long, copies long, v binary, dim long, place int, nodes array<int>"
    trees = materialize(dealt.repartition("block").sortWithinPartitions("block", "node").mapInArrow(tidy(_trees), kinds), "trees")
    inside = _inside(cells, trees, reach)
    blocks, groups = cells.blocks, -(-(cells.blocks // 2 + 1) // VISITS)
    partitions = max(1, min(blocks * groups, MOST_PARTITIONS))

    geometry = {dim: cells.centres(dim) for dim in cells.pivots}
    settled: dict[int, list[int]] = {}  # for each block those that are counted as a whole
    for b, others in inside.items():
        for other, _, _ in others:
            settled.setdefault(other, []).append(b)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once for every task that it takes part in, as the host's (guest 0) or as a guest's."""
        names = ["part", "task", "guest", "node", "rep", "copies", "v", "place", "nodes"]
        step = max(1, 50_000 // max(1, blocks))
        for batch in (whole.slice(lo, step) for whole in batches for lo in range(0, len(whole), step)):
            own, dims = batch.column("block").to_numpy(), batch.column("dim").to_numpy()
            row, task, guest = [], [], []
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                centre, radius, number = geometry[dim]
                close = _distances(_unit(_matrix(batch.column("v").take(pa.array(at)))), centre) <= radius + reach + 1e-6
                for k in np.flatnonzero(close.any(axis=0)):
                    other = int(number[k])
                    rows = at[close[:, k]]
                    rows = rows[~np.isin(own[rows], settled[other])] if other in settled else rows
                    ahead = (other - own[rows]) % blocks  # how far the other block is from the own one, round the circle
                    host = (2 * ahead < blocks) | (2 * ahead == blocks) & (own[rows] < other)
                    apart = np.where(host, ahead, blocks - ahead)
                    row.append(rows)
                    task.append(np.where(host, own[rows], other) * groups + apart // VISITS)
                    guest.append(np.where(host, 0, apart))
            row, task, guest = (np.concatenate(z) if z else np.zeros(0, "i8") for z in (row, task, guest))
            once = np.unique(np.stack([row, task, guest], axis=1), axis=0)  # a host's vector is in a task once
            take = pa.array(once[:, 0])
            cols = [pa.array((once[:, 1] % partitions).astype("i4")), pa.array(once[:, 1]), pa.array(once[:, 2]), *(batch.column(c).take(take) for c in names[3:])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    def found(ids: np.ndarray, reps: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        some = counts > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(int(some.sum()), pa.int64()), pa.nulls(int(some.sum()), pa.int64()), pa.array(counts[some])], names=["node", "a", "b", "n"])

    def linked(a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], names=["node", "a", "b", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, of = None, None
        for rows in _runs(batches, ["task", "guest"]):
            task, guest = rows.column("task")[0].as_py(), rows.column("guest")[0].as_py()
            node, rep, copies = (rows.column(c).to_numpy() for c in ("node", "rep", "copies"))
            one = Block(_matrix(rows.column("v")), copies, np.array(rows.column("nodes").to_pylist()))
            if guest == 0:
                host, of = (one, node, rep), task
                own = task // groups
                if task % groups == 0 and own not in settled.get(own, ()):  # the host's own vectors meet here
                    m = Meeting(one, one, cosine)
                    yield found(node, rep, m.nx + m.ny)
                    yield linked([rep[i] for i, _ in m.links], [rep[j] for _, j in m.links])
            elif of == task:
                m = Meeting(host[0], one, cosine)
                yield found(host[1], host[2], m.nx)
                yield found(node, rep, m.ny)
                yield linked([host[2][i] for i, _ in m.links], [rep[j] for _, j in m.links])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links with whole blocks: a number for each vector, and as few links as join the blocks."""
        for batch in batches:
            node, rep, copies, own = (batch.column(c).to_numpy() for c in ("node", "rep", "copies", "block"))
            for b in np.unique(own).tolist():
                others = inside[b]
                at = np.flatnonzero(own == b)
                total = sum(w for _, w, _ in others) - np.where(any(o == b for o, _, _ in others), copies[at], 0)
                yield found(node[at], rep[at], total)
                yield linked(rep[at].tolist(), [others[0][2]] * len(at))
                yield linked([others[0][2]] * len(others), [r for _, _, r in others])

    shape = "node long, a long, b long, n long"
    visits = trees.mapInArrow(tidy(visit), "part int, task long, guest long, node long, rep long, copies long, v binary, place int, nodes array<int>")
    pairs = visits.repartitionById(partitions, "part").sortWithinPartitions("task", "guest", "place").mapInArrow(tidy(meet), shape)
    if inside:
        pairs = pairs.union(trees.where(F.col("block").isin(list(inside))).select("block", "node", "rep", "copies").mapInArrow(tidy(counted), shape))
    pairs = materialize(pairs, "found")
    counts = pairs.where("n is not null").groupBy("node").agg(F.sum("n").alias("n"))
    links = pairs.where("b is not null and a <> b").select("a", "b").union(_shared_ids(units, reps))
    comps = components(links).withColumnRenamed("node", "rep")
    of_rep = reps.select("digest", "dim", "node", "rep", "copies").join(counts, "node", "left").join(comps, "rep", "left")
    of_rep = of_rep.select("digest", "dim", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = units.select("vec_id", "dim", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(of_rep, ["digest", "dim"], "left")
    discard(trees)  # all that reads it is written
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
