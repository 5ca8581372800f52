"""Operators on pairs and passages against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from edges import EDGES, docs, prose
from lumenloom.llm import cover_tree, decontaminate, minhash, substring_dedup
from lumenloom.llm import components as components_of
from lumenloom.llm.components import components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_texts():
    rng, out = random.Random(4), []
    for g in range(12):
        base = prose(120, g).split()
        for _ in range(rng.choice([2, 3, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 9])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10_000)}"
            out.append(" ".join(w))
    return list(enumerate(out, 100))


def sets_of(texts, size):
    out = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(size, len(w))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    return out


@pytest.mark.parametrize("size, hundredths", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, hundredths):
    texts = near_texts() + [e for e in EDGES if e[0]]
    sets = sets_of(texts, size)
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= hundredths * len(sets[a] | sets[b])]
    want = roots(ids, links)
    got = minhash.near_duplicates(docs(spark, texts), size, hundredths / 100).collect()
    assert len(got) == len(texts) and len(links) > 10
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r


@pytest.mark.parametrize("rows", [[(5, 1), (5, 2), (3, 2)], [(9, 1), (8, 1), (9, 2), (7, 2), (7, 3), (2, 3), (4, 4), (4, 4), (6, 4)], [(5, 1), (5, 2)], [(5, 1), (6, 2), (5, None)]])
def test_rows_that_share_an_id_are_one_node(spark, rows):
    texts = [(i, None if k is None else prose(50, 900 + k)) for i, k in rows]
    links = [(a, b) for a, x in texts for b, y in texts if a != b and x == y and x]
    want = roots([i for i, _ in texts], links)
    for r in minhash.near_duplicates(docs(spark, texts)).collect():
        assert (r.component_id, r.kept) == ((want[r.doc_id], want[r.doc_id] == r.doc_id) if r.n_shingles else (r.doc_id, True)), r


def test_near_links_meet_at_shared_ids(spark):
    base, other = prose(200, 950).split(), prose(200, 951).split()
    texts = [(5, " ".join(base)), (5, " ".join(other)), (3, " ".join([*other[:60], "new", *other[61:]])), (8, " ".join([*base[:60], "new", *base[61:]])), (1, prose(60, 952))]
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, texts)).collect()} == {5: 3, 3: 3, 8: 3, 1: 1}


def test_near_duplicates_find_all_links_of_a_given_table(spark):
    """Recall at sf0.01 against all pairs that share a shingle, printed with -s."""
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r.doc_id, r.text) for r in given.select("doc_id", "text").collect()]
    sets, holders = sets_of(texts, 3), {}
    for i, shingles in sets.items():
        for x in shingles:
            holders.setdefault(x, []).append(i)
    common = Counter(p for h in holders.values() for p in itertools.combinations(h, 2))
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n)]
    want = roots(sorted(sets), links)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(given, 3, 0.85).collect()}
    print("recall of op5:", sum(got[a] == got[b] for a, b in links), "of", len(links), "links")
    assert got == want


def test_near_duplicates_of_nothing_and_null_ids(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    r = minhash.near_duplicates(docs(spark, [(None, prose(50))])).first()
    assert r.component_id is None and r.kept is False


def test_overfull_regions_still_join(spark, monkeypatch):
    monkeypatch.setattr(minhash, "REGION", 8)
    base = prose(300, 1).split()
    texts = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(range(10, 290, 4), 1)]
    got = minhash.near_duplicates(docs(spark, texts)).collect()
    assert {r.component_id for r in got} == {1} and sum(r.kept for r in got) == 1


def test_pairs_inside_overfull_groups_of_near_misses(spark, monkeypatch):
    monkeypatch.setattr(minhash, "REGION", 4)
    base, texts = prose(400, 1).split(), []
    for a in range(12):  # five words changed; two documents share one place at most, and pairs one new word
        for b in range(13):
            w = list(base)
            for k in range(5):
                w[5 + 6 * (13 * k + (a * k + b) % 13)] = f"y{a}x{b}x{k}" if k else f"p{a // 2}x{b}"
            texts.append((13 * a + b, " ".join(w)))
    sets = sets_of(texts, 5)
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) == 78
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, texts)).collect()} == roots(sorted(sets), links)


@pytest.mark.parametrize("most", [1_000_000, 100])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(components_of, "NODES", most)
    rng = random.Random(1)
    links = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == roots({x for p in links for x in p}, links)


def repeats(texts, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(texts, words):
        gone = {p for j in range(len(w) - size + 1) if seen[tuple(w[j : j + size])] > 1 for p in range(j, j + size)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("crowd", [2000, 2])
def test_substring_dedup(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    passage, other = prose(80, 50), prose(36, 51)
    texts = [*EDGES, (20, prose(40, 20) + " " + passage + " " + prose(30, 21)), (21, passage), (22, f"{prose(90, 22)}\n{passage}\t{other}"), (23, other + " " + other), (24, "a " * 200), (25, "A " * 34), (26, prose(34, 50)), (27, f"{prose(9, 70)} {other.upper()}")]
    texts += [(100 + i, f"{prose(20, 200 + i)} {passage} {prose(20, 300 + i)}") for i in range(12)]
    got = substring_dedup.remove_repeats(docs(spark, texts)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == repeats(texts, 35)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_windows_of_a_crowded_passage_reach_the_index_once(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWD", 2)
    given, shards = [], substring_dedup._shards
    monkeypatch.setattr(substring_dedup, "_shards", lambda words, size: given.append(words.select("anchor", "words").collect()) or shards(words, size))
    texts = [(i, f"{prose(20, 200 + i)} {prose(80, 50)} {prose(20, 300 + i)}") for i in range(40)] + [(90, prose(60, 90)), (91, prose(60, 91) + " " + prose(60, 91))]
    got = substring_dedup.remove_repeats(docs(spark, texts)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == repeats(texts, 35)
    assert max(Counter(tuple(r) for r in given[0]).values(), default=0) <= 2


def test_equal_hashes_of_different_windows_are_told_apart(spark):
    rows = [(1, 7, 10, 0, 1, b"a"), (1, 7, 11, 2, 1, b"a"), (1, 7, 12, 1, 1, b"b"), (1, 8, 12, 2, 1, b"c"), (1, 9, 13, 3, 2, b"d"), (1, 9, 13, 1, 2, b"d"), (2, 8, 14, 0, 1, b"c")]
    windows = spark.createDataFrame(rows, "anchor long, part long, segment long, off int, copies int, words binary")
    assert {(r.segment, r.mask) for r in substring_dedup._counted(windows).collect()} == {(10, 1), (11, 4), (13, 10)}


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0


def found_items(texts, items, size=5, least=0.8):
    out = {}
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for d, t in texts:
        w = split(t)
        for i, text in items:
            v = split(text)
            n = min(len(v), len(w))
            k = min(size, len(v))
            if not v or n < k:
                continue
            grams = lambda x: Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
            b = grams(v)
            shared = [j for j in range(len(w) - k + 1) if tuple(w[j : j + k]) in b]
            for s in sorted({s for j in shared for s in range(max(0, j - n), min(j, len(w) - n) + 1)}):
                a = grams(w[s : s + n])
                common = sum((a & b).values())
                sim = common / (sum(a.values()) + sum(b.values()) - common)
                if sim >= least - 1e-12 and common and ((d, i) not in out or (sim, -s) > (out[d, i][1], -out[d, i][0])):
                    out[d, i] = (s, sim)
    return out


def check_found(spark, texts, items):
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    want = found_items(texts, items)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1]) for k in got)
    return got.keys()


def test_decontamination(spark, monkeypatch):
    items = [(1, prose(30, 400)), (2, prose(60, 401)), (3, "tiny item here"), (4, None), (5, ""), (6, prose(30, 400)), (7, "one two three four five six " * 5), (8, prose(30, 402)), (8, prose(31, 403)), (None, prose(30, 404))]
    changed = prose(60, 401).split()
    changed[30] = "other"
    long = prose(60_000, 9).split()
    for at in (4000, 4096, 8190, 59_960):
        long[at : at + 30] = prose(30, 400).split()
    texts = [*EDGES, (30, f"{prose(50, 30)} {prose(30, 400).upper()}! {prose(9, 31)}"), (31, " ".join(changed)), (32, "so: Tiny, item. Here?"), (33, prose(300, 33)), (34, prose(25, 400)), (35, " ".join(long))]
    texts += [(36, "x " + "one two three four five six " * 5), (37, "one two three four five six " * 3 + "a b c"), (38, prose(30, 402)), (39, prose(31, 403)), (40, prose(30, 404))]
    assert {(30, 1), (30, 6), (31, 2), (32, 3), (35, 1), (36, 7), (38, 8), (39, 8), (40, None)} <= check_found(spark, texts, items)
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    check_found(spark, texts, items)


def test_decontamination_of_repeated_and_missing_ids(spark):
    items = [(1, prose(40, 410)), (2, prose(40, 411)), (3, prose(41, 412))]
    texts = [(None, prose(40, 410)), (None, prose(40, 411)), (None, prose(40, 411)), (5, prose(40, 410)), (5, prose(40, 411)), (6, prose(40, 412)), (6, prose(70, 413))]
    assert check_found(spark, texts, items) == {(None, 1), (None, 2), (5, 1), (5, 2), (6, 3)}


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(300)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    other = [b ^ sum(1 << i for i in rng.sample(range(64), rng.choice([0, 8, 23, 23, 24, 30]))) for b in base]
    items = spark.createDataFrame([(i, 1, signed(b)) for i, b in enumerate(base)], "item long, n int, fp long")
    probes = spark.createDataFrame([(i, signed(b)) for i, b in enumerate(other)], "id long, probe long")
    held = decontaminate._entered(items, 23)
    from pyspark.sql import functions as F

    looked = probes.select("id", "probe", F.posexplode(F.array(*decontaminate._blocks(F.col("probe")))).alias("block", "value"))
    got = {(r.item, r.id) for r in looked.join(held, ["block", "value"]).where("bit_count(probe ^ item_fp) <= 23").select("item", "id").distinct().collect()}
    assert got == {(i, j) for i, b in enumerate(base) for j, o in enumerate(other) if (b ^ o).bit_count() <= 23}


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs(spark, EDGES), bench).count() == 0
    assert decontaminate.contaminated(docs(spark, []), spark.createDataFrame([(1, prose(40))], bench.schema)).count() == 0


def linked(rows):
    """Links, nodes and components of vectors by brute force; rows with one id are one node."""
    sound = lambda i, v: i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    good = [(p, i, v) for p, (i, v, _) in enumerate(rows) if sound(i, v)]
    good = [(p, i, v if 1e-99 < max(map(abs, v)) < 1e99 else [x / max(map(abs, v)) for x in v]) for p, i, v in good]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    hit = lambda a, b: len(a) == len(b) and dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) >= 0.9
    pairs = [(p, q, a, b) for k, (p, a, x) in enumerate(good) for q, b, y in good[k + 1 :] if hit(x, y)]
    degree = Counter(n for p, q, _, _ in pairs for n in (p, q))
    return degree, roots({i for i, _, _ in rows if i is not None}, [(a, b) for _, _, a, b in pairs])


def check_linked(spark, rows, **sizes):
    degree, comps = linked(rows)
    got = cover_tree.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), **sizes).collect()
    want = Counter((i, degree[p], comps.get(i), i is not None and comps[i] == i) for p, (i, _, _) in enumerate(rows))
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want


@pytest.mark.parametrize("block", [8192, 25])
def test_embeddings(spark, block):
    rng = random.Random(3)
    vecs = []
    for c in range(6):
        centre = [rng.gauss(0, 1) for _ in range(8)]
        vecs += [[x + rng.gauss(0, rng.choice([0.01, 0.2, 0.5])) for x in centre] for _ in range(30)]
    vecs += [vecs[0], [2 * x for x in vecs[1]], [0.0] * 8, None, [], [1.0, None] * 4, [math.nan] * 8, [1.0, 0.0], [math.inf] * 8, [2.0, 0.0], [1e200] * 8, [1e-200] * 8]
    check_linked(spark, [(i, v, i % 3) for i, v in enumerate(vecs)] + [(None, vecs[0], 1)], block=block)


@pytest.mark.parametrize("block", [8192, 12])
def test_embeddings_in_tight_groups(spark, block):
    rng = random.Random(8)
    near = lambda centre, by: [x + rng.gauss(0, by) for x in centre]
    a, b = [rng.gauss(0, 1) for _ in range(6)], [rng.gauss(0, 1) for _ in range(6)]
    vecs = [near(a, 0.01) for _ in range(90)] + [near(b, 0.0001) for _ in range(60)] + [near(a, 0.3) for _ in range(40)] + [near([0] * 6, 1) for _ in range(40)]
    check_linked(spark, list(zip(range(len(vecs)), vecs, vecs and [1] * len(vecs))), block=block)


def test_embeddings_at_the_threshold_and_with_repeated_ids(spark):
    tie = [(1, [1.0, 0.0, 0.0, 0.0], 0), (2, [9.0, 3.0, 3.0, 1.0], 0), (3, [18.0, 6.0, 6.0, 2.0], 0), (4, [8.999999, 3.0, 3.0, 1.0], 0), (5, [27.0, -9.0, 9.0, 3.0], 0)]
    check_linked(spark, tie)
    check_linked(spark, [*tie, (1, [0.0, 0.0, 0.0, 5.0], 0), (9, [0.0, 0.0, 0.1, 5.0], 0), (9, [0.0, 0.0, 0.1, 5.0], 0)])


def test_vectors_that_share_an_id_are_one_node(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    check_linked(spark, [(5, a, 0), (5, b, 0), (3, b, 0)])
    check_linked(spark, [(9, a, 0), (8, a, 0), (9, b, 0), (7, b, 0), (7, c, 0), (2, c, 0), (4, [1.0, 1.0, 1.0], 0), (4, [1.0, 1.0, 1.0], 1), (6, a, 0)])
    rows = cover_tree.linked_vectors(spark.createDataFrame([(6, None), (6, a), (2, a)], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in rows) == [(2, 1, 2), (6, 0, 6), (6, 1, 2)]  # what links with nothing is its own


def test_embeddings_of_nothing(spark):
    assert cover_tree.linked_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
