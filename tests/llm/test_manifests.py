"""Token counts, Merkle manifests and the filter audit against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from edges import EDGES, docs, prose
from lumenloom.llm import filter_audit, merkle, token_counts
from lumenloom.llm.common import fold

FOLDER = "/root/testdata/sf0.001"
WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain_count(text):
    return len(WHOLE.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def cutter():
    return token_counts.PreTokens(token_counts.default_tokenizer())


def test_pretokens_of_every_code_point(cutter):
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    cut = WHOLE.pre_tokenizer.pre_tokenize_str
    for at in range(0, len(codes), 512):
        text = "".join(f"a{chr(c)}1 {chr(c)}{chr(c)}b  {chr(c)}!" for c in codes[at : at + 512])
        want = [text[i:j] for _, (i, j) in cut(text)]
        assert [p for part in cutter.cut(text) for p in part] == want
        assert cutter.far.pattern and re.compile(cutter.patterns[1]).findall(text) == want


def test_pretokens_of_random_texts(cutter, monkeypatch):
    rng = random.Random(5)
    signs = ["'s", "'", "’ll", " ", "  ", "\n", "\r\n", "\t", " ", "　", "a", "é", "Ⅷ", "²", "9", "中文", "🙂", "👩‍👩‍👧", "<|endoftext|>", "<|endoftext", "|>", "?!", "Don't", "​", "İ", "\x00"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(3000)]
    counter = token_counts.TwoTiers(cutter, {"a": 1, " ": 1})
    assert [counter.count(t) for t in texts] == [plain_count(t) for t in texts]
    monkeypatch.setattr(token_counts, "LONG_TEXT", 1)
    monkeypatch.setattr(token_counts, "SLICE", 3)
    monkeypatch.setattr(token_counts, "CACHE", 5)
    counter = token_counts.TwoTiers(cutter, {})
    assert [counter.count(t) for t in texts] == [plain_count(t) for t in texts] and len(counter.cache) <= 5


def test_token_counts_of_the_given_texts(spark):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: (len(r.text.encode()), plain_count(r.text), plain_count(r.text) > 512) for r in given.collect()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(given).collect()} == want


def test_token_counts_take_edge_cases(spark):
    texts = [*EDGES, (10, "<|endoftext|>"), (11, " <|endoftext|>\n<|endoftext|>x"), (12, " " * 30_000), (13, "ab" * 40_000), (14, "a\u0000b"), (None, None)]
    got = token_counts.count_tokens(docs(spark, texts).withColumn("n_tokens", F.lit("old")).withColumn("Over_Limit", F.lit(1)), limit=0)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == Counter((i, len((t or "").encode()), plain_count(t), plain_count(t) > 0) for i, t in texts)
    assert set(got.columns) == {"doc_id", "lang", "source", "n_chars", "score", "kept", "predicted", "pii", "host", "idx", "lang_pred", "n_bytes", "n_tokens", "over_limit"}
    assert token_counts.count_tokens(docs(spark, [])).count() == 0


def test_the_first_tier_holds_what_is_frequent(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "COUNTED", 40)
    monkeypatch.setattr(token_counts, "PER_TASK", 5)
    texts = [(i, " the" * 50 + f" {prose(30, i)} and" * 4) for i in range(30)]
    found = token_counts.frequent_pretokens(docs(spark, texts).coalesce(2), token_counts.default_tokenizer()).collect()
    assert len(found) <= 10 and found[0].pretoken == " the" and found[0].n == 1500


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.PreTokens(public_tokenizers.path("word_bpe_49k.json"))


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(*fields):
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes):
    """Its levels up to the root, and for each leaf the digests before and after it on every level that is hashed."""
    levels, ways = [nodes], [[] for _ in nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        for i, way in enumerate(ways):
            at = i // 16 ** (len(levels) - 1)
            run = range(at - at % 16, min(at - at % 16 + 16, len(below)))
            way.append(("".join(below[k] for k in run if k < at), "".join(below[k] for k in run if k > at)))
        levels.append([h(*below[k : k + 16]) for k in range(0, len(below), 16)])
    return (levels[-1][0] if nodes else None), ways


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        got = (r[0], r[1], r[2], r[3], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r
        groups[r[1]].append((r[0], leaf_of(*r), leaf_of(*got)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: tree([x[1] for x in groups[s]]) for s in names}
    root, ends = tree([trees[s][0] for s in names])
    for s, end in zip(names, ends):
        for (i, leaf, got), way in zip(groups[s], trees[s][1]):
            way = way + end
            at = got
            for before, after in way:
                at = h(before, at, after)
            yield i, leaf, trees[s][0], root, h(*(a + b for a, b in way)), at, at == root


def check_manifest(spark, rows):
    given = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf int, member string").repartition(5)
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = merkle.manifest(given, received=(fold("doc_id", 5, 0), {"text": small}))
    want = Counter(plain_manifest(rows))
    assert Counter(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())) == want
    return want


def doc(i, source, text="Some Text"):
    return (i, source, "en", None if text is None else len(text), text)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17}, {"a": 1, "b": 1}, {"a": 300, "b": 33, None: 1, "": 2, "é": 16, "Z": 256}, {f"s{k}": 1 for k in range(40)}])
def test_manifest(spark, sizes):
    ids = itertools.count(1)
    want = check_manifest(spark, [doc(next(ids), s, f"Text {k} 🙂 é") for s, n in sizes.items() for k in range(n)])
    assert {v[-1] for v in want} == {True, False} or sum(sizes.values()) < 20


def test_manifest_takes_edge_cases(spark):
    rows = [(i, "s", "en", 5, t) for i, t in EDGES] + [(20, None, None, None, None), (8, "s", "en", 5, "other"), (None, None, None, None, None), (None, "s", None, 1, "A")] + [(8, "t", "en", 5, "copy")] * 40
    check_manifest(spark, rows)
    assert merkle.manifest(docs(spark, [])).count() == 0


def test_a_large_group_is_spread_over_runs(spark):
    rows = [doc(i, "hot", f"T{i}") for i in range(1, 1200)] + [doc(i, "b", f"T{i}") for i in range(1200, 1205)]
    check_manifest(spark, rows)
    given = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    leaves = merkle.leaf_rows(given, merkle.FIELDS, "source", "doc_id", None)
    nodes = merkle.runs_of(merkle.placed(leaves, ["key", "digest"]), ["key"]).collect()
    assert sorted((r.tree, r.run, len(r.members)) for r in nodes) == sorted([("+hot", k, 16) for k in range(74)] + [("+hot", 74, 15), ("+b", 0, 5)])
    assert all([m.i for m in r.members] == list(range(16 * r.run, 16 * r.run + len(r.members))) for r in nodes)


def plain_audit(rows, labels):
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    parts = defaultdict(list)
    for i, part, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        parts[part or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part, found in parts.items():
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = found
            for step, f in enumerate(order):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                total[f] += len(gone)
                hit = sum(f in d[0] for d in found)
                out[part, "".join(order), step + 1] = [len(left), len(gone), hit - len(gone), sum(d[0] == {f} for d in found), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def check_audit(spark, rows, labels):
    given = spark.createDataFrame([(*r, "x", True, 1) for r in rows], "doc_id long, lang string, text string, part string, A boolean, good int").repartition(4)
    known = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, E int")
    got = filter_audit.audit(filter_audit.verdicts(given, known))
    assert got.columns == ["part", "filter_order", "step", *filter_audit.COUNTED]
    found = {(r.part, r.filter_order, r.step): list(r)[3:] for r in got.collect()}
    assert got.count() == len(found) and found == plain_audit(rows, labels)
    return found


def test_audit(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1, 200):
        w = prose(rng.choice([40, 99, 100, 150]), i).split()
        if rng.random() < 0.3:
            w = w[:20] * 8
        if rng.random() < 0.3:
            w = [x.upper() if rng.random() < 0.5 else x for x in w]
        if rng.random() < 0.3:
            w.append(rng.choice("#$%&*|"))
        rows.append((i, rng.choice(["en", "de", None, ""]), " ".join(w)))
    rows += [(1000 + k, r[1], r[2]) for k, r in enumerate(rng.sample(rows, 40))] + [(2000 + k, "fr", rows[0][2]) for k in range(90)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(1, 150)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (9999, 1, 1)]
    found = check_audit(spark, rows, labels)
    assert any(v[2] for v in found.values()) and any(v[3] for v in found.values()) and any(v[4] for v in found.values()) and any(v[5] for v in found.values())


def test_audit_takes_edge_cases(spark):
    rows = [(i, "en", t) for i, t in EDGES] + [(30, None, None), (31, "", ""), (8, "xx", "Z"), (None, "en", ""), (None, "en", "")]
    check_audit(spark, rows, [(8, 1, 1), (8, None, 0), (None, 1, 1)])
    check_audit(spark, rows, [])
    check_audit(spark, [], [(1, 1, 1)])


def test_each_state_is_entered_once(spark, monkeypatch):
    seen = []
    count = filter_audit.Trie.count
    monkeypatch.setattr(filter_audit.Trie, "count", staticmethod(lambda state, rows, rest: (seen.append(state), count(state, rows, rest))[1]))
    filter_audit.audit(filter_audit.verdicts(docs(spark, EDGES), spark.read.parquet(f"{FOLDER}/labels.parquet")))
    assert len(seen) == len(set(seen)) == 31
    assert not spark._jsparkSession.sharedState().cacheManager().numCachedEntries()
