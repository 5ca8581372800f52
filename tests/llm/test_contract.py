"""The registered queries against their SQL, and the pipeline's stages against what they promise."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from edges import EDGES, docs, prose
from lumenloom.llm.queries import ORACLES, QUERIES
from same import assert_same
from test_pairs import found_items, roots, sets_of
from test_rows import masked

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_rows_equal_sql(spark, name):
    assert_same(QUERIES[name](spark, FOLDER), ORACLES[name], FOLDER)


def test_all_are_registered():
    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in found} and "pipeline" in found


def test_pipeline_stages(spark):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    d = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, FOLDER)
        assert out.columns == d.columns, name
        rows = out.collect()
        assert {r.doc_id for r in rows} <= {r.doc_id for r in d.select("doc_id").collect()}, name
        d = spark.createDataFrame(rows, out.schema)
    assert 0.5 * given.count() < d.count() < given.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, d, FOLDER).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in d.collect()}


def plain_near_dedup(rows):
    """One row of each group of near copies: that with the smallest id, ids before none."""
    sets = sets_of(list(enumerate(r.text for r in rows)), 5)
    at = range(len(rows))
    links = [(i, j) for i in at for j in at if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    groups = defaultdict(list)
    for i, top in roots(at, links).items():
        groups[top].append(i)
    return [rows[min(g, key=lambda i: (rows[i].doc_id is None, rows[i].doc_id or 0))].text for g in groups.values()]


def plain_pieces(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r in rows:
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        out.update((r.doc_id, at, len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes()), len(ids)) for at in range(0, len(ids), 1024))
    return out


def fixture():
    texts = [(i, f"{prose(70 + i, i)} mail a{i}@b.cd or 1.2.3.{i}") for i in range(1, 30)]
    near = prose(150, 90).split()
    texts += [(40 + k, " ".join([*near[: 30 * k], f"new{k}", *near[30 * k + 1 :]])) for k in range(5)]
    a, b, c = prose(90, 60), prose(90, 61), prose(90, 62)
    texts += [(50, a), (50, a), (51, b), (52, a), (52, c), (None, prose(80, 63)), (None, prose(80, 63)), (None, c), (None, prose(85, 64))]
    texts += [(60, f"{prose(20, 70)} {prose(45, 800)} {prose(20, 71)}"), (None, prose(45, 801)), (61, prose(45, 802)), (61, prose(66, 72)), (70, prose(3000, 73)), (71, ""), (72, None), (73, "one")]
    return texts, [(1, prose(45, 800)), (2, prose(45, 801)), (3, prose(45, 802)), (4, None)]


def test_pipeline_equals_the_plain_version(spark, tmp_path):
    texts, items = fixture()
    given = docs(spark, texts).coalesce(3)
    given.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.language(spark, given, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((i, t) for i, t in texts if t)
    stages = dict(corpus_pipeline.STAGES)
    again = lambda rows: spark.createDataFrame(rows, given.schema)
    kept = stages["near_dedup"](spark, again(rows), str(tmp_path))
    assert kept.columns == given.columns
    want = plain_near_dedup(rows)
    kept = kept.collect()
    assert len(kept) == len(want) and Counter(sorted(r.text for r in kept)) == Counter(sorted(want))
    assert Counter(r.doc_id for r in kept if r.text in (prose(90, 60), prose(90, 61), prose(90, 62))) == Counter([50, 51, 52])
    clean = stages["decontamination"](spark, again(kept), str(tmp_path)).collect()
    dirty = {i for i, _ in found_items(list(enumerate(r.text for r in kept)), items)}
    assert Counter(r.text for r in clean) == Counter(r.text for i, r in enumerate(kept) if i not in dirty) and len(dirty) == 3
    safe = stages["personal_data"](spark, again(clean), str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text, r.n_chars) for r in safe) == Counter((r.doc_id, masked(r.text), len(masked(r.text))) for r in clean)
    pieces = lambda df: Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect())
    assert pieces(stages["packing"](spark, again(safe), str(tmp_path))) == plain_pieces(safe)
    assert pieces(corpus_pipeline.run(spark, str(tmp_path))) == plain_pieces(safe)


def test_pipeline_stages_take_edge_cases(spark):
    d = docs(spark, EDGES)
    left = {"language": [4, 5, 6, None, 8, 8, 9], "near_dedup": [1, 2, 3, 4, 5, 6, 7, None, 8, 9], "decontamination": [i for i, _ in EDGES], "personal_data": [i for i, _ in EDGES]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, FOLDER)
        if name in left:
            assert out.columns == d.columns
            assert Counter(r.doc_id for r in out.collect()) == Counter(left[name]), name
        else:
            assert {r.doc_id for r in out.collect()} == {i for i, _ in EDGES}
        assert stage(spark, d.limit(0), FOLDER).count() == 0, name


def test_language_stage_keeps_all_where_no_language_is_known(spark):
    d = docs(spark, EDGES).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, d, FOLDER).count() == len(EDGES)
