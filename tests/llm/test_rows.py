"""Operators on single documents against brute force, round trips and held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from edges import EDGES, docs, prose
from lumenloom.llm import langid, packing, pii, quality, toxicity, url_filter
from lumenloom.llm.queries import URL_RULES

FOLDER = "/root/testdata/sf0.01"


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*EDGES, (50, "an <|endoftext|> inside"), (51, "  spaces\n\n\tand ümläüts’s don't 12345 "), (52, prose(700, 5)), (None, prose(2000, 6)), (None, None)]
    texts += [(53, " " * 1_000_000), (54, "\n" * 1_000_000), (55, "a" * 300_000), (53, prose(1100, 7))]
    packed = packing.pack(docs(spark, texts))
    got = packed.collect()
    want = Counter()
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 1024):
            piece = ids[at : at + 1024]
            want[i, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs(spark, [])).count() == 0
    assert packing.padding(packed).first().tokens == sum(r.length for r in got)


def test_both_tokenizers_give_equal_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing._load(packing.default_tokenizer())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 5000):
        texts = [f"a{c}b {c}1{c}{c} {c}  {c}'s" for c in points[at : at + 5000]]
        assert [encode(t) for t in texts] == [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    for run in (packing.LONG_RUN - 1, packing.LONG_RUN):
        for c in (" ", "\n", "\u2003", "\t "):
            text = f"a{(c * run)[:run]}b"
            assert encode(text) == tok.encode(text, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest():
    lengths = np.array(sorted([600, 500, 400, 424, 524, 100, 24, 1024, 7], reverse=True))
    sequence, offset = packing.best_fit_decreasing(lengths)
    used = defaultdict(int)
    open_ = {}
    for n, s, o in zip(lengths, sequence, offset):
        assert used[s] == o
        fits = [c for c in open_.values() if c >= n]
        assert (1024 - o) == (min(fits) if fits else 1024)
        used[s] += n
        open_[s] = 1024 - used[s]


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(p) <= 255 for p in h.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda h: 13 <= len(d := re.sub("[ -]", "", h)) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 9 <= len(re.sub("[^0-9]", "", h)) <= 15),
}
HARD = [
    "mail a.b@c.de and x@y, @z.com x@@y.z a@b.c@d.e %%@q.r.s- _x@y.z.", "1.2.3.4.5.6.7.8 and 256.1.1.1 0001.2.3.4 1.2.3 999.999.999.999.1.1.1.1", "card 4111 1111 1111 1111 or 4111-1111-1111-1112 1 4111 1111 1111 1111 41111111111111111111",
    "call +49 (30) 1234567-8 or +1 +12 345 678 90. ++49 1234 56789 and +123456789012345678", "IBAN DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00; SSN 123-45-6789, no 123-45-6789", "tel (555) 123-4567 üñ🙂 5105105105105100 🙂 a@b.cd", "1" * 5000 + " " + "a" * 5000 + "@" + "1 " * 3000,
]


def base_spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in BASE.items()}


def test_pii_report(spark):
    texts = [*EDGES, *enumerate(HARD, 100), (120, "a@b.cd 1.2.3.4 " * 10_000), (121, HARD[0]), (121, HARD[0]), (None, HARD[1])]
    rows = pii.pii_report(docs(spark, texts)).collect()
    got = {r.doc_id: r for r in rows}

    def told(i, t):
        spans = base_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v)
        return i, *map(len, spans.values()), hashlib.sha256(text.encode()).hexdigest()

    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == Counter(told(i, t) for i, t in texts)
    texts = [(i, t) for i, t in texts if i not in (None, 8)]

    for i, t in texts:
        want = base_spans(t)
        assert {k: got[i][f"n_{k}"] for k in want} == {k: len(v) for k, v in want.items()}, t
        text = ",".join(f"{k}:{a}:{b}" for k, v in want.items() for a, b in v)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[i].spans.startswith(text)
    assert "iban:5:32" in got[104].spans and got[104].spans.count("iban") == 1 and got[104].spans.count("ssn:") >= 1 and "tel:" in got[105].spans
    assert pii.pii_report(docs(spark, [])).count() == 0


def test_pii_context(spark):
    texts = [(1, "hotel 123-45-6789 recall 555-123-4567"), (2, "ssn: 123-45-6789"), (3, "555-123-4567 is my phone"), (4, "phone " + "x" * 36 + " 555-123-4567"), (5, "phone " + "x" * 30 + " 555-123-4567"), (6, "a ship 1.2.3.4 or host 1.2.3.4"), (7, "Write: a@b.cd")]
    got = {r.doc_id: (r.spans, r.scores) for r in pii.pii_report(docs(spark, texts)).collect()}
    assert got == {1: ("", ""), 2: ("ssn:5:16", "0.8"), 3: ("tel:0:12", "0.7"), 4: ("", ""), 5: ("tel:37:49", "0.7"), 6: ("ip:7:14,ip:23:30", "0.8,0.8"), 7: ("email:7:13", "0.95")}


def masked(text):
    """What masking makes of a text, from its spans."""
    spans = sorted((a, -b, k) for k, v in base_spans(text).items() for a, b in v)
    out, at = "", 0
    for a, b, k in spans:
        if a >= at:
            out += text[at:a] + f"<{k.upper()}>"
        at = max(at, -b)
    return out + text[at:]


def test_pii_masking_of_many_and_overlapping_spans(spark):
    texts = [(i, t) for i, t in enumerate([*HARD[:2], HARD[2], "🙂 a@b.cd 1.2.3.4 " * 3000, "+49 30 4111 1111 1111 1111 " * 900, "1.2.3.4@a.b " * 700], 1)]
    assert {r.doc_id: r.text for r in pii.mask_pii(docs(spark, texts)).collect()} == {i: masked(t) for i, t in texts}


def test_pii_masking(spark):
    texts = [(1, None), (2, "write to a@b.cd or 1.2.3.4 🙂 a@b.cd."), (3, "nothing")]
    df = pii.mask_pii(docs(spark, texts))
    assert df.columns == docs(spark, []).columns
    assert {r.doc_id: r.text for r in df.collect()} == {1: None, 2: "write to <EMAIL> or <IP> 🙂 <EMAIL>.", 3: "nothing"}


def judged(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "https://a.NET/x", "https://example.net/en/page?q#f", "https://example.net/en", "http://x.example.com/de/", "http://notexample.com/de/", "http://a.org/fr/x", "http://org/fr/", "http://a.org/FR/", "x://a://b.net/c", "http://a.net", "http://net.com/", "http://a..net/", "HTTP://ÄB.Net/ü?", "http://a.net/\nb", "http://a.net/\nb", "http://" + "a." * 8000 + "net/", "http://" + "x" * 100_000 + ".net/" + "y" * 100_000, "http://xexample.net/en/", "http://aaaa.example.net/en/", "http://" + "b." * 500 + "example.com/de/" + "/" * 5000, "http://q.xexample.com/de/"] + [f"http://h{i}.example.{t}/{p}/{i}" for i in range(200) for t in ("net", "com", "org") for p in ("en", "de", "fr")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'clash' AS rule", "1 AS verdict")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, URL_RULES).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}
    other = [("b.example.com", "/de/", "block"), ("b.example.com", "/de/", "allow"), ("example.com", "/", "block")]
    assert [(r.rule, r.verdict) for r in url_filter.filter_urls(df.where("url like 'http://b.%'"), other).collect()] == [("b.example.com/de/", "allow")]
    assert url_filter.filter_urls(df.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, []).select("verdict").distinct().collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).selectExpr("concat('key', id) AS key")
    listed = universe.where("crc32(cast(key as binary)) % 7 = 0")
    cascade = url_filter.build_cascade(listed, universe, 3000)
    assert len(cascade.levels) > 1
    found = universe.where(cascade.contains(universe["key"]))
    assert found.exceptAll(listed).count() == 0 and listed.exceptAll(found).count() == 0


def test_language(spark):
    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    edge = langid.identify(docs(spark, EDGES)).collect()
    assert len(edge) == len(EDGES) and {r.lang_pred for r in edge if r.doc_id in (1, 2, 3, 7)} == {"und"} and all(0 <= r.score <= 1 for r in edge)
    assert langid.identify(docs(spark, [])).count() == 0
    hidden = docs(spark, [(i, t) for i, t in EDGES if i]).selectExpr("doc_id", "text", "cast(null as string) AS lang")
    assert {r.lang_pred for r in langid.identify(hidden).collect()} == {"und"}


def _auc(rows, label):
    pos, neg = [r.score for r in rows if r[label] == 1], [r.score for r in rows if r[label] == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_toxicity(spark):
    d, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(d, labels).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    assert _auc(got, "toxic") > 0.8
    few = spark.createDataFrame([(4, 1), (5, 0), (8, None), (None, 1)], "doc_id long, toxic int")
    edge = toxicity.score_toxicity(docs(spark, EDGES), few).collect()
    assert len(edge) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in edge)
    assert toxicity.score_toxicity(docs(spark, []), few).count() == 0
    assert all(r.score < 0.01 for r in toxicity.score_toxicity(docs(spark, EDGES), few.limit(0)).collect())


def test_quality(spark):
    d, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(d, labels).join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert _auc(got, "quality") > 0.8
    few = spark.createDataFrame([(4, 1), (6, 0), (8, None), (None, 1)], "doc_id long, quality int")
    edge = quality.score_quality(docs(spark, EDGES), few).collect()
    assert len(edge) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in edge)
    assert quality.score_quality(docs(spark, []), few).count() == 0
    assert all(r.score == 0.5 for r in quality.score_quality(docs(spark, EDGES), few.limit(0)).collect())
