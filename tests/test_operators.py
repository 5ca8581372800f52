import json
import random

from pyspark.sql import functions as F

from lumenloom.functions import urls
from lumenloom.operators import colours, discover, excerpts, exports, jobs, pages, quotes, reading


def test_choose_pages_prefers_kinds_and_skips_repeats(spark):
    rows = [
        ("s", 0, "https://acme.com/about-us/", "About", "top", "link"), ("s", 1, "https://www.acme.com/about-us", "", "body", "search"),
        ("s", 2, "https://acme.com/our-mission", "Mission", "footer", "link"), ("s", 3, "https://careers.acme.com/", "Jobs", "footer", "link"),
        ("s", 4, "https://acme.com/pricing", "", "top", "link"), ("s", 5, "https://acme.com/tea", "", "top", "link"),
    ]
    links = spark.createDataFrame(rows, "site_id string, pos int, url string, text string, place string, origin string")
    got = [(r.kind, r.url) for r in discover.choose_pages(links).orderBy("rank").collect()]
    assert [k for k, _ in got] == ["about", "mission", "careers", "pricing"]
    assert got[0][1] == "https://acme.com/about-us/"


def test_usable_skips_logins_files_and_languages(spark):
    paths = {"/story": True, "/login": False, "/a.pdf": False, "/fr/story": False, "/": False}
    for path, ok in paths.items():
        c = discover.usable(F.lit("acme.com"), F.lit(path), F.lit("acme.com"), F.lit("acme.com"), F.lit("/"), F.lit("en"))
        assert spark.range(1).select(c.alias("x")).first().x is ok, path


def test_quotes_are_found_word_for_word(spark):
    site = [("s", 0, "https://a.com/", "We make **good tea** every day.\nAlways fresh."), ("s", 1, "https://a.com/about", "We make good tea every day.")]
    page = spark.createDataFrame(site, "site_id string, ord int, url string, text string")
    asked = [("s", "1", "make good tea", "https://a.com/about"), ("s", "2", "make good te", None), ("s", "3", "every day. Always fresh", None), ("s", "4", "good tea", None), ("s", "5", "“make good tea”", None)]
    q = spark.createDataFrame(asked, "site_id string, item string, quote string, claimed_url string")
    got = {r.item: r.found_url for r in quotes.check_quotes(q, page).collect()}
    assert got == {"1": "https://a.com/about", "2": None, "3": None, "4": None, "5": "https://a.com/"}


def test_voice_keeps_only_what_is_said(spark):
    page = spark.createDataFrame([("s", 0, "https://a.com/", "We make good tea.\nFor people who wake up early.")], "site_id string, ord int, url string, text string")
    draft = [("s", "Plain", [("Plain", "d", [("We make good tea", "https://a.com/")]), ("Bold", "d", [("We never said that", "https://a.com/")])], [("Early", "people who wake up early", "https://a.com/")], ["people", "robots"])]
    d = spark.createDataFrame(draft, "site_id string, summary string, traits array<struct<name:string,description:string,evidence:array<struct<quote:string,source_url:string>>>>, value_props array<struct<title:string,quote:string,source_url:string>>, audience array<string>")
    got = quotes.check_voice(d, page).first()
    assert [t.name for t in got.traits] == ["Plain"] and (got.quotes_checked, got.quotes_verified) == (3, 2)
    assert [a.phrase for a in got.audience] == ["people"] and "Bold" in got.warnings[0]


def test_reuse_is_open_at_the_old_end(spark):
    made = spark.sql("select 'k' key, 1L made_id, timestamp'2024-01-01 00:00:00' made_at")
    asked = spark.sql("select 'k' key, 1L request_id, timestamp'2024-01-01 23:59:59' ts union all select 'k', 2L, timestamp'2024-01-02 00:00:00' union all select 'x', 3L, timestamp'2024-01-01 01:00:00'")
    assert {r.request_id: r.reused_id for r in jobs.reuse_asof(asked, made).collect()} == {1: 1, 2: None, 3: None}


def test_budget_fold(spark):
    rows = [("s", 0, "u0", None, "same line\n" + "a" * 50), ("s", 1, "u1", "about", "Same Line\nnew words here"), ("s", 2, "u2", "blog", "b " * 400)]
    docs = spark.createDataFrame(rows, "site_id string, ord int, url string, kind string, text string")
    got = [r.excerpt for r in excerpts.pick_text(docs, homepage=100, page=60, total=300, least=20).orderBy("ord").collect()]
    assert got[0] == "same line\n" + "a" * 50 and got[1] == "new words here" and len(got[2]) <= 60


def test_exports(spark):
    schema = "site_id long, name string, colors array<struct<role:string,hex:string,name:string>>, fonts array<struct<role:string,family:string,fallback:string,weights:array<int>>>, traits array<struct<name:string,description:string,quotes:array<string>>>, value_props array<struct<title:string,quote:string>>"
    g = spark.createDataFrame([(1, 'A */ "x"', [("primary", "#2f5d50", "evil */ name")], [("body", 'Fa"ce', "serif", [400])], [], [])], schema)
    css = exports.export(g, "css").first().content
    assert "#2F5D50" in css and css.count("*/") == css.count("/*") and '\\"' in css
    tokens = json.loads(exports.export(g, "tokens").first().content)
    assert tokens["color"]["primary"]["$value"]["hex"] == "#2f5d50"
    assert json.loads(exports.export(g, "json").first().content)["name"] == 'A */ "x"'
    assert exports.export(g, "voice").count() == 0


def test_robot_check_and_links(spark):
    html = '<html lang="en-GB"><title> A &amp; B </title><script>var a = "<a href=/no>no</a>";</script><a href="/x#y">X  y</a><a href="/x">again</a><a href="mailto:a@b.c">m</a></html>'
    p = spark.createDataFrame([(1, "https://a.com/", html)], "page_id long, url string, html string")
    assert p.select(pages.title(F.col("html")).alias("t"), pages.language(F.col("html")).alias("l")).first() == ("A & B", "en-gb")
    assert "https://a.com/x" in [r.url for r in pages.links(p).collect()]
    assert spark.range(1).select(pages.is_robot_check(F.lit("Are you a robot? Prove it"), F.lit("x")).alias("x")).first().x


def lab(code):
    v = [int(code[i : i + 2], 16) / 255 for i in (1, 3, 5)]
    r, g, b = (x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4 for x in v)
    x, y, z = (r * 0.4124 + g * 0.3576 + b * 0.1805) / 0.95047, r * 0.2126 + g * 0.7152 + b * 0.0722, (r * 0.0193 + g * 0.1192 + b * 0.9505) / 1.08883
    f = lambda t: t ** (1 / 3) if t > (6 / 29) ** 3 else t / (3 * (6 / 29) ** 2) + 4 / 29
    return 116 * f(y) - 16, 500 * (f(x) - f(y)), 200 * (f(y) - f(z))


def plain_twins(held, asked, same, grow):
    """The asked colours one by one, each against all that are held by then."""
    out = {}
    for site in {s for s, *_ in asked}:
        known = [h for s, h, _ in sorted(held, key=lambda r: r[2]) if s == site]
        for _, h, _ in sorted((r for r in asked if r[0] == site), key=lambda r: r[2]):
            near = [k for k in known if sum((x - y) ** 2 for x, y in zip(lab(k), lab(h))) ** 0.5 < same]
            out[site, h] = h if h in known else near[0] if near else h if grow else None
            if grow and h not in known and not near:
                known.append(h)
    return out


def test_twins_are_found_by_code_then_by_looks(spark):
    rng = random.Random(6)
    code = lambda: "#" + "".join(rng.choice("0369CF") * 2 for _ in range(3))
    held = sorted({(s, code()) for s in range(12) for _ in range(15)})
    asked = sorted({(s, code()) for s in range(13) for _ in range(40)})
    held = [(*r, i) for i, r in enumerate(rng.sample(held, len(held)))]
    asked = [(*r, i) for i, r in enumerate(rng.sample(asked, len(asked)))]
    h, a = spark.createDataFrame(held, "site_id int, hex string, place int"), spark.createDataFrame(asked, "site_id int, hex string, at int")
    for grow in (True, False):
        got = {(r.site_id, r.hex): r.twin for r in colours.twins(h, a, 14.0, grow).collect()}
        assert got == plain_twins(held, asked, 14.0, grow) and len(got) == len(asked)
    points = colours.with_points(h, a.withColumn("count", F.lit(2)), 14.0).collect()
    assert sum(p.points for p in points) == 2 * len(asked) and all(abs(sum(p.share for p in points if p.site_id == s) - 1) < 0.05 for s in range(13))
    marked = colours.logo_uses(h, a, 14.0).collect()
    assert sum(m.times for m in marked) == sum((lab(c)[1] ** 2 + lab(c)[2] ** 2) ** 0.5 >= colours.COLOURFUL for _, c, _ in asked)


def test_runs_that_go_on_behind_ended_ones(spark):
    runs = [("k", 1, 0, 100), ("k", 2, 10, 20), ("k", 3, 200, None), ("j", 4, 0, 50)]
    asked = [("k", 10, 15), ("k", 11, 30), ("k", 12, 100), ("k", 13, 999), ("j", 14, 50), ("j", 15, 0), ("x", 16, 1)]
    at = lambda c: F.timestamp_seconds(c).alias(c)
    r = spark.createDataFrame(runs, "key string, run_id long, started long, ended long").select("key", "run_id", at("started"), at("ended"))
    q = spark.createDataFrame(asked, "key string, request_id long, ts long").select("key", "request_id", at("ts"))
    assert {x.request_id: x.run_id for x in jobs.in_flight(q, r).collect()} == {10: 1, 11: 1, 12: None, 13: 3, 14: None, 15: 4, 16: None}


def test_pages_are_read_once_and_with_enough_text(spark):
    homes = spark.createDataFrame([("s", "kelso.example", "https://kelso.example/", "https://www.kelso.example/start", "en")], "site_id string, domain string, home_url string, requested_url string, language string")
    long = "word " * 50
    rows = [
        ("a", "", None, long), ("b", "https://kelso.example/a/", None, long), ("c", "https://www.kelso.example", None, long), ("d", "https://kelso.example/start", None, "x"), ("e", "", None, " x "),
        ("f", "https://kelso.example/g", None, "short"), ("g", "", None, long), ("h", "https://other.example/", None, long), ("i", "", "timeout", None), ("z", "", None, long),
    ]
    f = spark.createDataFrame([("s", f"https://kelso.example/{p}", "press", final, error, 200, t) for p, final, error, t in rows], "site_id string, url string, kind string, final_url string, error string, status int, text string")
    chosen = f.where("url <> 'https://kelso.example/z'").select("site_id", F.upper("url").alias("url"), F.lit("about").alias("kind"))
    got = {r.url[-1]: (r.state, r.reason, r.retry, r.kind) for r in reading.read_pages(f, homes, chosen).collect()}
    again, little = "it led to a page that was already read", "it had almost no text"
    want = {"a": ("read", None, False), "b": ("skipped", again, False), "c": ("skipped", again, False), "d": ("skipped", again, False), "e": ("skipped", little, True), "f": ("skipped", little, True), "g": ("read", None, False), "h": ("skipped", reading.ELSEWHERE, False), "i": ("skipped", reading.REASONS["timeout"], True)}
    assert got == {k: (*v, "about") for k, v in want.items()}


def test_site_keys(spark):
    urls_ = {"https://www.kelso.example/": "site:kelso.example", "http://kelso.example": "site:kelso.example", "https://www.kelso.example/de/": "site:kelso.example/de", "https://kelso.example:8443/a?l=fr#x": "site:kelso.example:8443/a?l=fr", "https://Kelso.example/?": "site:kelso.example"}
    rows = spark.createDataFrame([(u,) for u in urls_], "u string").select("u", urls.site_key(F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in rows} == urls_
