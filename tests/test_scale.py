"""Steps that grew faster than their input or held too much in one place."""

from pyspark.sql import functions as F

from lumenloom.functions import color, text
from lumenloom.operators import colours, discover, quotes, typography
from lumenloom.plans import derive

FOLDER = "/root/testdata/sf0.001"


def test_shared_lists_give_what_each_query_would(spark):
    urls = ["https://www.acme.com/", "https://shop.acme.com/a/b", "https://www.acme.com/", "https://www.wikipedia.org/x", "ftp://acme.com/", None, "https://brandt.com/"]
    results = spark.createDataFrame([(n, i * 7 % 5, u) for n in (1, 2) for i, u in enumerate(urls[n - 1 :])], "list_id int, position int, url string")
    queries = spark.createDataFrame([(i, i % 4, ["Acme Inc", "Wikipedia", "Brandt & Co", None, "Nobody"][i % 5]) for i in range(40)], "query_id int, list_id int, name string")
    want = discover.official_sites(queries.join(results, "list_id").select("query_id", "name", "position", "url"))
    got = discover.official_sites_of_lists(queries, results)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.count() == 20


def test_searches_grow_with_suppliers(spark):
    queries, results = derive.searches(spark, FOLDER)
    n = derive.table(spark, FOLDER, "supplier").count()
    assert queries.count() == results.count() == n  # not the number of pairs


def test_nearest_starts_by_density_and_finds_far_ones(spark, monkeypatch):
    monkeypatch.setattr(colours, "TOGETHER", 3)  # arrays in parts
    monkeypatch.setattr(colours, "BROADCAST_HELD", 0)
    code = lambda df, n: df.select(F.concat(F.lit("#"), F.upper(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 6))).alias(n))
    wanted = code(spark.range(60), "hex").union(spark.createDataFrame([("#FFFFFF",), ("#nope",)], "hex string"))
    for held in (code(spark.range(100, 300), "near"), spark.createDataFrame([("#000000",), ("#000001",)], "near string")):
        lab = lambda df: {r[0]: r.p for r in df.distinct().select("*", color.lab(F.col(df.columns[0])).alias("p")).collect() if r.p and r.p.l is not None}
        w, h = lab(wanted), lab(held)
        want = {x: min((round(sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5, 9), y) for y, q in h.items()) for x, p in w.items()}
        got = {r.hex: (r.de, r.near) for r in colours.nearest(wanted, held).collect()}
        assert {x: y for x, (_, y) in got.items()} == {x: y for x, (_, y) in want.items()}
        assert all(abs(got[x][0] - want[x][0]) < 1e-8 for x in want)


def test_held_colours_are_never_broadcast(spark):
    """By their size on disk they look small; exploded and hashed they filled the driver."""
    held = spark.createDataFrame([(1, "#102030", 1)], "site_id int, hex string, place int")
    asked = spark.createDataFrame([(1, "#102031", 1)], "site_id int, hex string, at int")
    plan = colours.twins(held, asked, 14.0, grow=False)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_twins_of_crowded_sites(spark, monkeypatch):
    rows = lambda at, n: [(s, f"#{(i * 7919 + at * 31) % 0xFFFFFF:06X}", i) for s in (1, 2) for i in range(n * s)]
    held = spark.createDataFrame(rows(1, 40), "site_id int, hex string, place int")
    asked = spark.createDataFrame([*rows(2, 30), *rows(1, 3), (1, "odd", 900), (3, "#000000", 1)], "site_id int, hex string, at int")
    whole = colours.twins(held, asked, 14.0).collect()
    monkeypatch.setattr(colours, "CROWDED", 50)
    monkeypatch.setattr(colours, "TOGETHER", 4)
    assert sorted(colours.twins(held, asked, 14.0).collect()) == sorted(whole) and len(whole) == asked.count()


def test_lines_without_marks_are_read_the_same(spark):
    """Shortcuts for plain lines give what all steps would."""
    import random

    rng = random.Random(5)
    parts = ["a", "B", "word", " ", "  ", "\t", "\u00a0", "\u3000", "\u200b", "’", "“", "*", "__", "_", "`", "[x](y)", "![p](q)", "<b>", "<http:", "&amp;", "\\", "# ", "- ", "> ", "1. ", "|", "---", ":", "\n", "\r\n", ".", "\x85"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))),) for _ in range(4000)]

    def all_steps(markdown):
        lines = F.split(F.translate(markdown, text.INVISIBLE, ""), r"\r\n|[\n\r\x0B\f\x{85}\x{2028}\x{2029}]")

        def seen(line):
            shown = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, text.LEADING, ""), text.PICTURE, ""), text.LINKED, "$1")
            shown = F.regexp_replace(F.regexp_replace(shown, text.AUTOLINK, ""), text.ELEMENT, " ")
            shown = F.regexp_replace(F.regexp_replace(shown, text.STRONG_MARK, ""), text.LIGHT_MARK, "")
            return text.decoded(F.regexp_replace(F.replace(shown, F.lit("`"), F.lit("")), text.ESCAPED, "$1"))

        cells = lambda x: F.when(x.rlike(r"^\s*\|"), F.split(F.trim(x, F.lit("| ")), r"\|")).otherwise(F.array(x))
        told = F.transform(F.filter(lines, lambda x: ~x.rlike(text.DRAWN)), lambda x: cells(seen(x)))
        return F.transform(F.filter(F.transform(F.flatten(told), text.squeeze), lambda x: x != ""), text.as_compared)

    df = spark.createDataFrame(rows, "t string").repartition(4)
    assert df.where(~text.compared_lines(F.col("t")).eqNullSafe(all_steps(F.col("t")))).limit(3).collect() == []


def test_a_lines_work_does_not_follow_wanted_keys(spark):
    lines = spark.createDataFrame([(1, 0, "one two three four"), (2, 0, "one two three")], "site_id int, ord int, line string")
    wanted = spark.createDataFrame([(1, 7)], "site_id int, gram long").union(lines.where("site_id = 1").select("site_id", F.explode(quotes.shingle_keys(F.col("line")))))
    found = quotes.lines_with(lines, wanted, quotes.shingle_keys(F.col("line")), ["ord"])
    assert [(r.site_id, r.line) for r in found.collect()] == [(1, "one two three four")] * 2
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_font_stacks_are_read_once(spark):
    t = typography.typography(derive.elements(spark, FOLDER))
    assert "regexp_extract_all" not in t._jdf.queryExecution().optimizedPlan().toString()


def test_a_measurement_is_opened_once(spark):
    """Two look-ups for each possible field of each element, and its facts written for later, took most of the time."""
    from lumenloom.sources import measurements

    m = measurements.checked_measurements(spark.createDataFrame([("{}",)], "raw string"))
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "$.promo" not in plan and "facts:array" not in m.select("elements")._jdf.queryExecution().analyzed().toString()
    assert plan.count("STRUCT<tag: VARIANT") <= 2


def test_odd_types_are_told_as_before(spark):
    import json

    from lumenloom.sources import measurements

    odd = [{"w": {}}, {"w": []}, {"w": None}, {"w": True}, {"w": "NaN"}, {"w": "1e3"}, {"on_image": {}}, {"on_image": "YES"}, {"on_image": 1.0}, {"on_image": 2}, {"weight": True}, {"weight": 1e30}, {"color": 5}, {"bg": {}}, {"text": None}, {"heading": 9}, {"region": []}, None, [], "x"]
    whole = {"url": "u", "viewport": {"width": 1, "height": 2}, "page_height": True, "elements": odd}
    got = measurements.checked_measurements(spark.createDataFrame([(json.dumps(whole),), (json.dumps({**whole, "samples": None}),), (json.dumps({**whole, "elements": None}),), (json.dumps({**whole, "viewport": None}),)], "raw string")).collect()
    assert [r.error and r.error.split("shape: ")[1] for r in got] == [None, "samples: not an object", "elements: not a list", "viewport: not an object"]
    assert [(e.w, e.on_image, e.weight) for e in got[0].elements] == [(1.0, False, 400), (1000.0, False, 400), (0.0, True, 400), (0.0, True, 400), (0.0, False, 1), (0.0, False, 400)]
    assert got[0].left_out == {"elements": len(odd) - 6} and got[0].page_height == 0


def test_drawings_of_one_file_are_parsed_by_all_tasks(spark):
    """Many small drawings are few bytes: read as one or two partitions, they were parsed by one or two tasks."""
    from lumenloom.operators import svg

    drawings = spark.range(0, 64, 1, 1).select(F.col("id").alias("drawing_id"), F.lit('<svg><path d="M0"/></svg>').alias("svg"))
    found = svg.elements(drawings)
    assert len(found.inputFiles()) > 1 and found.count() == 128


def test_measurements_are_spread_over_tasks(spark):
    """With the items broadcast, all measurements of a small file of orders were checked by the one task that read it."""
    plan = derive.landed_measurements(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
