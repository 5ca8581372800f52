from lumenloom.operators import turns

HOME = "site_id string, domain string, home_url string, requested_url string, language string"


def test_settled_names_are_not_looked_up_again(spark, tmp_path):
    asked = spark.createDataFrame([(1, "Reddit"), (2, "Reddit"), (3, "Osier Mill"), (4, "Nobody"), (5, None)], "query_id int, name string")
    own = spark.createDataFrame([(1, 1, "https://www.reddit.com/r/a"), (2, 1, "https://elsewhere.org/"), (3, 1, "https://www.reddit.com/")], "query_id int, position int, url string")
    web = [(1, 1, "https://reddit.org/"), (2, 1, "https://reddit.org/"), (3, 1, "https://en.wikipedia.org/wiki/Osier"), (3, 2, "https://www.osiermill.com/about/us"), (4, 1, "ftp://nobody.org/")]
    turns.in_buckets(spark.createDataFrame(web, "query_id int, position int, url string"), "query_id", str(tmp_path / "web"), 16)
    landed = spark.read.parquet(str(tmp_path / "web"))
    got = {r["query_id"]: (r["url"], r["search"]) for r in turns.official_sites_in_turn(asked, own, landed).collect()}
    assert got == {1: ("https://www.reddit.com/", 1), 2: ("https://reddit.org/", 2), 3: ("https://www.osiermill.com/", 2), 4: (None, None), 5: (None, None)}


def test_buckets_of_settled_keys_are_not_read(spark, tmp_path):
    rows = spark.range(200).selectExpr("id % 50 AS k", "id AS n")
    turns.in_buckets(rows, "k", str(tmp_path / "b"), 32)
    landed = spark.read.parquet(str(tmp_path / "b"))
    open_ = spark.createDataFrame([(7,), (11,), (999,)], "k long")
    found = turns.only_open(landed, open_, "k")
    assert sorted(r["n"] for r in found.collect()) == [7, 11, 57, 61, 107, 111, 157, 161]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket_of_32" in plan.split("PartitionFilters")[1].split("]")[0]
    assert turns.only_open(landed, open_.where("k < 0"), "k").count() == 0
    assert turns.only_open(rows, open_, "k").count() == 8


def test_pages_after_one_search_or_two(spark):
    sites = ["full.com", "thin.com", "stop.com", "busy.com", "bare.com"]
    homes = spark.createDataFrame([(s, s, f"https://{s}/", None, "en") for s in sites], HOME)
    full = [("about", "full.com"), ("mission", "full.com"), ("careers", "full.com"), ("about", "thin.com"), ("about", "stop.com"), ("about", "busy.com")]
    links = spark.createDataFrame([(s, i, f"https://{s}/{w}", w, "top") for i, (w, s) in enumerate(full)], "site_id string, pos long, url string, text string, place string")
    outcomes = [(s, n, "ok") for s in ("full.com", "thin.com", "bare.com") for n in (1, 2)] + [("stop.com", 1, "ok"), ("stop.com", 2, "no_allowance"), ("busy.com", 1, "rate_limited"), ("busy.com", 2, "unavailable")]
    found = [(s, n, 1, f"https://{s}/{w}", None) for s in sites for n, w in ((1, "press"), (2, "pricing"))] + [("thin.com", 1, 2, "https://other.org/press", "Press")]
    pages, told = turns.pages_in_turn(homes, links, spark.createDataFrame(outcomes, "site_id string, search int, status string"), spark.createDataFrame(found, "site_id string, search int, position long, url string, title string"))
    got = {}
    for r in pages.orderBy("site_id", "rank").collect():
        got.setdefault(r["site_id"], []).append((r["kind"], r["origin"]))
    assert {s: sorted(p) for s, p in got.items()} == {
        "full.com": [("about", "link"), ("careers", "link"), ("mission", "link"), ("press", "search")], "thin.com": [("about", "link"), ("press", "search"), ("pricing", "search")],
        "busy.com": [("about", "link")], "bare.com": [("press", "search"), ("pricing", "search")],
    }
    state = {r["site_id"]: (r["thin"], r["search_calls"], r["searches_failed"], r["found_by_search"], r["stopped"]) for r in told.collect()}
    assert state == {"full.com": (False, 1, 0, 1, None), "thin.com": (True, 2, 0, 2, None), "stop.com": (True, 2, 0, 0, "no_allowance"), "busy.com": (True, 2, 2, 0, None), "bare.com": (True, 2, 0, 2, None)}


def test_unknown_links(spark):
    content = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "b"), (2, 0, "a"), (1, 3, None)], "site_id int, pos int, url string")
    known = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "site_id int, url string")
    assert sorted((r["site_id"], r["pos"], r["url"] or "") for r in turns.unknown_links(content.where("url IS NOT NULL"), known).collect()) == [(1, 1, "b"), (2, 0, "a")]
