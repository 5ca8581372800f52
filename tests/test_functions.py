import pytest
from pyspark.sql import functions as F

from lumenloom.functions import color, names, text, urls


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_contrast_and_levels(spark):
    assert one(spark, color.contrast_ratio(F.col("a"), F.col("b")), a="#000000", b="#FFFFFF") == pytest.approx(21)
    assert one(spark, color.luminance(F.col("a")), a="not a colour") is None
    levels = [spark.range(1).select(color.wcag_level(F.lit(x)).alias("x")).first().x for x in (7.0, 4.5, 3.0, 2.99)]
    assert levels == ["AAA", "AA", "AA-large", "fail"]


def test_lab_of_white_and_red(spark):
    white, red = (one(spark, color.lab(F.col("a")), a=c) for c in ("#FFFFFF", "#FF0000"))
    assert (white.l, white.a, white.b) == pytest.approx((100, 0, 0), abs=0.02)
    assert (red.l, red.a, red.b) == pytest.approx((53.24, 80.09, 67.22), abs=0.02)
    assert one(spark, color.delta_e(F.col("a"), F.col("b")), a="#FF0000", b="#FF0000") == 0


def test_css_colours(spark):
    assert one(spark, color.css_to_hex(F.col("a")), a="#fa4") == "#FFAA44"
    assert one(spark, color.css_to_hex(F.col("a")), a="rgba(0, 0, 0, 0.5)") == "#808080"
    assert one(spark, color.css_to_hex(F.col("a")), a="rgba(0, 0, 0, 0)") is None


def test_name_match(spark):
    cases = [
        ("Fenwick & Daughters", "fenwickanddaughters", 1.0), ("The Ottery Press Ltd", "ottery-press", 1.0), ("Harrow Lane Bakery", "harrowlane", 0.8), ("Tarn", "tarnwater", 0.8),
        ("Moss and Rye", "ryemoss", 0.7), ("Quillon Works", "getquillon", 0.4), ("Ox", "oxide", 0.0), ("Larch", "", 0.0), ("Ltd", "ltd", 0.0), ("Déjà Blue", "dejablue", 1.0),
    ]
    got = spark.createDataFrame(cases, "a string, b string, score double").select("a", names.name_match(F.col("a"), F.col("b")).alias("x"), "score").collect()
    assert [(r.a, r.x) for r in got] == [(r.a, r.score) for r in got]


def test_parse_queries(spark):
    accented = "mühle.at".encode("idna").decode()
    cases = [
        ("  Moss  &  Rye's ", "name", None, None), ("Dr. Thistle", "name", None, None), ("otterypress.net", "url", "https://otterypress.net/", "otterypress.net"),
        ("HTTP://OtteryPress.NET:8081", "url", "http://otterypress.net:8081/", "otterypress.net"), ("mühle.at", "url", f"https://{accented}/", accented),
        ("https://otterypress.net/list?by=year#new", "url", "https://otterypress.net/list?by=year", "otterypress.net"), ("data:text/html,x", None, None, None),
        ("http://192.168.7.7/", None, None, None), ("", None, None, None), (None, None, None, None),
    ]
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, a string").select("i", urls.parse_queries(F.col("a")).alias("x")).orderBy("i").collect()
    for (raw, kind, url, host), r in zip(cases, got):
        assert r.x.kind == kind, raw
        assert (r.x.url, r.x.host) == (url, host) if kind else r.x.error, raw


def test_site_domain(spark):
    cases = [("shop.otterypress.co.nz", "otterypress.co.nz", "otterypress"), ("www.moss.netlify.app", "moss.netlify.app", "moss"), ("x.y.quillon.org", "quillon.org", "quillon"), ("quillon.org.", "quillon.org", "quillon")]
    got = spark.createDataFrame([c[:1] for c in cases], "a string").select("a", urls.site_domain(F.col("a")).alias("d"), urls.main_label(F.col("a")).alias("l")).collect()
    assert sorted(map(tuple, got)) == sorted(cases)


def test_same_brand(spark):
    cases = [("help.quillon", "quillon.org", True), ("docs.quillon.org", "quillon.org", True), ("quillon.dev", "quillon.org", False), ("quillon.org.fake.net", "quillon.org", False), ("notquillon.org", "quillon.org", False)]
    got = spark.createDataFrame(cases, "a string, b string, same boolean").select("a", urls.same_brand(F.col("a"), F.col("b")).alias("x"), "same").collect()
    assert [(r.a, r.x) for r in got] == [(r.a, r.same) for r in got]


def test_markdown_lines(spark):
    raw = "# A **big** day\n\n- [Link](https://x.y) and `code`\n---\n| one | two |\n|---|---|\n> quoted &amp; told\nsnake_case_name stays"
    assert one(spark, text.plain_lines(F.col("a")), a=raw) == ["A big day", "Link and code", "one", "two", "quoted & told", "snake_case_name stays"]


def test_whole_words(spark):
    assert one(spark, text.contains_words(F.col("a"), F.col("b")), a="we like ink.", b="ink") is True
    assert one(spark, text.contains_words(F.col("a"), F.col("b")), a="we think", b="ink") is False
    assert one(spark, text.contains_words(F.col("a"), F.col("b")), a="costs (a+b)", b="(a+b)") is True


def test_scalars(spark):
    assert one(spark, text.slug(F.col("a")), a=" Café Ørsted & Söhne ") == "cafe-rsted-sohne"
    assert one(spark, text.clean(F.col("a"), 5), a="  a   b  c d") == "a b c"
    assert one(spark, text.joined(F.split("a", ",")), a="x,y,z") == "x, y and z"
