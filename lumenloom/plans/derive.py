"""Inputs derived from the star-schema tables: colours, page elements, links, searches, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["heading", "link", "button", "box", "text"]
REGIONS = ["header", "main", "footer", "nav", "page"]
PATH_WORDS = ["about", "careers", "newsroom", "blog", "pricing", "products", "our-story", "jobs", "logos", "login", "tea", "a.pdf"]
LINK_WORDS = ["", "About us", "Careers at the mill", "Our mission", "Press kit", "News", "See our plans"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_of(value: Column) -> Column:
    return F.concat(F.lit("#"), F.upper(F.substring(F.md5(value.cast("string").cast("binary")), 1, 6)))


def pick(names: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), index.cast("int") + 1)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo elements from lineitem: one site for each supplier."""
    i = table(spark, sf_dir, "lineitem")
    promo = (F.col("l_linestatus") == "F") & (F.col("l_partkey") % 7 == 0)
    return i.select(
        F.col("l_suppkey").alias("site_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        pick(KINDS, F.col("l_orderkey") % 5).alias("kind"), pick(REGIONS, F.col("l_partkey") % 5).alias("region"),
        (F.col("l_partkey") % 3).cast("double").alias("x"), (F.col("l_orderkey") % 4 * 800).cast("double").alias("y"),
        (F.col("l_quantity") * 4).alias("w"), (F.col("l_linenumber") * 20).cast("double").alias("h"),
        F.round(F.col("l_tax") * 100).cast("int").alias("chars"), (10 + F.col("l_orderkey") % 30).cast("double").alias("size"),
        hex_of(F.col("l_partkey") % 24).alias("color"), F.when(F.col("l_orderkey") % 2 == 0, F.lit("#FFFFFF")).otherwise("#222222").alias("back"),
        F.when(F.col("l_partkey") % 3 == 0, hex_of(F.col("l_orderkey") % 16)).alias("bg"), F.when(F.col("l_partkey") % 4 == 0, hex_of(F.col("l_orderkey") % 12)).alias("border"),
        promo.alias("promo"), (F.col("l_returnflag") == "R").alias("on_image"), F.lit("#FFFFFF").alias("page_background"),
        F.concat(F.lit('"Face '), (F.col("l_partkey") % 6).cast("string"), F.lit('", serif')).alias("font"), ((F.col("l_orderkey") % 9 + 1) * 100).cast("int").alias("weight"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate links from pages: the host of the url, a path word from page_id, one site for each domain."""
    from lumenloom.functions import urls

    p = table(spark, sf_dir, "pages")
    host = urls.host(F.col("url"))
    deep = F.when(F.col("page_id") % 2 == 0, F.lit("/en/")).otherwise("/")
    return p.select(
        urls.site_domain(host).alias("site_id"), F.col("page_id").alias("pos"),
        F.concat(F.lit("https://"), host, deep, pick(PATH_WORDS, F.col("page_id") % 12)).alias("url"), pick(LINK_WORDS, F.col("page_id") % 7).alias("text"),
        F.when(F.col("page_id") % 3 == 0, F.lit("top")).otherwise("footer").alias("place"), F.when(F.col("page_id") % 5 == 0, F.lit("link")).otherwise("search").alias("origin"),
    )


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A homepage for each site of the candidate links."""
    from lumenloom.functions import urls

    site = urls.site_domain(urls.host(F.col("url")))
    d = table(spark, sf_dir, "pages").select(site.alias("site_id")).distinct()
    return d.select("site_id", F.col("site_id").alias("domain"), F.concat(F.lit("https://"), "site_id", F.lit("/")).alias("home_url"), F.concat(F.lit("https://www."), "site_id", F.lit("/en/about")).alias("requested_url"), F.lit("en").alias("language"))


def searches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Searches for each supplier's name, and the results that those of one nation share: the hosts of its suppliers."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    host = F.when(k % 6 == 0, F.lit("www.wikipedia.org")).otherwise(F.concat(F.when(k % 4 == 0, F.lit("shop.")).otherwise("www."), F.lit("brand"), (k % 40).cast("string"), F.lit(".com")))
    name = F.when(k % 15 == 0, F.lit("Wikipedia")).otherwise(F.concat(F.lit("Bränd "), (k % 40).cast("string"), F.lit(" Inc")))
    url = F.concat(F.lit("https://"), host, F.when(k % 2 == 0, F.lit("/a/b")).otherwise("/"))
    return s.select(k.alias("query_id"), F.col("s_nationkey").alias("list_id"), name.alias("name")), s.select(F.col("s_nationkey").alias("list_id"), (k + 1).alias("position"), url.alias("url"))


def branded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url and html of `pages` with pictures put in: logos in the way home, header, body and footer, those of others, icons."""
    p = table(spark, sf_dir, "pages").where("html IS NOT NULL")
    n = F.col("page_id")
    num = n.cast("string")
    put = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    top = pick_text(n % 6, [
        put('<header><a href="/" aria-label="Example home"><svg viewBox="0 0 90 30"><path d="M0 0h', num, 'v1"/></svg></a></header>'),
        put('<header class="top"><img class="logo" src="/img/', num, '.png" alt="Example logo"></header>'),
        put('<section class="clients"><img class="logo" src="/c/', num, '.svg" alt="Osier Bank logo"><img src="/d/', num, '.svg" alt="Example"></section>'),
        put('<header><img class="logo" src="/o.png" alt="Osier Bank logo"><img src="/sale-banner.png" class="logo" alt="Sale"></header>'),
        put('<section><img src="/f/', num, '.jpg" alt="Example logo"></section>'),
        put('<header><svg width="16" height="16" class="chevron"><path d="M0 0l8 8"/></svg><a href="/en-us/"><img src="/e/', num, '.png"></a></header>'),
    ])
    low = pick_text(n % 4, [put('<img src="/f/', num, '.jpg" alt="Example logo">'), F.lit('<img class="logo" src="/g.webp">'), F.lit('<img src="/tiny.png" class="logo" alt="Example" width="9">'), F.lit("")])
    with_top = F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), top))
    return p.select("page_id", "url", F.replace(with_top, F.lit("<footer>"), F.concat(F.lit("<footer>"), low)).alias("html"))


def styled_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drawing_id and svg: parts as drawings whose fill is said by an attribute, a class rule, a style, the paint that was seen, or several of these."""
    k = F.col("p_partkey")
    num = k.cast("string")
    some = lambda every, *parts: F.when(k % every == 0, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])).otherwise("")
    markup = F.concat(
        F.lit('<svg viewBox="0 0 90 9">'), some(3, "<style>.b{fill:red} .a{fill:", hex_of(k), "}</style>"), F.lit('<path d="M0 0h'), num, F.lit('" class="a"'), some(2, ' fill="', hex_of(k + 1), '"'),
        some(5, ' style="fill:', hex_of(k + 2), '"'), some(7, ' data-mark-paint="fill:', hex_of(k + 3), '"'), some(13, ' visibility="hidden"'), F.lit('/><g opacity="'), (k % 4).cast("string"),
        F.lit('"><rect width="4"'), some(6, ' fill="none"'), F.lit(' onload="x()"/></g></svg>'),
    )
    return table(spark, sf_dir, "part").select(k.alias("drawing_id"), markup.alias("svg"))


def pick_text(index: Column, texts: list[Column]) -> Column:
    found = F.lit(None).cast("string")
    for i, t in enumerate(texts):
        found = F.when(index == i, t).otherwise(found)
    return found


def landed_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id and raw: each order as a measurement whose elements are its line items. Some elements, fonts and colours have a flaw, some measurements too."""
    put = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    n = F.col("l_partkey")
    item = pick_text(n % 16, [
        F.lit('{"kind":"box","color":"red"}'), F.lit('{"weight":400.5,"w":1}'), F.lit('{"kind":"blob","color":"red"}'), F.lit("7"), F.lit('{"w":"wide"}'), F.lit('{"w":" 12.5 ","weight":"700"}'), F.lit('{"region":null}'),
        F.lit('{"on_image":"perhaps"}'),
    ])
    plain = put('{"kind":"', pick(KINDS, n % 5), '","w":', F.col("l_quantity").cast("int").cast("string"), ',"color":"', hex_of(n), '","bg":null,"more":[1]}')
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.coalesce(item, plain).alias("item")).alias("one"))
    of_order = i.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["item"]), ",").alias("items"))
    k = F.col("o_orderkey")
    url = F.when(k % 29 == 0, F.lit("")).otherwise(put('"url":"https://a', k.cast("string"), '.com/",'))
    view = F.when(k % 23 == 0, F.lit("")).when(k % 19 == 0, F.lit('"viewport":{"width":"wide","height":900},')).otherwise('"viewport":{"width":1440,"height":900},')
    back = F.when(k % 31 == 0, F.lit('"page_background":"white",')).otherwise("")
    rest = put('"fonts":[{"family":"A"},{"weight":"700"},{"family":', (k % 3).cast("string"), '}],"samples":{"colors":{"#FFFFFF":', (k % 90).cast("string"), ',"#12345":4,"#000000":"x"},"total":90}}')
    raw = put("{", url, view, back, '"elements":[', F.coalesce("items", F.lit("")), "],", rest)
    raw = F.when(k % 37 == 0, F.substring(raw, 1, 40)).when(k % 41 == 0, F.lit("[1,2]")).otherwise(raw)
    # A broadcast would leave all measurements to the tasks that read orders, one for a small file; checking them is most of the work.
    return table(spark, sf_dir, "orders").join(of_order.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left").select(k.alias("site_id"), raw.alias("raw"))


def searches_in_turn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names of suppliers, one in four a platform's; results on the platform for some of these, and seven results of the web for each."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("query_id"), F.when(k % 4 == 0, pick(["Wikipedia", "Reddit", "X"], F.floor(k / 4) % 3)).otherwise(F.concat(F.lit("Bränd "), (k % 40).cast("string"), F.lit(" Inc"))).alias("name"))
    q = F.col("query_id")
    host = pick(["en.wikipedia.org", "www.reddit.com", "x.com"], F.floor(q / 4) % 3)
    own = s.where((q % 4 == 0) & (q % 5 > 1)).select("query_id", F.explode(F.sequence(F.lit(1), (q % 3).cast("int") + 1)).alias("position"))
    own = own.select("query_id", "position", F.concat(F.lit("https://"), F.when((q % 5 == 2) & (F.col("position") == 1), F.lit("a.example.org")).otherwise(host), F.lit("/w/"), F.col("position").cast("string")).alias("url"))
    web = s.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("position"))
    m = ((q + F.col("position") * 13) % 40).cast("string")
    lead = F.when(F.col("position") % 3 == 0, F.lit("shop.")).otherwise("www.")
    web = web.select("query_id", "position", F.concat(F.lit("https://"), lead, F.lit("brand"), F.when(F.col("position") == 5, (q % 40).cast("string")).otherwise(m), F.lit(".com"), F.when(F.col("position") % 2 == 0, F.lit("/a/b")).otherwise("/")).alias("url"))
    return s, own, web


def site_searches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of homepages, outcomes of two searches for each site and what they found, from the candidate links of `pages`."""
    all_ = links(spark, sf_dir)
    linked = all_.where("origin = 'link'").select("site_id", "pos", "url", "text", "place")
    found = all_.where("origin = 'search'").select("site_id", F.when(F.col("pos") % 2 == 0, 2).otherwise(1).alias("search"), F.col("pos").alias("position"), "url", F.col("text").alias("title"))
    each = homes(spark, sf_dir).select("site_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("search"))
    luck = F.substring(F.md5(F.concat("site_id", F.col("search").cast("string")).cast("binary")), 1, 1)
    status = F.when(luck.isin("0", "1", "2"), F.lit("rate_limited")).when(luck == "3", F.lit("unavailable")).when(luck == "4", F.lit("no_allowance")).otherwise("ok")
    return linked, each.select("site_id", "search", status.alias("status")), found


def copied_logos(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents of pages, three in four with a copied logo, and the files of some: the pages' html as drawings, some as pictures that are none."""
    p = table(spark, sf_dir, "pages")
    n = F.col("page_id")
    ext = F.when(n % 7 == 0, F.lit("png")).otherwise("svg")
    copied = F.concat(F.lit("/api/v1/guides/bg_"), n.cast("string"), F.lit("/logos/"), (n % 5 + 1).cast("string"), F.lit("."), ext)
    primary = F.when(n % 11 == 0, F.lit(None).cast("string")).when(n % 4 == 0, F.col("url")).otherwise(copied)
    one = lambda method, url: F.struct(F.lit(method).alias("method"), url.alias("url"))
    alternates = F.when(n % 6 == 0, F.array(one("og-image", F.lit("https://a.org/p.png")))).when(n % 6 == 1, F.array(one("header", F.lit("data:image/png;base64,aa")), one("header", F.lit("https://a.org/h.png")))).otherwise(F.array().cast("array<struct<method:string,url:string>>"))
    guides = p.select("page_id", primary.alias("primary"), alternates.alias("alternates"), F.when(n % 2 == 0, F.lit("https://a.org/favicon.ico")).alias("favicon"))
    content = F.when(n % 14 == 0, F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.col("url").cast("binary"))).otherwise(F.col("html").cast("binary"))
    files = p.where((n % 3 != 0) & F.col("html").isNotNull()).select(F.concat(F.lit("bg_"), n.cast("string")).alias("job_id"), (n % 5 + 1).cast("int").alias("number"), ext.alias("extension"), content.alias("content"))
    return guides, files.withColumn("length", F.octet_length("content").cast("long"))
