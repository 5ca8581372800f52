"""The library's operators over the tables of the driver."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenloom.functions import color, labels, text, urls
from lumenloom.operators import areas, colours, discover, excerpts, exports, guides, head, homepage, jobs, logos, pages, quotes, reading, svg, tree, turns, typography
from lumenloom.plans.derive import branded_pages, copied_logos, elements, hex_of, homes, landed_measurements, links, pick, searches, searches_in_turn, site_searches, styled_drawings, table
from lumenloom.sources import measurements, saved
from lumenloom.streaming import limits


def _rounded(name, digits):
    """Rounded so that the order in which a sum was made decides no tie."""
    return F.round(F.col(name) + 10.0 ** -(digits + 3 if digits > 3 else digits + 4), digits).alias(name)


def _part_colours(spark, d, remainder):
    """Sites of 16 parts, half of which are text colours."""
    p = table(spark, d, "part").where(F.col("p_partkey") % 2 == remainder)
    return p.select(F.floor(F.col("p_partkey") / 16).alias("site_id"), hex_of(F.col("p_partkey")).alias("hex"))


def contrast_matrix(spark: SparkSession, d: str) -> DataFrame:
    return colours.contrast_pairs(_part_colours(spark, d, 0), _part_colours(spark, d, 1), ["site_id"])


def contrast_summary(spark: SparkSession, d: str) -> DataFrame:
    return colours.contrast_summary(contrast_matrix(spark, d), ["site_id"])


def contrast_pivot(spark: SparkSession, d: str) -> DataFrame:
    levels = ["AAA", "AA", "AA-large", "fail"]
    wide = contrast_matrix(spark, d).groupBy("fg").pivot("level", levels).agg(F.count(F.lit(1))).na.fill(0, levels)
    return wide.select("fg", F.col("AAA").alias("aaa"), F.col("AA").alias("aa"), F.col("AA-large").alias("aa_large"), F.col("fail").alias("fail"))


def color_lab(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", hex_of(F.col("p_partkey")).alias("hex")).withColumn("p", color.lab(F.col("hex")))
    return p.select("p_partkey", "hex", *[F.round(f"p.{c}", 4).alias(c) for c in "lab"], F.round(F.hypot("p.a", "p.b"), 4).alias("chroma"))


def color_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Each part colour's nearest supplier colour."""
    parts = table(spark, d, "part").select(hex_of(F.col("p_partkey")).alias("hex")).distinct()
    held = table(spark, d, "supplier").select(hex_of(F.col("s_suppkey")).alias("near")).distinct()
    return colours.nearest(parts, held).select("hex", "near", F.round("de", 4).alias("de"))


def stacked_copies(spark: SparkSession, d: str) -> DataFrame:
    return colours.without_stacked_copies(elements(spark, d)).groupBy("site_id").agg(F.count("*").alias("kept"), F.sum("pos").alias("pos_sum"))


def colour_uses(spark: SparkSession, d: str) -> DataFrame:
    u = colours.colour_uses(elements(spark, d))
    return u.select("site_id", "hex", "label", *[_rounded(c, 3) for c in ("weight", "text_on_page", "links")], "elements", "buttons", "first_pos")


def _site_colours(spark, d):
    by = colours.by_colour(colours.colour_uses(elements(spark, d)))
    return by.withColumn("is_background", F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("page_weight"), "hex")) == 1)


def palette_merge(spark: SparkSession, d: str) -> DataFrame:
    return colours.merge_lookalikes(_site_colours(spark, d), same=25.0)


def palette_roles(spark: SparkSession, d: str) -> DataFrame:
    return colours.palette_roles(_site_colours(spark, d))


def palette_chain(spark: SparkSession, d: str) -> DataFrame:
    return colours.palette(elements(spark, d), same=12.0)


def guide_chain(spark: SparkSession, d: str) -> DataFrame:
    """Documents from measured elements: palette and fonts of each supplier's site, as a style sheet with what is missing."""
    e = elements(spark, d)
    sites = e.select("site_id").distinct().withColumns({"name": F.concat(F.lit("Site "), F.col("site_id").cast("string")), "logo_url": F.lit("https://a/logo.svg")})
    g = guides.build_guides(sites, colours.palette(e, same=12.0), typography.typography(e))
    return g.select("site_id", exports.css_export().alias("content"), F.array_join("missing", ", ").alias("missing"))


def logo_places(spark: SparkSession, d: str) -> DataFrame:
    """Parts as logo candidates of sites: some keys twice, some of them small tab icons."""
    k = F.col("p_partkey")
    c = table(spark, d, "part").select(F.floor(k / 12).alias("site_id"), (k % 12).alias("pos"), F.concat(F.lit("k"), (k % 11).cast("string")).alias("key"), F.round(0.3 + (k * 7 % 10) / 20.0, 2).alias("confidence"), (k % 12 > 8).alias("small_icon"))
    return logos.rank_logos(c).select("site_id", "key", "pos", "confidence", F.col("rank").cast("long").alias("rank"))


def typography_by_role(spark: SparkSession, d: str) -> DataFrame:
    e = elements(spark, d)
    t = typography.typography(e.withColumn("font", F.when(F.col("pos") % 3 == 0, F.replace("font", F.lit("serif"), F.lit("Arial, sans-serif"))).otherwise(F.col("font"))))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",").alias(c)
    return t.select("site_id", "role", "family", "elements", joined("weights"), joined("sizes"), F.array_join("fallbacks", ",").alias("fallbacks"))


def first_screen_shares(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("site_id"), F.when(F.col("o_orderstatus") != "P", hex_of(F.col("o_orderkey") % 9)).alias("hex"))
    return colours.first_screen(points)


def _screen(spark, d):
    """Colours of sites in the order in which they are seen, and points of their first screens: some of the same colours, some near them, some new."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    site = F.floor(k / 40).alias("site_id")
    held = p.select(site, hex_of(k % 90).alias("hex"), "p_partkey").groupBy("site_id", "hex").agg(F.min("p_partkey").alias("place"))
    seen = p.select(site, hex_of(k * 7 % 130).alias("hex"), "p_partkey").groupBy("site_id", "hex").agg(F.min("p_partkey").alias("at"), F.sum(k % 11 + 1).alias("count"))
    return held, seen


def points_shared(spark: SparkSession, d: str) -> DataFrame:
    return colours.with_points(*_screen(spark, d), same=20.0).select("site_id", "hex", "points", F.round(F.col("share") + 1e-9, 3).alias("share"))


def logo_colours(spark: SparkSession, d: str) -> DataFrame:
    held, seen = _screen(spark, d)
    return colours.logo_uses(held, seen, same=20.0)


def site_domain_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    host = urls.host(F.col("url"))
    return p.groupBy(urls.site_domain(host).alias("domain")).agg(F.count("*").alias("pages"), F.count_distinct(host).alias("hosts"), F.min(urls.main_label(host)).alias("label"))


def page_key_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return pages.first_of_each_page(table(spark, d, "pages"))


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", pages.title(F.col("html")).alias("title"), pages.language(F.col("html")).alias("language"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return pages.links(table(spark, d, "pages").select("page_id", "url", "html"))


def page_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every element of every page, with the tokens at which it opens and closes."""
    n = tree.page_nodes(table(spark, d, "pages").select("page_id", "html"))
    return n.select("page_id", "n", "at", "end", "parent", "depth", "tag", F.try_element_at("attributes", F.lit("href")).alias("href"))


def link_places(spark: SparkSession, d: str) -> DataFrame:
    return homepage.links_with_place(table(spark, d, "pages")).select("page_id", "url", "text", "place")


def page_logos(spark: SparkSession, d: str) -> DataFrame:
    """Logo candidates of all pages, each given some pictures of its own and of others."""
    return homepage.logo_candidates(branded_pages(spark, d)).select("page_id", "method", "confidence", "url", "format", "label", F.length("svg").alias("drawn"))


def shapes_borrowed(spark: SparkSession, d: str) -> DataFrame:
    """Parts as shapes of documents of 60: chains of up to twenty, of which some end in a missing shape and some in a circle; every tenth is drawn."""
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("#s"), c.cast("string"))
    to = F.when(k % 20 < 19, k + 1).when(F.floor(k / 20) % 4 == 1, k - 5).when(F.floor(k / 20) % 4 == 2, -k)
    uses = F.when(to.isNull(), F.array().cast("array<string>")).otherwise(F.array(name(to)))
    shapes = table(spark, d, "part").select(F.floor(k / 60).alias("page_id"), name(k).alias("name"), (k % 60).alias("pos"), F.concat(F.lit("<g>"), k.cast("string"), F.lit("</g>")).alias("markup"), uses.alias("uses"))
    drawings = shapes.where("pos % 10 = 3").select("page_id", "pos", F.array("name").alias("uses"), F.array("name").alias("borrows"))
    return homepage.borrowed_shapes(drawings, shapes).select("page_id", "pos", F.array_join("shapes", "").alias("shapes"))


def svg_cascade(spark: SparkSession, d: str) -> DataFrame:
    return svg.cascaded(svg.elements(styled_drawings(spark, d)))


def svg_clean(spark: SparkSession, d: str) -> DataFrame:
    return svg.clean_drawings(styled_drawings(spark, d))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", pages.visible_text(F.col("html")).alias("text"))


def page_locale_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", urls.other_language(urls.path(F.col("url")), F.lit("/"), F.lit("en")).alias("other_language"))


def choose_pages_topk(spark: SparkSession, d: str) -> DataFrame:
    return discover.choose_pages(links(spark, d), homes(spark, d)).select("site_id", F.col("rank").cast("long").alias("rank"), "url", "kind", "origin", F.round("score", 4).alias("score"))


def official_site_rank(spark: SparkSession, d: str) -> DataFrame:
    return discover.official_sites_of_lists(*searches(spark, d)).select("query_id", "url", "host", F.round("score", 4).alias("score"), "name_matches")


def line_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("site_id"), F.col("doc_id").alias("ord"), "text")
    return excerpts.first_lines(docs).groupBy("site_id").agg(F.count("*").alias("lines"), F.sum(F.length("line").cast("long")).alias("chars"))


def excerpt_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("site_id"), F.col("doc_id").alias("ord"), "text")
    return excerpts.running_budget(docs, 5000).select("site_id", "ord", F.col("line_no").cast("long").alias("line_no"), F.col("used").cast("long").alias("used"))


def excerpt_pick(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as sites of a few pages each."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("site_id"), F.col("turn").alias("ord"), F.concat(F.lit("https://c/"), "turn").alias("url"), F.when(F.col("turn") > 0, F.lit("about")).alias("kind"), "text")
    return excerpts.pick_text(c, homepage=400, page=300, total=1000, least=50)


def word_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalise(F.col("text")).cast("binary")).alias("digest"))


def _quotes(spark, d):
    """Every line of every benchmark text is a quote."""
    b = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("n", "quote"))
    item = F.concat_ws(".", F.col("item_id").cast("string"), F.col("n").cast("string"))
    return b.select(F.lit(1).alias("site_id"), item.alias("item"), "quote", F.concat(F.lit("https://s/doc/"), F.col("item_id").cast("string")).alias("claimed_url"))


def _doc_pages(spark, d):
    return table(spark, d, "documents").select(F.lit(1).alias("site_id"), F.col("doc_id").alias("ord"), F.concat(F.lit("https://s/doc/"), F.col("doc_id").cast("string")).alias("url"), "text")


def quote_check(spark: SparkSession, d: str) -> DataFrame:
    return quotes.check_quotes(_quotes(spark, d), _doc_pages(spark, d)).select("item", "words", "found_url")


def quote_summary(spark: SparkSession, d: str) -> DataFrame:
    return quotes.quote_summary(quotes.check_quotes(_quotes(spark, d), _doc_pages(spark, d)), ["site_id"])


def mentions_semi(spark: SparkSession, d: str) -> DataFrame:
    phrases = _quotes(spark, d).select("site_id", "item", F.col("quote").alias("phrase"))
    return quotes.mentioned(phrases, _doc_pages(spark, d)).select("item")


def unquoted_anti(spark: SparkSession, d: str) -> DataFrame:
    return quotes.check_quotes(_quotes(spark, d), _doc_pages(spark, d)).where("found_url is null").select("item")


def numbered_names(spark: SparkSession, d: str) -> DataFrame:
    return jobs.numbered(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"])


def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    rows = c.select(F.col("conv_id").alias("site_id"), F.col("turn").alias("ord"), F.concat(F.lit("https://c/"), F.col("turn").cast("string")).alias("url"), F.initcap("role").alias("label"), F.col("text").alias("excerpt"))
    brands = c.select(F.col("conv_id").alias("site_id")).distinct().select("site_id", F.lit("A & B").alias("brand"), F.lit("a.com").alias("domain"))
    return excerpts.build_prompts(rows, brands)


def job_state_latest(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest_state(table(spark, d, "events"), ["user_id"], "event_type", "ts", "event_id")


def job_steps_pivot(spark: SparkSession, d: str) -> DataFrame:
    return jobs.steps_pivot(table(spark, d, "events"), "user_id", "event_type", ["view", "click", "signup", "purchase", "error"])


def reuse_asof_24h(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    requests = e.where("event_type <> 'signup'").select(F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"))
    made = e.where("event_type = 'signup'").select(F.col("user_id").alias("key"), F.col("event_id").alias("made_id"), F.col("ts").cast("timestamp").alias("made_at"))
    return jobs.reuse_asof(requests, made)


def daily_limit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.daily_limit(e, 2, "user_id", "ts", "event_id").select("event_id", "allowed", "wait_s")


def sliding_limiter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.sliding_limit(e, 3, 86400.0, "user_id", "ts", "event_id").select(F.col("id").alias("event_id"), "allowed", F.round("wait_s", 3).alias("wait_s"))


def limiter_returns(spark: SparkSession, d: str) -> DataFrame:
    """The sliding limiter where sign-ups give the last accepted hit back."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("back", F.col("event_type") == "signup")
    return jobs.sliding_limit(e, 3, 86400.0, "user_id", "ts", "event_id", "back").select(F.col("id").alias("event_id"), "allowed", F.round("wait_s", 3).alias("wait_s"))


def joined_runs(spark: SparkSession, d: str) -> DataFrame:
    """Views join a purchase of the last hour that still goes on: it takes value minutes."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = e.where("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), "ts")
    runs = e.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("event_id").alias("run_id"), F.col("ts").alias("started"), (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 5000).cast("int"))).alias("ended"))
    return jobs.in_flight(asked, runs)


def cancelled_jobs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type IN ('click', 'error')").withColumn("delta", F.when(F.col("event_type") == "click", 1).otherwise(-1))
    return jobs.cancelled(e, "user_id", "delta", "ts", "event_id")


def usage_cost(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame([("1-URGENT", 3.0, 15.0), ("2-HIGH", 0.5, 2.0), ("5-LOW", 0.1, 0.4)], "model string, input_price double, output_price double")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("model"), (F.col("o_orderkey") % 10000).alias("input_tokens"), (F.col("o_custkey") % 3000).alias("output_tokens"))
    return jobs.usage_cost(o, prices).select("o_orderkey", _rounded("cost", 6))


def fallback_answer(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("ord"), F.col("l_quantity").alias("seconds"), (F.col("l_returnflag") == "A").alias("ok"), F.col("l_partkey").alias("answer"), F.col("l_linestatus").alias("reason"))
    a = a.groupBy("job_id", "ord").agg(F.min("seconds").alias("seconds"), F.bool_or("ok").alias("ok"), F.min("answer").alias("answer"), F.min("reason").alias("reason"))
    return jobs.first_usable(a, 60.0).select("job_id", "answer", F.array_join("reasons", ",").alias("reasons"))


def retention_filter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.saved_since(e, "ts", F.to_timestamp(F.lit("2024-01-20 00:00:00")), 48).select("event_id", "user_id")


def lru_finished(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("last_id"))
    return jobs.most_recent(last, 100, "last_id", "user_id")


def set_ops_links(spark: SparkSession, d: str) -> DataFrame:
    """Domains of pages by first path part: union, intersect and except of English and French ones."""
    p = table(spark, d, "pages").select(urls.host(F.col("url")).alias("host"), F.get(urls.path_parts(urls.path(F.col("url"))), F.lit(0)).alias("lang"))
    en, fr = p.where("lang = 'en'").select("host"), p.where("lang = 'fr'").select("host")
    tag = lambda df, name: df.select(F.lit(name).alias("op"), "host")
    return tag(en.union(fr).distinct(), "union").union(tag(en.intersect(fr), "intersect")).union(tag(en.exceptAll(fr).distinct().join(fr, "host", "left_anti"), "except"))


def scale_labels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    value = text.scale(F.col("p_size") * 4 - 50)
    return p.select("p_partkey", value.alias("value"), text.lean(value).alias("lean"), text.confidence_level(value / 100).alias("confidence"))


def merged_reads(spark: SparkSession, d: str) -> DataFrame:
    """Two reads that hold all documents between them: each lacks one source and leaves some fields empty."""
    doc = table(spark, d, "documents")
    read = doc.select(F.col("doc_id").alias("site_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("description"), F.col("lang").alias("language"), F.md5(F.col("text").cast("binary")).alias("text"))
    structure = read.where("description <> 'src1'").withColumn("title", F.concat(F.lit("structure "), "title")).withColumn("text", F.lit(""))
    content = read.where("description <> 'src2'").withColumn("language", F.when(F.col("description") != "src1", F.lit("")).otherwise(F.col("language")))
    return pages.merged_reads(structure, content)


def _guides(spark, d):
    c = table(spark, d, "customer")
    colour = F.array(*[F.struct(F.lit(r).alias("role"), hex_of(F.col("c_custkey") + i).alias("hex"), F.lit(None).cast("string").alias("name")) for i, r in enumerate(("background", "primary"))])
    fonts = F.array(F.struct(F.lit("body").alias("role"), F.col("c_mktsegment").alias("family"), F.lit("serif").alias("fallback"), F.array(F.lit(400)).alias("weights")))
    traits = F.when(F.col("c_custkey") % 2 == 0, F.array(F.struct(F.lit("Plain").alias("name"), F.col("c_mktsegment").alias("description"), F.array(F.lit("we *make* it")).alias("quotes")))).otherwise(F.array().cast("array<struct<name:string,description:string,quotes:array<string>>>"))
    props = F.array().cast("array<struct<title:string,quote:string>>")
    return c.select(F.col("c_custkey").alias("site_id"), F.col("c_name").alias("name"), colour.alias("colors"), fonts.alias("fonts"), traits.alias("traits"), props.alias("value_props"))


def export_css(spark: SparkSession, d: str) -> DataFrame:
    return _guides(spark, d).select("site_id", exports.css_export().alias("content"))


def export_tailwind(spark: SparkSession, d: str) -> DataFrame:
    return _guides(spark, d).select("site_id", exports.tailwind_export().alias("content"))


def export_voice(spark: SparkSession, d: str) -> DataFrame:
    return _guides(spark, d).select("site_id", exports.voice_export().alias("content"))


def export_tokens(spark: SparkSession, d: str) -> DataFrame:
    return exports.export(_guides(spark, d), "tokens")


def export_json(spark: SparkSession, d: str) -> DataFrame:
    return exports.export(_guides(spark, d), "json")


ERRORS = ["", "timeout", "page_not_found", "bot_blocked", "target_http_error", "odd_error"]
STATUSES = [0, 401, 402, 403, 404, 429, 500, 503]


def _fetched(spark, d):
    """The pages as if they were fetched: some fail, some land on other sites, the homepage or all on one page, some have almost no text."""
    p = table(spark, d, "pages")
    n = F.col("page_id")
    site = urls.site_domain(urls.host(F.col("url")))
    error = F.nullif(F.when(n % 3 == 0, pick(ERRORS, F.floor(n / 3) % 6)).otherwise(""), F.lit(""))
    label = F.substring_index(site, ".", 1)
    final = F.when(n % 7 == 0, F.lit("https://www.elsewhere.net/x")).when(n % 7 == 1, F.concat(F.lit("https://about."), label, F.lit("/login"))).when(n % 7 == 2, F.concat(F.lit("https://about."), label, F.lit("/story"))).when(n % 7 == 3, F.concat(F.lit("https://www."), site, F.lit("/all/"))).when(n % 49 == 4, F.concat(F.lit("https://"), site)).otherwise("")
    said = F.when(n % 5 == 0, F.lit(" t ")).otherwise(F.col("html"))
    return p.select(site.alias("site_id"), "url", F.when(n % 2 == 0, F.lit("about")).alias("kind"), final.alias("final_url"), error.alias("error"), pick_int(STATUSES, n % 8).alias("status"), said.alias("text"))


def pick_int(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def read_outcomes(spark: SparkSession, d: str) -> DataFrame:
    f = _fetched(spark, d)
    r = reading.read_pages(f, homes(spark, d))
    no_site = F.coalesce(reading.means_no_site(F.col("error"), F.col("status")), F.lit(False))
    return r.select("url", "state", "reason", "retry", "elsewhere", no_site.alias("no_site"), reading.failure_class(F.col("status")).alias("failure"))


def retry_set(spark: SparkSession, d: str) -> DataFrame:
    return reading.to_retry(reading.read_pages(_fetched(spark, d), homes(spark, d))).select("site_id", "url")


def skip_warnings(spark: SparkSession, d: str) -> DataFrame:
    r = reading.read_pages(_fetched(spark, d), homes(spark, d))
    w = reading.skipped_warnings(r, r.select("site_id", "url", F.lit("press").alias("kind")))
    return w.select("site_id", F.array_join("warnings", "\n").alias("warnings"))


def kinds_linked(spark: SparkSession, d: str) -> DataFrame:
    k = reading.known_kinds(links(spark, d), homes(spark, d))
    return k.select("site_id", F.array_join("kinds", ", ").alias("kinds"), "main_kinds", "thin")


def gaps_filled(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    odd = F.col("n_chars") % 2 == 1
    side = lambda here: doc.select(F.col("doc_id").alias("site_id"), F.when(here, F.col("source")).alias("title"), F.when(~here, F.col("source")).alias("site_name"), F.when(here, F.col("lang")).alias("description"), F.col("lang").alias("language"), F.when(~here, F.lit("icon")).alias("favicon"), F.when(here, F.col("text")).otherwise("short").alias("text"))
    g = reading.filled_gaps(side(odd), side(~odd))
    return g.select("site_id", "title", "site_name", "description", "language", "favicon", F.length("text").alias("chars"), F.array_join("filled", ",").alias("filled"))


def page_icons(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    tag = lambda rel, href, more: F.concat(F.lit(f'<link rel="{rel}" href="'), href, F.lit('"'), more, F.lit(">"))
    sizes = F.concat(F.lit(' sizes="16x16 '), (F.col("p_size") * 4).cast("string"), F.lit("x"), (F.col("p_size") * 4).cast("string"), F.lit('"'))
    svg = F.when(k % 5 == 0, tag("icon", F.lit("../i.svg"), F.lit(" type='image/svg+xml'"))).otherwise("")
    html = F.concat(tag("stylesheet", F.lit("a.css"), F.lit("")), F.when(k % 3 > 0, tag("shortcut icon", F.concat(F.lit("/i"), k.cast("string"), F.lit(".png")), sizes)).otherwise(""), svg, tag("apple-touch-icon", F.lit("touch.png"), F.lit(' sizes="180x180"')))
    return head.best_icon(head.icon_links(p.select(k.alias("page_id"), F.lit("https://a.com/b/c").alias("url"), html.alias("html"))))


def site_names(spark: SparkSession, d: str) -> DataFrame:
    """Names from titles: each supplier's own, with signs, regions and shop words around it."""
    k = F.col("s_suppkey")
    brand = F.concat(F.lit("Brand"), k.cast("string"))
    host = F.concat(F.lit("www.brand"), k.cast("string"), F.lit(".com"))
    told = pick(["{} | Things for all", "Fine things - {}", "Only | Things", "Official {} Shop - {} Ltd - x"], k % 4)
    title = F.replace(told, F.lit("{}"), brand)
    name = F.replace(pick(["{}® United States", "{} (formerly Old)", "www.{}.com", "The Official {} Store", "Thistle United Kingdom"], k % 5), F.lit("{}"), brand)
    s = table(spark, d, "supplier").withColumns({"host": host, "title": title, "name": name})
    return s.select("s_suppkey", labels.name_from_title(F.col("title"), F.col("host")).alias("from_title"), labels.plain_name(F.col("name"), F.col("host")).alias("plain"))


def durations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    s = F.col("o_orderkey") * 37 % 90000
    return o.select("o_orderkey", labels.wait_words(s).alias("wait"), labels.ago(s).alias("ago"), labels.day_words(F.col("o_orderdate").cast("timestamp")).alias("day"))


def font_stacks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    stack = F.concat(pick(['"Face, One"', "__Inter_d65c78", "__My_Sans_Fallback_d65c78", "-apple-system", "Arial"], F.col("p_partkey") % 5), F.lit(", 'B "), F.col("p_size").cast("string"), F.lit("', Sans-Serif"))
    names_ = labels.font_names(stack)
    shown = F.transform(F.filter(names_, lambda n: ~labels.is_stand_in(n)), lambda n: labels.css_family(labels.family_name(n)))
    return p.select("p_partkey", F.array_join(names_, "|").alias("names"), F.array_join(shown, "|").alias("shown"), labels.font_keyword(F.element_at(names_, -1)).alias("keyword"))


def safe_addresses(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    n = F.col("page_id")
    raw = F.when(n % 4 == 0, F.concat(F.lit("javascript:"), "url")).when(n % 4 == 1, F.lit("data:image/png;base64,iVBORw0KGgo=")).when(n % 4 == 2, F.concat(F.lit("\t"), F.lower("url"))).otherwise(F.concat("url", F.lit(" x")))
    data = labels.data_address(F.col("url").cast("binary"), F.when(n % 2 == 0, F.lit("svg")).otherwise("gif"))
    home = F.concat(F.lit("https://"), urls.host(F.col("url")), F.lit("/"))
    return p.select("page_id", labels.web_address(raw).alias("web"), labels.logo_address(raw).alias("logo"), data.alias("data"), labels.on_page(F.col("url"), home).alias("on_page"), urls.public_host(F.col("url")).alias("public"), F.array_join(reading.guide_keys(F.array(F.lit("name:x"), F.lit(None).cast("string")), F.col("url")), " ").alias("keys"))


def empty_sections(spark: SparkSession, d: str) -> DataFrame:
    g = _guides(spark, d)
    k = F.col("site_id")
    g = g.withColumns({"logo_url": F.when(k % 3 == 0, F.lit("https://a/b.svg")), "tagline": F.when(k % 4 == 0, F.lit(" ")).otherwise("x"), "mission": F.lit(None).cast("string")})
    return g.select("site_id", F.array_join(reading.missing_sections(g), ", ").alias("missing"))


def model_rounds(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    runs = i.select((F.col("l_suppkey") % 10).alias("site_id"), F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("round"), F.floor("l_quantity").cast("long").alias("verified"), F.lit(50).cast("long").alias("checked"), (F.col("l_partkey") % 5).alias("kept"), F.lit(5).cast("long").alias("drafted"), F.col("l_orderkey").alias("tokens"), F.col("l_tax").alias("cost"), F.col("l_discount").alias("seconds"))
    return reading.model_rounds(runs).withColumn("cost", _rounded_col(F.col("cost"), 3))


def _rounded_col(c, digits):
    return F.round(c + 1e-7, digits)


def paper_colours(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pictures whose line items are pixels of the edge."""
    i = table(spark, d, "lineitem")
    channel = lambda m, by: (F.col("l_orderkey") * m % 230 + by).cast("int")
    odd = (F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") == 1)
    shade = F.when(odd, F.lit(7)).otherwise(F.lit(0))
    return head.paper(i.select(F.col("l_orderkey").alias("image_id"), *[channel(m, F.col("l_linenumber") % 2 + shade * 3).alias(c) for m, c in ((1, "r"), (7, "g"), (13, "b"))], F.when(F.col("l_orderkey") % 11 == 0, F.lit(10)).otherwise(255).alias("a")))


def contrast_grid(spark: SparkSession, d: str) -> DataFrame:
    backs = _part_colours(spark, d, 1).withColumn("is_background", F.lit(True))
    g = head.contrast_grid(contrast_matrix(spark, d).where("level <> 'fail'"), backs)
    return g.select("site_id", "fg", F.array_join("cells", " ").alias("cells"))


def token_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Parts as design tokens: chains of 41 that end in a colour or, one in five, in a circle or nowhere; pairs of neighbours."""
    p = table(spark, d, "part")
    name = lambda c: F.concat(F.lit("t"), c.cast("string"))
    k = F.col("p_partkey")
    back = F.when(k % 41 == 0, k + 40).otherwise(k - 1)
    value = F.when((k % 41 == 0) & (F.floor(k / 41) % 5 != 0), F.lower(hex_of(k))).otherwise(F.concat(F.lit("var(--"), name(back), F.lit(")")))
    tokens = p.select(F.lit("light").alias("theme"), name(k).alias("name"), value.alias("value"))
    pairs = p.select(name(k).alias("fg"), name(k + 20).alias("bg"), F.lit(4.5).alias("least"))
    c = head.checked_pairs(tokens, pairs)
    return c.select("theme", "fg", "bg", F.floor(F.col("ratio") * 100).alias("ratio"), "enough")


def drawing_holes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as drawings of 24 lines whose line items are their ink: how much of the box is ink and how much is enclosed."""
    at = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % (24 * 24)
    ink = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image_id"), (at % 24).alias("x"), F.floor(at / 24).alias("y"))
    share = lambda n: F.round(F.col(n) / F.col("box_n") + 1e-9, 3)
    return areas.enclosed(ink).select("image_id", "ink_n", "box_n", "hole_n", share("ink_n").alias("fill"), share("hole_n").alias("holes"))


def sites_in_turn(spark: SparkSession, d: str) -> DataFrame:
    """Official sites by a search on the platform of that name, then by one over the web for names that are still open."""
    s = turns.official_sites_in_turn(*searches_in_turn(spark, d))
    return s.select("query_id", "url", "host", F.round("score", 4).alias("score"), "name_matches", F.col("search").cast("long").alias("search"))


def pages_in_turn(spark: SparkSession, d: str) -> DataFrame:
    """What each site's searches came to, and its pages in their order."""
    pages_, sites = turns.pages_in_turn(homes(spark, d), *site_searches(spark, d))
    told = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "kind", "origin", "url").alias("page"))))
    of_site = pages_.groupBy("site_id").agg(F.array_join(F.transform(told, lambda p: p["page"]), "; ").alias("pages"))
    return sites.join(of_site, "site_id", "left").withColumn("pages", F.coalesce("pages", F.lit("")))


def portable_logos(spark: SparkSession, d: str) -> DataFrame:
    """Main logos at addresses that work anywhere; copies below 600 bytes are put into the address."""
    p = saved.portable_logos(*copied_logos(spark, d), most=600)
    return p.select("page_id", "primary", "logo_url")


def measurements_checked(spark: SparkSession, d: str) -> DataFrame:
    """What may be used of each landed measurement, and what was left out."""
    m = measurements.checked_measurements(landed_measurements(spark, d))
    left = lambda key: F.coalesce(F.element_at("left_out", F.lit(key)), F.when(F.col("error").isNull(), F.lit(0).cast("bigint")))
    width = F.aggregate("elements", F.lit(0.0), lambda n, e: n + e["w"])
    return m.select("site_id", "error", left("elements").alias("left_elements"), left("fonts").alias("left_fonts"), left("first-screen colours").alias("left_colours"), F.array_join("problems", "; ").alias("problems"), F.array_join(F.transform("elements", lambda e: e["kind"]), ",").alias("kinds"), F.round(width, 2).alias("width"), F.element_at("colors", F.lit("#FFFFFF")).alias("white"))


def events_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream through the sliding limiter, in one run over what is there."""
    schema = table(spark, d, "events").schema
    folder = d if d.startswith(("hdfs", "s3", "viewfs", "file")) else f"file://{d}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    hits = stream.select(F.col("user_id").cast("string").alias("k"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: a stream's state needs a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="lumenloom-")
    out = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    run = limits.sliding_limit(hits, 3, 86400.0).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(F.col("id").alias("event_id"), "allowed", F.round("wait_s", 3).alias("wait_s"))
