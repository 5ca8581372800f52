"""What became of the pages that were asked for: failures and their reasons, redirects, retries, gaps, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import text, urls
from lumenloom.operators import discover

# Reasons by error code, errors that mean there is no site, answers that rather mean "blocked", errors that a
# browser may get past, kinds of page that a site should link, and how many of them.
REASONS = {
    "target_http_error": "the site answered with an error",
    "page_not_found": "the page doesn’t exist",
    "target_unreachable": "the site couldn’t be reached",
    "timeout": "the page took too long to load",
    "bot_blocked": "the site blocked automated reading",
    "empty_content": "the page had no readable text without running its JavaScript",
    "login_required": "the page needs a login",
    "content_too_large": "the page is too large",
    "invalid_url": "the address was refused",
    "invalid_redirect_url": "the page redirected to an address that was refused",
    "proxy_error": "the connection to the site failed",
    "selector_not_matched": "the page had none of the parts asked for",
}
OTHER_REASON = "it couldn’t be read"
NO_SITE = ["target_unreachable", "invalid_url", "invalid_redirect_url", "page_not_found"]
BLOCKED = [401, 403, 429, 503]
BROWSER_MAY_READ = ["empty_content", "bot_blocked", "timeout"]
MAIN_KINDS, MAIN_KINDS_NEEDED = ["about", "mission", "careers", "press"], 3
MAX_RETRIES = 3
MIN_TEXT = 200
READ_BEFORE, NO_TEXT = "it led to a page that was already read", "it had almost no text"
ELSEWHERE, NOT_READ = "it redirected to another website", "it redirected to a page that is never read, such as a sign-in or legal page"


def failure_reason(error: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.coalesce(F.element_at(known, error), F.lit(OTHER_REASON))


def failure_class(status: Column) -> Column:
    """Which kind of failure a service's HTTP status is."""
    return (
        F.when(status == 401, F.lit("auth")).when(status == 402, F.lit("credits")).when(status == 429, F.lit("rate_limited"))
        .when((status == 403) | (status >= 500), F.lit("unavailable")).otherwise("bad_request")
    )


def means_no_site(error: Column, status: Column) -> Column:
    """Whether a homepage's failure says that there is no website; an answer that looks like blocking doesn't."""
    blocked = F.coalesce(status.isin(BLOCKED), F.lit(False))
    return error.isin(NO_SITE) | ((error == "target_http_error") & ~blocked)


def read_pages(fetched: DataFrame, homes: DataFrame, chosen: DataFrame | None = None, order: str = "url") -> DataFrame:
    """fetched plus address, state (read, skipped), reason, retry and elsewhere (the other website's host).

    fetched: site_id, url, kind, final_url, error, status, text. homes: site_id, domain, home_url, requested_url,
    language. chosen: site_id, url and kind of the pages that were asked for; others are dropped, and the kind is theirs. A page
    that landed on the brand's own site is read; on another of its own sites only if a link to it would be; anywhere else it is skipped. So is one
    that landed on the homepage or where an earlier page (by `order`) was read, and one of almost no text, which a browser may get past.
    """
    f = fetched.withColumn("address", F.coalesce(F.nullif("final_url", F.lit("")), "url")).withColumn("text", F.coalesce("text", F.lit("")))
    if chosen is not None:
        asked = chosen.groupBy("site_id", urls.page_key(F.col("url")).alias("__asked")).agg(F.min("kind").alias("__kind"))
        f = f.withColumn("__asked", urls.page_key(F.col("url"))).join(asked, ["site_id", "__asked"]).withColumn("kind", F.col("__kind")).drop("__asked", "__kind")
    f = f.join(homes, "site_id").withColumn("host", urls.host(F.col("address")))
    path = F.when(urls.path(F.col("address")) == "", F.lit("/")).otherwise(urls.path(F.col("address")))
    home_path = F.when(urls.path(F.col("home_url")) == "", F.lit("/")).otherwise(urls.path(F.col("home_url")))
    fits = urls.public_host(F.col("address")).isNotNull() & discover.usable(F.col("host"), path, urls.site_domain(F.col("host")), urls.page_key(F.col("home_url")), home_path, F.col("language"))
    landed = F.when(urls.same_site(F.col("host"), F.col("domain")), F.lit(None)).when(urls.same_brand(F.col("host"), F.col("domain")), F.when(~fits, F.lit(NOT_READ))).otherwise(F.lit(ELSEWHERE))
    f = f.withColumn("__landed", F.when(F.col("error").isNotNull(), failure_reason(F.col("error"))).otherwise(landed))
    f = f.withColumn("__key", urls.page_key(F.col("address"))).withColumn("__short", F.length(text.squeeze(F.col("text"))) < MIN_TEXT)
    at_home = F.col("__key").isin(urls.page_key(F.col("home_url")), urls.page_key(F.col("requested_url")))
    good = F.col("__landed").isNull() & ~at_home & ~F.col("__short")
    first = F.min(F.when(good, F.struct(order, "url"))).over(Window.partitionBy("site_id", "__key"))
    again = at_home | F.coalesce(F.struct(order, "url") > first, F.lit(False))
    f = f.withColumn("__reason", F.coalesce("__landed", F.when(again, F.lit(READ_BEFORE)).when(F.col("__short"), F.lit(NO_TEXT))))
    reason = F.col("__reason")
    return f.select(
        *fetched.columns, "address", F.when(reason.isNull(), F.lit("read")).otherwise("skipped").alias("state"), reason.alias("reason"),
        F.coalesce(F.when(F.col("error").isNotNull(), F.col("error").isin(BROWSER_MAY_READ)).otherwise(reason == NO_TEXT), F.lit(False)).alias("retry"),
        F.when(F.col("error").isNull() & (reason == ELSEWHERE), urls.without_www(F.col("host"))).alias("elsewhere"),
    )


def to_retry(read: DataFrame, most: int = MAX_RETRIES, order: str = "url") -> DataFrame:
    """The first few skipped pages of each site that a browser may get past."""
    n = F.row_number().over(Window.partitionBy("site_id").orderBy(order))
    return read.where("state = 'skipped' AND retry").withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def with_retries(read: DataFrame, again: DataFrame) -> DataFrame:
    """Pages read on the second try in place of their first rows."""
    good = again.where("state = 'read'")
    return read.join(good.select("site_id", "url"), ["site_id", "url"], "left_anti").unionByName(good)


def skipped_warnings(read: DataFrame, chosen: DataFrame) -> DataFrame:
    """site_id, warnings: a sentence for each skipped page; several that left for other websites share one.

    chosen: site_id, url, kind; its kind labels a page that has none of its own.
    """
    labels = F.create_map(*[F.lit(x) for k in discover.KINDS for x in (k[0], k[1])])
    own = chosen.groupBy("site_id", urls.page_key(F.col("url")).alias("key")).agg(F.min("kind").alias("chosen_kind"))
    s = read.where("state = 'skipped'").withColumn("key", urls.page_key(F.col("url"))).join(own, ["site_id", "key"], "left")
    label = F.coalesce(F.element_at(labels, F.coalesce("kind", "chosen_kind")), F.lit("A"))
    one = F.concat(F.lit("The "), label, F.lit(" page ("), F.col("url"), F.lit(") was skipped: "), F.col("reason"), F.lit("."))
    away = F.concat(F.col("url"), F.lit(" (to "), F.col("elsewhere"), F.lit(")"))
    g = s.groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("url", one.alias("one"), "elsewhere"))).alias("all"), F.sort_array(F.collect_list(F.when(F.col("elsewhere").isNotNull(), F.struct("url", away.alias("away"))))).alias("gone"))
    many = F.size("gone") > 1
    single = F.transform(F.filter("all", lambda x: ~many | x["elsewhere"].isNull()), lambda x: x["one"])
    shared = F.concat(F.size("gone").cast("string"), F.lit(" pages were skipped because they redirected to other websites: "), text.joined(F.transform("gone", lambda x: x["away"])), F.lit("."))
    return g.select("site_id", F.concat(single, F.when(many, F.array(shared)).otherwise(F.array().cast("array<string>"))).alias("warnings"))


def filled_gaps(fetched: DataFrame, seen: DataFrame) -> DataFrame:
    """fetched with what it lacks taken from what a browser saw, and `filled`: what that was, for people.

    Both: site_id, title, site_name, description, language, favicon, text. A short text is replaced if the
    other one is long enough.
    """
    f, s = fetched.alias("f"), seen.alias("s")
    empty = lambda n: F.coalesce(F.col(f"f.{n}"), F.lit("")) == ""
    there = lambda n: F.coalesce(F.col(f"s.{n}"), F.lit("")) != ""
    length = lambda side: F.length(F.coalesce(F.col(f"{side}.text"), F.lit("")))
    longer = (length("f") < MIN_TEXT) & (length("s") >= MIN_TEXT)
    told = [F.when(empty("description") & there("description"), F.lit("description")), F.when(empty("favicon") & there("favicon"), F.lit("icon")), F.when(longer, F.lit("text"))]
    both = f.join(s, F.col("f.site_id") == F.col("s.site_id"), "left")
    pick = lambda n: F.when(empty(n) & there(n), F.col(f"s.{n}")).otherwise(F.col(f"f.{n}")).alias(n)
    return both.select("f.site_id", *[pick(n) for n in ("title", "site_name", "description", "language", "favicon")], F.when(longer, F.col("s.text")).otherwise(F.col("f.text")).alias("text"), F.array_compact(F.array(*told)).alias("filled"))


def known_kinds(links: DataFrame, homes: DataFrame) -> DataFrame:
    """site_id, kinds (labels in the order of their use), main_kinds and thin: too few of the main kinds are linked."""
    found = discover.classify(links).where("kind is not null").join(homes, "site_id")
    home_path = F.when(urls.path(F.col("home_url")) == "", F.lit("/")).otherwise(urls.path(F.col("home_url")))
    fits = discover.usable(F.col("host"), F.col("path"), F.col("domain"), urls.page_key(F.col("home_url")), home_path, F.col("language"))
    seen = found.where(fits).groupBy("site_id").agg(F.collect_set("kind").alias("held"))
    all_sites = links.select("site_id").distinct().join(seen, "site_id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    labels = F.array_compact(F.array(*[F.when(F.array_contains("held", k[0]), F.lit(k[1])) for k in discover.KINDS]))
    main = F.size(F.array_intersect("held", F.array(*[F.lit(k) for k in MAIN_KINDS])))
    return all_sites.select("site_id", labels.alias("kinds"), main.alias("main_kinds"), (main < MAIN_KINDS_NEEDED).alias("thin"))


def homepage_warnings(failures: DataFrame, homes: DataFrame) -> DataFrame:
    """site_id, warnings: distinct reasons in one sentence, and a missing logo.

    failures: site_id, reason. homes: site_id, host, logos (a number), filled array<string>.
    """
    reasons = failures.groupBy("site_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    h = homes.join(reasons, "site_id", "left")
    some, host = F.coalesce(F.size("reasons"), F.lit(0)) > 0, urls.without_www(F.col("host"))
    by_browser = F.array_contains("filled", "text")
    lead = F.concat(F.lit("Not all of the homepage of "), host, F.lit(" could be read"))
    told = F.when(some & by_browser, F.concat(lead, F.lit(" ("), text.joined(F.col("reasons")), F.lit("), so a browser read it instead."))).when(some, F.concat(lead, F.lit(": "), text.joined(F.col("reasons")), F.lit(". What couldn’t be read is missing from this guide.")))
    bare = F.when(F.col("logos") == 0, F.concat(F.lit("No logo or icon was found on the homepage of "), host, F.lit(".")))
    return h.select("site_id", F.array_compact(F.array(told, bare)).alias("warnings"))


def missing_sections(guide: DataFrame) -> Column:
    """Names of the parts a guide (logo_url, colors, fonts, traits, tagline, mission, value_props) has nothing for."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    checks = {"logo": blank("logo_url"), "colours": none("colors"), "fonts": none("fonts"), "tone of voice": none("traits"), "key messaging": blank("tagline") & blank("mission") & none("value_props")}
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


def guide_keys(query_keys: Column, url: Column) -> Column:
    """The keys that a guide is remembered under: those it was asked by, and its site's."""
    return F.array_union(F.filter(query_keys, lambda k: F.coalesce(k, F.lit("")) != ""), F.array(urls.site_key(url)))


def model_rounds(runs: DataFrame) -> DataFrame:
    """Each site, model and round: quotes found, claims kept, tokens, cost and seconds."""
    return runs.groupBy("site_id", "model", "round").agg(
        F.sum("verified").alias("verified"), F.sum("checked").alias("checked"), F.sum("kept").alias("kept"), F.sum("drafted").alias("drafted"),
        F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.max("seconds").alias("seconds"),
    )
