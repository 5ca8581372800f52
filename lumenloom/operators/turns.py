"""Searches in turn: what is asked first, and what only for those that the first answer leaves open.

A later source is read for open keys alone. Where it was landed in buckets of its key (`in_buckets`), the buckets of the open keys become
a filter on partitions, so files of settled keys aren't opened; inside them open keys meet rows by a semi-join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import names, urls
from lumenloom.operators import discover, reading
from lumenloom.sources.scratch import written

#: Up to this many open keys are broadcast; more meet the source by a shuffle.
BROADCAST_KEYS = 200_000
BUCKETS = 256
#: Results of the first search come after all links of a homepage, those of the second after them.
AFTER = 1 << 40
# Failures of a search that pass, so that a site goes on with its links.
PASSING = ["rate_limited", "unavailable"]


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def in_buckets(rows: DataFrame, key: str, path: str, buckets: int = BUCKETS) -> None:
    """Lands rows by the bucket of their key, for `only_open`. A hot key's rows are dealt to several tasks by the engine's rebalancing."""
    name = f"bucket_of_{buckets}"
    rows.withColumn(name, bucket(F.col(key), buckets)).hint("rebalance", F.col(name)).write.partitionBy(name).mode("overwrite").parquet(path)


def only_open(rows: DataFrame, open_keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is one of open_keys (written, distinct). If rows were landed in buckets, only those with an open key are read.

    How many buckets there are is in the column's name, so a reader can't take another number. The driver holds numbers of buckets, never keys.
    """
    n = open_keys.count()
    for name in [c for c in rows.columns if re.fullmatch(r"bucket_of_\d+", c)]:
        wanted = [r[0] for r in open_keys.select(bucket(F.col(key), int(name.rsplit("_", 1)[1])).alias("b")).distinct().collect()]
        rows = rows.where(F.col(name).isin(wanted) if wanted else F.lit(False)).drop(name)
    keys = open_keys.select(key)
    return rows.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, key, "left_semi")


def official_sites_in_turn(asked: DataFrame, own: DataFrame, web: DataFrame) -> DataFrame:
    """query_id, url, host, score, name_matches and search: the official site of each name, in one search or two.

    asked: query_id, name. own and web: query_id, position, url: the results of a search on the platform that is called so, and of one over
    the whole web. A name that is a platform's takes the best of its own results on that platform (search 1); all names that are still
    open take the best of the web (search 2), which isn't read for others. A name without a usable result has one row of nulls.
    A query_id is one name; own results of a name that is no platform's aren't used, as they were never asked for.
    """
    named = asked.select("query_id", "name", discover.named_site(names.name_words(F.col("name"))).alias("site"))
    at_home = own.join(named.where("site IS NOT NULL"), "query_id").where(F.coalesce(urls.same_site(urls.host(F.col("url")), F.col("site")), F.lit(False)))
    first = written(discover.official_sites(at_home.select("query_id", "name", "position", "url")).withColumn("search", F.lit(1)), "first")
    open_ = written(named.join(first.select("query_id"), "query_id", "left_anti").select("query_id", "name"), "open")
    rest = only_open(web, open_, "query_id").join(open_, "query_id").select("query_id", "name", "position", "url")
    second = discover.official_sites(rest).withColumn("search", F.lit(2))
    found = first.unionByName(second)
    return asked.select("query_id").join(found, "query_id", "left")


def pages_in_turn(homes: DataFrame, links: DataFrame, outcomes: DataFrame, found: DataFrame, limit: int = discover.MAX_PAGES) -> tuple[DataFrame, DataFrame]:
    """(pages, sites): the pages to read of each site (as discover.choose_pages) and what became of its one or two searches.

    homes as for choose_pages. links: site_id, pos, url, text, place of a homepage's links, pos below 2**40. outcomes: site_id, search (1 or
    2), status (`ok` or why it failed). found: site_id, search, position, url, title.
    The second search is for sites that link to too few of the main kinds of page; its outcome and results aren't read for others. A search
    that was limited or away is counted and the site goes on; any other failure stops the site: it has no pages, and `stopped` tells why
    (of two, that of the first search). A site without an outcome of a search counts as having found nothing by it.
    sites: site_id, thin, search_calls, searches_failed, found_by_search, stopped.
    """
    linked = links.withColumns({"origin": F.lit("link"), "place": F.col("place")})
    thin = reading.known_kinds(linked, homes).where("thin").select("site_id")
    unlinked = homes.select("site_id").join(links.select("site_id").distinct(), "site_id", "left_anti")
    open_ = written(thin.unionByName(unlinked), "thin")
    apply = lambda rows: rows.where("search = 1").unionByName(only_open(rows.where("search = 2"), open_, "site_id").select(*rows.columns))
    asked = apply(outcomes.select("site_id", "search", "status"))
    failed = F.col("status") != "ok"
    passing = F.col("status").isin(PASSING)
    state = asked.groupBy("site_id").agg(
        F.countDistinct(F.when(failed & passing, F.col("search"))).alias("searches_failed"), F.min_by("status", F.when(failed & ~passing, F.col("search"))).alias("stopped"),
        F.collect_set(F.when(~failed, F.col("search"))).alias("fine"),
    )
    state = written(homes.select("site_id").join(open_.withColumn("thin", F.lit(True)), "site_id", "left").join(state, "site_id", "left"), "searches")
    going = state.where("stopped IS NULL").select("site_id", "fine")
    results = apply(found.select("site_id", "search", "position", "url", "title")).join(going, "site_id").where(F.array_contains("fine", F.col("search")))
    by_search = results.select("site_id", (F.col("search") * AFTER + F.col("position")).alias("pos"), "url", F.coalesce("title", F.lit("")).alias("text"), F.lit("search").alias("place"), F.lit("search").alias("origin"))
    by_link = linked.join(going.select("site_id"), "site_id", "left_semi").select("site_id", F.col("pos").cast("long").alias("pos"), "url", "text", "place", "origin")
    pages = written(discover.choose_pages(by_link.unionByName(by_search), homes, limit), "chosen")
    counted = pages.groupBy("site_id").agg(F.count_if(F.col("origin") == "search").alias("found_by_search"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    is_thin = F.coalesce("thin", F.lit(False))
    sites = state.join(counted, "site_id", "left").select("site_id", is_thin.alias("thin"), F.when(is_thin, 2).otherwise(1).cast("long").alias("search_calls"), zero("searches_failed"), zero("found_by_search"), "stopped")
    return pages, sites


def unknown_links(content: DataFrame, known: DataFrame) -> DataFrame:
    """site_id, pos and url of addresses in a page's content that its structure doesn't link to; each once, where it is first seen."""
    first = content.groupBy("site_id", "url").agg(F.min("pos").alias("pos"))
    return first.join(known.select("site_id", "url").distinct(), ["site_id", "url"], "left_anti").select("site_id", "pos", "url")
