"""Word-for-word checks of quotes against the pages of their site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import text, urls

MIN_WORDS = 3
KEY_WORDS = 3


#: Keys of one site's quotes that are broadcast; with more of them, ids meet ids.
FEW_KEYS = 1000


def page_lines(pages: DataFrame) -> DataFrame:
    """site_id, ord, url, key, line_no, line: the normalised lines of each page, so that no quote spans two.

    pages: site_id, ord, url, text (Markdown). Of pages with one key the first counts: it is chosen by its
    numbers alone and its text is fetched after.
    """
    keyed = pages.withColumn("key", urls.page_key(F.col("url")))
    first = keyed.groupBy("site_id", "key").agg(F.min("ord").alias("ord"))
    once = keyed.join(first, ["site_id", "key", "ord"], "left_semi").withColumn("text", text.composed(F.col("text")))
    return once.select("site_id", "ord", "url", "key", F.posexplode(text.compared_lines(F.col("text"))).alias("line_no", "line"))


def lines_with(lines: DataFrame, wanted: DataFrame, keys: Column, place: list[str]) -> DataFrame:
    """lines (site_id, line, `place`) with `gram`: one row for each key of a line that is wanted on its site.

    wanted: site_id, gram. `keys`: the distinct keys of a line. Few wanted keys are broadcast and looked up by each key
    of a line as it is exploded, so only hits go on and a line's work doesn't follow how many are wanted; many
    meet the exploded keys by a shuffle, which carry the line's place, not the line.
    """
    wanted = wanted.select("site_id", "gram").where("gram is not null").distinct()
    sizes = wanted.groupBy("site_id").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (sizes[0] or 0) <= FEW_KEYS and (sizes[1] or 0) <= 100 * FEW_KEYS:
        # an outer explode, as Spark adds a filter to a plain one that would find the keys twice
        return lines.withColumn("gram", F.explode_outer(keys)).join(F.broadcast(wanted), ["site_id", "gram"])
    placed = lines.select("site_id", *place, F.explode(keys).alias("gram")).join(wanted, ["site_id", "gram"])
    return lines.join(placed, ["site_id", *place])


def shingle_keys(line: Column) -> Column:
    """Every run of KEY_WORDS words (letters and digits, lower case) of a line, distinct: what a quote is looked up by."""
    found = F.regexp_extract_all(F.lower(line), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))

    def runs(words: Column) -> Column:
        count = F.size(words) - KEY_WORDS + 1
        return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.xxhash64(F.slice(words, i + 1, KEY_WORDS)))))

    return text.let(found, runs)


def check_quotes(quotes: DataFrame, pages: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every quote with found_url: the first page that has it as whole words in one line, the claimed page first.

    quotes: site_id, item, quote, claimed_url. A quote in quote marks is compared without them, one final
    full stop is forgiven, and fewer than min_words words are never found. Quotes meet lines by a run of
    three words (a quote's first run), not site by site on everything; quotes of fewer words, possible
    for a smaller min_words, meet all lines of their site.
    """
    q = quotes.withColumn("__id", F.xxhash64("site_id", "item", "quote", "claimed_url")).withColumn("wanted", text.unquoted(text.normalise(F.col("quote"))))
    q = q.withColumn("words", text.word_count(F.col("wanted"))).withColumn("claimed", urls.page_key(F.col("claimed_url")))
    able = q.where(F.col("words") >= min_words).select("__id", "site_id", "wanted", "claimed", F.get(shingle_keys(F.col("wanted")), F.lit(0)).alias("gram")).distinct()
    lines = page_lines(pages)
    fits = text.contains_words(F.col("line"), F.col("wanted")) | (F.endswith("wanted", F.lit(".")) & text.contains_words(F.col("line"), F.regexp_replace("wanted", r"\.$", "")))
    by_gram = lines_with(lines, able, shingle_keys(F.col("line")), ["ord", "line_no"])
    found = able.where("gram is not null").join(by_gram, ["site_id", "gram"]).where(fits).select("__id", "url", "ord", "key", "claimed")
    if min_words < KEY_WORDS:
        short = able.where("gram is null").join(lines, "site_id").where(fits).select("__id", "url", "ord", "key", "claimed")
        found = found.union(short)
    best = found.groupBy("__id").agg(F.min_by("url", F.struct((F.col("key") != F.coalesce("claimed", F.lit(""))).alias("other"), "ord")).alias("found_url"))
    return q.join(best, "__id", "left").drop("__id", "wanted", "claimed")


def quote_summary(checked: DataFrame, keys: list[str]) -> DataFrame:
    return checked.groupBy(*keys).agg(F.count("*").alias("checked"), F.count("found_url").alias("verified"))


def mentioned(phrases: DataFrame, pages: DataFrame) -> DataFrame:
    """The phrases (site_id, phrase) that some page of their site holds as whole words, in any capitals.

    Looked up by their first word.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    p = phrases.withColumn("wanted", F.lower(text.normalise(F.col("phrase")))).withColumn("gram", F.get(words(F.col("wanted")), F.lit(0)))
    lines = page_lines(pages).withColumn("line", F.lower("line"))
    found = lines_with(lines, p, F.array_distinct(words(F.col("line"))), ["ord", "line_no"])
    asked = p.select("site_id", "gram", "wanted").distinct()
    fits = text.contains_words(F.col("line"), F.col("wanted"))
    seen = asked.join(found.select("site_id", "gram", "line"), ["site_id", "gram"]).where(fits).select("site_id", "wanted").distinct()
    return p.join(seen, ["site_id", "wanted"], "left_semi").select(*phrases.columns)


def capped(found: DataFrame, group: list[str], cap: int, order: str = "pos") -> DataFrame:
    """Rows up to the cap of successes: a row counts as tried while fewer than `cap` before it were found."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum(F.col("found").cast("int")).over(before), F.lit(0))
    return found.withColumn("__before", n).where(F.col("__before") < cap).drop("__before")


def check_voice(drafts: DataFrame, pages: DataFrame, max_traits: int = 5, max_quotes: int = 2, max_props: int = 4, max_audience: int = 4) -> DataFrame:
    """A draft per site against its pages: verified traits, value propositions, audience, counts and warnings.

    drafts: site_id, summary, traits array<struct<name, description, evidence array<struct<quote, source_url>>>>,
    value_props array<struct<title, quote, source_url>>, audience array<string>.
    """
    traits = drafts.select("site_id", F.posexplode("traits").alias("pos", "t")).select("site_id", "pos", "t.name", "t.description", F.posexplode("t.evidence").alias("epos", "e"))
    t = traits.select("site_id", F.concat(F.lit("t"), "pos", F.lit("."), "epos").alias("item"), F.col("e.quote").alias("quote"), F.col("e.source_url").alias("claimed_url"), "pos", "epos", "name", "description")
    props = drafts.select("site_id", F.posexplode("value_props").alias("pos", "p")).select("site_id", F.concat(F.lit("p"), "pos").alias("item"), F.col("p.quote").alias("quote"), F.col("p.source_url").alias("claimed_url"), "pos", F.lit(0).alias("epos"), F.col("p.title").alias("name"), F.lit(None).cast("string").alias("description"))
    checked = check_quotes(t.unionByName(props), pages).withColumn("found", F.col("found_url").isNotNull()).withColumn("is_trait", F.startswith("item", F.lit("t")))
    kept_quotes = capped(checked.where("is_trait"), ["site_id", "pos"], max_quotes, "epos")
    by_trait = kept_quotes.groupBy("site_id", "pos", "name", "description").agg(
        F.array_sort(F.collect_list(F.when(F.col("found"), F.struct("epos", "quote", "found_url")))).alias("evidence"), F.count("*").alias("tried"), F.count_if("found").alias("n")
    )
    by_trait = capped(by_trait.withColumn("found", F.col("n") > 0), ["site_id"], max_traits)
    by_prop = capped(checked.where("not is_trait"), ["site_id"], max_props)
    people = drafts.select("site_id", F.posexplode(F.array_distinct(F.transform("audience", text.squeeze))).alias("pos", "phrase")).where("phrase <> ''")
    seen = mentioned(people, pages).select("site_id", "phrase", F.lit(True).alias("found"))
    audience = capped(people.join(seen, ["site_id", "phrase"], "left").withColumn("found", F.coalesce("found", F.lit(False))), ["site_id"], max_audience)
    ordered = lambda *cols: F.array_sort(F.collect_list(F.when(F.col("found"), F.struct(*cols))))
    a = by_trait.groupBy("site_id").agg(ordered("pos", "name", "description", "evidence").alias("traits"), F.sum("tried").alias("t_checked"), F.sum("n").alias("t_verified"), F.array_sort(F.collect_list(F.when(~F.col("found"), F.col("name")))).alias("t_dropped"))
    b = by_prop.groupBy("site_id").agg(ordered("pos", "name", "quote", "found_url").alias("value_props"), F.count("*").alias("p_checked"), F.count_if("found").alias("p_verified"), F.array_sort(F.collect_list(F.when(~F.col("found"), F.col("name")))).alias("p_dropped"))
    c = audience.groupBy("site_id").agg(ordered("pos", "phrase").alias("audience"))
    out = drafts.select("site_id", "summary").join(a, "site_id", "left").join(b, "site_id", "left").join(c, "site_id", "left")
    none = F.coalesce(F.size("traits"), F.lit(0)) <= 0
    dropped = F.concat(F.coalesce("t_dropped", F.array().cast("array<string>")), F.coalesce("p_dropped", F.array().cast("array<string>")))
    warning = F.array_compact(F.array(F.when(none, F.lit("No trait could be verified, so the tone of voice was left out.")), F.when(F.size(dropped) > 0, F.concat(F.lit("Left out, as no quote was found for it: "), text.joined(dropped)))))
    return out.select(
        "site_id", F.when(~none, F.col("summary")).alias("summary"), F.when(~none, F.col("traits")).alias("traits"), "value_props", "audience",
        (F.coalesce("t_checked", F.lit(0)) + F.coalesce("p_checked", F.lit(0))).alias("quotes_checked"), (F.coalesce("t_verified", F.lit(0)) + F.coalesce("p_verified", F.lit(0))).alias("quotes_verified"), warning.alias("warnings"),
    )
