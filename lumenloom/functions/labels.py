"""Small things that documents show: durations, dates, addresses, ids, font names, brand names in titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions import names, text, urls

# CSS font keywords, names of the device's own font, a build tool's names for fonts that it serves; signs,
# shop words, regions and label words that are no part of a brand's name; what parts a page title.
FONT_KEYWORDS = [
    "serif", "sans-serif", "monospace", "cursive", "fantasy", "system-ui", "ui-serif", "ui-sans-serif", "ui-monospace", "ui-rounded",
    "math", "emoji", "fangsong", "-apple-system", "BlinkMacSystemFont",
]
SYSTEM_FONTS = ["-apple-system", "blinkmacsystemfont"]
GENERATED_FONT = r"^__(.+?)(_Fallback)?_[0-9a-f]{5,8}$"
TRADEMARKS = r"[®™©℠]"
BRACKETED = r"\s*\([^()]*\)$"
SHOP_WORDS = r"(?i)^(the )?official |( official)?( online)? (shop|store)$"
REGIONS = (
    r"(?i)^(.+?)[\s,|·:–-]+\(?(official (site|website|store|online store)|online store|united states|united kingdom|usa?|uk|global|international"
    r"|europe|eu|canada|australia|new zealand|ireland|india|singapore|japan|germany|deutschland|france|españa|spain|italia|italy|nederland"
    r"|netherlands|sweden)\)?$"
)
LABEL_WORDS = r"(?i)\b(logo|logotype|wordmark|home ?page|home|link|go to|back to|return to|the)\b"
TITLE_PARTS = r"\s+[|–—·:•-]\s+"
DATA_LOGO = r"^data:image/(svg\+xml|png);base64,[A-Za-z0-9+/]+={0,2}$"
MEDIA_TYPES = {"svg": "image/svg+xml", "png": "image/png"}


def _plural(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, F.lit("")).otherwise("s"))


def wait_words(seconds: Column) -> Column:
    """42 -> "42 seconds", 600 -> "10 minutes", 25,000 -> "7 hours": rounded up, one second at least."""
    return (
        F.when(seconds < 60, _plural(F.greatest(F.lit(1), F.ceil(seconds)), "second"))
        .when(seconds < 3600, _plural(F.ceil(seconds / 60), "minute")).otherwise(_plural(F.ceil(seconds / 3600), "hour"))
    )


def ago(seconds: Column) -> Column:
    hours = F.floor(seconds / 3600)
    return F.when(hours < 1, F.lit("a few minutes ago")).otherwise(F.concat(_plural(hours, "hour"), F.lit(" ago")))


def day_words(at: Column) -> Column:
    """ "11 October 2026"; the session's time zone should be UTC."""
    return F.date_format(at, "d MMMM yyyy")


def is_job_id(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9_-]{1,64}$")


def job_id(*key: Column) -> Column:
    """An id of 64 bits from a key, so that a task run again makes the same one."""
    return F.concat(F.lit("bg_"), F.lower(F.lpad(F.hex(F.xxhash64(*key)), 16, "0")))


def web_address(url: Column) -> Column:
    """A tidied http(s) address without spaces, null for anything else."""
    tidy = text.without_controls(url)
    return F.when(tidy.rlike(r"(?i)^https?://[^\s/]") & ~tidy.contains(" "), tidy)


def logo_address(url: Column) -> Column:
    """An http(s) address, or an SVG or PNG written into the address itself."""
    return F.when(url.rlike(DATA_LOGO), url).otherwise(web_address(url))


def data_address(content: Column, kind: Column) -> Column:
    """A file as a data address, null for kinds that no logo has. Base64 comes in lines of 76 letters, which an address can't have."""
    media = F.element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), kind)
    return F.concat(F.lit("data:"), media, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def on_page(current: Column, wanted: Column) -> Column:
    """Whether a tab shows the wanted page: the same host but for www., and the same path or any for a homepage."""
    bare = lambda u: F.regexp_replace(urls.path(u), "/+$", "")
    same_host = (urls.host(current) != "") & (urls.without_www(urls.host(current)) == urls.without_www(urls.host(wanted)))
    return urls.scheme(current).isin("http", "https") & same_host & ((bare(wanted) == "") | (bare(current) == bare(wanted)))


def font_keyword(name: Column) -> Column:
    """The CSS keyword that a family is, null for a font's own name."""
    return F.element_at(F.create_map(*[F.lit(x) for k in FONT_KEYWORDS for x in (k.lower(), k)]), F.lower(name))


def is_stand_in(name: Column) -> Column:
    return name.rlike(GENERATED_FONT) & (F.regexp_extract(name, GENERATED_FONT, 2) != "")


def family_name(name: Column) -> Column:
    """A font as people know it: generated names undone, the device's own font by its CSS name."""
    own = F.replace(F.regexp_extract(name, GENERATED_FONT, 1), F.lit("_"), F.lit(" "))
    return F.when(name.rlike(GENERATED_FONT), own).when(F.lower(name).isin(SYSTEM_FONTS), F.lit("system-ui")).otherwise(name)


def font_names(stack: Column) -> Column:
    """The families of a CSS list: commas inside quotes part nothing, a backslash keeps the next character."""
    each = F.regexp_extract_all(stack, F.lit(r"""((?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\\.|[^,"'\\])+)"""), F.lit(1))
    bare = lambda x: text.squeeze(F.regexp_replace(F.regexp_replace(x, r"""(?<!\\)["']""", ""), r"\\(.)", "$1"))
    return F.filter(F.transform(each, bare), lambda x: x != "")


def css_family(name: Column) -> Column:
    """A family as CSS writes it: keywords bare, names with spaces in quotes."""
    return F.when(name.contains(" ") & font_keyword(name).isNull(), F.concat(F.lit('"'), name, F.lit('"'))).otherwise(name)


def uses_current_color(svg: Column) -> Column:
    return F.lower(svg).contains("currentcolor")


def without_label_words(label: Column) -> Column:
    """ "Acme logo" -> "Acme"."""
    return F.trim(text.squeeze(F.regexp_replace(label, LABEL_WORDS, " ")), F.lit(" -|:"))


def could_be_name(words: Column, host: Column) -> Column:
    """At most four words that match the address; no UDF, so `words` must be folded to ASCII where that matters."""
    match = names.match_words(_plain_words(words), urls.main_label(host))
    return (text.squeeze(words) != "") & (F.size(F.split(text.squeeze(words), " ")) <= 4) & (match >= names.ENOUGH)


def _plain_words(name: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.translate(F.translate(name, "’‘`", "'''"), "'.", "")), F.lit("([a-z0-9]+|&)"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(names.COMPANY_WORDS))


def plain_name(name: Column, host: Column) -> Column:
    """A site's name as people say it; a part is only dropped if what is left still matches the address."""

    def kept(old: Column, new: Column) -> Column:
        return F.when((new != old) & could_be_name(new, host), new).otherwise(old)

    signs = text.squeeze(F.regexp_replace(name, TRADEMARKS, " "))
    bare = F.when(signs == "", name).otherwise(signs)
    return text.let(
        kept(bare, F.regexp_replace(bare, BRACKETED, "")),
        lambda n: F.when(
            n.rlike(r"(?i)^(?:www\.)?[^.\s]+\.[a-z.]{2,12}$") & (urls.without_www(F.lower(n)) == urls.without_www(F.lower(host))),
            F.regexp_extract(n, r"(?i)^(?:www\.)?([^.\s]+)\.", 1),
        ).otherwise(text.let(kept(n, F.regexp_replace(n, REGIONS, "$1")), lambda r: kept(r, F.trim(F.regexp_replace(r, SHOP_WORDS, ""))))),
    )


def name_from_title(title: Column, host: Column) -> Column:
    """The shortest part of a title that matches the address, the first on ties."""
    parts = F.filter(F.transform(F.split(title, TITLE_PARTS), lambda p: F.trim(p)), lambda p: (p != "") & could_be_name(p, host))
    ranked = F.array_min(F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i"), p.alias("part"))))
    return ranked["part"]
