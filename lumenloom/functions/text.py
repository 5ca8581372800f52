"""Text scalars: tidying, Markdown to plain lines, words, containment, labels, escaping."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that take no space, scripts written without spaces, quote marks and primes read as plain ones.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
UNSPACED = (
    r"[\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}"
    r"\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}\x{20000}-\x{3134f}]"
)
QUOTES_FROM, QUOTES_TO = "\u2018\u2019\u201a\u201b\u2032\u201c\u201d\u201e\u201f\u2033", "'''''\"\"\"\"\""
#: What composition (NFC) leaves alone; texts of nothing else skip the UDF.
COMPOSED = r"^[\x{0}-\x{2ff}\x{2010}-\x{205e}\x{20a0}-\x{20bf}\x{4e00}-\x{9fff}\x{1f300}-\x{1f6ff}]*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body uses it: nested expressions stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space, Unicode's included, to single spaces; trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean(text: Column, limit: int) -> Column:
    """Squeezed, cut, and null if nothing is left."""
    return F.nullif(F.substring(squeeze(text), 1, limit), F.lit(""))


def without_controls(text: Column) -> Column:
    """Direction marks dropped, control characters and separators read as spaces, squeezed."""
    marks = "‎‏‪‫‬‭‮⁦⁧⁨⁩"
    return squeeze(F.regexp_replace(F.translate(text, marks, ""), r"[\p{Cc}\p{Zl}\p{Zp}]", " "))


def composed(text: Column) -> Column:
    """NFC. Spark has no normalisation, so it takes a UDF, which gets only the texts that may need it."""

    @F.pandas_udf(StringType())
    def compose(values: pd.Series) -> pd.Series:
        import unicodedata

        return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))

    done = text.rlike(COMPOSED)
    return F.when(done, text).otherwise(compose(F.when(~done, text)))


def as_compared(text: Column) -> Column:
    """As composed quotes are compared: plain quote marks, nothing invisible, single spaces."""
    return squeeze(F.translate(F.translate(text, QUOTES_FROM, QUOTES_TO), INVISIBLE, ""))


def normalise(text: Column) -> Column:
    return as_compared(composed(text))


def unquoted(text: Column) -> Column:
    """Without one pair of equal quote marks around it."""
    return F.trim(F.regexp_replace(text, r"""^(["'])(.*)\1$""", "$2"))


def word_count(text: Column) -> Column:
    """Space-separated pieces with a letter or digit, plus half of the characters of unspaced scripts."""
    spaced = F.filter(F.split(squeeze(F.regexp_replace(text, UNSPACED, " ")), " "), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    return (F.size(spaced) + F.floor(F.regexp_count(text, F.lit(UNSPACED)) / 2)).cast("long")


#: What may stand before a line's own words: quote marks, a heading's or list's sign, in any nesting.
LEADING = r"^[\s>]*(?:(?:#{1,6}|[*+-]|\d{1,3}[.)])(?=\s)[\s>]*)*"
#: An inline mark and what of it can be seen: code and escapes first, as nothing inside them counts.
PICTURE, LINKED = r"!\[[^\[\]]*\]\([^()]*\)", r"\[([^\[\]]*)\]\([^()]*\)"
AUTOLINK, ELEMENT = r"<(?:[a-z]{4,6}:)[^<>\s]*>", r"<[/a-zA-Z][^<>]*>"
STRONG_MARK = r"(?<!\\)(?:\*\*|__)(?=\S)|(?<=[^\s\\])(?:\*\*|__)"
LIGHT_MARK = r"(?<![\p{L}\p{N}\\])[*_](?=[^\s*_])|(?<=[^\s\\])[*_](?![\p{L}\p{N}])"
ESCAPED = r"\\(\p{Punct})"
#: What every inline mark and entity has one of; most lines have none.
MARKED = r"[\[<*_`\\&]"
#: White space that squeezing changes, and characters that compared texts don't have.
LOOSE, UNLIKE = r"(?U)\s\s|[\s&&[^ ]]", f"[{QUOTES_FROM}{INVISIBLE}]"
#: Lines that draw something: rules, and what parts a table's head from its rows.
DRAWN = r"^(?=.*[-*_].*[-*_])[\s|:*_-]+$"
#: The entities that web pages use most; the rest stay as written.
ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def decoded(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _seen(line: Column) -> Column:
    """What a reader sees of one line of Markdown."""
    bare = F.regexp_replace(line, LEADING, "")
    shown = F.regexp_replace(F.regexp_replace(bare, PICTURE, ""), LINKED, "$1")
    shown = F.regexp_replace(F.regexp_replace(shown, AUTOLINK, ""), ELEMENT, " ")
    shown = F.regexp_replace(F.regexp_replace(shown, STRONG_MARK, ""), LIGHT_MARK, "")
    shown = decoded(F.regexp_replace(F.replace(shown, F.lit("`"), F.lit("")), ESCAPED, "$1"))
    return F.when(line.rlike(MARKED), shown).otherwise(bare)


def plain_lines(markdown: Column) -> Column:
    """array<string>: the visible lines of Markdown, table cells apart, nothing empty."""
    lines = F.split(F.regexp_replace(markdown, f"[{INVISIBLE}]", ""), r"\r\n|[\n\r\x0B\f\x{85}\x{2028}\x{2029}]")
    cells = lambda x: F.when(x.rlike(r"^\s*\|"), F.split(F.trim(x, F.lit("| ")), r"\|")).otherwise(F.array(x))
    told = F.transform(F.filter(lines, lambda x: ~(x.rlike(r"^[\s|:*_-]") & x.rlike(DRAWN))), lambda x: cells(_seen(x)))
    tight = lambda x: F.when(x.rlike(LOOSE), squeeze(x)).otherwise(F.trim(x))
    return F.filter(F.transform(F.flatten(told), tight), lambda x: x != "")


def compared_lines(markdown: Column) -> Column:
    """plain_lines() as composed quotes are compared; lines that have nothing to change, as most, are left alone."""
    return F.transform(plain_lines(markdown), lambda x: F.when(x.rlike(UNLIKE), as_compared(x)).otherwise(x))


def plain_text(markdown: Column) -> Column:
    return F.array_join(plain_lines(markdown), "\n")


def contains_words(text: Column, wanted: Column) -> Column:
    """Whether `wanted` is in `text` as whole words: "ink" isn't in "think". A plain test goes before the regex."""
    quoted = F.regexp_replace(wanted, r"([\\.\[\]{}()*+?^$|#-])", r"\\$1")
    before = F.when(wanted.rlike(r"^[\p{L}\p{N}]"), F.lit(r"(?<![\p{L}\p{N}])")).otherwise("")
    after = F.when(wanted.rlike(r"[\p{L}\p{N}]$"), F.lit(r"(?![\p{L}\p{N}])")).otherwise("")
    return F.when((wanted == "") | ~F.contains(text, wanted), F.lit(False)).otherwise(F.regexp_like(text, F.concat(before, quoted, after)))


def joined(items: Column) -> Column:
    """[a, b, c] -> "a, b and c"."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.get(items, n - 1)))


def html_escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def page_tag_defused(text: Column) -> Column:
    """No text may open or close a page tag of its own."""
    return F.regexp_replace(text, r"(?i)<(?=/?\s*page)", "&lt;")


def whole_number(x: Column) -> Column:
    """56.0 -> "56", 56.5 -> "56.5"."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def lean(value: Column) -> Column:
    """A 0-100 scale as words: which end, and how far."""
    return (
        F.when(value <= 15, F.lit("strongly left")).when(value <= 35, F.lit("leans left"))
        .when(value >= 85, F.lit("strongly right")).when(value >= 65, F.lit("leans right")).otherwise("balanced")
    )


def scale(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), value))


def confidence_level(value: Column) -> Column:
    return F.when(value >= 0.8, F.lit("high")).when(value >= 0.5, F.lit("medium")).otherwise("low")


def ascii_folded(text: Column) -> Column:
    """NFKD and what of it is ASCII (Spark has no normalisation)."""

    @F.pandas_udf(StringType())
    def fold(values: pd.Series) -> pd.Series:
        import unicodedata

        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())

    return fold(text)


def slug(text: Column, limit: int = 60) -> Column:
    """Lower-case ASCII words joined by dashes; null if nothing is left."""
    dashed = F.regexp_replace(F.lower(ascii_folded(text)), "[^a-z0-9]+", "-")
    return F.nullif(F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, limit), "-+$", ""), F.lit(""))
