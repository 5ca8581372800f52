"""The element tree of HTML pages: tokens of a page folded, in its row, into nodes with a path of ancestors and an interval.

A node knows the tokens at which it opens and closes, so "inside" is containment of intervals, and its path, the numbers of its
ancestors from the root, so what is around it is a lookup in the row's own array. The fold is Spark's own aggregate over the page's tags,
in blocks of BLOCK tags, so that a page of any length costs time in its length.

Defined results, as browsers read pages: void elements and, inside SVG, self-closed ones hold nothing; a paragraph, list item, table
cell or row, option, link or button ends where the next of its kind begins or what holds it ends; an end tag closes the nearest open element of
its name within its table cell or object, with all that is open in it, and is ignored if there is none; what is still open ends with the page; the contents of
scripts, styles, text areas and titles are text. Formatting that is left open isn't opened anew in the next paragraph, and elements
that a page leaves out (html, head, body) are not made up. A null page has no nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import text

_REST = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""
#: Comments, elements whose content is text, tags, declarations, texts; a bracket that opens nothing is text.
TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<(?:script|style|textarea|title)(?=[\s/>]){_REST}>.*?</(?:script|style|textarea|title)\s*>|</?[a-z]{_REST}>|<[!?/][^>]*>|[^<]+|<"
RAW = r"(?is)^<(script|style|textarea|title)(?=[\s/>])"
ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?"""
#: Tags folded at once.
BLOCK = 512

# Fixed values of the HTML standard: elements without content, those that end a paragraph, those that end tags don't reach across.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
BLOCKS = [
    "address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "table", "ul",
]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
WALLS = ["table", "td", "th", "caption", "template", "object", "button"]
#: Start tags: what they close, and what a search for it stops at. Blocks close a paragraph and an open head.
STARTS = [
    (["li"], ["li", "p"], ["ul", "ol", "menu", *WALLS]),
    (["dt", "dd"], ["dt", "dd", "p"], ["dl", *WALLS]),
    (["tr"], ["tr", "td", "th"], ["table", "template"]),
    (["td", "th"], ["td", "th"], ["table", "template"]),
    (["thead", "tbody", "tfoot"], ["thead", "tbody", "tfoot", "tr", "td", "th"], ["table", "template"]),
    (["option"], ["option"], ["select", "datalist"]),
    (["optgroup"], ["optgroup", "option"], ["select"]),
    (["a"], ["a"], WALLS),
    (["button"], ["button"], [w for w in WALLS if w != "button"]),
    (["body"], ["head"], []),
    (BLOCKS, ["p", "head"], WALLS),
]
#: End tags whose search stops elsewhere than at WALLS.
ENDS = [
    (["li"], ["ul", "ol", "menu", *WALLS]),
    (["tr", "td", "th", "thead", "tbody", "tfoot", "caption"], ["table", "template"]),
    (["table", "template", "object"], []),
    (["button"], [w for w in WALLS if w != "button"]),
]
#: End tags after which a page may go on.
IGNORED = ["body", "html"]

_OPEN = "struct<tag: string, n: int, at: int>"
_NODE = "struct<n: int, at: int, end: int, path: array<int>>"


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _marks(tokens: Column) -> Column:
    """Of each tag: its place among the tokens, name, whether it opens, holds nothing or is self-closed, what it closes and where that stops."""

    def mark(token: Column, at: Column) -> Column:
        name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1))

        def told(tag: Column) -> Column:
            opens = ~token.startswith("</")
            raw = token.rlike(RAW)
            shut, walls = F.when(opens, _words([])).when(tag.isin(*HEADINGS), _words(HEADINGS)).otherwise(F.array(tag)), F.lit(None)
            for tags, closed, stop in STARTS:
                shut, walls = F.when(opens & tag.isin(*tags), _words(closed)).otherwise(shut), F.when(opens & tag.isin(*tags), _words(stop)).otherwise(walls)
            for tags, stop in ENDS:
                walls = F.when(~opens & tag.isin(*tags), _words(stop)).otherwise(walls)
            return F.struct(
                at.alias("at"), tag.alias("tag"), opens.alias("opens"), (tag.isin(*VOID) | raw).alias("empty"), token.endswith("/>").alias("ended"),
                shut.alias("shut"), F.coalesce(walls, _words(WALLS)).alias("walls"),
            )

        return text.let(name, told)

    all_tags = F.transform(tokens, mark)
    return F.filter(all_tags, lambda m: (m["tag"] != "") & (m["opens"] | ~m["tag"].isin(*VOID, *IGNORED)))


def _cut(stack: Column, mark: Column) -> Column:
    """How many of the open elements stay open at a tag."""
    at = lambda within: F.transform(stack, lambda s, j: F.when(F.array_contains(within, s["tag"]), j))
    wall = F.coalesce(F.array_max(at(mark["walls"])), F.lit(-1))
    hits = text.let(wall, lambda w: F.filter(at(mark["shut"]), lambda j: j > w))
    return F.when(F.size(mark["shut"]) == 0, F.size(stack)).otherwise(text.let(hits, lambda h: F.coalesce(F.when(mark["opens"], F.array_min(h)).otherwise(F.array_max(h)), F.size(stack))))


def _ended(opened: Column, end: Column, below: Column) -> Column:
    """Nodes of the open elements `opened`, which stand on those of `below`."""
    path = lambda j: F.concat(below["n"], F.slice(opened["n"], 1, j))
    return F.transform(opened, lambda s, j: F.struct(s["n"].alias("n"), s["at"].alias("at"), end.alias("end"), path(j).alias("path")))


def _step(acc: Column, mark: Column) -> Column:
    def after(kept: Column) -> Column:
        stack = F.slice(acc["stack"], 1, kept)
        closed = _ended(F.slice(acc["stack"], kept + 1, F.size(acc["stack"])), mark["at"], stack)
        done = F.when(F.size(closed) == 0, acc["done"]).otherwise(F.concat(acc["done"], closed))
        drawing = mark["ended"] & ((mark["tag"] == "svg") | F.exists(stack, lambda s: s["tag"].isin("svg", "math")))
        hollow = mark["opens"] & (mark["empty"] | drawing)
        node = F.struct(acc["n"].alias("n"), mark["at"].alias("at"), mark["at"].alias("end"), stack["n"].alias("path"))
        one = F.struct(mark["tag"].alias("tag"), acc["n"].alias("n"), mark["at"].alias("at"))
        return F.struct(
            F.when(mark["opens"] & ~hollow, F.array_append(stack, one)).otherwise(stack).alias("stack"),
            F.when(hollow, F.array_append(done, node)).otherwise(done).alias("done"),
            (acc["n"] + mark["opens"].cast("int")).alias("n"),
        )

    return text.let(_cut(acc["stack"], mark), after)


def _folded(marks: Column, last: Column) -> Column:
    """The nodes (_NODE) in the order of their numbers."""
    nothing = F.array().cast(f"array<{_NODE}>")

    def block(acc: Column, b: Column) -> Column:
        start = F.struct(acc["stack"].alias("stack"), nothing.alias("done"), acc["n"].alias("n"))
        inner = F.aggregate(F.slice(marks, b * BLOCK + 1, F.lit(BLOCK)), start, _step)
        return text.let(inner, lambda i: F.struct(i["stack"].alias("stack"), F.array_append(acc["done"], i["done"]).alias("done"), i["n"].alias("n")))

    zero = F.struct(F.array().cast(f"array<{_OPEN}>").alias("stack"), F.array().cast(f"array<array<{_NODE}>>").alias("done"), F.lit(0).alias("n"))
    blocks = F.sequence(F.lit(0), F.floor(F.size(marks) / BLOCK).cast("int"))
    rest = lambda a: _ended(a["stack"], last, F.array().cast(f"array<{_OPEN}>"))
    return F.aggregate(blocks, zero, block, lambda a: F.array_sort(F.concat(F.flatten(a["done"]), rest(a))))


def _attributes(token: Column) -> Column:
    """Attributes of a start tag by lower-case name, the first of each name; without a value, an empty text."""
    inside = F.regexp_replace(token, r"(?s)^<[A-Za-z][^\s/>]*|/?>$", " ")
    found = lambda i: F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(i))

    def paired(a: Column) -> Column:
        return text.let(F.array_distinct(a["name"]), lambda names: F.map_from_arrays(names, F.transform(names, lambda n: text.decoded(F.get(a["value"], (F.array_position(a["name"], n) - 1).cast("int"))))))

    parts = F.struct(F.transform(found(1), lambda n: F.lower(n)).alias("name"), F.zip_with(F.zip_with(found(2), found(3), lambda x, y: F.concat(x, y)), found(4), lambda x, y: F.concat(x, y)).alias("value"))
    return text.let(parts, paired)


def parsed(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages plus tokens (texts) and nodes: n, at, end, path, tag, attributes, in the order in which they open."""
    cut = pages.withColumn("tokens", F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(0)))
    marked = cut.withColumn("__marks", _marks(F.col("tokens")))
    folded = marked.withColumn("nodes", _folded(F.col("__marks"), F.size("tokens")))
    start = lambda token: F.regexp_extract(token, rf"(?s)^<{_REST}>", 0)

    def whole(node: Column) -> Column:
        tag = F.lower(F.regexp_extract(F.get("tokens", node["at"]), r"^<([A-Za-z][^\s/>]*)", 1))
        return F.struct(*[node[c].alias(c) for c in ("n", "at", "end", "path")], tag.alias("tag"), _attributes(start(F.get("tokens", node["at"]))).alias("attributes"))

    return folded.withColumn("nodes", F.transform("nodes", whole)).drop("__marks")


def attribute(node: Column, name: str) -> Column:
    return F.try_element_at(node["attributes"], F.lit(name))


def ancestors(nodes: Column, node: Column) -> Column:
    """The nodes around one, the nearest first."""
    return F.transform(F.reverse(node["path"]), lambda n: F.get(nodes, n))


def closest(nodes: Column, node: Column, tag: str) -> Column:
    """The nearest ancestor of that name, null if there is none."""
    return F.get(F.filter(ancestors(nodes, node), lambda a: a["tag"] == tag), F.lit(0))


def is_inside(node: Column, other: Column) -> Column:
    return (node["at"] > other["at"]) & (node["at"] < other["end"])


def markup(tokens: Column, node: Column) -> Column:
    """A node as it stands in the page, end tag included."""
    return F.array_join(F.slice(tokens, node["at"] + 1, node["end"] - node["at"] + 1), "")


def inner_texts(tokens: Column, node: Column) -> Column:
    """The texts inside a node, those of titles included, of scripts and styles not; tidied, without empty ones."""
    own = F.slice(tokens, node["at"] + 1, node["end"] - node["at"] + 1)
    titled = lambda t: F.when(t.rlike(r"(?i)^<(title|textarea)\b"), F.regexp_replace(t, rf"(?s)^<{_REST}>|</\w+\s*>$", "")).otherwise(t)
    said = F.filter(F.transform(own, titled), lambda t: ~t.startswith("<"))
    return F.filter(F.transform(said, lambda t: text.squeeze(text.decoded(t))), lambda t: t != "")


def page_nodes(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row for each element: the columns `keep` (page_id), n, at, end, parent (its number, null at the root), depth, tag and attributes."""
    keep = keep or ["page_id"]
    # outer: for a plain explode the optimizer puts a filter on the number of nodes below, which would parse each page twice
    one = parsed(pages.select(*keep, "html")).select(*keep, F.explode_outer("nodes").alias("node")).where("node IS NOT NULL")
    depth = F.size("node.path")
    return one.select(*keep, *[F.col(f"node.{c}") for c in ("n", "at", "end")], F.get("node.path", depth - 1).alias("parent"), depth.alias("depth"), "node.tag", "node.attributes")
