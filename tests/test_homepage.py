"""The element tree of pages, links with their place, logo candidates and borrowed shapes."""

import random

from pyspark.sql import functions as F

from lumenloom.operators import head, homepage, references, tree

HOME = "https://www.marlowe.example/"


def nodes(spark, *htmls):
    found = [[] for _ in htmls]
    for r in tree.page_nodes(spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string").repartition(1)).orderBy("page_id", "n").collect():
        found[r.page_id].append(r)
    return found


TREES = [
    ("<p>a<p>b<div>c</div>", [("p", None), ("p", None), ("div", None)]),
    ("<ul><li>a<li><ul><li>b</ul><li>c</ul>d", [("ul", None), ("li", 0), ("li", 0), ("ul", 2), ("li", 3), ("li", 0)]),
    ("<div><br><img src=a><input></div><hr>", [("div", None), ("br", 0), ("img", 0), ("input", 0), ("hr", None)]),
    ("<div><span>a</div>b</span><i>c", [("div", None), ("span", 0), ("i", None)]),
    ("<svg><path d='M0'/><g/><circle></circle></svg><div/><b>", [("svg", None), ("path", 0), ("g", 0), ("circle", 0), ("div", None), ("b", 4)]),
    ("<table><tr><td><p>1<td>2<tr><th>3</table><p>", [("table", None), ("tr", 0), ("td", 1), ("p", 2), ("td", 1), ("tr", 0), ("th", 5), ("p", None)]),
    ("<table><tr><td>a</div></td></tr></table>", [("table", None), ("tr", 0), ("td", 1)]),
    ("<div><table><tr><td></div><b></b></table></div>", [("div", None), ("table", 0), ("tr", 1), ("td", 2), ("b", 3)]),
    ("<script>if(a<b){'</p><div>'}</script><!-- <i> --><title>a <b> c</title><u>", [("script", None), ("title", None), ("u", None)]),
    ("<a href=1>x<a href=2>y</a>z<select><option>a<option>b</select><dl><dt>a<dd>b<dt>c</dl>", [("a", None), ("a", None), ("select", None), ("option", 2), ("option", 2), ("dl", None), ("dt", 5), ("dd", 5), ("dt", 5)]),
    ("<html><head><meta charset=x><body><h1>a</h2>b</body></html><p>late", [("html", None), ("head", 0), ("meta", 1), ("body", 0), ("h1", 3), ("p", 3)]),
    ("a < b & c > d <3 </ p>", []),
    ("", []),
    (None, []),
]


def test_tree(spark):
    for (html, want), rows in zip(TREES, nodes(spark, *[html for html, _ in TREES])):
        assert [(r.tag, r.parent) for r in rows] == want, html


def test_attributes_and_intervals(spark):
    (rows,) = nodes(spark, """<DIV Class="a > b" id=c data-x='"' hidden id=d>x<br/>y</DIV><a href="?a=1&amp;b=2">""")
    assert rows[0].attributes == {"class": "a > b", "id": "c", "data-x": '"', "hidden": ""} and rows[2].attributes == {"href": "?a=1&b=2"}
    assert [(r.at, r.end, r.depth) for r in rows] == [(0, 4, 0), (2, 2, 1), (5, 6, 0)]


def test_long_pages_are_folded_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    html = "".join(rng.choice(["<div>", "</div>", "<p>", "x", "<br>", "<li>", "</ul>", "<ul>", "<b>", "</b>", "<table><tr><td>", "</table>"]) for _ in range(3000))
    (whole,) = nodes(spark, html)
    monkeypatch.setattr(tree, "BLOCK", 7)
    assert nodes(spark, html) == [whole] and len(whole) > 1000
    assert all(r.at <= r.end for r in whole)
    inside = {r.n: r for r in whole}
    assert all(inside[r.parent].at < r.at and r.end <= inside[r.parent].end and inside[r.parent].depth == r.depth - 1 for r in whole if r.parent is not None)


def homes(spark, *htmls, url=HOME):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


MARK = '<svg viewBox="0 0 90 30"><path d="M0 0h90v30H0z"/></svg>'


LADDER = [
    (f'<header><a href="/" aria-label="Marlowe Kites">{MARK}</a></header>', [("inline-svg", 0.9, None, "Marlowe Kites")]),
    (f'<header><a href="https://marlowe.example/en-gb">{MARK}</a></header>', [("inline-svg", 0.8, None, "")]),
    (f'<header><a href="https://shop.marlowe.example/">{MARK}</a></header>', []),
    ('<div class="topbar"><img class="logo" data-src="/i/kite.png" src="data:image/gif;base64,AA"></div>', [("header-img", 0.7, "https://www.marlowe.example/i/kite.png", "")]),
    ('<nav><img alt="Marlowe logo" srcset="/l@1x.webp 1x, /l@2x.webp 2x"></nav>', [("header-img", 0.75, "https://www.marlowe.example/l@1x.webp", "Marlowe logo")]),
    ('<footer><img alt="Marlowe logo" src="m.svg"></footer>', [("header-img", 0.65, "https://www.marlowe.example/m.svg", "Marlowe logo")]),
    ('<main><img alt="Marlowe" src="m.jpg"></main>', [("header-img", 0.6, "https://www.marlowe.example/m.jpg", "Marlowe")]),
    ('<main class="clients"><img class="logo" alt="Osier Bank logo" src="o.svg"><img alt="Marlowe Summer Fair logo" src="f.svg"></main>', []),
    ('<header><img class="logo" alt="Osier Bank logo" src="o.svg"></header>', []),
    ('<header><img class="logo" src="a.png" width="8"><img class="logo" alt="Free Delivery" src="b.png"><img class="logo" src="c.png" alt="logo"></header>', [("header-img", 0.7, "https://www.marlowe.example/c.png", "logo")]),
    ('<header class="logo-bar"><svg class="chevron" width="90"><path d="M0 0l4 4"/></svg><svg class="menu" width="20px" height="1.5em"><path d="M0 0"/></svg></header>', []),
    ('<header><svg width="20" height="20" aria-label="Marlowe logo"><path d="M0 0h9"/></svg></header>', [("inline-svg", 0.75, None, "Marlowe logo")]),
    (f'<header><ul class="language-list"><li><a href="/fr"><span>{MARK}</span></a></ul></header>', []),
    (f'<header><a href="/" hreflang="en">{MARK}</a></header>', []),
    ('<header><a href="/"><svg></svg></a></header>', []),
    ('<header><a href="/"><div data-mark-background="1" data-mark-id="e7" class="logo"></div></a></header>', [("css-background", 0.9, None, "")]),
    ('<base href="https://cdn.example/x/"><nav><img class="logo" src="k.png"></nav>', [("header-img", 0.7, "https://cdn.example/x/k.png", "")]),
    ('<main><img alt="Marlowe logo" src="/m.svg"></main><footer><img alt="Marlowe" src="/m.svg?"></footer><footer><img alt="Marlowe logo" src="/m.svg"></footer>', [("header-img", 0.65, "https://www.marlowe.example/m.svg", "Marlowe logo"), ("header-img", 0.65, "https://www.marlowe.example/m.svg?", "Marlowe")]),
    (f"<header><a href='/'><svg><title>Marlowe mark</title>{MARK}</svg></a></header>", [("inline-svg", 0.9, None, "Marlowe mark")]),
]


def test_logo_ladder(spark):
    found = [[] for _ in LADDER]
    for r in homepage.logo_candidates(homes(spark, *[html for html, _ in LADDER])).orderBy(F.desc("confidence"), "pos").collect():
        found[r.page_id].append((r.method, r.confidence, r.url, r.label))
    for (html, want), got in zip(LADDER, found):
        assert got == want, html


def drawn(spark, *pages):
    """The drawing in the link home of each page, given as what it uses and the rest of the page."""
    rows = homepage.logo_candidates(homes(spark, *[f'{rest}<header><a href="/"><svg class="logo">{uses}</svg></a></header>' for uses, rest in pages])).collect()
    found = {r.page_id: r.svg for r in rows}
    return [found.get(i) for i in range(len(pages))]


def test_borrowed_shapes(spark):
    sprite = '<svg hidden><symbol id="m"><use href="#part"/></symbol><g id="part"><path d="M1"/><use xlink:href="#dot"/></g><circle id="dot" r="3"/><g id="x"><use href="#y"/></g><g id="y"><use href="#x"/><path d="M9"/></g><g id="open"><use href="#none"/></g></svg>'
    chain = "".join(f'<g id="k{i}"><use href="#k{i + 1}"/></g>' for i in range(40)) + '<path id="k40" d="M0"/>'
    bad = ("#x", "#open", "#none", "/sprite.svg#m", "https://cdn.example/s.svg#m", "#a b")
    got = drawn(spark, ('<use href="#m"></use>', sprite), ('<path id="own" d="M2"/><use href="#own"/>', sprite), ('<use href="#k0"/>', f"<svg hidden>{chain}</svg>"), *[(f'<path d="M3"/><use href="{b}"/>', sprite) for b in bad])
    assert got[0] == '<svg class="logo"><use href="#m"></use><defs><symbol id="m"><use href="#part"/></symbol><g id="part"><path d="M1"/><use xlink:href="#dot"/></g><circle id="dot" r="3"/></defs></svg>'
    assert got[1] == '<svg class="logo"><path id="own" d="M2"/><use href="#own"/></svg>'
    assert got[2].count('<g id="k') == 40 and '<path id="k40" d="M0"/>' in got[2]
    assert got[3:] == [None] * len(bad)


def test_followed(spark):
    links = [("a", f"n{i}", f"n{i + 1}") for i in range(40)] + [("a", "n40", None), ("a", "p", "q"), ("a", "q", "r"), ("a", "r", "q"), ("a", "m", "gone"), ("a", "l", "m"), ("a", "s", "s"), ("b", "n0", None), ("b", "x", "n1")]
    got = {(r.scope, r.name): (r.state, r.end) for r in references.followed(spark.createDataFrame(links, "scope string, name string, to string")).collect()}
    assert all(got["a", f"n{i}"] == ("ends", "n40") for i in range(41)) and len(got) == len(links)
    assert {got["a", k] for k in "pqrs"} == {("circle", None)} and got["a", "m"] == got["a", "l"] == ("missing", None)
    assert got["b", "n0"] == ("ends", "n0") and got["b", "x"] == ("missing", None)
    assert references.followed(spark.createDataFrame([], "scope string, name string, to string")).count() == 0


def test_variables_over_long_chains(spark):
    rows = [("light", f"v{i}", f" var( --v{i + 1} ) ") for i in range(40)] + [("light", "v40", "#ABCDEF"), ("light", "x", "var(--y)"), ("light", "y", "var(--x)"), ("light", "z", "var(--none)"), ("dark", "v0", "var(--v40)")]
    got = {(r.theme, r.name): r.value for r in head.resolved_variables(spark.createDataFrame(rows, "theme string, name string, value string")).collect()}
    assert all(got["light", f"v{i}"] == "#ABCDEF" for i in range(41)) and len(got) == len(rows)
    assert got["light", "x"] is got["light", "y"] is got["light", "z"] is got["dark", "v0"] is None


def test_links_with_place(spark):
    html = """<head><base href="/en/"></head><body><div class="site-NAV"><a href="a">One <b>two</b>
    three</a><a href="#x">no</a><a href="mailto:a@b.example">no</a></div><p><a href="b" aria-label=" Said "><i>x</i></a><a href="/en/a">again</a>
    <footer><nav><a href="c"></a></nav></footer>"""
    rows = homepage.links_with_place(homes(spark, html)).orderBy("pos").collect()
    assert [(r.url, r.text, r.place) for r in rows] == [(f"{HOME}en/a", "One two three", "top"), (f"{HOME}en/b", "Said", "other"), (f"{HOME}en/c", "", "footer")]


def test_ranked_logos_and_the_name_they_give(spark):
    icons = '<head><link rel="icon" href="/i.svg" type="image/svg+xml"><link rel="apple-touch-icon" href="/t.png" sizes="180x180"><meta property="og:image" content="/o.jpg">'
    small = '<head><link rel="icon" href="/i16.png" sizes="16x16">'
    logo = '<header><a href="/"><img src="/m.png" alt="Marlowe Kites logo"></a></header>'
    h = homes(spark, f"{icons}{logo}", f"{small}{logo}", small, f"{icons}<p>", "")
    got = {}
    ranked = homepage.ranked_logos(h)
    for r in ranked.orderBy("page_id", "rank").collect():
        got.setdefault(r.page_id, []).append((r.method, r.confidence, r.url.removeprefix(HOME)))
    rest = [("favicon", 0.45, "t.png"), ("favicon", 0.35, "i.svg"), ("og-image", 0.25, "o.jpg")]
    assert got == {0: [("header-img", 0.9, "m.png"), *rest], 1: [("header-img", 0.9, "m.png"), ("favicon", 0.2, "i16.png")], 2: [("favicon", 0.2, "i16.png")], 3: rest}
    assert [(r.page_id, r.name) for r in homepage.name_from_logos(ranked, h).orderBy("page_id").collect()] == [(0, "Marlowe Kites"), (1, "Marlowe Kites")]
