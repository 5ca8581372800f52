"""What a homepage's element tree says about the brand: links with their place, and logo candidates with how sure each is.

A page is a row until its images are told apart; what is around an image comes from the tree's paths (operators/tree.py). Shapes
that a drawing borrows from elsewhere on its page come by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import labels, names, text, urls
from lumenloom.operators import head, logos, pages, references, tree
from lumenloom.sources.scratch import written

# How sure each kind of find is, sizes in pixels, words around logos, icons, menus, languages and promotions.
HOME_LINK_LOGO, HOME_LINK, TOP_LOGO, FOOTER_LOGO, NAMED_LOGO = 0.9, 0.8, 0.7, 0.65, 0.6
TOUCH_ICON, TAB_ICON, SHARED_PICTURE, SMALL_ICON = 0.45, 0.35, 0.25, 0.2
LEAST_SIZE, ICON_SIZE, ICON_EMS, ICON_DETAIL, TAB_ICON_SIZE = 12, 24, 1.5, 40, 64
LOGO_WORDS = r"(?i)logo|wordmark|brandmark"
ICON_WORDS = r"(?i)icon|chevron|caret|arrow|check|close|menu|hamburger|search"
TOP_WORDS = r"header|navbar|masthead|topbar|nav"
LANGUAGE_WORDS = r"(?i)language|locale|i18n|lang(uage)?[-_]?(switch|select|picker|menu)|country"
PROMOTION_WORDS = [
    "delivery", "returns", "sale", "offer", "offers", "banner", "banners", "promo", "promotion", "promotions",
    "deal", "deals", "discount", "discounts", "coupon", "coupons", "shipping", "cashback", "clearance",
    "advertise", "advertising", "sponsored",
]
HOME_LOCALE = r"(?i)^/[a-z]{2}([-_][a-z]{2})?/?$"
LOCAL_NAME = r"^#[\w:.-]{1,200}$"
SHAPES = r"(?i)<(path|rect|circle|ellipse|polygon|polyline|line|text|image)\b"
SAID = ["alt", "aria-label", "title", "class", "id", "data-analytics-label"]
OUTER = ["body", "html"]

#: Attributes by which a measured copy of a page marks its elements, and those that are drawn as a background.
MARK, BACKGROUND = "data-mark-id", "data-mark-background"


def _said(node: Column, *attributes: str) -> Column:
    return F.concat_ws(" ", *[tree.attribute(node, a) for a in attributes])


def _marker(node: Column) -> Column:
    return F.lower(_said(node, "class", "id"))


def _is_top(node: Column) -> Column:
    return node["tag"].isin("header", "nav") | (F.coalesce(tree.attribute(node, "role"), F.lit("")) == "banner") | _marker(node).rlike(TOP_WORDS)


def _is_footer(node: Column) -> Column:
    return (node["tag"] == "footer") | (F.coalesce(tree.attribute(node, "role"), F.lit("")) == "contentinfo") | _marker(node).contains("footer")


def _based(homes: DataFrame) -> DataFrame:
    """Parsed pages with `base`, the address that theirs are relative to: the first <base> with an address, else the page's own."""
    one = tree.parsed(homes)
    href = F.get(F.filter("nodes", lambda n: (n["tag"] == "base") & tree.attribute(n, "href").isNotNull()), F.lit(0))["attributes"]["href"]
    return one.withColumn("base", F.coalesce(text.let(href, lambda h: urls.absolute(h, F.col("url"))), F.col("url")))


def _absolute(value: Column) -> Column:
    return text.let(value, lambda v: urls.absolute(v, F.col("base")))


def links_with_place(homes: DataFrame) -> DataFrame:
    """page_id, pos, url, text and place (top, footer or other) of each address on a page once, where it first stands.

    homes: page_id, url, html. The text is the link's label, else the words inside it, 120 characters at most.
    """
    one = _based(homes.select("page_id", "url", "html"))

    def told(node: Column) -> Column:
        around = F.filter(tree.ancestors(F.col("nodes"), node), lambda a: ~a["tag"].isin(*OUTER))
        place = lambda a: F.when(F.exists(a, lambda x: x["tag"] == "footer"), F.lit("footer")).when(F.exists(a, _is_top), F.lit("top")).otherwise("other")
        words = F.coalesce(F.nullif(tree.attribute(node, "aria-label"), F.lit("")), F.array_join(tree.inner_texts(F.col("tokens"), node), " "))
        return F.struct(node["n"].alias("pos"), tree.attribute(node, "href").alias("href"), words.alias("text"), text.let(around, place).alias("place"))

    found = F.transform(F.filter("nodes", lambda n: (n["tag"] == "a") & tree.attribute(n, "href").isNotNull()), told)
    each = one.select("page_id", "base", F.explode_outer(found).alias("link")).where("link IS NOT NULL")
    each = each.select("page_id", "link.pos", _absolute(F.col("link.href")).alias("url"), F.coalesce(text.clean(F.col("link.text"), 120), F.lit("")).alias("text"), "link.place").where("url IS NOT NULL")
    first = Window.partitionBy("page_id", "url").orderBy("pos")
    return each.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def _file_name(node: Column) -> Column:
    source = F.coalesce(F.nullif(tree.attribute(node, "src"), F.lit("")), tree.attribute(node, "data-src"), F.lit(""))
    return F.when(source.startswith("data:"), F.lit("")).otherwise(F.regexp_extract(source, r"([^/?#]*)(?:[?#].*)?$", 1))


def _image(tokens: Column, nodes: Column, node: Column) -> Column:
    """What the page says of one image, before any address is read."""
    inner = F.filter(nodes, lambda n: tree.is_inside(n, node))
    titles = F.filter(inner, lambda n: n["tag"] == "title")
    title = F.when((node["tag"] == "svg") & (F.size(titles) > 0), F.array_join(tree.inner_texts(tokens, F.get(titles, F.lit(0))), " "))
    uses = F.transform(F.filter(inner, lambda n: n["tag"] == "use"), lambda n: F.coalesce(F.nullif(tree.attribute(n, "href"), F.lit("")), tree.attribute(n, "xlink:href"), F.lit("")))
    ids = F.filter(F.transform(inner, lambda n: tree.attribute(n, "id")), lambda i: i.isNotNull())

    def told(around: Column) -> Column:
        at = F.array_position(around["tag"], "a").cast("int")
        link = F.get(around, at - 1)
        page = F.filter(around, lambda a: ~a["tag"].isin(*OUTER))
        near = lambda k: F.coalesce(_said(F.get(page, F.lit(k)), *SAID), F.lit(""))
        menu = F.exists(F.filter(F.slice(around, F.greatest(at, F.lit(1)), F.lit(3)), lambda a: ~a["tag"].isin(*OUTER)), lambda a: _said(a, "class", "id", "aria-label").rlike(LANGUAGE_WORDS))
        return F.struct(
            node["n"].alias("pos"), node["tag"].alias("tag"), node["attributes"].alias("own"), title.alias("title"), _file_name(node).alias("file"),
            F.concat_ws(" ", _said(node, *SAID), _file_name(node), title, near(0), near(1), near(2)).alias("words"),
            F.when(at > 0, tree.attribute(link, "href")).alias("link"), F.when(at > 0, _said(link, "aria-label", "title")).alias("link_says"),
            F.when(at > 0, tree.attribute(link, "aria-label")).alias("link_label"), ((at > 0) & (tree.attribute(link, "hreflang").isNotNull() | menu)).alias("language_menu"),
            F.exists(page, _is_top).alias("in_top"), F.exists(page, _is_footer).alias("in_footer"),
            F.when(node["tag"] == "svg", tree.markup(tokens, node)).alias("svg"), uses.alias("uses"), F.array_except(F.filter(uses, lambda u: u.rlike(LOCAL_NAME)), F.transform(ids, lambda i: F.concat(F.lit("#"), i))).alias("borrows"),
        )

    return text.let(tree.ancestors(nodes, node), told)


def _told(homes: DataFrame) -> DataFrame:
    """page_id, url, requested, base, images and shapes of each page, written: everything that is told from the tree itself.

    Written, as a filter on what is told next would otherwise be pushed below the parsing and repeat it.
    """
    nodes = F.col("nodes")
    used = lambda u: F.coalesce(F.nullif(tree.attribute(u, "href"), F.lit("")), tree.attribute(u, "xlink:href"), F.lit(""))

    def is_image(n: Column) -> Column:
        inner = (n["tag"] == "svg") & F.exists(tree.ancestors(nodes, n), lambda a: a["tag"] == "svg")
        return (n["tag"].isin("img", "svg") | tree.attribute(n, BACKGROUND).isNotNull()) & ~inner

    def shape(n: Column) -> Column:
        uses = F.transform(F.filter(nodes, lambda u: (u["tag"] == "use") & (tree.is_inside(u, n) | (u["n"] == n["n"]))), used)
        return F.struct(n["n"].alias("pos"), F.concat(F.lit("#"), tree.attribute(n, "id")).alias("name"), tree.markup(F.col("tokens"), n).alias("markup"), uses.alias("uses"))

    images = F.transform(F.filter(nodes, is_image), lambda n: _image(F.col("tokens"), nodes, n))
    named = F.filter(nodes, lambda n: F.coalesce(tree.attribute(n, "id"), F.lit("")) != "")
    shapes = F.when(F.exists(nodes, lambda n: n["tag"] == "use"), F.transform(named, shape))
    return written(_based(homes).select("page_id", "url", "requested", "base", images.alias("images"), shapes.alias("shapes")), "images")


def _shapes(told: DataFrame) -> DataFrame:
    """page_id, name, pos, markup and uses of the elements with an id on pages that borrow; of one id, the first element."""
    each = told.select("page_id", F.explode("shapes").alias("s"))
    return each.groupBy("page_id", F.col("s.name").alias("name")).agg(F.min_by("s", "s.pos").alias("s")).select("page_id", "name", "s.pos", "s.markup", "s.uses")


def borrowed_shapes(drawings: DataFrame, shapes: DataFrame) -> DataFrame:
    """drawings with `shapes`, the markup of all that they borrow, in page order: null if one is missing, points elsewhere or is part of a circle.

    drawings: page_id, pos, uses and borrows (of the uses, those of names outside the drawing). shapes: page_id, name, pos, markup, uses. What a
    borrowed shape uses is borrowed too, over any number of steps.
    """
    scope = {"scope": "page_id"}
    edges = shapes.select("page_id", "name", F.explode("uses").alias("to"))
    beyond = references.reached(edges, **scope).withColumnRenamed("scope", "page_id").withColumnRenamed("name", "via")
    direct = drawings.select("page_id", "pos", F.explode("borrows").alias("name"))
    further = direct.join(beyond, (direct["page_id"] == beyond["page_id"]) & (direct["name"] == beyond["via"])).select(direct["page_id"], "pos", F.col("to").alias("name"))
    wanted = direct.unionByName(further).distinct()
    circles = beyond.where("via = to").select("page_id", F.col("via").alias("name"), F.lit(True).alias("circle"))
    held = shapes.select("page_id", "name", F.col("pos").alias("at"), "markup").join(circles, ["page_id", "name"], "left")
    met = wanted.join(held, ["page_id", "name"], "left")
    bad = F.col("markup").isNull() | F.coalesce("circle", F.lit(False)) | ~F.col("name").rlike(LOCAL_NAME)
    lent = met.groupBy("page_id", "pos").agg(F.max(bad).alias("bad"), F.array_sort(F.collect_list(F.struct("at", "markup"))).alias("lent"))
    elsewhere = F.exists("uses", lambda u: ~u.rlike(LOCAL_NAME))
    out = drawings.join(lent, ["page_id", "pos"], "left")
    return out.withColumn("shapes", F.when(~elsewhere & ~F.coalesce("bad", F.lit(False)), F.coalesce(F.col("lent.markup"), F.array().cast("array<string>")))).drop("bad", "lent")


def _own(name: str) -> Column:
    return F.coalesce(F.try_element_at("own", F.lit(name)), F.lit(""))


def _first_said(*values: Column) -> Column:
    """The first value with something in it, trimmed; else empty."""
    return F.coalesce(*[F.nullif(text.squeeze(v), F.lit("")) for v in values], F.lit(""))


def _icon_sized() -> Column:
    """Whether a drawing says it is as small as an icon: by width and height, else by its view box."""

    def small(value: Column) -> Column:
        number, unit = (F.regexp_extract(value, r"^(\d+(?:\.\d+)?)(px|r?em)?$", i) for i in (1, 2))
        return F.coalesce(number.try_cast("double") <= F.when(unit.isin("", "px"), ICON_SIZE).otherwise(ICON_EMS), F.lit(False))

    given = F.filter(F.array(*[F.lower(F.trim(_own(k))) for k in ("width", "height")]), lambda v: v != "")
    box = F.filter(F.split(F.translate(_own("viewbox"), ",", " "), r"\s+"), lambda v: v != "")
    return F.when(F.size(given) > 0, F.forall(given, small)).otherwise((F.size(box) == 4) & F.forall(F.slice(box, 3, 2), small))


def _too_small() -> Column:
    return F.greatest(*[F.coalesce(F.regexp_extract(_own(k), r"^(\d+(?:\.\d+)?)(px)?$", 1).try_cast("double") < LEAST_SIZE, F.lit(False)) for k in ("width", "height")])


def _bare(words: Column) -> Column:
    return F.regexp_replace(F.lower(words), "[^a-z0-9]", "")


def logo_candidates(homes: DataFrame) -> DataFrame:
    """page_id, pos, key, method, confidence, url, svg, shapes, format, label and element_id of what looks like the brand's logo.

    homes: page_id, url, html and, if they differ, `requested`, the address that was asked for. In the link home an image is almost always
    the logo; in the header it must be labelled as one; elsewhere it must also bear the brand's name and no other. Interface
    icons, promotions, images below 12 pixels and logos labelled with other names are none. An image found twice counts at its best place.
    """
    home = homes.withColumn("requested", F.col("requested") if "requested" in homes.columns else F.col("url"))
    told = _told(home.select("page_id", "url", "requested", "html"))
    i = told.select("page_id", "url", "requested", "base", F.explode("images").alias("i")).select("page_id", "url", "requested", "base", "i.*")
    host = urls.host(F.col("url"))
    sources = (_own("src"), _own("data-src"), F.regexp_extract(_own("srcset"), r"^\s*([^\s,]+)", 1))
    label = _first_said(_own("alt"), _own("aria-label"), _own("title"), F.col("title"), F.col("link_label"))
    given = labels.without_label_words(_first_said(_own("alt"), _own("aria-label")))
    i = i.select("*", host.alias("host"), urls.main_label(host).alias("brand"), _absolute(F.col("link")).alias("href"), *[_absolute(F.nullif(v, F.lit(""))).alias(f"source{k}") for k, v in enumerate(sources)], label.alias("label"), given.alias("given"), _too_small().alias("too_small"))
    i = written(i, "addresses").where("NOT too_small")
    bare_path = lambda u: F.when(urls.path(u) == "", F.lit("/")).otherwise(urls.path(u))
    at_home = bare_path(F.col("href")).isin("/") | (bare_path(F.col("href")) == bare_path(F.col("url"))) | (bare_path(F.col("href")) == bare_path(F.col("requested"))) | bare_path(F.col("href")).rlike(HOME_LOCALE)
    own_words = F.concat_ws(" ", _own("alt"), _own("aria-label"), _own("title"), "title", "file", "link_says")
    spaced = F.filter(F.split(F.lower(F.regexp_replace(own_words, "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda w: w != "")
    svg = F.col("tag") == "svg"
    named = lambda words: (F.length("brand") >= 3) & F.contains(_bare(words), F.col("brand"))
    i = i.withColumns({
        "home": F.coalesce(~F.col("language_menu") & (urls.without_www(urls.host(F.col("href"))) == urls.without_www(F.col("host"))) & at_home, F.lit(False)),
        "is_logo": F.col("words").rlike(LOGO_WORDS), "names_brand": named(F.col("words")), "names_itself": named(own_words),
        "promotion": F.arrays_overlap(spaced, F.array(*[F.lit(w) for w in PROMOTION_WORDS])),
        "icon": svg & (logos.detail(F.coalesce("svg", F.lit(""))) < ICON_DETAIL) & (_icon_sized() | F.concat_ws(" ", _own("class"), _own("id"), _own("data-icon"), _own("data-testid")).rlike(ICON_WORDS)),
        "says_logo": F.concat_ws(" ", _own("class"), _own("id"), _own("aria-label"), _own("title"), "title", "link_says").rlike(LOGO_WORDS),
        "label_name": labels.without_label_words(F.col("label")),
    })
    i = i.withColumns({"label_match": names.name_match(F.col("label_name"), F.col("brand")), "given_match": names.name_match(F.col("given"), F.col("brand"))})
    i = written(i, "judged")
    labelled = F.col("says_logo") | ((F.col("label_name") != "") & (F.col("label_match") >= names.ENOUGH))
    i = i.where(~(F.col("icon") & ~labelled) & (F.col("home") | ~F.col("promotion")))
    lower = F.when(F.col("in_footer"), F.lit(FOOTER_LOGO)).otherwise(NAMED_LOGO)
    confidence = (
        F.when(F.col("home"), F.when(F.col("is_logo") | F.col("names_brand"), F.lit(HOME_LINK_LOGO)).otherwise(HOME_LINK))
        .when(F.col("is_logo") & F.col("in_top"), F.lit(TOP_LOGO) + F.when(F.col("names_brand"), 0.05).otherwise(0.0))
        .when(F.col("is_logo") & F.col("names_itself"), lower)
        .when((F.col("given") != "") & (F.col("given_match") == 1.0) & ~F.col("icon"), lower)
    )
    ours = (F.col("label_name") == "") | F.when(F.col("in_top"), F.col("label_match") >= names.ENOUGH).otherwise(F.col("label_match") == 1.0)
    i = i.withColumn("confidence", F.round(confidence, 4)).where(F.col("confidence").isNotNull() & (F.col("home") | ours))
    source = F.coalesce("source0", "source1", "source2")
    background = ~svg & F.try_element_at("own", F.lit(BACKGROUND)).isNotNull()
    mark = F.nullif(_own(MARK), F.lit(""))
    i = i.withColumns({"source": F.when(~svg & ~background, source), "element_id": mark, "method": F.when(svg, F.lit("inline-svg")).when(background, F.lit("css-background")).otherwise("header-img")})
    i = borrowed_shapes(i, _shapes(told))
    drawn = F.concat(F.coalesce("svg", F.lit("")), F.array_join("shapes", "")).rlike(SHAPES)
    i = i.where(F.when(svg, F.coalesce(drawn, F.lit(False))).when(background, mark.isNotNull()).otherwise(F.col("source").isNotNull()))
    kind = F.when(svg, F.lit("svg")).when(background, F.lit("png")).otherwise(urls.file_format(F.col("source")))
    whole = F.when(F.size("shapes") > 0, F.concat(F.regexp_replace("svg", r"(?i)</svg\s*>$", ""), F.lit("<defs>"), F.array_join("shapes", ""), F.lit("</defs></svg>"))).otherwise(F.col("svg"))
    i = i.withColumn("markup", F.when(svg, whole)).withColumn("key", F.coalesce("source", "markup", F.concat(F.lit("css:"), F.col("element_id"))))
    row = F.struct("method", "confidence", F.col("source").alias("url"), F.col("markup").alias("svg"), kind.alias("format"), "label", "element_id")
    best = i.groupBy("page_id", "key").agg(F.min("pos").alias("pos"), F.max_by(row, F.struct("confidence", -F.col("pos"))).alias("row"))
    return best.select("page_id", "pos", "key", "row.*")


def ranked_logos(homes: DataFrame) -> DataFrame:
    """page_id, rank, method, confidence, url, svg, format and label: the page's logos with its app icon, tab icon and shared picture, best first.

    Five at most; a tab icon too small for a logo keeps the last place.
    """
    seen = logo_candidates(homes)
    icons = head.icon_links(homes)
    touch, tab = F.arrays_overlap("rel", F.array(F.lit("apple-touch-icon"), F.lit("apple-touch-icon-precomposed"))), F.array_contains("rel", "icon")
    largest = F.max_by(F.struct("url", "format"), F.struct("size", -F.col("pos")))
    none = F.lit(None).cast("string")

    def icon(kind: Column, confidence: float, place: int, method: str = "favicon") -> DataFrame:
        top = icons.where(kind).groupBy("page_id").agg(largest.alias("i"))
        return top.select("page_id", F.lit(place).alias("pos"), F.col("i.url").alias("key"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), F.col("i.url").alias("url"), none.alias("svg"), F.col("i.format").alias("format"), F.lit("").alias("label"))

    shared = homes.select("page_id", urls.absolute(pages.meta(F.col("html"), "og:image"), F.col("url")).alias("url")).where("url IS NOT NULL")
    shared = shared.select("page_id", F.lit(2_000_000_002).alias("pos"), F.col("url").alias("key"), F.lit("og-image").alias("method"), F.lit(SHARED_PICTURE).alias("confidence"), "url", none.alias("svg"), urls.file_format(F.col("url")).alias("format"), F.lit("").alias("label"))
    small = head.best_icon(icons).select("page_id", F.lit(2_000_000_003).alias("pos"), F.col("url").alias("key"), F.lit("favicon").alias("method"), F.lit(SMALL_ICON).alias("confidence"), "url", none.alias("svg"), urls.file_format(F.col("url")).alias("format"), F.lit("").alias("label"))
    usable = tab & ((F.col("format") == "svg") | (F.col("size") >= TAB_ICON_SIZE))
    no = F.lit(False)
    every = seen.drop("element_id").withColumn("small_icon", no)
    for more in (icon(touch, TOUCH_ICON, 2_000_000_000), icon(usable, TAB_ICON, 2_000_000_001), shared):
        every = every.unionByName(more.withColumn("small_icon", no))
    every = every.unionByName(small.withColumn("small_icon", F.lit(True)))
    ranks = logos.rank_logos(every.withColumnRenamed("page_id", "site_id").select("site_id", "key", "pos", "confidence", "small_icon"))
    held = every.groupBy("page_id", "key").agg(F.max_by(F.struct("method", "url", "svg", "format", "label"), F.struct("confidence", -F.col("pos"))).alias("row"))
    met = ranks.withColumnRenamed("site_id", "page_id").join(held, ["page_id", "key"])
    return met.select("page_id", "rank", "row.method", "confidence", "row.url", "row.svg", "row.format", "row.label")


def name_from_logos(ranked: DataFrame, homes: DataFrame) -> DataFrame:
    """page_id and name: the label of the best logo on the page itself that could be the brand's name."""
    own = ranked.where(F.col("method").isin("inline-svg", "header-img") & (F.col("label") != "")).join(homes.select("page_id", urls.host(F.col("url")).alias("host")), "page_id")
    told = own.withColumn("name", labels.without_label_words(F.col("label"))).where(labels.could_be_name(F.col("name"), F.col("host")))
    return told.groupBy("page_id").agg(F.min_by("name", "rank").alias("name"))
