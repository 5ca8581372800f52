"""DuckDB SQL for the rows of the registered queries, written independently of the operators."""

INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_SINGLE, _DOUBLE = "\u2018\u2019\u201a\u201b\u2032", "\u201c\u201d\u201e\u201f\u2033"
ADDRESS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"
_CODES = "'de fr es it pt nl sv da no nb fi pl cs sk ru ja ko zh tr ar he hu ro el id th vi bg hr sl lt lv et ms hi'"
_DB_UNSPACED = (
    r"[\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
    r"\x{f900}-\x{faff}\x{ff66}-\x{ff9f}\x{20000}-\x{3134f}]"
)
_SPACE = r"[\s\x{0b}\x{85}\p{Z}]+"


def _hex(value: str) -> str:
    return f"('#' || upper(substr(md5(CAST({value} AS VARCHAR)), 1, 6)))"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'))"


def _decoded(x: str) -> str:
    for name, char in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def _host(url: str) -> str:
    return f"lower(regexp_extract({url}, '{ADDRESS}', 2))"


def _path(url: str) -> str:
    return f"regexp_extract({url}, '{ADDRESS}', 3)"


def _dot(x: float, y: float, z: float) -> str:
    return f"(0.0::DOUBLE + c[1] * {x}::DOUBLE + c[2] * {y}::DOUBLE + c[3] * {z}::DOUBLE)"


def _colours(source: str) -> str:
    """CTEs that end in lab(hex, lum, l, a, b) for the column hex of source."""
    bend = "CASE WHEN t > (6.0::DOUBLE / 29) * (6.0::DOUBLE / 29) * (6.0::DOUBLE / 29) THEN pow(t, 1.0::DOUBLE / 3) ELSE t / (3 * (6.0::DOUBLE / 29) * (6.0::DOUBLE / 29)) + 4.0::DOUBLE / 29 END"
    return f"""
chan AS (SELECT DISTINCT hex, list_transform([2, 4, 6], lambda k: CAST(CAST('0x' || substr(hex, k, 2) AS INT) AS DOUBLE) / 255) AS v FROM {source}),
lin AS (SELECT hex, list_transform(v, lambda x: CASE WHEN x <= 0.04045 THEN x / 12.92::DOUBLE ELSE pow((x + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END) AS c FROM chan),
xyz AS (SELECT hex, {_dot(0.2126, 0.7152, 0.0722)} AS lum, list_transform([{_dot(0.4124, 0.3576, 0.1805)} / 0.95047::DOUBLE, {_dot(0.2126, 0.7152, 0.0722)}, {_dot(0.0193, 0.1192, 0.9505)} / 1.08883::DOUBLE], lambda t: {bend}) AS f FROM lin),
lab AS (SELECT hex, lum, 116 * f[2] - 16 AS l, 500 * (f[1] - f[2]) AS a, 200 * (f[2] - f[3]) AS b FROM xyz)"""


_CONTRAST = f"""
WITH src AS (SELECT p_partkey // 16 AS site_id, p_partkey % 2 AS half, {_hex("p_partkey")} AS hex FROM part),
{_colours("src")},
side AS (SELECT DISTINCT site_id, half, hex, lum FROM src JOIN lab USING (hex)),
r AS (
  SELECT f.site_id, f.hex AS fg, b.hex AS bg, (greatest(f.lum, b.lum) + 0.05::DOUBLE) / (least(f.lum, b.lum) + 0.05::DOUBLE) AS x
  FROM side f JOIN side b ON f.site_id = b.site_id AND f.half = 0 AND b.half = 1 AND f.hex <> b.hex),
pairs AS (
  SELECT site_id, fg, bg, floor(x * 100) / 100 AS ratio,
         CASE WHEN x >= 7 THEN 'AAA' WHEN x >= 4.5 THEN 'AA' WHEN x >= 3 THEN 'AA-large' ELSE 'fail' END AS level
  FROM r)
"""

_ELEMENTS = f"""
e AS (
  SELECT l_suppkey AS site_id, l_orderkey * 10 + l_linenumber AS pos,
         (['heading', 'link', 'button', 'box', 'text'])[CAST(l_orderkey % 5 AS INT) + 1] AS kind,
         (['header', 'main', 'footer', 'nav', 'page'])[CAST(l_partkey % 5 AS INT) + 1] AS region,
         l_partkey % 3 AS x, CAST(l_orderkey % 4 * 800 AS DOUBLE) AS y, l_quantity * 4 AS w, CAST(l_linenumber * 20 AS DOUBLE) AS h,
         CAST(round(l_tax * 100) AS INT) AS chars, CAST(10 + l_orderkey % 30 AS DOUBLE) AS size, {_hex("l_partkey % 24")} AS color,
         l_orderkey % 2 = 0 AS on_white, CASE WHEN l_partkey % 3 = 0 THEN {_hex("l_orderkey % 16")} END AS bg,
         CASE WHEN l_partkey % 4 = 0 THEN {_hex("l_orderkey % 12")} END AS border, l_linestatus = 'F' AND l_partkey % 7 = 0 AS promo,
         l_returnflag = 'R' AS on_image, 'Face ' || (l_partkey % 6) AS family, (l_orderkey % 9 + 1) * 100 AS weight,
         CASE WHEN l_orderkey % 4 * 800 < 900 THEN 1.0::DOUBLE WHEN l_orderkey % 4 * 800 < 2700 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS place
  FROM lineitem)"""

_USES = f"""
WITH {_ELEMENTS},
k AS (SELECT *, kind = 'button' AND w < 40 AND NOT promo AS icon, kind = 'button' AND w >= 40 AND NOT promo AS button FROM e WHERE w >= 1 AND h >= 1),
rows AS (
  SELECT site_id, pos, color AS hex,
         CASE WHEN promo THEN 'sale or deal text' WHEN kind = 'button' THEN 'button text' WHEN kind = 'heading' THEN 'heading text'
              WHEN region IN ('header', 'nav') THEN 'navigation text' WHEN region = 'footer' THEN 'footer text'
              WHEN kind = 'link' THEN 'link text' ELSE 'body text' END AS label,
         least(chars * greatest(size, 8) / 16, 150) * place * CASE WHEN kind = 'heading' THEN 1.5 ELSE 1.0 END AS weight,
         NOT promo AND NOT on_image AND on_white AS on_page, kind = 'link' AND region = 'main' AS linked, false AS button
  FROM k WHERE chars > 0
  UNION ALL
  SELECT site_id, pos, bg,
         CASE WHEN promo THEN 'sale or deal badge' WHEN kind = 'button' AND w >= 40 THEN 'button background' WHEN kind = 'button' THEN 'icon background'
              WHEN region = 'page' THEN 'page background' WHEN region = 'header' THEN 'header background' WHEN region = 'nav' THEN 'navigation background'
              WHEN region = 'footer' THEN 'footer background' ELSE 'section background' END,
         sqrt(w * least(h, 1800)) * place * CASE WHEN button THEN 3 ELSE 1 END, false, false, button
  FROM k WHERE bg IS NOT NULL
  UNION ALL
  SELECT site_id, pos, border, CASE WHEN button THEN 'button border' WHEN icon THEN 'icon border' ELSE 'border' END,
         (w + h) / 10 * place * CASE WHEN button THEN 3 ELSE 1 END, false, false, button
  FROM k WHERE border IS NOT NULL)
"""

_LINES = f"""
WITH s AS (
  SELECT source AS site_id, doc_id AS ord, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_squeeze("x")}), lambda x: x <> '') AS ls FROM documents),
each AS (SELECT site_id, ord, i - 1 AS line_no, ls[i] AS line FROM s, unnest(range(1, len(ls) + 1)) AS r(i)),
firsts AS (
  SELECT site_id, lower(line) AS key, min(struct_pack(ord := ord, line_no := line_no, line := line)) AS f FROM each GROUP BY ALL),
fl AS (SELECT site_id, f.ord AS ord, f.line_no AS line_no, f.line AS line FROM firsts)
"""


def _normal(x: str) -> str:
    plain = "''" * len(_SINGLE) + '"' * len(_DOUBLE)
    return _squeeze(f"translate(translate(nfc_normalize({x}), '{_SINGLE}{_DOUBLE}', '{plain}'), '{INVISIBLE}', '')")


_BULLET = r"^\s*(?:#{1,6}\s+|(?:>\s?)+|[-*+]\s+|[0-9]{1,3}[.)]\s+)"


def _whole(text: str, wanted: str) -> str:
    return rf"""(contains({text}, {wanted}) AND regexp_matches({text},
      CASE WHEN regexp_matches({wanted}, '^[\p{{L}}\p{{N}}]') THEN '(?:^|[^\p{{L}}\p{{N}}])' ELSE '' END || regexp_escape({wanted}) ||
      CASE WHEN regexp_matches({wanted}, '[\p{{L}}\p{{N}}]$') THEN '(?:$|[^\p{{L}}\p{{N}}])' ELSE '' END))"""


_QUOTES = rf"""
WITH b AS (SELECT item_id, string_split(text, chr(10)) AS ls FROM benchmark),
q AS (SELECT item_id || '.' || (i - 1) AS item, item_id, ls[i] AS quote FROM b, unnest(range(1, len(ls) + 1)) AS r(i)),
n AS (
  SELECT item, item_id, quote, trim(regexp_replace({_normal("quote")}, '^(?:"(.*)"|''(.*)'')$', '\1\2')) AS wanted FROM q),
c AS (SELECT *, len(list_filter(string_split({_squeeze("wanted")}, ' '), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]'))) AS words FROM n),
dl AS (
  SELECT doc_id, unnest(list_transform(string_split(translate(text, '{INVISIBLE}', ''), chr(10)), lambda x: {_normal(f"regexp_replace(x, '{_BULLET}', '')")})) AS line
  FROM documents),
f AS (
  SELECT item, arg_min(doc_id, (CASE WHEN doc_id = item_id THEN 0 ELSE 1 END) * 1000000000000 + doc_id) AS doc_id
  FROM c JOIN dl ON words >= 3 AND ({_whole("line", "wanted")} OR (ends_with(wanted, '.') AND {_whole("line", "regexp_replace(wanted, '[.]$', '')")}))
  GROUP BY item),
checked AS (SELECT c.item, CAST(words AS BIGINT) AS words, CASE WHEN f.doc_id IS NOT NULL THEN 'https://s/doc/' || f.doc_id END AS found_url FROM c LEFT JOIN f USING (item))
"""


def _export(open_: str, colour: str, font: str) -> str:
    return f"""
SELECT c_custkey AS site_id, '/* ' || c_name || ' */' || chr(10) || '{open_} {{' || chr(10)
  || '  --{colour}-background: ' || {_hex("c_custkey")} || '; /*  */' || chr(10) || '  --{colour}-primary: ' || {_hex("c_custkey + 1")} || '; /*  */' || chr(10)
  || '  --{font}-body: "' || c_mktsegment || '", serif;' || chr(10) || '}}' || chr(10) AS content
FROM customer
"""


def _token(role: str, value: str) -> str:
    channel = lambda at: f"CAST(round(CAST('0x' || substr({value}, {at}, 2) AS INT) / 255.0::DOUBLE, 4) AS VARCHAR)"
    return f"""'"{role}":{{"$type":"color","$value":{{"colorSpace":"srgb","components":[' || {channel(2)} || ',' || {channel(4)} || ',' || {channel(6)} || '],"hex":"' || lower({value}) || '"}}}}'"""


ORACLES = {
    "contrast_matrix": _CONTRAST + "SELECT * FROM pairs",
    "contrast_summary": _CONTRAST + """SELECT site_id, count(*) FILTER (level IN ('AA', 'AAA')) AS passes, count(*) FILTER (level = 'AA-large') AS large_only,
       count(*) FILTER (level = 'fail') AS fails FROM pairs GROUP BY site_id""",
    "contrast_pivot": _CONTRAST + """SELECT fg, count(*) FILTER (level = 'AAA') AS aaa, count(*) FILTER (level = 'AA') AS aa,
       count(*) FILTER (level = 'AA-large') AS aa_large, count(*) FILTER (level = 'fail') AS fail FROM pairs GROUP BY fg""",
    "color_lab": f"""WITH src AS (SELECT p_partkey, {_hex("p_partkey")} AS hex FROM part), {_colours("src")}
SELECT p_partkey, hex, round(l, 4) AS l, round(a, 4) AS a, round(b, 4) AS b, round(sqrt(a * a + b * b), 4) AS chroma FROM src JOIN lab USING (hex)""",
    "color_nearest": f"""WITH p AS (SELECT DISTINCT {_hex("p_partkey")} AS hex FROM part),
s AS (SELECT DISTINCT {_hex("s_suppkey")} AS hex FROM supplier), src AS (SELECT hex FROM p UNION SELECT hex FROM s), {_colours("src")},
d AS (
  SELECT x.hex, y.hex AS near, round(sqrt((x.l - y.l) * (x.l - y.l) + (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)), 9) AS de
  FROM p JOIN lab x USING (hex) CROSS JOIN s JOIN lab y ON y.hex = s.hex)
SELECT hex, near, round(de, 4) AS de FROM d QUALIFY row_number() OVER (PARTITION BY hex ORDER BY de, near) = 1""",
    "stacked_copies": f"""WITH {_ELEMENTS},
n AS (SELECT *, row_number() OVER (PARTITION BY site_id, x, y, w, h, chars ORDER BY pos DESC) AS n FROM e)
SELECT site_id, count(*) AS kept, CAST(sum(pos) AS BIGINT) AS pos_sum FROM n WHERE chars <= 0 OR n = 1 GROUP BY site_id""",
    "colour_uses": _USES + """SELECT site_id, hex, label, round(sum(weight) + 1e-7, 3) AS weight, round(sum(CASE WHEN on_page THEN weight ELSE 0 END) + 1e-7, 3) AS text_on_page,
       round(sum(CASE WHEN on_page AND linked THEN weight ELSE 0 END) + 1e-7, 3) AS links, count(*) AS elements, count(*) FILTER (button) AS buttons, min(pos) AS first_pos
FROM rows GROUP BY ALL""",
    "typography_by_role": f"""WITH {_ELEMENTS},
t AS (
  SELECT site_id, family, weight, size, CASE WHEN pos % 3 = 0 THEN 'Arial,sans-serif' ELSE 'serif' END AS rest,
         CASE WHEN kind = 'heading' OR (size >= 28 AND chars <= 200) THEN 'heading'
              WHEN kind = 'button' OR (kind = 'link' AND region IN ('header', 'nav')) THEN 'ui' ELSE 'body' END AS role,
         least(chars, 300) * place * CASE WHEN region = 'footer' THEN 0.5 ELSE 1.0 END AS amount
  FROM e WHERE chars > 0),
f AS (SELECT site_id, role, family, count(*) AS elements FROM t GROUP BY site_id, role, family QUALIFY row_number() OVER (PARTITION BY site_id, role ORDER BY round(sum(amount), 6) DESC, family) = 1),
w AS (SELECT site_id, role, family, weight FROM t GROUP BY site_id, role, family, weight QUALIFY row_number() OVER (PARTITION BY site_id, role, family ORDER BY round(sum(amount), 6) DESC, weight) <= 4),
z AS (SELECT site_id, role, family, size FROM t GROUP BY site_id, role, family, size QUALIFY row_number() OVER (PARTITION BY site_id, role, family ORDER BY round(sum(amount), 6) DESC, size) <= 6),
r AS (SELECT site_id, role, family, rest AS fallbacks FROM t GROUP BY site_id, role, family, rest QUALIFY row_number() OVER (PARTITION BY site_id, role, family ORDER BY count(*) DESC, rest) = 1),
wl AS (SELECT site_id, role, family, string_agg(CAST(weight AS VARCHAR), ',' ORDER BY weight) AS weights FROM w GROUP BY ALL),
zl AS (SELECT site_id, role, family, string_agg(CAST(CAST(size AS INT) AS VARCHAR), ',' ORDER BY size DESC) AS sizes FROM z GROUP BY ALL)
SELECT site_id, role, family, elements, weights, sizes, fallbacks FROM f JOIN wl USING (site_id, role, family) JOIN zl USING (site_id, role, family) JOIN r USING (site_id, role, family)""",
    "first_screen_shares": f"""WITH c AS (
  SELECT o_custkey % 50 AS site_id, CASE WHEN o_orderstatus <> 'P' THEN {_hex("o_orderkey % 9")} END AS hex, count(*) AS count FROM orders GROUP BY ALL)
SELECT site_id, hex, count, round(count / CAST(sum(count) OVER (PARTITION BY site_id) AS DOUBLE), 3) AS share FROM c""",
    "site_domain_rollup": f"""WITH h AS (SELECT {_host("url")} AS host FROM pages), d AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM h)
SELECT domain, count(*) AS pages, count(DISTINCT host) AS hosts, min(split_part(domain, '.', 1)) AS label FROM d GROUP BY domain""",
    "page_key_dedupe": rf"""SELECT regexp_replace({_host("url")}, '^www\.', '') || lower(regexp_replace({_path("url")}, '/+$', '')) AS key, min(page_id) AS page_id, count(*) AS copies
FROM pages GROUP BY 1""",
    "page_titles": rf"""SELECT page_id, nullif({_squeeze(_decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, '') AS title,
       nullif(lower(regexp_extract(html, '(?i)<html[^>]*\slang=["'']?([A-Za-z-]+)', 1)), '') AS language FROM pages""",
    "page_links": rf"""WITH x AS (
  SELECT page_id, url AS base, regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS hs,
         regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS ts FROM pages),
y AS (SELECT page_id, base, CAST(i - 1 AS INT) AS pos, hs[i] AS href, ts[i] AS inside, regexp_replace(trim(hs[i]), '#.*$', '') AS bare FROM x, unnest(range(1, len(hs) + 1)) AS r(i)),
z AS (
  SELECT page_id, pos, href, substring({_squeeze("regexp_replace(inside, '(?s)<[^>]*>', ' ', 'g')")}, 1, 120) AS text,
         CASE WHEN regexp_matches(bare, '^(?i)https?://') THEN bare
              WHEN starts_with(bare, '//') THEN lower(regexp_extract(base, '{ADDRESS}', 1)) || ':' || bare
              WHEN starts_with(bare, '/') THEN lower(regexp_extract(base, '{ADDRESS}', 1)) || '://' || {_host("base")} || bare END AS url
  FROM y)
SELECT page_id, pos, href, url, text FROM z WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1""",
    "page_text": rf"""SELECT page_id, {_squeeze(_decoded(r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"))} AS text FROM pages""",
    "page_locale_filter": f"""WITH p AS (SELECT page_id, list_filter(string_split({_path("url")}, '/'), lambda x: x <> '') AS parts FROM pages),
q AS (SELECT page_id, replace(lower(parts[1]), '_', '-') AS one, lower(parts[2]) AS two FROM p)
SELECT page_id, CASE WHEN one IS NULL OR NOT regexp_full_match(one, '[a-z][a-z](-[a-z][a-z])?') THEN false
  WHEN contains(one, '-') THEN split_part(one, '-', 1) <> 'en' WHEN regexp_full_match(coalesce(two, ''), '[a-z][a-z]') THEN two <> 'en' AND one <> 'en'
  ELSE list_contains(string_split({_CODES}, ' '), one) END AS other_language FROM q""",
    "choose_pages_topk": rf"""WITH l AS (
  SELECT page_id AS pos, {_host("url")} AS host, page_id % 2 = 0 AS deep, page_id % 3 = 0 AS top, page_id % 5 = 0 AS link,
         (['about', 'careers', 'newsroom', 'blog', 'pricing', 'products', 'our-story', 'jobs', 'logos', 'login', 'tea', 'a.pdf'])[CAST(page_id % 12 AS INT) + 1] AS word,
         (['', 'about', 'careers', 'mission', 'brand', 'press', 'pricing'])[CAST(page_id % 7 AS INT) + 1] AS said FROM pages),
k AS (
  SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS site_id, CASE WHEN deep THEN '/en/' ELSE '/' END || word AS path,
         CASE WHEN word IN ('about', 'our-story') THEN 'about' WHEN word IN ('careers', 'jobs') THEN 'careers' WHEN word = 'newsroom' THEN 'press'
              WHEN word IN ('blog', 'pricing') THEN word WHEN word = 'products' THEN 'product' WHEN word = 'logos' THEN 'brand' ELSE '' END AS named,
         CASE WHEN split_part(host, '.', 1) = 'blog' THEN 'blog' ELSE '' END AS sub FROM l),
kinds(i, kind, value) AS (VALUES (0, 'brand', 10), (1, 'about', 9), (2, 'mission', 8), (3, 'product', 6), (4, 'careers', 5), (5, 'press', 5), (6, 'blog', 4), (7, 'pricing', 3)),
e AS (
  SELECT k.*, i, kind, value,
         CASE WHEN named = kind OR sub = kind THEN 3 ELSE 0 END + CASE WHEN named = kind THEN 1 ELSE 0 END + CASE WHEN said = kind OR (said = 'brand' AND kind = 'press') THEN 2 ELSE 0 END
           + CASE WHEN kind = 'press' AND word = 'newsroom' THEN 1 ELSE 0 END AS points,
         value + (CASE WHEN named = kind THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN sub = kind THEN 2 ELSE 0 END + CASE WHEN said = kind OR (said = 'brand' AND kind = 'press') THEN 1 ELSE 0 END
           + CASE WHEN kind = 'press' AND word = 'newsroom' THEN 2 ELSE 0 END) AS match
  FROM k CROSS JOIN kinds WHERE word NOT IN ('login', 'a.pdf')),
s AS (
  SELECT *, match + CASE WHEN top THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END - 0.6::DOUBLE * CASE WHEN deep THEN 1 ELSE 0 END AS score,
         regexp_replace(host, '^www\.', '') || path AS key
  FROM e WHERE points > 0 AND regexp_replace(host, '^www\.', '') || path <> site_id || '/en/about' QUALIFY row_number() OVER (PARTITION BY pos ORDER BY points DESC, i) = 1),
o AS (
  SELECT *, row_number() OVER (PARTITION BY site_id, key ORDER BY score DESC, pos) AS n, min(pos) OVER (PARTITION BY site_id, key) AS first_pos,
         bool_or(link) OVER (PARTITION BY site_id, key) AS any_link FROM s),
c AS (SELECT * FROM o WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY site_id, kind ORDER BY score DESC, first_pos) <= CASE WHEN kind IN ('about', 'mission') THEN 2 ELSE 1 END),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, first_pos) AS rank FROM c)
SELECT site_id, rank, 'https://' || host || path AS url, kind, CASE WHEN any_link THEN 'link' ELSE 'search' END AS origin, round(score, 4) AS score FROM r WHERE rank <= 9""",
    "official_site_rank": """WITH r AS (
  SELECT s.s_suppkey AS query_id, s.s_suppkey % 15 = 0 AS wiki, s.s_suppkey % 40 AS n, o.s_suppkey AS o, o.s_suppkey % 6 = 0 AS there, o.s_suppkey % 40 AS m
  FROM supplier s JOIN supplier o USING (s_nationkey)),
m AS (
  SELECT *, CASE WHEN wiki THEN CASE WHEN there THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN n = m THEN 1.0::DOUBLE
              WHEN contains('brand' || m, 'brand' || n) OR contains('brand' || n, 'brand' || m) THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END AS x
  FROM r WHERE wiki OR NOT there),
s AS (
  SELECT *, 10 * x - 0.3::DOUBLE * (o + 1) - CASE WHEN o % 4 = 0 AND NOT there THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN o % 2 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS score,
         CASE WHEN there THEN 'www.wikipedia.org' ELSE CASE WHEN o % 4 = 0 THEN 'shop.' ELSE 'www.' END || 'brand' || m || '.com' END AS host FROM m)
SELECT query_id, 'https://' || host || '/' AS url, host, round(score, 4) AS score, x >= 0.7 AS name_matches
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY wiki AND there DESC, score DESC, o) = 1""",
    "line_dedupe": _LINES + "SELECT site_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM fl GROUP BY site_id",
    "excerpt_budget": _LINES + """, u AS (SELECT site_id, ord, line_no, CAST(sum(length(line) + 1) OVER (PARTITION BY site_id ORDER BY ord, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM fl)
SELECT * FROM u WHERE used <= 5000""",
    "word_count": rf"""SELECT doc_id, CAST(len(list_filter(string_split({_squeeze(f"regexp_replace(text, '{_DB_UNSPACED}', ' ', 'g')")}, ' '), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')))
       + len(regexp_extract_all(text, '{_DB_UNSPACED}')) // 2 AS BIGINT) AS words FROM documents""",
    "normalise_text": f"SELECT doc_id, md5({_normal('text')}) AS digest FROM documents",
    "quote_check": _QUOTES + "SELECT item, words, found_url FROM checked",
    "quote_summary": _QUOTES + "SELECT 1 AS site_id, count(*) AS checked, count(found_url) AS verified FROM checked",
    "unquoted_anti": _QUOTES + "SELECT item FROM checked WHERE found_url IS NULL",
    "mentions_semi": rf"""
WITH b AS (SELECT item_id, string_split(text, chr(10)) AS ls FROM benchmark),
p AS (SELECT item_id || '.' || (i - 1) AS item, lower({_normal("ls[i]")}) AS wanted FROM b, unnest(range(1, len(ls) + 1)) AS r(i)),
dl AS (SELECT DISTINCT unnest(list_transform(string_split(translate(text, '{INVISIBLE}', ''), chr(10)), lambda x: lower({_normal(f"regexp_replace(x, '{_BULLET}', '')")}))) AS line FROM documents),
c AS MATERIALIZED (SELECT item, wanted, line FROM p JOIN dl ON contains(line, wanted))
SELECT DISTINCT item FROM c WHERE {_whole("line", "wanted")}""",
    "numbered_names": """WITH n AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey, p_name, CASE WHEN n = 1 THEN p_name ELSE p_name || '-' || n END AS numbered FROM n""",
    "prompt_build": r"""SELECT conv_id AS site_id, 'Brand: A &amp; B (a.com)' || chr(10) || chr(10) || string_agg(
  '<page url="https://c/' || turn || '" type="' || upper(role[1]) || lower(role[2:]) || '">' || chr(10) || regexp_replace(text, '(?i)<(/?\s*page)', '&lt;\1', 'g') || chr(10) || '</page>' || chr(10), chr(10) ORDER BY turn) || chr(10) || 'Describe this brand’s tone of voice and key messages from these pages, as instructed.' AS prompt
FROM conversations GROUP BY conv_id""",
    "job_state_latest": "SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS status, max(ts) AS at FROM events GROUP BY user_id",
    "job_steps_pivot": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{s}') AS {s}" for s in ("view", "click", "signup", "purchase", "error")) + " FROM events GROUP BY user_id",
    "reuse_asof_24h": """WITH r AS (SELECT user_id, event_id, ts FROM events WHERE event_type <> 'signup'), m AS (SELECT user_id, event_id AS made, ts AS at FROM events WHERE event_type = 'signup')
SELECT r.user_id AS key, r.event_id AS request_id, CASE WHEN r.ts < m.at + INTERVAL 24 HOUR THEN made END AS reused_id
FROM r ASOF LEFT JOIN m ON r.user_id = m.user_id AND r.ts >= m.at""",
    "daily_limit": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, n <= 2 AS allowed, CAST(CASE WHEN n <= 2 THEN 0 ELSE epoch(CAST(ts AS DATE) + INTERVAL 1 DAY) - floor(epoch(ts)) END AS BIGINT) AS wait_s FROM n""",
    "usage_cost": """SELECT o_orderkey, round((o_orderkey % 10000 * CASE o_orderpriority WHEN '1-URGENT' THEN 3.0::DOUBLE WHEN '2-HIGH' THEN 0.5::DOUBLE WHEN '5-LOW' THEN 0.1::DOUBLE END
  + o_custkey % 3000 * CASE o_orderpriority WHEN '1-URGENT' THEN 15.0::DOUBLE WHEN '2-HIGH' THEN 2.0::DOUBLE WHEN '5-LOW' THEN 0.4::DOUBLE END) / 1e6 + 1e-9, 6) AS cost FROM orders""",
    "fallback_answer": """WITH a AS (
  SELECT l_orderkey AS job_id, l_linenumber * 100000 + l_partkey AS ord, min(l_quantity) AS seconds, bool_or(l_returnflag = 'A') AS ok, min(l_partkey) AS answer, min(l_linestatus) AS reason
  FROM lineitem GROUP BY ALL),
e AS (SELECT *, sum(seconds) OVER (PARTITION BY job_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS elapsed FROM a)
SELECT job_id, arg_min(answer, ord) FILTER (ok AND elapsed <= 60) AS answer, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason) FILTER (NOT ok), '') AS reasons FROM e GROUP BY job_id""",
    "retention_filter": "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-18 00:00:00'",
    "lru_finished": "SELECT user_id, max(event_id) AS last_id FROM events GROUP BY user_id ORDER BY last_id DESC LIMIT 100",
    "set_ops_links": f"""WITH p AS (SELECT {_host("url")} AS host, (list_filter(string_split({_path("url")}, '/'), lambda x: x <> ''))[1] AS lang FROM pages),
en AS (SELECT DISTINCT host FROM p WHERE lang = 'en'), fr AS (SELECT DISTINCT host FROM p WHERE lang = 'fr')
SELECT 'union' AS op, host FROM (FROM en UNION FROM fr) UNION ALL SELECT 'intersect', host FROM en WHERE host IN (FROM fr) UNION ALL SELECT 'except', host FROM en WHERE host NOT IN (FROM fr)""",
    "scale_labels": """WITH v AS (SELECT p_partkey, greatest(0, least(100, p_size * 4 - 50)) AS value FROM part)
SELECT p_partkey, value, CASE WHEN value <= 15 THEN 'strongly left' WHEN value <= 35 THEN 'leans left' WHEN value >= 85 THEN 'strongly right' WHEN value >= 65 THEN 'leans right' ELSE 'balanced' END AS lean,
  CASE WHEN value >= 80 THEN 'high' WHEN value >= 50 THEN 'medium' ELSE 'low' END AS confidence FROM v""",
    "merged_reads": """WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, source, lang, md5(text) AS t FROM documents)
SELECT doc_id AS site_id, CASE WHEN source = 'src2' OR title = '' THEN 'structure ' || title ELSE title END AS title, source AS description,
  lang AS language, CASE WHEN source = 'src2' THEN '' ELSE t END AS text FROM d""",
    "export_css": _export(":root", "color", "font"),
    "export_tailwind": _export("@theme", "color-brand", "font-brand"),
    "export_voice": r"""SELECT c_custkey AS site_id, CASE WHEN c_custkey % 2 = 0 THEN '# Write like ' || replace(c_name, '#', '\#') || chr(10) || chr(10) || '## Tone of voice' || chr(10) || chr(10)
  || '- **Plain**: ' || c_mktsegment || chr(10) || '  > we \*make\* it' || chr(10) END AS content FROM customer""",
    "export_tokens": f"""WITH c AS (SELECT *, {_hex("c_custkey")} AS h0, {_hex("c_custkey + 1")} AS h1 FROM customer)
SELECT c_custkey AS site_id, lower(replace(c_name, '#', '-')) || '.tokens.json' AS file_name,
  '{{"color":{{' || {_token("background", "h0")} || ',' || {_token("primary", "h1")} || '}},"font":{{"body":{{"$type":"fontFamily","$value":["' || c_mktsegment || '"]}}}}}}' AS content FROM c""",
}
