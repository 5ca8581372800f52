"""DuckDB SQL for the queries on the element tree: parents by a recursive query over tags, images by what stands before them."""

from lumenloom.plans.oracles import ORACLES, _colours, _hex, _host

_TAG_REST = """(?:[^''">]|"[^"]*"|''[^'']*'')*"""
_TOKEN = rf"(?is)<!--.*?-->|<(?:script|style|textarea|title)(?:\s{_TAG_REST})?>.*?</(?:script|style|textarea|title)\s*>|</?[a-z]{_TAG_REST}>|<[!?/][^>]*>|[^<]+|<"
#: One step for each tag: how many open elements stay open, then the new stack. Rules for the elements that these pages have.
_NODES = rf"""
WITH RECURSIVE tok AS (SELECT page_id, regexp_extract_all(html, '{_TOKEN}') AS ts FROM pages),
one AS (SELECT page_id, len(ts) AS total, i - 1 AS place, ts[i] AS t FROM tok, unnest(range(1, len(ts) + 1)) AS r(i)),
tags AS (
  SELECT page_id, total, place, lower(regexp_extract(t, '^</?([A-Za-z][^\s/>]*)', 1)) AS tag, starts_with(t, '</') AS shuts, nullif(regexp_extract(t, '(?is)^<[^>]*?\shref="([^"]*)"', 1), '') AS href
  FROM one WHERE regexp_matches(t, '^</?[A-Za-z]')),
m AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS k, sum(CASE WHEN shuts THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY place) - 1 AS n,
         tag IN ('br', 'meta', 'script', 'style', 'title', 'img', 'link', 'hr', 'input') AS hollow
  FROM tags WHERE NOT (shuts AND tag IN ('html', 'body', 'br'))),
walk AS (
  SELECT page_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS names, CAST([] AS BIGINT[]) AS ns, CAST(0 AS BIGINT) AS kept FROM (SELECT DISTINCT page_id FROM m)
  UNION ALL
  SELECT page_id, k, CASE WHEN shuts OR hollow THEN names[:kept] ELSE list_append(names[:kept], tag) END, CASE WHEN shuts OR hollow THEN ns[:kept] ELSE list_append(ns[:kept], n) END, kept
  FROM (
    SELECT m.page_id, m.k, m.tag, m.shuts, m.hollow, CAST(m.n AS BIGINT) AS n, w.names, w.ns, CAST(CASE
        WHEN m.shuts THEN CASE WHEN list_contains(w.names, m.tag) THEN len(w.names) - list_position(list_reverse(w.names), m.tag) ELSE len(w.names) END
        WHEN m.tag = 'a' AND list_contains(w.names, 'a') THEN list_position(w.names, 'a') - 1
        WHEN m.tag = 'li' AND list_contains(w.names, 'li') AND list_position(list_reverse(w.names), 'li') < coalesce(list_position(list_reverse(w.names), 'ul'), 1000000) THEN len(w.names) - list_position(list_reverse(w.names), 'li')
        WHEN m.tag IN ('p', 'div', 'article', 'h1', 'ul', 'nav', 'footer', 'li') AND list_contains(w.names, 'p') THEN list_position(w.names, 'p') - 1
        ELSE len(w.names) END AS BIGINT) AS kept
    FROM walk w JOIN m ON m.page_id = w.page_id AND m.k = w.k + 1)),
opened AS (SELECT m.page_id, m.n, m.place, m.total, m.tag, m.href, m.hollow, m.k, w.kept AS depth, w.ns FROM m JOIN walk w USING (page_id, k) WHERE NOT m.shuts),
shut AS (SELECT o.page_id, o.n, min(m.place) AS place FROM opened o JOIN m ON m.page_id = o.page_id AND m.k > o.k JOIN walk w ON w.page_id = m.page_id AND w.k = m.k WHERE NOT o.hollow AND NOT list_contains(w.ns, o.n) GROUP BY ALL)
SELECT o.page_id, CAST(o.n AS INT) AS n, CAST(o.place AS INT) AS "at", CAST(CASE WHEN hollow THEN o.place ELSE coalesce(s.place, total) END AS INT) AS "end", CAST(ns[depth] AS INT) AS parent, CAST(depth AS INT) AS depth, tag, href
FROM opened o LEFT JOIN shut s ON s.page_id = o.page_id AND s.n = o.n"""

_BEFORE = "split_part(html, 'href=\"' || href || '\"', 1)"


def _count(text: str, part: str) -> str:
    return f"(len(string_split({text}, '{part}')) - 1)"


_PUT = """
p AS (
  SELECT page_id, url, replace(replace(html, '<body>', '<body>' || CASE page_id % 6
      WHEN 0 THEN '<header><a href="/" aria-label="Example home"><svg viewBox="0 0 90 30"><path d="M0 0h' || page_id || 'v1"/></svg></a></header>'
      WHEN 1 THEN '<header class="top"><img class="logo" src="/img/' || page_id || '.png" alt="Example logo"></header>'
      WHEN 2 THEN '<section class="clients"><img class="logo" src="/c/' || page_id || '.svg" alt="Osier Bank logo"><img src="/d/' || page_id || '.svg" alt="Example"></section>'
      WHEN 3 THEN '<header><img class="logo" src="/o.png" alt="Osier Bank logo"><img src="/sale-banner.png" class="logo" alt="Sale"></header>'
      WHEN 4 THEN '<section><img src="/f/' || page_id || '.jpg" alt="Example logo"></section>'
      ELSE '<header><svg width="16" height="16" class="chevron"><path d="M0 0l8 8"/></svg><a href="/en-us/"><img src="/e/' || page_id || '.png"></a></header>' END),
    '<footer>', '<footer>' || CASE page_id % 4 WHEN 0 THEN '<img src="/f/' || page_id || '.jpg" alt="Example logo">' WHEN 1 THEN '<img class="logo" src="/g.webp">'
      WHEN 2 THEN '<img src="/tiny.png" class="logo" alt="Example" width="9">' ELSE '' END) AS html
  FROM pages WHERE html IS NOT NULL)"""

_DRAWINGS = f"""
g AS (
  SELECT p_partkey AS k, '<svg viewBox="0 0 90 9">' || CASE WHEN p_partkey % 3 = 0 THEN '<style>.b{{fill:red}} .a{{fill:' || {_hex("p_partkey")} || '}}</style>' ELSE '' END || '<path d="M0 0h' || p_partkey || '" class="a"'
    || CASE WHEN p_partkey % 2 = 0 THEN ' fill="' || {_hex("p_partkey + 1")} || '"' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ' style="fill:' || {_hex("p_partkey + 2")} || '"' ELSE '' END
    || CASE WHEN p_partkey % 7 = 0 THEN ' data-mark-paint="fill:' || {_hex("p_partkey + 3")} || '"' ELSE '' END || CASE WHEN p_partkey % 13 = 0 THEN ' visibility="hidden"' ELSE '' END
    || '/><g opacity="' || p_partkey % 4 || '"><rect width="4"' || CASE WHEN p_partkey % 6 = 0 THEN ' fill="none"' ELSE '' END || ' onload="x()"/></g></svg>' AS svg
  FROM part),
said AS (
  SELECT k, svg, regexp_extract(svg, '<path[^>]*>') AS path, regexp_extract(svg, '<rect[^>]*>') AS rect, CASE WHEN contains(svg, '<style>') THEN 2 ELSE 1 END AS n,
         [nullif(regexp_extract(svg, '<path[^>]* fill="([^"]*)"', 1), ''), nullif(regexp_extract(svg, '\\.a\\{{fill:([^}}]*)\\}}', 1), ''), nullif(regexp_extract(svg, ' style="fill:([^"]*)"', 1), ''), nullif(regexp_extract(svg, 'paint="fill:([^"]*)"', 1), '')] AS fills
  FROM g),
won AS (SELECT *, list_filter([3, 2, 1, 0], lambda i: fills[i + 1] IS NOT NULL)[1] AS layer FROM said)"""

_SCREEN = f"""
src AS (SELECT DISTINCT {_hex("p_partkey % 90")} AS hex FROM part UNION SELECT DISTINCT {_hex("p_partkey * 7 % 130")} FROM part), {_colours("src")},
held AS (SELECT s, h.hex, place, l, a, b FROM (SELECT p_partkey // 40 AS s, {_hex("p_partkey % 90")} AS hex, min(p_partkey) AS place FROM part GROUP BY ALL) h JOIN lab USING (hex)),
seen AS (SELECT s, x.hex, at_, n, l, a, b FROM (SELECT p_partkey // 40 AS s, {_hex("p_partkey * 7 % 130")} AS hex, min(p_partkey) AS at_, sum(p_partkey % 11 + 1) AS n FROM part GROUP BY ALL) x JOIN lab USING (hex)),
near AS (
  SELECT x.s, x.hex, h.hex AS twin, row_number() OVER (PARTITION BY x.s, x.hex ORDER BY CASE WHEN h.hex = x.hex THEN 0 ELSE 1 END, h.place) AS k
  FROM seen x JOIN held h ON h.s = x.s AND sqrt((x.l - h.l) * (x.l - h.l) + (x.a - h.a) * (x.a - h.a) + (x.b - h.b) * (x.b - h.b)) < 20),
rest AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY at_) AS k FROM seen ANTI JOIN near USING (s, hex))"""

PAGES = {
    "points_shared": f"""WITH RECURSIVE {_SCREEN},
g AS (
  SELECT s, 0::BIGINT AS k, CAST([] AS STRUCT(hex VARCHAR, l DOUBLE, a DOUBLE, b DOUBLE)[]) AS heads, '' AS hex, '' AS twin FROM (SELECT DISTINCT s FROM rest)
  UNION ALL
  SELECT s, k, CASE WHEN hit IS NULL THEN list_append(heads, {{'hex': hex, 'l': l, 'a': a, 'b': b}}) ELSE heads END, hex, coalesce(hit, hex)
  FROM (
    SELECT r.*, g.heads, list_filter(g.heads, lambda q: sqrt((r.l - q.l) * (r.l - q.l) + (r.a - q.a) * (r.a - q.a) + (r.b - q.b) * (r.b - q.b)) < 20)[1].hex AS hit
    FROM g JOIN rest r ON r.s = g.s AND r.k = g.k + 1)),
t AS (SELECT s, hex, twin FROM near WHERE k = 1 UNION ALL SELECT s, hex, twin FROM g WHERE k > 0),
p AS (SELECT s, twin AS hex, sum(n) AS points FROM t JOIN seen USING (s, hex) GROUP BY ALL)
SELECT s AS site_id, hex, CAST(points AS BIGINT) AS points, round(round(points / sum(points) OVER (PARTITION BY s), 3) + 1e-9, 3) AS share FROM p""",
    "logo_colours": f"""WITH {_SCREEN},
b AS (SELECT x.s, x.hex, twin FROM seen x LEFT JOIN (FROM near WHERE k = 1) n ON n.s = x.s AND n.hex = x.hex WHERE sqrt(x.a * x.a + x.b * x.b) >= 20.0)
SELECT s AS site_id, coalesce(twin, hex) AS hex, twin IS NULL AS only_in_logo, count(*) AS times FROM b GROUP BY ALL""",
    "svg_cascade": f"""WITH {_DRAWINGS},
e AS (
  FROM (SELECT k, 0 AS n, 'viewBox' AS name, '0 0 90 9' AS value, 0 AS layer FROM won) UNION ALL FROM (SELECT k, n, 'fill', fills[layer + 1], layer FROM won WHERE layer IS NOT NULL)
  UNION ALL FROM (SELECT k, n, unnest(['d', 'visibility']), unnest([regexp_extract(path, ' d="([^"]*)"', 1), nullif(regexp_extract(path, 'visibility="([^"]*)"', 1), '')]), 0 FROM won)
  UNION ALL FROM (SELECT k, n + 1, 'opacity', regexp_extract(svg, 'opacity="([^"]*)"', 1), 0 FROM won)
  UNION ALL FROM (SELECT k, n + 2, unnest(['width', 'fill']), unnest(['4', nullif(regexp_extract(rect, 'fill="([^"]*)"', 1), '')]), 0 FROM won))
SELECT k AS drawing_id, CAST(n AS INT) AS n, name, value, CAST(layer AS INT) AS layer FROM e WHERE value IS NOT NULL""",
    "svg_clean": f"""WITH {_DRAWINGS}
SELECT k AS drawing_id, CASE WHEN NOT contains(path, 'hidden') OR NOT (contains(svg, 'opacity="0"') OR contains(rect, 'none')) THEN
  '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 90 9" width="90" height="9"><path d="M0 0h' || k || '"' || CASE WHEN layer IS NULL THEN '' ELSE ' fill="' || fills[layer + 1] || '"' END
  || CASE WHEN contains(path, 'hidden') THEN ' visibility="hidden"' ELSE '' END || '></path><g opacity="' || regexp_extract(svg, 'opacity="([^"]*)"', 1) || '"><rect width="4"' || CASE WHEN contains(rect, 'none') THEN ' fill="none"' ELSE '' END || '></rect></g></svg>' END AS svg
FROM won""",
    "page_nodes": _NODES,
    "link_places": f"""SELECT l.page_id, l.url, l.text, CASE WHEN {_count(_BEFORE, "<footer>")} > {_count(_BEFORE, "</footer>")} THEN 'footer' WHEN {_count(_BEFORE, "<nav>")} > {_count(_BEFORE, "</nav>")} THEN 'top' ELSE 'other' END AS place
FROM ({ORACLES["page_links"]}) l JOIN pages USING (page_id)""",
    "page_logos": f"""WITH {_PUT},
x AS (SELECT page_id, html, regexp_extract(url, '^([a-z]+)://', 1) || '://' || {_host("url")} AS site, regexp_extract_all(html, '(?s)<img[^>]*>|<svg.*?</svg>') AS found, regexp_split_to_array(html, '(?s)<img[^>]*>|<svg.*?</svg>') AS rest FROM p),
i AS (SELECT page_id, site, k, found[k] AS t, array_to_string(rest[:k], '') AS before FROM x, unnest(range(1, len(found) + 1)) AS r(k)),
a AS (
  SELECT page_id, site, k, t, starts_with(t, '<svg') AS svg, regexp_extract(t, ' src="([^"]*)"', 1) AS src, regexp_extract(t, ' alt="([^"]*)"', 1) AS alt, regexp_extract(t, '^<[^>]* class="([^"]*)"', 1) AS class,
         TRY_CAST(regexp_extract(t, ' width="([0-9]+)"', 1) AS INT) AS width, {_count("before", "<header")} > {_count("before", "</header>")} AS top, {_count("before", "<footer>")} > {_count("before", "</footer>")} AS foot,
         CASE WHEN {_count("before", "<a ")} > {_count("before", "</a>")} THEN string_split(before, '<a ')[-1] END AS link
  FROM i),
w AS (
  SELECT *, concat_ws(' ', alt, class, src, regexp_extract(link, 'aria-label="([^"]*)"', 1)) AS said, regexp_extract(link, 'href="([^"]*)"', 1) AS href,
         CASE WHEN alt <> '' THEN alt ELSE coalesce(regexp_extract(link, 'aria-label="([^"]*)"', 1), '') END AS label FROM a WHERE coalesce(width, 99) >= 12),
n AS (SELECT *, lower(trim(regexp_replace(label, '(?i) *(logo|home)', '', 'g'))) AS name, coalesce(href IN ('/', '/en-us/'), false) AS home, regexp_matches(said, 'logo') AS logo, contains(lower(said), 'example') AS own FROM w),
c AS (
  SELECT *, CASE WHEN home THEN CASE WHEN logo OR own THEN 0.9 ELSE 0.8 END WHEN logo AND top THEN CASE WHEN own THEN 0.75 ELSE 0.7 END
              WHEN (logo AND contains(lower(alt || src), 'example')) OR lower(alt) = 'example' THEN CASE WHEN foot THEN 0.65 ELSE 0.6 END END AS confidence
  FROM n WHERE NOT (svg AND coalesce(width, 99) <= 24) AND (home OR NOT regexp_matches(lower(alt || src), '(sale|banner)')) AND (home OR name IN ('', 'example')))
SELECT page_id, CASE WHEN svg THEN 'inline-svg' ELSE 'header-img' END AS method, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN NOT svg THEN site || src END AS url,
       CASE WHEN svg THEN 'svg' ELSE string_split(src, '.')[-1] END AS format, label, CASE WHEN svg THEN CAST(length(t) AS INT) END AS drawn
FROM c WHERE confidence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, CASE WHEN svg THEN t ELSE src END ORDER BY confidence DESC, k) = 1""",
    "shapes_borrowed": """WITH RECURSIVE s AS (
  SELECT p_partkey AS k, p_partkey // 60 AS page_id, CASE WHEN p_partkey % 20 < 19 THEN p_partkey + 1 WHEN p_partkey // 20 % 4 = 1 THEN p_partkey - 5 WHEN p_partkey // 20 % 4 = 2 THEN -p_partkey END AS next FROM part),
w AS (
  SELECT page_id, k AS start, k, 0 AS step, next FROM s WHERE k % 60 % 10 = 3
  UNION ALL
  SELECT w.page_id, w.start, w.next, w.step + 1, s.next FROM w LEFT JOIN s ON s.k = w.next AND s.page_id = w.page_id WHERE w.next IS NOT NULL AND w.step < 60 AND (w.step = 0 OR EXISTS (FROM s x WHERE x.k = w.k AND x.page_id = w.page_id)))
SELECT w.page_id, start % 60 AS pos, CASE WHEN max(step) < 60 AND bool_and(EXISTS (FROM s x WHERE x.k = w.k AND x.page_id = w.page_id)) THEN string_agg('<g>' || k || '</g>', '' ORDER BY k) END AS shapes FROM w GROUP BY w.page_id, start""",
}
