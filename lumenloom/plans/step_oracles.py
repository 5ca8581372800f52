"""DuckDB SQL for checked measurements, enclosed areas and second searches; landed texts are read by its own JSON functions."""

from lumenloom.plans.oracles import ORACLES

_ITEM = """CASE l_partkey % 16
  WHEN 0 THEN '{"kind":"box","color":"red"}' WHEN 1 THEN '{"weight":400.5,"w":1}' WHEN 2 THEN '{"kind":"blob","color":"red"}' WHEN 3 THEN '7' WHEN 4 THEN '{"w":"wide"}'
  WHEN 5 THEN '{"w":" 12.5 ","weight":"700"}' WHEN 6 THEN '{"region":null}' WHEN 7 THEN '{"on_image":"perhaps"}'
  ELSE concat('{"kind":"', ['heading', 'link', 'button', 'box', 'text'][l_partkey % 5 + 1], '","w":', CAST(l_quantity AS INT), ',"color":"#', upper(md5(CAST(l_partkey AS VARCHAR))[1:6]), '","bg":null,"more":[1]}') END"""
_RAW = f"""
items AS (SELECT l_orderkey, string_agg(item, ',' ORDER BY l_linenumber, item) AS items FROM (SELECT l_orderkey, l_linenumber, {_ITEM} AS item FROM lineitem) GROUP BY l_orderkey),
whole AS (
  SELECT o_orderkey AS k, concat('{{', CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE concat('"url":"https://a', o_orderkey, '.com/",') END,
    CASE WHEN o_orderkey % 23 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN '"viewport":{{"width":"wide","height":900}},' ELSE '"viewport":{{"width":1440,"height":900}},' END,
    CASE WHEN o_orderkey % 31 = 0 THEN '"page_background":"white",' ELSE '' END, '"elements":[', coalesce(items, ''), '],"fonts":[{{"family":"A"}},{{"weight":"700"}},{{"family":', o_orderkey % 3,
    '}}],"samples":{{"colors":{{"#FFFFFF":', o_orderkey % 90, ',"#12345":4,"#000000":"x"}},"total":90}}}}') AS t
  FROM orders LEFT JOIN items ON l_orderkey = o_orderkey),
landed AS (SELECT k AS site_id, CASE WHEN k % 37 = 0 THEN t[1:40] WHEN k % 41 = 0 THEN '[1,2]' ELSE t END AS raw FROM whole)"""
_NUMBER = "json_type(e, '$.{0}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') OR (json_type(e, '$.{0}') = 'VARCHAR' AND try_cast(trim(e ->> '$.{0}') AS DOUBLE) IS NOT NULL)"
_BAD = "json_type(e, '$.{0}') IS NOT NULL AND NOT ({1})"
_CODE = "(json_type(e, '$.{0}') = 'NULL' OR (json_type(e, '$.{0}') = 'VARCHAR' AND regexp_full_match(e ->> '$.{0}', '#[0-9A-Fa-f]{{6}}')))"
_PROBLEM = f"""CASE
  WHEN json_type(e) <> 'OBJECT' THEN 'not an object'
  WHEN {_BAD.format("kind", "json_type(e, '$.kind') = 'VARCHAR' AND (e ->> '$.kind') IN ('box', 'button', 'button-text', 'input', 'code', 'heading', 'link', 'text')")} THEN 'kind: not one of the known words'
  WHEN {_BAD.format("region", "json_type(e, '$.region') = 'VARCHAR' AND (e ->> '$.region') IN ('page', 'header', 'nav', 'footer', 'main')")} THEN 'region: not one of the known words'
  WHEN {_BAD.format("w", _NUMBER.format("w"))} THEN 'w: not a number'
  WHEN {_BAD.format("color", _CODE.format("color"))} THEN 'color: not a colour code'
  WHEN {_BAD.format("on_image", "json_type(e, '$.on_image') = 'BOOLEAN'")} THEN 'on_image: neither yes nor no'
  WHEN {_BAD.format("bg", _CODE.format("bg"))} THEN 'bg: not a colour code'
  WHEN {_BAD.format("weight", _NUMBER.format("weight"))} OR try_cast(trim(e ->> '$.weight') AS DOUBLE) % 1 <> 0 THEN 'weight: not a whole number' END"""
_FONT = """CASE WHEN json_type(e, '$.family') IS NULL THEN 'family: missing' WHEN json_type(e, '$.family') <> 'VARCHAR' OR len(e ->> '$.family') > 100 THEN 'family: not a text of at most 100 characters' END"""

#: The candidates of chosen pages with their scores, a search result's place counting half a point; each site's links tell whether it is thin.
_CANDIDATES = ORACLES["choose_pages_topk"].split("o AS (")[0].replace("CASE WHEN top THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END", "CASE WHEN top AND link THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END")
_LUCK = "md5(site_id || CAST(search AS VARCHAR))[1:1]"

STEPS = {
    "measurements_checked": f"""
WITH {_RAW},
judged AS (
  SELECT site_id, CASE WHEN json_valid(raw) THEN raw END AS raw, CASE
      WHEN NOT json_valid(raw) OR json_type(CASE WHEN json_valid(raw) THEN raw END) <> 'OBJECT' THEN 'not an object'
      WHEN json_type(raw, '$.url') IS NULL THEN 'url: missing' WHEN json_type(raw, '$.viewport') IS NULL THEN 'viewport: missing'
      WHEN try_cast(raw ->> '$.viewport.width' AS INT) IS NULL THEN 'viewport.width: not a whole number'
      WHEN NOT regexp_full_match(coalesce(raw ->> '$.page_background', '#FFFFFF'), '#[0-9A-Fa-f]{{6}}') THEN 'page_background: not a colour code' END AS error
  FROM landed),
good AS (SELECT * FROM judged WHERE error IS NULL),
el AS (SELECT site_id, i, e, {_PROBLEM} AS problem FROM (SELECT site_id, unnest(range(len(x))) AS i, unnest(x) AS e FROM (SELECT site_id, json_extract(raw, '$.elements[*]') AS x FROM good))),
fo AS (SELECT site_id, i, {_FONT} AS problem FROM (SELECT site_id, unnest(range(len(x))) AS i, unnest(x) AS e FROM (SELECT site_id, json_extract(raw, '$.fonts[*]') AS x FROM good))),
told AS (
  SELECT site_id, array_to_string(list(said ORDER BY part, i)[1:3], '; ') AS problems
  FROM (SELECT site_id, 0 AS part, i, concat('elements[', i, ']: ', problem) AS said FROM el WHERE problem IS NOT NULL UNION ALL SELECT site_id, 1, i, concat('fonts[', i, ']: ', problem) FROM fo WHERE problem IS NOT NULL)
  GROUP BY site_id),
es AS (
  SELECT site_id, count(problem) AS left_elements, coalesce(string_agg(CASE WHEN problem IS NULL THEN coalesce(e ->> '$.kind', 'box') END, ',' ORDER BY i), '') AS kinds,
         coalesce(sum(CASE WHEN problem IS NULL THEN coalesce(CAST(trim(e ->> '$.w') AS DOUBLE), 0) END), 0) AS width
  FROM el GROUP BY site_id),
fs AS (SELECT site_id, count(problem) AS left_fonts FROM fo GROUP BY site_id),
cs AS (SELECT site_id, count(*) FILTER (NOT (regexp_full_match(c, '#[0-9A-Fa-f]{{6}}') AND json_type(raw, concat('$.samples.colors."', c, '"')) IN ('BIGINT', 'UBIGINT'))) AS left_colours FROM (SELECT site_id, raw, unnest(json_keys(raw, '$.samples.colors')) AS c FROM good) GROUP BY site_id)
SELECT site_id, 'measurement in an unexpected shape: ' || error AS error, CASE WHEN error IS NULL THEN coalesce(left_elements, 0) END AS left_elements, left_fonts, left_colours,
       CASE WHEN error IS NULL THEN coalesce(problems, '') END AS problems, CASE WHEN error IS NULL THEN coalesce(kinds, '') END AS kinds,
       round(CASE WHEN error IS NULL THEN coalesce(width, 0) END, 2) AS width, CASE WHEN error IS NULL THEN CAST(raw ->> '$.samples.colors."#FFFFFF"' AS BIGINT) END AS white
FROM judged LEFT JOIN es USING (site_id) LEFT JOIN fs USING (site_id) LEFT JOIN cs USING (site_id) LEFT JOIN told USING (site_id)""",
    "drawing_holes": """
WITH RECURSIVE ink AS (SELECT DISTINCT l_suppkey AS image_id, (l_orderkey * 7 + l_linenumber * 13) % 576 % 24 AS x, (l_orderkey * 7 + l_linenumber * 13) % 576 // 24 AS y FROM lineitem),
box AS (SELECT image_id, min(x) AS l, max(x) AS r, min(y) AS t, max(y) AS b, count(*) AS ink_n FROM ink GROUP BY image_id),
free AS (
  SELECT box.image_id, xs.x, ys.y, xs.x IN (l, r) OR ys.y IN (t, b) AS edge
  FROM box, range(24) AS xs(x), range(24) AS ys(y) WHERE xs.x BETWEEN l AND r AND ys.y BETWEEN t AND b AND NOT EXISTS (SELECT 1 FROM ink WHERE ink.image_id = box.image_id AND ink.x = xs.x AND ink.y = ys.y)),
water AS (
  SELECT image_id, x, y FROM free WHERE edge
  UNION
  SELECT f.image_id, f.x, f.y FROM water w JOIN free f ON f.image_id = w.image_id AND ((f.x = w.x AND abs(f.y - w.y) = 1) OR (f.y = w.y AND abs(f.x - w.x) = 1))),
n AS (SELECT image_id, ink_n, (r - l + 1) * (b - t + 1) AS box_n, (SELECT count(*) FROM free f WHERE f.image_id = box.image_id) - (SELECT count(*) FROM water w WHERE w.image_id = box.image_id) AS hole_n FROM box)
SELECT image_id, ink_n, box_n, hole_n, round(ink_n / box_n + 1e-9, 3) AS fill, round(hole_n / box_n + 1e-9, 3) AS holes FROM n""",
    "sites_in_turn": """
WITH asked AS (SELECT s_suppkey AS q, s_suppkey % 4 = 0 AS named, s_suppkey // 4 % 3 AS p FROM supplier),
own AS (
  SELECT q, i, CASE WHEN p = 0 THEN 'en.wikipedia.org' WHEN p = 1 THEN 'www.reddit.com' ELSE 'x.com' END AS host,
         10 - 0.3::DOUBLE * i - CASE WHEN p = 0 THEN 1.5::DOUBLE ELSE 0 END AS score
  FROM asked, range(1, 4) AS r(i) WHERE named AND q % 5 > 1 AND i <= q % 3 + 1 AND NOT (q % 5 = 2 AND i = 1)),
first AS (SELECT *, 1 AS search FROM own QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, i) = 1),
web AS (
  SELECT q, i, CASE WHEN i = 5 THEN q % 40 ELSE (q + i * 13) % 40 END AS m, named, q % 40 AS n FROM asked, range(1, 8) AS r(i) WHERE q NOT IN (SELECT q FROM first)),
judged AS (
  SELECT *, CASE WHEN named THEN 0.0::DOUBLE WHEN n = m THEN 1.0::DOUBLE WHEN contains('brand' || m, 'brand' || n) OR contains('brand' || n, 'brand' || m) THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END AS x FROM web),
scored AS (
  SELECT q, i, CASE WHEN i % 3 = 0 THEN 'shop.' ELSE 'www.' END || 'brand' || m || '.com' AS host,
         10 * x - 0.3::DOUBLE * i - CASE WHEN i % 3 = 0 THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN i % 2 = 0 THEN 0 ELSE 0.5::DOUBLE END AS score, x FROM judged),
second AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, i) = 1)
SELECT q AS query_id, 'https://' || host || '/' AS url, host, round(score, 4) AS score, true AS name_matches, CAST(1 AS BIGINT) AS search FROM first
UNION ALL SELECT q, 'https://' || host || '/', host, round(score, 4), x >= 0.7, 2 FROM second""",
    "pages_in_turn": rf"""{_CANDIDATES}
kinds_held AS (
  SELECT site_id, count(DISTINCT CASE WHEN kind IN ('about', 'mission', 'careers', 'press') THEN kind END) AS n
  FROM (SELECT site_id, kind, points, i, pos FROM e WHERE link AND points > 0 QUALIFY row_number() OVER (PARTITION BY pos ORDER BY points DESC, i) = 1) GROUP BY site_id),
site AS (SELECT site_id, coalesce(n, 0) < 3 AS thin FROM (SELECT DISTINCT site_id FROM k) LEFT JOIN kinds_held USING (site_id)),
out AS (
  SELECT site_id, search, CASE WHEN {_LUCK} IN ('0', '1', '2') THEN 'rate_limited' WHEN {_LUCK} = '3' THEN 'unavailable' WHEN {_LUCK} = '4' THEN 'no_allowance' ELSE 'ok' END AS status
  FROM site, (VALUES (1), (2)) AS v(search) WHERE search = 1 OR thin),
st AS (SELECT site_id, count(*) FILTER (status IN ('rate_limited', 'unavailable')) AS searches_failed, min_by(status, search) FILTER (status = 'no_allowance') AS stopped FROM out GROUP BY site_id),
used AS (
  SELECT s.* FROM s JOIN st USING (site_id) WHERE stopped IS NULL AND (link OR EXISTS (SELECT 1 FROM out WHERE out.site_id = s.site_id AND status = 'ok' AND search = CASE WHEN pos % 2 = 0 THEN 2 ELSE 1 END))),
placed AS (SELECT *, CASE WHEN link THEN 0 WHEN pos % 2 = 0 THEN 2 ELSE 1 END AS turn FROM used),
ordered AS (SELECT *, row_number() OVER (ORDER BY turn, pos) AS ord FROM placed),
o AS (SELECT *, row_number() OVER (PARTITION BY site_id, key ORDER BY score DESC, ord) AS n, min(ord) OVER (PARTITION BY site_id, key) AS first_at, bool_or(link) OVER (PARTITION BY site_id, key) AS any_link FROM ordered),
c AS (SELECT * FROM o WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY site_id, kind ORDER BY score DESC, first_at) <= CASE WHEN kind IN ('about', 'mission') THEN 2 ELSE 1 END),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, first_at) AS rank FROM c),
p AS (
  SELECT site_id, string_agg(concat_ws(' ', kind, CASE WHEN any_link THEN 'link' ELSE 'search' END, 'https://' || host || path), '; ' ORDER BY rank) AS pages, count(*) FILTER (NOT any_link) AS found_by_search
  FROM r WHERE rank <= 9 GROUP BY site_id)
SELECT site_id, thin, CAST(CASE WHEN thin THEN 2 ELSE 1 END AS BIGINT) AS search_calls, searches_failed, coalesce(found_by_search, 0) AS found_by_search, stopped, coalesce(pages, '') AS pages
FROM site JOIN st USING (site_id) LEFT JOIN p USING (site_id)""",
    "portable_logos": """
WITH g AS (
  SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN 'png' ELSE 'svg' END AS ext,
         CASE WHEN page_id % 3 <> 0 AND html IS NOT NULL THEN CASE WHEN page_id % 14 = 0 THEN from_hex('89504E470D0A1A0A') || encode(url) ELSE encode(html) END END AS content,
         CASE WHEN page_id % 6 = 1 THEN 'https://a.org/h.png' WHEN page_id % 2 = 0 THEN 'https://a.org/favicon.ico' END AS next FROM pages)
SELECT page_id, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 4 = 0 THEN url ELSE concat('/api/v1/guides/bg_', page_id, '/logos/', page_id % 5 + 1, '.', ext) END AS primary,
       CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 4 = 0 THEN url
            WHEN octet_length(content) < 600 AND (ext = 'svg' OR page_id % 14 = 0) THEN concat('data:image/', CASE ext WHEN 'svg' THEN 'svg+xml' ELSE ext END, ';base64,', to_base64(content)) ELSE next END AS logo_url
FROM g""",
}
