"""DuckDB SQL for the queries on reading, heads of pages, labels and palettes; written independently of the operators."""

from lumenloom.plans.oracles import _CONTRAST, _colours, _hex, _host, _path

_FETCHED = f"""
f AS (
  SELECT page_id AS n, url, html, array_to_string(string_split({_host("url")}, '.')[-2:], '.') AS site_id, CASE WHEN page_id % 2 = 0 THEN 'about' END AS kind,
         nullif(CASE WHEN page_id % 3 = 0 THEN (['', 'timeout', 'page_not_found', 'bot_blocked', 'target_http_error', 'odd_error'])[CAST(page_id // 3 % 6 AS INT) + 1] ELSE '' END, '') AS error,
         ([0, 401, 402, 403, 404, 429, 500, 503])[CAST(page_id % 8 AS INT) + 1] AS status
  FROM pages),
lands AS (
  SELECT *, CASE WHEN n % 7 = 2 THEN 'about.' || split_part(site_id, '.', 1) || '/story' WHEN n % 7 = 3 THEN site_id || '/all' WHEN n % 49 = 4 THEN site_id
                 ELSE lower(rtrim(regexp_replace({_host("url")}, '^www\\.', '') || {_path("url")}, '/')) END AS key,
         CASE WHEN n % 5 = 0 THEN 1 ELSE length(html) END < 200 AS short FROM f),
good AS (SELECT site_id, key, min(url) AS first FROM lands WHERE error IS NULL AND n % 7 > 1 AND NOT short AND key NOT IN (site_id, site_id || '/en/about') GROUP BY ALL),
r AS (
  SELECT lands.*, CASE error WHEN 'timeout' THEN 'the page took too long to load' WHEN 'page_not_found' THEN 'the page doesn’t exist' WHEN 'bot_blocked' THEN 'the site blocked automated reading'
                       WHEN 'target_http_error' THEN 'the site answered with an error' WHEN 'odd_error' THEN 'it couldn’t be read'
                       ELSE CASE n % 7 WHEN 0 THEN 'it redirected to another website' WHEN 1 THEN 'it redirected to a page that is never read, such as a sign-in or legal page'
                       ELSE CASE WHEN key IN (site_id, site_id || '/en/about') OR url > good.first THEN 'it led to a page that was already read' WHEN short THEN 'it had almost no text' END END END AS reason,
         CASE WHEN error IS NOT NULL THEN error IN ('timeout', 'bot_blocked') ELSE n % 7 > 1 AND short AND NOT (key IN (site_id, site_id || '/en/about') OR coalesce(url > good.first, false)) END AS retry, CASE WHEN error IS NULL AND n % 7 = 0 THEN 'elsewhere.net' END AS elsewhere
  FROM lands LEFT JOIN good USING (site_id, key))"""

MORE = {
    "joined_runs": """WITH r AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view'),
m AS (SELECT user_id, event_id AS run, ts AS at, ts + to_minutes(event_id % 5000) AS until FROM events WHERE event_type = 'purchase')
SELECT r.user_id AS key, r.event_id AS request_id, list(run ORDER BY until DESC, run DESC) FILTER (run IS NOT NULL)[1] AS run_id
FROM r LEFT JOIN m ON r.user_id = m.user_id AND r.ts >= m.at AND r.ts < m.until GROUP BY ALL""",
    "cancelled_jobs": """WITH n AS (
  SELECT user_id, ts, sum(CASE WHEN event_type = 'click' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n
  FROM events WHERE event_type IN ('click', 'error'))
SELECT user_id, min(ts) AS cancelled_at FROM n WHERE n <= 0 GROUP BY user_id""",
    "logo_places": """WITH c AS (SELECT p_partkey // 12 AS site_id, p_partkey % 12 AS pos, 'k' || p_partkey % 11 AS key, round(0.3::DOUBLE + (p_partkey * 7 % 10) / 20.0::DOUBLE, 2) AS confidence, p_partkey % 12 > 8 AS icon FROM part),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY site_id, key ORDER BY confidence DESC, pos) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY confidence DESC, pos, key) AS n FROM b),
i AS (SELECT site_id, min(n) AS first FROM n WHERE icon GROUP BY site_id HAVING min(n) > 5)
SELECT site_id, key, pos, confidence, CASE WHEN n = first THEN 5 ELSE n END AS rank FROM n LEFT JOIN i USING (site_id) WHERE n < CASE WHEN first IS NULL THEN 6 ELSE 5 END OR n = first""",
    "read_outcomes": f"""WITH {_FETCHED}
SELECT url, CASE WHEN reason IS NULL THEN 'read' ELSE 'skipped' END AS state, reason, retry, elsewhere,
  coalesce(error = 'page_not_found' OR (error = 'target_http_error' AND status NOT IN (401, 403, 429, 503)), false) AS no_site,
  CASE WHEN status = 401 THEN 'auth' WHEN status = 402 THEN 'credits' WHEN status = 429 THEN 'rate_limited' WHEN status IN (403, 500, 503) THEN 'unavailable' ELSE 'bad_request' END AS failure FROM r""",
    "retry_set": f"WITH {_FETCHED} SELECT site_id, url FROM r WHERE retry QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY url) <= 3",
    "skip_warnings": f"""WITH {_FETCHED},
s AS (SELECT *, count(elsewhere) OVER (PARTITION BY site_id) AS gone FROM r WHERE reason IS NOT NULL),
one AS (
  SELECT site_id, 0 AS late, url, 'The ' || CASE WHEN kind = 'about' THEN 'About' ELSE 'Press' END || ' page (' || url || ') was skipped: ' || reason || '.' AS w FROM s WHERE elsewhere IS NULL OR gone < 2),
l AS (SELECT site_id, list(url || ' (to ' || elsewhere || ')' ORDER BY url) AS xs FROM s WHERE elsewhere IS NOT NULL AND gone > 1 GROUP BY site_id),
many AS (SELECT site_id, 1, '', len(xs) || ' pages were skipped because they redirected to other websites: ' || array_to_string(xs[:-2], ', ') || ' and ' || xs[-1] || '.' FROM l)
SELECT site_id, string_agg(w, chr(10) ORDER BY late, url) AS warnings FROM (FROM one UNION ALL FROM many) GROUP BY site_id""",
    "kinds_linked": rf"""WITH l AS (
  SELECT page_id AS n, {_host("url")} AS host, CASE WHEN page_id % 2 = 0 THEN '/en/' ELSE '/' END AS lead,
         (['about', 'careers', 'newsroom', 'blog', 'pricing', 'products', 'our-story', 'jobs', 'logos', 'login', 'tea', 'a.pdf'])[CAST(page_id % 12 AS INT) + 1] AS word,
         ([NULL, 'about', 'careers', 'mission', 'brand', 'press', 'pricing'])[CAST(page_id % 7 AS INT) + 1] AS said FROM pages),
k AS (
  SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS site_id,
         CASE WHEN word IN ('about', 'our-story') THEN 'about' WHEN word IN ('careers', 'jobs') THEN 'careers' WHEN word = 'newsroom' THEN 'press' WHEN word IN ('blog', 'pricing') THEN word
              WHEN word = 'products' THEN 'product' WHEN word = 'logos' THEN 'brand' END AS named, CASE WHEN host LIKE 'blog.%' THEN 'blog' END AS sub FROM l),
d(i, kind, label) AS (VALUES (0, 'brand', 'Brand assets'), (1, 'about', 'About'), (2, 'mission', 'Mission and values'), (3, 'product', 'Product'), (4, 'careers', 'Careers'), (5, 'press', 'Press'), (6, 'blog', 'Blog'), (7, 'pricing', 'Pricing')),
e AS (
  SELECT site_id, n, i, kind, label, CASE WHEN coalesce(named = kind, false) OR coalesce(sub = kind, false) THEN 3 ELSE 0 END + CASE WHEN named = kind THEN 1 ELSE 0 END + CASE WHEN said = kind OR (said = 'brand' AND kind = 'press') THEN 2 ELSE 0 END
    + CASE WHEN kind = 'press' AND word = 'newsroom' THEN 1 ELSE 0 END AS points FROM k CROSS JOIN d WHERE word NOT IN ('login', 'a.pdf')),
b AS (SELECT * FROM e WHERE points > 0 QUALIFY row_number() OVER (PARTITION BY n ORDER BY points DESC, i) = 1),
g AS (SELECT DISTINCT site_id, i, kind, label FROM b),
a AS (SELECT site_id, string_agg(label, ', ' ORDER BY i) AS kinds, CAST(count(*) FILTER (kind IN ('about', 'mission', 'careers', 'press')) AS INT) AS main_kinds FROM g GROUP BY site_id)
SELECT s.site_id, coalesce(kinds, '') AS kinds, coalesce(main_kinds, 0) AS main_kinds, coalesce(main_kinds, 0) < 3 AS thin FROM (SELECT DISTINCT site_id FROM k) s LEFT JOIN a USING (site_id)""",
    "gaps_filled": """SELECT doc_id AS site_id, source AS title, source AS site_name, lang AS description, lang AS language, CASE WHEN text IS NOT NULL OR true THEN 'icon' END AS favicon,
  CASE WHEN n_chars % 2 = 1 THEN length(text) WHEN length(text) >= 200 THEN length(text) ELSE 5 END AS chars,
  concat_ws(',', CASE WHEN n_chars % 2 = 0 AND coalesce(lang, '') <> '' THEN 'description' END, CASE WHEN n_chars % 2 = 1 THEN 'icon' END, CASE WHEN n_chars % 2 = 0 AND length(text) >= 200 THEN 'text' END) AS filled
FROM documents""",
    "page_icons": """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 5 = 0 THEN 'https://a.com/i.svg' WHEN p_partkey % 3 > 0 THEN 'https://a.com/i' || p_partkey || '.png' ELSE 'https://a.com/b/touch.png' END AS url FROM part""",
    "site_names": """SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 2 THEN 'Brand' || s_suppkey WHEN s_suppkey % 4 = 2 THEN NULL ELSE 'Brand' || s_suppkey || ' Ltd' END AS from_title,
  CASE s_suppkey % 5 WHEN 2 THEN 'Brand' || s_suppkey WHEN 4 THEN 'Thistle United Kingdom' ELSE 'Brand' || s_suppkey END AS plain FROM supplier""",
    "durations": """WITH s AS (SELECT o_orderkey, o_orderdate, o_orderkey * 37 % 90000 AS s FROM orders),
w AS (SELECT *, CASE WHEN s < 60 THEN greatest(1, s) WHEN s < 3600 THEN CAST(ceil(s / 60.0) AS BIGINT) ELSE CAST(ceil(s / 3600.0) AS BIGINT) END AS n,
        CASE WHEN s < 60 THEN ' second' WHEN s < 3600 THEN ' minute' ELSE ' hour' END AS unit FROM s)
SELECT o_orderkey, n || unit || CASE WHEN n = 1 THEN '' ELSE 's' END AS wait,
  CASE WHEN s < 3600 THEN 'a few minutes ago' ELSE (s // 3600) || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago' END AS ago,
  day(o_orderdate) || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate) AS day FROM w""",
    "font_stacks": """WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, 'B ' || p_size AS b FROM part)
SELECT p_partkey, (['Face, One', '__Inter_d65c78', '__My_Sans_Fallback_d65c78', '-apple-system', 'Arial'])[CAST(k AS INT) + 1] || '|' || b || '|Sans-Serif' AS names,
  (['"Face, One"|', 'Inter|', '', 'system-ui|', 'Arial|'])[CAST(k AS INT) + 1] || '"' || b || '"|Sans-Serif' AS shown, 'sans-serif' AS keyword FROM p""",
    "safe_addresses": rf"""WITH p AS (SELECT page_id AS n, url, {_host("url")} AS host, {_path("url")} AS path FROM pages)
SELECT n AS page_id, CASE WHEN n % 4 = 2 THEN lower(url) END AS web, CASE n % 4 WHEN 2 THEN lower(url) WHEN 1 THEN 'data:image/png;base64,iVBORw0KGgo=' END AS logo,
  CASE WHEN n % 2 = 0 THEN 'data:image/svg+xml;base64,' || to_base64(encode(url)) END AS data, true AS on_page, host AS public,
  'name:x site:' || regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*[^?#/])', 1), '^www\.', '') || regexp_extract(url, '(\?[^#]+)', 1) AS keys FROM p""",
    "empty_sections": """SELECT c_custkey AS site_id, concat_ws(', ', CASE WHEN c_custkey % 3 <> 0 THEN 'logo' END, CASE WHEN c_custkey % 2 <> 0 THEN 'tone of voice' END, CASE WHEN c_custkey % 4 = 0 THEN 'key messaging' END) AS missing FROM customer""",
    "model_rounds": """SELECT l_suppkey % 10 AS site_id, l_returnflag AS model, l_linenumber AS round, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS verified, count(*) * 50 AS checked,
  CAST(sum(l_partkey % 5) AS BIGINT) AS kept, count(*) * 5 AS drafted, CAST(sum(l_orderkey) AS BIGINT) AS tokens, round(sum(l_tax) + 1e-7, 3) AS cost, max(l_discount) AS seconds FROM lineitem GROUP BY ALL""",
    "paper_colours": """WITH e AS (
  SELECT l_orderkey AS id, l_linenumber % 2 + CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 1 THEN 21 ELSE 0 END AS z, l_orderkey % 11 <> 0 AS solid FROM lineitem),
px AS (SELECT id, solid, z + id % 230 AS r, z + id * 7 % 230 AS g, z + id * 13 % 230 AS b FROM e),
s AS (SELECT id, r // 16 * 256 + g // 16 * 16 + b // 16 AS shade, count(*) AS n, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM px WHERE solid GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, shade) AS k FROM s),
a AS (SELECT id, count(*) AS n, count(*) FILTER (solid) AS solid FROM px GROUP BY id)
SELECT id AS image_id, '#' || printf('%02X%02X%02X', CAST(floor(r + 0.5) AS INT), CAST(floor(g + 0.5) AS INT), CAST(floor(b + 0.5) AS INT)) AS hex
FROM t JOIN a USING (id) WHERE k = 1 AND a.solid >= 0.98 * a.n AND t.n >= 0.95 * a.n""",
    "contrast_grid": _CONTRAST + """,
backs AS (SELECT DISTINCT site_id, hex AS bg FROM side WHERE half = 1), fgs AS (SELECT DISTINCT site_id, fg FROM pairs WHERE level <> 'fail')
SELECT site_id, fg, string_agg(CASE WHEN p.ratio IS NULL THEN '–' ELSE printf('%.2f', p.ratio) END, ' ' ORDER BY bg) AS cells
FROM fgs JOIN backs USING (site_id) LEFT JOIN (FROM pairs WHERE level <> 'fail') p USING (site_id, fg, bg) GROUP BY site_id, fg""",
    "token_contrast": f"""WITH src AS (SELECT DISTINCT {_hex("p_partkey // 41 * 41")} AS hex FROM part), {_colours("src")},
t AS (SELECT p_partkey AS k, CASE WHEN p_partkey // 41 % 5 <> 0 AND p_partkey >= 41 THEN lum END AS lum FROM part JOIN lab ON lab.hex = {_hex("p_partkey // 41 * 41")}),
x AS (SELECT a.k, b.k AS bk, (greatest(a.lum, b.lum) + 0.05::DOUBLE) / (least(a.lum, b.lum) + 0.05::DOUBLE) AS ratio FROM t a JOIN t b ON b.k = a.k + 20)
SELECT 'light' AS theme, 't' || k AS fg, 't' || bk AS bg, CAST(floor(ratio * 100) AS BIGINT) AS ratio, ratio >= 4.5 AS enough FROM x""",
}
