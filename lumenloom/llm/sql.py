"""DuckDB SQL that gives the rows of the queries independently of the operators."""

URL_FILTER = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM u LEFT JOIN fits f USING (page_id)
"""


def _near(*words: str) -> str:
    """Whether a whole word stands in the 40 characters before or after, as far as the text between two matches goes."""
    any_of = rf"(^|[^\p{{L}}\p{{N}}])({'|'.join(words)})([^\p{{L}}\p{{N}}]|$)"
    before = r"CASE WHEN length(piece) > 40 THEN regexp_replace(right(piece, 40), '^[\p{L}\p{N}]+', '') ELSE piece END"
    after = r"CASE WHEN length(after) > 40 THEN regexp_replace(left(after, 40), '[\p{L}\p{N}]+$', '') ELSE after END"
    return f"(regexp_matches(lower({before}), '{any_of}') OR regexp_matches(lower({after}), '{any_of}'))"


def _kind(name: str, pattern: str, valid: str, bare: str, with_word: str, words: tuple[str, ...]) -> str:
    """A subquery with the spans of one kind: pieces between matches and matches give the offsets."""
    return f"""
  SELECT doc_id, '{name}' AS kind, start, start + length(hit) AS stop, CASE WHEN {_near(*words)} THEN '{with_word}' ELSE '{bare}' END AS score FROM (
    SELECT doc_id, i, hits[i] AS hit, pieces[i] AS piece, pieces[i + 1] AS after,
           list_sum(list_transform(pieces[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS hits, regexp_split_to_array(text, '{pattern}') AS pieces FROM d) s,
         unnest(range(1, len(hits) + 1)) AS r(i)) m
  WHERE {valid}"""


_LUHN = """(list_sum(list_transform(range(1, length(regexp_replace(hit, '[ -]', '', 'g')) + 1), lambda k:
      CASE WHEN k % 2 = 1 THEN CAST(reverse(regexp_replace(hit, '[ -]', '', 'g'))[k] AS INT)
           ELSE CAST('0246813579'[CAST(reverse(regexp_replace(hit, '[ -]', '', 'g'))[k] AS INT) + 1] AS INT) END)) % 10 = 0)"""

_EDGE = "NOT regexp_matches(right(piece, 1), '{0}') AND NOT regexp_matches(left(after, 1), '{0}') AND "
_CALL = ("phone", "tel", "call", "mobile")
_SSN = ("ssn", "social security")


_MOD97 = """(list_reduce(list_prepend(0, list_transform(range(1, length(replace(hit, ' ', '')) + 1), lambda k:
      ascii((replace(hit, ' ', '')[5:] || replace(hit, ' ', '')[:4])[k]))),
      lambda rest, c: CASE WHEN c <= 57 THEN (rest * 10 + c - 48) % 97 ELSE (rest * 100 + c - 55) % 97 END) = 1)"""

PII = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT *, 1 AS k FROM ({_kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", "0.8", "0.95", ("mail", "email", "contact", "write"))})
  UNION ALL
  SELECT *, 2 FROM ({_kind("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_bool_and(list_transform(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(p, '0') AS INT), 0) <= 255))", "0.6", "0.8", ("ip", "address", "server", "host"))})
  UNION ALL
  SELECT *, 3 FROM ({_kind("card", r"[0-9](?:[ -]?[0-9])+", f"length(regexp_replace(hit, '[ -]', '', 'g')) BETWEEN 13 AND 19 AND {_LUHN}", "0.8", "0.95", ("card", "visa", "payment", "carte", "karte", "tarjeta"))})
  UNION ALL
  SELECT *, 4 FROM ({_kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "length(regexp_replace(hit, '[^0-9]', '', 'g')) BETWEEN 9 AND 15", "0.7", "0.9", _CALL)})),
added AS (
  SELECT *, 5 AS k FROM ({_kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", _EDGE.format("[A-Za-z0-9]") + _MOD97, "0.7", "0.95", ("iban", "account", "konto", "compte", "cuenta"))})
  UNION ALL
  SELECT *, 6 FROM ({_kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _EDGE.format("[0-9-]") + _near(*_SSN), "0.3", "0.8", _SSN)})
  UNION ALL
  SELECT *, 7 FROM ({_kind("tel", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", _EDGE.format("[0-9-]") + _near(*_CALL, "fax"), "0.3", "0.7", (*_CALL, "fax"))})),
spans AS (SELECT *, true AS is_base FROM base UNION ALL SELECT *, false FROM added),
g AS (
  SELECT doc_id,
         count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
         count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) FILTER (is_base) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS spans, string_agg(score, ',' ORDER BY k, start) AS scores
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN g USING (doc_id)
"""


DECONTAMINATE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dg AS (SELECT doc_id, len(w) AS nd, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS r(i)),
tg AS (SELECT item_id, len(w) AS n, i - 1 AS q, array_to_string(w[i:i + 4], ' ') AS g FROM t, unnest(range(1, len(w) - 3)) AS r(i)),
win AS (
  SELECT DISTINCT doc_id, item_id, n, least(n, nd) AS len, greatest(0, least(pos - q, nd - least(n, nd))) AS start
  FROM dg JOIN tg USING (g)),
tc AS (SELECT item_id, g, count(*) AS c FROM tg GROUP BY ALL),
wc AS (SELECT win.doc_id, win.item_id, start, len, g, count(*) AS c FROM win JOIN dg ON dg.doc_id = win.doc_id AND pos BETWEEN start AND start + len - 5 GROUP BY ALL),
s AS (
  SELECT doc_id, wc.item_id, start, len, n, sum(least(wc.c, coalesce(tc.c, 0))) AS common
  FROM wc LEFT JOIN tc ON tc.item_id = wc.item_id AND tc.g = wc.g JOIN (SELECT DISTINCT item_id, n FROM tg) x ON x.item_id = wc.item_id
  GROUP BY ALL),
j AS (SELECT *, common / (len - 4 + n - 4 - common) AS similarity FROM s WHERE common / (len - 4 + n - 4 - common) >= 0.8)
SELECT doc_id, item_id, start, len AS n_words, similarity FROM j
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""


EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
                      THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS e
  FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND list_inner_product(e, e) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


SUBSTRING_DEDUP = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
dup AS (SELECT r, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + k AS p FROM dup, range(0, 35) AS t(k)),
per AS (SELECT r, list(p) AS ps FROM gone GROUP BY r),
kept AS (SELECT doc_id, w, list_filter(w, lambda x, i: NOT list_contains(coalesce(ps, CAST([] AS BIGINT[])), i)) AS k FROM d LEFT JOIN per USING (r))
SELECT doc_id, len(w) AS n_words, len(w) - len(k) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


def _merkle_tree(name: str, levels: int) -> str:
    """CTEs name0 (tree, i, n, h) to name<levels>, with g, what the others of a node's run are: before and after it."""
    out = []
    for k in range(levels):
        out.append(f"""{name}{k}g AS (
  SELECT tree, i // 16 AS r, max(n) AS n, list(h ORDER BY i) AS hs FROM {name}{k} GROUP BY ALL),
{name}{k + 1} AS (
  SELECT tree, r AS i, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}{k}g)""")
    return ",\n".join(out)


def _merkle_up(name: str, levels: int, tree: str, i: str) -> tuple[str, str]:
    """Joins that reach the run of a node on each level, and the digests around it as a list of (hashed, before, after)."""
    joins = "\n".join(f"JOIN {name}{k}g {name[0]}{k} ON {name[0]}{k}.tree IS NOT DISTINCT FROM {tree} AND {name[0]}{k}.r = {i} // {16 ** (k + 1)}" for k in range(levels))
    at = [f"({i} // {16 ** k}) % 16" for k in range(levels)]
    steps = [f"{{'hashed': {name[0]}{k}.n > 1, 'l': array_to_string({name[0]}{k}.hs[:{a}], ''), 'r': array_to_string({name[0]}{k}.hs[{a} + 2:], '')}}" for k, a in enumerate(at)]
    return joins, ", ".join(steps)


def _field(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


#: crc32 bit by bit
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(CAST(doc_id AS VARCHAR)[k]) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: CAST(0 AS BIGINT))), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

#: Groups of up to 16^6 documents and up to 16^4 groups.
_DOCS, _GROUPS = 6, 4
_DOC_JOINS, _DOC_STEPS = _merkle_up("doc", _DOCS, "t.tree", "t.i")
_GROUP_JOINS, _GROUP_STEPS = _merkle_up("src", _GROUPS, "''", "s.i")
MERKLE = f"""
WITH leaves AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
         CASE WHEN {_CRC} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS forged
  FROM documents),
t AS (
  SELECT *, source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
doc0 AS (SELECT tree, i, n, leaf AS h FROM t),
{_merkle_tree("doc", _DOCS)},
src0 AS (
  SELECT '' AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h, tree AS source FROM doc{_DOCS}),
{_merkle_tree("src", _GROUPS)},
s AS (SELECT s.source, s.h AS subroot, [{_GROUP_STEPS}] AS up FROM src0 s {_GROUP_JOINS}),
p AS (
  SELECT t.doc_id, t.leaf, coalesce(t.forged, t.leaf) AS got, s.subroot, list_filter(list_concat([{_DOC_STEPS}], s.up), lambda x: x.hashed) AS path
  FROM t JOIN s ON t.source IS NOT DISTINCT FROM s.source {_DOC_JOINS}),
f AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM src{_GROUPS}) AS root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256,
         list_reduce(list_prepend({{'l': got, 'r': ''}}, list_transform(path, lambda x: {{'l': x.l, 'r': x.r}})), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root
  FROM p)
SELECT *, folded_root = root AS verified FROM f
"""

AUDIT = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
first AS (SELECT text, min(doc_id) AS least FROM w GROUP BY text),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(lab.toxic, false) AS toxic,
         MAP {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
              'C': 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 10 * length(w.text),
              'D': regexp_matches(w.text, '[#$%&*|]'), 'E': coalesce(least < w.doc_id, false)} AS fails
  FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id JOIN first ON w.text = first.text),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS f, string_split(filter_order[:step - 1], '') AS before FROM orders, range(1, 6) r(step)),
j AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS hit, len(list_filter(before, lambda x: x <> '' AND fails[x])) = 0 AS here,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x])) AS many
  FROM c, steps),
k AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN here AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND hit THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN hit AND NOT here THEN n ELSE 0 END) AS redundant, sum(CASE WHEN hit AND many = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN here AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND hit THEN toxic ELSE 0 END) AS toxic_lost
  FROM j GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM k
"""
