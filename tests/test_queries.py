import pytest

from lumenloom import plans
from same import assert_same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(plans.ORACLES))
def test_rows_equal_sql(spark, name):
    assert_same(plans.QUERIES[name](spark, FOLDER), plans.ORACLES[name], FOLDER)


def test_every_sql_has_a_query():
    assert set(plans.ORACLES) <= set(plans.QUERIES)
    assert plans.FLAGSHIP in plans.QUERIES


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["site_id", "fg", "bg", "ratio", "level"]


def limited(hits, limit, window):
    """Brute force: (key, t, id) in time order -> id: (allowed, wait)."""
    taken, out = {}, {}
    for k, t, i in sorted(hits):
        times = [x for x in taken.get(k, []) if t - x < window]
        out[i] = (True, 0.0) if len(times) < limit else (False, round(times[0] + window - t, 3))
        taken[k] = times + [t] * (len(times) < limit)
    return out


@pytest.mark.parametrize("name", ["sliding_limiter", "events_state_stream"])
def test_sliding_limit_is_the_fold(spark, name):
    e = spark.read.parquet(f"{FOLDER}/events.parquet").selectExpr("user_id", "unix_micros(cast(ts as timestamp)) / 1e6 AS t", "event_id").collect()
    want = limited([(r.user_id, r.t, r.event_id) for r in e], 3, 86400.0)
    got = {r.event_id: (r.allowed, r.wait_s) for r in plans.QUERIES[name](spark, FOLDER).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=2e-3) for i in want)


def test_returned_hits_free_their_place(spark):
    rows = spark.read.parquet(f"{FOLDER}/events.parquet").selectExpr("user_id", "unix_micros(cast(ts as timestamp)) / 1e6 AS t", "event_id", "event_type = 'signup' AS back").collect()
    taken, want = {}, {}
    for user, t, i, back in sorted(rows):
        live = [x for x in taken.get(user, []) if t - x < 86400]
        if back:
            want[i], live = (None, 0.0), live[:-1]
        elif len(live) < 3:
            want[i] = (True, 0.0)
            live = [*live, t]
        else:
            want[i] = (False, live[0] + 86400 - t)
        taken[user] = live
    got = {r.event_id: (r.allowed, r.wait_s) for r in plans.QUERIES["limiter_returns"](spark, FOLDER).collect()}
    assert got.keys() == want.keys() and all(got[i][0] is want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=2e-3) for i in want)


def test_merged_colours_follow_greedy_order(spark):
    from lumenloom.operators import colours
    from lumenloom.plans.queries import _site_colours

    from lumenloom.functions import color
    from pyspark.sql import functions as F

    c = _site_colours(spark, FOLDER).select("site_id", "hex", "weight", "first_pos", "is_background", color.lab(F.col("hex")).alias("p")).collect()
    want = {}
    for site in {r.site_id for r in c}:
        heads = []
        for r in sorted((r for r in c if r.site_id == site), key=lambda r: (not r.is_background, -r.weight, r.first_pos, r.hex)):
            d = [sum((a - b) ** 2 for a, b in zip(h.p, r.p)) ** 0.5 for h in heads]
            near = [h for h, x in zip(heads, d) if x < 25]
            if not near:
                heads.append(r)
            want[site, r.hex] = near[0].hex if near else r.hex
    got = {(r.site_id, r.hex): r.kept for r in plans.QUERIES["palette_merge"](spark, FOLDER).collect()}
    assert got == want
    assert colours.SAME == 3.0


def picked(rows, contrast):
    """Roles of one site's colours, one after the other (rows as dictionaries)."""
    page = next(r for r in rows if r["is_background"])
    chroma = lambda r: (r["p"].a ** 2 + r["p"].b ** 2) ** 0.5
    far = lambda r, q: sum((getattr(r["p"], c) - getattr(q["p"], c)) ** 2 for c in "lab") ** 0.5
    total = sum(r["text_on_page"] for r in rows)
    pool = sorted((r for r in rows if r is page or r["hex"] not in ("#0000EE", "#551A8B", "#EE0000")), key=lambda r: (r["first_pos"], r["hex"]))
    vivid = [r["hex"] for r in pool if chroma(r) >= 20]
    calm = [r["hex"] for r in pool if chroma(r) < 20 or r["p"].l < 25]
    brand = {r["hex"]: r["weight"] - r["page_weight"] for r in pool}
    sale = {r["hex"] for r in pool if r["promo_fill"] > 0 or (r["promo_weight"] > 0 and r["promo_weight"] >= 0.5 * brand[r["hex"]])}
    out, bright = {"background": page["hex"]}, []
    pool.remove(page)

    def take(role, fits, amount):
        found = [r for r in pool if fits(r)]
        if found:
            one = max(found, key=amount)
            pool.remove(one)
            out[role] = one["hex"]
            if one["hex"] in vivid:
                bright.append(one)

    said = lambda least: lambda r: r["hex"] in calm and r["text_on_page"] > 0 and r["text_on_page"] >= least * total
    take("text", said(0.05), lambda r: contrast[page["hex"], r["hex"]])
    tiers = [
        (lambda r: r["hex"] in vivid and r["button_weight"] > 0, "button_weight"), (lambda r: r["hex"] in calm and r["button_weight"] > 0 and contrast[page["hex"], r["hex"]] >= 3, "button_weight"),
        (lambda r: r["hex"] in vivid and r["header_weight"] > 0, "header_weight"), (lambda r: r["hex"] in vivid and r["hex"] not in sale, None),
    ]
    for fits, by in tiers:
        if any(map(fits, pool)):
            take("primary", fits, lambda r: r[by] if by else brand[r["hex"]])  # noqa: B023
            break
    take("link", lambda r: r["hex"] in vivid and r["hex"] not in sale and r["links"] > 0, lambda r: r["links"])
    for role in ("secondary", "accent"):
        take(role, lambda r: r["hex"] in vivid and brand[r["hex"]] >= 40 and all(far(r, q) >= 15 for q in bright), lambda r: brand[r["hex"]])
    take("text-muted", said(0.1), lambda r: r["text_on_page"])
    take("surface", lambda r: r["hex"] not in vivid and r["background_weight"] > 0, lambda r: r["background_weight"])
    take("border", lambda r: r["border_weight"] > 0, lambda r: r["border_weight"])
    return out


@pytest.mark.parametrize("name", ["palette_roles", "palette_chain"])
def test_palette_roles_follow_the_plain_rules(spark, name):
    from pyspark.sql import functions as F

    from lumenloom.functions import color
    from lumenloom.operators import colours
    from lumenloom.plans.derive import elements
    from lumenloom.plans.queries import _site_colours

    c = _site_colours(spark, FOLDER).drop("uses")
    if name == "palette_chain":
        by = colours.with_page_background(colours.by_colour(colours.colour_uses(colours.without_stacked_copies(elements(spark, FOLDER)))))
        merged = {(r.site_id, r.hex): r.kept for r in colours.merge_lookalikes(by, 12.0).collect()}
        sums, first = {}, {}
        for r in by.drop("uses").collect():
            key = r.site_id, merged[r.site_id, r.hex]
            row = sums.setdefault(key, {k: 0 for k in r.asDict()})
            for k, v in r.asDict().items():
                if k not in ("site_id", "hex", "first_pos", "is_background"):
                    row[k] += v
            row["is_background"] = row["is_background"] or r.is_background
            first[key] = min(first.get(key, r.first_pos), r.first_pos)
        rows = [row | {"site_id": s, "hex": h, "first_pos": first[s, h]} for (s, h), row in sums.items()]
        c = spark.createDataFrame([{k: (bool(v) if k == "is_background" else float(v) if isinstance(v, (int, float)) and k not in ("site_id", "first_pos", "is_background") else v) for k, v in row.items()} for row in rows])
    rows = [r.asDict() for r in c.withColumn("p", color.lab(F.col("hex"))).collect()]
    pages = {r["hex"] for r in rows if r["is_background"]}
    codes = spark.createDataFrame([(p, h) for p in pages for h in {r["hex"] for r in rows}], "a string, b string")
    contrast = {(r.a, r.b): r.x for r in codes.select("a", "b", color.contrast_ratio(F.col("a"), F.col("b")).alias("x")).collect()}
    want = {(site, role, h) for site in {r["site_id"] for r in rows} for role, h in picked([r for r in rows if r["site_id"] == site], contrast).items()}
    got = {(r.site_id, r.role, r.hex) for r in plans.QUERIES[name](spark, FOLDER).collect()}
    assert got == want and len(got) > 20


def test_excerpts_follow_the_budgets(spark):
    c = spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    want = set()
    for conv in {r.conv_id for r in c}:
        had, room = set(), 1000
        for r in sorted((r for r in c if r.conv_id == conv), key=lambda r: r.turn):
            if room < 50:
                break
            limit, used, kept = min(300 if r.turn > 0 else 400, room), 0, []
            for line in (" ".join(x.split()) for x in (r.text or "").split("\n")):
                if not line or line.lower() in had:
                    continue
                if used + len(line) + 1 > limit:
                    if limit - used >= 50:
                        kept.append(line[: limit - used].rsplit(" ", 1)[0])
                        used = limit
                    break
                had.add(line.lower())
                kept.append(line)
                used += len(line) + 1
            if kept:
                want.add((conv, r.turn, "\n".join(kept)))
                room -= used
    got = {(r.site_id, r.ord, r.excerpt) for r in plans.QUERIES["excerpt_pick"](spark, FOLDER).collect()}
    assert got == want


def test_json_documents_hold_what_their_guides_hold(spark):
    import json

    from lumenloom.plans.queries import _guides

    guides = {r.site_id: r.asDict(recursive=True) for r in _guides(spark, FOLDER).collect()}
    rows = plans.QUERIES["export_json"](spark, FOLDER).collect()
    assert len(rows) == len(guides)
    for r in rows:
        doc = json.loads(r.content)
        for k, v in guides[r.site_id].items():
            if k in doc and k != "colors":
                assert doc[k] == v or (not v and not doc[k]), k
        assert [(c["role"], c["hex"]) for c in doc["colors"]] == [(c["role"], c["hex"]) for c in guides[r.site_id]["colors"]]


def test_documents_hold_all_roles_in_order(spark):
    import re

    roles = "primary secondary accent background surface text text-muted link border".split()
    palette = {(r.site_id, r.role): r.hex for r in plans.QUERIES["palette_chain"](spark, FOLDER).collect()}
    fonts = {(r.site_id, r.role): r.family for r in plans.QUERIES["typography_by_role"](spark, FOLDER).collect()}
    rows = plans.QUERIES["guide_chain"](spark, FOLDER).collect()
    assert {r.site_id for r in rows} == {s for s, _ in palette} | {s for s, _ in fonts}
    for r in rows:
        assert re.findall(r"--color-([a-z-]+): (#[0-9A-F]{6});", r.content) == [(x, palette[r.site_id, x]) for x in roles if (r.site_id, x) in palette]
        assert re.findall(r'--font-([a-z]+): "([^"]*)", serif;', r.content) == [(x, fonts[r.site_id, x]) for x in ("heading", "body", "ui", "mono") if (r.site_id, x) in fonts]
        assert r.missing == "tone of voice, key messaging"


def test_documents_without_parts_are_kept(spark):
    from lumenloom.operators import guides

    sites = spark.createDataFrame([(1, "A", None), (2, "B", "https://b/c.svg")], "site_id long, name string, logo_url string")
    palette = spark.createDataFrame([(2, "text", "#111111"), (2, "primary", "#222222")], "site_id long, role string, hex string")
    fonts = spark.createDataFrame([(2, "body", "Face", [400], ["serif"])], "site_id long, role string, family string, weights array<int>, fallbacks array<string>")
    warnings = spark.createDataFrame([(1, ["a"]), (1, ["b"])], "site_id long, warnings array<string>")
    got = {r.site_id: r for r in guides.build_guides(sites, palette, fonts, warnings=warnings).collect()}
    assert sorted(got[1].warnings) == ["a", "b"] and got[1].missing == ["logo", "colours", "fonts", "tone of voice", "key messaging"] and got[1].colors == []
    assert [c.role for c in got[2].colors] == ["primary", "text"] and got[2].fonts[0].fallback == "serif" and got[2].missing == ["tone of voice", "key messaging"]
