import json

from lumenloom.sources import measurements

SIZE = {"width": 10, "height": "20"}


def _read(spark, *parts):
    rows = [(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(parts)]
    df = measurements.checked_measurements(spark.createDataFrame(rows, "site_id int, raw string"))
    return sorted(df.collect(), key=lambda r: r["site_id"])


def test_odd_parts_are_left_out_and_told(spark):
    elements = [{"kind": "link", "w": 12.5, "weight": 700, "color": "#ABCDEF", "on_image": 1}, {"kind": "blob"}, {"weight": 400.5}, 7, {"color": None, "w": "3"}, {"font": "f" * 301}]
    logos = [{"id": "a", "visible": True, "nw": 3}, {"x": 1}]
    got = _read(spark, {"url": "u", "viewport": SIZE, "elements": elements, "logos": logos, "fonts": [{"family": "A"}, {}], "samples": {"colors": {"#FFFFFF": 3, "red": 2, "#000000": "x"}}})[0]
    assert got["error"] is None
    assert got["left_out"] == {"elements": 4, "logos": 1, "fonts": 1, "first-screen colours": 2}
    assert got["problems"] == ["elements[1]: kind: not one of the known words", "elements[2]: weight: not a whole number", "elements[3]: not an object"]
    assert [(e["kind"], e["w"], e["weight"], e["color"], e["on_image"]) for e in got["elements"]] == [("link", 12.5, 700, "#ABCDEF", True), ("box", 3.0, 400, None, False)]
    assert [(x["id"], x["visible"], x["nw"]) for x in got["logos"]] == [("a", True, 3)]
    assert [(x["family"], x["weight"], x["style"]) for x in got["fonts"]] == [("A", "400", "normal")]
    assert got["colors"] == {"#FFFFFF": 3}
    assert (got["viewport"]["width"], got["viewport"]["height"]) == (10, 20)


def test_wrong_as_a_whole_is_refused_with_the_first_thing_wrong(spark):
    ok = {"url": "u", "viewport": SIZE}
    cases = [
        (None, "not an object"), ("", "not an object"), ("[]", "not an object"), ("{", "not an object"), ({"viewport": SIZE}, "url: missing"), ({"url": "u"}, "viewport: missing"),
        ({**ok, "viewport": 3}, "viewport: not an object"), ({**ok, "viewport": {"width": 1.5, "height": 2}}, "viewport.width: not a whole number"), ({**ok, "elements": 3}, "elements: not a list"),
        ({**ok, "elements": [{}] * 5001}, "elements: more than 5000"), ({**ok, "links": ["a", 2]}, "links: not a list of texts"), ({**ok, "page_background": "white"}, "page_background: not a colour code"),
        ({**ok, "samples": {"colors": []}}, "samples.colors: not an object"), ({**ok, "samples": {"total": "many"}}, "samples.total: not a whole number"), ({**ok, "text": 5}, "text: not a text"),
    ]
    got = _read(spark, *[c for c, _ in cases])
    assert [r["error"] for r in got] == [f"measurement in an unexpected shape: {e}" for _, e in cases]
    assert all(r["elements"] is None and r["left_out"] is None for r in got)


def test_a_bad_element_more_does_not_make_a_list_too_long(spark):
    got = _read(spark, {"url": "u", "viewport": SIZE, "elements": [{}] * 5000 + [7]}, {"url": "u", "viewport": SIZE})
    assert [(r["error"], len(r["elements"]), r["left_out"]) for r in got] == [(None, 5000, {"elements": 1}), (None, 0, {})]
    assert _read(spark) == []
