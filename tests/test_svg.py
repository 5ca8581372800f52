"""Inline drawings as safe files: precedence of looks, inheritance, what is painted."""

from lumenloom.operators import svg

NS = 'xmlns="http://www.w3.org/2000/svg"'
BOX = f'{NS} viewBox="0 0 9 9" width="9" height="9"'
GIVEN = '<svg viewBox="0 0 9 9">'


def clean(spark, *drawings):
    rows = svg.clean_drawings(spark.createDataFrame([(i, d, "#12ABef" if i % 2 else "red") for i, d in enumerate(drawings)], "drawing_id int, svg string, shade string"), color="shade").collect()
    found = {r.drawing_id: r.svg for r in rows}
    assert len(rows) == len(drawings)
    return [found[i] for i in range(len(drawings))]


CASES = [
    # attribute < class < style < paint that was seen
    (f'{GIVEN}<path d="M0" fill="#111111"/></svg>', f'<svg {BOX}><path d="M0" fill="#111111"></path></svg>'),
    (f'{GIVEN}<style>.a,.c{{fill:#222222;stroke:red}} .b{{fill:#333333}}</style><path class="b a" d="M0" fill="#111111"/></svg>', f'<svg {BOX} color="#12ABef"><path d="M0" fill="#222222" stroke="red"></path></svg>'),
    (f'{GIVEN}<style>/* .a{{fill:blue}} */.a{{fill:#222222}}.a{{fill:#444444}}g .a{{fill:pink}}</style><path class="a" style="FILL : #555555 !important; x: y" d="M0"/></svg>', f'<svg {BOX}><path d="M0" fill="#555555"></path></svg>'),
    (f'{GIVEN}<path data-mark-paint="fill:#666666;stroke:none" style="fill:#555555" d="M0"/></svg>', f'<svg {BOX} color="#12ABef"><path d="M0" fill="#666666" stroke="none"></path></svg>'),
    # unsafe values leave what they would have replaced
    (f'{GIVEN}<path fill="#111111" style="fill:url(https://e.example/x);stroke:url(#g)" d="M0" onclick="x()"/></svg>', f'<svg {BOX}><path d="M0" fill="#111111" stroke="url(#g)"></path></svg>'),
    (f'{GIVEN}<path fill="var(--a, var(--b, #777777))" stroke="var(--c)" d="M0"/></svg>', f'<svg {BOX} color="#12ABef"><path d="M0" fill="#777777"></path></svg>'),
    (f'{GIVEN}<script>x()</script><foreignObject><path d="M1"/></foreignObject><image href="a.png"/><use href="other.svg#a"/><rect width="3"/></svg>', f'<svg {BOX}><use></use><rect width="3"></rect></svg>'),
    # nothing painted
    (f'{GIVEN}<path d="M0" fill="none"/></svg>', None),
    ('<svg fill="none"><g><path d="M0"/></g></svg>', None),
    (f'{GIVEN}<defs><path d="M0"/></defs><g opacity="0.0"><path d="M0"/></g><g style="display:none"><path d="M1"/></g><path d="M0" fill-opacity="0%"/></svg>', None),
    (f'{GIVEN}<g visibility="hidden"><path d="M0"/></g></svg>', None),
    (f'{GIVEN}<g visibility="hidden"><path d="M0" visibility="visible"/></g></svg>', f'<svg {BOX} color="#12ABef"><g visibility="hidden"><path d="M0" visibility="visible"></path></g></svg>'),
    ('<svg fill="none"><g stroke="red"><path d="M0"/></g></svg>', f'<svg {NS} fill="none"><g stroke="red"><path d="M0"></path></g></svg>'),
    # text, names, sizes
    (f'{GIVEN}<text x="1">A &amp; <tspan>b</tspan> c</text>loose</svg>', f'<svg {BOX} color="#12ABef"><text x="1">A &amp; <tspan>b</tspan> c</text></svg>'),
    ('<p>x</p><svg width="20px" height="10"><lineargradient id="g" gradientunits="userSpaceOnUse"><stop offset="0"/></lineargradient><path d="M0" fill="url(#g)"/></svg>', f'<svg {NS} viewBox="0 0 20 10" width="20" height="10"><linearGradient id="g" gradientUnits="userSpaceOnUse"><stop offset="0"></stop></linearGradient><path d="M0" fill="url(#g)"></path></svg>'),
    ('<svg width="100%" height="1em"><use xlink:href="#s"/><symbol id="s" viewBox="0 0 30 40"><path d="M0"/></symbol></svg>', f'<svg {NS} viewBox="0 0 30 40" width="30" height="40" color="#12ABef"><use href="#s"></use><symbol viewBox="0 0 30 40" id="s"><path d="M0"></path></symbol></svg>'),
    ("<svg><circle r='1' id='a\"b'></svg>", f"<svg {NS}><circle r=\"1\"></circle></svg>"),
    (None, None),
    ("", None),
    ("<p>no drawing</p>", None),
]


def test_clean_drawings(spark):
    for (given, want), got in zip(CASES, clean(spark, *[g for g, _ in CASES])):
        assert got == want, given


def test_no_drawing_is_cut(spark):
    many = f"{GIVEN}{'<path d=\"M0 0\"/>' * 3000}</svg>"
    deep = f"{GIVEN}{'<g>' * 60}<path d='M0'/>{'</g>' * 60}</svg>"
    long = f'{GIVEN}{"<path d=\"M0 0h10v10z\"/>" * 8000}</svg>'
    got = clean(spark, many, deep, long)
    assert got[0].count("<path") == 3000 and got[1].count("<g>") == 60 and "<path" in got[1] and got[2] is None
