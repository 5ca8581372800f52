"""Colour arithmetic on "#RRGGBB" columns: WCAG luminance and contrast, CIELAB, distances. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenloom.functions.text import let

# sRGB to linear light, luminance weights, D65 white, WCAG thresholds.
KNEE, SLOPE, OFFSET, GAMMA = 0.04045, 12.92, 0.055, 2.4
LUMINANCE = (0.2126, 0.7152, 0.0722)
TO_X, TO_Z = (0.4124, 0.3576, 0.1805), (0.0193, 0.1192, 0.9505)
WHITE_X, WHITE_Z = 0.95047, 1.08883
LEVELS = ((7.0, "AAA"), (4.5, "AA"), (3.0, "AA-large"))


def rgb(code: Column) -> Column:
    """array<int> of the three channels; null for anything but #RRGGBB."""
    channel = lambda at: F.conv(F.substring(code, at, 2), 16, 10).cast("int")
    return F.when(code.rlike("^#[0-9A-Fa-f]{6}$"), F.array(channel(2), channel(4), channel(6)))


def linear(channel: Column) -> Column:
    c = channel / 255
    return F.when(c <= KNEE, c / SLOPE).otherwise(F.pow((c + OFFSET) / (1 + OFFSET), F.lit(GAMMA)))


def _linear_rgb(code: Column) -> Column:
    return F.transform(rgb(code), linear)


def _dot(channels: Column, weights: tuple[float, float, float]) -> Column:
    return sum((channels[i] * w for i, w in enumerate(weights)), F.lit(0.0))


def luminance(code: Column) -> Column:
    return let(_linear_rgb(code), lambda c: _dot(c, LUMINANCE))


def ratio_of_luminances(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def contrast_ratio(a: Column, b: Column) -> Column:
    return ratio_of_luminances(luminance(a), luminance(b))


def wcag_level(ratio: Column) -> Column:
    level = F.lit("fail")
    for least, name in reversed(LEVELS):
        level = F.when(ratio >= least, F.lit(name)).otherwise(level)
    return F.when(ratio.isNotNull(), level)


def lab(code: Column) -> Column:
    """struct<l,a,b> under D65."""
    f = lambda t: F.when(t > (6 / 29) ** 3, F.pow(t, F.lit(1 / 3))).otherwise(t / (3 * (6 / 29) ** 2) + 4 / 29)
    white = lambda c: F.array(_dot(c, TO_X) / WHITE_X, _dot(c, LUMINANCE), _dot(c, TO_Z) / WHITE_Z)
    bent = F.transform(let(_linear_rgb(code), white), f)
    return let(bent, lambda v: F.struct((116 * v[1] - 16).alias("l"), (500 * (v[0] - v[1])).alias("a"), (200 * (v[1] - v[2])).alias("b")))


def distance(p: Column, q: Column) -> Column:
    """CIE76 distance of two lab structs."""
    return F.sqrt(F.pow(p["l"] - q["l"], 2) + F.pow(p["a"] - q["a"], 2) + F.pow(p["b"] - q["b"], 2))


def delta_e(a: Column, b: Column) -> Column:
    return let(F.struct(lab(a).alias("p"), lab(b).alias("q")), lambda s: distance(s["p"], s["q"]))


def chroma(code: Column) -> Column:
    return let(lab(code), lambda p: F.hypot(p["a"], p["b"]))


def lightness(code: Column) -> Column:
    return lab(code)["l"]


def six_digits(code: Column) -> Column:
    """#FA4 -> #FFAA44, in upper case."""
    return F.upper(F.regexp_replace(code, "^#(.)(.)(.)$", "#$1$1$2$2$3$3"))


def svg_colours(markup: Column) -> Column:
    """Distinct colours of fill, stroke and stop-color, in order of first sight."""
    pattern = r"""(?i)(?:fill|stroke|stop-color)\s*[:=]\s*["']?\s*(#[0-9a-f]{6}|#[0-9a-f]{3})(?![0-9a-f])"""
    return F.array_distinct(F.transform(F.regexp_extract_all(markup, F.lit(pattern), F.lit(1)), six_digits))


def css_to_hex(value: Column) -> Column:
    """#RGB, #RRGGBB or rgb(a) text to #RRGGBB over white; null for anything else or fully transparent."""
    parts = F.regexp_extract_all(value, F.lit(r"([0-9.]+)"), F.lit(1))
    alpha = F.coalesce(F.get(parts, F.lit(3)).try_cast("double"), F.lit(1.0))
    over = lambda i: F.floor(F.get(parts, F.lit(i)).try_cast("double") * alpha + 255 * (1 - alpha) + 0.5).cast("int")
    hexed = F.concat(F.lit("#"), *[F.lpad(F.hex(over(i)), 2, "0") for i in range(3)])
    return F.when(value.rlike("^#([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6})$"), six_digits(value)).when(value.rlike(r"^rgba?\("), F.when(alpha > 0, hexed))
