"""Colour arithmetic as column expressions: CDF ranks, OKLCH, hex, hue distance."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetry.runtime import clamp, let

# Chroma and lightness ranges and the fallback colour.
CHROMA_LOW, CHROMA_SPAN, CHROMA_HIGH = 0.10, 0.36, 0.46
LIGHT_LOW, LIGHT_SPAN, LIGHT_HIGH, LIGHT_GAMMA = 0.45, 0.45, 0.90, 0.55
NO_COLOR = "#cccccc"
GAMUT_EPS = 5e-4
GAMUT_STEPS = 18

# The published OKLab matrices.
LAB_TO_LMS = (
    (0.3963377774, 0.2158037573),
    (-0.1055613458, -0.0638541728),
    (-0.0894841775, -1.2914855480),
)
LMS_TO_RGB = (
    (4.0767416621, -3.3077115913, 0.2309699292),
    (-1.2684380046, 2.6097574011, -0.3413193965),
    (-0.0041960863, -0.7034186147, 1.7076147010),
)
RGB_TO_LMS = (
    (0.4122214708, 0.5363325363, 0.0514459929),
    (0.2119034982, 0.6806995451, 0.1073969566),
    (0.0883024619, 0.2817188376, 0.6299787005),
)
LMS_TO_LAB = (
    (0.2104542553, 0.7936177850, -0.0040720468),
    (1.9779984951, -2.4285922050, 0.4505937099),
    (0.0259040371, 0.7827717662, -0.8086757660),
)


def count_below(points: Column, value: Column, inclusive: bool = False) -> Column:
    """How many of the ascending points lie below ``value``.

    Halving search: as many probes as the number of points has binary digits.
    """
    digits = F.length(F.bin(F.greatest(F.size(points), F.lit(1)).cast("bigint")))
    steps = F.transform(F.sequence(digits - 1, F.lit(0), F.lit(-1)), lambda b: F.call_function("shiftleft", F.lit(1), b))

    def probe(count, step):
        at = F.try_element_at(points, count + step)
        low = (at <= value) if inclusive else (at < value)
        return F.when(F.coalesce(low, F.lit(False)), count + step).otherwise(count)

    return F.aggregate(steps, F.lit(0), probe)


def _between(points: Column, upper: Column, value: Column) -> Column:
    """Rank of ``value`` on the segment that ends at 0-based index ``upper``."""
    low = F.try_element_at(points, upper)
    high = F.try_element_at(points, upper + 1)
    share = F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))
    return (upper - 1 + share) / (F.size(points) - 1)


def equalize_radius(value: Column, points: Column) -> Column:
    """Rank of a value in a CDF: lower bound plus linear interpolation.

    Values above the last point continue the last segment and may pass 1.
    """
    def rank(v: Column) -> Column:
        upper = F.least(count_below(points, v), F.size(points) - 1)
        return let(upper, lambda u: F.when(u > 0, _between(points, u, v)).otherwise(F.lit(0.0)))

    return F.when(value.isNotNull() & points.isNotNull(), let(value, rank))


def equalize_angle(value: Column, points: Column) -> Column:
    return equalize_radius(value, points) * (2 * math.pi)


def equalize_signed(value: Column, points: Column) -> Column:
    """Clamped rank, right-continuous where the CDF is flat."""
    last = F.size(points) - 1

    def rank(v: Column) -> Column:
        upper = F.least(count_below(points, v, inclusive=True), last)
        return (F.when(v <= F.element_at(points, 1), F.lit(0.0)).when(v >= F.element_at(points, -1), F.lit(1.0))
                .otherwise(let(upper, lambda u: _between(points, u, v))))

    return let(value, rank)


def hue_degrees(azimuth: Column, points: Column | None) -> Column:
    turned = azimuth if points is None else F.coalesce(equalize_angle(azimuth, points), azimuth)
    return F.pmod(turned * (180.0 / math.pi), F.lit(360.0))


def chroma_of_rank(rank: Column) -> Column:
    return clamp(CHROMA_LOW + CHROMA_SPAN * rank, CHROMA_LOW, CHROMA_HIGH)


def lightness_of_rank(rank: Column) -> Column:
    return clamp(LIGHT_LOW + LIGHT_SPAN * F.pow(rank, F.lit(LIGHT_GAMMA)), LIGHT_LOW, LIGHT_HIGH)


def _linear_rgb(light: Column, chroma: Column, cos_h: Column, sin_h: Column) -> list[Column]:
    a, b = chroma * cos_h, chroma * sin_h
    lms = [light + ka * a + kb * b for ka, kb in LAB_TO_LMS]
    cubes = [v * v * v for v in lms]
    return [sum((k * c for k, c in zip(row[1:], cubes[1:])), row[0] * cubes[0]) for row in LMS_TO_RGB]


def oklch_to_linear_rgb(light: Column, chroma: Column, hue_deg: Column) -> Column:
    hue = F.radians(hue_deg)
    r, g, b = _linear_rgb(light, chroma, F.cos(hue), F.sin(hue))
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))


def _in_gamut(light: Column, chroma: Column, cos_h: Column, sin_h: Column, eps: float) -> Column:
    channels = _linear_rgb(light, chroma, cos_h, sin_h)
    inside = [c.between(-eps, 1 + eps) for c in channels]
    return inside[0] & inside[1] & inside[2]


def _polar(light: Column, chroma: Column, hue_deg: Column, body) -> Column:
    """Run ``body`` on a struct (l, c, cos, sin) that is computed once."""
    hue = F.radians(hue_deg)
    return let(F.struct(light.alias("l"), chroma.alias("c"), F.cos(hue).alias("cos"), F.sin(hue).alias("sin")), body)


def _fitted(p: Column, eps: float) -> Column:
    fits = lambda chroma: _in_gamut(p["l"], chroma, p["cos"], p["sin"], eps)

    def halve(acc, _):
        return let((acc["lo"] + acc["hi"]) / 2, lambda mid: let(fits(mid), lambda ok: F.struct(
            F.when(ok, mid).otherwise(acc["lo"]).alias("lo"), F.when(ok, acc["hi"]).otherwise(mid).alias("hi"))))

    start = F.struct(F.lit(0.0).alias("lo"), p["c"].alias("hi"))
    steps = F.array_repeat(F.lit(0), GAMUT_STEPS)
    return F.when(fits(p["c"]), p["c"]).otherwise(F.aggregate(steps, start, halve, lambda acc: acc["lo"]))


def fit_chroma(light: Column, chroma: Column, hue_deg: Column, eps: float = GAMUT_EPS) -> Column:
    """Largest chroma (18 halvings) at which the colour is displayable."""
    return _polar(light, chroma, hue_deg, lambda p: _fitted(p, eps))


def _byte_hex(linear: Column) -> Column:
    x = clamp(linear, 0.0, 1.0)
    encoded = F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)
    return F.lpad(F.lower(F.hex(F.bround(encoded * 255, 0).cast("int"))), 2, "0")


def oklch_to_hex(light: Column, chroma: Column, hue_deg: Column, eps: float = GAMUT_EPS) -> Column:
    def text(p: Column) -> Column:
        rgb = let(_fitted(p, eps), lambda c: F.array(*_linear_rgb(p["l"], c, p["cos"], p["sin"])))
        return F.concat(F.lit("#"), F.array_join(F.transform(rgb, lambda v: _byte_hex(v)), ""))

    known = light.isNotNull() & chroma.isNotNull() & hue_deg.isNotNull()
    return F.when(known, _polar(light, chroma, hue_deg, text))


def hex_channels(color: Column) -> list[Column]:
    return [
        F.conv(F.substring(color, at, 2), 16, 10).cast("double") / 255 for at in (2, 4, 6)
    ]


def _decode(channel: Column) -> Column:
    return F.when(channel <= 0.04045, channel / 12.92).otherwise(
        F.pow((channel + 0.055) / 1.055, F.lit(2.4))
    )


def _mix(matrix, values: Column) -> Column:
    return F.array(*[row[0] * values[0] + row[1] * values[1] + row[2] * values[2] for row in matrix])


def hex_to_oklab(color: Column) -> Column:
    rgb = F.transform(F.array(*hex_channels(color)), lambda c: _decode(c))
    lms = let(rgb, lambda v: F.transform(_mix(RGB_TO_LMS, v), lambda x: F.cbrt(x)))
    lab = let(lms, lambda v: _mix(LMS_TO_LAB, v))
    return let(lab, lambda v: F.struct(v[0].alias("L"), v[1].alias("a"), v[2].alias("b")))


def oklab_to_hex(light: Column, a: Column, b: Column, eps: float = 0.0) -> Column:
    """Hex of an OKLab colour, chroma reduced at fixed hue and lightness when needed."""
    return oklch_to_hex(light, F.hypot(a, b), F.degrees(F.atan2(b, a)), eps)


def hue_diff(a: Column, b: Column) -> Column:
    """Smallest angle between two hues in degrees, 0 to 180."""
    turn = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(turn, 360.0 - turn)


def luminance(color: Column) -> Column:
    """Relative luminance of a hex colour."""
    r, g, b = [_decode(c) for c in hex_channels(color)]
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def label_color(color: Column) -> Column:
    return F.when(luminance(color) > 0.35, F.lit("#000")).otherwise(F.lit("#fff"))


def delta_e_ok(a: Column, b: Column) -> Column:
    """Euclidean distance of two OKLab structs."""
    return F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in ("a", "b")), (a["L"] - b["L"]) * (a["L"] - b["L"])))


def legacy_color(u: Column, v: Column, w: Column, hue_deg: Column, radius: Column | None = None) -> Column:
    """Older report colour: exponential chroma, linear lightness; struct of hex and parts."""
    spread = 1.0 - F.exp(-2.5 * (F.hypot(u, v) if radius is None else radius))
    boost = 0.10 * (1.0 - F.exp(-2.0 * F.abs(w)))
    chroma = clamp(0.12 + 0.26 * spread + boost, 0.12, 0.38)
    light = clamp(0.62 + 0.18 * w, 0.54, 0.82)
    return F.struct(
        oklch_to_hex(light, chroma, hue_deg, 0.0).alias("color"),
        light.alias("lightness"), chroma.alias("chroma"), hue_deg.alias("hue_deg"),
    )
