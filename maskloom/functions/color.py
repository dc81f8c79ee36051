"""Colour space columns over r, g, b in 0..255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luminance weights, sRGB to XYZ matrix (D65) and reference white.
LUMA = (0.2125, 0.7154, 0.0721)
LUMA_601 = (0.299, 0.587, 0.114)
XYZ_FROM_RGB = (
    (0.412453, 0.357580, 0.180423),
    (0.212671, 0.715160, 0.072169),
    (0.019334, 0.119193, 0.950227),
)
WHITE_D65 = (0.95047, 1.0, 1.08883)


def unit(channel: Column) -> Column:
    return channel.cast("double") / F.lit(255.0)


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luminance in [0, 1] from byte channels."""
    return unit(r) * LUMA[0] + unit(g) * LUMA[1] + unit(b) * LUMA[2]


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    red, green, blue = unit(r), unit(g), unit(b)
    top, bottom = F.greatest(red, green, blue), F.least(red, green, blue)
    span = top - bottom
    safe = F.nullif(span, F.lit(0.0))
    # The last matching channel wins, so blue is tested first.
    turn = (
        F.when(blue == top, F.lit(4.0) + (red - green) / safe)
        .when(green == top, F.lit(2.0) + (blue - red) / safe)
        .otherwise((green - blue) / safe)
    )
    hue = F.coalesce(F.pmod(turn / 6.0, F.lit(1.0)), F.lit(0.0))
    saturation = F.coalesce(span / F.nullif(top, F.lit(0.0)), F.lit(0.0))
    return hue, saturation, top


def _linear(channel: Column) -> Column:
    return F.when(channel > 0.04045, F.pow((channel + 0.055) / 1.055, F.lit(2.4))).otherwise(channel / 12.92)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    linear = [_linear(unit(c)) for c in (r, g, b)]
    bent = []
    for weights, white in zip(XYZ_FROM_RGB, WHITE_D65):
        ratio = (linear[0] * weights[0] + linear[1] * weights[1] + linear[2] * weights[2]) / white
        bent.append(
            F.when(ratio > 0.008856, F.cbrt(ratio)).otherwise(ratio * 7.787 + 16.0 / 116.0)
        )
    x, y, z = bent
    return y * 116.0 - 16.0, (x - y) * 500.0, (y - z) * 200.0


def rgb_from_hsv(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Inverse of :func:`hsv`, unit range."""
    sector = F.floor(h * 6.0)
    frac = h * 6.0 - sector
    p, q, t = v * (F.lit(1.0) - s), v * (F.lit(1.0) - frac * s), v * (F.lit(1.0) - (F.lit(1.0) - frac) * s)
    k = F.pmod(sector, F.lit(6)).cast("int")

    def pick(*choices: Column) -> Column:
        return F.element_at(F.array(*choices), k + 1)

    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)
