"""Colours as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fnv1a

# Linear sRGB to XYZ (D65), and the white point.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
# Saturation and value of a node's colour.
SATURATION, VALUE = 0.75, 0.95


def hsv_to_rgb(h: Column, s: float = SATURATION, v: float = VALUE) -> list[Column]:
    """Red, green and blue within [0, 1]."""
    i = (F.floor(h * 6.0) % 6).cast("int")
    f = h * 6.0 - F.floor(h * 6.0)
    low, fall, rise, top = F.lit(v * (1.0 - s)), v * (1.0 - f * s), v * (1.0 - (1.0 - f) * s), F.lit(v)
    around = [(top, rise, low), (fall, top, low), (low, top, rise), (low, fall, top), (rise, low, top), (top, low, fall)]
    return [F.element_at(F.array(*[c[k] for c in around]), i + 1) for k in range(3)]


def node_colour(kind: Column, name: Column, inst: Column) -> list[Column]:
    """A colour that follows from a node's type, name and instance."""
    hue = fnv1a(F.concat_ws("|", kind, name, inst)).bitwiseAND(F.lit(65535).cast("long")) / 65536.0
    return hsv_to_rgb(hue)


def rgb_to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    """CIE Lab of sRGB values from 0 to 255."""
    unit = [c / 255.0 for c in (r, g, b)]
    linear = [F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))) for c in unit]
    xyz = [sum((m * c for m, c in zip(row, linear, strict=True)), F.lit(0.0)) / w for row, w in zip(TO_XYZ, WHITE, strict=True)]
    d = 6 / 29
    fx, fy, fz = (F.when(t > d**3, F.cbrt(t)).otherwise(t / (3 * d * d) + 4 / 29) for t in xyz)
    return [116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)]
