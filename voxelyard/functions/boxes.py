"""Image boxes, distances and checks of transforms as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(box: list) -> Column:
    """Area of (x0, y0, x1, y1); turned sides count as 0."""
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def clamped(box: list, w: int, h: int) -> list[Column]:
    """Whole pixels around a box, within the image; nulls where nothing is left."""
    low = [F.least(F.greatest(F.floor(v).cast("long"), F.lit(0)), F.lit(m - 1)) for v, m in zip(box[:2], (w, h), strict=True)]
    high = [F.least(F.greatest(F.ceil(v).cast("long"), F.lit(0)), F.lit(m - 1)) for v, m in zip(box[2:], (w, h), strict=True)]
    some = (high[0] > low[0]) & (high[1] > low[1])
    return [F.when(some, v) for v in (*low, *high)]


def visible_ratio(box: list, w: int, h: int) -> Column:
    """Share of a box that the image shows, from 0 to 1; 0 where nothing is left."""
    seen = area(clamped(box, w, h)) / F.greatest(area(box), F.lit(1e-12))
    return F.coalesce(F.least(F.greatest(seen, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def distance(a: list, b: list, weights: tuple = (1.0, 1.0, 1.0)) -> Column:
    """Weighted Euclidean distance; a weight of 0 leaves an axis out."""
    return F.sqrt(sum(((x - y) ** 2 * w for x, y, w in zip(a, b, weights, strict=True) if w), F.lit(0.0)))


def within_axes(a: list, b: list, most: tuple) -> Column:
    """Whether each axis differs by less than its limit."""
    return reduce(Column.__and__, [F.abs(x - y) < m for x, y, m in zip(a, b, most, strict=True)])


def is_rotation(r: list, least_det: float = 0.01, most_off: float = 0.1) -> Column:
    """Whether a 3x3 matrix in row order is close to orthogonal and not flat."""
    det = sum((r[i] * (r[3 + (i + 1) % 3] * r[6 + (i + 2) % 3] - r[3 + (i + 2) % 3] * r[6 + (i + 1) % 3]) for i in range(3)), F.lit(0.0))
    off = [F.abs(sum((r[3 * k + i] * r[3 * k + j] for k in range(3)), F.lit(0.0)) - float(i == j)) for i in range(3) for j in range(i, 3)]
    return (F.abs(det) >= least_det) & (F.greatest(*off) <= most_off)


def distance_scaled(a: list, b: list, scale: tuple) -> Column:
    """Euclidean distance with each axis divided by its scale."""
    return F.sqrt(sum((((x - y) / s) ** 2 for x, y, s in zip(a, b, scale, strict=True)), F.lit(0.0)))


def mahalanobis(a: list, b: list, inverse: list) -> Column:
    """Distance under a symmetric 3x3 inverse covariance given as xx, xy, xz, yy, yz, zz."""
    d = [x - y for x, y in zip(a, b, strict=True)]
    xx, xy, xz, yy, yz, zz = inverse
    return F.sqrt(d[0] * d[0] * xx + d[1] * d[1] * yy + d[2] * d[2] * zz + 2 * (d[0] * d[1] * xy + d[0] * d[2] * xz + d[1] * d[2] * yz))


def inverse_symmetric(m: list) -> list[Column]:
    """Inverse of a symmetric 3x3 matrix, both as xx, xy, xz, yy, yz, zz."""
    a, b, c, d, e, f = m
    det = a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)
    return [(d * f - e * e) / det, (c * e - b * f) / det, (b * e - c * d) / det, (a * f - c * c) / det, (b * c - a * e) / det, (a * d - b * b) / det]


def hybrid_near(a: list, b: list, most_plane: float, most_height: float) -> Column:
    return (distance(a, b, (1.0, 1.0, 0.0)) < most_plane) & (F.abs(a[2] - b[2]) < most_height)


def iou(a: list, b: list) -> Column:
    """Intersection over union of image boxes (x0, y0, x1, y1); 0 where they don't meet."""
    inter = area([F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])])
    whole = area(a) + area(b) - inter
    return F.when((inter > 0) & (whole > 0), inter / whole).otherwise(F.lit(0.0))


def centre_size(box: list, w, h) -> list[Column]:
    """Centre and size of a box, as shares of the image."""
    return [(box[0] + box[2]) / 2.0 / w, (box[1] + box[3]) / 2.0 / h, (box[2] - box[0]) / w, (box[3] - box[1]) / h]


def around_point(x: Column, y: Column, w: int, h: int, radius: float = 8.0) -> list[Column]:
    """The box of a radius around a point, within the image."""
    return [F.greatest(x - radius, F.lit(0.0)), F.greatest(y - radius, F.lit(0.0)), F.least(x + radius, F.lit(float(w - 1))), F.least(y + radius, F.lit(float(h - 1)))]


def in_pixels(box: list, w: int, h: int) -> list[Column]:
    """A box in pixels: as it is if all of it lies in the image, or else from a scale of 1000."""
    inside = reduce(Column.__and__, [(v >= 0) & (v <= m) for v, m in zip(box, (w, h, w, h), strict=True)])
    return [F.when(inside, v.cast("double")).otherwise(v / 1000.0 * m) for v, m in zip(box, (w, h, w, h), strict=True)]
