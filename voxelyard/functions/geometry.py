"""Cameras, boxes, voxels and statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson_lower(k: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of Wilson's interval for k of n; n is 1 at least, k within [0, n]."""
    n = F.greatest(n.cast("double"), F.lit(1.0))
    p = F.least(F.greatest(k.cast("double"), F.lit(0.0)), n) / n
    z2 = z * z
    low = (p + z2 / (2 * n) - z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return F.least(F.greatest(low, F.lit(0.0)), F.lit(1.0))


def project(x: Column, y: Column, z: Column, fx, fy, cx, cy) -> tuple[Column, Column]:
    """Pixel of a point in camera axes; depth is floored in single precision, halves go to even. Null where it isn't finite."""
    d = F.greatest(z.cast("float").cast("double"), F.lit(1e-6))
    return F.rint(x * fx / d + cx).try_cast("long"), F.rint(y * fy / d + cy).try_cast("long")


def inside(u: Column, v: Column, z: Column, w, h) -> Column:
    return (z > 0) & (u >= 0) & (u < w) & (v >= 0) & (v < h)


def back_project(u: Column, v: Column, d: Column, fx, fy, cx, cy) -> tuple[Column, Column, Column]:
    return (u - cx) * d / fx, (v - cy) * d / fy, d


def apply_rigid(t: list, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """R p + t of a 4x4 matrix in row order (numbers or Columns)."""
    return tuple(t[4 * r] * x + t[4 * r + 1] * y + t[4 * r + 2] * z + t[4 * r + 3] for r in range(3))


def invert_rigid(t: list) -> list:
    """Transpose and turned-back translation."""
    r = [[t[4 * i + j] for j in range(3)] for i in range(3)]
    out = []
    for i in range(3):
        out += [r[0][i], r[1][i], r[2][i], -(r[0][i] * t[3] + r[1][i] * t[7] + r[2][i] * t[11])]
    return [*out, 0.0, 0.0, 0.0, 1.0]


def invert_general(t: list) -> list:
    """Inverse of an affine 4x4 matrix in row order whose 3x3 part need not be a rotation, by its adjugate."""
    m = [[t[4 * i + j] for j in range(3)] for i in range(3)]
    minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = m[0][0] * minor(0, 0) + m[0][1] * minor(0, 1) + m[0][2] * minor(0, 2)
    out = []
    for i in range(3):
        r = [minor(j, i) / det for j in range(3)]
        out += [*r, -(r[0] * t[3] + r[1] * t[7] + r[2] * t[11])]
    return [*out, 0.0, 0.0, 0.0, 1.0]


def rodrigues(ax: Column, ay: Column, az: Column) -> list[Column]:
    """Rotation matrix, row by row, of an angle-axis vector; the identity below 1e-12."""
    a = F.sqrt(ax * ax + ay * ay + az * az)
    tiny = a < 1e-12
    k = [F.when(tiny, 0.0).otherwise(v / a) for v in (ax, ay, az)]
    s, c = F.sin(a), 1 - F.cos(a)
    skew = [[None, (-1, 2), (1, 1)], [(1, 2), None, (-1, 0)], [(-1, 1), (1, 0), None]]
    out = []
    for i in range(3):
        for j in range(3):
            e = c * k[i] * k[j] + (F.cos(a) if i == j else s * k[skew[i][j][1]] * skew[i][j][0])
            out.append(F.when(tiny, float(i == j)).otherwise(e))
    return out


def voxel(*axes: tuple[Column, float]) -> list[Column]:
    return [F.floor(c / F.lit(size)).cast("long") for c, size in axes]


def box_volume(low: list, high: list) -> Column:
    out = F.lit(1.0)
    for a, b in zip(low, high, strict=True):
        out = out * F.greatest(b - a, F.lit(0.0))
    return out


def box_overlap(a: tuple[list, list], b: tuple[list, list]) -> tuple[Column, Column]:
    """IoU and the share of the smaller box; volumes and unions are 1e-12 at least."""
    inter = box_volume([F.greatest(x, y) for x, y in zip(a[0], b[0], strict=True)], [F.least(x, y) for x, y in zip(a[1], b[1], strict=True)])
    va, vb, tiny = box_volume(*a), box_volume(*b), F.lit(1e-12)
    return inter / F.greatest(va + vb - inter, tiny), inter / F.greatest(F.least(va, vb), tiny)
