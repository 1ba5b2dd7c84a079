"""Polylines, rectangles and angles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filigree.functions.stats import array_sum, col

VOXEL = (2.0, 2.0, 2.0)
BORDER = 50


def squared(a: Column, b: Column, voxel: tuple = VOXEL) -> Column:
    """Squared distance of two points (z, y, x)."""
    return sum((((a[k] - b[k]) * s) * ((a[k] - b[k]) * s) for k, s in zip("zyx", voxel, strict=True)), F.lit(0.0))


def segments(pts: Column | str, voxel: tuple = VOXEL) -> Column:
    """Lengths between neighbouring points; empty for fewer than two."""
    p = col(pts)
    n = F.size(p)
    return F.when(n >= 2, F.zip_with(F.slice(p, 1, F.greatest(n - 1, F.lit(0))), F.slice(p, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.sqrt(squared(a, b, voxel)))).otherwise(F.array().cast("array<double>"))


def path_length(pts: Column | str, voxel: tuple = VOXEL) -> Column:
    return array_sum(segments(pts, voxel))


def chord(pts: Column | str, voxel: tuple = VOXEL) -> Column:
    p = col(pts)
    return F.sqrt(squared(F.get(p, F.lit(0)), F.get(p, F.size(p) - 1), voxel))


def tortuosity(path: Column, straight: Column) -> Column:
    """From 1 to 50."""
    return F.greatest(F.lit(1.0), F.least(F.lit(50.0), path / (straight + 1e-8)))


def orientation(dx: Column, dy: Column, axis: str = "x") -> Column:
    """Degrees from 0 to 90 to the device's axis, in the plane; NULL for a vector of no length."""
    norm = F.sqrt(dx * dx + dy * dy)
    along = F.abs(dx if axis == "x" else dy)
    return F.when(norm > 1e-8, F.degrees(F.acos(F.least(F.lit(1.0), along / norm))))


def device_axis(width: Column | str, height: Column | str) -> Column:
    return F.when(col(width) >= col(height), "x").otherwise("y")


def width(area: Column) -> Column:
    """Diameter of a circle of the same area."""
    return F.sqrt(4 * area / F.pi())


def elliptical_area(flat: Column | str, deep: Column | str) -> Column:
    return F.pi() * col(flat) * col(deep)


def near_border(pts: Column | str, ymax: Column | int, xmax: Column | int, margin: int = BORDER) -> Column:
    """Whether a point lies within the margin of the border in the plane."""
    return F.exists(col(pts), lambda p: (p["y"] < margin) | (p["y"] > F.lit(ymax) - margin) | (p["x"] < margin) | (p["x"] > F.lit(xmax) - margin))


def rotated(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """Coordinates along and across an axis at an angle."""
    return F.cos(angle) * x + F.sin(angle) * y, -F.sin(angle) * x + F.cos(angle) * y


def principal_angle(x: Column | str, y: Column | str) -> Column:
    """An aggregate: the direction of greatest extent of points."""
    return 0.5 * F.atan2(2 * F.covar_pop(x, y), F.var_pop(x) - F.var_pop(y))


def ordered_corners(corners: Column | str) -> Column:
    """Corners (x, y) by angle about their centre, from the one with the least x + y on."""
    c = col(corners)
    n = F.size(c)
    cx = F.aggregate(c, F.lit(0.0), lambda a, p: a + p["x"]) / n
    cy = F.aggregate(c, F.lit(0.0), lambda a, p: a + p["y"]) / n
    turned = F.transform(F.array_sort(F.transform(c, lambda p: F.struct(F.atan2(p["y"] - cy, p["x"] - cx).alias("t"), p["x"].alias("x"), p["y"].alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    sums = F.transform(turned, lambda p: p["x"] + p["y"])
    at = F.array_position(sums, F.array_min(sums)).cast("int")
    return F.concat(F.slice(turned, at, n - at + 1), F.slice(turned, F.lit(1), at - 1))


def expanded(corners: Column | str, dx: float, dy: float) -> Column:
    """Four ordered corners moved outwards by dx along the first side and dy along the second."""
    c = col(corners)
    a, b, d = c[0], c[1], c[3]
    ul, vl = F.sqrt((b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2), F.sqrt((d["x"] - a["x"]) ** 2 + (d["y"] - a["y"]) ** 2)
    ux, uy, vx, vy = (b["x"] - a["x"]) / ul, (b["y"] - a["y"]) / ul, (d["x"] - a["x"]) / vl, (d["y"] - a["y"]) / vl
    signs = ((-1, -1), (1, -1), (1, 1), (-1, 1))
    return F.array(*(F.struct((c[i]["x"] + s * dx * ux + t * dy * vx).alias("x"), (c[i]["y"] + s * dx * uy + t * dy * vy).alias("y")) for i, (s, t) in enumerate(signs)))


def touches_border(corners: Column | str, ymax: int, xmax: int, margin: float = 1.0) -> Column:
    return F.exists(col(corners), lambda p: (p["x"] <= margin) | (p["y"] <= margin) | (p["x"] >= xmax - 1 - margin) | (p["y"] >= ymax - 1 - margin))
