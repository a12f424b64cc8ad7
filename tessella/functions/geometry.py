"""2-D geometry: column expressions for points, lines and segments, and polygons as arrays of (x, y)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Columns: a point is struct<x, y>, a line is two points, a polygon array<struct<x, y>>.


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def _cross(ax, ay, bx, by):
    return ax * by - ay * bx


def line_coordinate(p: Column, a: Column, b: Column) -> Column:
    """How far along the line through a and b, from a, the foot of p lies."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(F.hypot(dx, dy), F.lit(0.0))


def line_intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where the lines ab and cd meet; null if they are parallel."""
    ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    det = _cross(ux, uy, vx, vy)
    t = _cross(c["x"] - a["x"], c["y"] - a["y"], vx, vy) / F.nullif(det, F.lit(0.0))
    return F.when(F.abs(det) >= 1e-8, F.struct((a["x"] + t * ux).alias("x"), (a["y"] + t * uy).alias("y")))


def _within(p: Column, a: Column, b: Column) -> Column:
    """Whether a point of the line through a and b lies between them."""
    s = line_coordinate(p, a, b)
    return (s >= 0) & (s <= distance(a, b))


def segment_line_intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where the segment ab meets the line cd; null off the segment."""
    p = line_intersection(a, b, c, d)
    return F.when(_within(p, a, b), p)


def segment_intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    p = line_intersection(a, b, c, d)
    return F.when(_within(p, a, b) & _within(p, c, d), p)


def closest_on_segment(p: Column, a: Column, b: Column) -> Column:
    length = distance(a, b)
    s = F.least(F.greatest(line_coordinate(p, a, b), F.lit(0.0)), length) / F.nullif(length, F.lit(0.0))
    at = F.struct((a["x"] + s * (b["x"] - a["x"])).alias("x"), (a["y"] + s * (b["y"] - a["y"])).alias("y"))
    return F.when(length == 0, a).otherwise(at)


def _next(poly: Column) -> Column:
    return F.concat(F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), F.slice(poly, 1, 1))


def signed_area(poly: Column) -> Column:
    """Positive for a counter-clockwise polygon (y up)."""
    return F.aggregate(F.zip_with(poly, _next(poly), lambda p, q: _cross(p["x"], p["y"], q["x"], q["y"])), F.lit(0.0), lambda s, x: s + x) / 2


def make_ccw(poly: Column) -> Column:
    return F.when(signed_area(poly) < 0, F.reverse(poly)).otherwise(poly)


def contains_point(poly: Column, p: Column) -> Column:
    """Whether an odd number of sides lies to the right of p."""

    def crossed(a, b):
        spans = (a["y"] > p["y"]) != (b["y"] > p["y"])
        at = (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return F.when(spans & (p["x"] < at), 1).otherwise(0)

    return F.aggregate(F.zip_with(poly, _next(poly), crossed), F.lit(0), lambda s, x: s + x) % 2 == 1


def polygons_intersect(p: Column, q: Column) -> Column:
    """Whether any side of one crosses a side of the other."""
    sides = lambda poly: F.zip_with(poly, _next(poly), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.exists(sides(p), lambda s: F.exists(sides(q), lambda t: segment_intersection(s["a"], s["b"], t["a"], t["b"]).isNotNull()))


def interior_point(poly: Column) -> Column:
    """The mean of the first three corners: inside a convex polygon."""
    three = F.slice(poly, 1, 3)
    mean = [((F.element_at(three, 1)[c] + F.element_at(three, 2)[c] + F.element_at(three, 3)[c]) / 3).alias(c) for c in ("x", "y")]
    return F.struct(*mean)


def contains_polygon(p: Column, q: Column) -> Column:
    return ~polygons_intersect(p, q) & contains_point(p, F.element_at(q, 1))


def overlaps(p: Column, q: Column) -> Column:
    return polygons_intersect(p, q) | contains_point(p, interior_point(q)) | contains_point(q, interior_point(p))


def closest_on_boundary(poly: Column, p: Column) -> Column:
    near = F.zip_with(poly, _next(poly), lambda a, b: closest_on_segment(p, a, b))
    return F.array_min(F.transform(near, lambda c: F.struct(distance(c, p).alias("d"), c.alias("p"))))["p"]


def row_crossings(poly: Column, y: Column) -> Column:
    """The x at which a polygon's sides cross a row, ascending."""

    def at(a, b):
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans, a["x"] + (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)))

    return F.array_sort(F.array_compact(F.zip_with(poly, _next(poly), at)))


# Plain versions for use inside kernels.


def _sides_cross(a, b, c, d) -> bool:
    u, v, w = b - a, d - c, c - a
    det = u[0] * v[1] - u[1] * v[0]
    if abs(det) < 1e-8:
        return False
    s, t = (w[0] * v[1] - w[1] * v[0]) / det, (w[0] * u[1] - w[1] * u[0]) / det
    return 0 <= s <= 1 and 0 <= t <= 1


def inside(poly: np.ndarray, p: np.ndarray) -> bool:
    a, b = poly, np.roll(poly, -1, axis=0)
    spans = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((spans & (p[0] < x)).sum() % 2)


def polygons_overlap(p: np.ndarray, q: np.ndarray) -> bool:
    if (p.max(0) < q.min(0)).any() or (q.max(0) < p.min(0)).any():
        return False
    n, m = len(p), len(q)
    if any(_sides_cross(p[i], p[(i + 1) % n], q[j], q[(j + 1) % m]) for i in range(n) for j in range(m)):
        return True
    return inside(p, q[:3].mean(0)) or inside(q, p[:3].mean(0))


def overlaps_many(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which polygons of p (polygons x corners x 2) overlap the polygon q; a polygon with fewer corners repeats its last one."""
    a, c = p[:, :, None], q[None, None]
    u, v, w = np.roll(p, -1, axis=1)[:, :, None] - a, np.roll(q, -1, axis=0)[None, None] - c, c - a
    det = u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        s, t = (w[..., 0] * v[..., 1] - w[..., 1] * v[..., 0]) / det, (w[..., 0] * u[..., 1] - w[..., 1] * u[..., 0]) / det
        crossed = (np.abs(det) >= 1e-8) & (0 <= s) & (s <= 1) & (0 <= t) & (t <= 1)
    return crossed.any(axis=(1, 2)) | _inside_many(p, _mean(q[None])) | _inside_many(q[None], _mean(p))


def _mean(p: np.ndarray) -> np.ndarray:
    return (p[:, 0] + p[:, 1] + p[:, 2]) / 3


def _inside_many(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    a, b, x, y = p, np.roll(p, -1, axis=1), at[:, None, 0], at[:, None, 1]
    spans = (a[..., 1] > y) != (b[..., 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = (b[..., 0] - a[..., 0]) * (y - a[..., 1]) / (b[..., 1] - a[..., 1]) + a[..., 0]
    return (spans & (x < cut)).sum(axis=1) % 2 == 1


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull without collinear points (monotone chain)."""
    p = sorted(set(map(tuple, np.asarray(points, float).tolist())))
    if len(p) < 3:
        return np.array(p)

    def half(seq):
        out: list = []
        for c in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(c)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))
