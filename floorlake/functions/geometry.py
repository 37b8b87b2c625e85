"""Planar geometry as Column expressions. Points are struct<x,y>, polygons array<struct<x,y>>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

TINY = 1e-12


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def _c(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def box_polygon(x0, y0, x1, y1) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def edges(polygon: Column) -> Column:
    """Each vertex with the next one, the last closing the ring."""
    following = F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))
    return F.zip_with(polygon, following, lambda a, b: F.struct(
        a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))


def _sum(array: Column, term) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, e: acc + term(e))


def _cross(e: Column) -> Column:
    return e["x0"] * e["y1"] - e["x1"] * e["y0"]


def polygon_area(polygon: Column) -> Column:
    return F.when(F.size(polygon) < 3, 0.0).otherwise(F.abs(_sum(edges(polygon), _cross)) / 2)


def polygon_centroid(polygon: Column) -> Column:
    """Area centroid; the mean vertex for a degenerate ring."""
    n = F.greatest(F.size(polygon), F.lit(1))
    mean_x = F.aggregate(polygon, F.lit(0.0), lambda a, p: a + p["x"]) / n
    mean_y = F.aggregate(polygon, F.lit(0.0), lambda a, p: a + p["y"]) / n

    def moments(ring: Column) -> Column:
        return F.struct((_sum(ring, _cross) / 2).alias("signed"), _sum(ring, lambda e: (e["x0"] + e["x1"]) * _cross(e)).alias("x"),
                        _sum(ring, lambda e: (e["y0"] + e["y1"]) * _cross(e)).alias("y"))

    def middle(m: Column) -> Column:
        flat = F.when(F.size(polygon) < 3, 0.0).otherwise(F.abs(m["signed"])) < 1e-9
        return point(F.when(flat, mean_x).otherwise(m["x"] / (6 * m["signed"])), F.when(flat, mean_y).otherwise(m["y"] / (6 * m["signed"])))

    return let(let(edges(polygon), moments), middle)


def in_polygon(x, y, polygon: Column) -> Column:
    x, y = _c(x), _c(y)

    def toggles(e: Column) -> Column:
        rise = e["y1"] - e["y0"]
        spans = (e["y0"] > y) != (e["y1"] > y)
        at = e["x0"] + (e["x1"] - e["x0"]) * (y - e["y0"]) / F.when(F.abs(rise) > TINY, rise)
        return F.coalesce(spans & (x < at), F.lit(False))

    inside = F.aggregate(edges(polygon), F.lit(False), lambda acc, e: acc != toggles(e))
    return (F.size(polygon) >= 3) & inside


def segment_fraction(x, y, ax, ay, bx, by) -> Column:
    """Position along a-b of the point closest to (x, y), clamped to 0..1; 0 for a zero-length segment."""
    x, y, ax, ay, bx, by = map(_c, (x, y, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = ((x - ax) * dx + (y - ay) * dy) / F.when(square >= TINY, square)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))


def segment_distance(x, y, ax, ay, bx, by) -> Column:
    x, y, ax, ay, bx, by = map(_c, (x, y, ax, ay, bx, by))
    t = segment_fraction(x, y, ax, ay, bx, by)
    return F.hypot(x - (ax + t * (bx - ax)), y - (ay + t * (by - ay)))


def polygon_nearest(x, y, polygon: Column) -> Column:
    """struct(distance, x, y) of the boundary point closest to (x, y)."""
    x, y = _c(x), _c(y)

    def closest(e: Column) -> Column:
        at = let(segment_fraction(x, y, e["x0"], e["y0"], e["x1"], e["y1"]), lambda t: point(e["x0"] + t * (e["x1"] - e["x0"]), e["y0"] + t * (e["y1"] - e["y0"])))
        return let(at, lambda p: F.struct(F.hypot(x - p["x"], y - p["y"]).alias("distance"), p["x"].alias("x"), p["y"].alias("y")))

    return F.array_min(F.transform(edges(polygon), closest))


def polygon_distance(x, y, polygon: Column) -> Column:
    x, y = _c(x), _c(y)
    return F.array_min(F.transform(edges(polygon), lambda e: segment_distance(x, y, e["x0"], e["y0"], e["x1"], e["y1"])))


def clamp_inside(x, y, polygon: Column, margin) -> Column:
    """The point itself when it is inside by ``margin``, else the boundary point moved in towards the centroid."""
    margin = _c(margin)

    def inwards(near: Column, centre: Column) -> Column:
        dx, dy = centre["x"] - near["x"], centre["y"] - near["y"]
        step = let(F.hypot(dx, dy), lambda length: F.when(length < 1e-9, 0.0).otherwise(margin / length))
        return let(step, lambda s: point(near["x"] + dx * s, near["y"] + dy * s))

    def settled(p: Column, near: Column) -> Column:
        keep = in_polygon(p["x"], p["y"], polygon) & (near["distance"] >= margin)
        return F.when(keep, p).otherwise(let(polygon_centroid(polygon), lambda centre: inwards(near, centre)))

    return let(point(x, y), lambda p: let(polygon_nearest(p["x"], p["y"], polygon), lambda near: settled(p, near)))


def rect_corners(x, y, width, depth, rotation_deg) -> Column:
    x, y, width, depth = map(_c, (x, y, width, depth))
    angle = F.radians(_c(rotation_deg))
    cos, sin = F.cos(angle), F.sin(angle)

    def corner(sx: int, sy: int) -> Column:
        dx, dy = width * (0.5 * sx), depth * (0.5 * sy)
        return point(x + dx * cos - dy * sin, y + dx * sin + dy * cos)

    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def rect_bounds(x, y, width, depth, rotation_deg) -> tuple[Column, Column, Column, Column]:
    """Axis-aligned bounds of a rotated rectangle."""
    x, y, width, depth = map(_c, (x, y, width, depth))
    angle = F.radians(_c(rotation_deg))
    cos, sin = F.abs(F.cos(angle)), F.abs(F.sin(angle))
    rx, ry = (width * cos + depth * sin) / 2, (width * sin + depth * cos) / 2
    return x - rx, y - ry, x + rx, y + ry


def rect_turn(rotation_deg, prefix: str = "") -> dict[str, Column]:
    """Columns of a rectangle's turn. Pairs of rectangles read them, so no angle is taken once a pair."""
    angle = F.radians(_c(rotation_deg))
    return {f"{prefix}_cos": F.cos(angle), f"{prefix}_sin": F.sin(angle)}


def rect_relation(left: str, right: str) -> dict[str, Column]:
    """What two rectangles with ``rect_turn`` share in all their measures, as columns: the cosine and sine of the angle
    between them, and the way from the middle of the left to that of the right along the axes of each."""
    col = lambda side, name: F.col(f"{side}{name}")
    dx, dy = col(right, "x") - col(left, "x"), col(right, "y") - col(left, "y")
    out = {"_turn_cos": col(left, "_cos") * col(right, "_cos") + col(left, "_sin") * col(right, "_sin"),
           "_turn_sin": col(left, "_cos") * col(right, "_sin") - col(left, "_sin") * col(right, "_cos")}
    for side in (left, right):
        out |= {f"{side}_u": dx * col(side, "_cos") + dy * col(side, "_sin"), f"{side}_v": dy * col(side, "_cos") - dx * col(side, "_sin")}
    return out


def rect_overlap(left: str, right: str) -> Column:
    """Smallest penetration over the four edge normals of two rectangles, 0 when separated.

    Column prefixes name the two sides of a pair with its ``rect_relation``. On an axis the projections overlap by the
    sum of the half extents less the centre distance, but never by more than the smaller of the two projections.
    """
    cos, sin = F.abs(F.col("_turn_cos")), F.abs(F.col("_turn_sin"))

    def on_axes(own: str, other: str) -> list[Column]:
        w, d = F.col(f"{other}width"), F.col(f"{other}depth")
        axes = [(F.col(f"{own}width"), w * cos + d * sin, F.col(f"{own}_u")), (F.col(f"{own}depth"), w * sin + d * cos, F.col(f"{own}_v"))]
        return [c for mine, theirs, way in axes for c in ((mine + theirs) / 2 - F.abs(way), mine, theirs)]

    return F.greatest(F.lit(0.0), F.least(*on_axes(left, right), *on_axes(right, left)))


def rect_gap(left: str, right: str) -> Column:
    """Distance between two separated rectangles, a pair with its ``rect_relation``: the closest corner-to-rectangle distance either way.

    The corners are gone through in an array: eight formulas would make a method too long for the JVM to compile.
    """
    cos = F.col("_turn_cos")
    signs = F.array(*[F.struct(F.lit(sx).alias("x"), F.lit(sy).alias("y")) for sx in (-0.5, 0.5) for sy in (-0.5, 0.5)])

    def nearest_corner(inner: str, outer: str, sin: Column, way: int) -> Column:
        w, d = F.col(f"{inner}width"), F.col(f"{inner}depth")

        def square(s: Column) -> Column:
            lx = way * F.col(f"{outer}_u") + s["x"] * w * cos - s["y"] * d * sin
            ly = way * F.col(f"{outer}_v") + s["x"] * w * sin + s["y"] * d * cos
            gx, gy = F.greatest(F.abs(lx) - F.col(f"{outer}width") / 2, F.lit(0.0)), F.greatest(F.abs(ly) - F.col(f"{outer}depth") / 2, F.lit(0.0))
            return F.pow(gx, F.lit(2.0)) + F.pow(gy, F.lit(2.0))

        return F.array_min(F.transform(signs, square))

    return F.sqrt(F.least(nearest_corner(left, right, -F.col("_turn_sin"), -1), nearest_corner(right, left, F.col("_turn_sin"), 1)))


def _orientation(px, py, qx, qy, rx, ry) -> Column:
    value = (qy - py) * (rx - qx) - (qx - px) * (ry - qy)
    return F.when(F.abs(value) < TINY, 0).when(value > 0, 1).otherwise(2)


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    ax, ay, bx, by, cx, cy, dx, dy = map(_c, (ax, ay, bx, by, cx, cy, dx, dy))
    return (_orientation(ax, ay, bx, by, cx, cy) != _orientation(ax, ay, bx, by, dx, dy)) & (
        _orientation(cx, cy, dx, dy, ax, ay) != _orientation(cx, cy, dx, dy, bx, by))


def angle_between(a, b) -> Column:
    return F.abs(F.pmod(_c(a) - _c(b) + 180.0, F.lit(360.0)) - 180.0)


def heading_toward(ox, oy, tx, ty) -> Column:
    """Degrees counter-clockwise from +y; 0 for coincident points."""
    dx, dy = _c(tx) - _c(ox), _c(ty) - _c(oy)
    heading = F.pmod(F.degrees(F.atan2(-dx, dy)), F.lit(360.0))
    return F.when((F.abs(dx) < 1e-9) & (F.abs(dy) < 1e-9), 0.0).otherwise(heading)


def segment_length(sx, sy, ex, ey) -> Column:
    return F.hypot(_c(ex) - _c(sx), _c(ey) - _c(sy))


def segment_heading(sx, sy, ex, ey, modulus: float = 360.0) -> Column:
    return F.pmod(F.degrees(F.atan2(_c(ey) - _c(sy), _c(ex) - _c(sx))), F.lit(modulus))


DEGREE = math.pi / 180
