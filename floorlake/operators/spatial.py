"""Spatial joins as equi-joins on (building, cell) with an exact refine step.

Only the side with an extent is exploded over cells; points stay single rows. Buildings never mix,
cells spread a large building over many tasks, and the best partner of a point is a grouped
minimum, which combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..session import cut_lineage

BUILDING = "building_id"
LABEL_TOLERANCE = 1.5
BLOCK_TOLERANCE = 0.45
OPENING_TOLERANCE = 0.6
ROOM_TOLERANCE = 2.0
ADJACENCY_REACH = 1.4 * 1.6
SUPERSEDE_RADIUS = 0.5


def with_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, cell: float) -> DataFrame:
    """One row per grid cell the box touches."""
    span = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    return df.withColumn("_cx", F.explode(span(x0, x1))).withColumn("_cy", F.explode(span(y0, y1)))


def point_cell(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    return df.withColumn("_cx", F.floor(F.col(x) / cell)).withColumn("_cy", F.floor(F.col(y) / cell))


def polygon_bounds(polygon: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def assign_regions(points: DataFrame, point_key: str, regions: DataFrame, tolerance: float, by: str = "area",
                   cell: float = 4.0, strict: bool = False) -> DataFrame:
    """The region of every point: one that contains it, else the nearest within ``tolerance``, else none.

    ``regions``: building, room_id, polygon, area. Among containing regions the smallest ``by`` wins
    (``area``, or ``room_id`` for first-declared). Weight is 1 inside, 1 - 0.5 d/tolerance outside.
    Returns building, point_key, room_id, weight, distance, inside for the points that found a region; point
    keys need only be unique within their building.
    """
    x0, y0, x1, y1 = polygon_bounds(F.col("polygon"))
    boxed = regions.select(BUILDING, "room_id", "polygon", F.col(by).alias("_by"), (x0 - tolerance).alias("_bx0"), (y0 - tolerance).alias("_by0"), (x1 + tolerance).alias("_bx1"), (y1 + tolerance).alias("_by1"))
    reach = with_cells(boxed, F.col("_bx0"), F.col("_by0"), F.col("_bx1"), F.col("_by1"), cell)
    slim = point_cell(points.select(BUILDING, point_key, F.col("x").alias("_x"), F.col("y").alias("_y")), "_x", "_y", cell)
    boxes = F.col("_x").between(F.col("_bx0") - 1e-9, F.col("_bx1") + 1e-9) & F.col("_y").between(F.col("_by0") - 1e-9, F.col("_by1") + 1e-9)
    pairs = slim.join(reach, [BUILDING, "_cx", "_cy"]).filter(boxes).select(
        BUILDING, point_key, "room_id", "_by", "polygon", "_x", "_y", g.in_polygon("_x", "_y", F.col("polygon")).alias("_inside"))
    # The distance only matters outside, and every region outside the reach has been cut by its cells.
    pairs = pairs.withColumn("_distance", F.when(F.col("_inside"), 0.0).otherwise(F.round(g.polygon_distance("_x", "_y", F.col("polygon")), 9))).drop("polygon", "_x", "_y")
    near = F.col("_distance") < tolerance if strict else F.col("_distance") <= tolerance
    candidate = F.struct(
        F.when(F.col("_inside"), 0).otherwise(1).alias("tier"),
        F.when(F.col("_inside"), F.col("_by").cast("double")).otherwise(F.col("_distance")).alias("order"),
        F.col("room_id").alias("room_id"), F.col("_distance").alias("distance"))
    best = pairs.filter(F.col("_inside") | near).groupBy(BUILDING, point_key).agg(F.min(candidate).alias("b"))
    inside = F.col("b.tier") == 0
    return best.select(
        BUILDING, point_key, F.col("b.room_id").alias("room_id"),
        F.when(inside, 1.0).otherwise(1 - 0.5 * F.col("b.distance") / tolerance).alias("weight"),
        F.when(inside, 0.0).otherwise(F.col("b.distance")).alias("distance"), inside.alias("inside"))


def stamp_rooms(points: DataFrame, point_key: str, regions: DataFrame, tolerance: float = ROOM_TOLERANCE) -> DataFrame:
    """Fills missing room ids from the plan; ``outside_every_room`` where nothing is near enough."""
    open_points = points.filter(F.col("room_id").isNull())
    found = assign_regions(open_points, point_key, regions, tolerance, by="room_id", strict=True).select(
        BUILDING, point_key, F.col("room_id").alias("_found"))
    return points.join(found, [BUILDING, point_key], "left").withColumn("room_id", F.coalesce("room_id", "_found")).drop("_found").withColumn(
        "outside_every_room", F.col("room_id").isNull())


def near_boundary(points: DataFrame, regions: DataFrame, tolerance: float, inside_counts: bool = True,
                  strict: bool = False, cell: float = 4.0) -> DataFrame:
    """Every (point, region) with the point within ``tolerance`` of the outline; not exclusive."""
    x0, y0, x1, y1 = polygon_bounds(F.col("polygon"))
    reach = with_cells(regions.select(BUILDING, F.col("room_id").alias("region_id"), "polygon"),
                       x0 - tolerance, y0 - tolerance, x1 + tolerance, y1 + tolerance, cell)
    pairs = point_cell(points, "x", "y", cell).join(reach, [BUILDING, "_cx", "_cy"])
    distance = F.round(g.polygon_distance("x", "y", F.col("polygon")), 9)
    near = distance < tolerance if strict else distance <= tolerance
    if inside_counts:
        near = near | g.in_polygon("x", "y", F.col("polygon"))
    return pairs.filter(near).drop("_cx", "_cy", "polygon")


def opening_counts(openings: DataFrame, regions: DataFrame, tolerance: float = OPENING_TOLERANCE) -> DataFrame:
    """Doors and windows per region; rooms without any keep zero."""
    near = near_boundary(openings.select(BUILDING, "kind", "x", "y"), regions, tolerance)
    counts = near.groupBy(BUILDING, F.col("region_id").alias("room_id")).agg(
        F.count_if(F.col("kind") == "door").alias("doors"), F.count_if(F.col("kind") == "window").alias("windows"))
    return regions.select(BUILDING, "room_id").join(counts, [BUILDING, "room_id"], "left").na.fill(0, ["doors", "windows"])


def attach_walls(walls: DataFrame, regions: DataFrame, tolerance: float = 0.45) -> DataFrame:
    """Walls whose midpoint lies within ``tolerance`` of a region outline, as a link table."""
    middle = walls.select(BUILDING, "wall_id", ((F.col("sx") + F.col("ex")) / 2).alias("x"), ((F.col("sy") + F.col("ey")) / 2).alias("y"))
    return near_boundary(middle, regions, tolerance, inside_counts=False, strict=True).select(BUILDING, "wall_id", "region_id")


def region_adjacency(regions: DataFrame, reach: float = ADJACENCY_REACH, cell: float = 4.0) -> DataFrame:
    """Both directions of every pair whose outlines come within ``reach``, vertices of the first against edges of the second."""
    x0, y0, x1, y1 = polygon_bounds(F.col("polygon"))
    vertices = regions.select(BUILDING, F.col("room_id").alias("a_id"), F.explode("polygon").alias("p")).select(
        BUILDING, "a_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    reached = with_cells(regions.select(BUILDING, F.col("room_id").alias("b_id"), "polygon"), x0 - reach, y0 - reach, x1 + reach, y1 + reach, cell)
    close = point_cell(vertices, "x", "y", cell).join(reached, [BUILDING, "_cx", "_cy"]).filter(
        (F.col("a_id") < F.col("b_id")) & (F.round(g.polygon_distance("x", "y", F.col("polygon")), 9) <= reach))
    pairs = close.select(BUILDING, "a_id", "b_id").distinct()
    return pairs.toDF(BUILDING, "room_id", "neighbour_id").union(pairs.select(BUILDING, "b_id", "a_id"))


def nearest_segment(points: DataFrame, point_key: str, segments: DataFrame, segment_key: str, start: float = 2.0,
                    growth: float = 4.0) -> DataFrame:
    """Nearest segment of the same building without a distance limit.

    Rings: search within ``start``, keep what is closer than the ring, widen the ring for the rest
    until it spans the building. Each ring is one cell join; few points survive the first.
    """
    slim = points.select(BUILDING, point_key, F.col("x").alias("_x"), F.col("y").alias("_y"))
    slim = slim.join(segments.select(BUILDING).distinct(), BUILDING, "left_semi")
    lines = segments.select(BUILDING, segment_key, "sx", "sy", "ex", "ey")
    extent = lines.agg((F.max(F.greatest("sx", "ex")) - F.min(F.least("sx", "ex"))).alias("w"),
                       (F.max(F.greatest("sy", "ey")) - F.min(F.least("sy", "ey"))).alias("h")).crossJoin(
        slim.agg((F.max(F.abs("_x")) + F.max(F.abs("_y"))).alias("r"))).first()
    widest = (extent["w"] or 0.0) + (extent["h"] or 0.0) + 2 * (extent["r"] or 0.0) + start
    done, radius, rest = None, start, slim
    while True:
        reach = with_cells(lines, F.least("sx", "ex") - radius, F.least("sy", "ey") - radius,
                           F.greatest("sx", "ex") + radius, F.greatest("sy", "ey") + radius, radius)
        pairs = point_cell(rest, "_x", "_y", radius).join(reach, [BUILDING, "_cx", "_cy"])
        found = pairs.select(BUILDING, point_key, F.struct(
            F.round(g.segment_distance("_x", "_y", "sx", "sy", "ex", "ey"), 9).alias("distance"), F.col(segment_key)).alias("b")).filter(
            F.col("b.distance") <= radius).groupBy(BUILDING, point_key).agg(F.min("b").alias("b"))
        found = found.select(BUILDING, point_key, F.col(f"b.{segment_key}").alias(segment_key), F.col("b.distance").alias("distance"))
        done = found if done is None else done.unionByName(found)
        if radius >= widest:
            return done
        done = cut_lineage(done)
        rest = rest.join(done.select(BUILDING, point_key), [BUILDING, point_key], "left_anti")
        if rest.isEmpty():
            return done
        radius *= growth


def supersede(authoritative: DataFrame, observed: DataFrame, observed_key: str, radius: float = SUPERSEDE_RADIUS) -> DataFrame:
    """All authoritative rows plus the observed ones with no authoritative row within ``radius``."""
    reach = with_cells(authoritative.select(BUILDING, F.col("x").alias("_ax"), F.col("y").alias("_ay")),
                       F.col("_ax") - radius, F.col("_ay") - radius, F.col("_ax") + radius, F.col("_ay") + radius, radius)
    taken = point_cell(observed.select(BUILDING, observed_key, "x", "y"), "x", "y", radius).join(reach, [BUILDING, "_cx", "_cy"]).filter(
        F.round(F.hypot(F.col("x") - F.col("_ax"), F.col("y") - F.col("_ay")), 9) <= radius).select(BUILDING, observed_key).distinct()
    return authoritative.unionByName(observed.join(taken, [BUILDING, observed_key], "left_anti"), allowMissingColumns=True)


FOOTPRINT = ["x", "y", "width", "depth", "rotation_deg"]


def footprint_pairs(left: DataFrame, right: DataFrame, keys: list[str], halo: float = 0.0, cell: float = 2.0, once: str | None = None) -> DataFrame:
    """Candidate pairs whose footprint bounds come within ``halo``; columns prefixed ``a_`` and ``b_``.

    A pair meets in every cell both touch but is emitted only in the cell holding the lower corner
    of the common area, so no duplicate has to be removed by a shuffle. ``once`` names an id of which
    the left must be the smaller, for a table joined with itself. Both sides carry their ``rect_turn``.
    """

    def side(df: DataFrame, prefix: str, grow: float) -> DataFrame:
        x0, y0, x1, y1 = g.rect_bounds("x", "y", "width", "depth", "rotation_deg")
        boxed = df.withColumns({"_x0": x0 - grow, "_y0": y0 - grow, "_x1": x1 + grow, "_y1": y1 + grow, **g.rect_turn("rotation_deg")})
        celled = with_cells(boxed, F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1"), cell)
        keep = [*keys, "_cx", "_cy"]
        return celled.select(*keep, *[F.col(c).alias(prefix + c) for c in celled.columns if c not in keep])

    a, b = side(left, "a_", halo), side(right, "b_", 0.0)
    pairs = a.join(b, [*keys, "_cx", "_cy"])
    lowx, lowy = F.greatest("a__x0", "b__x0"), F.greatest("a__y0", "b__y0")
    if once:
        pairs = pairs.filter(F.col(f"a_{once}") < F.col(f"b_{once}"))
    return pairs.filter(
        (lowx <= F.least("a__x1", "b__x1")) & (lowy <= F.least("a__y1", "b__y1"))
        & (F.col("_cx") == F.floor(lowx / cell)) & (F.col("_cy") == F.floor(lowy / cell)))


def measured_pairs(pairs: DataFrame, name: str, measure) -> DataFrame:
    """Adds ``measure`` ("a_", "b_" -> column, see ``rect_overlap``) to pairs of footprints, worked out once a pair.

    A filter on a plain column would be moved into the join, and the whole formula with it: worked out again for every
    condition, in a method too long for the JVM to compile. What an explode returns stays where it is.
    """
    related = pairs if "_turn_cos" in pairs.columns else pairs.withColumns(g.rect_relation("a_", "b_"))
    return related.withColumn(name, F.explode(F.array(measure("a_", "b_"))))
