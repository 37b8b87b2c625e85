"""Connected components, clustering, grid segmentation, flood fill and graph walks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..session import cut_lineage, forget
from .spatial import BUILDING, point_cell, polygon_bounds, with_cells
from .validation import obstacles

JOIN_TOLERANCE = 0.30
CLUSTER_RADIUS = 0.9


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes``: id; ``edges``: src, dst -> id, component (the smallest id of the component).

    Every round takes the smallest label among neighbours and then follows labels one step
    (pointer jumping), so long chains settle in a logarithmic number of rounds. Label joins have
    one row per id on one side; a component of any size only skews the other, which AQE splits.
    Labels only fall and each round lowers one, so the loop ends; the files of a round are deleted
    when the next one is written.
    """
    both = cut_lineage(edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct())
    kept = labels = cut_lineage(nodes.select("id", F.col("id").alias("component")))
    while True:
        offered = both.join(labels.withColumnsRenamed({"id": "src", "component": "_c"}), "src").groupBy(F.col("dst").alias("id")).agg(F.min("_c").alias("_c"))
        lowered = labels.join(offered, "id", "left").select("id", F.col("component").alias("_old"), F.least("component", F.coalesce("_c", "component")).alias("_new"))
        lowered = cut_lineage(lowered)
        hop = lowered.select(F.col("id").alias("_new"), F.col("_new").alias("_far"))
        jumped = cut_lineage(lowered.join(hop, "_new", "left").select("id", "_old", F.least("_new", F.coalesce("_far", "_new")).alias("component")))
        settled = jumped.filter("component <> _old").isEmpty()
        forget(kept, lowered)
        kept, labels = jumped, jumped.select("id", "component")
        if settled:
            forget(both)
            return labels


def touching_segments(segments: DataFrame, tolerance: float = JOIN_TOLERANCE, cell: float = 1.0) -> DataFrame:
    """Edges between segments one of whose end points lies within ``tolerance`` of the other."""
    ends = segments.select(BUILDING, F.col("segment_id").alias("src"), F.explode(F.array(g.point("sx", "sy"), g.point("ex", "ey"))).alias("p")).select(
        BUILDING, "src", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    reach = with_cells(segments.withColumnRenamed("segment_id", "dst"), F.least("sx", "ex") - tolerance, F.least("sy", "ey") - tolerance,
                       F.greatest("sx", "ex") + tolerance, F.greatest("sy", "ey") + tolerance, cell)
    near = point_cell(ends, "x", "y", cell).join(reach, [BUILDING, "_cx", "_cy"])
    return near.filter((F.col("src") != F.col("dst")) & (F.round(g.segment_distance("x", "y", "sx", "sy", "ex", "ey"), 9) <= tolerance)).select("src", "dst").distinct()


def window_figures(segments: DataFrame) -> DataFrame:
    """Clusters of touching window segments as openings: long side is the width."""
    parts = connected_components(segments.select(F.col("segment_id").alias("id")), touching_segments(segments))
    boxes = segments.join(parts.withColumnRenamed("id", "segment_id"), "segment_id").groupBy(BUILDING, "component").agg(
        F.min(F.least("sx", "ex")).alias("x0"), F.max(F.greatest("sx", "ex")).alias("x1"), F.min(F.least("sy", "ey")).alias("y0"), F.max(F.greatest("sy", "ey")).alias("y1"), F.count("*").alias("segments"))
    across, up = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sized = boxes.withColumns({"width": F.greatest(across, up), "depth": F.least(across, up)}).filter((F.round("width", 9) >= 0.3) & (F.round("width", 9) <= 6.0))
    return sized.select(BUILDING, "component", F.lit("window").alias("kind"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"),
                        "width", "depth", F.when(across >= up, 0.0).otherwise(90.0).alias("rotation_deg"), "segments")


def door_openings(blocks: DataFrame) -> DataFrame:
    """Door blocks; the larger side is the width, 0.9 m where it is not a door's."""
    side = F.greatest("span_x", "span_y")
    return blocks.filter("kind = 'door'").select(BUILDING, "entity_id", F.lit("door").alias("kind"), "x", "y", F.when((side >= 0.3) & (side <= 6.0), side).otherwise(0.9).alias("width"))


def cluster_points(points: DataFrame, radius: float = CLUSTER_RADIUS) -> DataFrame:
    """Single-link clusters of points within ``radius``, as centroids.

    Points sharing a cell of radius/sqrt(2) are within reach of each other, so they hang on the
    cell's smallest point; only points of different cells are compared.
    """
    cell = radius / math.sqrt(2)
    celled = point_cell(points.select(BUILDING, "point_id", "x", "y"), "x", "y", cell)
    inside = celled.groupBy(BUILDING, "_cx", "_cy").agg(F.min("point_id").alias("_head"))
    star = celled.join(inside, [BUILDING, "_cx", "_cy"]).select(F.col("point_id").alias("src"), F.col("_head").alias("dst"))
    reach = celled.select(BUILDING, F.col("point_id").alias("dst"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("_cx").alias("_hx"), F.col("_cy").alias("_hy"))
    steps = F.sequence(F.lit(-2), F.lit(2))
    reach = reach.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).withColumns({"_cx": F.col("_hx") + F.col("_dx"), "_cy": F.col("_hy") + F.col("_dy")})
    across = celled.join(reach, [BUILDING, "_cx", "_cy"]).filter(
        ((F.col("_dx") != 0) | (F.col("_dy") != 0)) & (F.col("point_id") < F.col("dst")) & (F.round(F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")), 9) <= radius)).select(
        F.col("point_id").alias("src"), "dst")
    parts = connected_components(points.select(F.col("point_id").alias("id")), star.union(across))
    return points.join(parts.withColumnRenamed("id", "point_id"), "point_id").groupBy(BUILDING, "component").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("points"))


def cascade(removed: DataFrame, supports: DataFrame, keys: tuple[str, ...] = (BUILDING,)) -> DataFrame:
    """Everything resting, directly or not, on something removed. ``supports``: keys, object_id, support_id.

    ``keys`` (the building) go with every id. Each round writes its new rows only; it ends when there are none,
    which is at the latest after the longest chain of supports.
    """
    gone = frontier = cut_lineage(removed.select(*keys, "object_id").distinct())
    while not frontier.isEmpty():
        above = supports.join(frontier.withColumnRenamed("object_id", "support_id"), [*keys, "support_id"], "left_semi").select(*keys, "object_id").distinct()
        frontier = cut_lineage(above.join(gone, [*keys, "object_id"], "left_anti"))
        gone = gone.union(frontier)
    return gone


def carry_children(moves: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects carried along with a moved parent: turned about its new position and shifted with it.

    ``moves``: building_id, root_id, old_x, old_y, dx, dy, turn_deg; ``objects``: building_id, object_id, support_id, x, y, rotation_deg.

    Each round doubles the height that is looked at: ``jumps`` lead 2^k supports up, and what was found so far is carried
    on by them, so a stack of n objects takes log2(n) rounds. A child is kept at its least height above the root,
    once for each of the ways (a double, as it only counts rows) to it of that height.
    """
    key = [BUILDING, "root_id", "object_id"]
    found = cut_lineage(moves.select(BUILDING, "root_id", F.col("root_id").alias("object_id")).groupBy(*key).agg(F.lit(0).alias("height"), F.count("*").cast("double").alias("ways")))
    links = objects.filter("support_id IS NOT NULL").groupBy(BUILDING, F.col("support_id").alias("lower"), F.col("object_id").alias("upper"))
    jumps, reach = cut_lineage(links.agg(F.count("*").cast("double").alias("paths"))), 1
    while not jumps.isEmpty():
        above = found.join(jumps.withColumnRenamed("lower", "object_id"), [BUILDING, "object_id"]).groupBy(BUILDING, "root_id", F.col("upper").alias("object_id"), (F.col("height") + reach).alias("height")).agg(
            F.sum(F.col("ways") * F.col("paths")).alias("ways"))
        least = found.unionByName(above).groupBy(*key).agg(F.min(F.struct("height", "ways")).alias("b")).select(*key, "b.*")
        before, found = found, cut_lineage(least)
        grown = not found.filter(F.col("height") >= reach).isEmpty()
        forget(before)
        if not grown:
            break
        upper = jumps.select(BUILDING, F.col("lower").alias("upper"), F.col("upper").alias("_top"), F.col("paths").alias("_more"))
        before, jumps = jumps, cut_lineage(jumps.join(upper, [BUILDING, "upper"]).groupBy(BUILDING, "lower", F.col("_top").alias("upper")).agg(F.sum(F.col("paths") * F.col("_more")).alias("paths")))
        forget(before)
        reach *= 2
    pairs = found.filter("root_id <> object_id").select(*key, F.explode(F.array_repeat(F.lit(0), F.col("ways").cast("int")))).drop("col")
    moved = pairs.join(moves, [BUILDING, "root_id"]).join(objects.select(BUILDING, "object_id", "x", "y", "rotation_deg"), [BUILDING, "object_id"])
    angle = F.radians("turn_deg")
    rx, ry = F.col("x") - F.col("old_x"), F.col("y") - F.col("old_y")
    return moved.select(
        BUILDING, "root_id", "object_id", (F.col("old_x") + F.col("dx") + rx * F.cos(angle) - ry * F.sin(angle)).alias("x"),
        (F.col("old_y") + F.col("dy") + rx * F.sin(angle) + ry * F.cos(angle)).alias("y"), F.pmod(F.col("rotation_deg") + F.col("turn_deg"), F.lit(360.0)).alias("rotation_deg"))


# -- rows of runs: a mask is kept as merged column runs per grid row ---------------


def merge_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Merge overlapping or touching runs (c0..c1) within each (keys, row)."""
    line = Window.partitionBy(*keys, "row").orderBy("c0", "c1")
    before = F.max("c1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("_new", F.when(before.isNull() | (F.col("c0") > before + 1), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "row", "_island").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("_island")


def dilate(runs: DataFrame, radius: int, keys: list[str]) -> DataFrame:
    """Grow a mask by a disk: each run spreads to 2 radius + 1 rows, wider near its own."""
    dy = F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("dy")
    spread = runs.select(*keys, "row", "c0", "c1", dy)
    reach = F.floor(F.sqrt(F.lit(radius * radius + 1e-9) - F.col("dy") * F.col("dy")))
    return merge_runs(spread.select(*keys, (F.col("row") + F.col("dy")).alias("row"), (F.col("c0") - reach).alias("c0"), (F.col("c1") + reach).alias("c1")), keys)


def runs_of_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    return merge_runs(cells.select(*keys, "row", F.col("col").alias("c0"), F.col("col").alias("c1")), keys)


def label_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """4-connected components of a mask: runs of neighbouring rows connect where columns overlap."""
    named = runs.withColumn("id", F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("row").cast("string"), F.col("c0").cast("string")))
    named = cut_lineage(named)
    below = named.select(*keys, (F.col("row") - 1).alias("row"), F.col("c0").alias("_b0"), F.col("c1").alias("_b1"), F.col("id").alias("dst"))
    edges = named.join(below, [*keys, "row"]).filter("c0 <= _b1 AND c1 >= _b0").select(F.col("id").alias("src"), "dst")
    return named.join(connected_components(named.select("id"), edges), "id")


def segment_rooms(walls: DataFrame, thickness: float = 0.15, resolution: float = 0.05, gap: float = 1.4, min_area: float = 2.0) -> DataFrame:
    """Rooms enclosed by walls: area, bounds, centroid per building.

    Walls are drawn on a grid, doorways sealed by growing them, the enclosed free space labelled,
    grown back by the same disk and stripped of walls. All masks are runs; cells are only listed
    for the final statistics. ``walls``: building_id, sx, sy, ex, ey.
    """
    k = [BUILDING]
    pad = max(gap, thickness) * 2.0 + resolution * 4
    frame = walls.groupBy(BUILDING).agg(
        F.min(F.least("sx", "ex")).alias("_x0"), F.max(F.greatest("sx", "ex")).alias("_x1"), F.min(F.least("sy", "ey")).alias("_y0"), F.max(F.greatest("sy", "ey")).alias("_y1")).select(
        BUILDING, (F.col("_x0") - pad).alias("ox"), (F.col("_y0") - pad).alias("oy"),
        (F.ceil((F.col("_x1") - F.col("_x0") + 2 * pad) / resolution) + 1).alias("cols"), (F.ceil((F.col("_y1") - F.col("_y0") + 2 * pad) / resolution) + 1).alias("rows"))
    frame = cut_lineage(frame)
    length = g.segment_length("sx", "sy", "ex", "ey")
    steps = F.greatest(F.lit(2), F.floor(length / (resolution * 0.5)).cast("int") + 1)
    drawn = walls.filter(length >= 1e-9).join(frame, BUILDING).withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda a, b, o: F.floor((F.col(a) + (F.col(b) - F.col(a)) * (F.col("_i") / (F.col("_n") - 1)) - F.col(o)) / resolution + 1e-9)
    cells = drawn.select(BUILDING, at("sy", "ey", "oy").alias("row"), at("sx", "ex", "ox").alias("col")).distinct()
    thick = cut_lineage(dilate(runs_of_cells(cells, k), max(1, round(thickness / resolution / 2.0)), k))
    closing = max(1, round(gap / resolution / 2.0))
    sealed = dilate(thick, closing, k).join(frame.select(BUILDING, "cols", "rows"), BUILDING).filter("row >= 0 AND row < rows").select(BUILDING, "row", "c0", "c1")

    # Free runs are the gaps between sealed runs; sentinels at both ends close every row.
    ends = frame.select(BUILDING, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.explode(F.array(F.lit(-1), F.col("cols"))).alias("c0")).withColumn("c1", F.col("c0"))
    line = Window.partitionBy(BUILDING, "row").orderBy("c0")
    gaps = sealed.unionByName(ends).withColumn("_prev", F.lag("c1").over(line)).filter("_prev IS NOT NULL AND c0 - _prev > 1")
    free = gaps.select(BUILDING, "row", (F.col("_prev") + 1).alias("c0"), (F.col("c0") - 1).alias("c1"))
    labelled = cut_lineage(label_runs(free, k))
    outside = labelled.join(frame, BUILDING).filter("c0 = 0 OR c1 = cols - 1 OR row = 0 OR row = rows - 1").select("component").distinct()
    inner = labelled.join(outside, "component", "left_anti")
    keys = [BUILDING, "component"]
    grown = dilate(inner.select(*keys, "row", "c0", "c1"), closing, keys)
    listed = lambda runs, extra: runs.select(*extra, "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    floor = listed(grown, keys).join(listed(thick, k).hint("merge"), [BUILDING, "row", "col"], "left_anti")
    rooms = floor.groupBy(*keys).agg(F.count("*").alias("cells"), F.min("col").alias("_c0"), F.max("col").alias("_c1"), F.min("row").alias("_r0"), F.max("row").alias("_r1"),
                                     F.avg("col").alias("_cx"), F.avg("row").alias("_cy"))
    scaled = lambda c, o: F.col(o) + F.col(c) * resolution
    area = F.col("cells") * (resolution * resolution)
    return rooms.join(frame, BUILDING).filter(F.round(area, 9) >= min_area).select(
        *keys, area.alias("area"), scaled("_c0", "ox").alias("min_x"), scaled("_r0", "oy").alias("min_y"), scaled("_c1", "ox").alias("max_x"), scaled("_r1", "oy").alias("max_y"),
        scaled("_cx", "ox").alias("centre_x"), scaled("_cy", "oy").alias("centre_y"))


def fallback_regions(walls: DataFrame, regions: DataFrame) -> DataFrame:
    """The bounding box of all walls for buildings in which nothing encloses a room."""
    boxes = walls.join(regions.select(BUILDING).distinct(), BUILDING, "left_anti").groupBy(BUILDING).agg(
        F.min(F.least("sx", "ex")).alias("x0"), F.min(F.least("sy", "ey")).alias("y0"), F.max(F.greatest("sx", "ex")).alias("x1"), F.max(F.greatest("sy", "ey")).alias("y1"), F.count("*").alias("walls"))
    return boxes.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))


def reachable_floor(rooms: DataFrame, objects: DataFrame, openings: DataFrame, cell: float = 0.1, least: float = 0.6) -> DataFrame:
    """Share of the free floor of each room that can be reached from its doors.

    ``rooms``: building_id, room_id, polygon. Rooms without a seed keep a null share.
    """
    keys = [BUILDING, "room_id"]
    x0, y0, x1, y1 = polygon_bounds(F.col("polygon"))
    frame = rooms.select(*keys, "polygon", x0.alias("_x0"), y0.alias("_y0"), (F.floor((x1 - x0) / cell + 1e-9) + 1).alias("_cols"), (F.floor((y1 - y0) / cell + 1e-9) + 1).alias("_rows")).filter("_cols >= 3 AND _rows >= 3")
    centre = lambda o, i: F.col(o) + (F.col(i) + 0.5) * cell
    grid = frame.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("_cols") - 1)))
    floor = grid.filter(g.in_polygon(centre("_x0", "col"), centre("_y0", "row"), F.col("polygon"))).select(*keys, "row", "col")
    solid = obstacles(objects).join(frame.select(*keys, "_x0", "_y0", "_cols", "_rows"), keys)
    bx0, by0, bx1, by1 = g.rect_bounds("x", "y", "width", "depth", "rotation_deg")
    at = lambda v, o, n, slack: F.least(F.col(n) - 1, F.greatest(F.lit(0), F.floor((v - F.col(o)) / cell) + slack))
    covered = solid.withColumns({"_ra": at(by0, "_y0", "_rows", -1), "_rb": at(by1, "_y0", "_rows", 1), "_ca": at(bx0, "_x0", "_cols", -1), "_cb": at(bx1, "_x0", "_cols", 1)})
    covered = covered.withColumn("row", F.explode(F.sequence("_ra", "_rb"))).withColumn("col", F.explode(F.sequence("_ca", "_cb")))
    angle = F.radians("rotation_deg")
    dx, dy = centre("_x0", "col") - F.col("x"), centre("_y0", "row") - F.col("y")
    lx, ly = dx * F.cos(angle) + dy * F.sin(angle), -dx * F.sin(angle) + dy * F.cos(angle)
    blocked = covered.filter((F.round(F.abs(lx) - F.col("width") / 2, 9) < 0) & (F.round(F.abs(ly) - F.col("depth") / 2, 9) < 0)).select(*keys, "row", "col").distinct()
    free = cut_lineage(floor.join(blocked.hint("merge"), [*keys, "row", "col"], "left_anti"))

    middle = frame.select(*keys, "_x0", "_y0", g.polygon_centroid(F.col("polygon")).alias("_mid"))
    doors = openings.filter(F.col("kind").isin("door", "archway")).select(*keys, "opening_id", "x", "y").join(middle, keys)
    mx, my = F.col("_mid.x") - F.col("x"), F.col("_mid.y") - F.col("y")
    span = F.hypot(mx, my)
    unit = F.when(span == 0, 1.0).otherwise(span)
    probes = doors.withColumns({"_ux": mx / unit, "_uy": my / unit}).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(11)))).select(
        *keys, "opening_id", "step", F.floor((F.col("y") + F.col("_uy") * cell * F.col("step") - F.col("_y0")) / cell + 1e-9).alias("row"),
        F.floor((F.col("x") + F.col("_ux") * cell * F.col("step") - F.col("_x0")) / cell + 1e-9).alias("col"))
    seeds = probes.join(free.hint("merge"), [*keys, "row", "col"], "left_semi").groupBy(*keys, "opening_id").agg(F.min(F.struct("step", "row", "col")).alias("s")).select(
        *keys, F.col("s.row").alias("row"), F.col("s.col").alias("_col")).distinct()
    parts = cut_lineage(label_runs(runs_of_cells(free, keys), keys))
    hit = parts.join(seeds, [*keys, "row"]).filter("_col BETWEEN c0 AND c1").select("component").distinct().withColumn("_hit", F.lit(True))
    size = F.col("c1") - F.col("c0") + 1
    shares = parts.join(hit, "component", "left").groupBy(*keys).agg(F.sum(size).alias("free_cells"), F.coalesce(F.sum(F.when(F.col("_hit"), size)), F.lit(0)).alias("reached_cells"))
    joined = frame.select(*keys).join(shares, keys, "left").na.fill(0, ["free_cells", "reached_cells"])
    seeded = seeds.select(*keys).distinct().withColumn("_seeded", F.lit(True))
    share = F.when(F.col("_seeded") & (F.col("free_cells") > 0), F.col("reached_cells") / F.col("free_cells"))
    verdict = F.when(F.col("free_cells") == 0, "room_full").when(share < least, "unreachable_floor").otherwise("")
    return joined.join(seeded, keys, "left").select(*keys, "free_cells", "reached_cells", share.alias("share"), verdict.alias("issue"))


