"""Metric size and position of detected things, light grids, relation offsets and fit tests."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import dim
from ..functions import geometry as g
from ..functions import projection as pj
from .scale import rank_within
from .spatial import footprint_pairs, measured_pairs, polygon_bounds
from .validation import surface_height

KEYS = ["building_id", "room_id"]
MAX_DEPTH_FACTOR = 1.6
BESIDE_GAP = 0.06


def clamp(value: Column, low, high) -> Column:
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(value.isNotNull(), F.greatest(col(low), F.least(col(high), value)))


def resolve_dimensions(detections: DataFrame, rooms: DataFrame) -> DataFrame:
    """Catalog size x size word, width bent half-way to the box aspect, inside the limits and the room.

    ``detections``: keys, category, size_bucket, box_width, box_height (nullable); ``rooms``: keys,
    room_width, room_depth, ceiling_height.
    """
    spark = detections.sparkSession
    prior = F.broadcast(dim(spark, "dim_objects").select("category", "typical_w", "typical_d", "typical_h", "w_lo", "w_hi", "d_lo", "d_hi", "h_lo", "h_hi"))
    words = F.broadcast(dim(spark, "dim_size_buckets").withColumnRenamed("bucket", "size_bucket"))
    joined = detections.join(prior, "category", "left").join(words, "size_bucket", "left").join(rooms.select(*KEYS, "room_width", "room_depth", "ceiling_height"), KEYS)
    factor = F.coalesce("factor", F.lit(1.0))
    expected = F.when(F.col("typical_h") > 0, F.col("typical_w") / F.col("typical_h")).otherwise(1.0)
    usable = (F.col("box_height") > 0.02) & (F.col("box_width") > 0.005) & (expected > 0)
    bend = F.when(usable, 1 + (clamp(F.col("box_width") / F.col("box_height") / expected, 0.6, 1.7) - 1) * 0.5).otherwise(1.0)
    width = clamp(F.col("typical_w") * factor * F.coalesce(bend, F.lit(1.0)), F.col("w_lo"), F.col("w_hi"))
    depth = clamp(F.col("typical_d") * factor, F.col("d_lo"), F.col("d_hi"))
    height = clamp(F.col("typical_h") * factor, F.col("h_lo"), F.col("h_hi"))
    fit = lambda v, room: F.least(v, F.greatest(F.lit(0.2), room))
    known = F.col("typical_w").isNotNull()
    return joined.withColumns({
        "width": F.when(known, fit(width, F.col("room_width") * 0.92)).otherwise(0.5), "depth": F.when(known, fit(depth, F.col("room_depth") * 0.92)).otherwise(0.5),
        "height": F.when(known, fit(height, F.col("ceiling_height") * 0.95)).otherwise(0.5)}).drop(
        "typical_w", "typical_d", "typical_h", "w_lo", "w_hi", "d_lo", "d_hi", "h_lo", "h_hi", "factor")


def inward_normal(sx: Column, sy: Column, ex: Column, ey: Column, cx: Column, cy: Column) -> Column:
    """Heading (degrees from +y) of the wall normal that points into the room."""
    nx, ny = -(ey - sy), ex - sx
    side = F.when(nx * (cx - (sx + ex) / 2) + ny * (cy - (sy + ey) / 2) >= 0, 1.0).otherwise(-1.0)
    return F.pmod(F.degrees(F.atan2(-nx * side, ny * side)), F.lit(360.0))


def place_on_floor(detections: DataFrame, viewpoints: DataFrame, rooms: DataFrame) -> DataFrame:
    """Floor point of each detection, or the room centre (confidence x 0.85) when the ray misses or lands too far.

    ``detections``: keys, viewpoint_id, object_id, bx0, bx1, by1, confidence; ``rooms``: keys, polygon.
    """
    views = viewpoints.select("viewpoint_id", "x", "y", "z", "yaw", "pitch_deg", "vfov_deg", "aspect")
    x0, y0, x1, y1 = polygon_bounds(F.col("polygon"))
    frame = rooms.select(*KEYS, ((x0 + x1) / 2).alias("_cx"), ((y0 + y1) / 2).alias("_cy"), F.hypot(x1 - x0, y1 - y0).alias("_diag"))
    posed, cam = pj.with_camera(detections.join(views, "viewpoint_id").join(frame, KEYS))
    rays = pj.ground_positions(posed, cam)
    reach = F.hypot(F.col("implied_x") - F.col("x"), F.col("implied_y") - F.col("y"))
    hit = F.coalesce(F.round(reach - MAX_DEPTH_FACTOR * F.col("_diag"), 9) <= 0, F.lit(False))
    return rays.select(*KEYS, "viewpoint_id", "object_id", F.when(hit, F.col("implied_x")).otherwise(F.col("_cx")).alias("px"), F.when(hit, F.col("implied_y")).otherwise(F.col("_cy")).alias("py"),
                       F.when(hit, F.col("confidence")).otherwise(F.round(F.col("confidence") * 0.85, 4)).alias("confidence"), hit.alias("measured"))


def select_walls(requests: DataFrame, walls: DataFrame, rooms: DataFrame) -> DataFrame:
    """Host wall by viewing direction: smallest normal difference less twice the length (6 m at most).

    ``requests``: keys, request_id, yaw, on_wall; ``walls``: keys, wall_id, sx, sy, ex, ey.
    """
    turn = F.when(F.col("on_wall") == "left", 90.0).when(F.col("on_wall") == "right", -90.0).when(F.col("on_wall") == "front", 180.0).otherwise(0.0)
    x0, y0, x1, y1 = polygon_bounds(F.col("polygon"))
    centre = rooms.select(*KEYS, ((x0 + x1) / 2).alias("_cx"), ((y0 + y1) / 2).alias("_cy"))
    pairs = requests.join(walls.select(*KEYS, "wall_id", "sx", "sy", "ex", "ey"), KEYS).join(centre, KEYS)
    normal = inward_normal(*[F.col(c) for c in ("sx", "sy", "ex", "ey", "_cx", "_cy")])
    wanted = F.pmod(F.col("yaw") + turn + 180.0, F.lit(360.0))
    length = g.segment_length("sx", "sy", "ex", "ey")
    score = F.round(g.angle_between(normal, wanted) - F.least(length, F.lit(6.0)) * 2.0, 9)
    return pairs.groupBy("request_id").agg(F.min(F.struct(score.alias("s"), "wall_id", "sx", "sy", "ex", "ey", length.alias("length"), normal.alias("heading"))).alias("w")).select(
        "request_id", "w.wall_id", "w.sx", "w.sy", "w.ex", "w.ey", "w.length", "w.heading")


def place_openings(openings: DataFrame, hosts: DataFrame) -> DataFrame:
    """Openings evenly spaced on their wall at .07 + .86 (slot + .5) / n; the width shrinks to its share."""
    joined = openings.join(hosts, openings["opening_id"] == hosts["request_id"]).drop("request_id")
    counts = joined.groupBy("wall_id").agg(F.count("*").alias("_n"))
    slots = rank_within(joined, ["wall_id"], [F.asc("opening_id")], "_slot").join(counts, "wall_id")
    at = 0.07 + 0.86 * (F.col("_slot") - 0.5) / F.col("_n")
    return slots.select("opening_id", "wall_id", "kind", (F.col("sx") + (F.col("ex") - F.col("sx")) * at).alias("x"), (F.col("sy") + (F.col("ey") - F.col("sy")) * at).alias("y"),
                        F.least(F.col("width"), F.greatest(F.lit(0.4), F.col("length") * 0.86 / F.col("_n") * 0.88)).alias("width"))


def light_grid(lights: DataFrame, rooms: DataFrame) -> DataFrame:
    """``fixtures`` luminaires on a grid over the room. ``rooms``: keys, x0, y0, x1, y1, ceiling_height."""
    prior = F.broadcast(dim(lights.sparkSession, "dim_lights").select("kind", F.col("power_w").alias("_p"), "default_height"))
    joined = lights.join(prior, "kind").join(rooms.select(*KEYS, "x0", "y0", "x1", "y1", "ceiling_height"), KEYS)
    w, d = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.greatest(F.lit(1), F.col("fixtures"))
    staged = joined.withColumn("_cols", F.greatest(F.lit(1), F.bround(F.sqrt(n * F.greatest(w, F.lit(0.001)) / F.greatest(d, F.lit(0.001))), 0).cast("int")))
    staged = staged.withColumn("_rows", F.greatest(F.lit(1), F.ceil(n / F.col("_cols")))).withColumn("fixture", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    col, row = F.col("fixture") % F.col("_cols"), F.floor(F.col("fixture") / F.col("_cols"))
    area = clamp(w * d / 20.0, 0.6, 2.6)
    return staged.select(*KEYS, "kind", "fixture", (F.col("x0") + w * (col + 0.5) / F.col("_cols")).alias("x"), (F.col("y0") + d * (row + 0.5) / F.col("_rows")).alias("y"),
                         F.least(F.col("default_height"), F.col("ceiling_height") - 0.05).alias("z"), F.when(F.col("is_on"), F.col("_p") * F.col("brightness") * area).otherwise(0.0).alias("power_w"))


def apply_relations(relations: DataFrame, objects: DataFrame, rooms: DataFrame) -> DataFrame:
    """Where each relation wants its subject, one pass: centered_under, beside, on_top_of, above, faces.

    ``relations``: subject_id, predicate, target_id; ``objects``: keys, object_id, category, x, y, z,
    width, depth, height, rotation_deg; ``rooms``: keys, polygon, ceiling_height.
    """
    spark = objects.sparkSession
    columns = ["object_id", "category", "x", "y", "z", "width", "depth", "height", "rotation_deg"]
    side = lambda p, extra: objects.select(*extra, *[F.col(c).alias(f"{p}_{c}") for c in columns])
    prior = F.broadcast(dim(spark, "dim_objects").select(F.col("category").alias("t_category"), "typical_h", "surface_height"))
    own = F.broadcast(dim(spark, "dim_objects").select(F.col("category").alias("s_category"), "orientation"))
    joined = (relations.withColumnsRenamed({"subject_id": "s_object_id", "target_id": "t_object_id"}).join(side("s", KEYS), "s_object_id").join(side("t", []), "t_object_id")
              .join(prior, "t_category", "left").join(own, "s_category", "left").join(rooms.select(*KEYS, "polygon", "ceiling_height"), KEYS))
    top = surface_height(F.col("t_z"), F.col("t_height"), F.coalesce("typical_h", F.lit(0.0)), F.coalesce("surface_height", F.lit(0.0)))
    angle = F.radians("t_rotation_deg")
    cos, sin = F.cos(angle), F.sin(angle)
    gap = F.col("t_width") / 2 + F.col("s_width") / 2 + BESIDE_GAP
    spot = lambda sign: (F.col("t_x") + sign * cos * gap, F.col("t_y") + sign * sin * gap)
    (ax, ay), (bx, by) = spot(1.0), spot(-1.0)
    beside = lambda c: F.when(F.col("predicate") == "beside", c)  # noqa: E731  (what goes through the outline of a room is only worked out where it is asked for)
    staged = joined.withColumns({"_top": top, "_ax": ax, "_ay": ay, "_bx": bx, "_by": by}).withColumns({
        "_ina": beside(g.in_polygon("_ax", "_ay", F.col("polygon"))), "_inb": beside(g.in_polygon("_bx", "_by", F.col("polygon")))})
    near_a = F.round(F.hypot(F.col("_ax") - F.col("s_x"), F.col("_ay") - F.col("s_y")) - F.hypot(F.col("_bx") - F.col("s_x"), F.col("_by") - F.col("s_y")), 9) <= 0
    first = F.when(F.col("_ina") == F.col("_inb"), near_a).otherwise(F.col("_ina"))
    letters = F.split(F.col("s_object_id").cast("string"), "")
    seed = F.aggregate(letters, F.lit(0), lambda a, c: a + F.ascii(c))
    free = lambda t, s: F.greatest(F.lit(0.0), (F.col(f"t_{t}") - F.col(f"s_{s}")) / 2)
    ox = (seed % 7 / 6.0 - 0.5) * 1.4 * free("width", "width")
    oy = (F.floor(seed / 7) % 5 / 4.0 - 0.5) * 1.4 * free("depth", "depth")
    p = F.col("predicate")
    high = F.col("_top") + 0.9
    above = F.greatest(F.lit(0.0), F.when(F.round(high - F.col("ceiling_height"), 9) >= 0, F.col("ceiling_height") - F.col("s_height") - 0.05).otherwise(high))
    margin = F.greatest("s_width", "s_depth") / 2
    staged = staged.withColumn("_beside", beside(g.clamp_inside(F.when(first, F.col("_ax")).otherwise(F.col("_bx")), F.when(first, F.col("_ay")).otherwise(F.col("_by")), F.col("polygon"), margin)))
    pick = lambda under, beside, on, over, keep: F.when(p == "centered_under", under).when(p == "beside", beside).when(p == "on_top_of", on).when(p == "above", over).otherwise(keep)
    heading = g.heading_toward("s_x", "s_y", F.col("t_x"), F.col("t_y"))
    turned = F.when((p == "faces") & (F.coalesce("orientation", F.lit("free")) != "free") & (F.hypot(F.col("s_x") - F.col("t_x"), F.col("s_y") - F.col("t_y")) >= 0.001), heading)
    return staged.select(
        *KEYS, F.col("s_object_id").alias("subject_id"), "predicate", F.col("t_object_id").alias("target_id"),
        pick(F.col("t_x"), F.col("_beside.x"), F.col("t_x") + ox * cos - oy * sin, F.col("t_x"), F.col("s_x")).alias("x"),
        pick(F.col("t_y"), F.col("_beside.y"), F.col("t_y") + ox * sin + oy * cos, F.col("t_y"), F.col("s_y")).alias("y"),
        pick(F.lit(0.0), F.col("s_z"), F.col("_top"), above, F.col("s_z")).alias("z"),
        F.coalesce(turned, F.when(p.isin("centered_under", "beside"), F.col("t_rotation_deg")), F.col("s_rotation_deg")).alias("rotation_deg"))


def fit_tests(poses: DataFrame, rooms: DataFrame, obstacles: DataFrame, windows: DataFrame) -> DataFrame:
    """Whether given poses fit: size share, inside the outline, no overlap, no blocked window, room to use it.

    ``poses``: keys, pose_id, x, y, width, depth, height, rotation_deg; ``obstacles``: keys, object_id
    and footprint; ``windows``: keys, opening_id, x, y, width. Adds ``reason``, empty when it fits.
    """
    placed = poses.join(rooms.select(*KEYS, "polygon", "area"), KEYS)
    corners = g.rect_corners("x", "y", "width", "depth", "rotation_deg")
    placed = placed.withColumn("_c", corners)
    large = (F.col("height") > 0.1) & (F.col("area") > 0) & (F.round(F.col("width") * F.col("depth") - 0.6 * F.col("area"), 9) > 0)
    inside = F.forall("_c", lambda c: g.in_polygon(c["x"], c["y"], F.col("polygon")))
    shape = [*KEYS, "x", "y", "width", "depth", "rotation_deg"]
    solid = obstacles.select("object_id", *shape)
    touching = lambda left: measured_pairs(footprint_pairs(left, solid, KEYS), "_depth", g.rect_overlap).filter(F.round("_depth", 9) > 1e-9).select(F.col("a_pose_id").alias("pose_id")).distinct()
    hit = touching(poses.select("pose_id", *shape)).withColumn("_hit", F.lit(True))
    gap = F.greatest(F.lit(0.6), F.col("depth") * 0.5)
    ahead = F.col("depth") / 2 + gap / 2
    angle = F.radians("rotation_deg")
    front = poses.select("pose_id", *KEYS, (F.col("x") - F.sin(angle) * ahead).alias("x"), (F.col("y") + F.cos(angle) * ahead).alias("y"), (F.col("width") * 0.8).alias("width"), gap.alias("depth"), "rotation_deg")
    cramped = touching(front).withColumn("_cramped", F.lit(True))
    panes = windows.select(*KEYS, F.col("x").alias("_wx"), F.col("y").alias("_wy"), (F.greatest("width", F.lit(0.9)) / 2 + 0.35).alias("_reach"))
    tall = placed.filter("height > 1.1").select(*KEYS, "pose_id", F.explode("_c").alias("c"))
    shaded = tall.join(panes, KEYS).filter(F.round(F.hypot(F.col("c.x") - F.col("_wx"), F.col("c.y") - F.col("_wy")) - F.col("_reach"), 9) <= 0).select("pose_id").distinct().withColumn("_shaded", F.lit(True))
    joined = placed.join(hit, "pose_id", "left").join(cramped, "pose_id", "left").join(shaded, "pose_id", "left")
    reason = (F.when(large, "too large for the room").when(~inside, "outside the outline").when(F.col("_hit"), "overlaps").when(F.col("_shaded"), "blocks a window").when(F.col("_cramped"), "no room to use it").otherwise(""))
    return joined.select(*KEYS, "pose_id", reason.alias("reason"))


def spread_lights(rooms: DataFrame, counts: DataFrame) -> DataFrame:
    """``n`` ceiling lights along the longer axis, the centroid where a point would hang outside. ``counts``: keys, n."""
    x0, y0, x1, y1 = polygon_bounds(F.col("polygon"))
    staged = rooms.join(counts, KEYS).filter("n > 0").withColumns({"_mid": g.polygon_centroid(F.col("polygon")), "_x0": x0, "_y0": y0, "_x1": x1, "_y1": y1}).withColumn("light_no", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    t = F.col("light_no") / (F.col("n") + 1)
    wide = F.col("_x1") - F.col("_x0") >= F.col("_y1") - F.col("_y0")
    x = F.when(wide, F.col("_x0") + (F.col("_x1") - F.col("_x0")) * t).otherwise(F.col("_mid.x"))
    y = F.when(wide, F.col("_mid.y")).otherwise(F.col("_y0") + (F.col("_y1") - F.col("_y0")) * t)
    staged = staged.withColumns({"_x": x, "_y": y})
    keep = (F.col("n") > 1) & g.in_polygon("_x", "_y", F.col("polygon"))
    return staged.select(*KEYS, "light_no", F.when(keep, F.col("_x")).otherwise(F.col("_mid.x")).alias("x"), F.when(keep, F.col("_y")).otherwise(F.col("_mid.y")).alias("y"))


def item_defaults(items: DataFrame, rooms: DataFrame, palettes: DataFrame) -> DataFrame:
    """Size (catalog, shrunk to nine tenths of the room) and palette colour by group for planned items."""
    prior = F.broadcast(dim(items.sparkSession, "dim_objects").select("category", "obj_group", "typical_w", "typical_d", "typical_h"))
    joined = items.join(prior, "category").join(rooms.select(*KEYS, "room_width", "room_depth", "ceiling_height"), KEYS).join(palettes.select(*KEYS, "furniture_hex", "decor_hex", "primary_hex"), KEYS, "left")
    shade = F.when(F.col("obj_group") == "furniture", F.col("furniture_hex")).when(F.col("obj_group") == "decor", F.col("decor_hex")).otherwise(F.col("primary_hex"))
    return joined.select(*KEYS, "category", "item_index", F.least("typical_w", F.col("room_width") * 0.9).alias("width"), F.least("typical_d", F.col("room_depth") * 0.9).alias("depth"),
                         F.least("typical_h", F.col("ceiling_height") * 0.95).alias("height"), F.coalesce(shade, F.lit("#BFBFBF")).alias("color_hex"))


