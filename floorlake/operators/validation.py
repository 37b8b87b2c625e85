"""Plausibility reports over placed objects. Every check returns issue rows; corrections are columns.

Objects: building_id, room_id, object_id, category, support, support_id, x, y, z, width, depth, height,
rotation_deg, confidence, locked, flags. Rooms: building_id, room_id, polygon, ceiling_height.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .scale import top_within
from .spatial import BUILDING, footprint_pairs, measured_pairs, polygon_bounds

OVERLAP_TOLERANCE = 0.02
FLOAT_TOLERANCE = 0.02
MAX_FOOTPRINT_SHARE = 0.55
MIN_CIRCULATION = 0.6
DOOR_CLEARANCE = 0.9
OBSTACLE_FOOTPRINT = 0.15
STEP_OVER_HEIGHT = 0.12
WALKABLE = ["rug", "carpet"]
CONTAINMENT_TOLERANCE = 0.35
KEYS = [BUILDING, "room_id"]


def degenerate() -> Column:
    return (F.col("width") <= 0) | (F.col("depth") <= 0) | (F.col("height") <= 0)


def in_rooms(objects: DataFrame, rooms: DataFrame) -> DataFrame:
    return objects.join(rooms.select(*KEYS, "polygon", "ceiling_height"), KEYS)


def _issue(df: DataFrame, kind: str, severity: str, corrected: bool, subject: str = "object_id", target: Column | None = None) -> DataFrame:
    return df.select(
        *KEYS, F.col(subject).cast("long").alias("subject"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"),
        F.lit(corrected).alias("corrected"), (target if target is not None else F.lit(None)).cast("long").alias("target"))


def check_scale(placed: DataFrame) -> DataFrame:
    x0, y0, x1, y1 = polygon_bounds(F.col("polygon"))
    share = F.col("width") * F.col("depth") / F.greatest(F.lit(1e-6), (x1 - x0) * (y1 - y0))
    return _issue(placed.filter(degenerate()), "degenerate_dimensions", "error", False).unionByName(
        _issue(placed.filter(~degenerate() & _more(share, MAX_FOOTPRINT_SHARE)), "implausible_scale", "error", False)).unionByName(
        _issue(placed.filter(~degenerate() & (F.col("height") > F.col("ceiling_height"))), "taller_than_room", "warning", True))


def check_containment(placed: DataFrame) -> DataFrame:
    """Standing objects whose centre is outside their room, with the point they would be moved to."""
    outside = placed.filter(~F.col("support").isin("wall", "ceiling", "on_object") & ~g.in_polygon("x", "y", F.col("polygon")))
    moved = outside.withColumn("_to", g.clamp_inside("x", "y", F.col("polygon"), F.greatest("width", "depth") / 2))
    return moved.select(*KEYS, "object_id", F.col("_to.x").alias("to_x"), F.col("_to.y").alias("to_y"),
                        F.hypot(F.col("x") - F.col("_to.x"), F.col("y") - F.col("_to.y")).alias("moved"))


def surface_height(z: Column, height: Column, typical: Column, surface: Column) -> Column:
    """Top of a supporting object: the catalog surface scaled by its height, else its full height."""
    return F.when((surface > 0) & (typical > 0), z + surface * height / typical).otherwise(z + height)


def check_support(objects: DataFrame, catalog: DataFrame) -> DataFrame:
    """``catalog``: category, typical_height, surface_height (a fixed table)."""
    floor = objects.filter((F.col("support") == "floor") & _more(F.abs("z"), FLOAT_TOLERANCE))
    mounted = objects.filter(F.col("support").isin("wall", "ceiling") & (F.col("z") < 0))
    carriers = objects.join(F.broadcast(catalog), "category", "left").select(
        *KEYS, F.col("object_id").alias("support_id"),
        surface_height(F.col("z"), F.col("height"), F.coalesce("typical_height", F.lit(0.0)), F.coalesce("surface_height", F.lit(0.0))).alias("_top"))
    resting = objects.filter(F.col("support") == "on_object").join(carriers, [*KEYS, "support_id"], "left")
    return (
        _issue(floor, "floating_object", "warning", True)
        .unionByName(_issue(resting.filter("_top IS NULL"), "missing_support", "warning", False))
        .unionByName(_issue(resting.filter(_more(F.abs(F.col("z") - F.col("_top")), 0.03)), "misaligned_support", "warning", True, target=F.col("support_id")))
        .unionByName(_issue(mounted, "below_floor", "warning", True)))


def check_ceiling(placed: DataFrame) -> DataFrame:
    excess = F.col("z") + F.col("height") - F.col("ceiling_height")
    high = placed.withColumn("_excess", excess).filter(_more(F.col("_excess"), 0.01))
    trim = (F.col("support") == "floor") & (F.col("_excess") - F.col("height") * 0.4 < -5e-10)
    return _issue(high.filter(trim), "through_ceiling", "warning", True).unionByName(
        _issue(high.filter(~trim), "through_ceiling", "error", False))


def check_lights(lights: DataFrame, rooms: DataFrame) -> DataFrame:
    placed = in_rooms(lights, rooms)
    dark = rooms.join(lights.filter("NOT uncertain AND power_w > 0").select(*KEYS).distinct(), KEYS, "left_anti")
    return (
        _issue(placed.filter(~g.in_polygon("x", "y", F.col("polygon"))), "light_outside_room", "warning", True, "light_id")
        .unionByName(_issue(placed.filter("z > ceiling_height"), "light_above_ceiling", "warning", True, "light_id"))
        .unionByName(_issue(placed.filter("power_w < 0"), "negative_power", "warning", True, "light_id"))
        .unionByName(_issue(dark, "no_lighting", "warning", False, "room_id")))


def wall_crossings(objects: DataFrame, walls: DataFrame) -> DataFrame:
    """First wall (in wall order) a standing object's outline crosses. ``walls`` carry the room that sees them."""
    standing = objects.filter((F.col("support") == "floor") & ~degenerate() & (F.col("height") >= 0.06))
    length = g.segment_length("sx", "sy", "ex", "ey")
    thin = walls.select(*KEYS, "wall_id", "sx", "sy", "ex", "ey", ((F.col("sx") + F.col("ex")) / 2).alias("x"), ((F.col("sy") + F.col("ey")) / 2).alias("y"),
                        length.alias("width"), F.lit(1e-9).alias("depth"), F.degrees(F.atan2(F.col("ey") - F.col("sy"), F.col("ex") - F.col("sx"))).alias("rotation_deg"))
    near = footprint_pairs(standing.select(*KEYS, "object_id", "x", "y", "width", "depth", "rotation_deg"), thin, KEYS, halo=1e-6)
    edge = F.explode(g.edges(g.rect_corners("a_x", "a_y", "a_width", "a_depth", "a_rotation_deg"))).alias("e")
    crossing = near.select(*KEYS, "a_object_id", "b_wall_id", "b_sx", "b_sy", "b_ex", "b_ey", edge).filter(
        g.segments_cross("e.x0", "e.y0", "e.x1", "e.y1", "b_sx", "b_sy", "b_ex", "b_ey"))
    return crossing.groupBy(*KEYS, F.col("a_object_id").alias("object_id")).agg(F.min("b_wall_id").alias("wall_id"))


def _more(value: Column, limit: float) -> Column:
    """Greater by more than half a nanometre, so a measure that equals the limit on paper is not over it."""
    return value > limit + 5e-10


def _more_rounded(value: Column, limit: float) -> Column:
    """``_more`` of the value rounded to nine places, for a limit of as many; rounding is only asked where it decides."""
    return (value > limit + 4e-10) & ((value > limit + 6e-10) | _more(F.round(value, 9), limit))


def collisions(objects: DataFrame) -> DataFrame:
    """Pairs of footprints that penetrate each other by more than the tolerance."""
    usable = objects.filter(F.col("support").isin("floor", "on_object") & ~degenerate()).select(
        *KEYS, "object_id", "support_id", "x", "y", "z", "width", "depth", "height", "rotation_deg")
    pairs = footprint_pairs(usable, usable, KEYS, once="object_id")
    stacked = F.coalesce(F.col("a_support_id") == F.col("b_object_id"), F.lit(False)) | F.coalesce(F.col("b_support_id") == F.col("a_object_id"), F.lit(False))
    level = _more(F.least(F.col("a_z") + F.col("a_height"), F.col("b_z") + F.col("b_height")) - F.greatest("a_z", "b_z"), 0.02)
    hit = measured_pairs(pairs.filter(~stacked & level), "_depth", g.rect_overlap)
    return hit.filter(_more_rounded(F.col("_depth"), OVERLAP_TOLERANCE)).select(*KEYS, "a_object_id", "b_object_id", F.round("_depth", 9).alias("penetration"))


HAND_FLAGS = ["position_set_by_user", "rotation_z_set_by_user", "dimensions_set_by_user"]


def user_conflicts(objects: DataFrame, limit: int | None = None) -> DataFrame:
    """Conflicts, or the first ``limit`` of each building, of objects placed by hand, against everything solid in the room."""
    columns = [*KEYS, "object_id", "support_id", "x", "y", "z", "width", "depth", "height", "rotation_deg"]
    by_hand = F.exists("flags", _starts)
    pairs = footprint_pairs(objects.filter(by_hand).select(*columns), objects.filter(~degenerate()).select(*columns), KEYS)
    stacked = F.coalesce(F.col("a_support_id") == F.col("b_object_id"), F.lit(False)) | F.coalesce(F.col("b_support_id") == F.col("a_object_id"), F.lit(False))
    apart = (F.col("a_z") + F.col("a_height") <= F.col("b_z")) | (F.col("b_z") + F.col("b_height") <= F.col("a_z"))
    hit = measured_pairs(pairs.filter((F.col("a_object_id") != F.col("b_object_id")) & ~stacked & ~apart), "_depth", g.rect_overlap)
    unordered = hit.filter(_more_rounded(F.col("_depth"), OVERLAP_TOLERANCE)).withColumn("penetration", F.round("_depth", 9)).groupBy(
        *KEYS, F.least("a_object_id", "b_object_id").alias("first_id"), F.greatest("a_object_id", "b_object_id").alias("second_id")).agg(
        F.max("penetration").alias("penetration"))
    return unordered if limit is None else top_within(unordered, [BUILDING], [F.asc("first_id"), F.asc("second_id")], limit)


def _starts(flag: Column) -> Column:
    return reduce(lambda a, b: a | b, [flag.startswith(f) for f in HAND_FLAGS])


def obstacles(objects: DataFrame) -> DataFrame:
    return objects.filter((F.col("support") == "floor") & ~F.col("category").isin(*WALKABLE) & (F.col("height") > STEP_OVER_HEIGHT) & ~degenerate())


def narrow_gaps(objects: DataFrame, width: float = MIN_CIRCULATION) -> DataFrame:
    solid = obstacles(objects).filter(F.col("width") * F.col("depth") >= OBSTACLE_FOOTPRINT).select(
        *KEYS, "object_id", "x", "y", "width", "depth", "rotation_deg")
    pairs = footprint_pairs(solid, solid, KEYS, halo=width, once="object_id")
    apart = measured_pairs(measured_pairs(pairs, "_depth", g.rect_overlap).filter(~_more(F.col("_depth"), 0.0)), "_gap", g.rect_gap)
    return apart.filter((F.col("_gap") < width) & _more_rounded(F.col("_gap"), 1e-6)).withColumn("gap", F.round("_gap", 9)).filter(F.col("gap") < width - 5e-10).select(*KEYS, "a_object_id", "b_object_id", "gap")


def blocked_doors(objects: DataFrame, openings: DataFrame, rooms: DataFrame) -> DataFrame:
    """Obstacles inside the 0.9 m in front of a door, towards the middle of its room."""
    doors = openings.filter(F.col("kind").isin("door", "archway")).join(
        rooms.select(*KEYS, g.polygon_centroid(F.col("polygon")).alias("_mid")), KEYS)
    heading = F.atan2(F.col("_mid.y") - F.col("y"), F.col("_mid.x") - F.col("x"))
    zones = doors.withColumn("_h", heading).select(
        *KEYS, "opening_id", (F.col("x") + F.cos("_h") * (DOOR_CLEARANCE / 2)).alias("x"), (F.col("y") + F.sin("_h") * (DOOR_CLEARANCE / 2)).alias("y"),
        F.greatest("width", F.lit(0.6)).alias("width"), F.lit(DOOR_CLEARANCE).alias("depth"), (F.degrees("_h") - 90).alias("rotation_deg"))
    solid = obstacles(objects).select(*KEYS, "object_id", "x", "y", "width", "depth", "rotation_deg")
    pairs = measured_pairs(footprint_pairs(zones, solid, KEYS), "_depth", g.rect_overlap).withColumn("penetration", F.round("_depth", 9))
    return pairs.filter(_more_rounded(F.col("_depth"), OVERLAP_TOLERANCE)).select(*KEYS, F.col("a_opening_id").alias("opening_id"), F.col("b_object_id").alias("object_id"), "penetration")


def core_issues(objects: DataFrame, lights: DataFrame, rooms: DataFrame, catalog: DataFrame) -> DataFrame:
    placed = in_rooms(objects, rooms)
    outside = check_containment(placed).withColumn("kind", F.lit("outside_room"))
    return reduce(DataFrame.unionByName, [
        check_scale(placed), _issue(outside, "outside_room", "warning", True), check_support(objects, catalog),
        check_ceiling(placed), check_lights(lights, rooms)])


def issue_histogram(issues: DataFrame) -> DataFrame:
    return issues.groupBy(BUILDING, "kind").agg(F.count("*").alias("issues"), F.count_if("corrected").alias("corrected"))


def withhold(objects: DataFrame, issues: DataFrame) -> DataFrame:
    """Objects with an uncorrected error become uncertain and carry a flag."""
    bad = issues.filter("severity = 'error' AND NOT corrected").select(BUILDING, F.col("subject").alias("object_id"), F.lit(True).alias("_bad")).distinct()
    joined = objects.join(bad, [BUILDING, "object_id"], "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    return joined.withColumn("uncertain", F.col("uncertain") | F.col("_bad")).withColumn(
        "flags", F.when(F.col("_bad"), F.array_append("flags", F.lit("withheld_failed_validation"))).otherwise(F.col("flags"))).drop("_bad")


def corrected_columns(placed: DataFrame) -> DataFrame:
    """Position and height after the single-pass checks: clip to the ceiling, move inside, drop to the floor, trim."""
    clipped = placed.withColumn("_h", F.when(~degenerate() & (F.col("height") > F.col("ceiling_height")), F.col("ceiling_height") - 0.05).otherwise(F.col("height")))
    standing = ~F.col("support").isin("wall", "ceiling", "on_object")
    inside = g.in_polygon("x", "y", F.col("polygon"))
    target = g.clamp_inside("x", "y", F.col("polygon"), F.greatest("width", "depth") / 2)
    # What an explode returns stays where it is: a filter on the moved point does not work the outline out again.
    moved = clipped.withColumn("_p", F.explode(F.array(F.when(standing & ~inside, target).otherwise(g.point("x", "y")))))
    dropped = moved.withColumn("new_z", F.when((F.col("support") == "floor") & _more(F.abs("z"), FLOAT_TOLERANCE), 0.0)
                               .when(F.col("support").isin("wall", "ceiling") & (F.col("z") < 0), 0.0).otherwise(F.col("z")))
    excess = F.col("new_z") + F.col("_h") - F.col("ceiling_height")
    trim = (F.col("support") == "floor") & _more(excess, 0.01) & ((excess - F.col("_h") * 0.4 < -5e-10))
    return dropped.withColumn("new_height", F.when(trim, F.col("_h") - excess - 0.02).otherwise(F.col("_h"))).withColumn(
        "new_x", F.col("_p.x")).withColumn("new_y", F.col("_p.y")).drop("_h", "_p")


def recheck(placed: DataFrame, issues: DataFrame, respect_user_edits: bool = True) -> DataFrame:
    """Suggested corrections, report only: what differs, whether an issue explains it, whether it is protected."""
    protected = F.col("locked")
    if respect_user_edits:
        protected = protected | F.exists("flags", lambda f: f.endswith("_set_by_user"))
    fixed = corrected_columns(placed)
    changed = F.greatest(*[F.abs(F.col(c) - F.col(f"new_{c}")) for c in ("x", "y", "z", "height")]) > 1e-6
    explained = issues.select(BUILDING, F.col("subject").alias("object_id"), F.lit(True).alias("_explained")).distinct()
    return fixed.filter(changed).join(explained, [BUILDING, "object_id"], "left").select(
        *KEYS, "object_id", F.when(F.col("_explained"), "explained").otherwise("displaced").alias("kind"), protected.alias("protected"),
        "new_x", "new_y", "new_z", "new_height")


def integrity_report(objects: DataFrame, openings: DataFrame, walls: DataFrame, lights: DataFrame, relationships: DataFrame) -> DataFrame:
    """Duplicate ids, bad numbers and unresolved references as (building, kind, subject) rows.

    Each reference kind is one anti-join, so the check is linear in the entities. Ids of different
    tables are told apart by the prefixes 'object:', 'wall:' and 'light:' of ``entity`` columns.
    """
    row = lambda df, kind, subject: df.select(BUILDING, F.lit(kind).alias("kind"), F.col(subject).cast("string").alias("subject"))
    ids = objects.select(BUILDING, F.col("object_id").alias("support_id")).distinct()
    entity = lambda df, prefix, key: df.select(BUILDING, F.concat(F.lit(prefix), F.col(key).cast("string")).alias("entity"))
    known = entity(objects, "object:", "object_id").union(entity(walls, "wall:", "wall_id")).union(entity(lights, "light:", "light_id"))
    dangling = lambda side: relationships.join(known.withColumnRenamed("entity", side), [BUILDING, side], "left_anti")
    return reduce(DataFrame.unionByName, [
        row(objects.groupBy(BUILDING, "object_id").count().filter("count > 1"), "duplicate_id", "object_id"),
        row(objects.filter(degenerate()), "degenerate_dimensions", "object_id"),
        row(objects.filter("confidence < 0 OR confidence > 1"), "bad_confidence", "object_id"),
        row(objects.filter("support = 'on_object' AND support_id IS NULL"), "no_support_id", "object_id"),
        row(objects.filter("support_id IS NOT NULL").join(ids, [BUILDING, "support_id"], "left_anti"), "unresolved_support", "object_id"),
        row(openings.filter("wall_id IS NOT NULL").join(walls.select(BUILDING, "wall_id"), [BUILDING, "wall_id"], "left_anti"), "unresolved_wall", "opening_id"),
        row(dangling("subject_ref"), "unresolved_subject", "relationship_id"),
        row(dangling("object_ref"), "unresolved_object", "relationship_id"),
    ])
