"""Per-drawing resolution: units, north, structural extent, segment measures and selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import dim
from ..functions import geometry as g
from .scale import medians_within

DRAWING = "drawing_id"
PLAUSIBLE = (3.0, 500.0)
SHORT_ON_READ = 0.02
SHORT_ON_EXPORT = 0.05
STRUCTURAL_ROLES = ["wall", "door", "window", "column", "stair"]
# Roles that never bound a building.
ANNOTATION_ROLES = [
    "text", "dimension", "annotation", "grid", "title_block", "furniture", "casework", "appliance",
    "plumbing_fixture", "equipment", "area", "construction",
]


def _units(scale, name, method: str, confidence) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(scale).cast("double").alias("scale"), lit(name).alias("unit_name"), F.lit(method).alias("method"), lit(confidence).cast("double").alias("confidence"))


def units_from_extent(extent: Column) -> Column:
    band = lambda scale, name: _units(scale, name, "heuristic", F.when(
        (extent * scale >= PLAUSIBLE[0]) & (extent * scale <= PLAUSIBLE[1]), 0.55).otherwise(0.25))
    return (F.when(F.coalesce(extent, F.lit(0.0)) <= 0, _units(1.0, "unknown", "heuristic", 0.0))
            .when((extent >= 150) & (extent < 1e9), band(0.001, "millimetres")).when((extent >= 60) & (extent < 150), band(0.3048, "feet"))
            .when(extent < 60, band(1.0, "metres")).otherwise(_units(1.0, "metres", "heuristic", 0.2)))


def printed_number(text: Column) -> Column:
    tight = F.replace(text, F.lit(" "), F.lit(""))
    return F.nullif(F.replace(F.regexp_extract(tight, r"([0-9]+(?:[.,][0-9]+)?)", 1), F.lit(","), F.lit(".")), F.lit("")).try_cast("double")


def units_from_dimensions(dimensions: DataFrame) -> DataFrame:
    """Scale on which at least two printed dimensions agree within 2 % of their upper median.

    The upper median comes from distributed ranks, so no drawing's ratios meet in one task; the
    spread test only needs the smallest and largest ratio.
    """
    ratio = F.when(F.col("measurement") > 0, F.col("measurement") / F.when(printed_number(F.col("text")) > 0, printed_number(F.col("text"))))
    ratios = dimensions.withColumn("_r", ratio).filter("_r IS NOT NULL").select(DRAWING, "entity_id", "_r")
    bounds = ratios.groupBy(DRAWING).agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"), F.count("*").alias("_n")).filter("_n >= 2")
    grouped = bounds.join(medians_within(ratios, [DRAWING], ["_r"], "entity_id", upper=True), DRAWING).withColumnRenamed("median__r", "_m")
    agreed = grouped.filter((F.col("_n") >= 2) & (F.abs(F.col("_lo") / F.col("_m") - 1) <= 0.02) & (F.abs(F.col("_hi") / F.col("_m") - 1) <= 0.02))
    near = lambda expected: F.abs(F.col("_m") - expected) < 0.02 * expected
    verdict = F.when(near(1.0) | near(1000.0), _units(0.001, "millimetres", "dimension", 0.90))
    return agreed.select(DRAWING, verdict.alias("_dims")).filter("_dims IS NOT NULL")


def resolve_units(drawings: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Ranked: caller scale, header code, agreeing dimensions, extent bands.

    ``drawings``: drawing_id, insunits, user_scale, width, height.
    """
    header = dim(drawings.sparkSession, "dim_insunits").withColumnsRenamed({"scale": "_scale", "unit_name": "_name"})
    extent = F.greatest("width", "height")
    joined = drawings.join(F.broadcast(header), "insunits", "left").join(units_from_dimensions(dimensions), DRAWING, "left")
    metres = extent * F.col("_scale")
    fits = (metres == 0) | ((metres >= PLAUSIBLE[0]) & (metres <= PLAUSIBLE[1]))
    guess = units_from_extent(extent)
    overridden = _units(guess["scale"], guess["unit_name"], "heuristic", F.least(guess["confidence"], F.lit(0.5)))
    custom = (F.col("user_scale") > 0) & (F.abs(F.col("user_scale") - 1.0) > 1e-9)
    verdict = (F.when(custom, _units(F.col("user_scale"), "user-specified", "user", 1.0))
               .when(F.col("_scale").isNotNull(), F.when(fits, _units(F.col("_scale"), F.col("_name"), "header", 0.97)).otherwise(overridden))
               .otherwise(F.coalesce("_dims", guess)))
    return joined.withColumn("_u", verdict).select(DRAWING, "_u.*")


def resolve_north(drawings: DataFrame) -> DataFrame:
    """``drawings``: drawing_id, north_direction (radians) and arrow_rotation (degrees), both nullable."""
    full = lambda v: F.pmod(v, F.lit(360.0))
    return drawings.select(
        DRAWING,
        F.coalesce(full(F.degrees("north_direction") - 90.0), full(F.col("arrow_rotation")), F.lit(0.0)).alias("heading_deg"),
        F.when(F.col("north_direction").isNotNull(), "cad_metadata").when(F.col("arrow_rotation").isNotNull(), "cad_block").otherwise("reasoning").alias("source"),
        F.when(F.col("north_direction").isNotNull(), 0.95).when(F.col("arrow_rotation").isNotNull(), 0.70).otherwise(0.15).alias("confidence"))


def structural_extent(segments: DataFrame) -> DataFrame:
    """Bounds per drawing over structural roles, else everything but annotation, else everything."""
    tiers = {"s": F.col("role").isin(*STRUCTURAL_ROLES), "n": ~F.col("role").isin(*ANNOTATION_ROLES), "a": F.lit(True)}
    measures = {"min_x": (F.min, F.least("sx", "ex")), "min_y": (F.min, F.least("sy", "ey")), "max_x": (F.max, F.greatest("sx", "ex")), "max_y": (F.max, F.greatest("sy", "ey"))}
    aggregates = [fn(F.when(cond, col)).alias(f"_{t}_{m}") for t, cond in tiers.items() for m, (fn, col) in measures.items()]
    bounds = segments.groupBy(DRAWING).agg(*aggregates).select(DRAWING, *[F.coalesce(*[F.col(f"_{t}_{m}") for t in tiers]).alias(m) for m in measures])
    return bounds.withColumns({"origin_x": (F.col("min_x") + F.col("max_x")) / 2, "origin_y": (F.col("min_y") + F.col("max_y")) / 2})


def to_metres(segments: DataFrame, units: DataFrame, origins: DataFrame) -> DataFrame:
    """Scale, then move the structural centre to the origin, to a thousandth of a millimetre."""
    joined = segments.join(units.select(DRAWING, "scale"), DRAWING).join(origins.select(DRAWING, "origin_x", "origin_y"), DRAWING)
    moved = {c: F.round((F.col(c) - F.col("origin_x" if c.endswith("x") else "origin_y")) * F.col("scale"), 6) for c in ("sx", "sy", "ex", "ey")}
    return joined.withColumns(moved).drop("scale", "origin_x", "origin_y")


def measure_segments(segments: DataFrame) -> DataFrame:
    return segments.withColumns({
        "length": g.segment_length("sx", "sy", "ex", "ey"), "mid_x": (F.col("sx") + F.col("ex")) / 2, "mid_y": (F.col("sy") + F.col("ey")) / 2,
        "angle_deg": g.segment_heading("sx", "sy", "ex", "ey", 180.0)})


def drop_short(segments: DataFrame, shortest: float = SHORT_ON_READ) -> tuple[DataFrame, DataFrame]:
    """(kept segments, removed count per drawing)."""
    length = g.segment_length("sx", "sy", "ex", "ey")
    removed = segments.groupBy(DRAWING).agg(F.count_if(length < shortest).alias("removed"))
    return segments.filter(length >= shortest), removed


def select_walls(segments: DataFrame, wanted_layers: list[str]) -> DataFrame:
    """The requested layers where a drawing has any of them, else its wall-role segments."""
    wanted = F.upper("layer").isin(*[name.upper() for name in wanted_layers]) if wanted_layers else F.lit(False)
    flagged = segments.withColumn("_wanted", wanted)
    has = flagged.groupBy(DRAWING).agg(F.bool_or("_wanted").alias("_any"))
    return flagged.join(has, DRAWING).filter(F.when(F.col("_any"), F.col("_wanted")).otherwise(F.col("role") == "wall")).drop("_wanted", "_any")


def distinct_segments(segments: DataFrame) -> DataFrame:
    """One row per drawing and unordered pair of end points; the smallest entity id stays."""
    a, b = g.point("sx", "sy"), g.point("ex", "ey")
    keyed = segments.withColumns({"_a": F.least(a, b), "_b": F.greatest(a, b)})
    kept = F.min(F.struct("entity_id", *[c for c in segments.columns if c not in (DRAWING, "entity_id")])).alias("s")
    return keyed.groupBy(DRAWING, "_a", "_b").agg(kept).select(DRAWING, "s.*").select(segments.columns)


def polyline_segments(polylines: DataFrame) -> DataFrame:
    """``polylines``: drawing_id, entity_id, points array<struct<x,y>>, closed -> one row per step."""
    ring = F.when(F.col("closed") & (F.size("points") > 2), F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_ring") - 1, F.lit(1))), lambda i: F.struct(
        i.alias("step"), F.try_element_at("_ring", i).alias("a"), F.try_element_at("_ring", i + 1).alias("b")))
    rows = polylines.withColumn("_ring", ring).filter(F.size("_ring") >= 2).select(DRAWING, "entity_id", F.explode(steps).alias("s"))
    flat = rows.select(DRAWING, "entity_id", F.col("s.step").alias("step"), F.col("s.a.x").alias("sx"), F.col("s.a.y").alias("sy"), F.col("s.b.x").alias("ex"), F.col("s.b.y").alias("ey"))
    return flat.filter((F.col("sx") != F.col("ex")) | (F.col("sy") != F.col("ey")))


def tessellate_arcs(arcs: DataFrame, chords: int = 16) -> DataFrame:
    """``arcs``: drawing_id, entity_id, cx, cy, rx, ry, rotation_deg, start_deg, end_deg -> chords.

    An end angle at or below the start runs through 360; a full circle is 0..360.
    """
    span = F.when(F.col("end_deg") <= F.col("start_deg"), F.col("end_deg") + 360.0).otherwise(F.col("end_deg")) - F.col("start_deg")
    steps = arcs.withColumn("_span", span).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(chords - 1))))

    def at(i: Column) -> tuple[Column, Column]:
        angle = F.radians(F.col("start_deg") + F.col("_span") * i / chords)
        turn = F.radians("rotation_deg")
        px, py = F.col("rx") * F.cos(angle), F.col("ry") * F.sin(angle)
        return F.col("cx") + px * F.cos(turn) - py * F.sin(turn), F.col("cy") + px * F.sin(turn) + py * F.cos(turn)

    (sx, sy), (ex, ey) = at(F.col("step")), at(F.col("step") + 1)
    return steps.select(DRAWING, "entity_id", "step", sx.alias("sx"), sy.alias("sy"), ex.alias("ex"), ey.alias("ey"))


def mirrored_to_world(points: DataFrame, columns: list[str], extrusion_z: str = "extrusion_z") -> DataFrame:
    """Entities drawn on the underside (extrusion 0,0,-1) mirror their x coordinates."""
    return points.withColumns({c: F.when(F.col(extrusion_z) < 0, -F.col(c)).otherwise(F.col(c)) for c in columns})


def histograms(entities: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of several columns in one pass over the data: (drawing, column, value, n)."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return entities.select(DRAWING, rows.alias("h")).groupBy(DRAWING, "h.field", "h.value").agg(F.count("*").alias("n"))


def layer_table(entities: DataFrame, declared: DataFrame) -> DataFrame:
    """Every declared layer with its entity count, and layers that only occur on entities."""
    counted = entities.groupBy(DRAWING, F.upper("layer").alias("_key")).agg(F.count("*").alias("entities"), F.min("layer").alias("_seen"))
    listed = declared.withColumn("_key", F.upper("layer"))
    return listed.join(counted, [DRAWING, "_key"], "full_outer").select(
        DRAWING, F.coalesce("layer", "_seen").alias("layer"), F.coalesce("entities", F.lit(0)).alias("entities"), F.col("layer").isNotNull().alias("declared"))


def inherited_layer(layer: Column, parent: Column) -> Column:
    """Entities of a block that sit on layer 0 take the layer the block was placed on."""
    return F.when((layer == "0") & (F.coalesce(parent, F.lit("")) != ""), parent).otherwise(layer)


def plan_bounds(segments: DataFrame) -> DataFrame:
    return segments.groupBy(DRAWING).agg(
        F.min(F.least("sx", "ex")).alias("min_x"), F.min(F.least("sy", "ey")).alias("min_y"),
        F.max(F.greatest("sx", "ex")).alias("max_x"), F.max(F.greatest("sy", "ey")).alias("max_y"), F.count("*").alias("segments"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
