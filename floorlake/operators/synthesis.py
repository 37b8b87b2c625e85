"""Concrete actions out of grouped findings: one DataFrame per action type, united by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import dim
from ..functions import colour
from ..functions import geometry as g
from .appearance import dominant_style

DAMPING = 0.75
KEYS = ["building_id", "room_id"]


def clamp(value: Column, low: float, high: float) -> Column:
    """Null stays null: greatest and least would skip it."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def damp_scale(scale: Column) -> Column:
    return F.when(scale <= 0, 1.0).otherwise(F.exp(F.log(F.when(scale > 0, scale)) * DAMPING))


def lighting_actions(findings: DataFrame, rooms: DataFrame) -> DataFrame:
    """One action per room out of its exposure, warmth and contrast findings.

    ``findings``: keys, code, reference, render (measured values); ``rooms``: keys, ambient,
    color_temperature_k, shadow_softness. Findings of a code are reduced to the first by finding_id.
    """
    first = findings.filter(F.col("code").isin("exposure", "warmth", "contrast")).groupBy(*KEYS, "code").agg(F.min(F.struct("finding_id", "reference", "render")).alias("f"))
    wide = first.groupBy(*KEYS).pivot("code", ["exposure", "warmth", "contrast"]).agg(F.first("f"))
    staged = wide.join(rooms, KEYS)
    lit = (F.col("exposure.render") > 1e-4) & (F.col("exposure.reference") > 1e-4)
    scale = clamp(damp_scale(F.col("exposure.reference") / F.when(lit, F.col("exposure.render"))), 0.4, 2.5)
    ambient = clamp(F.col("ambient") * scale, 0.02, 1.0)
    kelvin_step = clamp((F.col("warmth.render") - F.col("warmth.reference")) * 6000.0 * DAMPING, -1500.0, 1500.0)
    soft_step = clamp(-(F.col("contrast.render") - F.col("contrast.reference")) * 3.0 * DAMPING, -0.35, 0.35)
    staged = staged.withColumns({
        "new_ambient": F.when(lit & (F.abs(ambient - F.col("ambient")) > 0.01), F.round(ambient, 4)),
        "new_kelvin": F.when(F.abs(kelvin_step) >= 50.0, F.round(clamp(F.col("color_temperature_k") + kelvin_step, 1800.0, 8000.0), 1)),
        "new_softness": F.when(F.abs(soft_step) >= 0.03, F.round(clamp(F.col("shadow_softness") + soft_step, 0.0, 1.0), 3))})
    return staged.filter(F.coalesce("new_ambient", "new_kelvin", "new_softness").isNotNull()).select(
        *KEYS, F.concat(F.lit("lighting_adjustment:"), F.col("room_id").cast("string")).alias("action_id"), "new_ambient", "new_kelvin", "new_softness")


def palette_actions(findings: DataFrame, palettes: DataFrame, blend: float = 0.35) -> DataFrame:
    """Palette roles shifted 35 % towards the measured reference colour. ``findings``: keys, finding_id, reference_hex, render_hex."""
    first = findings.filter("reference_hex IS NOT NULL AND render_hex IS NOT NULL").groupBy(*KEYS).agg(F.min(F.struct("finding_id", "reference_hex")).alias("f"))
    roles = [c for c in palettes.columns if c.endswith("_hex")]
    joined = palettes.join(first, KEYS)
    long = joined.select(*KEYS, F.col("f.reference_hex").alias("toward"), F.explode(F.array(*[F.struct(F.lit(r[:-4]).alias("role"), F.col(r).alias("old_hex")) for r in roles])).alias("v")).select(*KEYS, "toward", "v.*")
    shifted = long.withColumn("new_hex", colour.blend(F.col("old_hex"), F.col("toward"), blend))
    return shifted.filter(F.upper("new_hex") != F.upper("old_hex")).withColumn("action_id", F.concat(F.lit("palette_adjustment:"), F.col("room_id").cast("string")))


def placement_actions(findings: DataFrame, objects: DataFrame) -> DataFrame:
    """Damped moves towards where the reference places an object: 2 cm at least, 3 m at most."""
    first = findings.groupBy("object_id").agg(F.min(F.struct("finding_id", "implied_x", "implied_y", "actual_x", "actual_y")).alias("f"))
    joined = first.join(objects.select("object_id", *KEYS), "object_id")
    dx, dy = (F.col("f.implied_x") - F.col("f.actual_x")) * DAMPING, (F.col("f.implied_y") - F.col("f.actual_y")) * DAMPING
    staged = joined.withColumns({"_dx": dx, "_dy": dy, "_d": F.hypot(dx, dy)}).filter(F.round("_d", 9) >= 0.02)
    factor = F.when(F.col("_d") > 3.0, 3.0 / F.col("_d")).otherwise(1.0)
    return staged.select(*KEYS, "object_id", F.concat(F.lit("furniture_translation:"), F.col("object_id").cast("string")).alias("action_id"), F.round(F.col("_dx") * factor, 4).alias("dx"), F.round(F.col("_dy") * factor, 4).alias("dy"))


def camera_actions(findings: DataFrame, viewpoints: DataFrame) -> DataFrame:
    """Damped move against the offset every object of a view shares: 5 cm at least, 4 m at most."""
    first = findings.groupBy("viewpoint_id").agg(F.min(F.struct("finding_id", "offset_x", "offset_y")).alias("f")).join(viewpoints.select("viewpoint_id"), "viewpoint_id", "left_semi")
    dx, dy = -F.col("f.offset_x") * DAMPING, -F.col("f.offset_y") * DAMPING
    staged = first.withColumns({"_dx": dx, "_dy": dy, "_d": F.hypot(dx, dy)}).filter(F.round("_d", 9) >= 0.05)
    factor = F.when(F.col("_d") > 4.0, 4.0 / F.col("_d")).otherwise(1.0)
    return staged.select("viewpoint_id", F.concat(F.lit("camera_correction:"), F.col("viewpoint_id").cast("string")).alias("action_id"), F.round(F.col("_dx") * factor, 4).alias("dx"), F.round(F.col("_dy") * factor, 4).alias("dy"))


def rotation_actions(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    """Objects that should face another but do not (5 degrees and more). ``relationships``: subject_id, predicate, object_id, satisfied, ordinal."""
    facing = relationships.filter(~F.col("satisfied") & F.col("predicate").isin("faces", "facing", "oriented_toward"))
    target = objects.select(F.col("object_id").alias("target_id"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    pairs = facing.select(F.col("object_id").alias("target_id"), F.col("subject_id").alias("object_id"), "ordinal").join(target, "target_id").groupBy("object_id").agg(F.min(F.struct("ordinal", "target_id", "tx", "ty")).alias("t"))
    staged = objects.join(pairs, "object_id").withColumn("heading", g.heading_toward("x", "y", F.col("t.tx"), F.col("t.ty")))
    delta = F.pmod(F.col("heading") - F.col("rotation_deg") + 180.0, F.lit(360.0)) - 180.0
    return staged.withColumn("delta_deg", delta).filter(F.round(F.abs("delta_deg"), 9) >= 5.0).select(
        *KEYS, "object_id", F.concat(F.lit("furniture_rotation:"), F.col("object_id").cast("string")).alias("action_id"), F.round("heading", 2).alias("rotation_z"), F.round("delta_deg", 2).alias("delta_deg"), F.col("t.target_id").alias("toward"))


def asset_actions(matched: DataFrame, current: DataFrame) -> DataFrame:
    """Rebuild from the best variant where it differs, else try the alphabetically first other one.

    ``matched``: object_id, asset, asset_score (best match); ``current``: object_id, category, asset.
    """
    spark = matched.sparkSession
    variants = dim(spark, "dim_assets").select("category", F.col("asset").alias("_v"))
    base = current.withColumnRenamed("asset", "previous").join(matched.select("object_id", "asset", "asset_score"), "object_id")
    real = ~F.col("asset").startswith("generic_")
    better = base.filter(real & (F.col("asset") != F.col("previous"))).select("object_id", F.lit("asset_replacement").alias("action_type"), "asset", "previous")
    same = base.filter(~(real & (F.col("asset") != F.col("previous"))))
    other = same.join(F.broadcast(variants), "category").filter("_v <> previous").groupBy("object_id", "previous").agg(F.min("_v").alias("asset"))
    return better.unionByName(other.select("object_id", F.lit("asset_variant_swap").alias("action_type"), "asset", "previous")).withColumn("action_id", F.concat_ws(":", "action_type", F.col("object_id").cast("string")))


def scale_actions(objects: DataFrame, matched: DataFrame, least: float = 0.15) -> DataFrame:
    """Proportions off by 0.15 and more against the matched variant, damped; the signature is divided by its height."""
    signature = F.broadcast(dim(objects.sparkSession, "dim_assets").select("asset", "sig_w", "sig_d", "sig_h"))
    staged = objects.select(*KEYS, "object_id", "width", "depth", "height").join(matched.select("object_id", "asset"), "object_id").join(signature, "asset").filter("height > 1e-6")
    now = {"w": F.col("width") / F.col("height"), "d": F.col("depth") / F.col("height")}
    goal = {k: F.when(F.col("sig_h") != 0, F.col(f"sig_{k}") / F.col("sig_h")).otherwise(now[k]) for k in now}
    off = F.greatest(F.abs(now["w"] - goal["w"]), F.abs(now["d"] - goal["d"]))
    new = {k: F.col("height") * (now[k] + (goal[k] - now[k]) * DAMPING) for k in now}
    return staged.withColumn("disagreement", off).filter(F.round("disagreement", 9) >= least).select(
        *KEYS, "object_id", F.concat(F.lit("furniture_scale_refinement:"), F.col("object_id").cast("string")).alias("action_id"), F.round(new["w"] + 1e-9, 4).alias("width"), F.round(new["d"] + 1e-9, 4).alias("depth"))


def decor_actions(findings: DataFrame, objects: DataFrame) -> DataFrame:
    """Withheld detections worth admitting, as link rows of one action per room."""
    named = findings.select("object_id").distinct()
    admitted = objects.filter("uncertain AND width > 0 AND depth > 0 AND height > 0").join(named, "object_id", "left_semi")
    return admitted.select(*KEYS, "object_id", F.concat(F.lit("decor_density:"), F.col("room_id").cast("string")).alias("action_id"))


def grainier_species(materials: DataFrame) -> DataFrame:
    """Per material the species of its family with the smallest step up in grain (more than 0.05)."""
    every = dim(materials.sparkSession, "dim_materials").select("material", "family", "grain")
    species = every.filter("material <> family").select("family", F.col("material").alias("species"), F.col("grain").alias("_g"))
    steps = every.join(F.broadcast(species), "family").filter((F.col("species") != F.col("material")) & (F.round(F.col("_g") - F.col("grain"), 9) > 0.05))
    table = steps.groupBy("material").agg(F.min(F.struct("_g", "species")).alias("s")).select("material", F.col("s.species").alias("species"))
    return materials.join(F.broadcast(table), "material", "left")


def material_actions(findings: DataFrame) -> DataFrame:
    """Saturation scale, tint and grain step per (room, material). ``findings``: keys, material, code, finding_id, ratio, reference_hex."""
    grouped = findings.groupBy(*KEYS, "material").agg(
        F.min(F.when(F.col("code") == "saturation", F.struct("finding_id", "ratio"))).alias("s"), F.min(F.when(F.col("reference_hex").isNotNull(), F.struct("finding_id", "reference_hex"))).alias("h"),
        F.bool_or(F.col("code") == "texture").alias("_grain"))
    ratio = F.col("s.ratio")
    useful = (ratio > 1e-3) & (F.abs(1 - ratio) > 0.05)
    staged = grainier_species(grouped).withColumns({"saturation_scale": F.when(useful, F.round(clamp(damp_scale(1 / ratio), 0.35, 3.0) + 1e-9, 4)), "tint_toward": F.col("h.reference_hex"), "species": F.when(F.col("_grain"), F.col("species"))})
    return staged.filter(F.coalesce(F.col("saturation_scale").cast("string"), "tint_toward", "species").isNotNull()).select(*KEYS, "material", F.concat(F.lit("material_adjustment:"), "material").alias("action_id"), "saturation_scale", "tint_toward", "species")


def style_actions(findings: DataFrame, rooms: DataFrame) -> DataFrame:
    """Rooms without a style but with colour or material findings take the building's dominant one."""
    leading = dominant_style(rooms).filter("style <> 'unknown'").withColumnRenamed("style", "new_style")
    needy = findings.filter(F.col("axis").isin("colour", "material")).groupBy(*KEYS).agg(F.count("*").alias("findings"))
    return rooms.filter("style IS NULL OR style IN ('', 'unknown')").join(needy, KEYS).join(leading, "building_id").select(
        *KEYS, F.concat(F.lit("style_refinement:"), F.col("room_id").cast("string")).alias("action_id"), F.col("new_style").alias("style"), F.least(F.lit(0.7), F.col("share")).alias("confidence"), "findings")
