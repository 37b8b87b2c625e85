"""Room appearance: style, palette, light, materials and the asset each object is built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import dim
from ..functions import colour
from .scale import top_within

KEYS = ["building_id", "room_id"]
NOMINAL_W_PER_M2 = 4.0
NOMINAL_GLAZING = 0.18
POOR_MATCH = 0.62


def material_family(spark) -> DataFrame:
    return F.broadcast(dim(spark, "dim_materials").select("material", "family"))


def dominant_style(rooms: DataFrame, key: str = "building_id") -> DataFrame:
    """Style carrying most floor area, weighted by confidence; alphabetical on ties."""
    weight = F.greatest("area", F.lit(1.0)) * F.greatest("style_confidence", F.lit(0.2))
    scores = rooms.filter("style IS NOT NULL AND style NOT IN ('', 'unknown')").groupBy(key, "style").agg(F.sum(weight).alias("score"))
    best = scores.groupBy(key).agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "style", "score")).alias("b"), F.sum("score").alias("t"))
    found = best.select(key, F.col("b.style").alias("style"), F.round(F.col("b.score") / F.col("t"), 3).alias("share"))
    return rooms.select(key).distinct().join(found, key, "left").na.fill({"style": "unknown", "share": 0.0})


def style_confidence(rooms: DataFrame, objects: DataFrame) -> DataFrame:
    """0.55 for a known style plus up to 0.45 for how many of its expected material families are there."""
    spark = rooms.sparkSession
    families = material_family(spark)
    seen = objects.select(*KEYS, "material").distinct().join(families, "material").filter("family <> 'unknown'").select(*KEYS, "family").distinct()
    expected = dim(spark, "dim_style_materials").join(dim(spark, "dim_materials").select("material", "family"), "material", "left").select(
        "style", F.coalesce("family", F.lit("unknown")).alias("family")).distinct()
    totals = F.broadcast(expected.groupBy("style").agg(F.count("*").alias("_expected")))
    hits = rooms.select(*KEYS, "style").join(seen, KEYS).join(F.broadcast(expected), ["style", "family"]).groupBy(*KEYS).agg(F.count("*").alias("_hits"))
    any_seen = seen.select(*KEYS).distinct().withColumn("_seen", F.lit(True))
    joined = rooms.join(totals, "style", "left").join(hits, KEYS, "left").join(any_seen, KEYS, "left")
    share = F.coalesce(F.col("_hits"), F.lit(0)) / F.col("_expected")
    bonus = F.when(F.col("_seen") & F.col("_expected").isNotNull(), 0.45 * F.least(F.lit(1.0), share * 1.5)).otherwise(0.0)
    known = F.col("style") != "unknown"
    return joined.select(*KEYS, "style", F.when(known, F.round(F.least(F.lit(1.0), 0.55 + bonus), 3)).otherwise(0.0).alias("confidence"))


def derive_palettes(rooms: DataFrame, objects: DataFrame, lights: DataFrame) -> DataFrame:
    """Colour roles of every room in which anything was observed.

    ``rooms``: keys, wall_hex, floor_hex; ``objects``: keys, object_id, obj_group, color_hex, width, depth.
    """
    tinted = objects.filter("color_hex IS NOT NULL AND color_hex <> ''").join(rooms.select(*KEYS, "wall_hex", "floor_hex"), KEYS)
    furniture = F.col("obj_group") == "furniture"
    decor = F.col("obj_group").isin("decor", "appliance")
    area = F.greatest(F.col("width") * F.col("depth"), F.lit(0.01))
    near = lambda surface: F.coalesce(colour.distance(F.col("color_hex"), F.col(surface)) < 0.08, F.lit(False)) & F.col(surface).isNotNull()
    vivid = F.round(colour.saturation(F.col("color_hex")), 9)
    accent = F.when((furniture | decor) & ~near("wall_hex") & ~near("floor_hex") & (vivid > 0), F.struct(
        (-vivid).alias("s"), F.when(decor, 0).otherwise(1).alias("g"), F.col("object_id"), F.col("color_hex").alias("hex")))
    mixes = tinted.groupBy(*KEYS).agg(
        colour.mixed_hex(F.col("color_hex"), F.when(furniture, area)).alias("_furniture"), F.count_if(furniture).alias("_nf"),
        colour.mixed_hex(F.col("color_hex"), F.when(decor, F.lit(1.0))).alias("_decor"), F.count_if(decor).alias("_nd"), F.min(accent).alias("_accent"))
    power = F.greatest("power_w", F.lit(1.0))
    warm = lights.groupBy(*KEYS).agg((F.sum(F.col("kelvin") * power) / F.sum(power)).alias("_kelvin"))
    joined = rooms.join(mixes, KEYS, "left").join(warm, KEYS, "left").na.fill(0, ["_nf", "_nd"])
    wall, floor = F.nullif("wall_hex", F.lit("")), F.nullif("floor_hex", F.lit(""))
    shade = F.when(F.col("_nf") > 0, F.col("_furniture")).otherwise("#B5AFA5")
    sources = wall.isNotNull().cast("int") + floor.isNotNull().cast("int") + (F.col("_nf") > 0).cast("int") + (F.col("_nd") > 0).cast("int")
    return joined.filter(sources > 0).select(
        *KEYS, F.coalesce(wall, floor, shade).alias("primary_hex"), F.coalesce(floor, wall, shade).alias("secondary_hex"),
        F.coalesce("_accent.hex", F.lit("#9AA5AE")).alias("accent_hex"), colour.kelvin_to_hex(F.coalesce("_kelvin", F.lit(3400.0))).alias("lighting_hex"),
        shade.alias("furniture_hex"), F.when(F.col("_nd") > 0, F.col("_decor")).otherwise(shade).alias("decor_hex"),
        F.round(F.least(F.lit(1.0), 0.25 * sources), 3).alias("confidence"))


def style_palettes(rooms: DataFrame) -> DataFrame:
    """Palette of the room's style, for rooms nothing was observed in."""
    styles = F.broadcast(dim(rooms.sparkSession, "dim_styles").filter("color_1 IS NOT NULL"))
    warmth = F.when(F.col("lighting") == "warm", 2700.0).when(F.col("lighting") == "cool", 4200.0).otherwise(3400.0)
    half = [F.sqrt((a * a + b * b) / 2) for a, b in zip(colour.channels(F.col("color_1")), colour.channels(F.col("color_2")))]
    return rooms.join(styles, "style").select(
        *KEYS, F.col("color_1").alias("primary_hex"), F.col("color_2").alias("secondary_hex"), F.col("color_3").alias("accent_hex"),
        colour.kelvin_to_hex(warmth).alias("lighting_hex"), colour.to_hex(*half).alias("furniture_hex"), F.col("color_3").alias("decor_hex"), F.lit(0.25).alias("confidence"))


def derive_lighting(rooms: DataFrame, lights: DataFrame, openings: DataFrame) -> DataFrame:
    """Room light environment from glazing, luminaires and the observed time of day.

    ``rooms``: keys, area, x0, y0, x1, y1, time_of_day (nullable).
    """
    glass = F.col("width") * F.col("height")
    windows = openings.filter("kind = 'window'").groupBy(*KEYS).agg(
        F.sum(glass).alias("_glazed"), F.min(F.struct((-F.round(glass, 9)).alias("g"), "opening_id", "x", "y")).alias("_largest"))
    power = F.greatest("power_w", F.lit(1.0))
    lamps = lights.groupBy(*KEYS).agg(F.sum(F.when(~F.col("uncertain"), F.col("power_w")).otherwise(0.0)).alias("_power"), (F.sum(F.col("kelvin") * power) / F.sum(power)).alias("_kelvin"))
    joined = rooms.join(windows, KEYS, "left").join(lamps, KEYS, "left")
    floor_area = F.greatest("area", F.lit(1.0))
    staged = joined.withColumns({
        "_daylight": F.least(F.lit(0.85), F.coalesce("_glazed", F.lit(0.0)) / floor_area / NOMINAL_GLAZING * 0.45),
        "_lamplight": F.least(F.lit(1.0), F.coalesce("_power", F.lit(0.0)) / floor_area / NOMINAL_W_PER_M2)})
    inferred = (F.when(F.round("_daylight", 9) >= 0.35, "day").when((F.round("_daylight", 9) <= 0.05) & (F.round("_lamplight", 9) > 0.4), "night")
                .when(F.round(F.col("_lamplight") - F.col("_daylight") * 1.5, 9) > 0, "evening").otherwise("day"))
    observed = F.lower(F.trim(F.coalesce("time_of_day", F.lit(""))))
    time = F.when(observed.isin("day", "evening", "night", "overcast"), observed).otherwise(inferred)
    staged = staged.withColumn("time", time)
    staged = staged.withColumn("window_contribution", F.when(F.col("time") == "night", 0.0).when(F.col("time") == "evening", F.col("_daylight") * 0.25).otherwise(F.col("_daylight")))
    light = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.15 + 0.55 * F.col("window_contribution") + 0.45 * F.col("_lamplight")))
    ambient = F.when(F.col("time") == "night", F.least(light, F.lit(0.45))).when(F.col("time") == "overcast", F.least(light, F.lit(0.7))).otherwise(light)
    kelvin = F.coalesce("_kelvin", F.lit(3400.0))
    sunny = (F.col("time") == "day") & (F.round("window_contribution", 9) > 0.3)
    share = F.col("window_contribution")
    dx, dy = F.col("_largest.x") - (F.col("x0") + F.col("x1")) / 2, F.col("_largest.y") - (F.col("y0") + F.col("y1")) / 2
    centred = (F.abs(dx) < 1e-6) & (F.abs(dy) < 1e-6)
    direction = F.when(F.col("_largest").isNull() | centred, -1.0).otherwise(F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0)))
    softness = F.least(F.lit(1.0), 0.3 + 0.5 * share + F.when(F.col("time") == "overcast", 0.2).otherwise(0.0))
    seen = observed != ""
    elevation = F.when(F.col("time") == "day", 45.0).when(F.col("time") == "overcast", 30.0).when(F.col("time") == "evening", 8.0).otherwise(-10.0)
    confidence = 0.3 + F.when(F.col("_largest").isNotNull(), 0.25).otherwise(0.0) + F.when(F.col("_kelvin").isNotNull(), 0.25).otherwise(0.0) + F.when(seen, 0.2).otherwise(0.0)
    return staged.select(
        *KEYS, ambient.alias("ambient"), direction.alias("daylight_direction"), elevation.alias("daylight_elevation"), share.alias("window_contribution"),
        F.when(sunny, kelvin * (1 - share) + 6200.0 * share).otherwise(kelvin).alias("color_temperature_k"), softness.alias("shadow_softness"),
        F.col("time").alias("time_of_day"), F.least(F.lit(1.0), confidence).alias("confidence"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def match_assets(objects: DataFrame) -> DataFrame:
    """Best variant per object: 0.45 proportion + 0.25 style + 0.20 material family + 0.10 tone.

    ``objects``: object_id, category, width, depth, height, style, label, material, color_hex. The
    fixed variant table is broadcast; the winner is a grouped minimum, first declared on ties.
    """
    spark = objects.sparkSession
    variants = dim(spark, "dim_assets")
    counts = variants.groupBy("category").agg(F.count("*").alias("_variants"))
    families = dim(spark, "dim_materials").select("material", "family")
    wanted = variants.select("asset_no", F.explode(_words(F.col("materials"))).alias("material")).join(families, "material", "left").groupBy("asset_no").agg(
        F.collect_set(F.coalesce("family", F.lit("unknown"))).alias("_wanted"))
    table = F.broadcast(variants.join(counts, "category").join(wanted, "asset_no", "left"))
    own = objects.join(F.broadcast(families), "material", "left").withColumn("_family", F.coalesce("family", F.lit("unknown"))).drop("family")
    pairs = own.join(table, "category")
    gap = lambda seen, sig: F.when(sig <= 1e-6, 0.0).otherwise(F.abs(seen - sig) / F.greatest(seen, sig))
    proportion = F.when(F.col("height") <= 1e-6, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - (
        gap(F.col("width") / F.col("height"), F.col("sig_w")) + gap(F.col("depth") / F.col("height"), F.col("sig_d"))) / 2))
    text = F.lower(F.concat_ws(" ", F.coalesce("style", F.lit("")), F.coalesce("label", F.lit(""))))
    style = F.when(F.col("styles") == "", 0.6).when(F.exists(_words(F.col("styles")), lambda w: F.contains(text, w)), 1.0).otherwise(0.35)
    woody = F.array(F.lit("wood"), F.lit("laminate"))
    material = (F.when(F.col("materials") == "", 0.6).when(F.array_contains(_words(F.col("materials")), F.col("material")), 1.0)
                .when(F.array_contains("_wanted", F.col("_family")), 0.95)
                .when(F.col("_family").isin("wood", "laminate") & F.arrays_overlap("_wanted", woody), 0.85).otherwise(0.35))
    tone = F.when((F.col("tone") == "any") | (F.col("tone") == colour.tone(F.col("color_hex"))), 1.0).otherwise(0.55)
    score = F.when(F.col("_variants") == 1, 1.0).otherwise(F.round(0.45 * proportion + 0.25 * style + 0.20 * material + 0.10 * tone + 1e-9, 4))
    best = pairs.groupBy("object_id").agg(F.min(F.struct((-score).alias("s"), "asset_no", "asset", "builder")).alias("b"))
    family = F.broadcast(dim(spark, "dim_objects").select("category", "asset_family"))
    joined = objects.join(best, "object_id", "left").join(family, "category", "left")
    generic = F.concat(F.lit("generic_"), F.coalesce("asset_family", F.lit("box")))
    return joined.withColumns({
        "asset": F.coalesce("b.asset", generic), "asset_score": F.coalesce(-F.col("b.s"), F.lit(0.0)), "builder": F.coalesce("b.builder", F.lit("build_box_furniture"))}).drop("b", "asset_family")


def asset_coverage(matched: DataFrame, key: str = "building_id") -> DataFrame:
    scored = F.col("asset_score") > 0
    return matched.groupBy(key).agg(
        F.count_if(scored).alias("matched"), F.coalesce(F.round(F.avg(F.when(scored, F.col("asset_score"))), 3), F.lit(0.0)).alias("mean_score"),
        F.count_if(scored & (F.col("asset_score") < POOR_MATCH)).alias("poor"), F.count_if(F.col("asset").startswith("generic_")).alias("generic"))


def worst_assets(matched: DataFrame, key: str = "building_id", limit: int = 20) -> DataFrame:
    poor = matched.filter((F.col("asset_score") > 0) & (F.col("asset_score") < POOR_MATCH))
    return top_within(poor, [key], [F.asc("asset_score"), F.asc("object_id")], limit)


def weakest_categories(matched: DataFrame, key: str = "building_id", limit: int = 5) -> DataFrame:
    means = matched.filter("asset_score > 0").groupBy(key, "category").agg(F.avg("asset_score").alias("mean_score"), F.count("*").alias("objects"))
    return top_within(means, [key], [F.round("mean_score", 9).asc(), F.asc("category")], limit)


def categories_without_variant(matched: DataFrame, key: str = "building_id") -> DataFrame:
    return matched.filter(F.col("asset").startswith("generic_")).select(key, "category").distinct()


def builder_histogram(matched: DataFrame, key: str = "building_id") -> DataFrame:
    return matched.groupBy(key, "builder").agg(F.count("*").alias("objects"))


def resolve_materials(surfaces: DataFrame) -> DataFrame:
    """Material and where it came from. ``surfaces``: observed, style, surface, confidence."""
    spark = surfaces.sparkSession
    profiles = F.broadcast(dim(spark, "dim_style_profiles").select("style", F.col("wall").alias("_wall"), F.col("floor").alias("_floor"), F.col("ceiling").alias("_ceiling")))
    subs = F.broadcast(dim(spark, "dim_style_substitutes").select("style", F.col("family").alias("_family"), F.col("species").alias("_species")))
    rows = surfaces.withColumn("_seen", F.nullif(F.nullif(F.trim(F.coalesce("observed", F.lit(""))), F.lit("")), F.lit("unknown")))
    rows = rows.join(material_family(spark).withColumnsRenamed({"material": "_seen", "family": "_known"}), "_seen", "left").withColumn(
        "_family", F.when(F.col("_seen").isNotNull(), F.coalesce("_known", F.lit("unknown"))))
    rows = rows.join(profiles, "style", "left").join(subs, ["style", "_family"], "left")
    species = F.col("_seen").isNotNull() & (F.col("_seen") != F.col("_family"))
    refined = F.col("_seen").isNotNull() & ~species & (F.col("confidence") >= 0.5) & F.col("_species").isNotNull()
    default = F.when(F.col("surface") == "wall", F.col("_wall")).when(F.col("surface") == "floor", F.col("_floor")).when(F.col("surface") == "ceiling", F.col("_ceiling"))
    plain = F.when(F.col("surface") == "wall", "paint_matte").when(F.col("surface") == "floor", "wood").when(F.col("surface") == "ceiling", "gypsum").otherwise("unknown")
    seen = F.col("_seen").isNotNull()
    return rows.withColumns({
        "material": F.when(refined, F.col("_species")).when(seen, F.col("_seen")).otherwise(F.coalesce(default, plain)),
        "source": F.when(refined, "style").when(seen, "observed").when(default.isNotNull(), "style").otherwise("default")}).drop(
        "_seen", "_known", "_family", "_wall", "_floor", "_ceiling", "_species")


def _programme_counts(rooms: DataFrame, programme: DataFrame) -> DataFrame:
    """One row per planned item: the base count plus one per further ``per_area`` m2, up to the most."""
    rows = rooms.join(F.broadcast(programme), "room_type").filter((F.col("area") > 0) & (F.col("area") >= F.col("min_area")))
    extra = F.when(F.col("per_area") > 0, F.floor(F.greatest(F.lit(0.0), F.col("area") - F.col("min_area")) / F.col("per_area"))).otherwise(0)
    scaled = F.when(F.col("per_area") > 0, F.least(F.col("max_count"), F.col("item_count") + extra)).otherwise(F.col("item_count"))
    n = F.greatest(F.lit(1), F.least(scaled, F.greatest("max_count", "item_count"))).cast("int")
    return rows.withColumn("item_index", F.explode(F.sequence(F.lit(0), n - 1)))


def plan_furniture(rooms: DataFrame) -> DataFrame:
    items = _programme_counts(rooms, dim(rooms.sparkSession, "dim_furniture_programme"))
    return items.select(*KEYS, "category", "item_index", "importance", "requires", "relation", "relation_target", "on_surface")


def plan_lights(rooms: DataFrame) -> DataFrame:
    spark = rooms.sparkSession
    programme = dim(spark, "dim_lighting_programme")
    known = _programme_counts(rooms, programme).select(*KEYS, "kind", "item_index", "requires")
    plain = rooms.filter("area > 0").join(F.broadcast(programme.select("room_type").distinct()), "room_type", "left_anti").select(
        *KEYS, F.lit("ceiling_light").alias("kind"), F.lit(0).alias("item_index"), F.lit("").alias("requires"))
    return known.unionByName(plain)


def furnishing_targets(rooms: DataFrame, objects: DataFrame, lights: DataFrame) -> DataFrame:
    """Which rooms get furniture, which get lights, and why not."""
    spark = rooms.sparkSession
    has = lambda df, name: df.select(*KEYS).distinct().withColumn(name, F.lit(True))
    programme = F.broadcast(dim(spark, "dim_furniture_programme").groupBy("room_type").agg(F.min("min_area").alias("_smallest")))
    joined = rooms.join(has(objects, "_objects"), KEYS, "left").join(has(lights, "_lights"), KEYS, "left").join(programme, "room_type", "left")
    reason = (F.when(F.col("_objects"), "observed contents win").when(F.col("room_type").isin("staircase", "shaft", "unknown"), "room type stays empty")
              .when(F.col("_smallest").isNull(), "no programme").when(F.col("area") < F.col("_smallest"), "too small").otherwise(""))
    return joined.select(*KEYS, (reason == "").alias("furnish"), F.col("_lights").isNull().alias("light"), reason.alias("reason"))
