"""Image profiles, review rollups and most-trusted selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import dim
from ..dims.images import CLASS_ALIASES, GEOMETRY_ONLY, IMAGE_CLASSES
from .scale import top_within

KEYS = ["building_id", "room_id"]


def most_trusted(facts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The fact with the best source tier per key (unknown sources last), smallest ``order`` on ties."""
    tiers = F.broadcast(dim(facts.sparkSession, "dim_source_tiers"))
    ranked = facts.join(tiers, "source", "left").withColumn("tier", F.coalesce("tier", F.lit(99)))
    rest = [c for c in facts.columns if c not in keys]
    best = ranked.groupBy(*keys).agg(F.min(F.struct("tier", order, *[c for c in rest if c != order])).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest], F.col("b.tier").alias("tier"))


def measure_images(pixels: DataFrame) -> DataFrame:
    """Saturation, share of the modal brightness bucket, edge density, palette diversity, mean gradient.

    Neighbour differences come from joining each pixel to the one before it, not from a window over
    a whole picture.
    """
    hi, lo = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    grey = (F.col("r") + F.col("g") + F.col("b")) / 3
    rows = pixels.select("image_id", "prow", "pcol", grey.alias("_g"), F.when(hi > 1e-6, (hi - lo) / F.greatest(hi, F.lit(1e-6))).otherwise(0.0).alias("_s"),
                         (F.floor(F.col("r") * 7) * 64 + F.floor(F.col("g") * 7) * 8 + F.floor(F.col("b") * 7)).alias("_code"))
    ahead = lambda dr, dc, name: rows.select("image_id", (F.col("prow") - dr).alias("prow"), (F.col("pcol") - dc).alias("pcol"), F.col("_g").alias(name))
    both = rows.join(ahead(1, 0, "_down"), ["image_id", "prow", "pcol"], "left").join(ahead(0, 1, "_right"), ["image_id", "prow", "pcol"], "left")
    dy, dx = F.abs(F.col("_down") - F.col("_g")), F.abs(F.col("_right") - F.col("_g"))
    edge = F.coalesce(dy, F.lit(0.0)) + F.coalesce(dx, F.lit(0.0))
    basic = both.groupBy("image_id").agg(
        F.avg("_s").alias("mean_saturation"), F.avg(F.when(F.round(edge, 9) > 0.18, 1.0).otherwise(0.0)).alias("edge_density"),
        ((F.coalesce(F.avg(dx), F.lit(0.0)) + F.coalesce(F.avg(dy), F.lit(0.0))) / 2).alias("mean_gradient"), F.count("*").alias("_n"))
    buckets = rows.groupBy("image_id", F.least(F.floor(F.col("_g") * 32), F.lit(31)).alias("_b")).agg(F.count("*").alias("_c")).groupBy("image_id").agg(F.max("_c").alias("_m"))
    codes = rows.select("image_id", "_code").distinct().groupBy("image_id").agg((F.count("*") / 512).alias("palette_diversity"))
    joined = basic.join(buckets, "image_id").join(codes, "image_id")
    return joined.withColumn("flat_background_share", F.col("_m") / F.col("_n")).drop("_m", "_n")


def profile_images(measured: DataFrame) -> DataFrame:
    """Line art is recognised locally; everything else is left to the model's class."""
    drawn = (F.col("edge_density") >= 0.02) & (F.col("flat_background_share") >= 0.35)
    part = lambda cond, w: F.when(cond, w).otherwise(0.0)
    score = part(F.col("mean_saturation") < 0.14, 0.35) + part(F.col("flat_background_share") > 0.45, 0.30) + part(F.col("edge_density") > 0.045, 0.20) + part(F.col("palette_diversity") < 0.22, 0.15)
    line = F.when(drawn, score).otherwise(0.0)
    art = F.round(line, 9) >= 0.70
    return measured.withColumns({"line_art": line, "image_class": F.when(art, "cad_drawing").otherwise("unknown"), "medium": F.when(art, "drawing").otherwise("render"),
                                 "confidence": F.when(art, F.round(F.least(F.lit(0.95), 0.55 + line / 2.5), 3)).otherwise(0.25)})


def canonical_class(declared: Column) -> Column:
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(declared, F.lit("")))), "[ -]", "_")
    known = text.isin(*[c for c, _, _ in IMAGE_CLASSES])
    exact = F.coalesce(*[F.when(text == alias, name) for alias, name in CLASS_ALIASES])
    inside = F.coalesce(*[F.when(F.contains(text, F.lit(alias)), name) for alias, name in CLASS_ALIASES])
    return F.when(text == "", None).when(known, text).otherwise(F.coalesce(exact, inside))


def merge_classes(profiles: DataFrame, answers: DataFrame) -> DataFrame:
    """``answers``: image_id, declared, declared_medium, declared_confidence. Local line art keeps precedence; photographs gain 0.2 trust up to 0.9."""
    table = F.broadcast(dim(profiles.sparkSession, "dim_image_classes"))
    joined = profiles.join(answers, "image_id", "left").withColumn("_d", canonical_class(F.col("declared")))
    local = F.col("image_class").isin(*GEOMETRY_ONLY)
    answered = F.col("declared").isNotNull()
    staged = joined.withColumns({
        "image_class": F.when(local | ~answered, F.col("image_class")).otherwise(F.coalesce("_d", F.lit("unknown"))),
        "medium": F.when(local | ~answered, F.col("medium")).when(F.col("declared_medium").isin("photo", "photograph"), "photo").when(F.col("declared_medium").isin("drawing", "diagram", "line_art"), "drawing").otherwise("render"),
        "confidence": F.when(local | ~answered | F.col("_d").isNull(), F.col("confidence")).otherwise(F.col("declared_confidence"))})
    priced = staged.join(table, "image_class", "left")
    trust = F.when((F.col("medium") == "photo") & ~local, F.least(F.lit(0.9), F.col("trust") + 0.2)).otherwise(F.col("trust"))
    return priced.withColumn("geometry_trust", trust).select("image_id", "image_class", "mode", "medium", (F.col("medium") != "photo").alias("synthetic"), "geometry_trust", "confidence")


def summarise_images(profiles: DataFrame, keys: list[str]) -> DataFrame:
    only = F.col("image_class").isin(*GEOMETRY_ONLY)
    return profiles.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(~only & (F.col("mode") != "skip")).alias("appearance_sources"), F.count_if(only).alias("geometry_only"),
        F.count_if(F.col("mode") == "skip").alias("skipped"), F.count_if(F.col("medium") == "photo").alias("photographs"), F.count_if("synthetic").alias("synthetic"))


def review_rollup(rooms: DataFrame, objects: DataFrame, lights: DataFrame, openings: DataFrame) -> DataFrame:
    """Counts and mean confidence per room; children stay in their tables, joined by room on demand."""
    o = objects.groupBy(*KEYS).agg(F.count("*").alias("objects"), F.count_if("uncertain").alias("uncertain_objects"), F.count_if("locked").alias("locked_objects"), F.avg("confidence").alias("mean_confidence"))
    x = lights.groupBy(*KEYS).agg(F.count("*").alias("lights"))
    p = openings.groupBy(*KEYS).agg(F.count_if(F.col("kind") == "door").alias("doors"), F.count_if(F.col("kind") == "window").alias("windows"))
    joined = rooms.select(*KEYS).join(o, KEYS, "left").join(x, KEYS, "left").join(p, KEYS, "left")
    return joined.na.fill(0, ["objects", "uncertain_objects", "locked_objects", "lights", "doors", "windows"])


def unassigned(objects: DataFrame, rooms: DataFrame) -> DataFrame:
    return objects.join(rooms.select(*KEYS), KEYS, "left_anti")


def room_frames(rooms: DataFrame, walls: DataFrame) -> DataFrame:
    """Walls of each room; the four edges of its bounds where it has none."""
    corners = F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(edge, ("sx", "sy", "ex", "ey"))]) for edge in (("x0", "y0", "x1", "y0"), ("x1", "y0", "x1", "y1"), ("x1", "y1", "x0", "y1"), ("x0", "y1", "x0", "y0"))])
    bare = rooms.join(walls.select(*KEYS).distinct(), KEYS, "left_anti").select(*KEYS, F.posexplode(corners).alias("edge_no", "e")).select(*KEYS, F.lit(None).cast("long").alias("wall_id"), "e.*")
    return walls.select(*KEYS, "wall_id", "sx", "sy", "ex", "ey").unionByName(bare)


def scene_findings(objects: DataFrame, rooms: DataFrame, limit: int | None = None) -> DataFrame:
    """Poor asset matches (with ``limit`` the worst of each building), categories without a model, rooms pictured but unstyled."""
    poor = objects.filter("asset_score > 0 AND asset_score < 0.62 AND NOT uncertain")
    if limit is not None:
        poor = top_within(poor, ["building_id"], [F.asc("asset_score"), F.asc("object_id")], limit, "_r")
    row = lambda df, kind, subject: df.select("building_id", F.lit(kind).alias("kind"), F.col(subject).cast("string").alias("subject"))
    generic = objects.filter(F.col("asset").startswith("generic_")).select("building_id", "category").distinct()
    return row(poor, "poor_match", "object_id").unionByName(row(generic, "no_model", "category")).unionByName(row(rooms.filter("pictured AND style = 'unknown'"), "unstyled", "room_id"))
