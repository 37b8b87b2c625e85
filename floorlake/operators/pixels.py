"""Statistics over the long pixel table (image_id, prow, pcol, r, g, b in 0..1) and the five view axes.

Everything is one or two grouped aggregates per image; a picture is never one row or one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour
from ..functions import projection as pj
from ..session import cut_lineage
from .scale import medians_within

BINS = 24
MIN_REGION = 0.02
CHANNELS = ["r", "g", "b"]


def clamp01(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def luma(r="r", g="g", b="b") -> Column:
    """Relative luminance in linear light."""
    return 0.2126 * colour.to_linear(F.col(r)) + 0.7152 * colour.to_linear(F.col(g)) + 0.0722 * colour.to_linear(F.col(b))


def prepare(pixels: DataFrame) -> DataFrame:
    """Linear channels and luma once per pixel, for every statistic below."""
    linear = {f"_l{c}": colour.to_linear(F.col(c)) for c in CHANNELS}
    return pixels.withColumns(linear).withColumn("_luma", 0.2126 * F.col("_lr") + 0.7152 * F.col("_lg") + 0.0722 * F.col("_lb"))


def image_stats(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean colour, exposure, contrast, warmth, saturation and mean CIELAB per image (or image and region)."""
    rows = prepare(pixels)
    hi, lo = F.greatest(*CHANNELS), F.least(*CHANNELS)
    lab = colour.to_lab(F.col("r"), F.col("g"), F.col("b"))
    grouped = rows.groupBy(*keys).agg(
        F.count("*").alias("pixels"), *[F.avg(f"_l{c}").alias(f"_m{c}") for c in CHANNELS], F.avg("_luma").alias("exposure"), F.stddev_pop("_luma").alias("contrast"),
        F.avg(F.col("_lr") - F.col("_lb")).alias("warmth"), F.avg(F.when(hi > 1e-6, (hi - lo) / hi).otherwise(0.0)).alias("saturation"),
        F.avg(lab[0]).alias("lab_l"), F.avg(lab[1]).alias("lab_a"), F.avg(lab[2]).alias("lab_b"))
    shade = colour.to_hex(*[clamp01(colour.to_srgb(F.col(f"_m{c}"))) * 255 for c in CHANNELS])
    return grouped.withColumn("mean_hex", shade).drop("_mr", "_mg", "_mb")


def histograms(pixels: DataFrame, bins: int = BINS) -> DataFrame:
    """Share per image, channel and bin, smoothed over three bins with nothing beyond the ends."""
    total = pixels.groupBy("image_id").agg(F.count("*").alias("_n"))
    level = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1))
    counted = pixels.select("image_id", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), level(c).alias("bin")) for c in CHANNELS])).alias("v")).groupBy(
        "image_id", "v.channel", "v.bin").agg(F.count("*").alias("_c"))
    widened = counted.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))).filter(F.col("bin").between(0, bins - 1))
    return widened.groupBy("image_id", "channel", "bin").agg(F.sum("_c").alias("_c")).join(total, "image_id").select("image_id", "channel", "bin", (F.col("_c") / 3 / F.col("_n")).alias("share"))


def histogram_agreement(pairs: DataFrame, shares: DataFrame, per: float = 3.0, cell: list[str] | None = None) -> DataFrame:
    """Sum of the smaller shares of two images. ``pairs``: pair_id, reference_id, render_id."""
    cell = cell or ["channel", "bin"]
    left = shares.withColumnsRenamed({"image_id": "reference_id", "share": "_a"})
    right = shares.withColumnsRenamed({"image_id": "render_id", "share": "_b"})
    both = pairs.join(left, "reference_id").join(right, ["render_id", *cell])
    summed = both.groupBy("pair_id").agg((F.sum(F.least("_a", "_b")) / per).alias("agreement"))
    return pairs.join(summed, "pair_id", "left").na.fill(0.0, ["agreement"])


def mass_grids(pixels: DataFrame, rows: int = 6, columns: int = 8) -> DataFrame:
    """Contrast per coarse cell as a share of the image's; trailing remainder rows and columns are cropped."""
    size = pixels.groupBy("image_id").agg((F.max("prow") + 1).alias("_h"), (F.max("pcol") + 1).alias("_w"))
    sized = prepare(pixels).join(size, "image_id")
    ch, cw = F.greatest(F.lit(1), F.floor(F.col("_h") / rows)), F.greatest(F.lit(1), F.floor(F.col("_w") / columns))
    cells = sized.select("image_id", "_luma", F.floor(F.col("prow") / ch).alias("grid_row"), F.floor(F.col("pcol") / cw).alias("grid_col")).filter((F.col("grid_row") < rows) & (F.col("grid_col") < columns))
    spread = cells.groupBy("image_id", "grid_row", "grid_col").agg(F.stddev_pop("_luma").alias("_s"))
    total = spread.groupBy("image_id").agg(F.sum("_s").alias("_t"))
    return spread.join(total, "image_id").select("image_id", "grid_row", "grid_col", F.when(F.col("_t") > 1e-9, F.col("_s") / F.col("_t")).otherwise(F.col("_s")).alias("share"))


def detail_energy(pixels: DataFrame, scale: int) -> DataFrame:
    """Mean distance of luma from its block mean; blocks that do not fit are trimmed."""
    size = pixels.groupBy("image_id").agg((F.max("prow") + 1).alias("_h"), (F.max("pcol") + 1).alias("_w"))
    rows = prepare(pixels).join(size, "image_id")
    fits = (F.col("_h") >= scale * 2) & (F.col("_w") >= scale * 2) & (F.col("prow") < F.col("_h") - F.col("_h") % scale) & (F.col("pcol") < F.col("_w") - F.col("_w") % scale)
    blocks = rows.filter(fits).select("image_id", "_luma", F.floor(F.col("prow") / scale).alias("_br"), F.floor(F.col("pcol") / scale).alias("_bc"))
    # A block is scale x scale pixels, so its list has a fixed length and one aggregate is enough.
    per_block = blocks.groupBy("image_id", "_br", "_bc").agg(F.collect_list("_luma").alias("_v"), F.avg("_luma").alias("_m"))
    apart = F.aggregate("_v", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("_m")))
    energy = per_block.groupBy("image_id").agg((F.sum(apart) / F.sum(F.size("_v"))).alias("energy"))
    return size.select("image_id").join(energy, "image_id", "left").na.fill(0.0, ["energy"])


def gradient_directions(pixels: DataFrame) -> DataFrame:
    """Unit vector of the mean brightness gradient.

    The mean of central differences (one-sided at the edges) telescopes to the two outer columns
    and rows, so it is a weighted sum and needs no neighbour lookup.
    """
    size = pixels.groupBy("image_id").agg((F.max("prow") + 1).alias("_h"), (F.max("pcol") + 1).alias("_w"))
    rows = prepare(pixels).join(size, "image_id").filter("_h >= 4 AND _w >= 4")
    edge = lambda at, n: F.when(F.col(at) == 0, -1.5).when(F.col(at) == 1, 0.5).when(F.col(at) == F.col(n) - 2, -0.5).when(F.col(at) == F.col(n) - 1, 1.5).otherwise(0.0)
    sums = rows.groupBy("image_id").agg((F.sum(F.col("_luma") * edge("pcol", "_w")) / F.count("*")).alias("_dx"), (F.sum(F.col("_luma") * edge("prow", "_h")) / F.count("*")).alias("_dy"))
    length = F.hypot("_dx", "_dy")
    unit = lambda c: F.when(length < 1e-9, 0.0).otherwise(F.col(c) / length)
    return sums.select("image_id", unit("_dx").alias("dx"), unit("_dy").alias("dy"))


def regions(indices: DataFrame, names: DataFrame, minimum: float = MIN_REGION) -> DataFrame:
    """Named regions of an id pass, largest first. ``indices``: image_id, index per pixel; ``names``: index, name."""
    total = indices.groupBy("image_id").agg(F.count("*").alias("_n"))
    counted = indices.filter("index > 0").groupBy("image_id", "index").agg(F.count("*").alias("pixels")).join(total, "image_id")
    return counted.withColumn("coverage", F.col("pixels") / F.col("_n")).filter(F.col("coverage") >= minimum).join(F.broadcast(names), "index").drop("_n")


def _sides(pairs: DataFrame, stats: DataFrame, columns: list[str], extra: list[str] | None = None) -> DataFrame:
    side = lambda name, prefix: stats.select(F.col("image_id").alias(f"{name}_id"), *(extra or []), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
    return pairs.join(side("reference", "ref"), "reference_id").join(side("render", "ren"), ["render_id", *(extra or [])])


def _lab(prefix: str) -> tuple:
    return tuple(F.col(f"{prefix}_lab_{c}") for c in "lab")


def colour_axis(pairs: DataFrame, stats: DataFrame, agreement: DataFrame) -> DataFrame:
    """0.6 for the distance of the mean colours (40 dE and more count nothing) + 0.4 histogram agreement."""
    both = _sides(pairs, stats, ["lab_l", "lab_a", "lab_b", "mean_hex"]).join(agreement.select("pair_id", "agreement"), "pair_id")
    return both.withColumn("cast", colour.delta_e(_lab("ref"), _lab("ren"))).withColumn("score", clamp01(0.6 * (1 - clamp01(F.col("cast") / 40.0)) + 0.4 * F.col("agreement")))


def colour_findings(axis: DataFrame, albedo: DataFrame | None = None) -> DataFrame:
    """The whole-frame cast of 8 dE and more, its direction, and what owns it."""
    cast = axis.filter(F.round("cast", 9) >= 8.0)
    da, db = F.col("ren_lab_a") - F.col("ref_lab_a"), F.col("ren_lab_b") - F.col("ref_lab_b")
    direction = F.when(F.abs(db) >= F.abs(da), F.when(db > 0, "warmer").otherwise("cooler")).otherwise(F.when(da > 0, "redder").otherwise("greener"))
    if albedo is None:
        owner, sure = F.lit("ColourPalette"), F.lit(0.5)
    else:
        cast = cast.join(albedo.select("pair_id", *[F.col(f"lab_{c}").alias(f"alb_lab_{c}") for c in "lab"]), "pair_id", "left")
        own = colour.delta_e(_lab("ref"), _lab("alb"))
        owner = F.when(own.isNull(), "ColourPalette").when(own >= F.col("cast") * 0.6, "SurfaceFinish").otherwise("LightingEnvironment")
        sure = F.when(own.isNull(), 0.5).when(own >= F.col("cast") * 0.6, 0.8).otherwise(0.75)
    return cast.select("pair_id", F.lit("cast").alias("code"), direction.alias("direction"), owner.alias("subsystem"), F.col("cast").alias("difference"), clamp01(F.col("cast") / 40.0).alias("severity"), sure.alias("confidence"))


def region_colour_findings(pairs: DataFrame, region_stats: DataFrame) -> DataFrame:
    """Regions of the material pass 6 dE and more apart. ``region_stats``: image stats per (image_id, region) with coverage."""
    both = _sides(pairs, region_stats, ["lab_l", "lab_a", "lab_b", "coverage"], ["region"])
    measured = both.withColumn("difference", colour.delta_e(_lab("ref"), _lab("ren"))).filter(F.round("difference", 9) >= 6.0)
    severity = clamp01(clamp01(F.col("difference") / 40.0) * (0.5 + F.col("ref_coverage")))
    return measured.select("pair_id", "region", "difference", severity.alias("severity"), F.lit(0.7).alias("confidence"), F.lit("SurfaceFinish").alias("subsystem"))


def lighting_axis(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    both = _sides(pairs, stats, ["exposure", "contrast", "warmth"])
    gaps = both.withColumns({f"{c}_gap": F.col(f"ren_{c}") - F.col(f"ref_{c}") for c in ("exposure", "contrast", "warmth")})
    part = lambda c, weight, span: weight * (1 - clamp01(F.abs(f"{c}_gap") / span))
    return gaps.withColumn("score", clamp01(part("exposure", 0.5, 0.35) + part("contrast", 0.3, 0.2) + part("warmth", 0.2, 0.2)))


def lighting_findings(axis: DataFrame) -> DataFrame:
    """Exposure, contrast and warmth gaps worth reporting, as rows."""

    def rows(code: str, gap: str, least: float, span: float, factor: float, sure: float, less: str, more: str) -> DataFrame:
        size = F.abs(F.col(gap))
        return axis.filter(F.round(size, 9) >= least).select(
            "pair_id", F.lit(code).alias("code"), F.when(F.col(gap) < 0, less).otherwise(more).alias("direction"), size.alias("difference"),
            (clamp01(size / span) * factor).alias("severity"), F.lit(sure).alias("confidence"), F.lit("LightingEnvironment").alias("subsystem"))

    return rows("exposure", "exposure_gap", 0.06, 0.35, 1.0, 0.55, "darker", "brighter").unionByName(
        rows("contrast", "contrast_gap", 0.05, 0.2, 0.7, 0.65, "flatter", "harsher")).unionByName(rows("warmth", "warmth_gap", 0.05, 0.2, 0.8, 0.6, "cooler", "warmer"))


def shading_ratio(render: DataFrame, albedo: DataFrame) -> DataFrame:
    """Mean lit-to-unlit brightness where the unlit pass is not black."""
    unlit = prepare(albedo).select("image_id", "prow", "pcol", F.col("_luma").alias("_a")).filter("_a > 0.02")
    return prepare(render).select("image_id", "prow", "pcol", F.col("_luma").alias("_r")).join(unlit, ["image_id", "prow", "pcol"]).groupBy("image_id").agg(F.avg(F.col("_r") / F.col("_a")).alias("shading"))


def ratio(value: Column, against: Column) -> Column:
    return F.when(against <= 1e-6, 1.0).otherwise(value / against)


def ratio_score(value: Column) -> Column:
    return F.when(value <= 0, 0.0).otherwise(clamp01(1 - F.abs(F.log(value)) / math.log(4.0)))


def material_axis(pairs: DataFrame, stats: DataFrame, bands: dict[int, DataFrame]) -> DataFrame:
    """0.5 texture agreement over the detail bands + 0.5 saturation ratio."""
    wide = stats.select("image_id", "saturation")
    for scale, energy in bands.items():
        wide = wide.join(energy.withColumnRenamed("energy", f"e{scale}"), "image_id")
    both = _sides(pairs, wide, ["saturation", *[f"e{s}" for s in bands]])
    both = both.withColumns({f"ratio_{c}": ratio(F.col(f"ren_{c}"), F.col(f"ref_{c}")) for c in ["saturation", *[f"e{s}" for s in bands]]})
    texture = sum((ratio_score(F.col(f"ratio_e{s}")) for s in bands), F.lit(0.0)) / len(bands)
    return both.withColumn("texture", texture).withColumn("score", clamp01(0.5 * F.col("texture") + 0.5 * ratio_score(F.col("ratio_saturation"))))


def material_findings(axis: DataFrame, fine: int) -> DataFrame:
    off = F.abs(1 - F.col(f"ratio_e{fine}"))
    return axis.filter(~F.round(f"ratio_e{fine}", 9).between(0.45, 2.2)).select(
        "pair_id", F.lit("texture").alias("code"), F.when(F.col(f"ratio_e{fine}") < 1, "less").otherwise("more").alias("direction"), off.alias("difference"),
        (clamp01(off / 1.5) * 0.8).alias("severity"), F.lit(0.55).alias("confidence"), F.lit("MaterialSpecies").alias("subsystem"))


def displacements(detections: DataFrame, viewpoints: DataFrame, reach: float = 12.0) -> DataFrame:
    """Where each floor detection back-projects to, against where the object stands.

    ``detections``: viewpoint_id, object_id, bx0, bx1, by1, actual_x, actual_y.
    """
    posed, cam = pj.with_camera(viewpoints.select("viewpoint_id", "x", "y", "z", "yaw", "pitch_deg", "vfov_deg", "aspect"))
    posed = posed.drop("yaw", "pitch_deg", "vfov_deg", "aspect")  # once a viewpoint, not a detection
    ranged = pj.ground_positions(detections.join(posed, "viewpoint_id"), cam)
    within = (F.col("range_m") <= reach + 4e-10) | ((F.col("range_m") <= reach + 6e-10) & (F.round("range_m", 9) <= reach))  # rounding is only asked where it decides
    ranged = ranged.filter((F.col("range_m") > 1e-6) & within)
    return ranged.select("viewpoint_id", "object_id", "implied_x", "implied_y", "range_m", (F.col("implied_x") - F.col("actual_x")).alias("off_x"), (F.col("implied_y") - F.col("actual_y")).alias("off_y"))


def systematic_offsets(moved: DataFrame, least: int = 3) -> DataFrame:
    """Per viewpoint the median offset, how many objects agree with it, and whether it is shared."""
    moved = cut_lineage(moved)
    centre = medians_within(moved, ["viewpoint_id"], ["off_x", "off_y"], "object_id")
    joined = moved.join(centre, "viewpoint_id")
    size = F.hypot("median_off_x", "median_off_y")
    agrees = F.round(F.hypot(F.col("off_x") - F.col("median_off_x"), F.col("off_y") - F.col("median_off_y")) - F.greatest(F.lit(0.25), 0.4 * size), 9) <= 0
    grouped = joined.groupBy("viewpoint_id").agg(F.count("*").alias("objects"), F.count_if(agrees).alias("agreeing"), F.first("median_off_x").alias("offset_x"), F.first("median_off_y").alias("offset_y"))
    enough = F.col("objects") >= least
    shared = enough & (F.round(F.hypot("offset_x", "offset_y"), 9) >= 0.25) & (F.col("agreeing") / F.col("objects") >= 0.7)
    zero = lambda c: F.when(enough, F.col(c)).otherwise(0.0)
    return grouped.select("viewpoint_id", "objects", F.when(enough, F.col("agreeing")).otherwise(0).alias("agreeing"), zero("offset_x").alias("offset_x"), zero("offset_y").alias("offset_y"), shared.alias("systematic"))


def layout_axis(moved: DataFrame, offsets: DataFrame, mass: DataFrame) -> DataFrame:
    """0.4 visual-mass agreement + 0.6 mean residual displacement (2 m counts nothing). ``mass``: viewpoint_id, agreement."""
    joined = moved.join(offsets.select("viewpoint_id", "systematic", "offset_x", "offset_y"), "viewpoint_id")
    part = lambda c: F.when(F.col("systematic"), F.round(f"offset_{c}", 3)).otherwise(0.0)
    residual = F.hypot(F.col("off_x") - part("x"), F.col("off_y") - part("y"))
    means = joined.groupBy("viewpoint_id").agg(F.avg(residual).alias("mean_residual"), F.max(residual).alias("max_residual"), F.count("*").alias("measured"))
    both = mass.join(means, "viewpoint_id", "left")
    score = F.when(F.col("measured").isNull(), clamp01(F.col("agreement"))).otherwise(clamp01(0.4 * F.col("agreement") + 0.6 * (1 - clamp01(F.col("mean_residual") / 2.0))))
    return both.select("viewpoint_id", score.alias("score"), F.when(F.col("measured").isNull(), 0.5).otherwise(0.8).alias("confidence"), "mean_residual", "max_residual", F.coalesce("measured", F.lit(0)).alias("measured_objects"))


def objects_axis(objects: DataFrame, keys: list[str]) -> DataFrame:
    """1 - (missing + half the stand-ins) / observed. ``objects``: keys, confidence, uncertain, width, depth, height, asset, asset_score."""
    built = ~F.col("uncertain") & (F.col("width") > 0) & (F.col("depth") > 0) & (F.col("height") > 0)
    stand_in = built & (F.coalesce("asset", F.lit("")) != "") & (F.coalesce("asset_score", F.lit(0.0)) < 0.5)
    grouped = objects.groupBy(*keys).agg(F.count("*").alias("observed"), F.count_if(~built).alias("missing"), F.count_if(stand_in).alias("replaced"))
    return grouped.withColumn("score", clamp01(1 - (F.col("missing") + 0.5 * F.col("replaced")) / F.col("observed")))


def missing_objects(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Why each observed object was not built, weighted by its footprint."""
    total = objects.groupBy(*keys).agg(F.count("*").alias("_n"))
    flat = (F.col("width") <= 0) | (F.col("depth") <= 0) | (F.col("height") <= 0)
    gone = objects.filter(F.col("uncertain") | flat).join(total, keys)
    weight = clamp01(0.35 + F.col("width") * F.col("depth") / 3.0) * F.when(F.col("obj_group") == "decor", 0.6).otherwise(1.0)
    owner = F.when(F.col("uncertain") | (F.col("confidence") < 0.65), "ObjectDetection").otherwise("AssetPlacement")
    return gone.select(*keys, "object_id", owner.alias("subsystem"), (clamp01(0.4 + 0.6 / F.col("_n")) * weight).alias("severity"))


def observed_in_view(objects: DataFrame, object_images: DataFrame, viewpoints: DataFrame) -> DataFrame:
    """Objects a viewpoint saw: those listing its image, and those of its room without any listed image.

    Two equi-joins in union instead of one join with OR, which would compare everything.
    """
    listed = object_images.select("object_id", F.col("image_id").alias("viewpoint_id")).join(viewpoints.select("viewpoint_id"), "viewpoint_id")
    anonymous = objects.join(object_images.select("object_id").distinct(), "object_id", "left_anti").select("object_id", "building_id", "room_id")
    by_room = anonymous.join(viewpoints.select("viewpoint_id", "building_id", "room_id"), ["building_id", "room_id"])
    return listed.select("viewpoint_id", "object_id").unionByName(by_room.select("viewpoint_id", "object_id")).distinct()


def decode_index(r: Column, g: Column) -> Column:
    return (r + 256 * g).cast("long")


def decode_depth(value: Column, span: float) -> Column:
    """Metres of an 8-bit depth pass; full white is beyond the range and reads null."""
    return F.when(value < 255, value * span / 255.0)


def decode_normal(value: Column) -> Column:
    return value / 255.0 * 2.0 - 1.0


def difference_stats(left: DataFrame, right: DataFrame, block: int = 4) -> DataFrame:
    """CIELAB distance of two pictures per coarse cell - the numbers behind a heat map."""
    lab = lambda p: {f"{p}{i}": c for i, c in enumerate(colour.to_lab(F.col("r"), F.col("g"), F.col("b")))}
    side = lambda df, p: df.withColumns(lab(p)).select("pair_id", "prow", "pcol", *[f"{p}{i}" for i in range(3)])
    both = side(left, "a").join(side(right, "b"), ["pair_id", "prow", "pcol"])
    apart = colour.delta_e(tuple(F.col(f"a{i}") for i in range(3)), tuple(F.col(f"b{i}") for i in range(3)))
    return both.groupBy("pair_id", F.floor(F.col("prow") / block).alias("grid_row"), F.floor(F.col("pcol") / block).alias("grid_col")).agg(F.avg(apart).alias("mean_delta_e"), F.max(apart).alias("max_delta_e"))
