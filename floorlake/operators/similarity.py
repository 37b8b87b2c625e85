"""How alike two pictures look: palette, light, where the detail lies and how fine it is.

``pixels``: image_id, prow, pcol, r, g, b in 0..1, all pictures of one working size. All measures are sums per
picture or per cell of a picture; what needs a pixel's neighbours reads one row or column of one picture
at a time. Pairs meet on the few filled bins of their histograms, never on pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour
from ..session import cut_lineage

# Bins of a channel, rows and columns of the layout grid, scales of detail, the weights of the axes, and the score below which one is weak.
LEVELS = 4
GRID_ROWS, GRID_COLUMNS = 6, 8
SCALES = (1, 2, 4)
WEIGHTS = {"colour": 0.26, "layout": 0.24, "lighting": 0.22, "material": 0.08}
WEAK = 0.70


def joint_histograms(pixels: DataFrame, levels: int = LEVELS) -> DataFrame:
    """-> image_id, bin, share: the share of a picture's pixels in each cell of a coarse colour cube, filled cells only."""
    level = lambda c: F.greatest(F.lit(0), F.least(F.floor(F.col(c) * levels), F.lit(levels - 1)))
    counted = pixels.groupBy("image_id", ((level("r") * levels + level("g")) * levels + level("b")).cast("int").alias("bin")).agg(F.count("*").alias("_c"))
    return counted.join(counted.groupBy("image_id").agg(F.sum("_c").alias("_n")), "image_id").select("image_id", "bin", (F.col("_c") / F.col("_n")).alias("share"))


def _slope(value: str, line: str, along: str) -> Column:
    """Change of ``value`` per step: half the way between both neighbours, at an end the step to the only one."""
    window = Window.partitionBy("image_id", line).orderBy(along)
    before, after = F.lag(value).over(window), F.lead(value).over(window)
    return F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).when(after.isNotNull(), after - F.col(value)).when(before.isNotNull(), F.col(value) - before).otherwise(0.0)


def gradients(shades: DataFrame) -> DataFrame:
    """``shades``: image_id, prow, pcol, y -> with ``energy``, the length of the brightness gradient."""
    sloped = shades.withColumn("_dx", _slope("y", "prow", "pcol")).withColumn("_dy", _slope("y", "pcol", "prow"))
    return sloped.withColumn("energy", F.hypot("_dx", "_dy")).drop("_dx", "_dy")


def _section(place: str, size: str, sections: int) -> Column:
    """Number of the section of a side cut into as equal parts as possible, longer ones first."""
    i, q, r = F.col(place), F.floor(F.col(size) / sections), F.col(size) % sections
    return F.when(i < r * (q + 1), F.floor(i / (q + 1))).otherwise(r + F.floor((i - r * (q + 1)) / F.greatest(q, F.lit(1))))


def picture_measures(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """-> (per picture: mean colour, brightness, contrast, warmth, detail at each scale; per grid cell: mean energy)."""
    shades = cut_lineage(pixels.withColumn("y", 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")))
    mean = lambda c: F.avg(c) * 255
    basic = shades.groupBy("image_id").agg(
        colour.to_hex(mean("r"), mean("g"), mean("b")).alias("mean_hex"), F.avg("y").alias("brightness"), F.stddev_pop("y").alias("contrast"), (F.avg("r") - F.avg("b")).alias("warmth"),
        (F.max("prow") + 1).alias("_h"), (F.max("pcol") + 1).alias("_w"))
    basic = cut_lineage(basic)
    finest = cut_lineage(gradients(shades.select("image_id", "prow", "pcol", "y")))
    sized = finest.join(basic.select("image_id", "_h", "_w"), "image_id")
    cells = sized.groupBy("image_id", _section("prow", "_h", GRID_ROWS).alias("grid_row"), _section("pcol", "_w", GRID_COLUMNS).alias("grid_col")).agg(F.avg("energy").alias("energy"))
    out = basic
    for scale in SCALES:
        if scale == 1:
            rows = finest
        else:  # whole blocks only
            inside = sized.filter((F.col("prow") < F.floor(F.col("_h") / scale) * scale) & (F.col("pcol") < F.floor(F.col("_w") / scale) * scale))
            rows = gradients(inside.groupBy("image_id", F.floor(F.col("prow") / scale).alias("prow"), F.floor(F.col("pcol") / scale).alias("pcol")).agg(F.avg("y").alias("y")))
        out = out.join(rows.groupBy("image_id").agg(F.avg("energy").alias(f"detail_{scale}")), "image_id", "left")
    return out.drop("_h", "_w"), cells


def _near(a: str, b: str, reach: float) -> Column:
    return 1 - F.least(F.lit(1.0), F.abs(F.col(a) - F.col(b)) / reach)


def pair_similarity(pairs: DataFrame, pixels: DataFrame) -> DataFrame:
    """``pairs``: pair_id, reference_id, render_id -> pair_id, colour, lighting, layout, material, score.

    Pairs of which a picture is missing are left out. ``score`` is the mean of the axes by their weights.
    """
    stats, cells = picture_measures(pixels)
    stats = cut_lineage(stats)
    shares = joint_histograms(pixels)
    left = lambda df, key="image_id": df.withColumnsRenamed({c: ("reference_id" if c == key else f"{c}_a") for c in df.columns})
    right = lambda df, key="image_id": df.withColumnsRenamed({c: ("render_id" if c == key else f"{c}_b") for c in df.columns})
    both = pairs.join(left(stats), "reference_id").join(right(stats), "render_id")

    met = pairs.join(left(shares), "reference_id").join(right(shares).withColumnRenamed("bin_b", "bin_a"), ["render_id", "bin_a"])
    agreement = met.groupBy("pair_id").agg(F.sum(F.least("share_a", "share_b")).alias("_agree"))

    # Correlation of the grids from sums over their cells.
    grid = pairs.join(left(cells), "reference_id").join(right(cells).withColumnsRenamed({"grid_row_b": "grid_row_a", "grid_col_b": "grid_col_a"}), ["render_id", "grid_row_a", "grid_col_a"])
    spread = F.sqrt(F.var_pop("energy_a") * F.var_pop("energy_b"))
    layout = grid.groupBy("pair_id").agg(spread.alias("_s"), F.covar_pop("energy_a", "energy_b").alias("_v"), F.count("*").alias("_n"))
    layout = layout.select("pair_id", F.greatest(F.lit(0.0), (F.when(F.col("_s") * F.col("_n") > 1e-9, F.col("_v") / F.col("_s")).otherwise(0.0) + 1) / 2).alias("layout"))

    fine = [1 - F.least(F.lit(1.0), F.abs(F.col(f"detail_{s}_a") - F.col(f"detail_{s}_b")) / F.greatest(f"detail_{s}_a", f"detail_{s}_b", F.lit(1e-6))) for s in SCALES]
    apart = colour.distance(F.col("mean_hex_a"), F.col("mean_hex_b"))
    scored = both.join(agreement, "pair_id", "left").join(layout, "pair_id").select(
        "pair_id", F.greatest(F.lit(0.0), 0.6 * F.coalesce("_agree", F.lit(0.0)) + 0.4 * (1 - apart)).alias("colour"),
        (0.4 * _near("brightness_a", "brightness_b", 0.5) + 0.25 * _near("contrast_a", "contrast_b", 0.35) + 0.35 * _near("warmth_a", "warmth_b", 0.35)).alias("lighting"),
        "layout", (sum(fine[1:], fine[0]) / len(fine)).alias("material"), (F.col("brightness_b") - F.col("brightness_a")).alias("brighter"), (F.col("warmth_b") - F.col("warmth_a")).alias("warmer"), apart.alias("colour_distance"))
    total = sum(WEIGHTS.values())
    return scored.withColumn("score", sum((F.col(axis) * (w / total) for axis, w in list(WEIGHTS.items())[1:]), F.col("colour") * (WEIGHTS["colour"] / total)))


def similarity_findings(scored: DataFrame) -> DataFrame:
    """What a viewer would notice of a pair -> pair_id, axis, finding, remedy."""
    told = F.array_compact(F.array(
        F.when(F.col("colour_distance") > 0.18, F.struct(F.lit("colour").alias("axis"), F.lit("overall colour differs").alias("finding"), F.lit("materials").alias("remedy"))),
        F.when(F.col("brighter") < -0.10, F.struct(F.lit("lighting").alias("axis"), F.lit("render is darker").alias("finding"), F.lit("lighting").alias("remedy"))),
        F.when(F.col("brighter") > 0.10, F.struct(F.lit("lighting").alias("axis"), F.lit("render is brighter").alias("finding"), F.lit("lighting").alias("remedy"))),
        F.when(F.col("warmer") > 0.08, F.struct(F.lit("lighting").alias("axis"), F.lit("lighting too warm").alias("finding"), F.lit("lighting").alias("remedy"))),
        F.when(F.col("warmer") < -0.08, F.struct(F.lit("lighting").alias("axis"), F.lit("lighting too cool").alias("finding"), F.lit("lighting").alias("remedy"))),
        F.when(F.col("layout") < WEAK, F.struct(F.lit("layout").alias("axis"), F.lit("furniture layout differs").alias("finding"), F.lit("assets").alias("remedy"))),
        F.when(F.col("material") < WEAK, F.struct(F.lit("material").alias("axis"), F.lit("surfaces read flatter").alias("finding"), F.lit("materials").alias("remedy")))))
    return scored.select("pair_id", F.explode(told).alias("f")).select("pair_id", "f.*")
