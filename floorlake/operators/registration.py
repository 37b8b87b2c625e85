"""Fitting picture sheets to drawings by their labels, and interior views to regions.

All candidates of a sheet take part. Every label is paired with a fixed number of others, which is all of them on
sheets of a few dozen labels, so the pairs grow with the labels and not with their square. The transform of each pair
votes for cells of transforms; only the fits of the fullest cells are measured against all candidates.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import dim
from ..functions import text as tx
from ..session import cut_lineage
from .scale import greedy_matching, rank_within, top_within

#: Labels that each label of a sheet is paired with, and the fullest cells of a sheet whose fits are measured.
PARTNERS, FULLEST = 64, 4
#: Side of a cell of transforms in tolerances, and the number of grids, each shifted against the one before.
CELL, GRIDS = 2.0, 5
#: Room types there are, so the most that a plan can show (fixed by the vocabulary).
ALL_TYPES = 14
MIN_SCALE, MAX_SCALE = 0.5, 500.0
SNAP_DEG = 4.0
MIN_IN_FRAME = 0.3
MIN_ASSIGN = 0.15
SHEET = "sheet_id"


def tolerance(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(0.75), 0.06 * F.hypot(width, height))


def match_keys(anchors: DataFrame) -> DataFrame:
    """``anchors``: sheet_id, uid, text, ... -> informative ones with their match key."""
    keyed = anchors.withColumn("match_key", tx.strip_measurements(tx.normalise_label(F.col("text"))))
    return keyed.filter(tx.informative(F.col("match_key")))


def candidates(image: DataFrame, drawing: DataFrame, per_label: int | None = None) -> DataFrame:
    """Image labels against drawing labels of the same sheet.

    Similar texts share a word or a character pair, so the join runs on those instead of on all
    pairs. ``image``: sheet_id, uid, match_key, room_type, confidence, u, v; ``drawing``: the same
    with x, y and kind. ``per_label`` keeps only the best of each image label.
    """
    # Both sides are read three times: their keys are worked out once. Shared grams are joined by sorting, for Spark takes
    # the size of the labels for that of their grams, and would send those to every task.
    image, drawing = cut_lineage(image), cut_lineage(drawing)
    grams = lambda df: df.withColumn("_g", F.explode(F.array_distinct(F.concat(tx.bigrams(F.col("match_key")), F.split("match_key", " "), F.when(
        F.coalesce("room_type", F.lit("unknown")).isin("", "unknown", "none"), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("type:"), "room_type")))))))
    left = grams(image.select(SHEET, F.col("uid").alias("image_label_id"), "match_key", "room_type")).select(SHEET, "image_label_id", "_g")
    right = grams(drawing.select(SHEET, F.col("uid").alias("cad_uid"), "match_key", "room_type")).select(SHEET, "cad_uid", "_g")
    pairs = left.join(right.hint("merge"), [SHEET, "_g"]).select(SHEET, "image_label_id", "cad_uid").distinct()
    a = image.select(SHEET, F.col("uid").alias("image_label_id"), F.col("match_key").alias("text"), F.col("room_type").alias("_ta"), F.col("confidence").alias("_ca"), "u", "v")
    b = drawing.select(SHEET, F.col("uid").alias("cad_uid"), F.col("match_key").alias("_kb"), F.col("room_type").alias("_tb"), F.col("confidence").alias("_cb"), "kind", "x", "y")
    both = pairs.join(a, [SHEET, "image_label_id"]).join(b, [SHEET, "cad_uid"])
    known = lambda c: F.when(~F.coalesce(c, F.lit("")).isin("", "unknown", "none"), F.col(c))
    likeness = tx.text_similarity(F.col("text"), F.col("_kb"))
    staged = both.withColumn("_s", likeness)
    weight = F.when(F.col("_s") > 0, F.col("_s")).when(known("_ta") == known("_tb"), 0.5).otherwise(0.0)
    staged = staged.withColumn("weight", weight).filter("weight > 0")
    sure = lambda c: F.when(F.coalesce(c, F.lit(0.0)) == 0, 1.0).otherwise(F.col(c))
    trust = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(sure("_ca"), sure("_cb"))))
    scored = staged.withColumn("weight", F.col("weight") * F.when(F.col("kind") != "room_label", 0.8).otherwise(1.0) * (0.5 + 0.5 * trust))
    best = scored if per_label is None else top_within(scored, [SHEET, "image_label_id"], [F.round("weight", 9).desc(), F.asc("cad_uid")], per_label, "_r")
    return best.select(SHEET, "image_label_id", "cad_uid", "text", "u", "v", "x", "y", F.round(F.col("weight") + 1e-9, 4).alias("weight"))


def unmatched(anchors: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Match keys of one side no accepted correspondence uses."""
    return anchors.join(used.select(SHEET, F.col(key).alias("uid")), [SHEET, "uid"], "left_anti").select(SHEET, "match_key").distinct()


def numbered(pool: DataFrame) -> DataFrame:
    """``no``: the rank of every candidate of its sheet, heaviest first."""
    return rank_within(pool, [SHEET], [F.desc("weight"), F.asc("image_label_id"), F.asc("cad_uid")], "no")


# -- fits --------------------------------------------------------------------------

def moments(u: Column, v: Column, x: Column, y: Column, w: Column) -> dict[str, Column]:
    """Terms whose sums determine a similarity; the image v axis is flipped."""
    sx, sy = u, -v
    return {"w": w, "wsx": w * sx, "wsy": w * sy, "wdx": w * x, "wdy": w * y, "wss": w * (sx * sx + sy * sy), "wsd": w * (sx * x + sy * y), "wsc": w * (sx * y - sy * x)}


def similarity(m: dict[str, Column], rotation: Column | None = None) -> Column:
    """struct(scale, rotation_deg, a, b, c, d, tx, ty) from summed moments; null when undetermined."""
    total = F.when(m["w"] > 0, m["w"])
    var = m["wss"] - (m["wsx"] ** 2 + m["wsy"] ** 2) / total
    dot = m["wsd"] - (m["wsx"] * m["wdx"] + m["wsy"] * m["wdy"]) / total
    cross = m["wsc"] - (m["wsx"] * m["wdy"] - m["wsy"] * m["wdx"]) / total
    theta = F.atan2(cross, dot) if rotation is None else F.radians(rotation)
    reach = F.hypot(dot, cross) if rotation is None else F.cos(theta) * dot + F.sin(theta) * cross
    scale = reach / F.when(var >= 1e-12, var)
    cos, sin = F.cos(theta), F.sin(theta)
    mx, my = m["wsx"] / total, m["wsy"] / total
    return F.when((scale >= MIN_SCALE) & (scale <= MAX_SCALE), F.struct(
        scale.alias("scale"), F.degrees(theta).alias("rotation_deg"), (scale * cos).alias("a"), (scale * sin).alias("b"), (scale * sin).alias("c"), (-scale * cos).alias("d"),
        (m["wdx"] / total - scale * (cos * mx - sin * my)).alias("tx"), (m["wdy"] / total - scale * (sin * mx + cos * my)).alias("ty")))


def fit_groups(points: DataFrame, keys: list[str], rotation: Column | None = None) -> DataFrame:
    """Weighted N-point fit per group: sums only, so it combines map-side."""
    terms = moments(*[F.col(c) for c in ("u", "v", "x", "y", "weight")])
    sums = points.groupBy(*keys).agg(*[F.sum(t).alias(f"_{k}") for k, t in terms.items()], F.count("*").alias("_n"))
    return sums.filter("_n >= 2").withColumn("fit", similarity({k: F.col(f"_{k}") for k in terms}, rotation)).filter("fit IS NOT NULL").select(*keys, "fit")


def pair_fits(pool: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """A fit for pairs of candidates with different labels on both sides, with the sums it is made of.

    Labels are put into a hashed order and paired with the ``partners`` that follow; every candidate of the one meets every
    candidate of the other.
    """
    labels = rank_within(pool.select(SHEET, "image_label_id").distinct().withColumn("_h", F.xxhash64("image_label_id")), [SHEET], [F.asc("_h"), F.asc("image_label_id")], "_k").drop("_h")
    turned = cut_lineage(labels).select(SHEET, "image_label_id", "_k")
    meeting = turned.withColumn("_o", F.explode(F.sequence(F.lit(1), F.lit(partners)))).select(SHEET, F.col("image_label_id").alias("i_image_label_id"), (F.col("_k") + F.col("_o")).alias("_k"))
    meeting = meeting.join(turned.withColumnRenamed("image_label_id", "j_image_label_id").hint("merge"), [SHEET, "_k"]).drop("_k")
    side = lambda p: pool.select(SHEET, *[F.col(c).alias(f"{p}_{c}") for c in ("image_label_id", "cad_uid", "u", "v", "x", "y", "weight")], *(["tolerance_m"] if p == "i" else []))
    pairs = meeting.join(side("i").hint("merge"), [SHEET, "i_image_label_id"]).join(side("j").hint("merge"), [SHEET, "j_image_label_id"]).filter("i_cad_uid <> j_cad_uid")
    one = lambda p: moments(*[F.col(f"{p}_{c}") for c in ("u", "v", "x", "y", "weight")])
    a, b = one("i"), one("j")
    staged = pairs.withColumns({f"_{k}": a[k] + b[k] for k in a})
    return staged.withColumn("fit", similarity({k: F.col(f"_{k}") for k in a})).filter("fit IS NOT NULL").select(SHEET, "tolerance_m", "fit", *[f"_{k}" for k in a])


def voted_fits(pairs: DataFrame, fullest: int = FULLEST) -> DataFrame:
    """The fits of the fullest cells of every sheet, each from the summed moments of the pairs in the cell.

    A similarity is where it takes two points, the middles of the picture's left and right edge: four numbers. They are
    cut into cells of a few tolerances; several shifted grids see to it that like transforms share a cell.
    """
    f = lambda name: F.col(f"fit.{name}")
    ends = [f("a") * u + f("b") * 0.5 + f("tx") for u in (0.0, 1.0)] + [f("c") * u + f("d") * 0.5 + f("ty") for u in (0.0, 1.0)]
    sums = [c for c in pairs.columns if c.startswith("_")]
    spread = pairs.withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(GRIDS - 1))))
    cells = [F.floor(e / (CELL * F.col("tolerance_m")) + F.col("grid") / GRIDS) for e in ends]
    votes = spread.withColumn("cell", F.array(*cells)).groupBy(SHEET, "grid", "cell").agg(*[F.sum(c).alias(c) for c in sums])
    best = top_within(votes, [SHEET], [F.round("_w", 9).desc(), F.asc("grid"), F.asc("cell")], fullest, "nth")
    return best.withColumn("fit", similarity({c[1:]: F.col(c) for c in sums})).filter("fit IS NOT NULL").select(SHEET, "nth", "fit")


def evaluate(fits: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one inliers of every fit, closest first, summed up. ``pool`` carries tolerance_m.

    -> keys, fit, tolerance_m, inlier_count, support, residual_mean, residual_max; ``inlier_rows`` has the inliers.
    """
    near = inlier_rows(fits, pool, keys)
    scored = near.groupBy(*keys).agg(F.count("*").alias("inlier_count"), F.round(F.sum("weight"), 9).alias("support"), F.round(F.avg("residual"), 9).alias("residual_mean"), F.max("residual").alias("residual_max"), F.first("tolerance_m").alias("tolerance_m"))
    return fits.select(*keys, "fit").join(scored.filter("inlier_count >= 2"), keys)


def inlier_rows(fits: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """The candidates within the tolerance of each fit, each label once on either side, with their ``residual``."""
    placed = fits.select(*keys, "fit").join(pool, SHEET).withColumns({
        "_px": F.col("fit.a") * F.col("u") + F.col("fit.b") * F.col("v") + F.col("fit.tx"), "_py": F.col("fit.c") * F.col("u") + F.col("fit.d") * F.col("v") + F.col("fit.ty")})
    near = placed.withColumn("residual", F.round(F.hypot(F.col("_px") - F.col("x"), F.col("_py") - F.col("y")), 9)).filter("residual <= tolerance_m").drop("_px", "_py", "fit")
    return greedy_matching(near, keys, "image_label_id", "cad_uid", ["residual"])


def best_fits(scored: DataFrame) -> DataFrame:
    """Most support, then smaller mean residual, then the fuller cell."""
    fields = ["inlier_count", "residual_max", "tolerance_m"]
    order = F.struct((-F.col("support")).alias("s"), F.col("residual_mean").alias("m"), "nth", "fit", *fields)
    picked = scored.groupBy(SHEET).agg(F.min(order).alias("b"))
    return picked.select(SHEET, "b.fit", *[f"b.{f}" for f in fields], (-F.col("b.s")).alias("support"), F.col("b.m").alias("residual_mean"))


def _inlier_points(best: DataFrame, pool: DataFrame) -> DataFrame:
    return inlier_rows(best, pool, [SHEET])


def _adopt(best: DataFrame, challenger: DataFrame, wins: Column, flag: str | None = None) -> DataFrame:
    fields = ["fit", "tolerance_m", "inlier_count", "support", "residual_mean", "residual_max"]
    other = challenger.select(SHEET, *[F.col(f).alias(f"_n_{f}") for f in fields])
    joined = best.join(other, SHEET, "left").withColumn("_w", F.coalesce(wins, F.lit(False)))
    out = joined.select(SHEET, *[F.when(F.col("_w"), F.col(f"_n_{f}")).otherwise(F.col(f)).alias(f) for f in fields], *([F.col("_w").alias(flag)] if flag else []))
    return cut_lineage(out)


def consensus(candidate_rows: DataFrame, sheets: DataFrame, passes: int = 2) -> DataFrame:
    """Best transform per sheet: votes of pairs, up to ``passes`` refits while they improve, square-up.

    ``sheets``: sheet_id, x0, y0, x1, y1 (plan bounds).
    """
    limits = sheets.select(SHEET, tolerance(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("tolerance_m"))
    pool = cut_lineage(numbered(candidate_rows).join(limits, SHEET))
    fits = cut_lineage(voted_fits(pair_fits(pool)))
    best = cut_lineage(best_fits(evaluate(fits, pool, [SHEET, "nth"])))
    for _ in range(passes):
        again = evaluate(fit_groups(_inlier_points(best, pool), [SHEET]), pool, [SHEET])
        better = (F.col("_n_support") - F.col("support") > 1e-9) | ((F.abs(F.col("_n_support") - F.col("support")) <= 1e-9) & (F.col("_n_residual_mean") < F.col("residual_mean")))
        best = _adopt(best, again, better)
    turn = best.select(SHEET, F.col("fit.rotation_deg").alias("_rot")).withColumn("_near", F.bround(F.col("_rot") / 90.0, 0) * 90.0)
    off = F.abs(F.pmod(F.col("_rot") - F.col("_near") + 180.0, F.lit(360.0)) - 180.0)
    square = turn.filter(off <= SNAP_DEG).select(SHEET, "_near")
    points = _inlier_points(best, pool).join(square, SHEET)
    squared = evaluate(fit_groups(points, [SHEET, "_near"], F.col("_near")).select(SHEET, "fit"), pool, [SHEET])
    return _adopt(best, squared, F.col("_n_inlier_count") >= F.col("inlier_count"), "rotation_snapped")


def accept(found: DataFrame, sheets: DataFrame, candidate_rows: DataFrame) -> DataFrame:
    """Method, transform and confidence per sheet: label consensus, single anchor, or assumed bounds."""
    f = lambda name: F.col(f"fit.{name}")
    joined = sheets.join(found, SHEET, "left")
    det = f("a") * f("d") - f("b") * f("c")
    inv = lambda x, y: ((f("d") * (x - f("tx")) - f("b") * (y - f("ty"))) / det, (f("a") * (y - f("ty")) - f("c") * (x - f("tx"))) / det)
    corners = [inv(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]
    us, vs = [c[0] for c in corners], [c[1] for c in corners]
    staged = joined.withColumns({"u0": F.least(*us), "u1": F.greatest(*us), "v0": F.least(*vs), "v1": F.greatest(*vs)})
    inside = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(hi), F.lit(1.0)) - F.greatest(F.col(lo), F.lit(0.0)))
    area = (F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))
    lands = F.col("fit").isNotNull() & (area > 1e-9) & (inside("u0", "u1") * inside("v0", "v1") / area >= MIN_IN_FRAME)
    n = F.col("inlier_count")
    base = F.when(n == 2, 0.45).when(n == 3, 0.68).when(n == 4, 0.78).otherwise(0.86)
    tight = F.greatest(F.lit(0.0), 1 - F.col("residual_mean") / F.col("tolerance_m"))
    graded = base * (0.6 + 0.4 * tight) * (0.7 + 0.3 * F.least(F.lit(1.0), F.col("support") / n))
    once = lambda key: candidate_rows.groupBy(SHEET, key).agg(F.count("*").alias("_c")).filter("_c = 1").select(SHEET, key)
    lonely = candidate_rows.join(once("image_label_id"), [SHEET, "image_label_id"], "left_semi").join(once("cad_uid"), [SHEET, "cad_uid"], "left_semi")
    single = lonely.groupBy(SHEET).agg(F.count("*").alias("_k"), F.min(F.struct("u", "v", "x", "y", "weight")).alias("_s")).filter("_k = 1").select(SHEET, "_s")
    staged = staged.withColumn("_lands", F.coalesce(lands, F.lit(False))).join(single, SHEET, "left")
    width, depth = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    span = F.greatest(width, depth)
    # The single-anchor y offset subtracts scale x v although v runs downwards; kept so that stored results agree.
    method = F.when(F.col("_lands"), "label_consensus").when(F.col("_s").isNotNull() & (span > 0), "single_anchor").otherwise("plan_bounds")
    choose = lambda a, b, c: F.when(F.col("method") == "label_consensus", a).when(F.col("method") == "single_anchor", b).otherwise(c)
    zero = F.lit(0.0)
    return staged.withColumn("method", method).select(
        SHEET, "method", choose(F.round(F.least(F.lit(0.97), graded), 3), F.round(0.3 * F.greatest(F.lit(0.4), F.col("_s.weight")), 3), F.lit(0.15)).alias("confidence"),
        choose(f("a"), span, width).alias("a"), choose(f("b"), zero, zero).alias("b"), choose(f("c"), zero, zero).alias("c"), choose(f("d"), -span, -depth).alias("d"),
        choose(f("tx"), F.col("_s.x") - span * F.col("_s.u"), F.col("x0")).alias("tx"), choose(f("ty"), F.col("_s.y") + span * F.col("_s.v"), F.col("y1")).alias("ty"),
        F.coalesce(choose(F.col("residual_mean"), zero, zero), zero).alias("residual_mean"))


def place_detections(detections: DataFrame, transforms: DataFrame) -> DataFrame:
    """Plan position of picture detections (box middle) and how far off a room may still claim them."""
    joined = detections.join(transforms, SHEET)
    u, v = (F.col("bx0") + F.col("bx1")) / 2, (F.col("by0") + F.col("by1")) / 2
    return joined.withColumns({"x": F.col("a") * u + F.col("b") * v + F.col("tx"), "y": F.col("c") * u + F.col("d") * v + F.col("ty"),
                               "tolerance_m": F.least(F.lit(2.0), F.greatest(F.lit(0.35), 1.5 * F.col("residual_mean")))}).drop("a", "b", "c", "d", "tx", "ty")


# -- interior views ----------------------------------------------------------------

def score_regions(types: DataFrame, regions: DataFrame, plan: str = "building_id") -> DataFrame:
    """Every observed room type against every region of its plan (types are at most fourteen).

    ``types``: plan, observed_type; ``regions``: plan, room_id, area, aspect, room_type, room_type_confidence.
    """
    priors = F.broadcast(dim(types.sparkSession, "dim_area_priors").withColumnRenamed("room_type", "observed_type"))
    sizes = regions.groupBy(plan).agg(F.count("*").alias("_n"))
    ranked = rank_within(regions, [plan], [F.desc("area"), F.asc("room_id")], "_rank").join(sizes, plan)
    pairs = types.join(priors, "observed_type", "left").join(ranked, plan)
    area, lo, hi = F.col("area"), F.col("area_lo"), F.col("area_hi")
    fit = (F.when(lo.isNull(), 0.5).when(area.between(lo, hi), 1.0).when(area < lo, F.greatest(F.lit(0.0), 1 - (lo - area) / lo)).otherwise(F.greatest(F.lit(0.0), 1 - (area - hi) / hi)))
    place = F.when(F.col("_n") > 1, (F.col("_rank") - 1) / (F.col("_n") - 1)).otherwise(0.0)
    kind = F.col("observed_type")
    bonus = F.when(kind.isin("living_room", "dining_room"), 0.25 * (1 - place)).when(kind.isin("bathroom", "hallway"), 0.25 * place).otherwise(0.0) + F.when((kind == "hallway") & (F.col("aspect") > 2.2), 0.2).otherwise(0.0)
    stated = ~F.coalesce("room_type", F.lit("unknown")).isin("", "unknown")
    heard = stated & (F.col("room_type_confidence") >= 0.45)
    base = fit + bonus
    score = F.when(heard & (F.col("room_type") == kind), base + 1.3 * F.col("room_type_confidence")).when(heard, base * (1 - 0.85 * F.col("room_type_confidence"))).otherwise(base)
    return pairs.select(plan, "observed_type", "room_id", F.col("_rank").alias("region_order"), F.greatest(F.lit(0.0), score).alias("score"), "room_type", "room_type_confidence")


def best_assignment(value: list[list[int]]) -> list[int]:
    """Column of each row such that the sum of the whole numbers is largest (no more rows than columns).

    Shortest augmenting paths with row and column potentials, one row at a time.
    """
    rows, cols = len(value), len(value[0]) if value else 0
    u, v, owner, back = [0] * (rows + 1), [0] * (cols + 1), [0] * (cols + 1), [0] * (cols + 1)
    for i in range(1, rows + 1):
        owner[0], j = i, 0
        least: list[int | None] = [None] * (cols + 1)
        used = [False] * (cols + 1)
        while owner[j]:
            used[j] = True
            at, delta, nearest = owner[j], None, 0
            for k in range(1, cols + 1):
                if not used[k]:
                    cost = -value[at - 1][k - 1] - u[at] - v[k]
                    if least[k] is None or cost < least[k]:
                        least[k], back[k] = cost, j
                    if delta is None or least[k] < delta:
                        delta, nearest = least[k], k
            for k in range(cols + 1):
                if used[k]:
                    u[owner[k]] += delta
                    v[k] -= delta
                elif least[k] is not None:
                    least[k] -= delta
            j = nearest
        while j:
            owner[j] = owner[back[j]]
            j = back[j]
    found = [0] * rows
    for k in range(1, cols + 1):
        if owner[k]:
            found[owner[k] - 1] = k - 1
    return found


def assign_regions(scores: DataFrame, type_order: DataFrame, plan: str = "building_id") -> DataFrame:
    """A region of its own for each type such that the sum of the scores is largest -> plan, observed_type, room_id.

    ``type_order``: plan, observed_type, position. Of equal sums the one that gives the first types the first regions
    counts. A type whose score is below MIN_ASSIGN, or for which no region is left, has none. There are at most
    ``ALL_TYPES`` types, so of a type's regions only as many of the best can be needed, whatever the size of the plan: the
    others are dropped before the shuffle, and the one exact method sees a small table of each plan.
    """
    sized = scores.join(type_order, [plan, "observed_type"])
    rows = top_within(sized, [plan, "observed_type"], [F.round("score", 12).desc(), F.asc("region_order")], ALL_TYPES, "_k").select(plan, "observed_type", "position", "room_id", "region_order", F.round("score", 12).alias("score"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        types = list(dict.fromkeys(pdf.sort_values("position")["observed_type"]))
        rooms = list(dict.fromkeys(pdf.sort_values("region_order")["room_id"]))
        score = {(t, r): s for t, r, s in zip(pdf["observed_type"], pdf["room_id"], pdf["score"], strict=True)}
        # Every type may also stay without a region, which is worth nothing. Scores outweigh all orders.
        size = len(rooms) + len(types) + 1
        weight = size ** len(types)
        value = [[round(score.get((t, r), -1.0) * 10**12) * weight - k * size ** (len(types) - 1 - i) for k, r in enumerate(rooms)] + [-len(rooms) * size ** (len(types) - 1 - i)] * len(types) for i, t in enumerate(types)]
        chosen = [rooms[k] if k < len(rooms) and score.get((t, rooms[k]), 0.0) >= MIN_ASSIGN else None for t, k in zip(types, best_assignment(value), strict=True)]
        return pd.DataFrame({plan: pdf[plan].iloc[0], "observed_type": types, "room_id": pd.array(chosen, dtype="Int64")})

    return rows.groupBy(plan).applyInPandas(solve, f"{plan} long, observed_type string, room_id long")


def grade_assignments(assigned: DataFrame, scores: DataFrame, plan: str = "building_id") -> DataFrame:
    joined = assigned.join(scores, [plan, "observed_type", "room_id"])
    stated = ~F.coalesce("room_type", F.lit("unknown")).isin("", "unknown")
    clash = stated & (F.col("room_type") != F.col("observed_type"))
    c = F.coalesce("room_type_confidence", F.lit(0.0))
    confidence = (F.when(clash, F.greatest(F.lit(0.05), 0.25 * (1 - c))).when(stated & (c >= 0.45), F.least(F.lit(0.95), 0.55 + 0.4 * c)).otherwise(F.least(F.lit(0.6), 0.25 + 0.25 * F.least(F.lit(1.0), F.col("score")))))
    return joined.select(plan, "observed_type", "room_id", F.round(confidence + 1e-9, 3).alias("confidence"), clash.alias("conflicts_with_drawing"))


def group_images(images: DataFrame, assigned: DataFrame, regions: DataFrame, plan: str = "building_id") -> DataFrame:
    """Interior pictures per region: how many, and the corroborated type confidence.

    ``images``: plan, image_id, room_type, confidence, mode. The drawing's type is kept on conflict.
    """
    votes = images.filter("mode = 'full'").groupBy(plan, F.col("room_type").alias("observed_type")).agg(F.count("*").alias("images"), F.max("confidence").alias("observed"))
    placed = assigned.filter("room_id IS NOT NULL").join(votes, [plan, "observed_type"])
    joined = regions.select(plan, "room_id", "room_type", "room_type_confidence").join(placed, [plan, "room_id"], "left")
    stated = ~F.coalesce("room_type", F.lit("unknown")).isin("", "unknown")
    c, o = F.coalesce("room_type_confidence", F.lit(0.0)), F.coalesce("observed", F.lit(0.0))
    agree = stated & (F.col("room_type") == F.col("observed_type"))
    return joined.select(
        plan, "room_id", F.coalesce("images", F.lit(0)).alias("images"), F.when(stated, F.col("room_type")).otherwise(F.coalesce("observed_type", F.lit("unknown"))).alias("room_type"),
        F.round(F.when(agree, c + 0.35 * o * (1 - c)).when(stated, c).otherwise(o) + 1e-9, 4).alias("confidence"), F.coalesce(stated & F.col("observed_type").isNotNull() & ~agree, F.lit(False)).alias("conflict"))


