"""Edit sets applied as joins, constraint checks and the immutability proof.

Edits are rows: ``edits`` has building_id, op, target_id, key, value (text) and ordinal, the order they were given in. Every function returns
(accepted result, rejected rows) or rows with a reason; nothing is applied silently.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import dim
from ..functions import geometry as g
from ..functions import text as tx
from ..functions.digest import multiset_digest, row_digest
from .graph import cascade
from .scale import rank_within
from .validation import _more_rounded, footprint_pairs, measured_pairs

BUILDING = "building_id"
OVERRIDE_KEYS = ["category", "room_id", "label", "position", "rotation_z", "dimensions", "locked", "asset", "material", "color_hex"]
LIGHT_KEYS = ["kind", "position", "mounting", "color_temperature_k", "power_w", "size", "length"]
EDIT_OPS = ["remove_objects", "keep_objects", "object_overrides", "room_types", "remove_lights", "add_objects", "room_finishes", "light_overrides", "add_lights"]
IMMUTABLE_KINDS = ["wall", "opening", "door", "window", "geometry", "architecture"]
# Room types a review may set.
ROOM_TYPES = ["living_room", "bedroom", "kitchen", "dining_room", "bathroom", "office", "hallway", "studio", "balcony", "unknown"]


def reject(rows: DataFrame, reason) -> DataFrame:
    return rows.select(BUILDING, "op", "target_id", "key", "value", (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))


def rejected_targets(edits: DataFrame, objects: DataFrame, lights: DataFrame, rooms: DataFrame) -> DataFrame:
    """Unknown operations, unknown ids and unknown override keys."""
    known = {
        "object_id": ["remove_objects", "keep_objects", "object_overrides"], "light_id": ["remove_lights", "light_overrides"], "room_id": ["room_types", "room_finishes"]}
    tables = {"object_id": objects, "light_id": lights, "room_id": rooms}
    missing = [reject(edits.filter(F.col("op").isin(*ops)).join(
        tables[key].select(BUILDING, F.col(key).cast("string").alias("target_id")).distinct(), [BUILDING, "target_id"], "left_anti"), "unknown id") for key, ops in known.items()]
    odd_op = reject(edits.filter(~F.col("op").isin(*EDIT_OPS)), "unrecognised edit key")
    odd_key = reject(edits.filter(((F.col("op") == "object_overrides") & ~F.col("key").isin(*OVERRIDE_KEYS)) | ((F.col("op") == "light_overrides") & ~F.col("key").isin(*LIGHT_KEYS))), "unrecognised key")
    return reduce(DataFrame.unionByName, [*missing, odd_op, odd_key])


def remove_objects(objects: DataFrame, edits: DataFrame) -> DataFrame:
    """Objects without the removed ones and everything that rested on them."""
    key = [BUILDING, "object_id"]
    wanted = edits.filter("op = 'remove_objects'").select(BUILDING, F.col("target_id").try_cast("long").alias("object_id")).join(objects.select(*key), key, "left_semi")
    gone = cascade(wanted, objects.filter("support_id IS NOT NULL").select(*key, "support_id"), (BUILDING,))
    return objects.join(gone, key, "left_anti")


def keep_uncertain(objects: DataFrame, edits: DataFrame) -> DataFrame:
    kept = edits.filter("op = 'keep_objects'").select(BUILDING, F.col("target_id").try_cast("long").alias("object_id"), F.lit(True).alias("_kept")).distinct()
    joined = objects.join(kept, [BUILDING, "object_id"], "left")
    confirmed = F.coalesce(F.col("_kept") & F.col("uncertain"), F.lit(False))
    return joined.withColumn("flags", F.when(confirmed, F.array_append("flags", F.lit("confirmed_by_user"))).otherwise(F.col("flags"))).withColumn(
        "uncertain", F.col("uncertain") & ~confirmed).drop("_kept")


def last_value(value: str = "value") -> Column:
    """The value given last, by the edits' ``ordinal``."""
    return F.max_by(value, "ordinal")


def strict_material(raw: Column) -> Column:
    found = tx.normalise_term(raw, "material")
    return F.when(raw.isNull() | (F.trim(raw) == "") | ((found == "unknown") & (F.lower(F.trim(raw)) != "unknown")), None).otherwise(found)


def strict_hex(raw: Column) -> Column:
    text = F.trim(raw)
    full = F.when(text.startswith("#"), text).otherwise(F.concat(F.lit("#"), text))
    return F.when(full.rlike("^#[0-9A-Fa-f]{6}$"), F.upper(full))


def override_appearance(objects: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Category, material, colour and asset overrides; (patched objects, rejected edits).

    Overrides pivot to one row per object; the last value given for a key counts.
    """
    spark = objects.sparkSession
    keys = ["category", "material", "color_hex", "asset"]
    wide = edits.filter("op = 'object_overrides'").filter(F.col("key").isin(*keys)).groupBy(BUILDING, F.col("target_id").try_cast("long").alias("object_id")).pivot("key", keys).agg(last_value())
    wide = wide.select(BUILDING, "object_id", *[F.col(k).alias(f"_{k}") for k in keys])
    staged = objects.join(wide, [BUILDING, "object_id"], "left").withColumns({"_nc": tx.normalise_term(F.col("_category"), "category"), "_nm": strict_material(F.col("_material")), "_nh": strict_hex(F.col("_color_hex"))})
    staged = staged.withColumn("category", F.coalesce("_nc", "category"))
    variants = F.broadcast(dim(spark, "dim_assets").select("category", F.col("asset").alias("_asset"), F.lit(True).alias("_fits")))
    staged = staged.join(variants, ["category", "_asset"], "left")
    fits = F.col("_asset").isNotNull() & (F.col("_fits").isNotNull() | (F.col("_asset") == ""))
    bad = lambda key, ok: staged.filter(F.col(f"_{key}").isNotNull() & ~F.coalesce(ok, F.lit(False))).select(
        BUILDING, F.lit("object_overrides").alias("op"), F.col("object_id").cast("string").alias("target_id"), F.lit(key).alias("key"), F.col(f"_{key}").alias("value"), F.lit(f"{key} not recognised").alias("reason"))
    rejected = reduce(DataFrame.unionByName, [bad("category", F.col("_nc").isNotNull()), bad("material", F.col("_nm").isNotNull()), bad("color_hex", F.col("_nh").isNotNull()), bad("asset", fits)])
    patched = staged.withColumns({
        "material": F.coalesce("_nm", "material"), "color_hex": F.coalesce("_nh", "color_hex"), "asset": F.when(fits, F.col("_asset")).otherwise(F.col("asset")),
        "asset_score": F.when(fits, 0.0).otherwise(F.col("asset_score"))})
    return patched.drop("_nc", "_nm", "_nh", "_fits", *[f"_{k}" for k in keys]), rejected


def override_lights(lights: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kind, temperature (1500..10000 K) and power (0..5000 W) of lights; an edited light is certain."""
    keys = ["kind", "color_temperature_k", "power_w"]
    wide = edits.filter("op = 'light_overrides'").filter(F.col("key").isin(*keys)).groupBy(BUILDING, F.col("target_id").try_cast("long").alias("light_id")).pivot("key", keys).agg(last_value())
    staged = lights.join(wide.select(BUILDING, "light_id", *[F.col(k).alias(f"_{k}") for k in keys]), [BUILDING, "light_id"], "left").withColumns({
        "_nk": tx.normalise_term(F.col("_kind"), "light"), "_kt": F.col("_color_temperature_k").try_cast("double"), "_pw": F.col("_power_w").try_cast("double")})
    bad = lambda key, ok: staged.filter(F.col(f"_{key}").isNotNull() & ok.isNull()).select(
        BUILDING, F.lit("light_overrides").alias("op"), F.col("light_id").cast("string").alias("target_id"), F.lit(key).alias("key"), F.col(f"_{key}").alias("value"), F.lit(f"{key} not recognised").alias("reason"))
    rejected = reduce(DataFrame.unionByName, [bad("kind", F.col("_nk")), bad("color_temperature_k", F.col("_kt")), bad("power_w", F.col("_pw"))])
    clamp = lambda c, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), c))
    changed = F.coalesce("_nk", F.col("_kt").cast("string"), F.col("_pw").cast("string")).isNotNull()
    patched = staged.withColumns({
        "kind": F.coalesce("_nk", "kind"), "kelvin": F.coalesce(F.when(F.col("_kt").isNotNull(), clamp(F.col("_kt"), 1500.0, 10000.0)), "kelvin"),
        "power_w": F.coalesce(F.when(F.col("_pw").isNotNull(), clamp(F.col("_pw"), 0.0, 5000.0)), "power_w"), "uncertain": F.col("uncertain") & ~changed})
    return patched.drop("_nk", "_kt", "_pw", *[f"_{k}" for k in keys]), rejected


def override_finishes(finishes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``finishes``: building_id, room_id, surface, material, color_hex, roughness, confidence.
    ``edits``: key = 'surface.field'. A new material brings its catalog shading; edited finishes are certain."""
    spark = finishes.sparkSession
    rows = edits.filter("op = 'room_finishes'").withColumns({"surface": F.substring_index("key", ".", 1), "_f": F.substring_index("key", ".", -1)})
    wide = rows.groupBy(BUILDING, F.col("target_id").try_cast("long").alias("room_id"), "surface").pivot("_f", ["material", "color_hex", "roughness"]).agg(last_value())
    wide = wide.select(BUILDING, "room_id", "surface", F.col("material").alias("_m"), F.col("color_hex").alias("_h"), F.col("roughness").alias("_r"))
    shading = F.broadcast(dim(spark, "dim_materials").select(F.col("material").alias("_nm"), F.col("roughness").alias("_mr")))
    staged = finishes.join(wide, [BUILDING, "room_id", "surface"], "left").withColumns({"_nm": strict_material(F.col("_m")), "_nh": strict_hex(F.col("_h")), "_nr": F.col("_r").try_cast("double")}).join(shading, "_nm", "left")
    refused = (F.col("_m").isNotNull() & F.col("_nm").isNull()) | (F.col("_h").isNotNull() & F.col("_nh").isNull())
    touched = F.coalesce("_m", "_h", "_r").isNotNull() & ~refused
    rejected = staged.filter(refused).select(BUILDING, F.lit("room_finishes").alias("op"), F.col("room_id").cast("string").alias("target_id"), F.col("surface").alias("key"), F.coalesce("_m", "_h").alias("value"), F.lit("finish not recognised").alias("reason"))
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    patched = staged.withColumns({
        "material": F.when(touched, F.coalesce("_nm", "material")).otherwise(F.col("material")), "color_hex": F.when(touched, F.coalesce("_nh", "color_hex")).otherwise(F.col("color_hex")),
        "roughness": F.when(touched, F.coalesce(F.when(F.col("_nr").isNotNull(), unit(F.col("_nr"))), "_mr", "roughness")).otherwise(F.col("roughness")), "confidence": F.when(touched, 1.0).otherwise(F.col("confidence"))})
    return patched.drop("_m", "_h", "_r", "_nm", "_nh", "_nr", "_mr"), rejected


def override_room_types(rooms: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    wanted = edits.filter("op = 'room_types'").withColumns({"room_id": F.col("target_id").try_cast("long"), "_t": F.replace(F.lower(F.trim("value")), F.lit(" "), F.lit("_"))})
    wanted = wanted.groupBy(BUILDING, "room_id").agg(last_value("_t").alias("_t"), last_value().alias("_v"))
    staged = rooms.join(wanted, [BUILDING, "room_id"], "left")
    good = F.col("_t").isin(*ROOM_TYPES)
    rejected = staged.filter(F.col("_t").isNotNull() & ~good).select(BUILDING, F.lit("room_types").alias("op"), F.col("room_id").cast("string").alias("target_id"), F.lit("").alias("key"), F.col("_v").alias("value"), F.lit("not a known room type").alias("reason"))
    return staged.withColumn("room_type", F.when(good, F.col("_t")).otherwise(F.col("room_type"))).drop("_t", "_v"), rejected


def override_transforms(objects: DataFrame, patches: DataFrame, rooms: DataFrame) -> DataFrame:
    """Move, turn and resize requests judged on the final state.

    ``patches``: building_id, object_id, new_x, new_y, new_rotation, new_width, new_depth, new_height, unlock
    (nullable fields keep the old value). Adds ``verdict`` ('applied' or the reason) and ``overlaps``.
    """
    staged = objects.join(patches, [BUILDING, "object_id"]).join(rooms.select(BUILDING, "room_id", "polygon", "area"), [BUILDING, "room_id"])
    final = {c: F.coalesce(f"new_{n}", c) for c, n in (("x", "x"), ("y", "y"), ("rotation_deg", "rotation"), ("width", "width"), ("depth", "depth"), ("height", "height"))}
    staged = staged.withColumns({f"f_{c}": v for c, v in final.items()})
    sizes = [F.col(f"f_{c}") for c in ("width", "depth", "height")]
    bad_size = (F.least(*sizes) < 0.05) | (F.greatest(*sizes) > 20.0)
    standing = F.col("support") == "floor"
    verdict = (F.when(F.col("locked") & ~F.coalesce("unlock", F.lit(False)), "locked").when(bad_size, "size outside 0.05..20 m")
               .when(standing & ~g.in_polygon("f_x", "f_y", F.col("polygon")), "outside the room")
               .when(standing & (F.round(F.col("f_width") * F.col("f_depth") - 0.55 * F.col("area"), 9) > 0), "too large for the room").otherwise("applied"))
    judged = staged.withColumn("verdict", verdict)
    moved = judged.filter("verdict = 'applied'").select(BUILDING, "room_id", "object_id", *[F.col(f"f_{c}").alias(c) for c in ("x", "y", "width", "depth", "rotation_deg")])
    others = objects.filter("width > 0 AND depth > 0 AND height > 0").select(BUILDING, "room_id", "object_id", "x", "y", "width", "depth", "rotation_deg")
    near = footprint_pairs(moved, others, [BUILDING, "room_id"]).filter("a_object_id <> b_object_id")
    hits = measured_pairs(near, "_depth", g.rect_overlap).filter(_more_rounded(F.col("_depth"), 0.02))
    counts = hits.groupBy(BUILDING, F.col("a_object_id").alias("object_id")).agg(F.count("*").alias("overlaps"))
    return judged.join(counts, [BUILDING, "object_id"], "left").na.fill(0, ["overlaps"]).select(BUILDING, "room_id", "object_id", "f_x", "f_y", "f_rotation_deg", "f_width", "f_depth", "f_height", "verdict", "overlaps")


def new_ids(requests: DataFrame, taken: DataFrame) -> DataFrame:
    """``requests``: building_id, request_id, category; ``taken``: building_id, object_key. Ids are
    <category>_user_<n> with the first free numbers.

    Free numbers below requests + taken are enough for all requests, so the numbers of a category
    are a sequence of that length minus the taken ones, matched to the requests by rank.
    """
    used = taken.withColumn("category", F.regexp_extract("object_key", r"^(.*)_user_[0-9]+$", 1)).withColumn("n", F.regexp_extract("object_key", r"_user_([0-9]+)$", 1).try_cast("long")).filter("n IS NOT NULL").select(BUILDING, "category", "n").distinct()
    keys = [BUILDING, "category"]
    need = requests.groupBy(*keys).agg(F.count("*").alias("_r")).join(used.groupBy(*keys).agg(F.count("*").alias("_u")), keys, "left").na.fill(0, ["_u"])
    free = need.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_r") + F.col("_u"))).alias("n")).join(used, [*keys, "n"], "left_anti")
    numbered = rank_within(free, keys, [F.asc("n")], "_k")
    asked = rank_within(requests, keys, [F.asc("request_id")], "_k")
    return asked.join(numbered, [*keys, "_k"]).withColumn("object_key", F.concat("category", F.lit("_user_"), F.col("n").cast("string"))).drop("_k", "n")


def default_objects(requests: DataFrame) -> DataFrame:
    """Catalog size and support for objects added without a source to clone."""
    prior = F.broadcast(dim(requests.sparkSession, "dim_objects").select("category", F.col("typical_w").alias("width"), F.col("typical_d").alias("depth"), F.col("typical_h").alias("height"), "support"))
    return requests.join(prior, "category")


# -- constraints -------------------------------------------------------------------


def action_violations(actions: DataFrame, action_objects: DataFrame, action_rooms: DataFrame, objects: DataFrame, rooms: DataFrame) -> DataFrame:
    """``actions``: building_id, action_id, action_type, target, species, style, asset (nullable parameters)."""
    spark = actions.sparkSession
    row = lambda df, rule, subject: df.select(BUILDING, "action_id", F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))
    linked = action_objects.join(objects.select(BUILDING, "object_id", "locked", "category", F.lit(True).alias("_known")), [BUILDING, "object_id"], "left")
    materials, styles = dim(spark, "dim_materials").select("material"), dim(spark, "dim_styles").select("style")
    variants = dim(spark, "dim_assets").select("category", "asset")
    placed = actions.filter("asset IS NOT NULL").join(linked.filter("_known"), [BUILDING, "action_id"]).join(F.broadcast(variants), ["category", "asset"], "left_anti")
    return reduce(DataFrame.unionByName, [
        row(actions.filter(F.substring_index("target", ":", 1).isin(*IMMUTABLE_KINDS)), "immutable_target", "target"),
        row(linked.filter("_known IS NULL"), "unknown_object", "object_id"), row(linked.filter("locked"), "locked_object", "object_id"),
        row(action_rooms.join(rooms.select(BUILDING, "room_id"), [BUILDING, "room_id"], "left_anti"), "unknown_room", "room_id"),
        row(actions.filter("action_type = 'material_adjustment' AND species IS NOT NULL").join(F.broadcast(materials.withColumnRenamed("material", "species")), "species", "left_anti"), "material_taxonomy", "species"),
        row(actions.filter("action_type = 'style_refinement' AND style IS NOT NULL").join(F.broadcast(styles), "style", "left_anti"), "style_taxonomy", "style"),
        row(placed, "asset_category", "asset")])


def graph_violations(objects: DataFrame, rooms: DataFrame, tolerance: float = 0.35) -> DataFrame:
    """Materials and styles outside the catalogs and objects outside their room's bounds."""
    spark = objects.sparkSession
    materials = F.broadcast(dim(spark, "dim_materials").select("material"))
    named = objects.filter("material IS NOT NULL AND material <> ''").join(materials, "material", "left_anti")
    odd_style = rooms.filter("style IS NOT NULL AND style NOT IN ('', 'unknown')").withColumn("_s", tx.normalise_term(F.col("style"), "style")).filter("_s = 'unknown'")
    inside = objects.join(rooms.select(BUILDING, "room_id", "x0", "y0", "x1", "y1"), [BUILDING, "room_id"])
    apart = F.greatest(F.col("x0") - F.col("x"), F.col("x") - F.col("x1"), F.col("y0") - F.col("y"), F.col("y") - F.col("y1"))
    row = lambda df, rule, subject: df.select(BUILDING, F.lit(rule).alias("rule"), F.col(subject).cast("long").alias("subject"))
    return row(named, "material_taxonomy", "object_id").unionByName(row(odd_style, "style_taxonomy", "room_id")).unionByName(row(inside.filter(F.round(apart, 9) > tolerance), "room_containment", "object_id"))


def immutable_snapshot(collections: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One order-free digest per building and protected collection."""
    parts = [df.withColumn("_d", row_digest(df, cols)).groupBy(BUILDING).agg(multiset_digest(F.col("_d")).alias("digest")).withColumn("collection", F.lit(name)) for name, (df, cols) in collections.items()]
    return reduce(DataFrame.unionByName, parts)


def immutables_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    joined = before.withColumnRenamed("digest", "_b").join(after.withColumnRenamed("digest", "_a"), [BUILDING, "collection"], "full_outer")
    return joined.filter(~F.col("_b").eqNullSafe(F.col("_a"))).select(BUILDING, "collection")


def apply_actions(objects: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Object actions as one patch join; (patched objects, change log of entity, field, old, new).

    ``actions``: object_id, dx, dy (relative), rotation_z, width, depth, height, asset, admit - null where untouched.
    Locked objects keep their state.
    """
    staged = objects.join(actions, "object_id", "left")
    free = ~F.col("locked")
    fields = {
        "x": F.when(free, F.col("x") + F.coalesce("dx", F.lit(0.0))).otherwise(F.col("x")), "y": F.when(free, F.col("y") + F.coalesce("dy", F.lit(0.0))).otherwise(F.col("y")),
        "rotation_deg": F.when(free, F.coalesce("rotation_z", "rotation_deg")).otherwise(F.col("rotation_deg")),
        **{c: F.when(free, F.coalesce(f"set_{c}", c)).otherwise(F.col(c)) for c in ("width", "depth", "height")},
        "uncertain": F.when(free & F.col("admit").isNotNull(), ~F.col("admit")).otherwise(F.col("uncertain"))}
    patched = staged.select("object_id", *[F.col(c).alias(f"old_{c}") for c in fields], *[v.alias(c) for c, v in fields.items()], *[c for c in objects.columns if c not in fields and c != "object_id"])
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"old_{c}").cast("string").alias("old"), F.col(c).cast("string").alias("new")) for c in fields])).alias("e")
    log = patched.select("object_id", entries).select("object_id", "e.*").filter(~F.col("old").eqNullSafe(F.col("new")))
    return patched.select(*objects.columns), log


def buildable(rows: DataFrame, include_uncertain: bool = False, sized: bool = True) -> DataFrame:
    kept = rows if include_uncertain else rows.filter("NOT uncertain")
    return kept.filter("width > 0 AND depth > 0 AND height > 0") if sized else kept


