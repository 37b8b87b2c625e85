"""Content-hash work lists: what changed, what must be rendered again, what can be dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digest import canonical, digest, multiset_digest, row_digest
from ..session import cut_lineage

UNATTRIBUTED = "__scene__"


def bucket_by_room(records: DataFrame, rooms: DataFrame, building: str = "building_id") -> DataFrame:
    """Adds ``bucket``: the record's room, or the scene bucket when that room is unknown."""
    known = rooms.select(building, "room_id", F.lit(True).alias("_known"))
    joined = records.join(known, [building, "room_id"], "left")
    return joined.withColumn("bucket", F.when(F.col("_known"), F.col("room_id").cast("string")).otherwise(UNATTRIBUTED)).drop("_known")


def bucket_by_wall(records: DataFrame, wall_owners: DataFrame, rooms: DataFrame, building: str = "building_id") -> DataFrame:
    """Openings by their own room, else by every owner of their wall; a shared wall counts for both."""
    owned = records.filter(F.col("room_id").isNotNull())
    loose = records.filter(F.col("room_id").isNull()).drop("room_id").join(wall_owners.select(building, "wall_id", "room_id"), [building, "wall_id"], "left")
    return bucket_by_room(owned.unionByName(loose), rooms, building)


def collection_digests(records: DataFrame, columns: list[str], kind: str, building: str = "building_id") -> DataFrame:
    rows = records.withColumn("_row", row_digest(records, columns))
    return rows.groupBy(building, "bucket").agg(multiset_digest(F.col("_row")).alias("digest")).withColumn("kind", F.lit(kind))


def scene_digests(rooms: DataFrame, room_columns: list[str], collections: dict[str, tuple[DataFrame, list[str]]],
                  settings: str = "default", building: str = "building_id") -> tuple[DataFrame, DataFrame]:
    """(room digests, scene digests) from bucketed ``collections`` of kind -> (records, columns)."""
    parts = reduce(DataFrame.unionByName, [collection_digests(df, cols, kind, building) for kind, (df, cols) in sorted(collections.items())])
    kinds = sorted(collections)
    wide = parts.groupBy(building, "bucket").pivot("kind", kinds).agg(F.first("digest")).na.fill("")
    own = rooms.withColumn("_own", row_digest(rooms, room_columns)).withColumn("bucket", F.col("room_id").cast("string"))
    room = own.join(wide, [building, "bucket"], "left").na.fill("", kinds).select(
        building, "room_id", digest(F.col("_own"), *[F.col(k) for k in kinds]).alias("room_hash"))
    loose = wide.filter(F.col("bucket") == UNATTRIBUTED).select(building, digest(*[F.col(k) for k in kinds]).alias("_loose"))
    roster = rooms.groupBy(building).agg(multiset_digest(row_digest(rooms, ["room_id"])).alias("_roster"))
    scene = roster.join(loose, building, "left").select(
        building, digest(F.lit(settings), F.coalesce("_loose", F.lit("")), F.col("_roster")).alias("scene_hash"))
    return room, scene


def with_neighbours(room_hashes: DataFrame, adjacency: DataFrame, building: str = "building_id") -> DataFrame:
    """Folds in the hashes one hop away. ``adjacency``: building, room_id, neighbour_id.

    The hashes are written first: they are read as the room's own and as its neighbours'.
    """
    room_hashes = cut_lineage(room_hashes)
    near = room_hashes.select(building, F.col("room_id").alias("neighbour_id"), F.col("room_hash").alias("_near"))
    folded = adjacency.join(near, [building, "neighbour_id"]).groupBy(building, "room_id").agg(multiset_digest(F.col("_near")).alias("_around"))
    return room_hashes.join(folded, [building, "room_id"], "left").select(
        building, "room_id", digest(F.col("room_hash"), F.coalesce("_around", F.lit(""))).alias("room_hash"))


def camera_hashes(viewpoints: DataFrame, width: int = 640, height: int = 360) -> DataFrame:
    columns = ["x", "y", "z", "yaw", "pitch_deg", "vfov_deg", "aspect"]
    return viewpoints.withColumn("camera_hash", digest(canonical(viewpoints, columns), F.lit(str(width)), F.lit(str(height))))


def render_keys(viewpoints: DataFrame, room_hashes: DataFrame, scene_hashes: DataFrame, building: str = "building_id") -> DataFrame:
    """``viewpoints`` carry camera_hash and image; a viewpoint outside every room takes the scene hash."""
    joined = viewpoints.join(scene_hashes, building, "left").join(room_hashes, [building, "room_id"], "left")
    room = F.coalesce("room_hash", "scene_hash")
    return joined.withColumn("room_hash", room).withColumn("key", digest(F.col("scene_hash"), room, F.col("camera_hash"), F.col("image")))


def work_list(wanted: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Adds ``status``: 'hit' when the cached entry has this key and its outputs exist, else 'render'."""
    fresh = cache.filter("outputs_present").select("viewpoint_id", "key", F.lit(True).alias("_fresh"))
    joined = wanted.join(fresh, ["viewpoint_id", "key"], "left")
    hit = F.coalesce("_fresh", F.lit(False)) & F.lit(not force)
    return joined.withColumn("status", F.when(hit, "hit").otherwise("render")).drop("_fresh")


def stale_entries(cache: DataFrame, live: DataFrame) -> DataFrame:
    return cache.join(live.select("viewpoint_id"), "viewpoint_id", "left_anti")


def response_keys(images: DataFrame, content: str, prompt: str, model: str, version: str = "2") -> DataFrame:
    """Key under which a saved answer for these bytes, this prompt and this model is filed."""
    return images.withColumn("key", F.sha2(F.concat_ws(chr(1), F.lit(version), F.sha2(content, 256), F.lit(prompt), F.lit(model)), 256))


def missing_responses(keyed: DataFrame, answered: DataFrame) -> DataFrame:
    return keyed.join(answered.select("key"), "key", "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def prune(records: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    return records.join(live.select(*keys), keys, "left_semi")


def fold_outcomes(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Final status per planned viewpoint. ``outcomes``: viewpoint_id, ok, render_ms, error."""
    joined = plan.join(outcomes, "viewpoint_id", "left")
    status = F.when(F.col("status") == "hit", "cached").when(F.coalesce("ok", F.lit(False)), "rendered").otherwise("failed")
    error = F.when(F.col("status") == "hit", "").when(F.col("ok").isNull(), "no outcome reported").otherwise(F.coalesce("error", F.lit("")))
    return joined.withColumns({"status": status, "error": error})


def report(records: DataFrame, keys: list[str]) -> DataFrame:
    return records.groupBy(*keys).agg(
        F.count_if(F.col("status") == "rendered").alias("rendered"), F.count_if(F.col("status") == "cached").alias("cached"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total"))
