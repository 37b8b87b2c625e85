"""Content-hash queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fx
from ..operators import incremental as op
from .registry import query

OBJECT_COLUMNS = ["object_id", "category", "x", "y", "z", "rotation_deg", "width", "depth", "height", "material"]
LIGHT_COLUMNS = ["light_id", "kind", "power_w", "kelvin"]
OPENING_COLUMNS = ["opening_id", "kind", "x", "y", "width", "height"]
ROOM_COLUMNS = ["room_id", "room_type", "style", "x0", "y0", "x1", "y1"]
DOUBLES = set("x y z rotation_deg width depth height power_w kelvin x0 y0 x1 y1 yaw pitch_deg vfov_deg aspect".split())


def framed_sql(*texts: str) -> str:
    return "CONCAT(" + ", ".join(f"COALESCE(CAST(LENGTH({t}) AS VARCHAR) || ':' || {t}, '~')" for t in texts) + ")"


def digest_sql(*texts: str) -> str:
    return f"SUBSTRING(SHA256({framed_sql(*texts)}),1,32)"


def canon_sql(columns: list[str]) -> str:
    return framed_sql(*[f"CAST(CAST(ROUND({c}*1000000) AS BIGINT) AS VARCHAR)" if c in DOUBLES else f"CAST({c} AS VARCHAR)" for c in columns])


def row_sql(columns: list[str]) -> str:
    return f"SUBSTRING(SHA256({canon_sql(columns)}),1,32)"


def multiset_sql(row: str) -> str:
    half = lambda at: f"COALESCE(CAST(SUM(CAST(CONCAT('0x', SUBSTRING({row},{at},15)) AS BIGINT)) AS VARCHAR),'0')"
    return digest_sql(f"CAST(COUNT({row}) AS VARCHAR)", half(1), half(16))


BUCKETS = f"""
ob AS (SELECT o.*, CASE WHEN r.room_id IS NULL OR o.object_id % 19 = 0 THEN '__scene__' ELSE CAST(r.room_id AS VARCHAR) END AS bucket FROM fx_objects o LEFT JOIN fx_rooms r ON r.room_id = o.hint_room_id AND r.building_id = o.building_id),
lb AS (SELECT l.*, CAST(room_id AS VARCHAR) AS bucket FROM fx_lights l),
pb AS (SELECT p.*, CAST(COALESCE(p.room_id, w.room_id) AS VARCHAR) AS bucket FROM fx_openings p LEFT JOIN fx_wall_owners w ON p.room_id IS NULL AND w.wall_id = p.wall_id),
od AS (SELECT building_id, bucket, {multiset_sql('d')} AS o FROM (SELECT *, {row_sql(OBJECT_COLUMNS)} AS d FROM ob) GROUP BY ALL),
ld AS (SELECT building_id, bucket, {multiset_sql('d')} AS l FROM (SELECT *, {row_sql(LIGHT_COLUMNS)} AS d FROM lb) GROUP BY ALL),
pd AS (SELECT building_id, bucket, {multiset_sql('d')} AS p FROM (SELECT *, {row_sql(OPENING_COLUMNS)} AS d FROM pb) GROUP BY ALL),
rh AS (SELECT r.building_id, r.room_id, {digest_sql(row_sql(ROOM_COLUMNS), "COALESCE(l,'')", "COALESCE(o,'')", "COALESCE(p,'')")} AS room_hash
  FROM fx_rooms r LEFT JOIN od ON od.building_id = r.building_id AND od.bucket = CAST(r.room_id AS VARCHAR) LEFT JOIN ld ON ld.building_id = r.building_id AND ld.bucket = CAST(r.room_id AS VARCHAR)
  LEFT JOIN pd ON pd.building_id = r.building_id AND pd.bucket = CAST(r.room_id AS VARCHAR)),
roster AS (SELECT building_id, {multiset_sql('d')} AS ro FROM (SELECT building_id, {row_sql(['room_id'])} AS d FROM fx_rooms) GROUP BY building_id),
sh AS (SELECT roster.building_id, {digest_sql("'default'", "CASE WHEN o IS NULL THEN '' ELSE " + digest_sql("''", "o", "''") + " END", "ro")} AS scene_hash FROM roster LEFT JOIN od ON od.building_id = roster.building_id AND od.bucket = '__scene__')"""
CAMERA = f"""
cam AS (SELECT *, {digest_sql(canon_sql(['x','y','z','yaw','pitch_deg','vfov_deg','aspect']), "'640'", "'360'")} AS camera_hash, CONCAT('preview/', CAST(viewpoint_id AS VARCHAR), '.png') AS image FROM fx_viewpoints),
keyed AS (SELECT cam.*, room_hash, scene_hash, {digest_sql('scene_hash', 'room_hash', 'camera_hash', 'image')} AS key FROM cam JOIN rh USING (building_id, room_id) JOIN sh USING (building_id)),
cache AS (SELECT viewpoint_id + CASE WHEN viewpoint_id % 11 = 0 THEN 1000000 ELSE 0 END AS viewpoint_id, CASE WHEN viewpoint_id % 4 = 0 THEN 'old' ELSE key END AS key, viewpoint_id % 7 <> 0 AS outputs_present FROM keyed WHERE viewpoint_id % 3 <> 0),
wl AS (SELECT k.*, CASE WHEN c.key IS NOT NULL THEN 'hit' ELSE 'render' END AS status FROM keyed k LEFT JOIN cache c ON c.viewpoint_id = k.viewpoint_id AND c.key = k.key AND c.outputs_present),
folded AS (SELECT building_id, room_id, viewpoint_id, CASE WHEN status = 'hit' THEN 'cached' WHEN viewpoint_id % 5 IN (0, 1) THEN 'failed' ELSE 'rendered' END AS status,
  CASE WHEN status = 'hit' THEN '' WHEN viewpoint_id % 5 = 0 THEN 'no outcome reported' WHEN viewpoint_id % 5 = 1 THEN 'crashed' ELSE '' END AS error FROM wl)"""


def buckets(spark, sf_dir):
    rooms = fx(spark, sf_dir, "fx_rooms")
    objects = fx(spark, sf_dir, "fx_objects").withColumn("room_id", F.when(F.col("object_id") % 19 != 0, F.col("hint_room_id")))
    return rooms, {
        "lights": (op.bucket_by_room(fx(spark, sf_dir, "fx_lights"), rooms), LIGHT_COLUMNS),
        "objects": (op.bucket_by_room(objects, rooms), OBJECT_COLUMNS),
        "openings": (op.bucket_by_wall(fx(spark, sf_dir, "fx_openings"), fx(spark, sf_dir, "fx_wall_owners"), rooms), OPENING_COLUMNS),
    }


def hashes(spark, sf_dir):
    rooms, collections = buckets(spark, sf_dir)
    return op.scene_digests(rooms, ROOM_COLUMNS, collections)


def keyed(spark, sf_dir):
    views = op.camera_hashes(fx(spark, sf_dir, "fx_viewpoints")).withColumn(
        "image", F.concat(F.lit("preview/"), F.col("viewpoint_id").cast("string"), F.lit(".png")))
    return op.render_keys(views, *hashes(spark, sf_dir))


def cached(keys):
    return keys.filter("viewpoint_id % 3 <> 0").select(
        (F.col("viewpoint_id") + F.when(F.col("viewpoint_id") % 11 == 0, 1000000).otherwise(0)).alias("viewpoint_id"),
        F.when(F.col("viewpoint_id") % 4 == 0, "old").otherwise(F.col("key")).alias("key"), (F.col("viewpoint_id") % 7 != 0).alias("outputs_present"))


def folded(spark, sf_dir):
    keys = keyed(spark, sf_dir)
    outcomes = keys.filter("viewpoint_id % 5 <> 0").select(
        "viewpoint_id", (F.col("viewpoint_id") % 5 != 1).alias("ok"), F.when(F.col("viewpoint_id") % 5 == 1, "crashed").otherwise("").alias("error"))
    return op.fold_outcomes(op.work_list(keys, cached(keys)), outcomes)


@query("ownership_buckets", "IC-01", oracle=f"WITH {BUCKETS} SELECT building_id, bucket, COUNT(*) AS openings FROM pb GROUP BY ALL")
def ownership_buckets(spark, sf_dir):
    return buckets(spark, sf_dir)[1]["openings"][0].groupBy("building_id", "bucket").agg(F.count("*").alias("openings"))


@query("room_digests", "IC-02", "STR-17", oracle=f"WITH {BUCKETS} SELECT building_id, room_id, room_hash FROM rh")
def room_digests(spark, sf_dir):
    return hashes(spark, sf_dir)[0]


@query("scene_digests", "IC-02", oracle=f"WITH {BUCKETS} SELECT building_id, scene_hash FROM sh")
def scene_digests(spark, sf_dir):
    return hashes(spark, sf_dir)[1]


@query("neighbour_digests", "IC-03", oracle=f"""
WITH {BUCKETS}, adj AS (SELECT a.building_id, a.room_id, b.room_hash AS nh FROM rh a LEFT JOIN rh b ON b.building_id = a.building_id AND ABS(a.room_id - b.room_id) = 1)
SELECT building_id, room_id, {digest_sql('room_hash', "CASE WHEN n = 0 THEN '' ELSE around END")} AS room_hash FROM rh JOIN
 (SELECT building_id, room_id, COUNT(nh) AS n, {multiset_sql('nh')} AS around FROM adj GROUP BY building_id, room_id) USING (building_id, room_id)""")
def neighbour_digests(spark, sf_dir):
    rooms, _ = hashes(spark, sf_dir)
    ids = fx(spark, sf_dir, "fx_rooms").select("building_id", "room_id")
    step = lambda d: ids.select("building_id", "room_id", (F.col("room_id") + d).alias("neighbour_id"))
    return op.with_neighbours(rooms, step(1).union(step(-1)))


@query("render_keys", "IC-04", oracle=f"WITH {BUCKETS}, {CAMERA} SELECT viewpoint_id, camera_hash, key FROM keyed")
def render_keys(spark, sf_dir):
    return keyed(spark, sf_dir).select("viewpoint_id", "camera_hash", "key")


@query("render_work_list", "IC-05", oracle=f"WITH {BUCKETS}, {CAMERA} SELECT viewpoint_id, room_id, status FROM wl")
def render_work_list(spark, sf_dir):
    keys = keyed(spark, sf_dir)
    return op.work_list(keys, cached(keys)).select("viewpoint_id", "room_id", "status")


@query("stale_cache_entries", "IC-05", oracle=f"WITH {BUCKETS}, {CAMERA} SELECT viewpoint_id, key FROM cache WHERE viewpoint_id NOT IN (SELECT viewpoint_id FROM fx_viewpoints)")
def stale_cache_entries(spark, sf_dir):
    return op.stale_entries(cached(keyed(spark, sf_dir)), fx(spark, sf_dir, "fx_viewpoints")).select("viewpoint_id", "key")


@query("render_report", "IC-07", oracle=f"""
WITH {BUCKETS}, {CAMERA} SELECT room_id, COUNT(*) FILTER (status = 'rendered') AS rendered, COUNT(*) FILTER (status = 'cached') AS cached, COUNT(*) FILTER (status = 'failed') AS failed, COUNT(*) AS total FROM folded GROUP BY room_id""")
def render_report(spark, sf_dir):
    return op.report(folded(spark, sf_dir), ["room_id"])


@query("manifest_upsert", "SRC-08", "IC-07", oracle=f"""
WITH {BUCKETS}, {CAMERA}, old AS (SELECT viewpoint_id, room_id, 'rendered' AS status, '' AS error FROM fx_viewpoints WHERE viewpoint_id % 2 = 0)
SELECT * FROM (SELECT viewpoint_id, room_id, status, error FROM old WHERE viewpoint_id NOT IN (SELECT viewpoint_id FROM folded WHERE viewpoint_id % 3 = 0)
UNION ALL SELECT viewpoint_id, room_id, status, error FROM folded WHERE viewpoint_id % 3 = 0) WHERE viewpoint_id % 13 <> 0""")
def manifest_upsert(spark, sf_dir):
    views = fx(spark, sf_dir, "fx_viewpoints")
    old = views.filter("viewpoint_id % 2 = 0").select("viewpoint_id", "room_id", F.lit("rendered").alias("status"), F.lit("").alias("error"))
    new = folded(spark, sf_dir).filter("viewpoint_id % 3 = 0").select("viewpoint_id", "room_id", "status", "error")
    return op.prune(op.upsert(old, new, ["viewpoint_id"]), views.filter("viewpoint_id % 13 <> 0"), ["viewpoint_id"])


@query("missing_responses", "IC-06", oracle="""
WITH k AS (SELECT doc_id, SHA256(CONCAT_WS(CHR(1), '2', SHA256(text), 'describe', 'm1')) AS key FROM documents)
SELECT doc_id, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 3 = 0)""")
def missing_responses(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = op.response_keys(docs, "text", "describe", "m1").select("doc_id", "key")
    return op.missing_responses(found, found.filter("doc_id % 3 = 0").select("key").distinct()).select("doc_id", "key")
