"""Registration queries: label candidates, fits against a known transform, region scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import FX, fx
from ..operators import registration as rg
from .drawings import GRAMS
from .evaluation import rounded
from .registry import query

# Sheets of ten labels. The picture is the plan under a known turn and scale; labels 8 and 9 are read wrongly.
FX["fx_cad_labels"] = """
SELECT CAST(FLOOR(CAST(p_partkey AS DOUBLE)/10e0) AS BIGINT) AS sheet_id, p_partkey AS uid, CASE p_partkey % 10 WHEN 0 THEN 'Kitchen' WHEN 1 THEN 'Master Bedroom' WHEN 2 THEN 'Bath 12 SQ M' WHEN 3 THEN 'Bedroom 2' WHEN 4 THEN 'Living' WHEN 5 THEN 'Store' WHEN 6 THEN 'Balcony' WHEN 7 THEN 'Bedroom 3' WHEN 8 THEN 'Study' ELSE 'Utility' END AS text,
 CASE p_partkey % 10 WHEN 0 THEN 'kitchen' WHEN 1 THEN 'bedroom' WHEN 3 THEN 'bedroom' ELSE 'unknown' END AS room_type, 0.94e0 AS confidence, CASE WHEN p_partkey % 10 = 5 THEN 'note' ELSE 'room_label' END AS kind,
 CAST((p_partkey*37) % 100 AS DOUBLE)/10e0 AS x, CAST((p_partkey*53) % 70 AS DOUBLE)/10e0 AS y FROM part"""
FX["fx_sheets"] = """
SELECT sheet_id, 8e0 + CAST(sheet_id % 5 AS DOUBLE) AS scale, CASE sheet_id % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 90e0 ELSE 17e0 END AS rot, CASE sheet_id % 3 WHEN 1 THEN 9e0 ELSE -1e0 END AS tx, CASE sheet_id % 3 WHEN 2 THEN 9e0 ELSE 8e0 END AS ty FROM (SELECT DISTINCT sheet_id FROM fx_cad_labels) q"""
FX["fx_image_labels"] = """
SELECT c.sheet_id, uid + 1000000 AS uid, CASE WHEN uid % 10 = 3 THEN 'BEDROOM-2' WHEN uid % 10 = 6 THEN 'BALCONY AREA' ELSE text END AS text, room_type, 0.5e0 + CAST(uid % 5 AS DOUBLE)/10e0 AS confidence,
 ((x-tx)*COS(RADIANS(rot)) + (y-ty)*SIN(RADIANS(rot)))/scale + CASE WHEN uid % 10 >= 8 THEN 0.9e0 ELSE 0e0 END AS u, ((x-tx)*SIN(RADIANS(rot)) - (y-ty)*COS(RADIANS(rot)))/scale AS v FROM fx_cad_labels c JOIN fx_sheets s ON s.sheet_id = c.sheet_id"""


def anchors(spark, sf_dir):
    return rg.match_keys(fx(spark, sf_dir, "fx_image_labels")), rg.match_keys(fx(spark, sf_dir, "fx_cad_labels"))


def sheets(spark, sf_dir):
    return fx(spark, sf_dir, "fx_sheets").select("sheet_id", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("x1"), F.lit(7.0).alias("y1"))


KEY = "TRIM(REGEXP_REPLACE(REGEXP_REPLACE(UPPER(text), '-', ' ', 'g'), '\\s+\\d+\\s+SQ M$', ''))"
CAND = f"""
a AS (SELECT *, {KEY} AS k FROM fx_image_labels), b AS (SELECT *, {KEY} AS k FROM fx_cad_labels),
p AS (SELECT a.sheet_id, a.uid AS ia, b.uid AS cb, a.room_type AS ra, b.room_type AS rb, kind, a.k AS ka, b.k AS kb, LEAST(a.confidence, b.confidence) AS cf, REPLACE(a.k,' ','') AS ta, REPLACE(b.k,' ','') AS tb, LIST_DISTINCT(STR_SPLIT(a.k,' ')) AS wa, LIST_DISTINCT(STR_SPLIT(b.k,' ')) AS wb FROM a JOIN b ON a.sheet_id = b.sheet_id),
g AS (SELECT *, {GRAMS.format('ta')} AS ga, {GRAMS.format('tb')} AS gb FROM p), s AS (SELECT *, 2e0*LEN(LIST_INTERSECT(ga,gb))/(LEN(ga)+LEN(gb)) AS dice, LEN(LIST_INTERSECT(wa,wb)) AS shared FROM g),
w AS (SELECT *, CASE WHEN ka = kb THEN 1e0 WHEN shared = LEN(wa) OR shared = LEN(wb) THEN 0.75e0 WHEN dice >= 0.62e0 THEN dice WHEN ra <> 'unknown' AND ra = rb THEN 0.5e0 ELSE 0e0 END AS w0 FROM s),
z AS (SELECT sheet_id, ia, cb, w0*CASE WHEN kind <> 'room_label' THEN 0.8e0 ELSE 1e0 END*(0.5e0+0.5e0*cf) AS w FROM w WHERE w0 > 0),
cd AS (SELECT * FROM z)"""


@query("label_candidates", "JN-16", oracle=f"WITH {CAND} SELECT sheet_id, ia AS image_label_id, cb AS cad_uid, RND(w,4) AS weight FROM cd")
def label_candidates(spark, sf_dir):
    return rg.candidates(*anchors(spark, sf_dir)).select("sheet_id", "image_label_id", "cad_uid", "weight")


@query("unmatched_labels", "JN-17", oracle=f"WITH {CAND} SELECT DISTINCT sheet_id, {KEY} AS match_key FROM fx_cad_labels c WHERE uid NOT IN (SELECT cb FROM cd WHERE ia % 2 = 0)")
def unmatched_labels(spark, sf_dir):
    image, drawing = anchors(spark, sf_dir)
    used = rg.candidates(image, drawing).filter("image_label_id % 2 = 0")
    return rg.unmatched(drawing, used, "cad_uid")


@query("similarity_fits", "RG-01", oracle="SELECT sheet_id, RND(scale,5) AS scale, RND(rot,4) AS rotation_deg, RND(tx,4) AS tx, RND(ty,4) AS ty FROM fx_sheets")
def similarity_fits(spark, sf_dir):
    cad = fx(spark, sf_dir, "fx_cad_labels").select("sheet_id", (F.col("uid") + 1000000).alias("uid"), "x", "y")
    points = fx(spark, sf_dir, "fx_image_labels").filter("uid % 10 < 8").join(cad, ["sheet_id", "uid"]).withColumn("weight", F.col("confidence"))
    fits = rg.fit_groups(points, ["sheet_id"])
    return rounded(rounded(fits.select("sheet_id", "fit.scale", "fit.rotation_deg", "fit.tx", "fit.ty"), 5, "scale"), 4, "rotation_deg", "tx", "ty")


@query("sheet_consensus", "RG-02", "RG-03", oracle="SELECT sheet_id, RND(scale,3) AS scale, RND(rot,2) AS rotation_deg, TRUE AS enough, sheet_id % 3 <> 2 AS rotation_snapped FROM fx_sheets")
def sheet_consensus(spark, sf_dir):
    found = rg.consensus(rg.candidates(*anchors(spark, sf_dir)), sheets(spark, sf_dir))
    rows = found.select("sheet_id", "fit.scale", "fit.rotation_deg", (F.col("inlier_count") >= 8).alias("enough"), "rotation_snapped")
    return rounded(rounded(rows, 3, "scale"), 2, "rotation_deg")


@query("sheet_registration", "RG-04", "RG-08")
def sheet_registration(spark, sf_dir):
    rows = rg.candidates(*anchors(spark, sf_dir))
    accepted = rg.accept(rg.consensus(rows, sheets(spark, sf_dir)), sheets(spark, sf_dir), rows)
    boxes = fx(spark, sf_dir, "fx_observed").select((F.col("image_id") % 200).alias("sheet_id"), "local_id", "bx0", "bx1", "by0", "by1")
    return rounded(rg.place_detections(boxes, accepted).select("sheet_id", "local_id", "method", "confidence", "x", "y", "tolerance_m"), 4, "x", "y", "tolerance_m")


TYPES = ["living_room", "bedroom", "hallway"]
SCORES = """
ty AS (SELECT DISTINCT building_id, t AS observed_type FROM fx_rooms CROSS JOIN (VALUES ('living_room'), ('bedroom'), ('hallway')) v(t)),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY building_id ORDER BY area DESC, room_id) AS rnk, COUNT(*) OVER (PARTITION BY building_id) AS n, GREATEST(x1-x0,y1-y0)/LEAST(x1-x0,y1-y0) AS aspect FROM fx_rooms),
sc AS (SELECT r.building_id, observed_type, r.room_id, CASE WHEN area BETWEEN area_lo AND area_hi THEN 1e0 WHEN area < area_lo THEN GREATEST(0e0, 1e0-(area_lo-area)/area_lo) ELSE GREATEST(0e0, 1e0-(area-area_hi)/area_hi) END
  + CASE observed_type WHEN 'living_room' THEN 0.25e0*(1e0-CAST(rnk-1 AS DOUBLE)/(n-1)) WHEN 'hallway' THEN 0.25e0*CAST(rnk-1 AS DOUBLE)/(n-1) + CASE WHEN aspect > 2.2e0 THEN 0.2e0 ELSE 0e0 END ELSE 0e0 END AS base, r.room_type, style_confidence AS c FROM ty JOIN rk r ON r.building_id = ty.building_id JOIN dim_area_priors p ON p.room_type = observed_type),
fs AS (SELECT *, CASE WHEN r_known AND c >= 0.45e0 AND room_type = observed_type THEN base + 1.3e0*c WHEN r_known AND c >= 0.45e0 THEN base*(1e0-0.85e0*c) ELSE base END AS score FROM (SELECT *, room_type <> 'unknown' AS r_known FROM sc) q)"""


def scored(spark, sf_dir):
    rooms = fx(spark, sf_dir, "fx_rooms").withColumns({"aspect": F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), "room_type_confidence": F.col("style_confidence")})
    types = rooms.select("building_id").distinct().withColumn("observed_type", F.explode(F.array(*[F.lit(t) for t in TYPES])))
    regions = rooms.select("building_id", "room_id", "area", "aspect", "room_type", "room_type_confidence")
    order = types.withColumn("position", F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("observed_type")))
    return rg.score_regions(types, regions), order, regions


@query("region_scores", "RG-05", "WN-10", oracle=f"WITH {SCORES} SELECT building_id, observed_type, room_id, RND(score,6) AS score FROM fs")
def region_scores(spark, sf_dir):
    return rounded(scored(spark, sf_dir)[0].select("building_id", "observed_type", "room_id", "score"), 6, "score")


ASSIGNED = f"""{SCORES}, v AS (SELECT fs.building_id, observed_type, fs.room_id, rnk, CAST(ROUND(score*1e9) AS BIGINT) AS s FROM fs JOIN rk USING (building_id, room_id)),
cb AS (SELECT l.building_id, l.room_id AS rl, b.room_id AS rb, h.room_id AS rh, l.s AS sl, b.s AS sb, h.s AS sh, ROW_NUMBER() OVER (PARTITION BY l.building_id ORDER BY l.s + b.s + h.s DESC, l.rnk, b.rnk, h.rnk) AS k
 FROM v l JOIN v b ON b.building_id = l.building_id AND b.room_id <> l.room_id JOIN v h ON h.building_id = l.building_id AND h.room_id <> l.room_id AND h.room_id <> b.room_id WHERE l.observed_type = 'living_room' AND b.observed_type = 'bedroom' AND h.observed_type = 'hallway'),
asg AS (SELECT building_id, 'living_room' AS observed_type, CASE WHEN sl >= 150000000 THEN rl END AS room_id FROM cb WHERE k = 1 UNION ALL SELECT building_id, 'bedroom', CASE WHEN sb >= 150000000 THEN rb END FROM cb WHERE k = 1 UNION ALL SELECT building_id, 'hallway', CASE WHEN sh >= 150000000 THEN rh END FROM cb WHERE k = 1)"""


@query("region_assignment", "RG-06", oracle=f"WITH {ASSIGNED} SELECT building_id, observed_type, room_id FROM asg")
def region_assignment(spark, sf_dir):
    scores, order, _ = scored(spark, sf_dir)
    return rg.assign_regions(scores, order).select("building_id", "observed_type", "room_id")


@query("image_groups", "RG-07", oracle=f"""
WITH {ASSIGNED}, vt AS (SELECT image_id % 10 AS building_id, CASE WHEN image_id % 3 = 0 THEN 'living_room' ELSE 'bedroom' END AS t, COUNT(*) AS images, MAX(confidence) AS o FROM fx_observed WHERE image_id % 4 <> 0 GROUP BY ALL),
pl AS (SELECT a.building_id, a.room_id, observed_type, images, o FROM asg a JOIN vt ON vt.building_id = a.building_id AND t = observed_type WHERE room_id IS NOT NULL),
j AS (SELECT r.building_id, r.room_id, images, room_type, observed_type, COALESCE(style_confidence,0e0) AS c, COALESCE(o,0e0) AS o, room_type <> 'unknown' AS stated FROM fx_rooms r LEFT JOIN pl ON pl.building_id = r.building_id AND pl.room_id = r.room_id)
SELECT building_id, room_id, COALESCE(images, 0) AS images, CASE WHEN stated THEN room_type ELSE COALESCE(observed_type, 'unknown') END AS room_type, RND(CASE WHEN stated AND room_type = observed_type THEN c+0.35e0*o*(1e0-c) WHEN stated THEN c ELSE o END,4) AS confidence, COALESCE(stated AND observed_type IS NOT NULL AND room_type <> observed_type, FALSE) AS conflict FROM j""")
def image_groups(spark, sf_dir):
    scores, order, regions = scored(spark, sf_dir)
    images = fx(spark, sf_dir, "fx_observed").select((F.col("image_id") % 10).alias("building_id"), "image_id", F.when(F.col("image_id") % 3 == 0, "living_room").otherwise("bedroom").alias("room_type"), "confidence",
                                                     F.when(F.col("image_id") % 4 == 0, "layout").otherwise("full").alias("mode"))
    return rg.group_images(images, rg.assign_regions(scores, order), regions)
