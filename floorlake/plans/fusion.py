"""Multi-image fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import FX, fx
from ..functions import boxes, colour
from ..operators import fusion as fu
from .evaluation import rounded
from .registry import query
from .rooms import RGB, hex_sql

FX["fx_observed"] = """
SELECT detection_id AS local_id, image_id, room_id, category, bx0, by0, bx1, by1, (bx1-bx0)*(by1-by0) AS box_area, confidence, material,
 CASE detection_id % 5 WHEN 0 THEN '#8C5A3C' WHEN 1 THEN '#3F6B5E' WHEN 2 THEN '#D8C3A5' WHEN 3 THEN '#2E4A52' ELSE '#EFEDE8' END AS color_hex,
 CASE detection_id % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large' ELSE 'medium' END AS size_bucket, CASE detection_id % 3 WHEN 0 THEN 'grey corner sofa' WHEN 1 THEN 'wooden table' ELSE '' END AS label FROM fx_detections"""
FX["fx_local_relations"] = """
SELECT local_id AS relation_id, image_id, local_id AS subject, CASE local_id % 4 WHEN 0 THEN 'faces' WHEN 1 THEN 'beside' WHEN 2 THEN 'mounted_on' ELSE 'likes' END AS predicate, local_id + CASE WHEN local_id % 7 = 0 THEN 100000000 WHEN local_id % 25 = 24 THEN -1 ELSE 1 END AS object, confidence FROM fx_observed"""

NOISY = "ROUND(LEAST(0.99e0, 1e0-(1e0-MAX({c}))*EXP(SUM(LN(1e0-0.5e0*{c}))-LN(1e0-0.5e0*MAX({c}))))+1e-9,4)"


@query("corroborated_confidence", "AG-06", oracle="""
WITH o AS (SELECT room_id, category, LIST_REVERSE_SORT(LIST(confidence)) AS cs FROM fx_observed GROUP BY ALL)
SELECT room_id, category, ROUND(LEAST(0.99e0, LIST_REDUCE(cs, LAMBDA a, v: a + (1e0-a)*v*0.5e0))+1e-9,4) AS confidence FROM o""")
def corroborated_confidence(spark, sf_dir):
    return fx(spark, sf_dir, "fx_observed").groupBy("room_id", "category").agg(fu.corroborated(F.col("confidence")).alias("confidence"))


@query("weighted_vote", "AG-07", oracle="""
WITH t AS (SELECT room_id, category, material, SUM(GREATEST(confidence,1e-3)) AS w FROM fx_observed WHERE material <> 'unknown' GROUP BY ALL), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY room_id, category ORDER BY ROUND(w,9) DESC, material) AS rn FROM t)
SELECT q.room_id, q.category, COALESCE(k.material, 'unknown') AS material FROM (SELECT DISTINCT room_id, category FROM fx_observed) q LEFT JOIN k ON k.room_id = q.room_id AND k.category = q.category AND rn = 1""")
def weighted_vote(spark, sf_dir):
    return fu.vote(fx(spark, sf_dir, "fx_observed"), ["room_id", "category"], "material", fu.weight_of(), "unknown")


@query("mean_colours", "AG-08", oracle=f"""
SELECT room_id, category, {hex_sql(*[f"SUM({c.format('color_hex')}*GREATEST(confidence,1e-3))/SUM(GREATEST(confidence,1e-3))" for c in RGB])} AS color_hex, RND(SUM(box_area*GREATEST(confidence,1e-3))/SUM(GREATEST(confidence,1e-3)),6) AS mean_area FROM fx_observed GROUP BY ALL""")
def mean_colours(spark, sf_dir):
    w = fu.weight_of()
    found = fx(spark, sf_dir, "fx_observed").groupBy("room_id", "category").agg(colour.mean_hex(F.col("color_hex"), w).alias("color_hex"), (F.sum(F.col("box_area") * w) / F.sum(w)).alias("mean_area"))
    return rounded(found, 6, "mean_area")


@query("fused_lights", "AG-09", oracle=f"""
WITH n AS (SELECT room_id, kind, MAX(f) AS fixtures, COUNT(*) AS images FROM (SELECT room_id, kind, image_id, SUM(fixtures) AS f FROM fx_lights GROUP BY ALL) GROUP BY ALL)
SELECT room_id, kind, CAST(ANY_VALUE(n.fixtures) AS BIGINT) AS fixtures, RND(SUM(kelvin*GREATEST(confidence,1e-3))/SUM(GREATEST(confidence,1e-3)),4) AS kelvin, RND(SUM(power_w*GREATEST(confidence,1e-3))/SUM(GREATEST(confidence,1e-3)),4) AS power_w, BOOL_OR(is_on) AS is_on, {NOISY.format(c='confidence')} AS confidence, BOOL_AND(uncertain) AS uncertain, ANY_VALUE(images) AS images
FROM fx_lights JOIN n USING (room_id, kind) GROUP BY room_id, kind""")
def fused_lights(spark, sf_dir):
    return rounded(fu.fuse_lights(fx(spark, sf_dir, "fx_lights"), ["room_id"]), 4, "kelvin", "power_w")


@query("replicated_openings", "AG-10", oracle="""
WITH o AS (SELECT room_id, category AS kind, material AS on_wall, image_id, local_id, confidence FROM fx_observed), n AS (SELECT room_id, kind, on_wall, MAX(c) AS n FROM (SELECT room_id, kind, on_wall, image_id, COUNT(*) AS c FROM o GROUP BY ALL) GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY room_id, kind, on_wall ORDER BY confidence DESC, image_id, local_id) AS rn FROM o) WHERE rn = 1)
SELECT room_id, kind, on_wall, local_id, confidence, CAST(i AS INTEGER) AS instance FROM (SELECT b.*, UNNEST(RANGE(1, n+1)) AS i FROM b JOIN n USING (room_id, kind, on_wall))""")
def replicated_openings(spark, sf_dir):
    rows = fx(spark, sf_dir, "fx_observed").withColumnsRenamed({"category": "kind", "material": "on_wall"})
    return fu.replicate_best(rows, ["room_id", "kind", "on_wall"], "local_id")


@query("merged_finishes", "AG-11", oracle=f"""
WITH f AS (SELECT room_id, material, color_hex, box_area AS roughness, CASE WHEN room_id % 5 = 0 THEN 0e0 ELSE GREATEST(0e0, confidence-0.3e0) END AS confidence FROM fx_observed), s AS (SELECT room_id, MAX(confidence) > 0 AS sure FROM f GROUP BY 1),
u AS (SELECT f.* FROM f JOIN s USING (room_id) WHERE NOT sure OR confidence > 0), v AS (SELECT room_id, material, ROW_NUMBER() OVER (PARTITION BY room_id ORDER BY ROUND(SUM(GREATEST(confidence,1e-3)),9) DESC, material) AS rn FROM u WHERE material <> 'unknown' GROUP BY room_id, material),
m AS (SELECT room_id, {hex_sql(*[f"SUM({c.format('color_hex')}*GREATEST(confidence,1e-3))/SUM(GREATEST(confidence,1e-3))" for c in RGB])} AS color_hex, RND(SUM(roughness*GREATEST(confidence,1e-3))/SUM(GREATEST(confidence,1e-3)),6) AS roughness, {NOISY.format(c='confidence')} AS confidence FROM u GROUP BY room_id)
SELECT m.*, COALESCE(v.material, 'unknown') AS material FROM m LEFT JOIN v ON v.room_id = m.room_id AND rn = 1""")
def merged_finishes(spark, sf_dir):
    rows = fx(spark, sf_dir, "fx_observed").withColumn("roughness", F.col("box_area")).withColumn(
        "confidence", F.when(F.col("room_id") % 5 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("confidence") - 0.3)))
    return rounded(fu.merge_finishes(rows, ["room_id"]), 6, "roughness")


@query("fused_objects", "AG-12")
def fused_objects(spark, sf_dir):
    observed = fx(spark, sf_dir, "fx_observed")
    return rounded(fu.merge_clusters(observed, fu.fuse_objects(observed, ["room_id"]), ["room_id"]), 4, "confidence")


@query("fusion_stats", "AG-12", oracle="SELECT room_id, category, COUNT(*) AS observations FROM fx_observed GROUP BY ALL")
def fusion_stats(spark, sf_dir):
    """Every observation ends in exactly one fused object."""
    observed = fx(spark, sf_dir, "fx_observed")
    merged = fu.merge_clusters(observed, fu.fuse_objects(observed, ["room_id"]), ["room_id"])
    return merged.groupBy("room_id", "category").agg(F.sum("observations").alias("observations"))


@query("fused_relationships", "JN-18", oracle=f"""
WITH m AS (SELECT image_id, local_id, CAST(FLOOR(CAST(local_id AS DOUBLE)/2e0) AS BIGINT) % 400 AS e FROM fx_observed)
SELECT s.e AS subject_id, predicate, o.e AS object_id, {NOISY.format(c='r.confidence')} AS confidence FROM fx_local_relations r JOIN m s ON s.image_id = r.image_id AND s.local_id = r.subject JOIN m o ON o.image_id = r.image_id AND o.local_id = r.object WHERE s.e <> o.e GROUP BY ALL""")
def fused_relationships(spark, sf_dir):
    id_map = fx(spark, sf_dir, "fx_observed").select("image_id", "local_id", (F.floor(F.col("local_id") / 2) % 400).alias("entity_id"))
    return fu.fuse_relationships(fx(spark, sf_dir, "fx_local_relations"), id_map)


@query("relationship_rejects", "JN-19", oracle="""
WITH ob AS (SELECT image_id, local_id FROM fx_observed WHERE local_id % 9 <> 0), r AS (SELECT CASE WHEN predicate = 'likes' THEN 'unenforceable_predicate' WHEN s.local_id IS NULL OR (o.local_id IS NULL AND predicate <> 'mounted_on') THEN 'relationship_dangling_reference' ELSE '' END AS reason FROM fx_local_relations r LEFT JOIN ob s ON s.image_id = r.image_id AND s.local_id = r.subject LEFT JOIN ob o ON o.image_id = r.image_id AND o.local_id = r.object)
SELECT reason, COUNT(*) AS n FROM r GROUP BY reason""")
def relationship_rejects(spark, sf_dir):
    kept = fx(spark, sf_dir, "fx_observed").filter("local_id % 9 <> 0")
    return fu.check_relationships(fx(spark, sf_dir, "fx_local_relations"), kept).groupBy("reason").agg(F.count("*").alias("n"))


FX["fx_seated"] = """
SELECT building_id, room_id, object_id, CASE object_id % 9 WHEN 0 THEN 'sofa' WHEN 1 THEN 'tv' WHEN 2 THEN 'coffee_table' WHEN 3 THEN 'bed' WHEN 4 THEN 'bedside_table' WHEN 5 THEN 'rug' WHEN 6 THEN 'armchair' WHEN 7 THEN 'dining_chair' ELSE 'tv_unit' END AS category, x, y, confidence FROM fx_placed WHERE NOT (room_id % 3 = 0 AND object_id % 9 = 8)"""


@query("implied_relations", "JN-21", oracle="""
WITH ex AS (SELECT object_id AS subject_id, 'faces' AS predicate FROM fx_seated WHERE object_id % 5 = 0),
w AS (SELECT s.*, rule_no, predicate, object_category FROM fx_seated s JOIN dim_implied_relations d ON d.subject_category = s.category WHERE EXISTS (SELECT 1 FROM fx_seated t WHERE t.room_id = s.room_id AND t.category = d.object_category)),
f AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY object_id, predicate ORDER BY rule_no) AS rn FROM w) q WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.subject_id = q.object_id AND ex.predicate = q.predicate))
SELECT subject_id, predicate, object_id, 0.45e0 AS confidence FROM (SELECT f.object_id AS subject_id, f.predicate, t.object_id, ROW_NUMBER() OVER (PARTITION BY f.object_id, f.predicate ORDER BY ROUND(SQRT(POWER(f.x-t.x,2)+POWER(f.y-t.y,2)),9), t.object_id) AS k FROM f JOIN fx_seated t ON t.room_id = f.room_id AND t.category = f.object_category) WHERE k = 1""")
def implied_relations(spark, sf_dir):
    objects = fx(spark, sf_dir, "fx_seated")
    explicit = objects.filter("object_id % 5 = 0").select(F.col("object_id").alias("subject_id"), F.lit("faces").alias("predicate"))
    return fu.implied_relationships(objects, explicit)


@query("placing_relations", "WN-04", oracle="""
WITH r AS (SELECT subject % 300 AS subject_id, CASE relation_id % 3 WHEN 0 THEN 'faces' WHEN 1 THEN 'beside' ELSE 'under' END AS predicate, object AS object_id, confidence, relation_id FROM fx_local_relations)
SELECT subject_id, predicate, object_id, confidence FROM r WHERE predicate = 'faces' UNION ALL SELECT subject_id, predicate, object_id, confidence FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY confidence DESC, relation_id) AS rn FROM r WHERE predicate <> 'faces') WHERE rn = 1""")
def placing_relations(spark, sf_dir):
    kind = F.when(F.col("relation_id") % 3 == 0, "faces").when(F.col("relation_id") % 3 == 1, "beside").otherwise("under")
    rows = fx(spark, sf_dir, "fx_local_relations").select((F.col("subject") % 300).alias("subject_id"), kind.alias("predicate"), F.col("object").alias("object_id"), "confidence", F.col("relation_id").alias("ordinal"))
    return fu.drop_conflicting(rows)


IOU = """(GREATEST(0e0, LEAST({a}.x1,{b}.x1)-GREATEST({a}.x0,{b}.x0))*GREATEST(0e0, LEAST({a}.y1,{b}.y1)-GREATEST({a}.y0,{b}.y0)))"""


@query("overlap_suppression", "WN-03", oracle=f"""
WITH RECURSIVE d AS (SELECT image_id, category, bx0, by0, bx1, by1, MAX(confidence) AS confidence, ARG_MIN(local_id, -confidence*1000000000e0 + local_id*0.001e0) AS box_id FROM fx_observed GROUP BY ALL),
o AS (SELECT image_id, category, box_id, confidence, {{'x0': bx0, 'y0': by0, 'x1': bx1, 'y1': by1}} AS b, ROW_NUMBER() OVER (PARTITION BY image_id, category ORDER BY confidence DESC, box_id) AS rn FROM d),
s(image_id, category, rn, kept, ids) AS (SELECT image_id, category, 1, [b], [box_id] FROM o WHERE rn = 1 UNION ALL
 SELECT o.image_id, o.category, s.rn + 1, CASE WHEN hit THEN kept ELSE LIST_APPEND(kept, b) END, CASE WHEN hit THEN ids ELSE LIST_APPEND(ids, box_id) END FROM (
   SELECT s.*, o.b, o.box_id, LEN(LIST_FILTER(s.kept, LAMBDA k: {IOU.format(a='k', b='o.b')}/((k.x1-k.x0)*(k.y1-k.y0)+(o.b.x1-o.b.x0)*(o.b.y1-o.b.y0)-{IOU.format(a='k', b='o.b')}) >= 0.45e0)) > 0 AS hit FROM s JOIN o ON o.image_id = s.image_id AND o.category = s.category AND o.rn = s.rn + 1) s JOIN (SELECT DISTINCT image_id, category FROM o) o USING (image_id, category))
SELECT image_id, category, box_id FROM (SELECT image_id, category, UNNEST(ids) AS box_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, category ORDER BY rn DESC) AS z FROM s) WHERE z = 1)""")
def overlap_suppression(spark, sf_dir):
    rows = fx(spark, sf_dir, "fx_observed").withColumnRenamed("local_id", "box_id")
    return fu.suppress_overlaps(rows.select("image_id", "category", "box_id", "bx0", "by0", "bx1", "by1", "confidence"), ["image_id", "category"]).select("image_id", "category", "box_id")


@query("instance_numbers", "WN-02", oracle="SELECT local_id, ROW_NUMBER() OVER (PARTITION BY room_id, category ORDER BY confidence DESC, local_id) AS instance FROM fx_observed")
def instance_numbers(spark, sf_dir):
    return fu.number_instances(fx(spark, sf_dir, "fx_observed"), ["room_id", "category"], [F.desc("confidence"), F.asc("local_id")]).select("local_id", "instance")


@query("box_measures", "STR-18", oracle="""
SELECT local_id, RND(bx1-bx0,6) AS box_width, RND((bx1-bx0)*(by1-by0),6) AS box_area, RND((bx1-bx0)/(by1-by0),6) AS box_aspect, RND(GREATEST(0e0,LEAST(bx1,0.5e0)-GREATEST(bx0,0.1e0))*GREATEST(0e0,LEAST(by1,0.4e0)-GREATEST(by0,0.05e0))/((bx1-bx0)*(by1-by0)+0.4e0*0.35e0-GREATEST(0e0,LEAST(bx1,0.5e0)-GREATEST(bx0,0.1e0))*GREATEST(0e0,LEAST(by1,0.4e0)-GREATEST(by0,0.05e0))),6) AS iou,
 RND(0.25e0+bx0*0.5e0,6) AS gx0 FROM fx_observed""")
def box_measures(spark, sf_dir):
    rows = boxes.box_measures(fx(spark, sf_dir, "fx_observed"))
    own = [F.col(c) for c in ("bx0", "by0", "bx1", "by1")]
    tile = boxes.tile_to_image(own, [F.lit(v) for v in (0.25, 0.0, 0.75, 0.5)])
    found = rows.select("local_id", "box_width", "box_area", "box_aspect", boxes.iou(own, [F.lit(v) for v in (0.1, 0.05, 0.5, 0.4)]).alias("iou"), tile[0].alias("gx0"))
    return rounded(found, 6, "box_width", "box_area", "box_aspect", "iou", "gx0")


@query("tile_plan", "SRC-15", oracle="""
WITH i AS (SELECT p_partkey AS image_id, CAST(600 + p_partkey % 2500 AS DOUBLE) AS w, CAST(600 + p_size*45 AS DOUBLE) AS h, CASE p_partkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'layout' WHEN 2 THEN 'geometry' ELSE 'skip' END AS mode FROM part),
g AS (SELECT a.c, b.c AS r FROM (SELECT UNNEST(RANGE(1,5)) AS c) a CROSS JOIN (SELECT UNNEST(RANGE(1,5)) AS c) b WHERE a.c*b.c > 1 AND a.c*b.c <= 9),
k AS (SELECT image_id, c, r, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY ROUND(-ABS(LN((w/c)/(h/r)))+0.06e0*c*r,12) DESC, c, r) AS rn FROM i CROSS JOIN g WHERE (mode = 'layout' AND GREATEST(w,h) >= 1100) OR (mode = 'full' AND GREATEST(w,h) >= 1760))
SELECT image_id, COUNT(*) AS tiles, RND(SUM(GREATEST(0e0, CAST(tc AS DOUBLE)/c-0.18e0/c)),6) AS sx0, RND(SUM(LEAST(1e0, (tr+1e0)/r+0.18e0/r)),6) AS sy1 FROM k CROSS JOIN (SELECT UNNEST(RANGE(0,4)) AS tc) x CROSS JOIN (SELECT UNNEST(RANGE(0,4)) AS tr) y WHERE rn = 1 AND tc < c AND tr < r GROUP BY image_id""")
def tile_plan(spark, sf_dir):
    mode = F.element_at(F.array(*[F.lit(m) for m in ("full", "layout", "geometry", "skip")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    images = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("image_id"), (600 + F.col("p_partkey") % 2500).cast("double").alias("width"), (600 + F.col("p_size") * 45).cast("double").alias("height"), mode.alias("mode"))
    return rounded(boxes.plan_tiles(images).groupBy("image_id").agg(F.count("*").alias("tiles"), F.sum("x0").alias("sx0"), F.sum("y1").alias("sy1")), 6, "sx0", "sy1")


@query("analysis_modes", "PRJ-14", oracle="""
WITH p AS (SELECT DISTINCT image_id, CASE image_id % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'layout' WHEN 2 THEN 'geometry' ELSE 'skip' END AS mode FROM fx_observed)
SELECT mode, COUNT(*) AS finishes, RND(SUM(CASE WHEN mode = 'layout' THEN ROUND(confidence*0.5e0,4) ELSE confidence END),4) AS confidence FROM fx_observed JOIN p USING (image_id) WHERE mode IN ('full','layout') GROUP BY mode""")
def analysis_modes(spark, sf_dir):
    rows = fx(spark, sf_dir, "fx_observed")
    mode = F.element_at(F.array(*[F.lit(m) for m in ("full", "layout", "geometry", "skip")]), (F.col("image_id") % 4 + 1).cast("int"))
    profiles = rows.select("image_id").distinct().withColumn("mode", mode)
    kept, _ = fu.enforce_mode(rows, "finishes", profiles)
    return rounded(kept.join(profiles, "image_id").groupBy("mode").agg(F.count("*").alias("finishes"), F.sum("confidence").alias("confidence")), 4, "confidence")
