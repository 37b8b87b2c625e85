"""Image profile, review and catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import dim
from ..fixtures import fx
from ..operators import placement as pc
from ..operators import review as rv
from .evaluation import rollup, rounded
from .placement import frames
from .registry import query
from .rooms import ASSETS, matched

MEASURE = """
m0 AS (SELECT *, (r+g+b)/3e0 AS y, LEAD((r+g+b)/3e0) OVER (PARTITION BY image_id, pcol ORDER BY prow) AS dn, LEAD((r+g+b)/3e0) OVER (PARTITION BY image_id, prow ORDER BY pcol) AS rt FROM fx_rgb),
m1 AS (SELECT image_id, AVG(CASE WHEN GREATEST(r,g,b) > 1e-6 THEN (GREATEST(r,g,b)-LEAST(r,g,b))/GREATEST(r,g,b) ELSE 0e0 END) AS sat, AVG(CASE WHEN ROUND(COALESCE(ABS(dn-y),0e0)+COALESCE(ABS(rt-y),0e0),9) > 0.18e0 THEN 1e0 ELSE 0e0 END) AS edge, (AVG(ABS(rt-y))+AVG(ABS(dn-y)))/2e0 AS grad, COUNT(DISTINCT FLOOR(r*7)*64+FLOOR(g*7)*8+FLOOR(b*7))/512e0 AS pal FROM m0 GROUP BY image_id),
m2 AS (SELECT image_id, MAX(c)/64e0 AS flat FROM (SELECT image_id, LEAST(FLOOR(y*32),31) AS k, COUNT(*) AS c FROM m0 GROUP BY ALL) GROUP BY image_id)"""


@query("image_measures", "PX-08", oracle=f"WITH {MEASURE} SELECT image_id, RND(sat,6) AS mean_saturation, RND(edge,6) AS edge_density, RND(grad,6) AS mean_gradient, RND(pal,6) AS palette_diversity, RND(flat,6) AS flat_background_share FROM m1 JOIN m2 USING (image_id)")
def image_measures(spark, sf_dir):
    found = rv.measure_images(fx(spark, sf_dir, "fx_rgb"))
    return rounded(found, 6, "mean_saturation", "edge_density", "mean_gradient", "palette_diversity", "flat_background_share")


def profiles(spark, sf_dir):
    base = fx(spark, sf_dir, "fx_rgb").select("image_id").distinct()
    i = F.col("image_id")
    measured = base.select("image_id", ((i % 10) / 40).alias("mean_saturation"), (0.3 + (i % 7) / 20).alias("flat_background_share"), ((i % 9) / 100).alias("edge_density"), ((i % 5) / 12).alias("palette_diversity"))
    names = F.element_at(F.array(*[F.lit(n) for n in ("Interior Photo", "floor-plan", "site plan", "kitchen render view", "mystery", "wireframe")]), (i % 6 + 1).cast("int"))
    answers = base.filter("image_id % 8 <> 0").select("image_id", names.alias("declared"), F.when(i % 6 == 0, "photo").otherwise("").alias("declared_medium"), F.lit(0.8).alias("declared_confidence"))
    return rv.merge_classes(rv.profile_images(measured), answers)


PROFILES = """
b AS (SELECT image_id, CAST(image_id % 10 AS DOUBLE)/40e0 AS sat, 0.3e0+CAST(image_id % 7 AS DOUBLE)/20e0 AS flat, CAST(image_id % 9 AS DOUBLE)/100e0 AS edge, CAST(image_id % 5 AS DOUBLE)/12e0 AS pal FROM (SELECT DISTINCT image_id FROM fx_rgb) q),
l AS (SELECT *, CASE WHEN edge >= 0.02e0 AND flat >= 0.35e0 THEN CASE WHEN sat < 0.14e0 THEN 0.35e0 ELSE 0e0 END + CASE WHEN flat > 0.45e0 THEN 0.3e0 ELSE 0e0 END + CASE WHEN edge > 0.045e0 THEN 0.2e0 ELSE 0e0 END + CASE WHEN pal < 0.22e0 THEN 0.15e0 ELSE 0e0 END ELSE 0e0 END AS s FROM b),
c AS (SELECT image_id, ROUND(s,9) >= 0.7e0 AS art, image_id % 8 <> 0 AS answered, CASE image_id % 6 WHEN 0 THEN 'interior_photograph' WHEN 1 THEN 'furnished_floorplan' WHEN 2 THEN 'site_plan' WHEN 3 THEN 'interior_render' WHEN 4 THEN 'unknown' ELSE 'wireframe' END AS d FROM l),
k AS (SELECT image_id, CASE WHEN art THEN 'cad_drawing' WHEN NOT answered THEN 'unknown' ELSE d END AS image_class, CASE WHEN art THEN 'drawing' WHEN answered AND image_id % 6 = 0 THEN 'photo' ELSE 'render' END AS medium FROM c)"""


@query("image_profiles", "PX-09", oracle=f"WITH {PROFILES} SELECT image_id, image_class, mode, medium, RND(CASE WHEN medium = 'photo' THEN LEAST(0.9e0, trust+0.2e0) ELSE trust END,4) AS geometry_trust FROM k JOIN dim_image_classes USING (image_class)")
def image_profiles(spark, sf_dir):
    return rounded(profiles(spark, sf_dir).select("image_id", "image_class", "mode", "medium", "geometry_trust"), 4, "geometry_trust")


@query("image_set_summary", "AG-29", oracle=f"WITH {PROFILES} SELECT mode, COUNT(*) AS total, COUNT(*) FILTER (image_class IN ('cad_drawing','wireframe','architectural_elevation')) AS geometry_only, COUNT(*) FILTER (medium = 'photo') AS photographs FROM k JOIN dim_image_classes USING (image_class) GROUP BY mode")
def image_set_summary(spark, sf_dir):
    return rv.summarise_images(profiles(spark, sf_dir), ["mode"]).select("mode", "total", "geometry_only", "photographs")


@query("review_rollup", "AG-28", oracle="""
WITH o AS (SELECT room_id, COUNT(*) AS objects, COUNT(*) FILTER (uncertain) AS u, COUNT(*) FILTER (locked) AS k, AVG(confidence) AS c FROM fx_placed GROUP BY 1), l AS (SELECT room_id, COUNT(*) AS lights FROM fx_lights GROUP BY 1), p AS (SELECT room_id, COUNT(*) FILTER (kind = 'door') AS doors FROM fx_openings GROUP BY 1)
SELECT r.room_id, COALESCE(objects,0) AS objects, COALESCE(u,0) AS uncertain_objects, COALESCE(k,0) AS locked_objects, RND(c,6) AS mean_confidence, COALESCE(lights,0) AS lights, COALESCE(doors,0) AS doors FROM fx_rooms r LEFT JOIN o USING (room_id) LEFT JOIN l USING (room_id) LEFT JOIN p USING (room_id)""")
def review_rollup(spark, sf_dir):
    found = rv.review_rollup(*[fx(spark, sf_dir, n) for n in ("fx_rooms", "fx_placed", "fx_lights", "fx_openings")])
    return rounded(found.select("room_id", "objects", "uncertain_objects", "locked_objects", "mean_confidence", "lights", "doors"), 6, "mean_confidence")


@query("trusted_facts", "STR-19", oracle="""
WITH f AS (SELECT room_id, object_id, CASE object_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'cad_text' WHEN 2 THEN 'rumour' ELSE 'reasoning' END AS source FROM fx_placed)
SELECT room_id, object_id, source FROM (SELECT f.*, ROW_NUMBER() OVER (PARTITION BY room_id ORDER BY COALESCE(tier, 99), object_id) AS rn FROM f LEFT JOIN dim_source_tiers USING (source)) WHERE rn = 1""")
def trusted_facts(spark, sf_dir):
    k = F.col("object_id")
    facts = fx(spark, sf_dir, "fx_placed").select("room_id", "object_id", F.when(k % 4 == 0, "image").when(k % 4 == 1, "cad_text").when(k % 4 == 2, "rumour").otherwise("reasoning").alias("source"))
    return rv.most_trusted(facts, ["room_id"], "object_id").select("room_id", "object_id", "source")


@query("room_frames", "PRJ-18", oracle="""
SELECT room_id, COUNT(*) AS walls, COUNT(*) FILTER (room_id % 3 = 0) AS from_bounds, RND(SUM(SQRT(POWER(ex-sx,2)+POWER(ey-sy,2))),6) AS outline FROM fx_walls GROUP BY room_id""")
def room_frames(spark, sf_dir):
    found = rv.room_frames(fx(spark, sf_dir, "fx_rooms"), fx(spark, sf_dir, "fx_walls").filter("room_id % 3 <> 0"))
    sized = found.groupBy("room_id").agg(F.count("*").alias("walls"), F.count_if(F.col("wall_id").isNull()).alias("from_bounds"), F.sum(F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"))).alias("outline"))
    return rounded(sized, 6, "outline")


@query("scene_findings", "PX-15", oracle=f"""
WITH {ASSETS}, p AS (SELECT m.*, ROW_NUMBER() OVER (PARTITION BY m.building_id ORDER BY asset_score, m.object_id) AS rn FROM mt m JOIN fx_placed USING (object_id) WHERE asset_score > 0 AND asset_score < 0.62e0 AND NOT uncertain)
SELECT building_id, 'poor_match' AS kind, CAST(object_id AS VARCHAR) AS subject FROM p UNION ALL SELECT DISTINCT building_id, 'no_model', category FROM mt WHERE asset LIKE 'generic%' UNION ALL SELECT building_id, 'unstyled', CAST(room_id AS VARCHAR) FROM fx_rooms WHERE style = 'unknown' AND room_id % 2 = 1""")
def scene_findings(spark, sf_dir):
    rooms = fx(spark, sf_dir, "fx_rooms").withColumn("pictured", F.col("room_id") % 2 == 1)
    return rv.scene_findings(matched(spark, sf_dir), rooms)


@query("catalog_usage", "SRC-12", oracle="SELECT obj_group, support, COUNT(*) AS objects FROM (SELECT category FROM fx_placed) p JOIN dim_objects d USING (category) GROUP BY ALL")
def catalog_usage(spark, sf_dir):
    return fx(spark, sf_dir, "fx_placed").select("category").join(F.broadcast(dim(spark, "dim_objects")), "category").groupBy("obj_group", "support").agg(F.count("*").alias("objects"))


@query("planned_item_defaults", "PL-12", oracle="""
SELECT room_id, category, RND(LEAST(typical_w, (x1-x0)*0.9e0),5) AS width, RND(LEAST(typical_d, (y1-y0)*0.9e0),5) AS depth, CASE obj_group WHEN 'furniture' THEN '#111111' WHEN 'decor' THEN '#222222' ELSE '#333333' END AS color_hex FROM fx_rooms CROSS JOIN (VALUES ('sofa'), ('rug'), ('toilet')) v(category) JOIN dim_objects USING (category)""")
def planned_item_defaults(spark, sf_dir):
    rooms = frames(spark, sf_dir)
    items = rooms.select("building_id", "room_id", F.explode(F.array(*[F.lit(c) for c in ("sofa", "rug", "toilet")])).alias("category"), F.lit(0).alias("item_index"))
    palettes = rooms.select("building_id", "room_id", F.lit("#111111").alias("furniture_hex"), F.lit("#222222").alias("decor_hex"), F.lit("#333333").alias("primary_hex"))
    return rounded(pc.item_defaults(items, rooms, palettes).select("room_id", "category", "width", "depth", "color_hex"), 5, "width", "depth")


@query("building_documents", "SRC-09")
def building_documents(spark, sf_dir):
    """The building part of the evaluation documents, one JSON object per building."""
    return rollup(spark, sf_dir).select("building_id", F.to_json(F.struct("building_id", F.round("score", 4).alias("score"), F.round("confidence", 4).alias("confidence"), "rooms_total", "rooms_assessed")).alias("document"))
