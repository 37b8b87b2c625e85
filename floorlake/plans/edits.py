"""Edit, constraint and action-synthesis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import FX, fx
from ..operators import edits as ed
from ..operators import synthesis as sy
from ..session import cut_lineage
from .evaluation import rounded
from .registry import query
from .rooms import ASSETS, RGB, hex_sql, matched
from .pixels import LIN, SRGB
from .spatial import corners_sql, near_sql, overlap_sql, placed, regions

FX["fx_edits"] = """
SELECT building_id, CASE object_id % 6 WHEN 0 THEN 'remove_objects' WHEN 1 THEN 'keep_objects' WHEN 2 THEN 'object_overrides' WHEN 3 THEN 'light_overrides' WHEN 4 THEN 'room_types' ELSE 'paint_everything' END AS op,
 CAST(CASE object_id % 6 WHEN 3 THEN room_id + n * (1 + object_id % 3) + CASE WHEN object_id % 7 = 0 THEN 10000000 ELSE 0 END WHEN 4 THEN room_id + CASE WHEN object_id % 7 = 0 THEN 100000 ELSE 0 END ELSE object_id + CASE WHEN object_id % 7 = 0 THEN 10000000 ELSE 0 END END AS VARCHAR(20)) AS target_id,
 CASE object_id % 6 WHEN 2 THEN CASE object_id % 4 WHEN 0 THEN 'material' WHEN 2 THEN 'color_hex' ELSE 'mood' END WHEN 3 THEN CASE object_id % 2 WHEN 0 THEN 'kind' ELSE 'power_w' END ELSE '' END AS key,
 CASE object_id % 6 WHEN 2 THEN CASE object_id % 8 WHEN 0 THEN 'walnut' WHEN 4 THEN 'stardust' WHEN 2 THEN 'ff8800' ELSE 'red' END WHEN 3 THEN CASE object_id % 4 WHEN 0 THEN 'sconce' WHEN 2 THEN 'candle' WHEN 1 THEN '9000' ELSE 'bright' END WHEN 4 THEN CASE object_id % 5 WHEN 0 THEN 'Dining Room' WHEN 1 THEN 'attic' ELSE 'office' END ELSE '' END AS value, object_id AS ordinal
FROM fx_placed CROSS JOIN (SELECT COUNT(*) AS n FROM supplier) c WHERE object_id % 11 = 0"""


def edits(spark, sf_dir):
    return fx(spark, sf_dir, "fx_edits")


@query("edit_rejections", "ED-02", "ED-07", oracle="""
SELECT building_id, op, target_id, key, 'unknown id' AS reason FROM fx_edits e WHERE op IN ('remove_objects','keep_objects','object_overrides') AND NOT EXISTS (SELECT 1 FROM fx_placed p WHERE p.building_id = e.building_id AND CAST(p.object_id AS VARCHAR) = e.target_id)
UNION ALL SELECT building_id, op, target_id, key, 'unknown id' FROM fx_edits e WHERE op = 'light_overrides' AND NOT EXISTS (SELECT 1 FROM fx_lights p WHERE p.building_id = e.building_id AND CAST(p.light_id AS VARCHAR) = e.target_id)
UNION ALL SELECT building_id, op, target_id, key, 'unknown id' FROM fx_edits e WHERE op = 'room_types' AND NOT EXISTS (SELECT 1 FROM fx_rooms p WHERE p.building_id = e.building_id AND CAST(p.room_id AS VARCHAR) = e.target_id)
UNION ALL SELECT building_id, op, target_id, key, 'unrecognised edit key' FROM fx_edits WHERE op = 'paint_everything'
UNION ALL SELECT building_id, op, target_id, key, 'unrecognised key' FROM fx_edits WHERE op = 'object_overrides' AND key = 'mood'""")
def edit_rejections(spark, sf_dir):
    return ed.rejected_targets(edits(spark, sf_dir), fx(spark, sf_dir, "fx_placed"), fx(spark, sf_dir, "fx_lights"), fx(spark, sf_dir, "fx_rooms")).drop("value")


@query("edited_objects", "ED-02", oracle="""
WITH RECURSIVE e AS (SELECT building_id, TRY_CAST(target_id AS BIGINT) AS object_id, op FROM fx_edits),
gone(building_id, object_id) AS (SELECT p.building_id, p.object_id FROM fx_placed p JOIN e ON e.building_id = p.building_id AND e.object_id = p.object_id AND op = 'remove_objects'
 UNION SELECT p.building_id, p.object_id FROM fx_placed p JOIN gone ON p.building_id = gone.building_id AND p.support_id = gone.object_id)
SELECT object_id, uncertain AND NOT EXISTS (SELECT 1 FROM e WHERE e.building_id = p.building_id AND e.object_id = p.object_id AND op = 'keep_objects') AS uncertain
FROM fx_placed p WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.building_id = p.building_id AND gone.object_id = p.object_id)""")
def edited_objects(spark, sf_dir):
    changes = edits(spark, sf_dir)
    return ed.keep_uncertain(ed.remove_objects(placed(spark, sf_dir), changes), changes).select("object_id", "uncertain")


@query("appearance_overrides", "ED-03", oracle="""
WITH o AS (SELECT building_id, target_id, MAX_BY(value, ordinal) FILTER (key = 'material') AS m, MAX_BY(value, ordinal) FILTER (key = 'color_hex') AS h FROM fx_edits WHERE op = 'object_overrides' GROUP BY building_id, target_id)
SELECT object_id, CASE WHEN m = 'walnut' THEN 'walnut' ELSE material END AS material, CASE WHEN h = 'ff8800' THEN '#FF8800' ELSE color_hex END AS color_hex FROM fx_coloured c LEFT JOIN o ON o.building_id = c.building_id AND target_id = CAST(object_id AS VARCHAR)""")
def appearance_overrides(spark, sf_dir):
    objects = fx(spark, sf_dir, "fx_coloured").withColumns({"asset": F.lit(""), "asset_score": F.lit(0.5)})
    return ed.override_appearance(objects, edits(spark, sf_dir))[0].select("object_id", "material", "color_hex")


@query("light_overrides", "ED-03", oracle="""
WITH o AS (SELECT building_id, target_id, MAX_BY(value, ordinal) FILTER (key = 'kind') AS k, MAX_BY(value, ordinal) FILTER (key = 'power_w') AS p FROM fx_edits WHERE op = 'light_overrides' GROUP BY building_id, target_id)
SELECT light_id, CASE WHEN k = 'sconce' THEN 'wall_light' ELSE kind END AS kind, CASE WHEN p = '9000' THEN 5000e0 ELSE power_w END AS power_w, uncertain AND NOT COALESCE(k = 'sconce' OR p = '9000', FALSE) AS uncertain FROM fx_lights l LEFT JOIN o ON o.building_id = l.building_id AND target_id = CAST(light_id AS VARCHAR)""")
def light_overrides(spark, sf_dir):
    return ed.override_lights(fx(spark, sf_dir, "fx_lights"), edits(spark, sf_dir))[0].select("light_id", "kind", "power_w", "uncertain")


@query("room_type_overrides", "ED-02", oracle="""
WITH o AS (SELECT building_id, target_id, MAX_BY(REPLACE(LOWER(TRIM(value)), ' ', '_'), ordinal) AS t FROM fx_edits WHERE op = 'room_types' GROUP BY building_id, target_id) SELECT room_id, CASE WHEN t IN ('dining_room','office') THEN t ELSE room_type END AS room_type FROM fx_rooms r LEFT JOIN o ON o.building_id = r.building_id AND target_id = CAST(room_id AS VARCHAR)""")
def room_type_overrides(spark, sf_dir):
    return ed.override_room_types(fx(spark, sf_dir, "fx_rooms"), edits(spark, sf_dir))[0].select("room_id", "room_type")


@query("finish_overrides", "ED-03", oracle="""
SELECT room_id, CASE WHEN room_id % 3 = 0 THEN 'teak' ELSE 'wood' END AS material, CASE room_id % 3 WHEN 0 THEN 0.4e0 ELSE 0.9e0 END AS roughness, CASE WHEN room_id % 3 = 0 THEN 1e0 ELSE 0.5e0 END AS confidence FROM fx_rooms""")
def finish_overrides(spark, sf_dir):
    finishes = fx(spark, sf_dir, "fx_rooms").select("building_id", "room_id", F.lit("floor").alias("surface"), F.lit("wood").alias("material"), F.lit("#C08E5C").alias("color_hex"), F.lit(0.9).alias("roughness"), F.lit(0.5).alias("confidence"))
    asked = fx(spark, sf_dir, "fx_rooms").filter("room_id % 3 < 2").select("building_id", F.lit("room_finishes").alias("op"), F.col("room_id").cast("string").alias("target_id"), F.lit("floor.material").alias("key"), F.when(F.col("room_id") % 3 == 0, "Teak").otherwise("moon dust").alias("value"), F.lit(1).alias("ordinal"))
    return ed.override_finishes(finishes, asked)[0].select("room_id", "material", "roughness", "confidence")


PATCH = "pt AS (SELECT building_id, object_id, CASE WHEN object_id % 3 = 0 THEN x + 1.5e0 END AS nx, CASE WHEN object_id % 3 = 1 THEN 0.01e0 WHEN object_id % 3 = 2 THEN 4e0 END AS nw, object_id % 2 = 0 AS free_it FROM fx_restarted WHERE object_id % 13 = 0)"


@query("transform_overrides", "ED-04", oracle=f"""
WITH {PATCH}, f AS (SELECT p.building_id, p.room_id, p.object_id, support, locked, free_it, COALESCE(nx, x) AS x, y, COALESCE(nw, width) AS width, depth, height, rotation_deg, x0, y0, x1, y1, area FROM fx_restarted p JOIN pt USING (building_id, object_id) JOIN fx_rooms r ON r.building_id = p.building_id AND r.room_id = p.room_id),
v AS (SELECT *, CASE WHEN locked AND NOT free_it THEN 'locked' WHEN LEAST(width,depth,height) < 0.05e0 OR GREATEST(width,depth,height) > 20 THEN 'size outside 0.05..20 m' WHEN support = 'floor' AND NOT (x >= x0 AND x < x1 AND y >= y0 AND y < y1) THEN 'outside the room' WHEN support = 'floor' AND ROUND(width*depth-0.55e0*area,9) > 0 THEN 'too large for the room' ELSE 'applied' END AS verdict, {corners_sql('')} AS c FROM f),
o AS (SELECT *, {corners_sql('')} AS c FROM fx_restarted WHERE width > 0 AND depth > 0 AND height > 0),
n AS (SELECT a.building_id, a.object_id, COUNT(*) AS hits FROM v a JOIN o b ON a.verdict = 'applied' AND a.building_id = b.building_id AND a.room_id = b.room_id AND a.object_id <> b.object_id AND {near_sql('a.', 'b.')} WHERE {overlap_sql('a.c', 'b.c', 'a.rotation_deg', 'b.rotation_deg')} > 0.02e0 GROUP BY a.building_id, a.object_id)
SELECT building_id, object_id, verdict, COALESCE(hits, 0) AS hits FROM v LEFT JOIN n USING (building_id, object_id)""")
def transform_overrides(spark, sf_dir):
    empty = F.lit(None).cast("double")
    objects = cut_lineage(fx(spark, sf_dir, "fx_restarted"))
    patches = objects.filter("object_id % 13 = 0").select(
        "building_id", "object_id", F.when(F.col("object_id") % 3 == 0, F.col("x") + 1.5).alias("new_x"), empty.alias("new_y"), empty.alias("new_rotation"),
        F.when(F.col("object_id") % 3 == 1, 0.01).when(F.col("object_id") % 3 == 2, 4.0).alias("new_width"), empty.alias("new_depth"), empty.alias("new_height"), (F.col("object_id") % 2 == 0).alias("unlock"))
    return ed.override_transforms(objects, patches, regions(spark, sf_dir)).select("building_id", "object_id", "verdict", F.col("overlaps").alias("hits"))


@query("new_object_ids", "ED-05", oracle="""
WITH rq AS (SELECT building_id, object_id AS request_id, category FROM fx_placed WHERE object_id % 50 = 7), tk AS (SELECT building_id, category, object_id % 7 + 1 AS n FROM fx_placed WHERE object_id % 100 = 7 GROUP BY ALL),
fr AS (SELECT q.building_id, q.category, i AS n, ROW_NUMBER() OVER (PARTITION BY q.building_id, q.category ORDER BY i) AS k FROM (SELECT DISTINCT building_id, category FROM rq) q CROSS JOIN (SELECT UNNEST(RANGE(1, 3000)) AS i) s WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.building_id = q.building_id AND tk.category = q.category AND tk.n = i)),
ak AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY building_id, category ORDER BY request_id) AS k FROM rq)
SELECT request_id, CONCAT(ak.category, '_user_', CAST(n AS VARCHAR)) AS object_key FROM ak JOIN fr ON fr.building_id = ak.building_id AND fr.category = ak.category AND fr.k = ak.k""")
def new_object_ids(spark, sf_dir):
    objects = fx(spark, sf_dir, "fx_placed")
    asked = objects.filter("object_id % 50 = 7").select("building_id", F.col("object_id").alias("request_id"), "category")
    taken = objects.filter("object_id % 100 = 7").select("building_id", F.concat("category", F.lit("_user_"), (F.col("object_id") % 7 + 1).cast("string")).alias("object_key"))
    return ed.new_ids(asked, taken).select("request_id", "object_key")


@query("action_application", "ED-06", oracle="""
WITH a AS (SELECT object_id, 0.25e0 AS dx, CASE WHEN object_id % 2 = 0 THEN 30e0 END AS rz FROM fx_placed WHERE object_id % 9 = 0)
SELECT p.object_id, 'x' AS field FROM fx_placed p JOIN a USING (object_id) WHERE NOT locked UNION ALL SELECT p.object_id, 'rotation_deg' FROM fx_placed p JOIN a USING (object_id) WHERE NOT locked AND rz IS NOT NULL""")
def action_application(spark, sf_dir):
    objects = fx(spark, sf_dir, "fx_placed")
    none = F.lit(None).cast("double")
    actions = objects.filter("object_id % 9 = 0").select(
        "object_id", F.lit(0.25).alias("dx"), none.alias("dy"), F.when(F.col("object_id") % 2 == 0, 30.0).alias("rotation_z"), none.alias("set_width"), none.alias("set_depth"), none.alias("set_height"), F.lit(None).cast("boolean").alias("admit"))
    return ed.apply_actions(objects, actions)[1].select("object_id", "field")


@query("buildable_objects", "PRJ-13", oracle="SELECT object_id FROM fx_placed WHERE NOT uncertain AND width > 0 AND depth > 0 AND height > 0")
def buildable_objects(spark, sf_dir):
    return ed.buildable(fx(spark, sf_dir, "fx_placed")).select("object_id")


@query("action_violations", "VL-07", oracle="""
WITH a AS (SELECT building_id, object_id AS action_id, CASE object_id % 3 WHEN 0 THEN 'material_adjustment' WHEN 1 THEN 'style_refinement' ELSE 'asset_replacement' END AS t, CASE WHEN object_id % 10 = 0 THEN 'wall:7' ELSE 'object:1' END AS target, CASE object_id % 3 WHEN 0 THEN CASE WHEN object_id % 2 = 0 THEN 'teak' ELSE 'moonstone' END END AS species, CASE object_id % 3 WHEN 1 THEN CASE WHEN object_id % 2 = 0 THEN 'modern' ELSE 'cubist' END END AS style, CASE object_id % 3 WHEN 2 THEN 'sofa_deep_lounge' END AS asset,
  object_id + CASE WHEN object_id % 8 = 0 THEN 10000000 ELSE 0 END AS oid, room_id + CASE WHEN object_id % 5 = 0 THEN 100000 ELSE 0 END AS rid FROM fx_placed)
SELECT building_id, action_id, 'immutable_target' AS rule, target AS subject FROM a WHERE target LIKE 'wall:%' UNION ALL SELECT building_id, action_id, 'unknown_object', CAST(oid AS VARCHAR) FROM a WHERE oid >= 10000000
UNION ALL SELECT a.building_id, action_id, 'locked_object', CAST(oid AS VARCHAR) FROM a JOIN fx_placed p ON p.object_id = oid AND p.locked UNION ALL SELECT building_id, action_id, 'unknown_room', CAST(rid AS VARCHAR) FROM a WHERE rid >= 100000
UNION ALL SELECT building_id, action_id, 'material_taxonomy', species FROM a WHERE species = 'moonstone' UNION ALL SELECT building_id, action_id, 'style_taxonomy', style FROM a WHERE style = 'cubist'
UNION ALL SELECT a.building_id, action_id, 'asset_category', asset FROM a JOIN fx_placed p ON p.object_id = oid WHERE asset IS NOT NULL AND p.category <> 'sofa'""")
def action_violations(spark, sf_dir):
    k = F.col("object_id")
    base = fx(spark, sf_dir, "fx_placed").select(
        "building_id", k.alias("action_id"), F.when(k % 3 == 0, "material_adjustment").when(k % 3 == 1, "style_refinement").otherwise("asset_replacement").alias("action_type"),
        F.when(k % 10 == 0, "wall:7").otherwise("object:1").alias("target"), F.when(k % 3 == 0, F.when(k % 2 == 0, "teak").otherwise("moonstone")).alias("species"),
        F.when(k % 3 == 1, F.when(k % 2 == 0, "modern").otherwise("cubist")).alias("style"), F.when(k % 3 == 2, "sofa_deep_lounge").alias("asset"),
        (k + F.when(k % 8 == 0, 10000000).otherwise(0)).alias("object_id"), (F.col("room_id") + F.when(k % 5 == 0, 100000).otherwise(0)).alias("room_id"))
    return ed.action_violations(base.drop("object_id", "room_id"), base.select("building_id", "action_id", "object_id"), base.select("building_id", "action_id", "room_id"), fx(spark, sf_dir, "fx_placed"), fx(spark, sf_dir, "fx_rooms"))


@query("graph_violations", "VL-08", oracle="""
WITH o AS (SELECT *, CASE WHEN object_id % 23 = 0 THEN 'moonstone' ELSE material END AS mt FROM fx_placed)
SELECT building_id, 'material_taxonomy' AS rule, object_id AS subject FROM o WHERE mt = 'moonstone' UNION ALL SELECT building_id, 'style_taxonomy', room_id FROM fx_rooms WHERE room_id % 9 = 4
UNION ALL SELECT o.building_id, 'room_containment', object_id FROM o JOIN fx_rooms r ON r.building_id = o.building_id AND r.room_id = o.room_id WHERE ROUND(GREATEST(x0-x, x-x1, y0-y, y-y1),9) > 0.35e0""")
def graph_violations(spark, sf_dir):
    objects = fx(spark, sf_dir, "fx_placed").withColumn("material", F.when(F.col("object_id") % 23 == 0, "moonstone").otherwise(F.col("material")))
    rooms = fx(spark, sf_dir, "fx_rooms").withColumn("style", F.when(F.col("room_id") % 9 == 4, "cubist").otherwise(F.col("style")))
    return ed.graph_violations(objects, rooms)


@query("immutability_proof", "VL-09", oracle="SELECT DISTINCT building_id, 'openings' AS collection FROM fx_openings WHERE opening_id = 77 UNION ALL SELECT DISTINCT building_id, 'locked_objects' FROM fx_placed WHERE locked AND object_id % 87 = 0")
def immutability_proof(spark, sf_dir):
    walls, holes, locked = fx(spark, sf_dir, "fx_walls"), fx(spark, sf_dir, "fx_openings"), fx(spark, sf_dir, "fx_placed").filter("locked")
    snap = lambda w, o, k: ed.immutable_snapshot({"walls": (w, ["wall_id", "sx", "sy", "ex", "ey"]), "openings": (o, ["opening_id", "x", "width"]), "locked_objects": (k, ["object_id", "x", "y"])})
    moved = holes.withColumn("x", F.when(F.col("opening_id") == 77, F.col("x") + 0.1).otherwise(F.col("x")))
    shifted = locked.withColumn("y", F.when(F.col("object_id") % 87 == 0, F.col("y") + 0.1).otherwise(F.col("y")))
    return ed.immutables_changed(snap(walls, holes, locked), snap(walls.orderBy(F.rand(1)), moved, shifted))


# -- synthesis ---------------------------------------------------------------------

LF = """lf AS (SELECT building_id, room_id, object_id AS finding_id, CASE object_id % 3 WHEN 0 THEN 'exposure' WHEN 1 THEN 'warmth' ELSE 'contrast' END AS code, CAST(object_id % 37 AS DOUBLE)/50e0 + 0.02e0 AS reference, CAST(object_id % 29 AS DOUBLE)/40e0 AS render FROM fx_placed),
f1 AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY building_id, room_id, code ORDER BY finding_id) AS rn FROM lf) WHERE rn = 1)"""


@query("lighting_actions", "PN-03", oracle=f"""
WITH {LF}, w AS (SELECT building_id, room_id, MAX(reference) FILTER (code = 'exposure') AS er, MAX(render) FILTER (code = 'exposure') AS en, MAX(render-reference) FILTER (code = 'warmth') AS wd, MAX(render-reference) FILTER (code = 'contrast') AS cd FROM f1 GROUP BY ALL),
a AS (SELECT *, CASE WHEN en > 1e-4 AND er > 1e-4 THEN GREATEST(0.02e0, LEAST(1e0, 0.4e0*GREATEST(0.4e0, LEAST(2.5e0, EXP(LN(er/en)*0.75e0))))) END AS am, GREATEST(-1500e0, LEAST(1500e0, wd*6000e0*0.75e0)) AS ks, GREATEST(-0.35e0, LEAST(0.35e0, -cd*3e0*0.75e0)) AS ss FROM w),
n AS (SELECT building_id, room_id, CASE WHEN ABS(am-0.4e0) > 0.01e0 THEN am END AS new_ambient, CASE WHEN ABS(ks) >= 50 THEN GREATEST(1800e0, LEAST(8000e0, 3400e0+ks)) END AS new_kelvin, CASE WHEN ABS(ss) >= 0.03e0 THEN GREATEST(0e0, LEAST(1e0, 0.5e0+ss)) END AS new_softness FROM a)
SELECT room_id, RND(ROUND(new_ambient,4),3) AS new_ambient, RND(ROUND(new_kelvin,1),1) AS new_kelvin, RND(ROUND(new_softness,3),2) AS new_softness FROM n WHERE new_ambient IS NOT NULL OR new_kelvin IS NOT NULL OR new_softness IS NOT NULL""")
def lighting_actions(spark, sf_dir):
    k = F.col("object_id")
    found = fx(spark, sf_dir, "fx_placed").select(
        "building_id", "room_id", k.alias("finding_id"), F.when(k % 3 == 0, "exposure").when(k % 3 == 1, "warmth").otherwise("contrast").alias("code"), ((k % 37) / 50 + 0.02).alias("reference"), ((k % 29) / 40).alias("render"))
    rooms = fx(spark, sf_dir, "fx_rooms").select("building_id", "room_id", F.lit(0.4).alias("ambient"), F.lit(3400.0).alias("color_temperature_k"), F.lit(0.5).alias("shadow_softness"))
    made = sy.lighting_actions(found, rooms).select("room_id", "new_ambient", "new_kelvin", "new_softness")
    return rounded(rounded(rounded(made, 3, "new_ambient"), 1, "new_kelvin"), 2, "new_softness")


@query("placement_actions", "PN-04", oracle="""
WITH d AS (SELECT room_id, object_id, (CAST(object_id % 9 AS DOUBLE)-4e0)*0.75e0 AS dx, (CAST(object_id % 5 AS DOUBLE)-2e0)*0.75e0 AS dy FROM fx_placed), e AS (SELECT *, SQRT(dx*dx+dy*dy) AS l FROM d)
SELECT room_id, object_id, RND(dx*CASE WHEN l > 3 THEN 3e0/l ELSE 1e0 END,4) AS dx, RND(dy*CASE WHEN l > 3 THEN 3e0/l ELSE 1e0 END,4) AS dy FROM e WHERE ROUND(l,9) >= 0.02e0""")
def placement_actions(spark, sf_dir):
    objects = fx(spark, sf_dir, "fx_placed")
    k = F.col("object_id")
    found = objects.select("object_id", k.alias("finding_id"), ((k % 9) - 4.0).alias("implied_x"), ((k % 5) - 2.0).alias("implied_y"), F.lit(0.0).alias("actual_x"), F.lit(0.0).alias("actual_y"))
    return rounded(sy.placement_actions(found, objects).select("room_id", "object_id", "dx", "dy"), 4, "dx", "dy")


@query("camera_actions", "PN-04", oracle="""
WITH d AS (SELECT viewpoint_id, -(CAST(viewpoint_id % 13 AS DOUBLE)-6e0)*0.75e0 AS dx, -(CAST(viewpoint_id % 4 AS DOUBLE)-1e0)*0.75e0 AS dy FROM fx_viewpoints), e AS (SELECT *, SQRT(dx*dx+dy*dy) AS l FROM d)
SELECT viewpoint_id, RND(dx*CASE WHEN l > 4 THEN 4e0/l ELSE 1e0 END,4) AS dx, RND(dy*CASE WHEN l > 4 THEN 4e0/l ELSE 1e0 END,4) AS dy FROM e WHERE ROUND(l,9) >= 0.05e0""")
def camera_actions(spark, sf_dir):
    views = fx(spark, sf_dir, "fx_viewpoints")
    v = F.col("viewpoint_id")
    found = views.select("viewpoint_id", F.lit(1).alias("finding_id"), ((v % 13) - 6.0).alias("offset_x"), ((v % 4) - 1.0).alias("offset_y"))
    return rounded(sy.camera_actions(found, views).select("viewpoint_id", "dx", "dy"), 4, "dx", "dy")


@query("rotation_actions", "PN-04", oracle="""
WITH r AS (SELECT s.object_id, s.rotation_deg, s.x, s.y, t.object_id AS toward, t.x AS tx, t.y AS ty FROM fx_placed s CROSS JOIN (SELECT COUNT(*) AS n FROM supplier) c JOIN fx_placed t ON t.object_id = s.object_id + n),
h AS (SELECT *, CASE WHEN ABS(tx-x) < 1e-9 AND ABS(ty-y) < 1e-9 THEN 0e0 ELSE DEGREES(ATAN2(-(tx-x), ty-y)) END AS a FROM r), m AS (SELECT *, a - 360e0*FLOOR(a/360e0) AS heading FROM h), d AS (SELECT *, (heading-rotation_deg+180e0) - 360e0*FLOOR((heading-rotation_deg+180e0)/360e0) - 180e0 AS delta FROM m)
SELECT object_id, toward, RND(heading,2) AS rotation_z, RND(delta,2) AS delta_deg FROM d WHERE ROUND(ABS(delta),9) >= 5""")
def rotation_actions(spark, sf_dir):
    objects = fx(spark, sf_dir, "fx_placed")
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").agg(F.count("*").alias("n"))
    facing = objects.crossJoin(F.broadcast(n)).select(F.col("object_id").alias("subject_id"), F.lit("faces").alias("predicate"), (F.col("object_id") + F.col("n")).alias("object_id"), F.lit(False).alias("satisfied"), F.lit(1).alias("ordinal"))
    return rounded(sy.rotation_actions(objects, facing).select("object_id", "toward", "rotation_z", "delta_deg"), 2, "rotation_z", "delta_deg")


@query("asset_actions", "PN-04", oracle=f"""
WITH {ASSETS}, cur AS (SELECT object_id, category, CASE object_id % 3 WHEN 0 THEN 'sofa_classic_arms' WHEN 1 THEN 'rug_rect' ELSE 'x' END AS previous FROM fx_coloured), j AS (SELECT c.*, m.asset FROM cur c JOIN mt m USING (object_id))
SELECT object_id, 'asset_replacement' AS action_type, asset, previous FROM j WHERE asset NOT LIKE 'generic%' AND asset <> previous
UNION ALL SELECT j.object_id, 'asset_variant_swap', MIN(v.asset), previous FROM j JOIN dim_assets v ON v.category = j.category AND v.asset <> previous WHERE j.asset LIKE 'generic%' OR j.asset = previous GROUP BY j.object_id, previous""")
def asset_actions(spark, sf_dir):
    k = F.col("object_id")
    current = fx(spark, sf_dir, "fx_coloured").select("object_id", "category", F.when(k % 3 == 0, "sofa_classic_arms").when(k % 3 == 1, "rug_rect").otherwise("x").alias("asset"))
    return sy.asset_actions(matched(spark, sf_dir), current).drop("action_id")


@query("scale_actions", "PN-04", oracle=f"""
WITH {ASSETS}, j AS (SELECT o.object_id, width, depth, height, sig_w/sig_h AS gw, sig_d/sig_h AS gd FROM fx_coloured o JOIN mt USING (object_id) JOIN dim_assets v ON v.asset = mt.asset WHERE height > 1e-6)
SELECT object_id, RND(height*(width/height+(gw-width/height)*0.75e0),3) AS width, RND(height*(depth/height+(gd-depth/height)*0.75e0),3) AS depth FROM j WHERE ROUND(GREATEST(ABS(width/height-gw), ABS(depth/height-gd)),9) >= 0.15e0""")
def scale_actions(spark, sf_dir):
    made = sy.scale_actions(fx(spark, sf_dir, "fx_coloured"), matched(spark, sf_dir))
    objects = made.select("object_id", "width", "depth")
    return rounded(objects, 3, "width", "depth")


@query("decor_actions", "PN-04", oracle="SELECT room_id, object_id FROM fx_placed WHERE uncertain AND width > 0 AND depth > 0 AND height > 0")
def decor_actions(spark, sf_dir):
    objects = fx(spark, sf_dir, "fx_placed")
    return sy.decor_actions(objects, objects).select("room_id", "object_id")


BLEND = hex_sql(*[f"255e0*({SRGB.format(f'({LIN.format(f'({a}/255e0)')} + ({LIN.format(f'({b}/255e0)')} - {LIN.format(f'({a}/255e0)')})*0.35e0)')})" for a, b in zip([c.format('old_hex') for c in RGB], [c.format('toward') for c in RGB])])


@query("palette_actions", "PN-04", "STR-12", oracle=f"""
WITH p AS (SELECT room_id, '#3F6B5E' AS toward, 'primary' AS role, COALESCE(wall_hex, '#EFEDE8') AS old_hex FROM fx_finished_rooms UNION ALL SELECT room_id, '#3F6B5E', 'secondary', COALESCE(floor_hex, '#3F6B5E') FROM fx_finished_rooms), b AS (SELECT *, {BLEND} AS new_hex FROM p) SELECT room_id, role, new_hex FROM b WHERE new_hex <> old_hex""")
def palette_actions(spark, sf_dir):
    rooms = fx(spark, sf_dir, "fx_finished_rooms")
    palettes = rooms.select("building_id", "room_id", F.coalesce("wall_hex", F.lit("#EFEDE8")).alias("primary_hex"), F.coalesce("floor_hex", F.lit("#3F6B5E")).alias("secondary_hex"))
    found = rooms.select("building_id", "room_id", F.lit(1).alias("finding_id"), F.lit("#3F6B5E").alias("reference_hex"), F.lit("#000000").alias("render_hex"))
    return sy.palette_actions(found, palettes).select("room_id", "role", "new_hex")


@query("material_actions", "PN-04", oracle="""
WITH f AS (SELECT room_id, CASE object_id % 4 WHEN 0 THEN 'wood' WHEN 1 THEN 'fabric' WHEN 2 THEN 'walnut' ELSE 'glass' END AS material, object_id AS fid, CASE object_id % 2 WHEN 0 THEN 'saturation' ELSE 'texture' END AS code, 0.3e0 + CAST(object_id % 20 AS DOUBLE)/10e0 AS ratio FROM fx_placed),
s AS (SELECT a.material, MIN(b.grain) AS g FROM dim_materials a JOIN dim_materials b ON b.family = a.family AND b.material <> b.family AND b.material <> a.material AND ROUND(b.grain-a.grain,9) > 0.05e0 GROUP BY a.material), sp AS (SELECT s.material, MIN(b.material) AS species FROM s JOIN dim_materials a ON a.material = s.material JOIN dim_materials b ON b.family = a.family AND b.material <> b.family AND b.material <> a.material AND b.grain = s.g GROUP BY s.material),
q AS (SELECT room_id, material, ARG_MIN(ratio, fid) FILTER (code = 'saturation') AS r, BOOL_OR(code = 'texture') AS t FROM f GROUP BY ALL), z AS (SELECT room_id, q.material, CASE WHEN r > 1e-3 AND ABS(1-r) > 0.05e0 THEN GREATEST(0.35e0, LEAST(3e0, EXP(LN(1e0/r)*0.75e0))) END AS sc, CASE WHEN t THEN species END AS species FROM q LEFT JOIN sp ON sp.material = q.material)
SELECT room_id, material, RND(sc,3) AS saturation_scale, species FROM z WHERE sc IS NOT NULL OR species IS NOT NULL""")
def material_actions(spark, sf_dir):
    k = F.col("object_id")
    found = fx(spark, sf_dir, "fx_placed").select(
        "building_id", "room_id", F.when(k % 4 == 0, "wood").when(k % 4 == 1, "fabric").when(k % 4 == 2, "walnut").otherwise("glass").alias("material"), k.alias("finding_id"),
        F.when(k % 2 == 0, "saturation").otherwise("texture").alias("code"), (0.3 + (k % 20) / 10).alias("ratio"), F.lit(None).cast("string").alias("reference_hex"))
    return rounded(sy.material_actions(found).select("room_id", "material", "saturation_scale", "species"), 3, "saturation_scale")


@query("style_actions", "PN-05", oracle="""
WITH s AS (SELECT building_id, style, SUM(GREATEST(area,1e0)*GREATEST(style_confidence,0.2e0)) AS w FROM fx_rooms WHERE style <> 'unknown' GROUP BY ALL), d AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY building_id ORDER BY ROUND(w,9) DESC, style) AS rn, SUM(w) OVER (PARTITION BY building_id) AS t FROM s) WHERE rn = 1),
f AS (SELECT room_id, COUNT(*) AS findings FROM fx_findings WHERE axis IN ('colour','material') GROUP BY room_id)
SELECT r.room_id, d.style, RND(LEAST(0.7e0, ROUND(w/t,3)),3) AS confidence, findings FROM fx_rooms r JOIN f USING (room_id) JOIN d ON d.building_id = r.building_id WHERE r.style = 'unknown'""")
def style_actions(spark, sf_dir):
    rooms = fx(spark, sf_dir, "fx_rooms")
    found = fx(spark, sf_dir, "fx_findings").join(rooms.select("room_id", "building_id"), "room_id")
    return rounded(sy.style_actions(found, rooms).select("room_id", "style", "confidence", "findings"), 3, "confidence")


