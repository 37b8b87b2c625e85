"""Spatial joins and plausibility reports over rooms, walls, openings and objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import dim
from ..fixtures import fx
from ..functions import geometry as g
from ..operators import spatial as sp
from ..operators import validation as va
from .evaluation import rounded
from .registry import query

CEILING = 2.7
INSIDE = "(x >= x0 AND x < x1 AND y >= y0 AND y < y1)"
OUTLINE = """ROUND(CASE WHEN x >= x0 AND x <= x1 AND y >= y0 AND y <= y1 THEN LEAST(x-x0, x1-x, y-y0, y1-y)
  ELSE SQRT(POWER(GREATEST(x0-x, 0e0, x-x1),2) + POWER(GREATEST(y0-y, 0e0, y-y1),2)) END, 9)"""


def regions(spark, sf_dir):
    return fx(spark, sf_dir, "fx_rooms").withColumn("polygon", g.box_polygon("x0", "y0", "x1", "y1")).withColumn(
        "ceiling_height", F.lit(CEILING))


def placed(spark, sf_dir):
    return fx(spark, sf_dir, "fx_placed").withColumn(
        "flags", F.when(F.col("by_hand"), F.array(F.lit("position_set_by_user"))).otherwise(F.array().cast("array<string>")))


def openings(spark, sf_dir):
    return fx(spark, sf_dir, "fx_openings").withColumn("room_id", F.coalesce("room_id", F.floor(F.col("wall_id") / 4)))


@query("contained_by", "JN-01", "JN-02", oracle=f"""
WITH c AS (SELECT object_id, r.room_id, area, {INSIDE} AS inside, {OUTLINE} AS d FROM fx_objects o JOIN fx_rooms r USING (building_id)),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY object_id ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN area ELSE d END, room_id) AS rn FROM c WHERE inside OR d <= 0.45e0)
SELECT object_id, room_id, RND(CASE WHEN inside THEN 1e0 ELSE 1e0-0.5e0*d/0.45e0 END,6) AS weight, RND(CASE WHEN inside THEN 0e0 ELSE d END,6) AS distance FROM k WHERE rn = 1""")
def contained_by(spark, sf_dir):
    found = sp.assign_regions(fx(spark, sf_dir, "fx_objects"), "object_id", regions(spark, sf_dir), sp.BLOCK_TOLERANCE)
    return rounded(found.drop("building_id", "inside"), 6, "weight", "distance")


@query("stamped_rooms", "JN-03", oracle=f"""
WITH c AS (SELECT object_id, r.room_id, {INSIDE} AS inside, {OUTLINE} AS d FROM fx_objects o JOIN fx_rooms r USING (building_id) WHERE object_id % 3 <> 0),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY object_id ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN room_id ELSE d END, room_id) AS rn FROM c WHERE inside OR d < 0.3e0),
s AS (SELECT o.object_id, CASE WHEN o.object_id % 3 = 0 THEN hint_room_id ELSE k.room_id END AS room_id FROM fx_objects o LEFT JOIN k ON k.object_id = o.object_id AND rn = 1)
SELECT COALESCE(room_id, -1) AS room_id, COUNT(*) AS objects, COUNT(*) FILTER (room_id IS NULL) AS outside FROM s GROUP BY 1""")
def stamped_rooms(spark, sf_dir):
    objects = fx(spark, sf_dir, "fx_objects").withColumn("room_id", F.when(F.col("object_id") % 3 == 0, F.col("hint_room_id")))
    stamped = sp.stamp_rooms(objects, "object_id", regions(spark, sf_dir), tolerance=0.3)
    return stamped.groupBy(F.coalesce("room_id", F.lit(-1)).alias("room_id")).agg(
        F.count("*").alias("objects"), F.count_if("outside_every_room").alias("outside"))


@query("opening_counts", "JN-06", oracle=f"""
WITH n AS (SELECT r.room_id, COUNT(*) FILTER (kind = 'door') AS doors, COUNT(*) FILTER (kind = 'window') AS windows FROM fx_openings o JOIN fx_rooms r ON r.building_id = o.building_id
  AND (({OUTLINE}) <= 0.6e0 OR {INSIDE}) GROUP BY r.room_id)
SELECT building_id, room_id, COALESCE(doors, 0) AS doors, COALESCE(windows, 0) AS windows FROM fx_rooms LEFT JOIN n USING (room_id)""")
def opening_counts(spark, sf_dir):
    return sp.opening_counts(fx(spark, sf_dir, "fx_openings"), regions(spark, sf_dir))


@query("wall_attachment", "JN-07", oracle=f"""
WITH m AS (SELECT building_id, wall_id, (sx+ex)/2e0 AS x, (sy+ey)/2e0 AS y FROM fx_walls)
SELECT m.building_id, wall_id, r.room_id AS region_id FROM m JOIN fx_rooms r ON r.building_id = m.building_id AND ({OUTLINE}) < 0.45e0""")
def wall_attachment(spark, sf_dir):
    return sp.attach_walls(fx(spark, sf_dir, "fx_walls"), regions(spark, sf_dir))


@query("region_adjacency", "JN-08", oracle=f"""
WITH v AS (SELECT building_id, room_id AS a_id, sx AS x, sy AS y FROM fx_walls),
p AS (SELECT DISTINCT v.building_id, a_id, r.room_id AS b_id FROM v JOIN fx_rooms r ON r.building_id = v.building_id AND a_id < r.room_id AND ({OUTLINE}) <= 2.24e0)
SELECT building_id, a_id AS room_id, b_id AS neighbour_id FROM p UNION ALL SELECT building_id, b_id, a_id FROM p""")
def region_adjacency(spark, sf_dir):
    return sp.region_adjacency(regions(spark, sf_dir))


SEGMENT = """ROUND(SQRT(POWER(x - (sx + t*(ex-sx)),2) + POWER(y - (sy + t*(ey-sy)),2)),9)"""


@query("nearest_wall", "JN-09", oracle=f"""
WITH c AS (SELECT o.opening_id, w.wall_id, o.x, o.y, sx, sy, ex, ey, GREATEST(0e0, LEAST(1e0, ((o.x-sx)*(ex-sx)+(o.y-sy)*(ey-sy))/((ex-sx)*(ex-sx)+(ey-sy)*(ey-sy)))) AS t FROM fx_openings o JOIN fx_walls w ON w.building_id = o.building_id),
k AS (SELECT opening_id, wall_id, {SEGMENT} AS d FROM c)
SELECT opening_id, ARG_MIN(wall_id, d*1000000000e0 + wall_id*0.0001e0) AS wall_id, RND(MIN(d),6) AS distance FROM k GROUP BY opening_id""")
def nearest_wall(spark, sf_dir):
    return rounded(sp.nearest_segment(fx(spark, sf_dir, "fx_openings"), "opening_id", fx(spark, sf_dir, "fx_walls"), "wall_id").drop("building_id"), 6, "distance")


@query("superseded_openings", "JN-10", "ED-01", oracle="""
WITH d AS (SELECT * FROM fx_openings WHERE source = 'dxf'), i AS (SELECT * FROM fx_openings WHERE source = 'image')
SELECT opening_id, source FROM d UNION ALL SELECT opening_id, source FROM i WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.building_id = i.building_id AND ROUND(SQRT(POWER(d.x-i.x,2)+POWER(d.y-i.y,2)),9) <= 0.5e0)""")
def superseded_openings(spark, sf_dir):
    found = fx(spark, sf_dir, "fx_openings")
    return sp.supersede(found.filter("source = 'dxf'"), found.filter("source = 'image'"), "opening_id").select("opening_id", "source")


def corners_sql(p: str) -> str:
    t = f"RADIANS({p}rotation_deg)"
    one = lambda sx, sy: (
        f"{{'x': {p}x + {sx}*{p}width*COS({t}) - {sy}*{p}depth*SIN({t}), 'y': {p}y + {sx}*{p}width*SIN({t}) + {sy}*{p}depth*COS({t})}}")
    return "[" + ", ".join(one(sx, sy) for sx, sy in (("-0.5e0", "-0.5e0"), ("0.5e0", "-0.5e0"), ("0.5e0", "0.5e0"), ("-0.5e0", "0.5e0"))) + "]"


def overlap_sql(a: str, b: str, ra: str, rb: str) -> str:
    """Smallest projection overlap over both rectangles' axes, from their corners."""
    axes = f"[{{'x': COS(RADIANS({ra})), 'y': SIN(RADIANS({ra}))}}, {{'x': -SIN(RADIANS({ra})), 'y': COS(RADIANS({ra}))}}, {{'x': COS(RADIANS({rb})), 'y': SIN(RADIANS({rb}))}}, {{'x': -SIN(RADIANS({rb})), 'y': COS(RADIANS({rb}))}}]"
    proj = lambda c, f: f"LIST_{f}(LIST_TRANSFORM({c}, LAMBDA p: p.x*u.x + p.y*u.y))"
    return f"ROUND(GREATEST(0e0, LIST_MIN(LIST_TRANSFORM({axes}, LAMBDA u: LEAST({proj(a, 'MAX')}, {proj(b, 'MAX')}) - GREATEST({proj(a, 'MIN')}, {proj(b, 'MIN')})))),9)"


def near_sql(a: str, b: str, grow: str = "0e0") -> str:
    reach = lambda p: f"SQRT({p}width*{p}width+{p}depth*{p}depth)/2e0"
    return f"SQRT(POWER({a}x-{b}x,2)+POWER({a}y-{b}y,2)) <= {reach(a)} + {reach(b)} + {grow} + 1e-6"


FOOTPRINTS = f"f AS (SELECT *, width > 0 AND depth > 0 AND height > 0 AS solid, {corners_sql('')} AS c FROM fx_placed)"
UNSTACKED = "COALESCE(a.support_id = b.object_id, FALSE) = FALSE AND COALESCE(b.support_id = a.object_id, FALSE) = FALSE"


@query("footprint_collisions", "JN-11", oracle=f"""
WITH {FOOTPRINTS}, p AS (SELECT a.building_id, a.room_id, a.object_id AS a_object_id, b.object_id AS b_object_id, {overlap_sql('a.c', 'b.c', 'a.rotation_deg', 'b.rotation_deg')} AS penetration
 FROM f a JOIN f b ON a.building_id = b.building_id AND a.room_id = b.room_id AND a.object_id < b.object_id AND a.solid AND b.solid AND a.support <> 'wall' AND b.support <> 'wall' AND {UNSTACKED}
  AND ROUND(LEAST(a.z+a.height, b.z+b.height) - GREATEST(a.z, b.z), 9) > 0.02e0 AND {near_sql('a.', 'b.')})
SELECT building_id, room_id, a_object_id, b_object_id, RND(penetration,6) AS penetration FROM p WHERE penetration > 0.02e0""")
def footprint_collisions(spark, sf_dir):
    return rounded(va.collisions(placed(spark, sf_dir)), 6, "penetration")


@query("user_placement_conflicts", "JN-12", oracle=f"""
WITH {FOOTPRINTS}, p AS (SELECT a.building_id, a.room_id, LEAST(a.object_id, b.object_id) AS first_id, GREATEST(a.object_id, b.object_id) AS second_id, MAX({overlap_sql('a.c', 'b.c', 'a.rotation_deg', 'b.rotation_deg')}) AS penetration
 FROM f a JOIN f b ON a.building_id = b.building_id AND a.room_id = b.room_id AND a.object_id <> b.object_id AND a.by_hand AND b.solid AND {UNSTACKED}
  AND NOT (a.z+a.height <= b.z OR b.z+b.height <= a.z) AND {near_sql('a.', 'b.')} GROUP BY ALL),
k AS (SELECT * FROM p WHERE penetration > 0.02e0)
SELECT building_id, room_id, first_id, second_id, RND(penetration,6) AS penetration FROM k""")
def user_placement_conflicts(spark, sf_dir):
    return rounded(va.user_conflicts(placed(spark, sf_dir)), 6, "penetration")


EDGE_GAP = """LIST_MIN(LIST_TRANSFORM({c}, LAMBDA p: LIST_MIN(LIST_TRANSFORM(RANGE(1, 5), LAMBDA i:
  SQRT(POWER(p.x - ({e}[i].x + GREATEST(0e0, LEAST(1e0, ((p.x-{e}[i].x)*({e}[i%4+1].x-{e}[i].x) + (p.y-{e}[i].y)*({e}[i%4+1].y-{e}[i].y))/(POWER({e}[i%4+1].x-{e}[i].x,2)+POWER({e}[i%4+1].y-{e}[i].y,2))))*({e}[i%4+1].x-{e}[i].x)),2)
   + POWER(p.y - ({e}[i].y + GREATEST(0e0, LEAST(1e0, ((p.x-{e}[i].x)*({e}[i%4+1].x-{e}[i].x) + (p.y-{e}[i].y)*({e}[i%4+1].y-{e}[i].y))/(POWER({e}[i%4+1].x-{e}[i].x,2)+POWER({e}[i%4+1].y-{e}[i].y,2))))*({e}[i%4+1].y-{e}[i].y)),2)) )) ))"""
OBSTACLE = "support = 'floor' AND category NOT IN ('rug', 'carpet') AND height > 0.12e0 AND width > 0 AND depth > 0"


@query("narrow_gaps", "JN-13", oracle=f"""
WITH f AS (SELECT *, {corners_sql('')} AS c FROM fx_placed WHERE {OBSTACLE} AND width*depth >= 0.15e0),
p AS (SELECT a.building_id, a.room_id, a.object_id AS a_object_id, b.object_id AS b_object_id, ROUND(LEAST({EDGE_GAP.format(c='a.c', e='b.c')}, {EDGE_GAP.format(c='b.c', e='a.c')}),9) AS gap
 FROM f a JOIN f b ON a.building_id = b.building_id AND a.room_id = b.room_id AND a.object_id < b.object_id AND {near_sql('a.', 'b.', '0.6e0')} WHERE {overlap_sql('a.c', 'b.c', 'a.rotation_deg', 'b.rotation_deg')} <= 0)
SELECT building_id, room_id, a_object_id, b_object_id, RND(gap,6) AS gap FROM p WHERE gap > 1e-6 AND gap < 0.6e0""")
def narrow_gaps(spark, sf_dir):
    return rounded(va.narrow_gaps(placed(spark, sf_dir)), 6, "gap")


@query("blocked_doors", "JN-14", oracle=f"""
WITH f AS (SELECT *, {corners_sql('')} AS c FROM fx_placed WHERE {OBSTACLE}),
d AS (SELECT o.building_id, r.room_id, opening_id, o.x AS ox, o.y AS oy, GREATEST(o.width, 0.6e0) AS width, 0.9e0 AS depth, ATAN2((y0+y1)/2e0 - o.y, (x0+x1)/2e0 - o.x) AS h FROM fx_openings o JOIN fx_rooms r ON r.room_id = COALESCE(o.room_id, CAST(FLOOR(CAST(wall_id AS DOUBLE)/4e0) AS BIGINT)) AND r.building_id = o.building_id WHERE kind = 'door'),
z AS (SELECT building_id, room_id, opening_id, ox + COS(h)*0.45e0 AS x, oy + SIN(h)*0.45e0 AS y, width, depth, DEGREES(h) - 90e0 AS rotation_deg FROM d),
zc AS (SELECT *, {corners_sql('')} AS c FROM z),
p AS (SELECT a.building_id, a.room_id, opening_id, object_id, {overlap_sql('a.c', 'b.c', 'a.rotation_deg', 'b.rotation_deg')} AS penetration FROM zc a JOIN f b ON a.building_id = b.building_id AND a.room_id = b.room_id AND {near_sql('a.', 'b.')})
SELECT building_id, room_id, opening_id, object_id, RND(penetration,4) AS penetration FROM p WHERE penetration > 0.02e0""")
def blocked_doors(spark, sf_dir):
    return rounded(va.blocked_doors(placed(spark, sf_dir), openings(spark, sf_dir), regions(spark, sf_dir)), 4, "penetration")


CROSS = "CASE WHEN ABS(({1}.y-{0}.y)*({2}.x-{1}.x)-({1}.x-{0}.x)*({2}.y-{1}.y)) < 1e-12 THEN 0 WHEN ({1}.y-{0}.y)*({2}.x-{1}.x)-({1}.x-{0}.x)*({2}.y-{1}.y) > 0 THEN 1 ELSE 2 END"


@query("wall_crossings", "JN-15", oracle=f"""
WITH f AS (SELECT *, {corners_sql('')} AS c FROM fx_placed WHERE support = 'floor' AND height >= 0.06e0 AND width > 0 AND depth > 0),
e AS (SELECT building_id, room_id, object_id, c[k] AS a, c[k%4+1] AS b FROM f CROSS JOIN (SELECT UNNEST(RANGE(1,5)) AS k)),
w AS (SELECT room_id, wall_id, {{'x': sx, 'y': sy}} AS s, {{'x': ex, 'y': ey}} AS t FROM fx_walls)
SELECT building_id, e.room_id, object_id, MIN(wall_id) AS wall_id FROM e JOIN w ON e.room_id = w.room_id
WHERE {CROSS.format('a', 'b', 's')} <> {CROSS.format('a', 'b', 't')} AND {CROSS.format('s', 't', 'a')} <> {CROSS.format('s', 't', 'b')} GROUP BY ALL""")
def wall_crossings(spark, sf_dir):
    return va.wall_crossings(placed(spark, sf_dir), fx(spark, sf_dir, "fx_walls"))


RELATION_ENDS = """known AS (SELECT building_id, CONCAT('object:', CAST(object_id AS VARCHAR)) AS entity FROM fx_placed UNION ALL SELECT building_id, CONCAT('wall:', CAST(wall_id AS VARCHAR)) FROM fx_walls UNION ALL SELECT building_id, CONCAT('light:', CAST(light_id AS VARCHAR)) FROM fx_lights)"""


@query("integrity_report", "JN-20", "JN-19", oracle=f"""
WITH {RELATION_ENDS}, ob AS (SELECT * FROM fx_placed UNION ALL SELECT * FROM fx_placed WHERE object_id % 500 = 0),
op AS (SELECT *, CASE WHEN opening_id % 31 = 0 THEN -1 ELSE wall_id END AS wid FROM fx_openings)
SELECT building_id, 'duplicate_id' AS kind, CAST(object_id AS VARCHAR) AS subject FROM ob GROUP BY building_id, object_id HAVING COUNT(*) > 1
UNION ALL SELECT building_id, 'degenerate_dimensions', CAST(object_id AS VARCHAR) FROM ob WHERE width <= 0 OR depth <= 0 OR height <= 0
UNION ALL SELECT building_id, 'bad_confidence', CAST(object_id AS VARCHAR) FROM ob WHERE confidence < 0 OR confidence > 1
UNION ALL SELECT building_id, 'no_support_id', CAST(object_id AS VARCHAR) FROM ob WHERE support = 'on_object' AND support_id IS NULL
UNION ALL SELECT building_id, 'unresolved_support', CAST(object_id AS VARCHAR) FROM ob WHERE support_id IS NOT NULL AND (building_id, support_id) NOT IN (SELECT (building_id, object_id) FROM ob)
UNION ALL SELECT building_id, 'unresolved_wall', CAST(opening_id AS VARCHAR) FROM op WHERE wid NOT IN (SELECT wall_id FROM fx_walls)
UNION ALL SELECT building_id, 'unresolved_subject', CAST(relationship_id AS VARCHAR) FROM fx_relationships r WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.building_id = r.building_id AND k.entity = r.subject_ref)
UNION ALL SELECT building_id, 'unresolved_object', CAST(relationship_id AS VARCHAR) FROM fx_relationships r WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.building_id = r.building_id AND k.entity = r.object_ref)""")
def integrity_report(spark, sf_dir):
    objects = fx(spark, sf_dir, "fx_placed")
    objects = objects.unionByName(objects.filter("object_id % 500 = 0"))
    holes = fx(spark, sf_dir, "fx_openings").withColumn("wall_id", F.when(F.col("opening_id") % 31 == 0, -1).otherwise(F.col("wall_id")))
    return va.integrity_report(objects, holes, fx(spark, sf_dir, "fx_walls"), fx(spark, sf_dir, "fx_lights"), fx(spark, sf_dir, "fx_relationships"))


def catalog(spark):
    return dim(spark, "dim_objects").select("category", F.col("typical_h").alias("typical_height"), "surface_height")


def issues(spark, sf_dir):
    return va.core_issues(placed(spark, sf_dir), fx(spark, sf_dir, "fx_lights"), regions(spark, sf_dir), catalog(spark))


ISSUES = f"""
j AS (SELECT o.*, x0, y0, x1, y1, {INSIDE} AS inside, width > 0 AND depth > 0 AND height > 0 AS solid, ROUND(z+height-2.7e0,9) AS excess FROM fx_placed o JOIN fx_rooms r USING (building_id, room_id)),
lj AS (SELECT l.*, {INSIDE} AS inside FROM fx_lights l JOIN fx_rooms r USING (building_id, room_id)),
tops AS (SELECT building_id, room_id, object_id AS support_id, CASE WHEN surface_height > 0 AND typical_h > 0 THEN z + surface_height*height/typical_h ELSE z+height END AS top FROM fx_placed LEFT JOIN dim_objects USING (category)),
rest AS (SELECT o.*, top FROM fx_placed o LEFT JOIN tops t ON t.building_id = o.building_id AND t.room_id = o.room_id AND t.support_id = o.support_id WHERE support = 'on_object'),
iss AS (SELECT building_id, room_id, object_id AS subject, 'degenerate_dimensions' AS kind, 'error' AS severity, FALSE AS corrected FROM j WHERE NOT solid
 UNION ALL SELECT building_id, room_id, object_id, 'implausible_scale', 'error', FALSE FROM j WHERE solid AND ROUND(width*depth/((x1-x0)*(y1-y0)),9) > 0.55e0
 UNION ALL SELECT building_id, room_id, object_id, 'taller_than_room', 'warning', TRUE FROM j WHERE solid AND height > 2.7e0
 UNION ALL SELECT building_id, room_id, object_id, 'outside_room', 'warning', TRUE FROM j WHERE support = 'floor' AND NOT inside
 UNION ALL SELECT building_id, room_id, object_id, 'floating_object', 'warning', TRUE FROM j WHERE support = 'floor' AND ABS(z) > 0.02e0
 UNION ALL SELECT building_id, room_id, object_id, 'missing_support', 'warning', FALSE FROM rest WHERE top IS NULL
 UNION ALL SELECT building_id, room_id, object_id, 'misaligned_support', 'warning', TRUE FROM rest WHERE ROUND(ABS(z-top),9) > 0.03e0
 UNION ALL SELECT building_id, room_id, object_id, 'below_floor', 'warning', TRUE FROM j WHERE support = 'wall' AND z < 0
 UNION ALL SELECT building_id, room_id, object_id, 'through_ceiling', CASE WHEN support = 'floor' AND ROUND(excess-0.4e0*height,9) < 0 THEN 'warning' ELSE 'error' END, support = 'floor' AND ROUND(excess-0.4e0*height,9) < 0 FROM j WHERE excess > 0.01e0
 UNION ALL SELECT building_id, room_id, light_id, 'light_outside_room', 'warning', TRUE FROM lj WHERE NOT inside
 UNION ALL SELECT building_id, room_id, light_id, 'light_above_ceiling', 'warning', TRUE FROM lj WHERE z > 2.7e0
 UNION ALL SELECT building_id, room_id, light_id, 'negative_power', 'warning', TRUE FROM lj WHERE power_w < 0
 UNION ALL SELECT building_id, room_id, room_id, 'no_lighting', 'warning', FALSE FROM fx_rooms WHERE room_id NOT IN (SELECT room_id FROM fx_lights WHERE NOT uncertain AND power_w > 0))"""


@query("placement_issues", "VL-01", "VL-02", "VL-03", "VL-04", oracle=f"WITH {ISSUES} SELECT building_id, room_id, subject, kind, severity, corrected FROM iss")
def placement_issues(spark, sf_dir):
    return issues(spark, sf_dir).drop("target")


@query("issue_histogram", "VL-05", "UNI-04", oracle=f"WITH {ISSUES} SELECT building_id, kind, COUNT(*) AS issues, COUNT(*) FILTER (corrected) AS corrected FROM iss GROUP BY ALL")
def issue_histogram(spark, sf_dir):
    return va.issue_histogram(issues(spark, sf_dir))


@query("withheld_objects", "VL-05", oracle=f"""
WITH {ISSUES}, bad AS (SELECT DISTINCT subject FROM iss WHERE severity = 'error' AND NOT corrected)
SELECT object_id, uncertain OR subject IS NOT NULL AS uncertain, CASE WHEN by_hand THEN 1 ELSE 0 END + CASE WHEN subject IS NOT NULL THEN 1 ELSE 0 END AS flags FROM fx_placed LEFT JOIN bad ON subject = object_id""")
def withheld_objects(spark, sf_dir):
    return va.withhold(placed(spark, sf_dir), issues(spark, sf_dir)).select("object_id", "uncertain", F.size("flags").alias("flags"))


CLAMP = """
near AS (SELECT *, CASE WHEN inside THEN x ELSE LEAST(GREATEST(x, x0), x1) END AS nx, CASE WHEN inside THEN y ELSE LEAST(GREATEST(y, y0), y1) END AS ny, (x0+x1)/2e0 - LEAST(GREATEST(x, x0), x1) AS cx, (y0+y1)/2e0 - LEAST(GREATEST(y, y0), y1) AS cy, GREATEST(width, depth)/2e0 AS m FROM j)"""


@query("containment_clamps", "VL-02", oracle=f"""
WITH {ISSUES}, {CLAMP}, c AS (SELECT building_id, room_id, object_id, x, y, nx + cx/SQRT(cx*cx+cy*cy)*m AS to_x, ny + cy/SQRT(cx*cx+cy*cy)*m AS to_y FROM near WHERE support = 'floor' AND NOT inside)
SELECT building_id, room_id, object_id, RND(to_x,5) AS to_x, RND(to_y,5) AS to_y, RND(SQRT(POWER(x-to_x,2)+POWER(y-to_y,2)),5) AS moved FROM c""")
def containment_clamps(spark, sf_dir):
    return rounded(va.check_containment(va.in_rooms(placed(spark, sf_dir), regions(spark, sf_dir))), 5, "to_x", "to_y", "moved")


@query("recheck_suggestions", "VL-06", oracle=f"""
WITH {ISSUES}, {CLAMP},
k AS (SELECT *, CASE WHEN support = 'floor' AND NOT inside THEN nx + cx/SQRT(cx*cx+cy*cy)*m ELSE x END AS new_x, CASE WHEN support = 'floor' AND NOT inside THEN ny + cy/SQRT(cx*cx+cy*cy)*m ELSE y END AS new_y,
  CASE WHEN support = 'floor' AND ABS(z) > 0.02e0 THEN 0e0 WHEN support = 'wall' AND z < 0 THEN 0e0 ELSE z END AS new_z, CASE WHEN solid AND height > 2.7e0 THEN 2.65e0 ELSE height END AS h FROM near),
q AS (SELECT *, CASE WHEN support = 'floor' AND ROUND(new_z+h-2.7e0,9) > 0.01e0 AND ROUND(new_z+h-2.7e0-0.4e0*h,9) < 0 THEN h - (new_z+h-2.7e0) - 0.02e0 ELSE h END AS new_height FROM k)
SELECT building_id, room_id, object_id, CASE WHEN object_id IN (SELECT subject FROM iss WHERE kind NOT LIKE '%light%' AND kind <> 'negative_power') THEN 'explained' ELSE 'displaced' END AS kind, locked OR by_hand AS protected,
 RND(new_x,4) AS new_x, RND(new_y,4) AS new_y, RND(new_z,4) AS new_z, RND(new_height,4) AS new_height FROM q WHERE GREATEST(ABS(x-new_x), ABS(y-new_y), ABS(z-new_z), ABS(height-new_height)) > 1e-6""")
def recheck_suggestions(spark, sf_dir):
    frame = va.in_rooms(placed(spark, sf_dir), regions(spark, sf_dir))
    own = issues(spark, sf_dir).filter("kind NOT LIKE '%light%' AND kind <> 'negative_power'")
    return rounded(va.recheck(frame, own), 4, "new_x", "new_y", "new_z", "new_height")
