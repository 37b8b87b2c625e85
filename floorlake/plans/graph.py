"""Component, segmentation, flood-fill and walk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import FX, fx
from ..operators import graph as gr
from .evaluation import rounded
from .registry import query
from .spatial import OBSTACLE, openings, placed, regions

# Short window segments in groups of three, one group in two broken apart.
FX["fx_window_segments"] = """
SELECT p_partkey AS segment_id, CAST(FLOOR(CAST(p_partkey AS DOUBLE)/60e0) AS BIGINT) AS building_id, CAST(FLOOR(CAST(p_partkey AS DOUBLE)/3e0) AS BIGINT) % 20 AS grp,
 CAST(CAST(FLOOR(CAST(p_partkey AS DOUBLE)/3e0) AS BIGINT) % 20 AS DOUBLE)*4e0 + CAST(p_partkey % 3 AS DOUBLE)*CASE WHEN CAST(FLOOR(CAST(p_partkey AS DOUBLE)/3e0) AS BIGINT) % 2 = 0 THEN 0.6e0 ELSE 1.1e0 END AS sx, 0e0 AS sy,
 CAST(CAST(FLOOR(CAST(p_partkey AS DOUBLE)/3e0) AS BIGINT) % 20 AS DOUBLE)*4e0 + CAST(p_partkey % 3 AS DOUBLE)*CASE WHEN CAST(FLOOR(CAST(p_partkey AS DOUBLE)/3e0) AS BIGINT) % 2 = 0 THEN 0.6e0 ELSE 1.1e0 END + 0.5e0 AS ex, 0.05e0 AS ey FROM part"""

LABELS = """
{p}e AS ({edges}),
{p}w(id, r) AS (SELECT id, id FROM ({nodes}) n UNION SELECT w.id, e.dst FROM {p}w w JOIN {p}e e ON e.src = w.r),
{p}cc AS (SELECT id, MIN(r) AS component FROM {p}w GROUP BY id)"""
TOUCH = """SELECT a.segment_id AS src, b.segment_id AS dst FROM fx_window_segments a JOIN fx_window_segments b ON a.building_id = b.building_id AND a.segment_id <> b.segment_id
 AND LEAST(b.sx - a.ex, 9e9) <= 0.3e0 AND LEAST(a.sx - b.ex, 9e9) <= 0.3e0 AND ROUND(CASE WHEN b.sx > a.ex THEN SQRT(POWER(b.sx-a.ex,2)+POWER(0.05e0,2)) WHEN a.sx > b.ex THEN SQRT(POWER(a.sx-b.ex,2)+POWER(0.05e0,2)) ELSE 0e0 END,9) <= 0.3e0"""


@query("window_figures", "GR-01", "GR-02", oracle="WITH RECURSIVE " + LABELS.format(p="t_", edges=TOUCH, nodes="SELECT segment_id AS id FROM fx_window_segments") + """,
b AS (SELECT building_id, component, MIN(sx) AS x0, MAX(ex) AS x1, COUNT(*) AS segments FROM fx_window_segments JOIN t_cc ON id = segment_id GROUP BY ALL)
SELECT building_id, component, 'window' AS kind, RND((x0+x1)/2e0,6) AS x, RND(0.025e0,6) AS y, RND(x1-x0,6) AS width, RND(0.05e0,6) AS depth, 0e0 AS rotation_deg, segments FROM b WHERE ROUND(x1-x0,9) BETWEEN 0.3e0 AND 6e0""")
def window_figures(spark, sf_dir):
    return rounded(gr.window_figures(fx(spark, sf_dir, "fx_window_segments")), 6, "x", "y", "width", "depth")


@query("door_openings", "GR-02", oracle="""
SELECT building_id, opening_id AS entity_id, 'door' AS kind, x, y, CASE WHEN opening_id % 9 = 0 THEN 0.9e0 ELSE GREATEST(width, 0.2e0) END AS width FROM fx_openings WHERE kind = 'door'""")
def door_openings(spark, sf_dir):
    blocks = fx(spark, sf_dir, "fx_openings").select("building_id", F.col("opening_id").alias("entity_id"), "kind", "x", "y",
                                                     F.when(F.col("opening_id") % 9 == 0, 0.1).otherwise(F.col("width")).alias("span_x"), F.lit(0.2).alias("span_y"))
    return gr.door_openings(blocks)


@query("point_clusters", "GR-03", oracle="WITH RECURSIVE " + LABELS.format(
    p="q_", edges="SELECT a.opening_id AS src, b.opening_id AS dst FROM fx_openings a JOIN fx_openings b ON a.building_id = b.building_id AND a.opening_id <> b.opening_id AND ROUND(SQRT(POWER(a.x-b.x,2)+POWER(a.y-b.y,2)),9) <= 0.9e0",
    nodes="SELECT opening_id AS id FROM fx_openings") + """
SELECT building_id, component, RND(AVG(x),6) AS x, RND(AVG(y),6) AS y, COUNT(*) AS points FROM fx_openings JOIN q_cc ON id = opening_id GROUP BY ALL""")
def point_clusters(spark, sf_dir):
    points = fx(spark, sf_dir, "fx_openings").withColumnRenamed("opening_id", "point_id")
    return rounded(gr.cluster_points(points), 6, "x", "y")


@query("support_cascade", "GR-08", oracle="""
WITH RECURSIVE up(building_id, object_id) AS (SELECT building_id, object_id FROM fx_restarted WHERE object_id % 10 = 3 UNION SELECT p.building_id, p.object_id FROM fx_restarted p JOIN up ON p.building_id = up.building_id AND p.support_id = up.object_id) SELECT building_id, object_id FROM up""")
def support_cascade(spark, sf_dir):
    objects = fx(spark, sf_dir, "fx_restarted")
    return gr.cascade(objects.filter("object_id % 10 = 3"), objects.filter("support_id IS NOT NULL").select("building_id", "object_id", "support_id"))


@query("carried_children", "GR-09", oracle="""
WITH RECURSIVE mv AS (SELECT building_id, object_id AS root_id, x AS old_x, y AS old_y, 0.5e0 AS dx, -0.25e0 AS dy, 30e0 AS turn FROM fx_restarted WHERE object_id % 11 = 4),
ch(building_id, root_id, object_id) AS (SELECT building_id, root_id, root_id FROM mv UNION SELECT ch.building_id, ch.root_id, p.object_id FROM fx_restarted p JOIN ch ON p.building_id = ch.building_id AND p.support_id = ch.object_id)
SELECT ch.building_id, ch.root_id, ch.object_id, RND(old_x+dx+(x-old_x)*COS(RADIANS(turn))-(y-old_y)*SIN(RADIANS(turn)),6) AS x, RND(old_y+dy+(x-old_x)*SIN(RADIANS(turn))+(y-old_y)*COS(RADIANS(turn)),6) AS y, RND(CASE WHEN rotation_deg+turn >= 360 THEN rotation_deg+turn-360e0 ELSE rotation_deg+turn END,6) AS rotation_deg
FROM ch JOIN mv USING (building_id, root_id) JOIN fx_restarted p ON p.building_id = ch.building_id AND p.object_id = ch.object_id WHERE ch.root_id <> ch.object_id""")
def carried_children(spark, sf_dir):
    objects = fx(spark, sf_dir, "fx_restarted")
    moves = objects.filter("object_id % 11 = 4").select("building_id", F.col("object_id").alias("root_id"), F.col("x").alias("old_x"), F.col("y").alias("old_y"),
                                                         F.lit(0.5).alias("dx"), F.lit(-0.25).alias("dy"), F.lit(30.0).alias("turn_deg"))
    return rounded(gr.carry_children(moves, objects), 6, "x", "y", "rotation_deg")


@query("fallback_regions", "GR-05", oracle="""
SELECT building_id, MIN(LEAST(sx,ex)) AS x0, MIN(LEAST(sy,ey)) AS y0, MAX(GREATEST(sx,ex)) AS x1, MAX(GREATEST(sy,ey)) AS y1, COUNT(*) AS walls, RND((MAX(GREATEST(sx,ex))-MIN(LEAST(sx,ex)))*(MAX(GREATEST(sy,ey))-MIN(LEAST(sy,ey))),6) AS area FROM fx_walls WHERE building_id % 2 = 1 GROUP BY building_id""")
def fallback_regions(spark, sf_dir):
    return rounded(gr.fallback_regions(fx(spark, sf_dir, "fx_walls"), fx(spark, sf_dir, "fx_rooms").filter("building_id % 2 = 0")), 6, "area")


RES = 0.25


@query("segmented_rooms", "GR-04", oracle=f"""
WITH RECURSIVE fr AS (SELECT building_id, MIN(LEAST(sx,ex))-2e0 AS ox, MIN(LEAST(sy,ey))-2e0 AS oy, CAST(CEIL((MAX(GREATEST(sx,ex))-MIN(LEAST(sx,ex))+4e0)/{RES}e0) AS BIGINT)+1 AS cols, CAST(CEIL((MAX(GREATEST(sy,ey))-MIN(LEAST(sy,ey))+4e0)/{RES}e0) AS BIGINT)+1 AS rws FROM fx_walls GROUP BY building_id),
st AS (SELECT w.building_id, ox, oy, sx, sy, ex, ey, GREATEST(2, CAST(FLOOR(SQRT(POWER(ex-sx,2)+POWER(ey-sy,2))/{RES/2}e0) AS BIGINT)+1) AS n FROM fx_walls w JOIN fr USING (building_id)),
ce AS (SELECT DISTINCT building_id, CAST(FLOOR((sy+(ey-sy)*(CAST(i AS DOUBLE)/(n-1))-oy)/{RES}e0+1e-9) AS BIGINT) AS r, CAST(FLOOR((sx+(ex-sx)*(CAST(i AS DOUBLE)/(n-1))-ox)/{RES}e0+1e-9) AS BIGINT) AS c FROM (SELECT *, UNNEST(RANGE(0, n)) AS i FROM st)),
d1 AS (SELECT dr, dc FROM (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) v(dr,dc)), d2 AS (SELECT dr, dc FROM (SELECT UNNEST(RANGE(-1,2)) AS dr) a CROSS JOIN (SELECT UNNEST(RANGE(-1,2)) AS dc) b WHERE dr*dr+dc*dc <= 1),
wl AS (SELECT DISTINCT building_id, r+dr AS r, c+dc AS c FROM ce CROSS JOIN d1), se AS (SELECT DISTINCT building_id, r+dr AS r, c+dc AS c FROM wl CROSS JOIN d2),
seed AS (SELECT q.building_id, room_id, CAST(FLOOR(((y0+y1)/2e0-oy)/{RES}e0+1e-9) AS BIGINT) AS r, CAST(FLOOR(((x0+x1)/2e0-ox)/{RES}e0+1e-9) AS BIGINT) AS c FROM fx_rooms q JOIN fr USING (building_id)),
fl(building_id, room_id, r, c) AS (SELECT building_id, room_id, r, c FROM seed s WHERE NOT EXISTS (SELECT 1 FROM se WHERE se.building_id = s.building_id AND se.r = s.r AND se.c = s.c)
  UNION SELECT f.building_id, f.room_id, f.r+dr, f.c+dc FROM fl f CROSS JOIN (SELECT dr, dc FROM d1 WHERE dr <> 0 OR dc <> 0) n JOIN fr USING (building_id) WHERE f.r+dr >= 0 AND f.r+dr < rws AND f.c+dc >= 0 AND f.c+dc < cols AND NOT EXISTS (SELECT 1 FROM se WHERE se.building_id = f.building_id AND se.r = f.r+dr AND se.c = f.c+dc)),
gw AS (SELECT DISTINCT building_id, room_id, r+dr AS r, c+dc AS c FROM fl CROSS JOIN d2),
ok AS (SELECT * FROM gw WHERE NOT EXISTS (SELECT 1 FROM wl WHERE wl.building_id = gw.building_id AND wl.r = gw.r AND wl.c = gw.c)),
rm AS (SELECT building_id, COUNT(*)*{RES*RES}e0 AS area, MIN(c) AS c0, MIN(r) AS r0, MAX(c) AS c1, AVG(c) AS cx, AVG(r) AS cy FROM ok GROUP BY building_id, room_id)
SELECT building_id, RND(area,4) AS area, RND(ox+c0*{RES}e0,4) AS min_x, RND(oy+r0*{RES}e0,4) AS min_y, RND(ox+c1*{RES}e0,4) AS max_x, RND(ox+cx*{RES}e0,4) AS centre_x, RND(oy+cy*{RES}e0,4) AS centre_y FROM rm JOIN fr USING (building_id) WHERE ROUND(area,9) >= 2e0""")
def segmented_rooms(spark, sf_dir):
    found = gr.segment_rooms(fx(spark, sf_dir, "fx_walls"), thickness=0.15, resolution=RES, gap=0.5)
    return rounded(found, 4, "area", "min_x", "min_y", "max_x", "centre_x", "centre_y").drop("component", "max_y")


@query("reachable_floor", "GR-06", oracle=f"""
WITH RECURSIVE fr AS (SELECT building_id, room_id, x0, y0, x1, y1, CAST(FLOOR((x1-x0)/0.1e0+1e-9) AS BIGINT)+1 AS cols, CAST(FLOOR((y1-y0)/0.1e0+1e-9) AS BIGINT)+1 AS rws FROM fx_rooms),
g0 AS (SELECT room_id, x0, y0, x1, y1, UNNEST(RANGE(0, cols)) AS c, rws FROM fr), g1 AS (SELECT room_id, x0, y0, x1, y1, c, UNNEST(RANGE(0, rws)) AS r FROM g0),
fl AS (SELECT room_id, r, c, x0+(c+0.5e0)*0.1e0 AS px, y0+(r+0.5e0)*0.1e0 AS py FROM g1 WHERE x0+(c+0.5e0)*0.1e0 < x1 AND y0+(r+0.5e0)*0.1e0 < y1),
ob AS (SELECT room_id, x, y, rotation_deg, width*0.1e0 AS width, depth*0.1e0 AS depth FROM fx_placed WHERE {OBSTACLE}),
bl AS (SELECT DISTINCT f.room_id, r, c FROM fl f JOIN ob o ON o.room_id = f.room_id AND ROUND(ABS((px-x)*COS(RADIANS(rotation_deg))+(py-y)*SIN(RADIANS(rotation_deg)))-width/2e0,9) < 0 AND ROUND(ABS(-(px-x)*SIN(RADIANS(rotation_deg))+(py-y)*COS(RADIANS(rotation_deg)))-depth/2e0,9) < 0),
fc AS (SELECT f.room_id, f.r, f.c FROM fl f LEFT JOIN bl USING (room_id, r, c) WHERE bl.room_id IS NULL),
dr AS (SELECT opening_id, f.*, o.x AS ox, o.y AS oy, (x0+x1)/2e0-o.x AS mx, (y0+y1)/2e0-o.y AS my FROM fx_openings o JOIN fr f ON f.room_id = COALESCE(o.room_id, CAST(FLOOR(CAST(wall_id AS DOUBLE)/4e0) AS BIGINT)) WHERE kind = 'door'),
pr AS (SELECT opening_id, room_id, s, CAST(FLOOR((oy+my/SQRT(mx*mx+my*my)*0.1e0*s-y0)/0.1e0+1e-9) AS BIGINT) AS r, CAST(FLOOR((ox+mx/SQRT(mx*mx+my*my)*0.1e0*s-x0)/0.1e0+1e-9) AS BIGINT) AS c FROM dr CROSS JOIN (SELECT UNNEST(RANGE(1,12)) AS s) q),
sd AS (SELECT room_id, r, c FROM (SELECT pr.*, ROW_NUMBER() OVER (PARTITION BY opening_id ORDER BY s) AS rn FROM pr JOIN fc USING (room_id, r, c)) WHERE rn = 1),
fd(room_id, r, c) AS (SELECT DISTINCT room_id, r, c FROM sd UNION SELECT f.room_id, f.r, f.c FROM fd d JOIN fc f ON f.room_id = d.room_id AND ((f.r = d.r AND ABS(f.c-d.c) = 1) OR (f.c = d.c AND ABS(f.r-d.r) = 1))),
t AS (SELECT room_id, COUNT(*) AS n FROM fc GROUP BY 1), h AS (SELECT room_id, COUNT(*) AS n FROM fd GROUP BY 1)
SELECT f.building_id, f.room_id, COALESCE(t.n, 0) AS free_cells, COALESCE(h.n, 0) AS reached_cells, RND(CAST(h.n AS DOUBLE)/t.n,6) AS share, CASE WHEN t.n IS NULL THEN 'room_full' WHEN CAST(h.n AS DOUBLE)/t.n < 0.6e0 THEN 'unreachable_floor' ELSE '' END AS issue FROM fr f LEFT JOIN t USING (room_id) LEFT JOIN h USING (room_id)""")
def reachable_floor(spark, sf_dir):
    """All objects stand on the floor, a tenth as wide and deep, else no room of this data had free floor."""
    slender = placed(spark, sf_dir).withColumns({"width": F.col("width") * 0.1, "depth": F.col("depth") * 0.1})
    found = gr.reachable_floor(regions(spark, sf_dir), slender, openings(spark, sf_dir))
    return rounded(found, 6, "share")
