"""Placement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import FX, fx
from ..operators import placement as pc
from .evaluation import rounded
from .pixels import CAM
from .registry import query
from .spatial import regions

FX["fx_sized"] = """
SELECT building_id, room_id, object_id, category, CASE object_id % 5 WHEN 0 THEN 'very_small' WHEN 1 THEN 'small' WHEN 2 THEN 'large' WHEN 3 THEN 'huge' ELSE 'medium' END AS size_bucket,
 CASE WHEN object_id % 4 <> 0 THEN 0.05e0 + CAST(object_id % 9 AS DOUBLE)*0.05e0 END AS box_width, CASE WHEN object_id % 4 <> 0 THEN 0.04e0 + CAST(object_id % 7 AS DOUBLE)*0.06e0 END AS box_height FROM fx_placed"""


def frames(spark, sf_dir):
    return regions(spark, sf_dir).withColumns({"room_width": F.col("x1") - F.col("x0"), "room_depth": F.col("y1") - F.col("y0")})


@query("resolved_dimensions", "PL-01", oracle="""
WITH j AS (SELECT s.*, o.*, COALESCE(factor, 1e0) AS f, x1-x0 AS rw, y1-y0 AS rd FROM fx_sized s JOIN fx_rooms r USING (building_id, room_id) LEFT JOIN dim_objects o ON o.category = s.category LEFT JOIN dim_size_buckets b ON b.bucket = s.size_bucket),
k AS (SELECT *, CASE WHEN box_height > 0.02e0 AND box_width > 0.005e0 THEN 1e0+(GREATEST(0.6e0, LEAST(1.7e0, box_width/box_height/(typical_w/typical_h)))-1e0)*0.5e0 ELSE 1e0 END AS bend FROM j)
SELECT object_id, RND(CASE WHEN typical_w IS NULL THEN 0.5e0 ELSE LEAST(GREATEST(w_lo, LEAST(w_hi, typical_w*f*bend)), GREATEST(0.2e0, rw*0.92e0)) END,5) AS width, RND(CASE WHEN typical_w IS NULL THEN 0.5e0 ELSE LEAST(GREATEST(d_lo, LEAST(d_hi, typical_d*f)), GREATEST(0.2e0, rd*0.92e0)) END,5) AS depth,
 RND(CASE WHEN typical_w IS NULL THEN 0.5e0 ELSE LEAST(GREATEST(h_lo, LEAST(h_hi, typical_h*f)), 2.7e0*0.95e0) END,5) AS height FROM k""")
def resolved_dimensions(spark, sf_dir):
    return rounded(pc.resolve_dimensions(fx(spark, sf_dir, "fx_sized"), frames(spark, sf_dir)).select("object_id", "width", "depth", "height"), 5, "width", "depth", "height")


@query("floor_positions", "PL-02", oracle=f"""
WITH {CAM}, q AS (SELECT v.viewpoint_id, v.object_id, r.*, v.x AS vx, v.y AS vy FROM fx_views_of v JOIN fx_placed p ON p.object_id = v.object_id JOIN fx_rooms r ON r.building_id = p.building_id AND r.room_id = p.room_id),
h AS (SELECT q.*, ix, iy, ix IS NOT NULL AND ROUND(SQRT(POWER(ix-vx,2)+POWER(iy-vy,2))-1.6e0*SQRT(POWER(x1-x0,2)+POWER(y1-y0,2)),9) <= 0 AS hit FROM q LEFT JOIN c5 ON c5.viewpoint_id = q.viewpoint_id AND c5.object_id = q.object_id)
SELECT viewpoint_id, object_id, RND(CASE WHEN hit THEN ix ELSE (x0+x1)/2e0 END,4) AS px, RND(CASE WHEN hit THEN iy ELSE (y0+y1)/2e0 END,4) AS py, hit AS measured FROM h""")
def floor_positions(spark, sf_dir):
    seen = fx(spark, sf_dir, "fx_views_of").select("viewpoint_id", "object_id", "bx0", "bx1", "by1").join(fx(spark, sf_dir, "fx_placed").select("object_id", "building_id", "room_id", "confidence"), "object_id")
    return rounded(pc.place_on_floor(seen, fx(spark, sf_dir, "fx_viewpoints"), regions(spark, sf_dir)).select("viewpoint_id", "object_id", "px", "py", "measured"), 4, "px", "py")


@query("host_walls", "PL-02", "PL-04")
def host_walls(spark, sf_dir):
    asked = fx(spark, sf_dir, "fx_viewpoints").select("building_id", "room_id", F.col("viewpoint_id").alias("request_id"), "yaw", F.when(F.col("viewpoint_id") % 2 == 0, "left").otherwise("back").alias("on_wall"))
    return pc.select_walls(asked, fx(spark, sf_dir, "fx_walls"), regions(spark, sf_dir)).select("request_id", "wall_id")


@query("spaced_openings", "PL-04", oracle="""
WITH k AS (SELECT o.opening_id, o.wall_id, o.width, sx, sy, ex, ey, ROW_NUMBER() OVER (PARTITION BY o.wall_id ORDER BY opening_id) AS s, COUNT(*) OVER (PARTITION BY o.wall_id) AS n, SQRT(POWER(ex-sx,2)+POWER(ey-sy,2)) AS l FROM fx_openings o JOIN fx_walls w USING (wall_id))
SELECT opening_id, wall_id, RND(sx+(ex-sx)*(0.07e0+0.86e0*(s-0.5e0)/n),5) AS x, RND(sy+(ey-sy)*(0.07e0+0.86e0*(s-0.5e0)/n),5) AS y, RND(LEAST(width, GREATEST(0.4e0, l*0.86e0/n*0.88e0)),5) AS width FROM k""")
def spaced_openings(spark, sf_dir):
    holes = fx(spark, sf_dir, "fx_openings")
    walls = fx(spark, sf_dir, "fx_walls").select("wall_id", "sx", "sy", "ex", "ey", F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")).alias("length"))
    hosts = holes.select(F.col("opening_id").alias("request_id"), "wall_id").join(walls, "wall_id")
    return rounded(pc.place_openings(holes.select("opening_id", "kind", "width"), hosts).select("opening_id", "wall_id", "x", "y", "width"), 5, "x", "y", "width")


@query("light_grids", "PL-03", oracle="""
WITH l AS (SELECT light_id, building_id, room_id, CASE light_id % 2 WHEN 0 THEN 'ceiling_light' ELSE 'spotlight' END AS kind, fixtures, is_on FROM fx_lights), j AS (SELECT l.*, x0, y0, x1-x0 AS w, y1-y0 AS d, p.power_w AS pw, GREATEST(1, CAST(ROUND(SQRT(fixtures*(x1-x0)/(y1-y0))) AS BIGINT)) AS cols FROM l JOIN fx_rooms r USING (building_id, room_id) JOIN dim_lights p ON p.kind = l.kind),
g AS (SELECT *, GREATEST(1, CAST(CEIL(CAST(fixtures AS DOUBLE)/cols) AS BIGINT)) AS rws, UNNEST(RANGE(0, fixtures)) AS i FROM j)
SELECT room_id, kind, CAST(i AS INTEGER) AS fixture, RND(x0+w*((i % cols)+0.5e0)/cols,5) AS x, RND(y0+d*((i // cols)+0.5e0)/rws,5) AS y, RND(CASE WHEN is_on THEN pw*GREATEST(0.6e0, LEAST(2.6e0, w*d/20e0)) ELSE 0e0 END,4) AS power_w FROM g""")
def light_grids(spark, sf_dir):
    lights = fx(spark, sf_dir, "fx_lights").select("building_id", "room_id", F.when(F.col("light_id") % 2 == 0, "ceiling_light").otherwise("spotlight").alias("kind"), "fixtures", "is_on", F.lit(1.0).alias("brightness"))
    grid = pc.light_grid(lights, frames(spark, sf_dir)).select("room_id", "kind", "fixture", "x", "y", "power_w")
    return rounded(rounded(grid, 5, "x", "y"), 4, "power_w")


@query("relation_positions", "PL-05", oracle="""
WITH r AS (SELECT s.object_id AS subject_id, CASE s.object_id % 3 WHEN 0 THEN 'centered_under' WHEN 1 THEN 'above' ELSE 'on_top_of' END AS predicate, t.object_id AS target_id, s.height AS sh, s.width AS sw, s.depth AS sd, t.x, t.y, t.z, t.width, t.depth, t.height, t.rotation_deg, typical_h, surface_height
  FROM fx_placed s CROSS JOIN (SELECT COUNT(*) AS n FROM supplier) c JOIN fx_placed t ON t.object_id = s.object_id + n LEFT JOIN dim_objects d ON d.category = t.category),
p AS (SELECT *, CASE WHEN surface_height > 0 AND typical_h > 0 THEN z + surface_height*height/typical_h ELSE z + height END AS top, CAST(LIST_SUM(LIST_TRANSFORM(STR_SPLIT(CAST(subject_id AS VARCHAR), ''), LAMBDA c: ASCII(c))) AS BIGINT) AS seed FROM r),
o AS (SELECT *, ((seed % 7)/6e0-0.5e0)*1.4e0*GREATEST(0e0,(width-sw)/2e0) AS ox, (((seed // 7) % 5)/4e0-0.5e0)*1.4e0*GREATEST(0e0,(depth-sd)/2e0) AS oy FROM p)
SELECT subject_id, predicate, RND(x + CASE WHEN predicate = 'on_top_of' THEN ox*COS(RADIANS(rotation_deg))-oy*SIN(RADIANS(rotation_deg)) ELSE 0e0 END,5) AS x, RND(y + CASE WHEN predicate = 'on_top_of' THEN ox*SIN(RADIANS(rotation_deg))+oy*COS(RADIANS(rotation_deg)) ELSE 0e0 END,5) AS y,
 RND(CASE predicate WHEN 'centered_under' THEN 0e0 WHEN 'on_top_of' THEN top ELSE GREATEST(0e0, CASE WHEN ROUND(top+0.9e0-2.7e0,12) >= 0 THEN 2.7e0-sh-0.05e0 ELSE top+0.9e0 END) END,5) AS z FROM o""")
def relation_positions(spark, sf_dir):
    objects = fx(spark, sf_dir, "fx_placed")
    # The count as a number, not a relation: as one it takes part in join reordering, and rows may meet on no key.
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    k = F.col("object_id")
    links = objects.select(
        k.alias("subject_id"), F.when(k % 3 == 0, "centered_under").when(k % 3 == 1, "above").otherwise("on_top_of").alias("predicate"), (k + F.lit(n)).alias("target_id"))
    return rounded(pc.apply_relations(links, objects, regions(spark, sf_dir)).select("subject_id", "predicate", "x", "y", "z"), 5, "x", "y", "z")


@query("pose_fit_tests", "PL-11")
def pose_fit_tests(spark, sf_dir):
    objects = fx(spark, sf_dir, "fx_placed")
    poses = objects.withColumnRenamed("object_id", "pose_id")
    windows = fx(spark, sf_dir, "fx_openings").filter("kind = 'window' AND room_id IS NOT NULL")
    return pc.fit_tests(poses, regions(spark, sf_dir), objects, windows)


@query("spread_lights", "PL-13", oracle="""
WITH c AS (SELECT *, 1 + room_id % 4 AS n FROM fx_rooms), g AS (SELECT *, UNNEST(RANGE(1, n + 1)) AS i FROM c)
SELECT room_id, CAST(i AS INTEGER) AS light_no, RND(CASE WHEN n > 1 AND x1-x0 >= y1-y0 THEN x0+(x1-x0)*i/(n+1e0) ELSE (x0+x1)/2e0 END,5) AS x, RND(CASE WHEN n > 1 AND x1-x0 < y1-y0 THEN y0+(y1-y0)*i/(n+1e0) ELSE (y0+y1)/2e0 END,5) AS y FROM g""")
def spread_lights(spark, sf_dir):
    rooms = regions(spark, sf_dir)
    return rounded(pc.spread_lights(rooms, rooms.select("building_id", "room_id", (1 + F.col("room_id") % 4).alias("n"))).select("room_id", "light_no", "x", "y"), 5, "x", "y")
