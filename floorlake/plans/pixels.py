"""Pixel statistics and view axes. Pairs compare image n (reference) with image n + 1 (render)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import FX, fx
from ..functions import projection as pj
from ..operators import pixels as px
from ..operators import similarity as sm
from .evaluation import rounded
from .registry import query
from .rooms import dist_sql, hex_sql

LIN = "CASE WHEN {0} <= 0.04045e0 THEN {0}/12.92e0 ELSE POWER(({0}+0.055e0)/1.055e0, 2.4e0) END"
SRGB = "CASE WHEN {0} <= 0.0031308e0 THEN {0}*12.92e0 ELSE 1.055e0*POWER({0}, 1e0/2.4e0)-0.055e0 END"
F_LAB = "CASE WHEN {0} > 216e0/24389e0 THEN CBRT({0}) ELSE ((24389e0/27e0)*{0}+16e0)/116e0 END"
PREP = f"""
p0 AS (SELECT *, {LIN.format('r')} AS lr, {LIN.format('g')} AS lg, {LIN.format('b')} AS lb FROM fx_rgb),
p1 AS (SELECT *, 0.2126e0*lr+0.7152e0*lg+0.0722e0*lb AS y, (0.4124564e0*lr+0.3575761e0*lg+0.1804375e0*lb)/0.95047e0 AS cx, 0.2126729e0*lr+0.7151522e0*lg+0.0721750e0*lb AS cy, (0.0193339e0*lr+0.1191920e0*lg+0.9503041e0*lb)/1.08883e0 AS cz FROM p0),
p2 AS (SELECT *, {F_LAB.format('cx')} AS fx, {F_LAB.format('cy')} AS fy, {F_LAB.format('cz')} AS fz, CASE WHEN GREATEST(r,g,b) > 1e-6 THEN (GREATEST(r,g,b)-LEAST(r,g,b))/GREATEST(r,g,b) ELSE 0e0 END AS sat FROM p1),
p3 AS (SELECT *, 116e0*fy-16e0 AS ll, 500e0*(fx-fy) AS la, 200e0*(fy-fz) AS lbb FROM p2)"""


def stats_sql(keys: str) -> str:
    return f"""SELECT {keys}, COUNT(*) AS pixels, AVG(lr) AS mr, AVG(lg) AS mg, AVG(lb) AS mb, AVG(y) AS exposure, STDDEV_POP(y) AS contrast, AVG(lr-lb) AS warmth, AVG(sat) AS saturation, AVG(ll) AS lab_l, AVG(la) AS lab_a, AVG(lbb) AS lab_b FROM p3 GROUP BY {keys}"""


STATS = f"{PREP}, st AS ({stats_sql('image_id')})"
PAIRS = "pr AS (SELECT image_id AS pair_id, image_id AS reference_id, image_id + 1 AS render_id FROM (SELECT DISTINCT image_id FROM fx_rgb) a WHERE image_id + 1 IN (SELECT image_id FROM fx_rgb))"
HIST = """
hc AS (SELECT image_id, ch, LEAST(CAST(FLOOR(v*24) AS BIGINT), 23) AS b0, COUNT(*) AS c FROM (SELECT image_id, 'r' AS ch, r AS v FROM fx_rgb UNION ALL SELECT image_id, 'g', g FROM fx_rgb UNION ALL SELECT image_id, 'b', b FROM fx_rgb) GROUP BY ALL),
hs AS (SELECT image_id, ch AS channel, b0 + d AS bin, SUM(c)/3e0/64e0 AS share FROM hc CROSS JOIN (VALUES (-1), (0), (1)) v(d) WHERE b0 + d BETWEEN 0 AND 23 GROUP BY ALL),
ha AS (SELECT pair_id, COALESCE(SUM(CASE WHEN b.share IS NULL THEN 0e0 ELSE LEAST(a.share, b.share) END)/3e0, 0e0) AS agreement FROM pr LEFT JOIN hs a ON a.image_id = reference_id LEFT JOIN hs b ON b.image_id = render_id AND b.channel = a.channel AND b.bin = a.bin GROUP BY pair_id)"""
COLOUR = f"{STATS}, {PAIRS}, {HIST}, ca AS (SELECT pr.pair_id, agreement, SQRT(POWER(a.lab_l-b.lab_l,2)+POWER(a.lab_a-b.lab_a,2)+POWER(a.lab_b-b.lab_b,2)) AS cst, b.lab_a-a.lab_a AS da, b.lab_b-a.lab_b AS db FROM pr JOIN st a ON a.image_id = reference_id JOIN st b ON b.image_id = render_id JOIN ha ON ha.pair_id = pr.pair_id)"


def rgb(spark, sf_dir):
    return fx(spark, sf_dir, "fx_rgb")


def pairs(spark, sf_dir):
    ids = rgb(spark, sf_dir).select("image_id").distinct()
    following = ids.select((F.col("image_id") - 1).alias("image_id"))
    return ids.join(following, "image_id").select(F.col("image_id").alias("pair_id"), F.col("image_id").alias("reference_id"), (F.col("image_id") + 1).alias("render_id"))


@query("image_statistics", "PX-01", "PX-02", "STR-13", oracle=f"""
WITH {STATS} SELECT image_id, pixels, RND(exposure,6) AS exposure, RND(contrast,6) AS contrast, RND(warmth,6) AS warmth, RND(saturation,6) AS saturation, RND(lab_l,4) AS lab_l, RND(lab_a,4) AS lab_a, RND(lab_b,4) AS lab_b, {hex_sql(*[f"255e0*LEAST(1e0,GREATEST(0e0,{SRGB.format('m' + c)}))" for c in 'rgb'])} AS mean_hex FROM st""")
def image_statistics(spark, sf_dir):
    found = px.image_stats(rgb(spark, sf_dir), ["image_id"])
    return rounded(rounded(found, 6, "exposure", "contrast", "warmth", "saturation"), 4, "lab_l", "lab_a", "lab_b")


@query("colour_histograms", "PX-03", oracle=f"WITH {PAIRS}, {HIST} SELECT image_id, channel, bin, RND(share,6) AS share FROM hs")
def colour_histograms(spark, sf_dir):
    return rounded(px.histograms(rgb(spark, sf_dir)), 6, "share")


@query("histogram_agreement", "PX-03", oracle=f"WITH {PAIRS}, {HIST} SELECT pair_id, RND(agreement,6) AS agreement FROM ha")
def histogram_agreement(spark, sf_dir):
    return rounded(px.histogram_agreement(pairs(spark, sf_dir), px.histograms(rgb(spark, sf_dir))).select("pair_id", "agreement"), 6, "agreement")


JOINT = "jh AS (SELECT image_id, bin, CAST(COUNT(*) AS DOUBLE)/ANY_VALUE(n) AS share FROM (SELECT image_id, CAST(GREATEST(0, LEAST(3, FLOOR(r*4)))*16 + GREATEST(0, LEAST(3, FLOOR(g*4)))*4 + GREATEST(0, LEAST(3, FLOOR(b*4))) AS INTEGER) AS bin, COUNT(*) OVER (PARTITION BY image_id) AS n FROM fx_rgb) GROUP BY ALL)"


@query("joint_histograms", "PX-03", oracle=f"WITH {JOINT} SELECT image_id, bin, RND(share,6) AS share FROM jh")
def joint_histograms(spark, sf_dir):
    return rounded(sm.joint_histograms(rgb(spark, sf_dir)), 6, "share")


def slope_sql(line: str, along: str) -> str:
    before, after = [f"{f}(y) OVER (PARTITION BY image_id, {line} ORDER BY {along})" for f in ("LAG", "LEAD")]
    return f"COALESCE(({after}-{before})/2e0, {after}-y, y-{before}, 0e0)"


def energy_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT image_id, prow, pcol, SQRT(POWER({slope_sql('prow', 'pcol')},2)+POWER({slope_sql('pcol', 'prow')},2)) AS e FROM {source})"


# Pictures are 8 x 8: six bands of 2, 2, 1, 1, 1, 1 rows and eight columns.
SIMILAR = f"""{JOINT}, {PAIRS}, ym AS (SELECT image_id, prow, pcol, r, g, b, 0.2126e0*r+0.7152e0*g+0.0722e0*b AS y FROM fx_rgb),
y2 AS (SELECT image_id, prow//2 AS prow, pcol//2 AS pcol, AVG(y) AS y FROM ym GROUP BY ALL), y4 AS (SELECT image_id, prow//4 AS prow, pcol//4 AS pcol, AVG(y) AS y FROM ym GROUP BY ALL),
{energy_sql('g1', 'ym')}, {energy_sql('g2', 'y2')}, {energy_sql('g4', 'y4')},
cl AS (SELECT image_id, CASE WHEN prow < 4 THEN prow//2 ELSE prow-2 END AS gr, pcol AS gc, AVG(e) AS e FROM g1 GROUP BY ALL),
ms AS (SELECT image_id, {hex_sql('255e0*AVG(r)', '255e0*AVG(g)', '255e0*AVG(b)')} AS hex, AVG(y) AS br, STDDEV_POP(y) AS co, AVG(r)-AVG(b) AS wa FROM ym GROUP BY image_id),
dt AS (SELECT image_id, d1, d2, d4 FROM (SELECT image_id, AVG(e) AS d1 FROM g1 GROUP BY 1) JOIN (SELECT image_id, AVG(e) AS d2 FROM g2 GROUP BY 1) USING (image_id) JOIN (SELECT image_id, AVG(e) AS d4 FROM g4 GROUP BY 1) USING (image_id)),
ag AS (SELECT pair_id, SUM(LEAST(x.share, z.share)) AS agree FROM pr JOIN jh x ON x.image_id = reference_id JOIN jh z ON z.image_id = render_id AND z.bin = x.bin GROUP BY pair_id),
ly AS (SELECT pair_id, GREATEST(0e0, (CASE WHEN COUNT(*)*SQRT(VAR_POP(x.e)*VAR_POP(z.e)) > 1e-9 THEN COVAR_POP(x.e, z.e)/SQRT(VAR_POP(x.e)*VAR_POP(z.e)) ELSE 0e0 END + 1e0)/2e0) AS layout FROM pr JOIN cl x ON x.image_id = reference_id JOIN cl z ON z.image_id = render_id AND z.gr = x.gr AND z.gc = x.gc GROUP BY pair_id),
sm AS (SELECT pr.pair_id, GREATEST(0e0, 0.6e0*COALESCE(agree,0e0)+0.4e0*(1e0-{dist_sql('a.hex', 'b.hex')})) AS colour, {dist_sql('a.hex', 'b.hex')} AS cd, b.br-a.br AS brighter, b.wa-a.wa AS warmer, layout,
 0.4e0*(1e0-LEAST(1e0, ABS(a.br-b.br)/0.5e0))+0.25e0*(1e0-LEAST(1e0, ABS(a.co-b.co)/0.35e0))+0.35e0*(1e0-LEAST(1e0, ABS(a.wa-b.wa)/0.35e0)) AS lighting,
 ({'+'.join(f"1e0-LEAST(1e0, ABS(x.d{s}-z.d{s})/GREATEST(x.d{s}, z.d{s}, 1e-6))" for s in (1, 2, 4))})/3e0 AS material
 FROM pr JOIN ms a ON a.image_id = reference_id JOIN ms b ON b.image_id = render_id JOIN dt x ON x.image_id = reference_id JOIN dt z ON z.image_id = render_id JOIN ly ON ly.pair_id = pr.pair_id LEFT JOIN ag ON ag.pair_id = pr.pair_id)"""


@query("pair_similarity", "PX-15", oracle=f"WITH {SIMILAR} SELECT pair_id, RND(colour,5) AS colour, RND(lighting,5) AS lighting, RND(layout,5) AS layout, RND(material,5) AS material, RND((0.26e0*colour+0.24e0*layout+0.22e0*lighting+0.08e0*material)/0.8e0,5) AS score FROM sm")
def pair_similarity(spark, sf_dir):
    found = sm.pair_similarity(pairs(spark, sf_dir), rgb(spark, sf_dir)).select("pair_id", "colour", "lighting", "layout", "material", "score")
    return rounded(found, 5, "colour", "lighting", "layout", "material", "score")


@query("similarity_findings", "PX-15", oracle=f"""
WITH {SIMILAR} SELECT pair_id, 'colour' AS axis, 'overall colour differs' AS finding, 'materials' AS remedy FROM sm WHERE cd > 0.18e0 UNION ALL SELECT pair_id, 'lighting', 'render is darker', 'lighting' FROM sm WHERE brighter < -0.1e0
UNION ALL SELECT pair_id, 'lighting', 'render is brighter', 'lighting' FROM sm WHERE brighter > 0.1e0 UNION ALL SELECT pair_id, 'lighting', 'lighting too warm', 'lighting' FROM sm WHERE warmer > 0.08e0 UNION ALL SELECT pair_id, 'lighting', 'lighting too cool', 'lighting' FROM sm WHERE warmer < -0.08e0
UNION ALL SELECT pair_id, 'layout', 'furniture layout differs', 'assets' FROM sm WHERE layout < 0.7e0 UNION ALL SELECT pair_id, 'material', 'surfaces read flatter', 'materials' FROM sm WHERE material < 0.7e0""")
def similarity_findings(spark, sf_dir):
    return sm.similarity_findings(sm.pair_similarity(pairs(spark, sf_dir), rgb(spark, sf_dir)))


MASS = """mg AS (SELECT image_id, gr, gc, s/NULLIF(SUM(s) OVER (PARTITION BY image_id), 0) AS share FROM (SELECT image_id, CAST(FLOOR(prow/4) AS BIGINT) AS gr, CAST(FLOOR(pcol/2) AS BIGINT) AS gc, STDDEV_POP(y) AS s FROM p3 GROUP BY ALL)),
ma AS (SELECT pair_id, SUM(LEAST(a.share, b.share)) AS agreement FROM pr JOIN mg a ON a.image_id = reference_id JOIN mg b ON b.image_id = render_id AND b.gr = a.gr AND b.gc = a.gc GROUP BY pair_id)"""


@query("mass_agreement", "PX-04", "PX-17", oracle=f"WITH {PREP}, {PAIRS}, {MASS} SELECT pair_id, RND(agreement,6) AS agreement FROM ma")
def mass_agreement(spark, sf_dir):
    grids = px.mass_grids(rgb(spark, sf_dir), rows=2, columns=4)
    return rounded(px.histogram_agreement(pairs(spark, sf_dir), grids, 1.0, ["grid_row", "grid_col"]).select("pair_id", "agreement"), 6, "agreement")


ENERGY = "e{s} AS (SELECT image_id, AVG(ABS(y-m)) AS energy FROM (SELECT image_id, y, AVG(y) OVER (PARTITION BY image_id, CAST(FLOOR(prow/{s}) AS BIGINT), CAST(FLOOR(pcol/{s}) AS BIGINT)) AS m FROM p3) GROUP BY image_id)"


@query("detail_energy", "PX-05", oracle=f"WITH {PREP}, {ENERGY.format(s=2)} SELECT image_id, RND(energy,6) AS energy FROM e2")
def detail_energy(spark, sf_dir):
    return rounded(px.detail_energy(rgb(spark, sf_dir), 2), 6, "energy")


@query("gradient_directions", "PX-06", oracle=f"""
WITH {PREP}, g AS (SELECT image_id, AVG(CASE pcol WHEN 0 THEN rt - y WHEN 7 THEN y - lf ELSE (rt - lf)/2e0 END) AS dx, AVG(CASE prow WHEN 0 THEN dn - y WHEN 7 THEN y - up ELSE (dn - up)/2e0 END) AS dy FROM (SELECT image_id, prow, pcol, y, LAG(y) OVER w AS lf, LEAD(y) OVER w AS rt, LAG(y) OVER v AS up, LEAD(y) OVER v AS dn FROM p3 WINDOW w AS (PARTITION BY image_id, prow ORDER BY pcol), v AS (PARTITION BY image_id, pcol ORDER BY prow)) GROUP BY image_id)
SELECT image_id, RND(dx/SQRT(dx*dx+dy*dy),5) AS dx, RND(dy/SQRT(dx*dx+dy*dy),5) AS dy FROM g""")
def gradient_directions(spark, sf_dir):
    return rounded(px.gradient_directions(rgb(spark, sf_dir)), 5, "dx", "dy")


@query("id_pass_regions", "PX-07", "STR-16", oracle="SELECT image_id, CAST(region AS BIGINT) AS index, COUNT(*) AS pixels, RND(COUNT(*)/64e0,6) AS coverage, CASE region WHEN 1 THEN 'M_wood_1' ELSE 'M_fabric_2' END AS name FROM fx_rgb WHERE region IN (1, 2) GROUP BY image_id, region")
def id_pass_regions(spark, sf_dir):
    indices = rgb(spark, sf_dir).select("image_id", px.decode_index(F.col("region"), F.lit(0)).alias("index"))
    names = spark.sql("SELECT * FROM VALUES (1L, 'M_wood_1'), (2L, 'M_fabric_2'), (3L, 'M_metal_3') AS t(index, name)")
    return rounded(px.regions(indices, names), 6, "coverage")


@query("decoded_passes", "STR-16", oracle="""
SELECT image_id, COUNT(*) FILTER (CAST(FLOOR(r*255) AS BIGINT) >= 255) AS beyond, RND(AVG(CASE WHEN FLOOR(r*255) < 255 THEN FLOOR(r*255)*20e0/255e0 END),4) AS mean_depth, RND(AVG(FLOOR(g*255)/255e0*2e0-1e0),5) AS mean_normal, MAX(CAST(FLOOR(r*255)+256*FLOOR(b*255) AS BIGINT)) AS top_index FROM fx_rgb GROUP BY image_id""")
def decoded_passes(spark, sf_dir):
    byte = lambda c: F.floor(F.col(c) * 255)
    rows = rgb(spark, sf_dir).select("image_id", byte("r").alias("r"), byte("g").alias("g"), byte("b").alias("b")).withColumn("depth", px.decode_depth(F.col("r"), 20.0))
    found = rows.groupBy("image_id").agg(F.count_if(F.col("depth").isNull()).alias("beyond"), F.avg("depth").alias("mean_depth"), F.avg(px.decode_normal(F.col("g"))).alias("mean_normal"), F.max(px.decode_index(F.col("r"), F.col("b"))).alias("top_index"))
    return rounded(rounded(found, 4, "mean_depth"), 5, "mean_normal")


@query("colour_axis", "PX-10", oracle=f"WITH {COLOUR} SELECT pair_id, RND(cst,4) AS cast, RND(LEAST(1e0,GREATEST(0e0,0.6e0*(1e0-LEAST(1e0,cst/40e0))+0.4e0*agreement)),5) AS score FROM ca")
def colour_axis(spark, sf_dir):
    return rounded(rounded(colour_scores(spark, sf_dir).select("pair_id", "cast", "score"), 4, "cast"), 5, "score")


def colour_scores(spark, sf_dir):
    pixels = rgb(spark, sf_dir)
    both = pairs(spark, sf_dir)
    return px.colour_axis(both, px.image_stats(pixels, ["image_id"]), px.histogram_agreement(both, px.histograms(pixels)))


@query("colour_findings", "PX-10", oracle=f"""
WITH {COLOUR} SELECT pair_id, 'cast' AS code, CASE WHEN ABS(db) >= ABS(da) THEN CASE WHEN db > 0 THEN 'warmer' ELSE 'cooler' END WHEN da > 0 THEN 'redder' ELSE 'greener' END AS direction, 'ColourPalette' AS subsystem, RND(cst,4) AS difference, RND(LEAST(1e0,cst/40e0),5) AS severity, 0.5e0 AS confidence FROM ca WHERE ROUND(cst,9) >= 8e0""")
def colour_findings(spark, sf_dir):
    return rounded(rounded(px.colour_findings(colour_scores(spark, sf_dir)), 4, "difference"), 5, "severity")


@query("region_colour_findings", "PX-10", oracle=f"""
WITH {PREP}, {PAIRS}, rs AS ({stats_sql('image_id, region')}), j AS (SELECT pair_id, a.region, a.pixels/64e0 AS cov, SQRT(POWER(a.lab_l-b.lab_l,2)+POWER(a.lab_a-b.lab_a,2)+POWER(a.lab_b-b.lab_b,2)) AS d FROM pr JOIN rs a ON a.image_id = reference_id JOIN rs b ON b.image_id = render_id AND b.region = a.region WHERE a.region IN (1, 2))
SELECT pair_id, region, RND(d,4) AS difference, RND(LEAST(1e0, LEAST(1e0,d/40e0)*(0.5e0+cov)),5) AS severity, 0.7e0 AS confidence, 'SurfaceFinish' AS subsystem FROM j WHERE ROUND(d,9) >= 6e0""")
def region_colour_findings(spark, sf_dir):
    stats = px.image_stats(rgb(spark, sf_dir).filter("region IN (1, 2)"), ["image_id", "region"]).withColumn("coverage", F.col("pixels") / 64)
    return rounded(rounded(px.region_colour_findings(pairs(spark, sf_dir), stats), 4, "difference"), 5, "severity")


LIGHT = f"{STATS}, {PAIRS}, lj AS (SELECT pair_id, b.exposure-a.exposure AS eg, b.contrast-a.contrast AS cg, b.warmth-a.warmth AS wg FROM pr JOIN st a ON a.image_id = reference_id JOIN st b ON b.image_id = render_id)"


@query("lighting_axis", "PX-11", oracle=f"WITH {LIGHT} SELECT pair_id, RND(eg,6) AS exposure_gap, RND(0.5e0*(1e0-LEAST(1e0,ABS(eg)/0.35e0))+0.3e0*(1e0-LEAST(1e0,ABS(cg)/0.2e0))+0.2e0*(1e0-LEAST(1e0,ABS(wg)/0.2e0)),5) AS score FROM lj")
def lighting_axis(spark, sf_dir):
    found = px.lighting_axis(pairs(spark, sf_dir), px.image_stats(rgb(spark, sf_dir), ["image_id"]))
    return rounded(rounded(found.select("pair_id", "exposure_gap", "score"), 6, "exposure_gap"), 5, "score")


@query("lighting_findings", "PX-11", oracle=f"""
WITH {LIGHT} SELECT pair_id, 'exposure' AS code, CASE WHEN eg < 0 THEN 'darker' ELSE 'brighter' END AS direction, RND(LEAST(1e0,ABS(eg)/0.35e0),5) AS severity FROM lj WHERE ROUND(ABS(eg),9) >= 0.06e0
UNION ALL SELECT pair_id, 'contrast', CASE WHEN cg < 0 THEN 'flatter' ELSE 'harsher' END, RND(LEAST(1e0,ABS(cg)/0.2e0)*0.7e0,5) FROM lj WHERE ROUND(ABS(cg),9) >= 0.05e0
UNION ALL SELECT pair_id, 'warmth', CASE WHEN wg < 0 THEN 'cooler' ELSE 'warmer' END, RND(LEAST(1e0,ABS(wg)/0.2e0)*0.8e0,5) FROM lj WHERE ROUND(ABS(wg),9) >= 0.05e0""")
def lighting_findings(spark, sf_dir):
    axis = px.lighting_axis(pairs(spark, sf_dir), px.image_stats(rgb(spark, sf_dir), ["image_id"]))
    return rounded(px.lighting_findings(axis).select("pair_id", "code", "direction", "severity"), 5, "severity")


ALBEDO_Y = " + ".join(f"{w}e0*{LIN.format(f'({c}*0.7e0)')}" for w, c in ((0.2126, "r"), (0.7152, "g"), (0.0722, "b")))


@query("shading_ratio", "PX-11", oracle=f"WITH {PREP} SELECT image_id, RND(AVG(y/a),5) AS shading FROM (SELECT image_id, y, {ALBEDO_Y} AS a FROM p3) q WHERE a > 0.02e0 GROUP BY image_id")
def shading_ratio(spark, sf_dir):
    pixels = rgb(spark, sf_dir)
    return rounded(px.shading_ratio(pixels, pixels.withColumns({c: F.col(c) * 0.7 for c in ("r", "g", "b")})), 5, "shading")


RS = "CASE WHEN {0} <= 0 THEN 0e0 ELSE LEAST(1e0, GREATEST(0e0, 1e0-ABS(LN({0}))/LN(4e0))) END"
MATERIAL = f"""{STATS}, {PAIRS}, {ENERGY.format(s=2)}, {ENERGY.format(s=4)},
mj AS (SELECT pair_id, CASE WHEN a.saturation <= 1e-6 THEN 1e0 ELSE b.saturation/a.saturation END AS rs, CASE WHEN a2.energy <= 1e-6 THEN 1e0 ELSE b2.energy/a2.energy END AS r2, CASE WHEN a4.energy <= 1e-6 THEN 1e0 ELSE b4.energy/a4.energy END AS r4 FROM pr JOIN st a ON a.image_id = reference_id JOIN st b ON b.image_id = render_id JOIN e2 a2 ON a2.image_id = reference_id JOIN e2 b2 ON b2.image_id = render_id JOIN e4 a4 ON a4.image_id = reference_id JOIN e4 b4 ON b4.image_id = render_id)"""


@query("material_axis", "PX-12", oracle=f"WITH {MATERIAL} SELECT pair_id, RND(({RS.format('r2')}+{RS.format('r4')})/2e0,5) AS texture, RND(0.5e0*({RS.format('r2')}+{RS.format('r4')})/2e0+0.5e0*{RS.format('rs')},5) AS score FROM mj")
def material_axis(spark, sf_dir):
    return rounded(material_scores(spark, sf_dir).select("pair_id", "texture", "score"), 5, "texture", "score")


def material_scores(spark, sf_dir):
    pixels = rgb(spark, sf_dir)
    return px.material_axis(pairs(spark, sf_dir), px.image_stats(pixels, ["image_id"]), {s: px.detail_energy(pixels, s) for s in (2, 4)})


@query("material_findings", "PX-12", oracle=f"WITH {MATERIAL} SELECT pair_id, CASE WHEN r2 < 1 THEN 'less' ELSE 'more' END AS direction, RND(LEAST(1e0,ABS(1e0-r2)/1.5e0)*0.8e0,5) AS severity FROM mj WHERE ROUND(r2,9) NOT BETWEEN 0.45e0 AND 2.2e0")
def material_findings(spark, sf_dir):
    return rounded(px.material_findings(material_scores(spark, sf_dir), 2).select("pair_id", "direction", "severity"), 5, "severity")


# -- camera ------------------------------------------------------------------------

FX["fx_views_of"] = """
SELECT v.viewpoint_id, p.object_id, 0.1e0 + CAST(p.object_id % 7 AS DOUBLE)*0.1e0 AS bx0, 0.3e0 + CAST(p.object_id % 7 AS DOUBLE)*0.1e0 AS bx1, 0.7e0 + CAST(p.object_id % 4 AS DOUBLE)*0.08e0 AS by1, p.x AS actual_x, p.y AS actual_y, v.x, v.y, v.z, v.yaw, v.pitch_deg, v.vfov_deg, v.aspect
FROM fx_viewpoints v JOIN fx_placed p ON p.building_id = v.building_id AND p.room_id = v.room_id WHERE p.support = 'floor'"""
CAM = """
c0 AS (SELECT *, RADIANS(yaw) AS w, RADIANS(90e0+pitch_deg) AS t, TAN(RADIANS(GREATEST(5e0,LEAST(150e0,vfov_deg)))/2e0) AS tv FROM fx_views_of),
c1 AS (SELECT *, tv*aspect AS th, -SIN(w)*SIN(t) AS f1, COS(w)*SIN(t) AS f2, -COS(t) AS f3, COS(w) AS r1, SIN(w) AS r2, -SIN(w)*COS(t) AS u1, COS(w)*COS(t) AS u2, SIN(t) AS u3 FROM c0),
c2 AS (SELECT *, ((bx0+bx1)/2e0*2e0-1e0)*th AS px, (1e0-by1*2e0)*tv AS py FROM c1),
c3 AS (SELECT *, f1+r1*px+u1*py AS d1, f2+r2*px+u2*py AS d2, f3+u3*py AS d3 FROM c2),
c4 AS (SELECT *, -z/d3 AS s FROM c3 WHERE ABS(d3/SQRT(d1*d1+d2*d2+d3*d3)) >= 1e-6 AND -z/d3 > 0),
c5 AS (SELECT *, x+d1*s AS ix, y+d2*s AS iy, (d1*s)*f1+(d2*s)*f2+(-z)*f3 AS dep FROM c4),
mv AS (SELECT viewpoint_id, object_id, ix, iy, dep, ix-actual_x AS ox, iy-actual_y AS oy FROM c5 WHERE dep > 1e-6 AND ROUND(dep,9) <= 12e0)"""


@query("displacements", "PX-13", "STR-15", oracle=f"WITH {CAM} SELECT viewpoint_id, object_id, RND(ix,5) AS implied_x, RND(iy,5) AS implied_y, RND(dep,5) AS range_m, RND(ox,5) AS off_x, RND(oy,5) AS off_y FROM mv")
def displacements(spark, sf_dir):
    return rounded(moved(spark, sf_dir), 5, "implied_x", "implied_y", "range_m", "off_x", "off_y")


def moved(spark, sf_dir):
    seen = fx(spark, sf_dir, "fx_views_of").select("viewpoint_id", "object_id", "bx0", "bx1", "by1", "actual_x", "actual_y")
    return px.displacements(seen, fx(spark, sf_dir, "fx_viewpoints"))


OFFSETS = f"""{CAM}, md AS (SELECT viewpoint_id, COUNT(*) AS n, MEDIAN(ox) AS mx, MEDIAN(oy) AS my FROM mv GROUP BY viewpoint_id),
ag AS (SELECT viewpoint_id, n, mx, my, COUNT(*) FILTER (ROUND(SQRT(POWER(ox-mx,2)+POWER(oy-my,2))-GREATEST(0.25e0,0.4e0*SQRT(mx*mx+my*my)),9) <= 0) AS a FROM mv JOIN md USING (viewpoint_id) GROUP BY ALL),
so AS (SELECT viewpoint_id, n AS objects, CASE WHEN n >= 3 THEN a ELSE 0 END AS agreeing, CASE WHEN n >= 3 THEN mx ELSE 0e0 END AS offset_x, CASE WHEN n >= 3 THEN my ELSE 0e0 END AS offset_y, n >= 3 AND ROUND(SQRT(mx*mx+my*my),9) >= 0.25e0 AND CAST(a AS DOUBLE)/n >= 0.7e0 AS systematic FROM ag)"""


@query("systematic_offsets", "PX-13", oracle=f"WITH {OFFSETS} SELECT viewpoint_id, objects, agreeing, RND(offset_x,5) AS offset_x, RND(offset_y,5) AS offset_y, systematic FROM so")
def systematic_offsets(spark, sf_dir):
    return rounded(px.systematic_offsets(moved(spark, sf_dir)), 5, "offset_x", "offset_y")


@query("layout_axis", "PX-13", oracle=f"""
WITH {OFFSETS}, ms AS (SELECT viewpoint_id, CAST(viewpoint_id % 10 AS DOUBLE)/20e0 + 0.3e0 AS agreement FROM fx_viewpoints), rs AS (SELECT viewpoint_id, SQRT(POWER(ox-CASE WHEN systematic THEN ROUND(offset_x,3) ELSE 0e0 END,2)+POWER(oy-CASE WHEN systematic THEN ROUND(offset_y,3) ELSE 0e0 END,2)) AS r FROM mv JOIN so USING (viewpoint_id)),
m AS (SELECT viewpoint_id, AVG(r) AS mean_residual, COUNT(*) AS k FROM rs GROUP BY 1)
SELECT viewpoint_id, RND(CASE WHEN k IS NULL THEN agreement ELSE 0.4e0*agreement+0.6e0*(1e0-LEAST(1e0,mean_residual/2e0)) END,4) AS score, CASE WHEN k IS NULL THEN 0.5e0 ELSE 0.8e0 END AS confidence, COALESCE(k, 0) AS measured_objects FROM ms LEFT JOIN m USING (viewpoint_id)""")
def layout_axis(spark, sf_dir):
    found = moved(spark, sf_dir)
    mass = fx(spark, sf_dir, "fx_viewpoints").select("viewpoint_id", ((F.col("viewpoint_id") % 10) / 20 + 0.3).alias("agreement"))
    return rounded(px.layout_axis(found, px.systematic_offsets(found), mass).select("viewpoint_id", "score", "confidence", "measured_objects"), 4, "score")


@query("projected_objects", "STR-15", oracle="""
WITH c0 AS (SELECT *, RADIANS(yaw) AS w, RADIANS(90e0+pitch_deg) AS t, TAN(RADIANS(vfov_deg)/2e0) AS tv FROM fx_views_of), o AS (SELECT *, (actual_x-x)*-SIN(w)*SIN(t)+(actual_y-y)*COS(w)*SIN(t)+(0.5e0-z)*-COS(t) AS d FROM c0)
SELECT viewpoint_id, object_id, RND(((( (actual_x-x)*COS(w)+(actual_y-y)*SIN(w))/(d*tv*aspect))+1e0)/2e0,4) AS u, RND(d,5) AS depth FROM o WHERE d > 0.05e0""")
def projected_objects(spark, sf_dir):
    u, _, depth = pj.project(pj.camera(), (F.col("actual_x"), F.col("actual_y"), F.lit(0.5)))
    rows = fx(spark, sf_dir, "fx_views_of").select("viewpoint_id", "object_id", u.alias("u"), depth.alias("depth")).filter("depth > 0.05")
    return rounded(rounded(rows, 4, "u"), 5, "depth")


OBJ = "oj AS (SELECT building_id, room_id, object_id, obj_group, confidence, uncertain, width, depth, height, CASE WHEN object_id % 3 = 0 THEN 'x' ELSE '' END AS asset, CAST(object_id % 10 AS DOUBLE)/10e0 AS asset_score FROM fx_coloured)"


def judged(spark, sf_dir):
    return fx(spark, sf_dir, "fx_coloured").withColumns({"asset": F.when(F.col("object_id") % 3 == 0, "x").otherwise(""), "asset_score": (F.col("object_id") % 10) / 10})


@query("objects_axis", "PX-14", oracle=f"""
WITH {OBJ}, g AS (SELECT building_id, room_id, COUNT(*) AS observed, COUNT(*) FILTER (uncertain OR width <= 0 OR depth <= 0 OR height <= 0) AS missing, COUNT(*) FILTER (NOT uncertain AND width > 0 AND depth > 0 AND height > 0 AND asset <> '' AND asset_score < 0.5e0) AS replaced FROM oj GROUP BY ALL)
SELECT *, RND(GREATEST(0e0, 1e0-(missing+0.5e0*replaced)/observed),6) AS score FROM g""")
def objects_axis(spark, sf_dir):
    return rounded(px.objects_axis(judged(spark, sf_dir), ["building_id", "room_id"]), 6, "score")


@query("missing_objects", "PX-14", oracle=f"""
WITH {OBJ}, n AS (SELECT room_id, COUNT(*) AS n FROM oj GROUP BY 1)
SELECT building_id, room_id, object_id, CASE WHEN uncertain OR confidence < 0.65e0 THEN 'ObjectDetection' ELSE 'AssetPlacement' END AS subsystem, RND(LEAST(1e0,0.4e0+0.6e0/n)*LEAST(1e0,0.35e0+width*depth/3e0)*CASE WHEN obj_group = 'decor' THEN 0.6e0 ELSE 1e0 END,5) AS severity FROM oj JOIN n USING (room_id) WHERE uncertain OR width <= 0 OR depth <= 0 OR height <= 0""")
def missing_objects(spark, sf_dir):
    return rounded(px.missing_objects(judged(spark, sf_dir), ["building_id", "room_id"]), 5, "severity")


@query("observed_in_view", "JN-22", oracle="""
WITH im AS (SELECT object_id, (object_id * 3) % 1500 AS image_id FROM fx_placed WHERE object_id % 2 = 0)
SELECT v.viewpoint_id, object_id FROM im JOIN fx_viewpoints v ON v.viewpoint_id = im.image_id UNION SELECT v.viewpoint_id, p.object_id FROM fx_placed p JOIN fx_viewpoints v USING (building_id, room_id) WHERE p.object_id % 2 = 1""")
def observed_in_view(spark, sf_dir):
    objects = fx(spark, sf_dir, "fx_placed")
    images = objects.filter("object_id % 2 = 0").select("object_id", ((F.col("object_id") * 3) % 1500).alias("image_id"))
    return px.observed_in_view(objects, images, fx(spark, sf_dir, "fx_viewpoints"))


@query("difference_cells", "PX-16", oracle=f"""
WITH {PREP}, {PAIRS} SELECT pair_id, CAST(FLOOR(a.prow/4) AS BIGINT) AS grid_row, CAST(FLOOR(a.pcol/4) AS BIGINT) AS grid_col, RND(AVG(SQRT(POWER(a.ll-b.ll,2)+POWER(a.la-b.la,2)+POWER(a.lbb-b.lbb,2))),4) AS mean_delta_e, RND(MAX(SQRT(POWER(a.ll-b.ll,2)+POWER(a.la-b.la,2)+POWER(a.lbb-b.lbb,2))),4) AS max_delta_e
FROM pr JOIN p3 a ON a.image_id = reference_id JOIN p3 b ON b.image_id = render_id AND b.prow = a.prow AND b.pcol = a.pcol GROUP BY ALL""")
def difference_cells(spark, sf_dir):
    pixels, both = rgb(spark, sf_dir), pairs(spark, sf_dir)
    side = lambda c: both.select("pair_id", F.col(c).alias("image_id")).join(pixels, "image_id")
    return rounded(px.difference_stats(side("reference_id"), side("render_id")), 4, "mean_delta_e", "max_delta_e")
