"""Room classification and appearance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims.rooms import ROOM_PRIORS
from ..fixtures import FX, fx
from ..operators import appearance as ap
from ..operators import rooms as rm
from ..operators import spatial as sp
from ..session import cut_lineage
from .evaluation import rounded
from .registry import query
from .spatial import OUTLINE, INSIDE, regions

LAYER_ROLES = ["plumbing_fixture", "casework", "appliance", "furniture", "stair", "plumbing"]
FX["fx_claims"] = """
SELECT p_partkey AS ordinal, r.building_id, r.room_id, CASE p_size % 9 WHEN 0 THEN 'master_bedroom' WHEN 1 THEN 'kitchen' WHEN 2 THEN 'bathroom' WHEN 3 THEN 'lounge' WHEN 4 THEN 'hallway' WHEN 5 THEN 'bedroom' WHEN 6 THEN 'living_room' ELSE 'office' END AS room_type,
 CONCAT('T', CAST(p_partkey AS VARCHAR(12))) AS text, 0.94e0 * (0.4e0 + CAST(p_partkey % 6 AS DOUBLE)/10e0) AS confidence, p_partkey % 17 = 0 AS from_attribute
FROM part CROSS JOIN (SELECT COUNT(*) AS n FROM supplier) c JOIN fx_rooms r ON r.room_id = p_partkey % n - CASE WHEN (p_partkey % n) % 10 % 3 = 1 THEN 1 ELSE 0 END"""
FX["fx_room_blocks"] = """
SELECT object_id, building_id, room_id - room_id % 2 AS room_id, category, CASE category WHEN 'toilet' THEN 'plumbing_fixture' WHEN 'cooktop' THEN 'kitchen_fixture' WHEN 'plant' THEN 'casework' ELSE 'furniture' END AS kind, ROUND(confidence*0.8e0,4) AS confidence FROM fx_placed"""
FX["fx_layer_roles"] = "SELECT r.building_id, r.room_id, " + "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LAYER_ROLES)) + """ END AS role, COUNT(*) AS n
FROM orders CROSS JOIN (SELECT COUNT(*) AS m FROM supplier) c JOIN fx_rooms r ON r.room_id = o_orderkey % m GROUP BY 1, 2, 3"""
FX["fx_readings"] = "SELECT building_id, room_id, CASE room_id % 4 WHEN 0 THEN room_type WHEN 1 THEN 'office' ELSE 'unknown' END AS room_type, CAST(room_id % 10 AS DOUBLE)/10e0 AS confidence FROM fx_rooms"


def measured(spark, sf_dir):
    area = regions(spark, sf_dir)
    rooms = area.select("building_id", "room_id", "area", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("depth"))
    counts = sp.opening_counts(fx(spark, sf_dir, "fx_openings"), area)
    return rooms.join(counts, ["building_id", "room_id"]).withColumn("openings_known", F.lit(True))


def evidence(spark, sf_dir, vision: bool = True):
    claims = fx(spark, sf_dir, "fx_claims")
    blocks = fx(spark, sf_dir, "fx_room_blocks")
    rows = [
        rm.attribute_evidence(claims.filter("from_attribute")), rm.label_evidence(claims.filter("NOT from_attribute")), rm.block_evidence(blocks),
        rm.layer_evidence(fx(spark, sf_dir, "fx_layer_roles"), blocks), rm.geometry_evidence(measured(spark, sf_dir))]
    if vision:
        rows.append(rm.vision_evidence(fx(spark, sf_dir, "fx_readings"), fx(spark, sf_dir, "fx_placed")))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


MEASURED = f"""
oc AS (SELECT r.room_id, COUNT(*) FILTER (kind = 'door') AS doors, COUNT(*) FILTER (kind = 'window') AS windows FROM fx_openings o JOIN fx_rooms r ON r.building_id = o.building_id AND (({OUTLINE}) <= 0.6e0 OR {INSIDE}) GROUP BY r.room_id),
me AS (SELECT building_id, room_id, area, x1-x0 AS width, y1-y0 AS depth, COALESCE(doors,0) AS doors, COALESCE(windows,0) AS windows FROM fx_rooms LEFT JOIN oc USING (room_id))"""
EVIDENCE = f"""{MEASURED},
cl AS (SELECT *, CASE WHEN room_type = 'master_bedroom' THEN 'bedroom' ELSE room_type END AS t FROM fx_claims),
gp AS (SELECT m.*, p.room_type AS label, p.* EXCLUDE (room_type) FROM me m CROSS JOIN dim_room_priors p),
ev AS (
 SELECT building_id, room_id, 'room_name_attribute' AS signal, 1 AS tier, ordinal, t AS label, 5e0 AS score, 1e0 AS weight, TRUE AS auth FROM cl WHERE from_attribute AND t IN (SELECT room_type FROM dim_room_priors)
 UNION ALL SELECT building_id, room_id, 'room_label', 4, ordinal, t, 4.5e0, GREATEST(0.5e0, confidence), TRUE FROM cl WHERE NOT from_attribute AND t IN (SELECT room_type FROM dim_room_priors)
 UNION ALL SELECT building_id, room_id, CASE WHEN kind IN ('plumbing_fixture','kitchen_fixture','appliance') THEN 'block_fixture' ELSE 'block_furniture' END, 2, 0, e.room_type, e.score, GREATEST(0.4e0, best)*(1e0+0.25e0*LN(n)), FALSE FROM (SELECT building_id, room_id, category, COUNT(*) AS n, MAX(confidence) AS best, MIN(kind) AS kind FROM fx_room_blocks GROUP BY ALL) b JOIN dim_object_evidence e USING (category)
 UNION ALL SELECT building_id, room_id, 'layer_role', 3, 0, e.room_type, e.score, LEAST(1e0, 0.5e0+0.1e0*n), FALSE FROM fx_layer_roles l JOIN dim_layer_evidence e USING (role) WHERE NOT (role IN ('plumbing_fixture','casework','appliance','furniture') AND EXISTS (SELECT 1 FROM fx_room_blocks b WHERE b.building_id = l.building_id AND b.room_id = l.room_id AND b.kind = l.role))
 UNION ALL SELECT building_id, room_id, 'area', 5, 0, label, CASE WHEN area BETWEEN area_lo AND area_hi THEN 1.2e0*EXP(-2e0*POWER(ABS(area-area_typical)/(area_hi-area_lo),2))+0.3e0 WHEN area < area_lo THEN GREATEST(-2.5e0, -1.2e0*(area_lo-area)/(area_lo*0.4e0)) ELSE GREATEST(-2.5e0, -1.2e0*(area-area_hi)/(area_hi*0.4e0)) END, 1e0, FALSE FROM gp
 UNION ALL SELECT building_id, room_id, 'aspect', 5, 0, label, CASE WHEN GREATEST(width,depth)/LEAST(width,depth) <= aspect_max THEN 0.25e0 ELSE GREATEST(-2e0, -(GREATEST(width,depth)/LEAST(width,depth)-aspect_max)/aspect_max) END, 1e0, FALSE FROM gp
 UNION ALL SELECT building_id, room_id, 'window_count', 5, 0, label, CASE WHEN windows = 0 THEN 2.4e0*(windowless-0.5e0) ELSE 1.2e0*(0.5e0-windowless) END, 1e0, FALSE FROM gp
 UNION ALL SELECT building_id, room_id, 'door_count', 5, 0, label, CASE WHEN doors >= 3 THEN CASE WHEN label IN ('hallway','staircase') THEN 1.2e0 ELSE -0.9e0 END WHEN doors = 1 AND label IN ('bathroom','bedroom','store','utility') THEN 0.5e0 ELSE 0e0 END, 1e0, FALSE FROM gp WHERE doors > 0
 UNION ALL SELECT building_id, room_id, 'vision', 6, 0, room_type, 3e0, GREATEST(0.3e0, confidence), FALSE FROM fx_readings WHERE confidence > 0 AND room_type IN (SELECT room_type FROM dim_room_priors)
 UNION ALL SELECT building_id, room_id, 'vision_object', 6, 0, e.room_type, e.score, 0.5e0*(1e0+0.2e0*LN(n)), FALSE FROM (SELECT building_id, room_id, category, COUNT(*) AS n FROM fx_placed GROUP BY ALL) v JOIN dim_object_evidence e USING (category))"""


def fuse_sql(ev: str, p: str) -> str:
    """Fusion of evidence table ``ev``; every CTE name starts with ``p``, the result is ``p``res."""
    order = "CASE label " + " ".join(f"WHEN '{r[0]}' THEN {i}" for i, r in enumerate(ROOM_PRIORS)) + " END"
    return f"""
{p}tot AS (SELECT r.building_id, r.room_id, t.room_type AS label, COALESCE(SUM(score*weight),0e0) AS total, COALESCE(SUM(score*weight) FILTER (NOT auth),0e0) AS ind, COUNT(*) FILTER (auth) AS claims
  FROM (SELECT DISTINCT building_id, room_id FROM {ev}) r CROSS JOIN dim_room_priors t LEFT JOIN {ev} e ON e.building_id = r.building_id AND e.room_id = r.room_id AND e.label = t.room_type GROUP BY ALL),
{p}pos AS (SELECT *, {order} AS o, EXP(total - MAX(total) OVER w)/SUM(EXP(total)) OVER w*EXP(MAX(total) OVER w) AS post, EXP(ind)/SUM(EXP(ind)) OVER w AS ip FROM {p}tot WINDOW w AS (PARTITION BY building_id, room_id)),
{p}prim AS (SELECT * FROM (SELECT building_id, room_id, signal, label AS stated, ROW_NUMBER() OVER (PARTITION BY building_id, room_id ORDER BY tier, -score, ordinal, signal, label) AS rn FROM {ev} WHERE auth) WHERE rn = 1),
{p}agg AS (SELECT building_id, room_id, ARG_MIN(label, -ROUND(post,12)*1000000e0 + o*0.000001e0) AS best, MAX(post) AS bestp, ARG_MIN(label, -ROUND(ip,12)*1000000e0 + o*0.000001e0) AS chal, MAX(ip) AS chalp, SUM(claims) AS nclaims, MAX(ABS(ind)) > 1e-9 AS anyind FROM {p}pos GROUP BY ALL),
{p}own AS (SELECT a.*, signal, stated, (SELECT ind FROM {p}pos x WHERE x.building_id = a.building_id AND x.room_id = a.room_id AND x.label = stated) AS own, (SELECT MAX(ind) FROM {p}pos x WHERE x.building_id = a.building_id AND x.room_id = a.room_id AND x.label <> stated) AS oth,
  (SELECT claims FROM {p}pos x WHERE x.building_id = a.building_id AND x.room_id = a.room_id AND x.label = stated) AS same, (SELECT SUM(post) FROM {p}pos x WHERE x.building_id = a.building_id AND x.room_id = a.room_id AND x.label <> stated) AS rest FROM {p}agg a LEFT JOIN {p}prim USING (building_id, room_id)),
{p}dec AS (SELECT *, CASE WHEN stated IS NULL THEN 0 ELSE nclaims - same END AS split, COALESCE(stated IS NOT NULL AND anyind AND chal <> stated AND chalp > 0.5e0, FALSE) AS contested FROM {p}own),
{p}conf AS (SELECT *, CASE WHEN stated IS NOT NULL THEN GREATEST(0e0, LEAST(0.99e0, 0.90e0 + 0.09e0*GREATEST(-1e0, LEAST(1e0, (own-oth)/3e0)) - CASE WHEN split > 0 THEN 0.15e0 ELSE 0e0 END - CASE WHEN contested THEN 0.10e0 ELSE 0e0 END)) ELSE LEAST(bestp, 0.99e0) END AS c FROM {p}dec),
{p}fin AS (SELECT x.building_id, x.room_id, x.label, CASE WHEN stated IS NULL THEN post WHEN x.label = stated THEN c ELSE post/rest*(1e0-c) END AS fp, CASE WHEN x.label = stated THEN -1 ELSE o END AS fo FROM {p}pos x JOIN {p}conf USING (building_id, room_id)),
{p}run AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY building_id, room_id ORDER BY ROUND(fp,12) DESC, fo) AS rn FROM {p}fin) WHERE rn = 2),
{p}res AS (SELECT q.building_id, q.room_id, CASE WHEN stated IS NOT NULL THEN stated WHEN c >= 0.30e0 THEN best ELSE 'unknown' END AS label, CASE WHEN stated IS NOT NULL OR c >= 0.30e0 THEN c ELSE 0e0 END AS confidence, COALESCE(signal, '') AS decided_by, r.label AS runner_up, r.fp AS runner_up_confidence, CAST(split AS BIGINT) AS authority_conflicts, contested, stated IS NULL AND c >= 0.30e0 AND c - r.fp < 0.08e0 AS near_tie
  FROM {p}conf q JOIN {p}run r USING (building_id, room_id))"""


ADJ = f"""
av AS (SELECT building_id, room_id AS a_id, sx AS x, sy AS y FROM fx_walls),
ap AS (SELECT DISTINCT av.building_id, a_id, r.room_id AS b_id FROM av JOIN fx_rooms r ON r.building_id = av.building_id AND a_id < r.room_id AND ({OUTLINE}) <= 1e0),
adj AS (SELECT building_id, a_id AS room_id, b_id AS neighbour_id FROM ap UNION ALL SELECT building_id, b_id, a_id FROM ap)"""
DEPTH = """
dg AS (SELECT m.building_id, m.room_id, doors, COUNT(neighbour_id) AS deg FROM me m LEFT JOIN adj a ON a.building_id = m.building_id AND a.room_id = m.room_id GROUP BY ALL),
sr AS (SELECT building_id, room_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY building_id ORDER BY doors DESC, deg DESC, room_id) AS rn, COUNT(*) OVER (PARTITION BY building_id) AS n FROM dg) WHERE rn = 1 AND n >= 4),
walk(building_id, room_id, hops) AS (SELECT building_id, room_id, 0 FROM sr UNION SELECT w.building_id, a.neighbour_id, w.hops + 1 FROM walk w JOIN adj a ON a.building_id = w.building_id AND a.room_id = w.room_id WHERE w.hops < 12),
hop AS (SELECT building_id, room_id, MIN(hops) AS hops FROM walk GROUP BY ALL),
dep AS (SELECT m.building_id, m.room_id, COALESCE(CASE WHEN far > 0 THEN CAST(hops AS DOUBLE)/far END, -1e0) AS depth_normalised FROM me m LEFT JOIN hop USING (building_id, room_id) LEFT JOIN (SELECT building_id, MAX(hops) AS far FROM hop GROUP BY 1) f USING (building_id))"""
TOPOLOGY = """
tp AS (SELECT * FROM ev UNION ALL SELECT building_id, room_id, 'adjacency', 5, 0, label, LEAST(2e0, SUM(0.7e0*w.weight)), 1e0, FALSE FROM (SELECT a.building_id, a.room_id, r.label AS neighbour_type FROM adj a JOIN f1_res r ON r.building_id = a.building_id AND r.room_id = a.neighbour_id WHERE r.label <> 'unknown') x JOIN (SELECT room_type AS label, neighbour_type, weight FROM dim_room_adjacency) w USING (neighbour_type) GROUP BY building_id, room_id, label
 UNION ALL SELECT building_id, room_id, 'privacy_depth', 5, 0, room_type, 0.6e0*(1e0-2e0*ABS(privacy-depth_normalised)), 1e0, FALSE FROM dep CROSS JOIN dim_room_priors WHERE depth_normalised >= 0)"""
RESULT = "building_id, room_id, label, RND(confidence,4) AS confidence, decided_by, runner_up, RND(runner_up_confidence,4) AS runner_up_confidence, authority_conflicts, contested, near_tie"


def adjacency(spark, sf_dir):
    return sp.region_adjacency(regions(spark, sf_dir), reach=1.0)


def classified(spark, sf_dir):
    rooms = measured(spark, sf_dir)
    depth = rm.infer_depths(rooms, adjacency(spark, sf_dir))
    return rm.classify(evidence(spark, sf_dir), depth, adjacency(spark, sf_dir))


def shown(df):
    return rounded(df, 4, "confidence", "runner_up_confidence")


@query("room_evidence", "AG-01", "JN-04", oracle=f"WITH {EVIDENCE} SELECT building_id, room_id, signal, label, RND(SUM(score*weight),6) AS strength, COUNT(*) AS items FROM ev GROUP BY ALL")
def room_evidence(spark, sf_dir):
    rows = evidence(spark, sf_dir).groupBy("building_id", "room_id", "signal", "label").agg(F.sum(F.col("score") * F.col("weight")).alias("strength"), F.count("*").alias("items"))
    return rounded(rows, 6, "strength")


@query("evidence_fusion", "AG-02", oracle=f"WITH {EVIDENCE}, {fuse_sql('ev', 'f1_')} SELECT {RESULT} FROM f1_res")
def evidence_fusion(spark, sf_dir):
    return shown(rm.fuse(evidence(spark, sf_dir)))


@query("evidence_reasons", "AG-02", oracle=f"""
WITH {EVIDENCE}, {fuse_sql('ev', 'f1_')}, x AS (SELECT e.building_id, e.room_id, signal, ABS(score*weight) AS s FROM ev e JOIN f1_res r ON r.building_id = e.building_id AND r.room_id = e.room_id AND r.label = e.label WHERE ABS(score*weight) >= 0.05e0)
SELECT building_id, room_id, RND(MAX(s),6) AS strongest FROM x GROUP BY ALL""")
def evidence_reasons(spark, sf_dir):
    rows = cut_lineage(evidence(spark, sf_dir))
    return rounded(rm.explain(rows, rm.fuse(rows)).groupBy("building_id", "room_id").agg(F.max("strength").alias("strongest")), 6, "strongest")


@query("plan_depths", "GR-07", oracle=f"WITH RECURSIVE {MEASURED}, {ADJ}, {DEPTH} SELECT building_id, room_id, RND(depth_normalised,6) AS depth_normalised FROM dep")
def plan_depths(spark, sf_dir):
    return rounded(rm.infer_depths(measured(spark, sf_dir), adjacency(spark, sf_dir)), 6, "depth_normalised")


@query("room_classification", "AG-03", "AG-30", oracle=f"WITH RECURSIVE {EVIDENCE}, {ADJ}, {DEPTH}, {fuse_sql('ev', 'f1_')}, {TOPOLOGY}, {fuse_sql('tp', 'f2_')} SELECT {RESULT} FROM f2_res")
def room_classification(spark, sf_dir):
    return shown(classified(spark, sf_dir))


@query("uniqueness_conflicts", "AG-04", oracle=f"""
WITH {EVIDENCE}, {fuse_sql('ev', 'f1_')}, k AS (SELECT r.building_id, room_id, label, FIRST_VALUE(room_id) OVER (PARTITION BY r.building_id, label ORDER BY ROUND(confidence,4) DESC, room_id) AS winner_id FROM f1_res r JOIN dim_room_priors p ON p.room_type = r.label AND NOT repeatable)
SELECT building_id, room_id, label AS claimed, winner_id, 0.4e0 AS severity FROM k WHERE room_id <> winner_id""")
def uniqueness_conflicts(spark, sf_dir):
    return rm.uniqueness_conflicts(rm.fuse(evidence(spark, sf_dir)))


@query("area_conflicts", "AG-05", oracle="""
WITH d AS (SELECT building_id, room_id, area, area*(0.4e0 + CAST(room_id % 9 AS DOUBLE)*0.3e0) AS s FROM fx_rooms)
SELECT building_id, room_id, RND(GREATEST(area,s)/LEAST(area,s),6) AS ratio, RND(LEAST(0.95e0, 0.3e0+0.1e0*GREATEST(area,s)/LEAST(area,s)),6) AS severity, s > area AS lost FROM d WHERE GREATEST(area,s)/LEAST(area,s) > 1.5e0""")
def area_conflicts(spark, sf_dir):
    rooms = fx(spark, sf_dir, "fx_rooms").withColumn("declared_area", F.col("area") * (0.4 + (F.col("room_id") % 9) * 0.3))
    return rounded(rm.area_conflicts(rooms), 6, "ratio", "severity")


@query("classification_summary", "AG-30", oracle=f"""
WITH {EVIDENCE}, {fuse_sql('ev', 'f1_')} SELECT building_id, COUNT(*) AS rooms, COUNT(*) FILTER (label <> 'unknown') AS identified, COUNT(*) FILTER (label = 'unknown') AS unidentified, COUNT(*) FILTER (ROUND(confidence,4) >= 0.65e0) AS confident,
 RND(AVG(ROUND(confidence,4)),3) AS mean_confidence, CAST(SUM(authority_conflicts + CAST(contested AS INTEGER) + CAST(near_tie AS INTEGER)) AS BIGINT) AS conflicts FROM f1_res GROUP BY building_id""")
def classification_summary(spark, sf_dir):
    return rounded(rm.classification_summary(rm.fuse(evidence(spark, sf_dir))), 3, "mean_confidence")


@query("specific_room_types", "AG-30", oracle=f"""
WITH {EVIDENCE}, {fuse_sql('ev', 'f1_')}, m AS (SELECT DISTINCT building_id, room_id FROM fx_claims WHERE NOT from_attribute AND room_type = 'master_bedroom')
SELECT r.building_id, r.room_id, label, CASE WHEN label = 'bedroom' AND m.room_id IS NOT NULL THEN 'master_bedroom' ELSE '' END AS specific_type FROM f1_res r LEFT JOIN m USING (building_id, room_id)""")
def specific_room_types(spark, sf_dir):
    labels = fx(spark, sf_dir, "fx_claims").filter("NOT from_attribute")
    return rm.specific_types(rm.fuse(evidence(spark, sf_dir)), labels).select("building_id", "room_id", "label", "specific_type")


@query("layer_role_counts", "JN-05", oracle=f"""
WITH s AS (SELECT object_id, building_id, x, y, CASE object_id % 6 WHEN 0 THEN 'plumbing_fixture' WHEN 1 THEN 'casework' WHEN 2 THEN 'wall' WHEN 3 THEN 'furniture' WHEN 4 THEN 'stair' ELSE 'plumbing' END AS role FROM fx_objects)
SELECT r.building_id, r.room_id, role, COUNT(*) AS n FROM s JOIN fx_rooms r ON r.building_id = s.building_id AND {INSIDE} WHERE role <> 'wall' GROUP BY ALL""")
def layer_role_counts(spark, sf_dir):
    names = F.element_at(F.array(*[F.lit(x) for x in ("plumbing_fixture", "casework", "wall", "furniture", "stair", "plumbing")]), (F.col("object_id") % 6 + 1).cast("int"))
    points = fx(spark, sf_dir, "fx_objects").withColumn("role", names).filter(F.col("role").isin(*LAYER_ROLES)).select("building_id", "role", "x", "y", "object_id")
    inside = sp.assign_regions(points, "object_id", regions(spark, sf_dir), 1e-9).filter("inside")
    return points.join(inside.select("building_id", "object_id", "room_id"), ["building_id", "object_id"]).groupBy("building_id", "room_id", "role").agg(F.count("*").alias("n"))


@query("label_attribution", "JN-04", oracle=f"""
WITH t AS (SELECT object_id, building_id, x, y, CAST(object_id % 50 AS DOUBLE) AS declared FROM fx_objects), c AS (SELECT object_id, declared, r.building_id, r.room_id, area, {INSIDE} AS inside, {OUTLINE} AS d FROM t JOIN fx_rooms r USING (building_id)),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY object_id ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN area ELSE d END, room_id) AS rn FROM c WHERE inside OR d <= 1.5e0)
SELECT building_id, room_id, COUNT(*) AS labels, MAX(declared) AS declared_area FROM k WHERE rn = 1 GROUP BY ALL""")
def label_attribution(spark, sf_dir):
    texts = fx(spark, sf_dir, "fx_objects").withColumn("declared", (F.col("object_id") % 50).cast("double"))
    found = sp.assign_regions(texts, "object_id", regions(spark, sf_dir), sp.LABEL_TOLERANCE)
    return texts.select("object_id", "building_id", "declared").join(found, ["building_id", "object_id"]).groupBy("building_id", "room_id").agg(
        F.count("*").alias("labels"), F.max("declared").alias("declared_area"))


# -- appearance ------------------------------------------------------------------

RGB = "CAST(CONCAT('0x', SUBSTRING({0},2,2)) AS INTEGER)", "CAST(CONCAT('0x', SUBSTRING({0},4,2)) AS INTEGER)", "CAST(CONCAT('0x', SUBSTRING({0},6,2)) AS INTEGER)"


def hex_sql(r: str, g: str, b: str) -> str:
    one = lambda c: f"CAST(ROUND(LEAST(255e0, GREATEST(0e0, {c}))) AS INTEGER)"
    return f"PRINTF('#%02X%02X%02X', {one(r)}, {one(g)}, {one(b)})"


def mix_sql(col: str, weight: str) -> str:
    return hex_sql(*[f"SQRT(SUM(POWER({c.format(col)},2)*{weight})/SUM(CASE WHEN {col} IS NOT NULL THEN {weight} END))" for c in RGB])


def kelvin_sql(k: str) -> str:
    t = f"(LEAST(10000e0, GREATEST(1500e0, {k}))/100e0)"
    clip = lambda c: f"LEAST(255e0, GREATEST(0e0, {c}))"
    return hex_sql(f"CASE WHEN {t} <= 66 THEN 255e0 ELSE {clip(f'329.7e0*POWER(GREATEST({t}-60,1), -0.1332e0)')} END",
                   f"CASE WHEN {t} <= 66 THEN {clip(f'99.47e0*LN({t})-161.12e0')} ELSE {clip(f'288.12e0*POWER(GREATEST({t}-60,1), -0.0755e0)')} END",
                   f"CASE WHEN {t} >= 66 THEN 255e0 WHEN {t} <= 19 THEN 0e0 ELSE {clip(f'138.52e0*LN(GREATEST({t}-10,1))-305.04e0')} END")


def dist_sql(a: str, b: str) -> str:
    (ra, ga, ba), (rb, gb, bb) = [[c.format(x) for c in RGB] for x in (a, b)]
    return f"LEAST(1e0, SQRT((2e0+({ra}+{rb})/512e0)*POWER({ra}-{rb},2) + 4e0*POWER({ga}-{gb},2) + (2e0+(255e0-({ra}+{rb})/2e0)/256e0)*POWER({ba}-{bb},2))/764e0)"


def sat_sql(c: str) -> str:
    r, g, b = [f"({x.format(c)}/255e0)" for x in RGB]
    hi, lo = f"GREATEST({r},{g},{b})", f"LEAST({r},{g},{b})"
    return f"CASE WHEN {hi} = {lo} THEN 0e0 WHEN ({hi}+{lo})/2e0 <= 0.5e0 THEN ({hi}-{lo})/({hi}+{lo}) ELSE ({hi}-{lo})/(2e0-{hi}-{lo}) END"


@query("dominant_style", "AG-14", oracle="""
WITH s AS (SELECT building_id, style, SUM(GREATEST(area,1e0)*GREATEST(style_confidence,0.2e0)) AS score FROM fx_rooms WHERE style <> 'unknown' GROUP BY ALL), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY building_id ORDER BY ROUND(score,9) DESC, style) AS rn, SUM(score) OVER (PARTITION BY building_id) AS t FROM s)
SELECT building_id, style, RND(score/t,3) AS share FROM k WHERE rn = 1""")
def dominant_style(spark, sf_dir):
    return rounded(ap.dominant_style(fx(spark, sf_dir, "fx_rooms")), 3, "share")


@query("style_confidence", "AG-15", oracle="""
WITH fam AS (SELECT DISTINCT style, COALESCE(family, 'unknown') AS family FROM dim_style_materials LEFT JOIN dim_materials USING (material)), n AS (SELECT style, COUNT(*) AS n FROM fam GROUP BY style),
seen AS (SELECT DISTINCT p.room_id, family FROM fx_placed p JOIN dim_materials USING (material) WHERE family <> 'unknown'), h AS (SELECT r.room_id, COUNT(fam.family) AS hits, COUNT(seen.family) AS seen FROM fx_rooms r LEFT JOIN seen USING (room_id) LEFT JOIN fam ON fam.style = r.style AND fam.family = seen.family GROUP BY r.room_id)
SELECT building_id, room_id, style, RND(CASE WHEN style = 'unknown' THEN 0e0 ELSE LEAST(1e0, 0.55e0 + CASE WHEN seen > 0 THEN 0.45e0*LEAST(1e0, CAST(hits AS DOUBLE)/n*1.5e0) ELSE 0e0 END) END,3) AS confidence FROM fx_rooms JOIN h USING (room_id) LEFT JOIN n USING (style)""")
def style_confidence(spark, sf_dir):
    return rounded(ap.style_confidence(fx(spark, sf_dir, "fx_rooms"), fx(spark, sf_dir, "fx_placed")), 3, "confidence")


@query("room_palettes", "AG-16", "STR-12", oracle=f"""
WITH o AS (SELECT c.*, wall_hex, floor_hex, obj_group = 'furniture' AS f, obj_group IN ('decor','appliance') AS d, GREATEST(width*depth, 0.01e0) AS a FROM fx_coloured c JOIN fx_finished_rooms r USING (building_id, room_id) WHERE color_hex IS NOT NULL),
acc AS (SELECT *, ROUND({sat_sql('color_hex')},9) AS s FROM o WHERE (f OR d)), ak AS (SELECT room_id, color_hex AS hex, ROW_NUMBER() OVER (PARTITION BY room_id ORDER BY s DESC, CASE WHEN d THEN 0 ELSE 1 END, object_id) AS rn FROM acc WHERE s > 0 AND (wall_hex IS NULL OR {dist_sql('color_hex', 'wall_hex')} >= 0.08e0) AND (floor_hex IS NULL OR {dist_sql('color_hex', 'floor_hex')} >= 0.08e0)),
fm AS (SELECT room_id, {mix_sql('color_hex', 'a')} AS hex FROM o WHERE f GROUP BY room_id), dm AS (SELECT room_id, {mix_sql('color_hex', '1e0')} AS hex FROM o WHERE d GROUP BY room_id),
lk AS (SELECT room_id, SUM(kelvin*GREATEST(power_w,1e0))/SUM(GREATEST(power_w,1e0)) AS k FROM fx_lights GROUP BY room_id),
j AS (SELECT r.building_id, r.room_id, wall_hex, floor_hex, COALESCE(fm.hex, '#B5AFA5') AS shade, fm.hex IS NOT NULL AS hf, dm.hex AS dhex, ak.hex AS ahex, COALESCE(k, 3400e0) AS k FROM fx_finished_rooms r LEFT JOIN fm USING (room_id) LEFT JOIN dm USING (room_id) LEFT JOIN ak ON ak.room_id = r.room_id AND rn = 1 LEFT JOIN lk USING (room_id)),
q AS (SELECT *, CAST(wall_hex IS NOT NULL AS INTEGER) + CAST(floor_hex IS NOT NULL AS INTEGER) + CAST(hf AS INTEGER) + CAST(dhex IS NOT NULL AS INTEGER) AS n FROM j)
SELECT building_id, room_id, COALESCE(wall_hex, floor_hex, shade) AS primary_hex, COALESCE(floor_hex, wall_hex, shade) AS secondary_hex, COALESCE(ahex, '#9AA5AE') AS accent_hex, {kelvin_sql('k')} AS lighting_hex, shade AS furniture_hex, COALESCE(dhex, shade) AS decor_hex, RND(0.25e0*n,3) AS confidence FROM q WHERE n > 0""")
def room_palettes(spark, sf_dir):
    objects = fx(spark, sf_dir, "fx_coloured")
    return rounded(ap.derive_palettes(fx(spark, sf_dir, "fx_finished_rooms"), objects, fx(spark, sf_dir, "fx_lights")), 3, "confidence")


@query("style_palettes", "AG-16", oracle=f"""
SELECT building_id, room_id, color_1 AS primary_hex, color_2 AS secondary_hex, color_3 AS accent_hex, {kelvin_sql("CASE lighting WHEN 'warm' THEN 2700e0 WHEN 'cool' THEN 4200e0 ELSE 3400e0 END")} AS lighting_hex, {hex_sql(*[f"SQRT((POWER({c.format('color_1')},2)+POWER({c.format('color_2')},2))/2e0)" for c in RGB])} AS furniture_hex, color_3 AS decor_hex, 0.25e0 AS confidence FROM fx_rooms JOIN dim_styles USING (style) WHERE color_1 IS NOT NULL""")
def style_palettes(spark, sf_dir):
    return ap.style_palettes(fx(spark, sf_dir, "fx_rooms"))


@query("room_lighting", "AG-17", oracle="""
WITH w AS (SELECT building_id, room_id, SUM(width*height) AS glazed FROM fx_openings WHERE kind = 'window' AND room_id IS NOT NULL GROUP BY ALL), wl AS (SELECT * FROM (SELECT room_id, x, y, ROW_NUMBER() OVER (PARTITION BY room_id ORDER BY ROUND(width*height,9) DESC, opening_id) AS rn FROM fx_openings WHERE kind = 'window' AND room_id IS NOT NULL) WHERE rn = 1),
l AS (SELECT building_id, room_id, SUM(CASE WHEN uncertain THEN 0e0 ELSE power_w END) AS p, SUM(kelvin*GREATEST(power_w,1e0))/SUM(GREATEST(power_w,1e0)) AS k FROM fx_lights GROUP BY ALL),
a AS (SELECT r.*, wl.x AS wx, wl.y AS wy, k, LEAST(0.85e0, COALESCE(glazed,0e0)/GREATEST(area,1e0)/0.18e0*0.45e0) AS d, LEAST(1e0, COALESCE(p,0e0)/GREATEST(area,1e0)/4e0) AS f FROM fx_finished_rooms r LEFT JOIN w USING (building_id, room_id) LEFT JOIN l USING (building_id, room_id) LEFT JOIN wl USING (room_id)),
t AS (SELECT *, COALESCE(time_of_day, CASE WHEN ROUND(d,9) >= 0.35e0 THEN 'day' WHEN ROUND(d,9) <= 0.05e0 AND ROUND(f,9) > 0.4e0 THEN 'night' WHEN ROUND(f-d*1.5e0,9) > 0 THEN 'evening' ELSE 'day' END) AS tod FROM a),
c AS (SELECT *, CASE tod WHEN 'night' THEN 0e0 WHEN 'evening' THEN d*0.25e0 ELSE d END AS wc FROM t), e AS (SELECT *, LEAST(1e0, 0.15e0+0.55e0*wc+0.45e0*f) AS amb FROM c)
SELECT building_id, room_id, RND(CASE tod WHEN 'night' THEN LEAST(amb,0.45e0) WHEN 'overcast' THEN LEAST(amb,0.7e0) ELSE amb END,3) AS ambient, RND(CASE WHEN wx IS NULL THEN -1e0 ELSE DEGREES(ATAN2(wy-(y0+y1)/2e0, wx-(x0+x1)/2e0)) + CASE WHEN ATAN2(wy-(y0+y1)/2e0, wx-(x0+x1)/2e0) < 0 THEN 360e0 ELSE 0e0 END END,2) AS daylight_direction,
 CASE tod WHEN 'day' THEN 45e0 WHEN 'overcast' THEN 30e0 WHEN 'evening' THEN 8e0 ELSE -10e0 END AS daylight_elevation, RND(wc,3) AS window_contribution, RND(CASE WHEN tod = 'day' AND ROUND(wc,9) > 0.3e0 THEN COALESCE(k,3400e0)*(1e0-wc)+6200e0*wc ELSE COALESCE(k,3400e0) END,1) AS color_temperature_k,
 RND(LEAST(1e0, 0.3e0+0.5e0*wc+CASE WHEN tod = 'overcast' THEN 0.2e0 ELSE 0e0 END),3) AS shadow_softness, tod AS time_of_day, RND(LEAST(1e0, 0.3e0 + CASE WHEN wx IS NOT NULL THEN 0.25e0 ELSE 0e0 END + CASE WHEN k IS NOT NULL THEN 0.25e0 ELSE 0e0 END + CASE WHEN time_of_day IS NOT NULL THEN 0.2e0 ELSE 0e0 END),3) AS confidence FROM e""")
def room_lighting(spark, sf_dir):
    found = ap.derive_lighting(fx(spark, sf_dir, "fx_finished_rooms"), fx(spark, sf_dir, "fx_lights"), fx(spark, sf_dir, "fx_openings"))
    return rounded(rounded(rounded(found, 3, "ambient", "window_contribution", "shadow_softness", "confidence"), 2, "daylight_direction"), 1, "color_temperature_k")


@query("contents_room_type", "AG-13", oracle="""
WITH p AS (SELECT DISTINCT building_id, room_id, category FROM fx_placed), h AS (SELECT building_id, room_id, room_type, COUNT(*) AS n FROM p JOIN dim_room_markers USING (category) GROUP BY ALL),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY building_id, room_id ORDER BY n DESC, room_type) AS rn, SUM(n) OVER (PARTITION BY building_id, room_id) AS t FROM h)
SELECT q.building_id, q.room_id, COALESCE(k.room_type, 'unknown') AS room_type, RND(COALESCE(CAST(n AS DOUBLE)/t, 0e0),3) AS confidence FROM (SELECT DISTINCT building_id, room_id FROM p) q LEFT JOIN k ON k.building_id = q.building_id AND k.room_id = q.room_id AND rn = 1""")
def contents_room_type(spark, sf_dir):
    return rounded(rm.contents_type(fx(spark, sf_dir, "fx_placed")), 3, "confidence")


@query("reconciled_room_type", "AG-13", oracle="""
WITH i AS (SELECT building_id, room_id, room_type AS declared, style_confidence AS dc, CASE room_id % 4 WHEN 0 THEN 'kitchen' WHEN 1 THEN 'bedroom' ELSE 'unknown' END AS inf, CASE room_id % 4 WHEN 0 THEN 0.7e0 WHEN 1 THEN 0.55e0 ELSE 0e0 END AS ic FROM fx_rooms)
SELECT building_id, room_id, CASE WHEN declared = 'unknown' THEN inf WHEN inf = 'unknown' THEN declared ELSE inf END AS room_type, RND(CASE WHEN declared = 'unknown' THEN ic WHEN inf = 'unknown' THEN dc WHEN declared = inf THEN LEAST(0.99e0, GREATEST(ic, 0.6e0)+0.2e0) ELSE ic*0.8e0 END,4) AS confidence FROM i""")
def reconciled_room_type(spark, sf_dir):
    rows = fx(spark, sf_dir, "fx_rooms").withColumns({
        "inf": F.when(F.col("room_id") % 4 == 0, "kitchen").when(F.col("room_id") % 4 == 1, "bedroom").otherwise("unknown"),
        "ic": F.when(F.col("room_id") % 4 == 0, 0.7).when(F.col("room_id") % 4 == 1, 0.55).otherwise(0.0)})
    kind, confidence = rm.reconcile_type(F.col("room_type"), F.col("style_confidence"), F.col("inf"), F.col("ic"))
    return rounded(rows.select("building_id", "room_id", kind.alias("room_type"), confidence.alias("confidence")), 4, "confidence")


ASSETS = """
vf AS (SELECT asset_no, LIST(DISTINCT COALESCE(family,'unknown')) AS fams FROM (SELECT asset_no, UNNEST(STR_SPLIT(materials, ' ')) AS material FROM dim_assets WHERE materials <> '') x LEFT JOIN dim_materials USING (material) GROUP BY asset_no),
vc AS (SELECT category, COUNT(*) AS nv FROM dim_assets GROUP BY category),
ob AS (SELECT c.*, style, COALESCE(family, 'unknown') AS fam FROM fx_coloured c JOIN fx_rooms r USING (building_id, room_id) LEFT JOIN dim_materials m ON m.material = c.material),
lum AS (SELECT *, CASE WHEN color_hex IS NULL THEN 'light' WHEN (0.2126e0*CAST(CONCAT('0x',SUBSTRING(color_hex,2,2)) AS INTEGER)+0.7152e0*CAST(CONCAT('0x',SUBSTRING(color_hex,4,2)) AS INTEGER)+0.0722e0*CAST(CONCAT('0x',SUBSTRING(color_hex,6,2)) AS INTEGER))/255e0 > 0.66e0 THEN 'light'
  WHEN (0.2126e0*CAST(CONCAT('0x',SUBSTRING(color_hex,2,2)) AS INTEGER)+0.7152e0*CAST(CONCAT('0x',SUBSTRING(color_hex,4,2)) AS INTEGER)+0.0722e0*CAST(CONCAT('0x',SUBSTRING(color_hex,6,2)) AS INTEGER))/255e0 < 0.30e0 THEN 'dark' ELSE 'mid' END AS tn, LOWER(CONCAT(style, ' ', label)) AS txt FROM ob),
sc AS (SELECT object_id, v.asset_no, asset, builder, CASE WHEN nv = 1 THEN 1e0 ELSE RND(
  0.45e0*CASE WHEN height <= 1e-6 THEN 0.5e0 ELSE GREATEST(0e0, 1e0-(ABS(width/height-sig_w)/GREATEST(width/height,sig_w)+ABS(depth/height-sig_d)/GREATEST(depth/height,sig_d))/2e0) END
  + 0.25e0*CASE WHEN styles = '' THEN 0.6e0 WHEN LEN(LIST_FILTER(STR_SPLIT(styles,' '), LAMBDA s: CONTAINS(txt, s))) > 0 THEN 1e0 ELSE 0.35e0 END
  + 0.20e0*CASE WHEN materials = '' THEN 0.6e0 WHEN LIST_CONTAINS(STR_SPLIT(materials,' '), o.material) THEN 1e0 WHEN LIST_CONTAINS(fams, fam) THEN 0.95e0 WHEN fam IN ('wood','laminate') AND (LIST_CONTAINS(fams,'wood') OR LIST_CONTAINS(fams,'laminate')) THEN 0.85e0 ELSE 0.35e0 END
  + 0.10e0*CASE WHEN v.tone = 'any' OR v.tone = tn THEN 1e0 ELSE 0.55e0 END, 4) END AS score FROM lum o JOIN dim_assets v ON v.category = o.category JOIN vc ON vc.category = o.category LEFT JOIN vf ON vf.asset_no = v.asset_no),
bs AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY object_id ORDER BY score DESC, asset_no) AS rn FROM sc) WHERE rn = 1),
mt AS (SELECT o.object_id, o.building_id, o.category, COALESCE(asset, CONCAT('generic_', COALESCE(asset_family, 'box'))) AS asset, COALESCE(score, 0e0) AS asset_score, COALESCE(builder, 'build_box_furniture') AS builder FROM fx_coloured o LEFT JOIN bs USING (object_id) LEFT JOIN dim_objects d ON d.category = o.category)"""


def matched(spark, sf_dir):
    styles = fx(spark, sf_dir, "fx_rooms").select("building_id", "room_id", "style")
    return ap.match_assets(fx(spark, sf_dir, "fx_coloured").join(styles, ["building_id", "room_id"]))


@query("asset_matches", "PL-06", oracle=f"WITH {ASSETS} SELECT object_id, asset, asset_score, builder FROM mt")
def asset_matches(spark, sf_dir):
    return matched(spark, sf_dir).select("object_id", "asset", "asset_score", "builder")


@query("asset_coverage", "AG-24", oracle=f"""
WITH {ASSETS} SELECT building_id, COUNT(*) FILTER (asset_score > 0) AS matched, RND(AVG(asset_score) FILTER (asset_score > 0),3) AS mean_score, COUNT(*) FILTER (asset_score > 0 AND asset_score < 0.62e0) AS poor, COUNT(*) FILTER (asset LIKE 'generic%') AS generic FROM mt GROUP BY building_id""")
def asset_coverage(spark, sf_dir):
    return rounded(ap.asset_coverage(matched(spark, sf_dir)), 3, "mean_score")


@query("worst_assets", "AG-24", "WN-07", oracle=f"""
WITH {ASSETS} SELECT building_id, object_id, asset, asset_score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY building_id ORDER BY asset_score, object_id) AS rank FROM mt WHERE asset_score > 0 AND asset_score < 0.62e0) WHERE rank <= 20""")
def worst_assets(spark, sf_dir):
    return ap.worst_assets(matched(spark, sf_dir)).select("building_id", "object_id", "asset", "asset_score", "rank")


@query("weakest_categories", "AG-24", "WN-07", oracle=f"""
WITH {ASSETS}, m AS (SELECT building_id, category, AVG(asset_score) AS mean_score, COUNT(*) AS objects FROM mt WHERE asset_score > 0 GROUP BY ALL)
SELECT building_id, category, RND(mean_score,3) AS mean_score, objects, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY building_id ORDER BY ROUND(mean_score,9), category) AS rank FROM m) WHERE rank <= 5""")
def weakest_categories(spark, sf_dir):
    return rounded(ap.weakest_categories(matched(spark, sf_dir)), 3, "mean_score")


@query("builder_histogram", "AG-24", oracle=f"WITH {ASSETS} SELECT building_id, builder, COUNT(*) AS objects FROM mt GROUP BY ALL")
def builder_histogram(spark, sf_dir):
    return ap.builder_histogram(matched(spark, sf_dir))


@query("resolved_materials", "PL-07", oracle="""
WITH s AS (SELECT room_id, style, style_confidence AS confidence, sf AS surface, CASE sf WHEN 'floor' THEN floor_material WHEN 'object' THEN 'metal' END AS observed FROM fx_finished_rooms CROSS JOIN (VALUES ('wall'), ('floor'), ('ceiling'), ('object')) v(sf)),
n AS (SELECT *, NULLIF(COALESCE(observed,'unknown'), 'unknown') AS seen FROM s), f AS (SELECT n.*, m.family FROM n LEFT JOIN dim_materials m ON m.material = n.seen), j AS (SELECT f.*, species, CASE surface WHEN 'wall' THEN wall WHEN 'floor' THEN floor WHEN 'ceiling' THEN ceiling END AS def FROM f LEFT JOIN dim_style_substitutes u ON u.style = f.style AND u.family = f.family LEFT JOIN dim_style_profiles p ON p.style = f.style)
SELECT room_id, surface, CASE WHEN seen IS NOT NULL AND seen = family AND confidence >= 0.5e0 AND species IS NOT NULL THEN species WHEN seen IS NOT NULL THEN seen ELSE COALESCE(def, CASE surface WHEN 'wall' THEN 'paint_matte' WHEN 'floor' THEN 'wood' WHEN 'ceiling' THEN 'gypsum' ELSE 'unknown' END) END AS material,
 CASE WHEN seen IS NOT NULL AND seen = family AND confidence >= 0.5e0 AND species IS NOT NULL THEN 'style' WHEN seen IS NOT NULL THEN 'observed' WHEN def IS NOT NULL THEN 'style' ELSE 'default' END AS source FROM j""")
def resolved_materials(spark, sf_dir):
    rooms = fx(spark, sf_dir, "fx_finished_rooms").withColumn("surface", F.explode(F.array(*[F.lit(s) for s in ("wall", "floor", "ceiling", "object")])))
    rows = rooms.withColumn("observed", F.when(F.col("surface") == "floor", F.col("floor_material")).when(F.col("surface") == "object", "metal")).withColumn("confidence", F.col("style_confidence"))
    return ap.resolve_materials(rows).select("room_id", "surface", "material", "source")


PROGRAMME = """LEAST(GREATEST(max_count, item_count), CASE WHEN per_area > 0 THEN LEAST(max_count, item_count + CAST(FLOOR(GREATEST(0e0, area-min_area)/per_area) AS BIGINT)) ELSE item_count END)"""


@query("furniture_programme", "PL-09", oracle=f"""
SELECT room_id, category, CAST(i AS INTEGER) AS item_index, importance, requires FROM (SELECT room_id, category, importance, requires, GREATEST(1, {PROGRAMME}) AS n FROM fx_rooms JOIN dim_furniture_programme USING (room_type) WHERE area >= min_area) q CROSS JOIN (SELECT UNNEST(RANGE(0, 10)) AS i) s WHERE i < n""")
def furniture_programme(spark, sf_dir):
    return ap.plan_furniture(fx(spark, sf_dir, "fx_rooms")).select("room_id", "category", "item_index", "importance", "requires")


@query("lighting_programme", "PL-09", oracle=f"""
SELECT room_id, kind, CAST(i AS INTEGER) AS item_index FROM (SELECT room_id, kind, GREATEST(1, {PROGRAMME}) AS n FROM fx_rooms JOIN dim_lighting_programme USING (room_type) WHERE area >= min_area) q CROSS JOIN (SELECT UNNEST(RANGE(0, 10)) AS i) s WHERE i < n
UNION ALL SELECT room_id, 'ceiling_light', 0 FROM fx_rooms WHERE room_type NOT IN (SELECT room_type FROM dim_lighting_programme)""")
def lighting_programme(spark, sf_dir):
    return ap.plan_lights(fx(spark, sf_dir, "fx_rooms")).select("room_id", "kind", "item_index")


@query("furnishing_targets", "PL-10", oracle="""
WITH s AS (SELECT room_type, MIN(min_area) AS smallest FROM dim_furniture_programme GROUP BY room_type),
r AS (SELECT building_id, room_id, CASE WHEN room_id IN (SELECT room_id - room_id % 4 FROM fx_placed) THEN 'observed contents win' WHEN room_type IN ('staircase','shaft','unknown') THEN 'room type stays empty' WHEN smallest IS NULL THEN 'no programme' WHEN area < smallest THEN 'too small' ELSE '' END AS reason, room_id NOT IN (SELECT room_id - room_id % 3 FROM fx_lights) AS light FROM fx_rooms LEFT JOIN s USING (room_type))
SELECT building_id, room_id, reason = '' AS furnish, light, reason FROM r""")
def furnishing_targets(spark, sf_dir):
    """Objects are gathered in every fourth room and lights in every third, so that the others have none."""
    gathered = lambda name, n: fx(spark, sf_dir, name).withColumn("room_id", F.col("room_id") - F.col("room_id") % n).withColumn("building_id", F.floor(F.col("room_id") / 10))
    return ap.furnishing_targets(fx(spark, sf_dir, "fx_rooms"), gathered("fx_placed", 4), gathered("fx_lights", 3))


