"""Building-shaped tables derived in SQL from the driver's star schema.

The text of every fixture runs unchanged on Spark and on the oracle engine, except where
``SPARK_ONLY``/``ORACLE_ONLY`` give one text per engine.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from .dims import TABLES as DIMS
from .dims import values_sql

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

FX: dict[str, str] = {}
SPARK_ONLY: dict[str, str] = {}
ORACLE_ONLY: dict[str, str] = {}

FX["fx_regions"] = """
SELECT CAST(s_suppkey AS BIGINT) AS room_id, CAST(FLOOR(CAST(s_suppkey AS DOUBLE)/10e0) AS BIGINT) AS building_id,
 CAST(s_suppkey % 10 AS DOUBLE)*6e0 AS x0, 0e0 AS y0,
 CAST(s_suppkey % 10 AS DOUBLE)*6e0 + 3e0 + CAST(s_suppkey % 7 AS DOUBLE)*0.5e0 AS x1, 2.5e0 + CAST(s_suppkey % 5 AS DOUBLE)*0.75e0 AS y1,
 CASE s_nationkey % 6 WHEN 0 THEN 'living_room' WHEN 1 THEN 'bedroom' WHEN 2 THEN 'kitchen' WHEN 3 THEN 'bathroom' WHEN 4 THEN 'hallway' ELSE 'unknown' END AS room_type,
 CASE s_suppkey % 4 WHEN 0 THEN 'modern' WHEN 1 THEN 'scandinavian' WHEN 2 THEN 'industrial' ELSE 'unknown' END AS style,
 CAST(s_suppkey % 11 AS DOUBLE)/10e0 AS style_confidence FROM supplier"""

FX["fx_objects"] = """
SELECT CAST(o_orderkey AS BIGINT) AS object_id, CAST((o_orderkey*7) % n AS BIGINT) AS hint_room_id, CAST(FLOOR(CAST((o_orderkey*7) % n AS DOUBLE)/10e0) AS BIGINT) AS building_id,
 CAST(((o_orderkey*7) % n) % 10 AS DOUBLE)*6e0 + CAST((o_orderkey*37) % 620 AS DOUBLE)/100e0 - 0.4e0 AS x, CAST((o_orderkey*53) % 600 AS DOUBLE)/100e0 - 0.4e0 AS y,
 CASE WHEN o_orderkey % 17 = 0 THEN 0.3e0 ELSE 0e0 END AS z, CAST((o_orderkey % 4) * 45 AS DOUBLE) AS rotation_deg,
 CASE o_orderkey % 8 WHEN 0 THEN 'sofa' WHEN 1 THEN 'bed' WHEN 2 THEN 'dining_table' WHEN 3 THEN 'dining_chair' WHEN 4 THEN 'rug' WHEN 5 THEN 'toilet' WHEN 6 THEN 'cooktop' ELSE 'plant' END AS category,
 0.3e0 + CAST(o_orderkey % 23 AS DOUBLE)*0.1e0 AS width, 0.3e0 + CAST(o_orderkey % 13 AS DOUBLE)*0.1e0 AS depth, CAST(o_orderkey % 31 AS DOUBLE)*0.1e0 AS height,
 CAST(o_custkey % 101 AS DOUBLE)/100e0 AS confidence, CASE o_orderstatus WHEN 'F' THEN 'fabric' WHEN 'O' THEN 'wood' ELSE 'unknown' END AS material,
 o_orderkey % 29 = 0 AS locked FROM orders CROSS JOIN (SELECT COUNT(*) AS n FROM supplier) c"""

FX["fx_detections"] = """
SELECT event_id AS detection_id, CAST(FLOOR(CAST(event_id AS DOUBLE)/25e0) AS BIGINT) AS image_id, CAST(FLOOR(CAST(event_id AS DOUBLE)/100e0) AS BIGINT) AS room_id, event_type AS category,
 CAST((event_id*31) % 8 AS DOUBLE)/10e0 AS bx0, CAST((event_id*17) % 4 AS DOUBLE)/5e0 AS by0,
 CAST((event_id*31) % 8 AS DOUBLE)/10e0 + 0.05e0 + CAST(event_id % 5 AS DOUBLE)*0.03e0 AS bx1, CAST((event_id*17) % 4 AS DOUBLE)/5e0 + 0.05e0 + CAST(event_id % 3 AS DOUBLE)*0.05e0 AS by1,
 CAST((event_id*13) % 100 AS DOUBLE)/100e0 AS confidence, CASE event_id % 3 WHEN 0 THEN 'fabric' WHEN 1 THEN 'wood' ELSE 'unknown' END AS material FROM events"""

FX["fx_findings"] = """
SELECT CASE l_linenumber % 5 WHEN 0 THEN 'colour' WHEN 1 THEN 'material' WHEN 2 THEN 'lighting' WHEN 3 THEN 'layout' ELSE 'objects' END AS axis,
 CASE l_partkey % 11 WHEN 0 THEN 'LightingEnvironment' WHEN 1 THEN 'LightSource' WHEN 2 THEN 'ColourPalette' WHEN 3 THEN 'SurfaceFinish' WHEN 4 THEN 'MaterialSpecies' WHEN 5 THEN 'SceneGraphTransform' WHEN 6 THEN 'AssetPlacement' WHEN 7 THEN 'ObjectDetection' WHEN 8 THEN 'CameraFit' WHEN 9 THEN 'Geometry' ELSE 'RenderSettings' END AS subsystem,
 l_returnflag AS code, l_suppkey AS room_id, CAST(l_orderkey % 6 AS BIGINT) AS viewpoint_id, l_discount*10e0 AS severity, 1e0 - l_tax*5e0 AS confidence, l_quantity AS difference, CASE WHEN l_partkey % 11 IN (5, 6, 7) THEN CAST(l_partkey % 20 AS BIGINT) ELSE CAST(-1 AS BIGINT) END AS object_id FROM lineitem"""

FX["fx_attempts"] = """
SELECT CAST(FLOOR(CAST(o_orderkey AS DOUBLE)/12e0) AS BIGINT) AS run_id, o_orderkey AS seq, CASE o_orderpriority WHEN '1-URGENT' THEN 'lighting_adjustment' WHEN '2-HIGH' THEN 'material_adjustment' WHEN '3-MEDIUM' THEN 'palette_adjustment' WHEN '4-NOT SPECIFIED' THEN 'furniture_translation' ELSE 'camera_correction' END AS action_type,
 CAST((o_orderkey*19) % 100 AS DOUBLE)/1000e0 AS expected_gain, CAST((o_orderkey*23) % 100 AS DOUBLE)/1000e0 - 0.05e0 AS measured_gain FROM orders"""

FX["fx_job_events"] = """
SELECT user_id AS job_id, event_id, ts AS at, CASE event_type WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'EXTRACTING_DXF' WHEN 'signup' THEN 'BUILDING_SCENE' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status, props FROM events"""

FX["fx_labels"] = """
SELECT CAST(p_partkey AS BIGINT) AS text_id, CONCAT(CASE p_size % 7 WHEN 0 THEN 'M.BED.RM ' WHEN 1 THEN CONCAT('{', CHR(92), 'fArial|b1;KITCHEN} ') WHEN 2 THEN 'w.c. ' WHEN 3 THEN 'Bedroom-' WHEN 4 THEN 'GROUND FLOOR PLAN' WHEN 5 THEN 'hall ' ELSE p_name END, CASE WHEN p_size % 7 = 4 THEN '' WHEN p_partkey % 3 = 0 THEN CONCAT(CAST(p_size AS VARCHAR(10)), '.5 SQ.M') WHEN p_partkey % 3 = 1 THEN '3.6x4.2' ELSE CAST(p_size AS VARCHAR(10)) END) AS raw FROM part"""

FX["fx_axis_scores"] = """
SELECT l_suppkey AS room_id, CAST(l_orderkey % 6 AS BIGINT) AS viewpoint_id,
 CASE l_linenumber % 5 WHEN 0 THEN 'colour' WHEN 1 THEN 'material' WHEN 2 THEN 'lighting' WHEN 3 THEN 'layout' ELSE 'objects' END AS axis,
 ROUND(AVG(l_quantity)/50e0, 6) AS score, ROUND(1e0 - AVG(l_tax)*5e0, 6) AS confidence,
 SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 3 < COUNT(*) AS measured
FROM lineitem
GROUP BY l_suppkey, CAST(l_orderkey % 6 AS BIGINT),
 CASE l_linenumber % 5 WHEN 0 THEN 'colour' WHEN 1 THEN 'material' WHEN 2 THEN 'lighting' WHEN 3 THEN 'layout' ELSE 'objects' END"""

FX["fx_rooms"] = """
SELECT room_id, building_id, room_type, style, style_confidence, x0, y0, x1, y1, (x1-x0)*(y1-y0) AS area FROM fx_regions"""

# Four walls a room, counter-clockwise from the lower left corner.
FX["fx_walls"] = """
SELECT room_id*4 + k AS wall_id, building_id, room_id, k, CASE k WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x1 ELSE x0 END AS sx, CASE k WHEN 0 THEN y0 WHEN 1 THEN y0 WHEN 2 THEN y1 ELSE y1 END AS sy,
 CASE k WHEN 0 THEN x1 WHEN 1 THEN x1 WHEN 2 THEN x0 ELSE x0 END AS ex, CASE k WHEN 0 THEN y0 WHEN 1 THEN y1 WHEN 2 THEN y1 ELSE y0 END AS ey
FROM fx_regions CROSS JOIN (SELECT CAST(c AS BIGINT) AS k FROM (VALUES (0), (1), (2), (3)) AS v(c)) q"""

# Who owns a wall: its room, and for right-hand walls the next room of the building as well.
FX["fx_wall_owners"] = """
SELECT wall_id, building_id, room_id FROM fx_walls
UNION ALL SELECT w.wall_id, w.building_id, r.room_id FROM fx_walls w JOIN fx_regions r ON r.room_id = w.room_id + 1 AND r.building_id = w.building_id WHERE w.k = 1"""

# Openings a third of which lie off the wall line by up to 0.5 m and some without a room of their own.
FX["fx_openings"] = """
SELECT CAST(p_partkey AS BIGINT) AS opening_id, building_id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE w.room_id END AS room_id, w.wall_id,
 CASE p_size % 3 WHEN 0 THEN 'window' ELSE 'door' END AS kind, CASE p_size % 4 WHEN 0 THEN 'image' ELSE 'dxf' END AS source,
 sx + (ex-sx)*(0.11e0 + CAST(p_partkey % 7 AS DOUBLE)*0.1e0) + CAST(p_partkey % 5 AS DOUBLE)*0.11e0 AS x,
 sy + (ey-sy)*(0.13e0 + CAST(p_partkey % 7 AS DOUBLE)*0.1e0) + CAST(p_partkey % 3 AS DOUBLE)*0.09e0 AS y,
 0.7e0 + CAST(p_size % 9 AS DOUBLE)*0.1e0 AS width, 1.2e0 + CAST(p_size % 7 AS DOUBLE)*0.15e0 AS height, CAST(p_size % 97 AS DOUBLE)/100e0 + 0.02e0 AS confidence
FROM part CROSS JOIN (SELECT COUNT(*)*4 AS n FROM supplier) c JOIN fx_walls w ON w.wall_id = p_partkey % n"""

# Objects with a room and a support: plants stand on something, cooktops hang on a wall.
FX["fx_placed"] = """
SELECT o.building_id, hint_room_id AS room_id, object_id, category, CASE category WHEN 'plant' THEN 'on_object' WHEN 'cooktop' THEN 'wall' ELSE 'floor' END AS support,
 CASE WHEN category = 'plant' AND object_id % 3 <> 0 THEN object_id - n WHEN category = 'plant' AND object_id % 9 = 3 THEN CAST(-1 AS BIGINT) END AS support_id,
 x, y, CASE WHEN category = 'cooktop' THEN CAST(object_id % 5 AS DOUBLE)*0.5e0 - 0.5e0 WHEN category = 'plant' THEN CAST(object_id % 4 AS DOUBLE)*0.3e0 ELSE z END AS z,
 width, depth, CASE WHEN object_id % 41 = 0 THEN 0e0 ELSE height END AS height, rotation_deg, CASE WHEN object_id % 57 = 0 THEN 1.2e0 ELSE confidence END AS confidence, material, locked,
 confidence < 0.4e0 AS uncertain, object_id % 13 = 0 AS by_hand
FROM fx_objects o CROSS JOIN (SELECT COUNT(*) AS n FROM supplier) c"""

# The same objects with ids that start anew in every building.
FX["fx_restarted"] = """
SELECT p.building_id, p.room_id, p.k AS object_id, s.k AS support_id, p.category, p.support, p.x, p.y, p.z, p.width, p.depth, p.height, p.rotation_deg, p.confidence, p.material, p.locked, p.uncertain, p.by_hand
FROM (SELECT q.*, ROW_NUMBER() OVER (PARTITION BY building_id ORDER BY object_id) AS k FROM fx_placed q) p
LEFT JOIN (SELECT building_id, object_id, ROW_NUMBER() OVER (PARTITION BY building_id ORDER BY object_id) AS k FROM fx_placed) s ON s.building_id = p.building_id AND s.object_id = p.support_id"""

# Objects with the colour, label and group the appearance rules need.
FX["fx_coloured"] = """
SELECT p.*, obj_group, CASE object_id % 7 WHEN 0 THEN '#8C5A3C' WHEN 1 THEN '#3F6B5E' WHEN 2 THEN '#D8C3A5' WHEN 3 THEN '#2E4A52' WHEN 4 THEN '#EFEDE8' WHEN 5 THEN '#C1683F' END AS color_hex,
 CASE object_id % 3 WHEN 0 THEN 'modern grey one' WHEN 1 THEN 'classic piece' ELSE '' END AS label FROM fx_placed p LEFT JOIN dim_objects d ON d.category = p.category"""
FX["fx_finished_rooms"] = """
SELECT r.*, CASE room_id % 5 WHEN 0 THEN '#EFEDE8' WHEN 1 THEN '#DED5C8' WHEN 2 THEN '#C1683F' END AS wall_hex, CASE room_id % 3 WHEN 0 THEN '#C08E5C' WHEN 1 THEN '#9A9A96' END AS floor_hex,
 CASE room_id % 4 WHEN 0 THEN 'wood' WHEN 1 THEN 'walnut' WHEN 2 THEN 'unknown' END AS floor_material, CASE room_id % 6 WHEN 0 THEN 'evening' WHEN 1 THEN 'overcast' END AS time_of_day FROM fx_rooms r"""

# Relations between objects, some with ends that do not resolve.
FX["fx_relationships"] = """
SELECT object_id AS relationship_id, building_id, CONCAT('object:', CAST(CASE WHEN object_id % 43 = 0 THEN -object_id - 1 ELSE object_id END AS VARCHAR(20))) AS subject_ref,
 CASE object_id % 4 WHEN 0 THEN 'faces' WHEN 1 THEN 'beside' WHEN 2 THEN 'mounted_on' ELSE 'on_top_of' END AS predicate,
 CASE WHEN object_id % 4 = 2 THEN CONCAT('wall:', CAST(hint_room_id*4 + object_id % 5 AS VARCHAR(20))) ELSE CONCAT('object:', CAST(object_id + n * (1 + object_id % 3) AS VARCHAR(20))) END AS object_ref,
 confidence FROM fx_objects CROSS JOIN (SELECT COUNT(*) AS n FROM supplier) c WHERE object_id % 2 = 0"""

FX["fx_lights"] = """
SELECT CAST(c_custkey AS BIGINT) AS light_id, r.room_id, r.building_id, CAST(c_custkey % 4 AS BIGINT) AS image_id,
 CASE c_nationkey % 5 WHEN 0 THEN 'ceiling' WHEN 1 THEN 'pendant' WHEN 2 THEN 'floor_lamp' WHEN 3 THEN 'spot' ELSE 'unknown' END AS kind,
 CAST(1 + c_custkey % 4 AS BIGINT) AS fixtures, 20e0 + CAST(c_custkey % 13 AS DOUBLE)*10e0 AS power_w, 2700e0 + CAST(c_custkey % 9 AS DOUBLE)*300e0 AS kelvin,
 c_custkey % 6 <> 0 AS is_on, c_custkey % 5 = 0 AS uncertain, CAST(c_custkey % 89 AS DOUBLE)/100e0 + 0.05e0 AS confidence,
 x0 + CAST(c_custkey % 40 AS DOUBLE)*0.11e0 - 0.2e0 AS x, y0 + CAST(c_custkey % 31 AS DOUBLE)*0.13e0 - 0.2e0 AS y, 1.5e0 + CAST(c_custkey % 15 AS DOUBLE)*0.1e0 AS z
FROM customer CROSS JOIN (SELECT COUNT(*) AS n FROM supplier) c JOIN fx_regions r ON r.room_id = c_custkey % n"""

FX["fx_viewpoints"] = """
SELECT CAST(c_custkey AS BIGINT) AS viewpoint_id, r.room_id, r.building_id, x0 + CAST(c_custkey % 17 AS DOUBLE)*0.2e0 AS x, y0 + CAST(c_custkey % 11 AS DOUBLE)*0.2e0 AS y, 1.6e0 AS z,
 CAST((c_custkey*37) % 360 AS DOUBLE) AS yaw, CAST(c_custkey % 21 AS DOUBLE) - 10e0 AS pitch_deg, 45e0 + CAST(c_custkey % 30 AS DOUBLE) AS vfov_deg, CASE c_custkey % 3 WHEN 0 THEN 1.5e0 WHEN 1 THEN 1e0 ELSE 1.7777e0 END AS aspect
FROM customer CROSS JOIN (SELECT COUNT(*) AS n FROM supplier) c JOIN fx_regions r ON r.room_id = c_custkey % n"""

_PIXELS = """
SELECT vec_id AS image_id, CAST(FLOOR(CAST(pos AS DOUBLE)/8e0) AS BIGINT) AS prow, CAST(pos % 8 AS BIGINT) AS pcol,
 LEAST(1e0, GREATEST(0e0, CAST(v AS DOUBLE) + 0.5e0)) AS luma
FROM ({src}) e"""
SPARK_ONLY["fx_pixels"] = _PIXELS.format(src="SELECT vec_id, posexplode(embedding) AS (pos, v) FROM embeddings")
ORACLE_ONLY["fx_pixels"] = _PIXELS.format(
    src="SELECT vec_id, UNNEST(embedding) AS v, UNNEST(RANGE(LEN(embedding))) AS pos FROM embeddings"
)

# Coloured pixels and, per image, four material regions of different size.
FX["fx_rgb"] = """
SELECT image_id, prow, pcol, luma*(1e0 - CAST(image_id % 3 AS DOUBLE)*0.3e0) AS r, luma*(0.9e0 - CAST(image_id % 3 AS DOUBLE)*0.3e0) AS g, LEAST(1e0, luma*(0.6e0 - CAST(image_id % 2 AS DOUBLE)*0.2e0) + 0.15e0) AS b, CASE WHEN prow < 3 THEN 1 WHEN prow < 5 AND pcol < 6 THEN 2 WHEN prow = 7 AND pcol = 7 THEN 3 ELSE 0 END AS region FROM fx_pixels"""

_NAME = re.compile(r"\b(fx_\w+|dim_\w+)\b")
_BASE = re.compile(r"(?i)\b(from|join)\s+(" + "|".join(BASE) + r")\b")


def _dependencies(sql: str, oracle: bool) -> list[str]:
    """Fixture and dimension names ``sql`` reads, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in ordered or not (name in FX or name in SPARK_ONLY or name in DIMS):
                continue
            visit(fixture_sql(name, oracle))
            ordered.append(name)

    visit(sql)
    return ordered


def fixture_sql(name: str, oracle: bool) -> str:
    if name in DIMS:
        return values_sql(name)
    special = ORACLE_ONLY if oracle else SPARK_ONLY
    return special.get(name) or FX[name]


def _nudged(body: str) -> str:
    """``RND(x,n)`` -> ``ROUND((x)+1e-9,n)``: the same tie-safe rounding the queries use."""
    while (at := body.find("RND(")) >= 0:
        depth, comma, i = 0, 0, at + 4
        while depth >= 0:
            c = body[i]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                comma = i
            i += 1
        body = f"{body[:at]}ROUND(({body[at + 4:comma]})+1e-9{body[comma:i - 1]}){body[i:]}"
    return body


def oracle_text(body: str) -> str:
    """``body`` with the fixtures and dimensions it names put in front as CTEs."""
    body = _nudged(body.strip())
    ctes = [f"{n} AS ({fixture_sql(n, True).strip()})" for n in _dependencies(body, True)]
    recursive = ""
    head = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if head:
        recursive = head.group(1) or ""
        body = body[head.end():]
        return "WITH " + recursive + ",\n".join(ctes + [body])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


#: A table is spread over tasks in shares of SHARE bytes, unless every core has WHOLE bytes of it to scan.
SHARE, WHOLE = 8 << 10, 32 << 20


def spread(df: DataFrame, path: str) -> DataFrame:
    """``df``, read from ``path``, over several tasks for each core.

    Millions of narrow rows are a file of a few megabytes, which Spark scans in one task; all that follows without a
    shuffle (cells, pairs, distances) would stay in that task, on one core.
    """
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    cores = spark.sparkContext.defaultParallelism
    tasks = min(4 * cores, size // SHARE)
    return df if tasks < 2 or size > cores * WHOLE else df.repartition(tasks)


#: A table next to the number of rows of another one, which a later join takes its keys modulo.
_COUNTED = re.compile(r"FROM (\w+)( \w)? CROSS JOIN \((SELECT COUNT\(\*\)(?:\*\d+)?) AS (\w+) (FROM \w+)\) c\b")


def _counts_as_columns(sql: str) -> str:
    """The count as a column of the table it stands next to: the same rows, in a form that keeps the join an equi-join.

    As a relation of its own it takes part in join reordering: Spark may then join the other two tables first, on
    whatever condition reads both (that a coordinate is not null), which pairs every row with every row.
    """
    return _COUNTED.sub(lambda m: f"FROM (SELECT *, ({m[3]} {m[5]}) AS {m[4]} FROM {m[1]}) {(m[2] or m[1]).strip()}", sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spread(spark.read.parquet(path), path)


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a lazy DataFrame; every table in its text becomes a session view first."""
    tag = hashlib.md5(sf_dir.encode()).hexdigest()[:8]

    def localise(sql: str, known: list[str]) -> str:
        for base in dict.fromkeys(m[1].lower() for m in _BASE.findall(sql)):
            view = f"{base}_{tag}"
            table(spark, sf_dir, base).createOrReplaceTempView(view)
        sql = _BASE.sub(lambda m: f"{m.group(1)} {m.group(2).lower()}_{tag}", sql)
        return _NAME.sub(lambda m: f"{m.group(1)}_{tag}" if m.group(1) in known else m.group(1), _counts_as_columns(sql))

    text = fixture_sql(name, False)
    known = _dependencies(text, False)
    for dep in known:
        spark.sql(localise(fixture_sql(dep, False), known)).createOrReplaceTempView(f"{dep}_{tag}")
    return spark.sql(localise(text, known))
