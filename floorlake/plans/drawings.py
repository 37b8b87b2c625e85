"""Label, layer, block and unit queries over drawing entities."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..dims import define, patterns
from ..fixtures import FX, fx
from ..functions import coerce, geometry as g, text as tx
from ..operators import drawings as dr
from .evaluation import rounded
from .registry import query

LAYER_NAMES = ["A-WALL", "A-WALL-PATT", "A-DOOR", "A-GLAZ", "I-FURN", "A-FLOR-FIXT", "A-ANNO-TEXT", "Z-WALL", "A-FLOR-TPTN-ABCD", "AB21", "A3210", "WALLS_EXT",
               "door-swing", "Furniture 2", "0", "", "Defpoints", "XREF|PLUMB", "S-COLS", "random stuff", "ELEC POWER", "Stair_up", "HATCH", "A-FLOR-ABCD-STRS"]
BLOCK_NAMES = ["WC_01", "*U12", "BLK_SOFA-2", "M_DOOR 900", "Double Bed", "KITCHEN SINK", "A$C1234F", "N_ARROW", "ARCH_CHAIR", "UNKNOWN_THING", "WINDOW W12", "BASIN",
               "HOB-4", "TV UNIT", "CAR", "ROOM TAG", "lib_dining table", "Fridge"]
TERMS = ["L-Shaped Sofa", "big couch", "Wash_Basin", "dining table set", "coffee_table", "xyz", "TV Stand", "tall potted plant", "polished marble floor", "light oak parquet",
         "Nordic boho", "downlights", "mid century modern", "brushed steel", "sconce pair", "", "Retro Lounge Chair", "velvet", "track light"]


def pick(names: list[str], key: str) -> str:
    return f"CASE {key} % {len(names)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


# Segments: ten or so per drawing, millimetre-sized coordinates, named layers.
FX["fx_segments"] = f"""
SELECT o_orderkey AS entity_id, o_custkey AS drawing_id, {pick(LAYER_NAMES, 'o_orderkey')} AS layer,
 CASE o_orderkey % 7 WHEN 0 THEN 'LINE' WHEN 1 THEN 'LWPOLYLINE' WHEN 2 THEN 'ARC' WHEN 3 THEN 'INSERT' ELSE 'LINE' END AS dxftype,
 CASE o_orderkey % 5 WHEN 0 THEN 'wall' WHEN 1 THEN 'wall' WHEN 2 THEN 'furniture' WHEN 3 THEN 'door' ELSE 'unknown' END AS role,
 CAST((o_orderkey*37) % 12000 AS DOUBLE) AS sx, CAST((o_orderkey*53) % 9000 AS DOUBLE) AS sy,
 CAST((o_orderkey*37) % 12000 AS DOUBLE) + CAST(o_orderkey % 41 AS DOUBLE)*90e0 AS ex, CAST((o_orderkey*53) % 9000 AS DOUBLE) + CAST(o_orderkey % 3 AS DOUBLE)*0.01e0 AS ey FROM orders"""
FX["fx_drawings"] = """
SELECT c_custkey AS drawing_id, CASE c_custkey % 6 WHEN 0 THEN CAST(4 AS BIGINT) WHEN 1 THEN CAST(1 AS BIGINT) WHEN 2 THEN CAST(6 AS BIGINT) WHEN 3 THEN CAST(99 AS BIGINT) END AS insunits,
 CASE WHEN c_custkey % 11 = 0 THEN 0.5e0 WHEN c_custkey % 11 = 1 THEN 1e0 END AS user_scale, CASE c_custkey % 9 WHEN 0 THEN 12000e0 WHEN 1 THEN 90e0 WHEN 2 THEN 20e0 WHEN 3 THEN 2e0 WHEN 4 THEN 0e0 WHEN 5 THEN 600000e0 ELSE 4500e0 END AS width, CAST(c_custkey % 3 AS DOUBLE) AS height,
 CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 7 AS DOUBLE)*0.7e0 END AS north_direction, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 500 AS DOUBLE) END AS arrow_rotation FROM customer"""
FX["fx_dimensions"] = """
SELECT o_custkey AS drawing_id, o_orderkey AS entity_id, CAST(1000 + o_orderkey % 900 AS DOUBLE) * CASE o_custkey % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 1000e0 ELSE 1e0 + CAST(o_orderkey % 2 AS DOUBLE)*0.5e0 END AS measurement,
 CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE CONCAT('L ', CAST(1000 + o_orderkey % 900 AS VARCHAR(10)), ' ') END AS text FROM orders WHERE o_orderkey % 4 = 0"""
FX["fx_blocks"] = f"""
SELECT p_partkey AS entity_id, {pick(BLOCK_NAMES, 'p_partkey')} AS name, CASE p_size % 5 WHEN 0 THEN 'type' WHEN 1 THEN 'ROOM_NAME' WHEN 2 THEN 'NAME' WHEN 3 THEN 'Area' END AS key_1,
 CASE p_size % 5 WHEN 0 THEN 'Toilet Suite' WHEN 1 THEN ' Bed Room ' WHEN 2 THEN '101' WHEN 3 THEN '1,012.5 m2' END AS value_1, CASE p_size % 5 WHEN 2 THEN 'Use' WHEN 1 THEN 'SQM' END AS key_2, CASE p_size % 5 WHEN 2 THEN 'Store' WHEN 1 THEN '9.5' END AS value_2 FROM part"""
FX["fx_terms"] = f"SELECT p_partkey AS term_id, {pick(TERMS, 'p_partkey')} AS raw FROM part"

for _kind in tx.VOCABULARIES:
    define(f"dim_vocab_{_kind}", "tier length_key declared term name", tx.vocabulary_entries(_kind))


def plain(pattern: str) -> str:
    """RE2 has no look-ahead; none of the fixture's names needs one."""
    return re.sub(r"\(\?!.*?\)", "", pattern).replace("'", "''")


CLEAN = "TRIM(REGEXP_REPLACE(REGEXP_REPLACE(@COL, '" + tx.FORMAT_CODES.replace("(?i)", "").replace("'", "''") + "', ' ', 'gi'), '\\s+', ' ', 'g'))"
LABEL = "TRIM(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(UPPER(" + CLEAN + "), '" + tx.PUNCTUATION.replace("'", "''") + "', ' ', 'g'), '" + tx.DASHES + "', ' ', 'g'), '\\s+', ' ', 'g'))"
ROOM_CASE = "CASE " + " ".join(f"WHEN REGEXP_MATCHES(label, '{plain(tx.any_of(ps))}') THEN '{room}'" for room, ps in patterns.ROOM_LABELS) + " END"
AREA_SQL = tx.AREA.replace("(?i)", "")
LEN_SQL = """CASE WHEN TRY_CAST({0} AS DOUBLE) <= 0 THEN NULL WHEN TRY_CAST({0} AS DOUBLE) <= 30 THEN TRY_CAST({0} AS DOUBLE) WHEN TRY_CAST({0} AS DOUBLE) BETWEEN 300 AND 30000 THEN TRY_CAST({0} AS DOUBLE)/1000e0 WHEN TRY_CAST({0} AS DOUBLE) > 30 AND TRY_CAST({0} AS DOUBLE) < 300 THEN TRY_CAST({0} AS DOUBLE)/100e0 END"""
LABELS = f"""
l0 AS (SELECT text_id, raw, {CLEAN.replace('@COL', 'raw')} AS cleaned, {LABEL.replace('@COL', 'raw')} AS label FROM fx_labels),
l1 AS (SELECT *, {ROOM_CASE} AS room, TRY_CAST(NULLIF(REGEXP_EXTRACT(cleaned, '{AREA_SQL}', 1, 'i'), '') AS DOUBLE) AS av, REGEXP_EXTRACT(cleaned, '([0-9]+(?:\\.[0-9]+)?)\\s*[xX]\\s*([0-9]+(?:\\.[0-9]+)?)', 1) AS pa, REGEXP_EXTRACT(cleaned, '([0-9]+(?:\\.[0-9]+)?)\\s*[xX]\\s*([0-9]+(?:\\.[0-9]+)?)', 2) AS pb,
  cleaned = '' OR REGEXP_MATCHES(label, '{patterns.TITLE_NOISE.replace("'", "''")}') AS noise FROM l0),
l2 AS (SELECT *, {LEN_SQL.format('pa')} AS a, {LEN_SQL.format('pb')} AS b FROM l1),
l3 AS (SELECT *, CASE WHEN noise THEN 'note' WHEN room IS NOT NULL THEN 'room_label' WHEN av IS NOT NULL THEN 'area' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'dimension' WHEN REGEXP_MATCHES(label, '^[0-9]+(?:\\.[0-9]+)?$') THEN 'number' ELSE 'note' END AS role FROM l2)"""


@query("label_normalise", "STR-01", oracle=f"WITH {LABELS} SELECT text_id, cleaned, label FROM l0")
def label_normalise(spark, sf_dir):
    return fx(spark, sf_dir, "fx_labels").select("text_id", tx.clean_text(F.col("raw")).alias("cleaned"), tx.normalise_label(F.col("raw")).alias("label"))


@query("label_measures", "STR-02", "STR-03", oracle=f"WITH {LABELS} SELECT text_id, RND(av,4) AS area_m2, RND(CASE WHEN b IS NOT NULL THEN a END,4) AS dim_a, RND(CASE WHEN a IS NOT NULL THEN b END,4) AS dim_b FROM l2")
def label_measures(spark, sf_dir):
    rows = fx(spark, sf_dir, "fx_labels").withColumns({"area": tx.parse_area(F.col("raw")), "pair": tx.parse_dimension_pair(F.col("raw"))})
    return rounded(rows.select("text_id", F.col("area.m2").alias("area_m2"), F.col("pair.a").alias("dim_a"), F.col("pair.b").alias("dim_b")), 4, "area_m2", "dim_a", "dim_b")


@query("label_roles", "STR-04", oracle=f"""
WITH {LABELS} SELECT text_id, role, CASE WHEN role = 'room_label' THEN room ELSE '' END AS room_type, CASE role WHEN 'room_label' THEN 0.94e0 WHEN 'area' THEN 0.90e0 WHEN 'dimension' THEN 0.85e0 WHEN 'number' THEN 0.50e0 ELSE 0e0 END AS confidence,
 CASE WHEN role = 'room_label' THEN TRY_CAST(NULLIF(REGEXP_EXTRACT(label, '\\b([0-9]{{1,2}})\\s*$', 1), '') AS INTEGER) END AS trailing FROM l3""")
def label_roles(spark, sf_dir):
    return tx.classify_texts(fx(spark, sf_dir, "fx_labels"), "raw").select("text_id", "role", "room_type", "confidence", "trailing")


AIA = tx.AIA_NAME
LAYERS = f"""
n AS (SELECT DISTINCT layer, UPPER(TRIM(layer)) AS u FROM fx_segments),
p AS (SELECT *, REGEXP_EXTRACT(u, '{AIA}', 1) AS d, REGEXP_EXTRACT(u, '{AIA}', 3) AS mj, REGEXP_EXTRACT(u, '{AIA}', 4) AS m1, REGEXP_EXTRACT(u, '{AIA}', 5) AS m2, REGEXP_EXTRACT(u, '{tx.ISO_NAME}', 1) AS el, REGEXP_REPLACE(u, '[-_./|]+', ' ', 'g') AS hay FROM n),
k AS (SELECT *, CASE {' '.join(f"WHEN REGEXP_MATCHES(hay, '{plain(pt)}') THEN '{role}|{c}'" for pt, role, c in patterns.LAYER_KEYWORDS)} END AS kw FROM p),
v AS (SELECT k.layer, CASE WHEN TRIM(k.layer) IN ('', '0') THEN 'unknown|0.0|none' WHEN mj.role IS NOT NULL THEN CONCAT(COALESCE(o1.role, o2.role, mj.role), CASE WHEN d.discipline IS NULL THEN '|0.8|aia' ELSE '|0.95|aia' END)
  WHEN iso.role IS NOT NULL THEN CONCAT(iso.role, '|0.75|iso13567') WHEN kw IS NOT NULL THEN CONCAT(kw, '|keyword') ELSE 'unknown|0.0|none' END AS v
 FROM k LEFT JOIN dim_aia_major mj ON mj.major = k.mj LEFT JOIN dim_aia_minor o1 ON o1.major = k.mj AND o1.minor = m1 LEFT JOIN dim_aia_minor o2 ON o2.major = k.mj AND o2.minor = m2
 LEFT JOIN dim_aia_disciplines d ON d.discipline = k.d LEFT JOIN dim_iso_elements iso ON iso.element = el)"""


@query("layer_roles", "STR-05", oracle=f"""
WITH {LAYERS} SELECT entity_id, layer, SPLIT_PART(v, '|', 1) AS role, CAST(SPLIT_PART(v, '|', 2) AS DOUBLE) AS confidence, SPLIT_PART(v, '|', 3) AS convention FROM fx_segments JOIN v USING (layer)""")
def layer_roles(spark, sf_dir):
    rows = fx(spark, sf_dir, "fx_segments").select("entity_id", "layer")
    return tx.classify_distinct(rows, "layer", tx.classify_layers)


def blocks(spark, sf_dir):
    pair = lambda k, v: F.when(F.col(k).isNotNull(), F.struct(F.col(k).alias("k"), F.col(v).alias("v")))
    entries = F.filter(F.array(pair("key_1", "value_1"), pair("key_2", "value_2")), lambda e: e.isNotNull())
    return fx(spark, sf_dir, "fx_blocks").withColumn("attributes", F.map_from_entries(entries))


BLOCK_KEY = "TRIM(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(UPPER(TRIM(@COL)), '" + tx.BLOCK_PREFIX.replace("(?i)", "") + "', ''), '[-_./|+]+', ' ', 'g'), '\\s+', ' ', 'g'))"
BLOCK_CASE = "CASE " + " ".join(f"WHEN REGEXP_MATCHES(@COL, '{plain(tx.any_of(ps))}') THEN '{c}|{k}|{cc}'" for c, k, cc, ps in patterns.BLOCK_RULES) + " END"


@query("block_classes", "STR-06", oracle=f"""
WITH b AS (SELECT entity_id, name, CASE WHEN REGEXP_MATCHES(UPPER(TRIM(name)), '^(\\*[A-Z][0-9]*|A\\$[A-Z][0-9A-F]{{4,}})$') THEN '' ELSE {BLOCK_KEY.replace('@COL', 'name')} END AS bk, CASE WHEN key_1 = 'type' THEN {BLOCK_KEY.replace('@COL', 'value_1')} END AS stated FROM fx_blocks),
c AS (SELECT entity_id, bk, stated, {BLOCK_CASE.replace('@COL', 'stated')} AS sv, {BLOCK_CASE.replace('@COL', 'bk')} AS nv FROM b),
d AS (SELECT *, CASE WHEN bk = '' THEN '|unknown|' ELSE COALESCE(sv, nv, '|unknown|') END AS v FROM c)
SELECT entity_id, SPLIT_PART(v,'|',1) AS category, SPLIT_PART(v,'|',2) AS kind, SPLIT_PART(v,'|',3) AS catalog_category,
 CASE WHEN bk = '' OR COALESCE(sv, nv) IS NULL THEN 0e0 WHEN sv IS NOT NULL THEN 0.90e0 WHEN SPLIT_PART(v,'|',2) IN ('plumbing_fixture','kitchen_fixture') THEN 0.92e0 ELSE 0.85e0 END AS confidence FROM d""")
def block_classes(spark, sf_dir):
    return tx.classify_blocks(blocks(spark, sf_dir)).select("entity_id", "category", "kind", "catalog_category", "confidence")


@query("block_attributes", "STR-07", oracle="""
SELECT entity_id, CASE p WHEN 1 THEN 'Bed Room' WHEN 2 THEN 'Store' ELSE '' END AS room_name, CASE p WHEN 1 THEN 9.5e0 WHEN 3 THEN 1012.5e0 END AS area FROM (SELECT p_partkey AS entity_id, p_size % 5 AS p FROM part)""")
def block_attributes(spark, sf_dir):
    return blocks(spark, sf_dir).select("entity_id", tx.room_name_from_attributes(F.col("attributes")).alias("room_name"), tx.area_from_attributes(F.col("attributes")).alias("area"))


def vocab_sql(kind: str, default: str) -> str:
    return f"""{kind}_m AS (SELECT t.raw, ARG_MIN(v.name, v.tier*1000000 + v.length_key*1000 + v.declared) AS name FROM (SELECT DISTINCT raw, TRIM(REGEXP_REPLACE(REPLACE(LOWER(raw), '_', ' '), '\\s+', ' ', 'g')) AS t FROM fx_terms) t
 JOIN dim_vocab_{kind} v ON CASE WHEN v.tier <= 2 THEN t.t = v.term ELSE t.t <> '' AND CONTAINS(t.t, v.term) END GROUP BY t.raw)"""


@query("vocabulary_terms", "STR-08", oracle=f"""
WITH {', '.join(vocab_sql(k, '') for k in tx.VOCABULARIES)}
SELECT term_id, c.name AS category, COALESCE(m.name, 'unknown') AS material, COALESCE(s.name, 'unknown') AS style, l.name AS light FROM fx_terms t LEFT JOIN category_m c USING (raw) LEFT JOIN material_m m USING (raw) LEFT JOIN style_m s USING (raw) LEFT JOIN light_m l USING (raw)""")
def vocabulary_terms(spark, sf_dir):
    raw = F.col("raw")
    return fx(spark, sf_dir, "fx_terms").select("term_id", *[tx.normalise_term(raw, k).alias(k) for k in tx.VOCABULARIES])


GRAMS = "(CASE WHEN LENGTH({0}) >= 2 THEN LIST_DISTINCT(LIST_TRANSFORM(RANGE(1, LENGTH({0})), LAMBDA i: SUBSTRING({0}, i, 2))) ELSE [] END)"


@query("label_similarity", "STR-09", "STR-10", oracle=f"""
WITH {LABELS}, pr AS (SELECT a.text_id, a.label AS a, b.label AS b, REPLACE(a.label,' ','') AS ta, REPLACE(b.label,' ','') AS tb, LIST_DISTINCT(STR_SPLIT(a.label,' ')) AS wa, LIST_DISTINCT(STR_SPLIT(b.label,' ')) AS wb FROM l0 a JOIN l0 b ON b.text_id = a.text_id + 1),
g AS (SELECT *, {GRAMS.format('ta')} AS ga, {GRAMS.format('tb')} AS gb, LIST_FILTER(LIST_TRANSFORM(wa, LAMBDA w: LOWER(w)), LAMBDA w: LENGTH(w) > 2) AS ja, LIST_FILTER(LIST_TRANSFORM(wb, LAMBDA w: LOWER(w)), LAMBDA w: LENGTH(w) > 2) AS jb FROM pr),
s AS (SELECT *, 2e0*LEN(LIST_INTERSECT(ga, gb))/NULLIF(LEN(ga)+LEN(gb), 0) AS dice, LEN(LIST_INTERSECT(wa, wb)) AS shared FROM g)
SELECT text_id, RND(CASE WHEN a = '' OR b = '' THEN 0e0 WHEN a = b THEN 1e0 WHEN shared = LEN(wa) OR shared = LEN(wb) THEN 0.75e0 WHEN dice >= 0.62e0 THEN dice ELSE 0e0 END,6) AS similarity,
 RND(CASE WHEN LEN(ja) = 0 OR LEN(jb) = 0 THEN 0.5e0 ELSE CAST(LEN(LIST_INTERSECT(ja, jb)) AS DOUBLE)/LEN(LIST_DISTINCT(LIST_CONCAT(ja, jb))) END,6) AS jaccard FROM s""")
def label_similarity(spark, sf_dir):
    rows = fx(spark, sf_dir, "fx_labels").select("text_id", tx.normalise_label(F.col("raw")).alias("a"))
    following = rows.select((F.col("text_id") - 1).alias("text_id"), F.col("a").alias("b"))
    both = rows.join(following, "text_id")
    return rounded(both.select("text_id", tx.text_similarity(F.col("a"), F.col("b")).alias("similarity"), tx.word_jaccard(F.col("a"), F.col("b")).alias("jaccard")), 6, "similarity", "jaccard")


JUNK = """j AS (SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN '1.2m' WHEN 1 THEN NULL WHEN 2 THEN '3,5' WHEN 3 THEN ' 7 ' WHEN 4 THEN 'wide' WHEN 5 THEN '-2e1' WHEN 6 THEN '' ELSE '1.2.3' END AS n,
 CASE p_partkey % 6 WHEN 0 THEN '#abc' WHEN 1 THEN '12Ff00' WHEN 2 THEN 'red' WHEN 3 THEN NULL WHEN 4 THEN '##A0B1C2' ELSE '#12' END AS h, CASE p_partkey % 4 WHEN 0 THEN 'Very Large' WHEN 1 THEN 'small' WHEN 2 THEN 'huge' END AS s, p_name AS nm FROM part)"""
FX["fx_junk"] = "SELECT * FROM (" + JUNK.split("AS (", 1)[1][:-1] + ") q"


@query("tolerant_values", "STR-11", "PRJ-12", oracle="""
SELECT k, CASE k % 8 WHEN 0 THEN 1.2e0 WHEN 2 THEN 3.5e0 WHEN 3 THEN 7e0 WHEN 5 THEN -20e0 ELSE -1e0 END AS number, CASE k % 6 WHEN 0 THEN '#AABBCC' WHEN 1 THEN '#12FF00' WHEN 4 THEN '#A0B1C2' ELSE '#BFBFBF' END AS hex,
 CASE k % 4 WHEN 0 THEN 'very_large' WHEN 1 THEN 'small' ELSE 'medium' END AS bucket, COALESCE(NULLIF(TRIM(REGEXP_REPLACE(LOWER(TRIM(nm)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'none') AS slug,
 CASE WHEN k % 100 >= 65 THEN 'accept' WHEN k % 100 >= 40 THEN 'uncertain' ELSE 'discard' END AS band FROM fx_junk""")
def tolerant_values(spark, sf_dir):
    return fx(spark, sf_dir, "fx_junk").select(
        "k", coerce.tolerant_number(F.col("n"), -1.0).alias("number"), coerce.normalise_hex(F.col("h")).alias("hex"), coerce.size_bucket(F.col("s")).alias("bucket"),
        coerce.slug(F.col("nm"), "none").alias("slug"), coerce.confidence_band((F.col("k") % 100) / 100).alias("band"))


UNITS = """
rt AS (SELECT drawing_id, measurement/CAST(REGEXP_EXTRACT(REPLACE(text,' ',''), '[0-9]+') AS DOUBLE) AS r FROM fx_dimensions WHERE REGEXP_MATCHES(text, '[0-9]')),
md AS (SELECT drawing_id, LIST_SORT(LIST(r)) AS rs FROM rt GROUP BY drawing_id HAVING COUNT(*) >= 2),
dm AS (SELECT drawing_id FROM (SELECT drawing_id, rs, rs[LEN(rs)//2+1] AS m FROM md) WHERE ABS(rs[1]/m-1) <= 0.02e0 AND ABS(rs[LEN(rs)]/m-1) <= 0.02e0 AND (ABS(m-1) < 0.02e0 OR ABS(m-1000) < 20e0)),
ex AS (SELECT d.*, GREATEST(width, height) AS e FROM fx_drawings d),
gs AS (SELECT *, CASE WHEN e <= 0 THEN 1e0 WHEN e >= 150 THEN 0.001e0 WHEN e >= 60 THEN 0.3048e0 ELSE 1e0 END AS gscale, CASE WHEN e <= 0 THEN 'unknown' WHEN e >= 150 THEN 'millimetres' WHEN e >= 60 THEN 'feet' ELSE 'metres' END AS gname FROM ex),
gc AS (SELECT *, CASE WHEN e <= 0 THEN 0e0 WHEN e*gscale BETWEEN 3 AND 500 THEN 0.55e0 ELSE 0.25e0 END AS gconf FROM gs),
un AS (SELECT g.drawing_id, CASE WHEN user_scale > 0 AND user_scale <> 1 THEN user_scale WHEN i.scale IS NOT NULL AND (e = 0 OR e*i.scale BETWEEN 3 AND 500) THEN i.scale WHEN i.scale IS NOT NULL THEN gscale WHEN dm.drawing_id IS NOT NULL THEN 0.001e0 ELSE gscale END AS scale,
 CASE WHEN user_scale > 0 AND user_scale <> 1 THEN 'user-specified' WHEN i.scale IS NOT NULL AND (e = 0 OR e*i.scale BETWEEN 3 AND 500) THEN i.unit_name WHEN i.scale IS NOT NULL THEN gname WHEN dm.drawing_id IS NOT NULL THEN 'millimetres' ELSE gname END AS unit_name,
 CASE WHEN user_scale > 0 AND user_scale <> 1 THEN 'user' WHEN i.scale IS NOT NULL AND (e = 0 OR e*i.scale BETWEEN 3 AND 500) THEN 'header' WHEN i.scale IS NOT NULL THEN 'heuristic' WHEN dm.drawing_id IS NOT NULL THEN 'dimension' ELSE 'heuristic' END AS method,
 CASE WHEN user_scale > 0 AND user_scale <> 1 THEN 1e0 WHEN i.scale IS NOT NULL AND (e = 0 OR e*i.scale BETWEEN 3 AND 500) THEN 0.97e0 WHEN i.scale IS NOT NULL THEN LEAST(gconf, 0.5e0) WHEN dm.drawing_id IS NOT NULL THEN 0.90e0 ELSE gconf END AS confidence
 FROM gc g LEFT JOIN dim_insunits i ON i.insunits = g.insunits LEFT JOIN dm ON dm.drawing_id = g.drawing_id)"""
EXTENT = """
bd AS (SELECT drawing_id, COALESCE(MIN(LEAST(sx,ex)) FILTER (role IN ('wall','door')), MIN(LEAST(sx,ex)) FILTER (role <> 'furniture'), MIN(LEAST(sx,ex))) AS min_x, COALESCE(MIN(LEAST(sy,ey)) FILTER (role IN ('wall','door')), MIN(LEAST(sy,ey)) FILTER (role <> 'furniture'), MIN(LEAST(sy,ey))) AS min_y,
 COALESCE(MAX(GREATEST(sx,ex)) FILTER (role IN ('wall','door')), MAX(GREATEST(sx,ex)) FILTER (role <> 'furniture'), MAX(GREATEST(sx,ex))) AS max_x, COALESCE(MAX(GREATEST(sy,ey)) FILTER (role IN ('wall','door')), MAX(GREATEST(sy,ey)) FILTER (role <> 'furniture'), MAX(GREATEST(sy,ey))) AS max_y FROM fx_segments GROUP BY drawing_id)"""


@query("drawing_units", "UNI-01", oracle=f"WITH {UNITS} SELECT drawing_id, scale, unit_name, method, confidence FROM un")
def drawing_units(spark, sf_dir):
    return dr.resolve_units(fx(spark, sf_dir, "fx_drawings"), fx(spark, sf_dir, "fx_dimensions"))


@query("drawing_north", "UNI-02", oracle="""
SELECT drawing_id, RND(CASE WHEN north_direction IS NOT NULL THEN (DEGREES(north_direction) - 90e0) - 360e0*FLOOR((DEGREES(north_direction) - 90e0)/360e0) WHEN arrow_rotation IS NOT NULL THEN arrow_rotation - 360e0*FLOOR(arrow_rotation/360e0) ELSE 0e0 END,6) AS heading_deg,
 CASE WHEN north_direction IS NOT NULL THEN 'cad_metadata' WHEN arrow_rotation IS NOT NULL THEN 'cad_block' ELSE 'reasoning' END AS source, CASE WHEN north_direction IS NOT NULL THEN 0.95e0 WHEN arrow_rotation IS NOT NULL THEN 0.70e0 ELSE 0.15e0 END AS confidence FROM fx_drawings""")
def drawing_north(spark, sf_dir):
    return rounded(dr.resolve_north(fx(spark, sf_dir, "fx_drawings")), 6, "heading_deg")


@query("drawing_extent", "UNI-03", oracle=f"WITH {EXTENT} SELECT *, (min_x+max_x)/2e0 AS origin_x, (min_y+max_y)/2e0 AS origin_y FROM bd")
def drawing_extent(spark, sf_dir):
    return dr.structural_extent(fx(spark, sf_dir, "fx_segments"))


@query("segments_in_metres", "PRJ-05", "PRJ-06", oracle=f"""
WITH {UNITS}, {EXTENT}, m AS (SELECT s.entity_id, ROUND((sx-(min_x+max_x)/2e0)*scale,6) AS sx, ROUND((sy-(min_y+max_y)/2e0)*scale,6) AS sy, ROUND((ex-(min_x+max_x)/2e0)*scale,6) AS ex, ROUND((ey-(min_y+max_y)/2e0)*scale,6) AS ey FROM fx_segments s JOIN un USING (drawing_id) JOIN bd USING (drawing_id))
SELECT entity_id, RND(sx,4) AS sx, RND(sy,4) AS sy, RND(SQRT(POWER(ex-sx,2)+POWER(ey-sy,2)),4) AS length, RND((sx+ex)/2e0,4) AS mid_x, RND(DEGREES(ATAN2(ey-sy, ex-sx)) - 180e0*FLOOR(DEGREES(ATAN2(ey-sy, ex-sx))/180e0),4) AS angle_deg FROM m""")
def segments_in_metres(spark, sf_dir):
    segments = fx(spark, sf_dir, "fx_segments")
    moved = dr.to_metres(segments, dr.resolve_units(fx(spark, sf_dir, "fx_drawings"), fx(spark, sf_dir, "fx_dimensions")), dr.structural_extent(segments))
    return rounded(dr.measure_segments(moved).select("entity_id", "sx", "sy", "length", "mid_x", "angle_deg"), 4, "sx", "sy", "length", "mid_x", "angle_deg")


@query("short_segments", "PRJ-09", oracle="SELECT drawing_id, COUNT(*) FILTER (SQRT(POWER(ex-sx,2)+POWER(ey-sy,2)) < 100) AS removed FROM fx_segments GROUP BY drawing_id")
def short_segments(spark, sf_dir):
    return dr.drop_short(fx(spark, sf_dir, "fx_segments"), 100.0)[1]


@query("wall_selection", "PRJ-10", oracle="""
WITH a AS (SELECT *, UPPER(layer) IN ('A-WALL', 'WALLS_EXT') AS w FROM fx_segments), h AS (SELECT drawing_id, BOOL_OR(w) AS any_w FROM a GROUP BY drawing_id)
SELECT entity_id, drawing_id, layer FROM a JOIN h USING (drawing_id) WHERE CASE WHEN any_w THEN w ELSE role = 'wall' END""")
def wall_selection(spark, sf_dir):
    return dr.select_walls(fx(spark, sf_dir, "fx_segments"), ["a-wall", "walls_ext"]).select("entity_id", "drawing_id", "layer")


@query("distinct_segments", "PRJ-11", oracle="""
WITH s AS (SELECT entity_id, drawing_id % 5 AS d, sx % 3 AS ax, ex % 3 AS bx FROM fx_segments) SELECT d AS drawing_id, COUNT(*) AS n FROM (SELECT DISTINCT d, LEAST(ax, bx) AS a, GREATEST(ax, bx) AS b FROM s) GROUP BY d""")
def distinct_segments(spark, sf_dir):
    coarse = fx(spark, sf_dir, "fx_segments").select("entity_id", (F.col("drawing_id") % 5).alias("drawing_id"), (F.col("sx") % 3).alias("sx"), F.lit(0.0).alias("sy"), (F.col("ex") % 3).alias("ex"), F.lit(0.0).alias("ey"))
    return dr.distinct_segments(coarse).groupBy("drawing_id").agg(F.count("*").alias("n"))


@query("entity_histograms", "UNI-04", oracle="""
SELECT drawing_id, 'role' AS field, role AS value, COUNT(*) AS n FROM fx_segments GROUP BY ALL UNION ALL SELECT drawing_id, 'dxftype', dxftype, COUNT(*) FROM fx_segments GROUP BY ALL""")
def entity_histograms(spark, sf_dir):
    return dr.histograms(fx(spark, sf_dir, "fx_segments"), ["role", "dxftype"])


@query("layer_table", "SRC-02", oracle="""
WITH c AS (SELECT drawing_id, UPPER(layer) AS k, COUNT(*) AS n, MIN(layer) AS seen FROM fx_segments GROUP BY ALL), d AS (SELECT drawing_id, layer FROM fx_drawings CROSS JOIN (VALUES ('a-wall'), ('A-DOOR'), ('UNUSED')) v(layer))
SELECT COALESCE(d.drawing_id, c.drawing_id) AS drawing_id, COALESCE(d.layer, seen) AS layer, COALESCE(n, 0) AS entities, d.layer IS NOT NULL AS declared FROM d FULL OUTER JOIN c ON c.drawing_id = d.drawing_id AND c.k = UPPER(d.layer)""")
def layer_table(spark, sf_dir):
    declared = fx(spark, sf_dir, "fx_drawings").select("drawing_id", F.explode(F.array(F.lit("a-wall"), F.lit("A-DOOR"), F.lit("UNUSED"))).alias("layer"))
    return dr.layer_table(fx(spark, sf_dir, "fx_segments"), declared)


@query("plan_bounds", "PRJ-17", oracle="""
SELECT drawing_id, MIN(LEAST(sx,ex)) AS min_x, MIN(LEAST(sy,ey)) AS min_y, MAX(GREATEST(sx,ex)) AS max_x, MAX(GREATEST(sy,ey)) AS max_y, COUNT(*) AS segments FROM fx_segments GROUP BY drawing_id""")
def plan_bounds(spark, sf_dir):
    return dr.plan_bounds(fx(spark, sf_dir, "fx_segments"))


POLY = "poly AS (SELECT o_orderkey AS entity_id, o_custkey AS drawing_id, o_orderkey % 3 = 0 AS closed, CAST(o_orderkey % 50 AS DOUBLE) AS bx, CAST(o_orderkey % 7 AS DOUBLE) + 1e0 AS w, CAST(o_orderkey % 4 AS DOUBLE) AS h FROM orders)"


def polygons(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("entity_id"), F.col("o_custkey").alias("drawing_id"), (F.col("o_orderkey") % 3 == 0).alias("closed"),
        (F.col("o_orderkey") % 50).cast("double").alias("bx"), ((F.col("o_orderkey") % 7) + 1.0).alias("w"), (F.col("o_orderkey") % 4).cast("double").alias("h"))
    corner = F.col("bx") + F.col("w")
    return base.withColumn("points", F.array(g.point("bx", F.lit(0.0)), g.point(corner, F.lit(0.0)), g.point(corner, "h"), g.point("bx", F.col("h") * 2)))


@query("polyline_segments", "PRJ-01", oracle=f"""
WITH {POLY}, s AS (SELECT entity_id, 1 AS step, bx AS sx, 0e0 AS sy, bx+w AS ex, 0e0 AS ey FROM poly UNION ALL SELECT entity_id, 2, bx+w, 0e0, bx+w, h FROM poly UNION ALL SELECT entity_id, 3, bx+w, h, bx, 2*h FROM poly UNION ALL SELECT entity_id, 4, bx, 2*h, bx, 0e0 FROM poly WHERE closed)
SELECT * FROM s WHERE sx <> ex OR sy <> ey""")
def polyline_segments(spark, sf_dir):
    return dr.polyline_segments(polygons(spark, sf_dir)).drop("drawing_id")


@query("polygon_measures", "PRJ-07", "STR-14", oracle=f"""
WITH {POLY}, a AS (SELECT entity_id, bx, w, h, w*h*1.5e0 AS area FROM poly)
SELECT entity_id, RND(area,6) AS area, RND(CASE WHEN h = 0 THEN bx + w/2e0 ELSE bx + w*(0.5e0*1e0 + 1e0/3e0*0.5e0)/1.5e0 END,6) AS cx, RND(CASE WHEN h = 0 THEN 0e0 ELSE (h*h/2e0*1e0 + 0.5e0*h*(h+h/3e0))/(1.5e0*h) END,6) AS cy,
 1.1e0 > 0 AND h > 0 AND (0.4e0*h) < 2*h - 0.3e0*h AND 0.4e0*h > 0 AS inside FROM a""")
def polygon_measures(spark, sf_dir):
    rows = polygons(spark, sf_dir).withColumn("c", g.polygon_centroid(F.col("points")))
    return rounded(rows.select("entity_id", g.polygon_area(F.col("points")).alias("area"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy"),
                               g.in_polygon(F.col("bx") + F.col("w") * 0.3, F.col("h") * 0.4, F.col("points")).alias("inside")), 6, "area", "cx", "cy")


@query("rectangle_corners", "PRJ-08", oracle="""
SELECT object_id, RND(x + (-width*COS(RADIANS(rotation_deg)) + depth*SIN(RADIANS(rotation_deg)))/2e0,6) AS x1, RND(y + (-width*SIN(RADIANS(rotation_deg)) - depth*COS(RADIANS(rotation_deg)))/2e0,6) AS y1,
 RND(x + (width*COS(RADIANS(rotation_deg)) - depth*SIN(RADIANS(rotation_deg)))/2e0,6) AS x3 FROM fx_objects""")
def rectangle_corners(spark, sf_dir):
    rows = fx(spark, sf_dir, "fx_objects").withColumn("c", g.rect_corners("x", "y", "width", "depth", "rotation_deg"))
    return rounded(rows.select("object_id", F.col("c")[0]["x"].alias("x1"), F.col("c")[0]["y"].alias("y1"), F.col("c")[2]["x"].alias("x3")), 6, "x1", "y1", "x3")


@query("arc_chords", "PRJ-02", oracle=f"""
WITH {POLY}, a AS (SELECT entity_id, bx AS cx, h AS cy, w AS rx, w/2e0 AS ry, CAST(entity_id % 90 AS DOUBLE) AS rot, CAST(entity_id % 360 AS DOUBLE) AS st, CASE WHEN entity_id % 120 <= entity_id % 360 THEN CAST(entity_id % 120 AS DOUBLE) + 360e0 ELSE CAST(entity_id % 120 AS DOUBLE) END AS en FROM poly),
s AS (SELECT *, st + (en-st)*k/8e0 AS t0 FROM a CROSS JOIN (SELECT UNNEST(RANGE(0,8)) AS k))
SELECT entity_id, CAST(k AS INTEGER) AS step, RND(cx + rx*COS(RADIANS(t0))*COS(RADIANS(rot)) - ry*SIN(RADIANS(t0))*SIN(RADIANS(rot)),6) AS sx, RND(cy + rx*COS(RADIANS(t0))*SIN(RADIANS(rot)) + ry*SIN(RADIANS(t0))*COS(RADIANS(rot)),6) AS sy FROM s""")
def arc_chords(spark, sf_dir):
    arcs = polygons(spark, sf_dir).select(
        "drawing_id", "entity_id", F.col("bx").alias("cx"), F.col("h").alias("cy"), F.col("w").alias("rx"), (F.col("w") / 2).alias("ry"), (F.col("entity_id") % 90).cast("double").alias("rotation_deg"),
        (F.col("entity_id") % 360).cast("double").alias("start_deg"), (F.col("entity_id") % 120).cast("double").alias("end_deg"))
    return rounded(dr.tessellate_arcs(arcs, 8).select("entity_id", "step", "sx", "sy"), 6, "sx", "sy")


@query("mirrored_points", "PRJ-04", oracle="SELECT entity_id, CASE WHEN entity_id % 3 = 0 THEN -sx ELSE sx END AS sx, sy FROM fx_segments")
def mirrored_points(spark, sf_dir):
    rows = fx(spark, sf_dir, "fx_segments").withColumn("extrusion_z", F.when(F.col("entity_id") % 3 == 0, -1.0).otherwise(1.0))
    return dr.mirrored_to_world(rows, ["sx", "ex"]).select("entity_id", "sx", "sy")


