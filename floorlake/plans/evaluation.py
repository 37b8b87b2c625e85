"""Queries over findings and axis scores, and the flagship building report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import fx
from ..operators import evaluation as ev
from ..session import cut_lineage
from .registry import query

MERGED = """
per_key AS (
  SELECT axis, subsystem, code, room_id, object_id, COUNT(*) AS agreeing, COUNT(DISTINCT viewpoint_id) AS viewpoints_seen
  FROM fx_findings GROUP BY ALL),
worst AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY axis, subsystem, code, room_id, object_id
    ORDER BY ROUND(severity,6) DESC, ROUND(confidence,6) DESC, difference, viewpoint_id) AS rn FROM fx_findings) WHERE rn = 1),
merged AS (
  SELECT w.axis, w.subsystem, w.code, w.room_id, w.object_id, w.severity,
    CASE WHEN agreeing > 1 THEN LEAST(0.99e0, w.confidence + 0.05e0*(agreeing-1)) ELSE w.confidence END AS confidence,
    w.difference, CASE WHEN agreeing > 1 THEN NULL ELSE w.viewpoint_id END AS viewpoint_id, agreeing, viewpoints_seen
  FROM worst w JOIN per_key USING (axis, subsystem, code, room_id, object_id))"""

TOP = """
top AS (SELECT * FROM (SELECT m.*, r.building_id, ROW_NUMBER() OVER (PARTITION BY r.building_id ORDER BY ROUND(m.severity,6) DESC, ROUND(m.confidence,6) DESC,
  m.axis, m.subsystem, m.code, m.room_id, m.object_id) AS rank FROM merged m JOIN fx_rooms r USING (room_id)) WHERE rank <= 12)"""

ROOM_AXES = """
room_axes AS (SELECT room_id, axis,
  CASE WHEN COUNT(*) FILTER (measured) > 0 THEN SUM(score*GREATEST(0.05e0, confidence)) FILTER (measured) / SUM(GREATEST(0.05e0, confidence)) FILTER (measured) ELSE 0e0 END AS score,
  CASE WHEN COUNT(*) FILTER (measured) > 0 THEN AVG(confidence) FILTER (measured) ELSE 0e0 END AS confidence,
  COUNT(*) FILTER (measured) > 0 AS measured, COUNT(*) FILTER (measured) AS sources,
  COALESCE(MAX(score) FILTER (measured) - MIN(score) FILTER (measured), 0e0) AS spread
  FROM fx_axis_scores GROUP BY room_id, axis)"""


def combine_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys},
  CASE WHEN SUM(weight) FILTER (measured) > 0 THEN SUM(weight*score) FILTER (measured)/SUM(weight) FILTER (measured) ELSE 0e0 END AS score,
  CASE WHEN SUM(weight) FILTER (measured) > 0 THEN SUM(weight*confidence) FILTER (measured)/SUM(weight) FILTER (measured)*SUM(weight) FILTER (measured) ELSE 0e0 END AS confidence,
  COALESCE(SUM(weight) FILTER (measured), 0e0) AS weight_used, COUNT(*) FILTER (measured) AS axes_measured
  FROM {source} JOIN dim_axis_weights USING (axis) GROUP BY {keys}"""


BUILDING = f"""
keyed AS (SELECT a.*, building_id, area FROM room_axes a JOIN fx_rooms USING (room_id)),
room_totals AS ({combine_sql('keyed', 'building_id, room_id, area')}),
b_axes AS (SELECT building_id, axis,
  CASE WHEN COUNT(*) FILTER (measured) > 0 THEN SUM(score*GREATEST(0.05e0, confidence)) FILTER (measured) / SUM(GREATEST(0.05e0, confidence)) FILTER (measured) ELSE 0e0 END AS score,
  CASE WHEN COUNT(*) FILTER (measured) > 0 THEN AVG(confidence) FILTER (measured) ELSE 0e0 END AS confidence,
  COUNT(*) FILTER (measured) > 0 AS measured FROM keyed GROUP BY building_id, axis),
b_tot AS ({combine_sql('b_axes', 'building_id')}),
rollup_b AS (SELECT t.building_id, r.score, t.confidence, t.weight_used, rooms_total, rooms_assessed FROM b_tot t JOIN (
  SELECT building_id, SUM(score*CASE WHEN area > 0.1e0 THEN area ELSE 1e0 END) FILTER (weight_used > 0)/SUM(CASE WHEN area > 0.1e0 THEN area ELSE 1e0 END) FILTER (weight_used > 0) AS score,
  COUNT(*) AS rooms_total, COUNT(*) FILTER (weight_used > 0) AS rooms_assessed FROM room_totals GROUP BY building_id) r USING (building_id))"""

TIES = ["subsystem", "code", "room_id", "object_id"]


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round for output. The nudge keeps exact decimal ties from depending on summation order."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, digits) for c in columns})


def merged_with_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = ev.merge_findings(fx(spark, sf_dir, "fx_findings"))
    return merged.join(fx(spark, sf_dir, "fx_rooms").select("room_id", "building_id"), "room_id")


def room_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of rooms, written once: their rollup reads them several times."""
    return cut_lineage(ev.room_axes(fx(spark, sf_dir, "fx_axis_scores"), ["room_id"]))


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.building_rollup(room_scores(spark, sf_dir), fx(spark, sf_dir, "fx_rooms"))


@query("building_report", "AG-18", "AG-20", "AG-21", "AG-22", "WN-01", oracle=f"""
WITH {MERGED}, {TOP}, {ROOM_AXES}, {BUILDING},
pressure AS (SELECT building_id, subsystem, SUM(severity*confidence) AS pressure FROM top GROUP BY building_id, subsystem),
first_fix AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY building_id ORDER BY ROUND(pressure,6) DESC, subsystem) AS rn FROM pressure) WHERE rn = 1)
SELECT r.building_id, RND(r.score,4) AS score, RND(r.confidence,4) AS confidence, RND(weight_used,4) AS weight_used, rooms_total, rooms_assessed,
  rank, axis, t.subsystem AS finding_subsystem, code, room_id, object_id, RND(severity,4) AS severity, RND(t.confidence,4) AS finding_confidence, agreeing,
  f.subsystem AS fix_first, RND(f.pressure,4) AS pressure
FROM rollup_b r JOIN top t USING (building_id) JOIN first_fix f USING (building_id)""")
def building_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per building: area-weighted score, its 12 worst findings, the subsystem to fix first."""
    top = cut_lineage(ev.top_findings(merged_with_building(spark, sf_dir), ["building_id"], TIES))
    pressure = ev.subsystem_pressure(top, ["building_id"])
    first = (
        pressure.groupBy("building_id")
        .agg(F.min(F.struct((-F.round("pressure", 6)).alias("p"), "subsystem", "pressure")).alias("f"))
        .select("building_id", F.col("f.subsystem").alias("fix_first"), F.round(F.col("f.pressure") + 1e-9, 4).alias("pressure"))
    )
    scores = rounded(rollup(spark, sf_dir), 4, "score", "confidence", "weight_used")
    top = top.select(
        "building_id", "rank", "axis", F.col("subsystem").alias("finding_subsystem"), "code", "room_id", "object_id",
        F.round(F.col("severity") + 1e-9, 4).alias("severity"), F.round(F.col("confidence") + 1e-9, 4).alias("finding_confidence"), "agreeing",
    )
    return scores.join(top, "building_id").join(first, "building_id")


@query("finding_merge", "AG-21", oracle=f"""
WITH {MERGED} SELECT axis, subsystem, code, room_id, object_id, RND(severity,6) AS severity, RND(confidence,6) AS confidence, difference, viewpoint_id, agreeing, viewpoints_seen FROM merged""")
def finding_merge(spark, sf_dir):
    return rounded(ev.merge_findings(fx(spark, sf_dir, "fx_findings")), 6, "severity", "confidence")


@query("finding_viewpoint_links", "AG-21", oracle="""
SELECT DISTINCT axis, subsystem, code, room_id, object_id, viewpoint_id FROM fx_findings""")
def finding_viewpoint_links(spark, sf_dir):
    return ev.finding_viewpoints(fx(spark, sf_dir, "fx_findings"))


@query("top_findings", "WN-01", "WN-07", oracle=f"""
WITH {MERGED}, {TOP} SELECT building_id, rank, axis, subsystem, code, room_id, object_id, RND(severity,6) AS severity, RND(confidence,6) AS confidence FROM top""")
def top_findings(spark, sf_dir):
    top = ev.top_findings(merged_with_building(spark, sf_dir), ["building_id"], TIES)
    return rounded(top, 6, "severity", "confidence").select(
        "building_id", "rank", "axis", "subsystem", "code", "room_id", "object_id", "severity", "confidence"
    )


@query("subsystem_pressure", "AG-22", oracle=f"""
WITH {MERGED} SELECT room_id, subsystem, RND(SUM(severity*confidence),4) AS pressure, COUNT(*) AS findings FROM merged GROUP BY room_id, subsystem""")
def subsystem_pressure(spark, sf_dir):
    merged = ev.merge_findings(fx(spark, sf_dir, "fx_findings"))
    return rounded(ev.subsystem_pressure(merged, ["room_id"]), 4, "pressure")


@query("axis_combine", "AG-18", oracle=f"""
WITH x AS ({combine_sql('fx_axis_scores', 'room_id, viewpoint_id')})
SELECT room_id, viewpoint_id, RND(score,6) AS score, RND(confidence,6) AS confidence, RND(weight_used,6) AS weight_used, axes_measured FROM x""")
def axis_combine(spark, sf_dir):
    scores = ev.combine_axes(fx(spark, sf_dir, "fx_axis_scores"), ["room_id", "viewpoint_id"])
    return rounded(scores, 6, "score", "confidence", "weight_used")


@query("axis_merge", "AG-19", oracle=f"""
WITH {ROOM_AXES} SELECT room_id, axis, RND(score,6) AS score, RND(confidence,6) AS confidence, measured, sources, RND(spread,6) AS spread,
 CASE WHEN measured THEN '' ELSE 'not measured in any viewpoint' END AS reason FROM room_axes""")
def axis_merge(spark, sf_dir):
    return rounded(ev.merge_axes(fx(spark, sf_dir, "fx_axis_scores"), ["room_id"]) , 6, "score", "confidence", "spread")


@query("building_rollup", "AG-20", oracle=f"""
WITH {ROOM_AXES}, {BUILDING} SELECT building_id, RND(score,6) AS score, RND(confidence,6) AS confidence, RND(weight_used,6) AS weight_used, rooms_total, rooms_assessed FROM rollup_b""")
def building_rollup(spark, sf_dir):
    return rounded(rollup(spark, sf_dir), 6, "score", "confidence", "weight_used")


@query("reference_coverage", "AG-23", oracle="""
WITH v AS (SELECT room_id, viewpoint_id, BOOL_OR(measured) AS evaluated, BOOL_OR(measured AND axis = 'colour') AS has_reference FROM fx_axis_scores GROUP BY 1,2)
SELECT building_id, COUNT(*) AS viewpoints_total, COUNT(*) FILTER (evaluated) AS viewpoints_evaluated, COUNT(*) FILTER (has_reference) AS viewpoints_with_reference,
 ROUND(CAST(COUNT(*) FILTER (has_reference) AS DOUBLE)/COUNT(*),3) AS reference_coverage FROM v JOIN fx_rooms USING (room_id) GROUP BY building_id""")
def reference_coverage(spark, sf_dir):
    views = (
        fx(spark, sf_dir, "fx_axis_scores")
        .groupBy("room_id", "viewpoint_id")
        .agg(
            F.bool_or("measured").alias("evaluated"),
            F.bool_or(F.col("measured") & (F.col("axis") == "colour")).alias("has_reference"),
        )
        .join(fx(spark, sf_dir, "fx_rooms").select("room_id", "building_id"), "room_id")
    )
    return ev.coverage(views, ["building_id"])


@query("reported_rooms", "AG-32", oracle="""
SELECT DISTINCT room_id FROM fx_axis_scores UNION SELECT room_id FROM fx_rooms""")
def reported_rooms(spark, sf_dir):
    return ev.room_ids(fx(spark, sf_dir, "fx_axis_scores"), fx(spark, sf_dir, "fx_rooms"), ["room_id"])
