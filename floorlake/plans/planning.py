"""Queries that turn findings into plans. Candidate actions are one per root cause."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fx
from ..operators import evaluation as ev
from ..operators import planning as pl
from ..session import cut_lineage
from . import evaluation as base
from .registry import query

PLANNED = f"""{base.MERGED},
planned AS (SELECT m.*, building_id, severity*confidence AS weight,
  CASE WHEN object_id >= 0 THEN CONCAT('object:', CAST(object_id AS VARCHAR)) ELSE CONCAT('room:', CAST(room_id AS VARCHAR)) END AS scope FROM merged m JOIN fx_rooms USING (room_id))"""
GROUPS = f"""{PLANNED},
grp AS (SELECT building_id, subsystem, scope, action_type, LEAST(1e0, SUM(weight)) AS weight, AVG(confidence) AS confidence, COUNT(*) AS findings, MIN(room_id) AS room_id,
  LIST_SORT(LIST(DISTINCT axis)) AS axes FROM planned JOIN dim_subsystem_actions USING (subsystem) GROUP BY building_id, subsystem, scope, action_type)"""
ACTIONS = f"""{GROUPS},
cand AS (SELECT building_id, CONCAT(action_type, '|', scope) AS action_id, action_type, scope AS target, confidence, ROUND(weight,9) AS evidence, findings AS triggers, axes, subsystem, room_id, scope FROM grp),
acts AS (SELECT building_id, action_id, MIN(action_type) AS action_type, MIN(target) AS target, ROUND(MAX(confidence),9) AS confidence, ARG_MAX(evidence, subsystem) AS evidence, CAST(SUM(triggers) AS BIGINT) AS triggers,
  LIST_SORT(LIST_DISTINCT(FLATTEN(LIST(axes)))) AS axes FROM cand GROUP BY building_id, action_id),
scopes AS (SELECT DISTINCT building_id, action_id, 'object' AS kind, SUBSTRING(scope, 8) AS entity FROM cand WHERE scope LIKE 'object:%'
  UNION SELECT DISTINCT building_id, action_id, 'room', CAST(room_id AS VARCHAR) FROM cand)"""
PRICED = f"""{base.ROOM_AXES}, {base.BUILDING}, {ACTIONS},
hr AS (SELECT building_id, axis, CASE WHEN measured THEN GREATEST(0e0, 1e0-ROUND(score,9)) ELSE 0e0 END AS h, measured FROM b_axes),
joined AS (SELECT a.building_id, a.action_id, a.action_type, a.target, a.confidence, a.evidence, a.axes, efficacy, MAX(h) AS headroom, NOT BOOL_OR(h.measured) AS unverifiable,
   (SELECT COUNT(*) FROM scopes s WHERE s.building_id = a.building_id AND s.action_id = a.action_id AND kind = 'object') AS objects
  FROM acts a JOIN hr h ON h.building_id = a.building_id AND LIST_CONTAINS(a.axes, h.axis) JOIN dim_efficacy e ON e.action_type = a.action_type GROUP BY ALL),
gains AS (SELECT *, LEAST(1e0, GREATEST(0e0, evidence*efficacy*headroom*CASE WHEN unverifiable THEN 0.25e0 ELSE 1e0 END)) AS expected_gain,
  ROUND(CASE WHEN action_type = 'camera_correction' THEN 0.15e0 ELSE 1e0 END + 0.03e0*objects, 4) AS cost,
  LEAST(1e0, GREATEST(0e0, (1e0-confidence)*0.6e0 + LEAST(0.4e0, 0.05e0*objects))) AS risk FROM joined),
priced AS (SELECT *, ROUND(expected_gain*(1e0-0.5e0*risk)/(0.5e0+cost), 6) AS priority FROM gains),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY building_id ORDER BY ROUND(priority,6) DESC, ROUND(cost,6), action_id) AS rank FROM priced)"""


def planned(spark, sf_dir):
    return pl.planned_findings(base.merged_with_building(spark, sf_dir))


def candidates(groups):
    return groups.select(
        "building_id", F.concat_ws("|", "action_type", "scope").alias("action_id"), "action_type",
        F.col("scope").alias("target"), "confidence", F.round("weight", 9).alias("evidence"),
        F.col("findings").alias("triggers"), "axes", F.col("subsystem").alias("ordinal"), "room_id", "scope")


def actions_and_scopes(spark, sf_dir):
    found = cut_lineage(candidates(pl.group_findings(planned(spark, sf_dir))))
    acts = pl.deduplicate_actions(found).withColumn("confidence", F.round("confidence", 9))
    objects = found.filter("scope LIKE 'object:%'").select("building_id", "action_id", F.lit("object").alias("kind"), F.expr("substring(scope, 8)").alias("entity"))
    rooms = found.select("building_id", "action_id", F.lit("room").alias("kind"), F.col("room_id").cast("string").alias("entity"))
    return acts, objects.union(rooms).distinct()


def priced(spark, sf_dir):
    acts, scopes = actions_and_scopes(spark, sf_dir)
    rooms = fx(spark, sf_dir, "fx_rooms")
    axes = base.room_scores(spark, sf_dir)
    scores = ev.merge_axes(axes.join(rooms.select("room_id", "building_id"), "room_id"), ["building_id"]).withColumn("score", F.round("score", 9))
    baselines = ev.building_rollup(axes, rooms).select("building_id", F.col("score").alias("baseline"))
    counts = scopes.filter("kind = 'object'").groupBy("building_id", "action_id").agg(F.count("*").alias("objects"))
    return pl.price_actions(acts, scores, baselines, counts), scopes, baselines


@query("finding_scopes", "PN-01", oracle=f"""
WITH {PLANNED} SELECT building_id, axis, subsystem, code, room_id, object_id, scope, RND(weight,6) AS weight FROM planned""")
def finding_scopes(spark, sf_dir):
    return base.rounded(planned(spark, sf_dir), 6, "weight").select(
        "building_id", "axis", "subsystem", "code", "room_id", "object_id", "scope", "weight")


@query("root_cause_groups", "PN-02", oracle=f"""
WITH {GROUPS} SELECT building_id, subsystem, scope, action_type, RND(weight,6) AS weight, RND(confidence,6) AS confidence, findings, LIST_AGGREGATE(axes, 'string_agg', ',') AS axes FROM grp""")
def root_cause_groups(spark, sf_dir):
    groups = pl.group_findings(planned(spark, sf_dir)).drop("room_id").withColumn("axes", F.array_join("axes", ","))
    return base.rounded(groups, 6, "weight", "confidence")


@query("unactionable_findings", "PN-02", oracle=f"""
WITH {PLANNED} SELECT building_id, axis, subsystem, code, room_id, object_id, reason FROM planned JOIN dim_unactionable USING (subsystem)""")
def unactionable_findings(spark, sf_dir):
    return pl.unactionable_findings(planned(spark, sf_dir)).select(
        "building_id", "axis", "subsystem", "code", "room_id", "object_id", "reason")


@query("action_dedupe", "PN-06", oracle=f"""
WITH {ACTIONS} SELECT building_id, action_id, action_type, target, RND(confidence,6) AS confidence, RND(evidence,6) AS evidence, triggers, LIST_AGGREGATE(axes, 'string_agg', ',') AS axes FROM acts""")
def action_dedupe(spark, sf_dir):
    acts, _ = actions_and_scopes(spark, sf_dir)
    return base.rounded(acts, 6, "confidence", "evidence").withColumn("axes", F.array_join("axes", ","))


@query("action_pricing", "PN-07", oracle=f"""
WITH {PRICED} SELECT building_id, action_id, RND(headroom,6) AS headroom, unverifiable, RND(expected_gain,6) AS expected_gain, cost, RND(risk,6) AS risk, priority FROM priced""")
def action_pricing(spark, sf_dir):
    table, _, _ = priced(spark, sf_dir)
    return base.rounded(table, 6, "headroom", "expected_gain", "risk").select(
        "building_id", "action_id", "headroom", "unverifiable", "expected_gain", "cost", "risk", "priority")


@query("action_rank", "WN-09", oracle=f"WITH {PRICED} SELECT building_id, action_id, rank FROM ranked")
def action_rank(spark, sf_dir):
    return pl.rank_actions(priced(spark, sf_dir)[0]).select("building_id", "action_id", "rank")


@query("action_filter", "PN-08", oracle=f"""
WITH {PRICED} SELECT building_id, action_id, CASE WHEN action_type = 'camera_correction' THEN 'not enabled for this run' WHEN unverifiable THEN 'targets only unmeasured axes' WHEN expected_gain < 0.1e0 THEN 'below the gain floor' ELSE '' END AS rejection FROM priced""")
def action_filter(spark, sf_dir):
    allowed = ["material_adjustment", "lighting_adjustment", "palette_adjustment", "asset_replacement", "decor_density", "furniture_translation"]
    return pl.filter_actions(priced(spark, sf_dir)[0], allowed, min_gain=0.1).select("building_id", "action_id", "rejection")


@query("plan_gain", "WN-08", oracle=f"""
WITH {PRICED}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY building_id, axes[1] ORDER BY rank) AS kth FROM ranked)
SELECT building_id, ROUND(LEAST(SUM(expected_gain*POWER(0.6e0, kth-1)), MAX(GREATEST(0e0, 1e0-score))),4) AS plan_gain FROM k JOIN rollup_b USING (building_id) GROUP BY building_id""")
def plan_gain(spark, sf_dir):
    table, _, baselines = priced(spark, sf_dir)
    return pl.plan_gain(table, baselines)


@query("ordering_edges", "PN-10", oracle=f"""
WITH {ACTIONS} SELECT DISTINCT a.building_id, a.action_id AS earlier_id, b.action_id AS later_id
FROM acts a JOIN scopes s ON s.building_id = a.building_id AND s.action_id = a.action_id
 JOIN scopes t ON t.building_id = s.building_id AND t.kind = s.kind AND t.entity = s.entity
 JOIN acts b ON b.building_id = t.building_id AND b.action_id = t.action_id
 JOIN dim_ordering o ON o.earlier_type = a.action_type AND o.later_type = b.action_type WHERE a.action_id <> b.action_id""")
def ordering_edges(spark, sf_dir):
    return pl.ordering_edges(*actions_and_scopes(spark, sf_dir))


@query("plan_order", "GR-10")
def plan_order(spark, sf_dir):
    table, scopes, _ = priced(spark, sf_dir)
    return pl.order_plan(pl.rank_actions(table), scopes)





@query("plan_exclusions", "PN-09", oracle=f"""
WITH RECURSIVE {PRICED},
v AS (SELECT building_id, action_id, rank, target, CASE action_type WHEN 'decor_density' THEN 'asset_variant_swap' WHEN 'furniture_translation' THEN 'furniture_scale_refinement' ELSE action_type END AS t FROM ranked),
pairs AS (SELECT a.building_id, a.action_id AS winner, b.action_id AS loser, a.rank AS wr, b.rank AS lr FROM v a JOIN v b ON a.building_id = b.building_id AND a.target = b.target AND a.rank < b.rank
  AND (a.t = b.t OR EXISTS (SELECT 1 FROM dim_exclusive e WHERE (e.left_type = a.t AND e.right_type = b.t) OR (e.left_type = b.t AND e.right_type = a.t)))),
-- at most three actions share a target, so two unrolled rounds settle every chain
r1 AS (SELECT building_id, action_id FROM v WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.building_id = v.building_id AND p.loser = v.action_id)),
d1 AS (SELECT DISTINCT p.building_id, p.loser FROM pairs p JOIN r1 ON r1.building_id = p.building_id AND r1.action_id = p.winner),
r2 AS (SELECT building_id, action_id FROM v WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.building_id = v.building_id AND p.loser = v.action_id
   AND NOT EXISTS (SELECT 1 FROM d1 WHERE d1.building_id = p.building_id AND d1.loser = p.winner))),
d2 AS (SELECT DISTINCT p.building_id, p.loser FROM pairs p JOIN r2 ON r2.building_id = p.building_id AND r2.action_id = p.winner)
SELECT v.building_id, v.action_id, v.rank, (d2.loser IS NOT NULL) AS excluded FROM v LEFT JOIN d2 ON d2.building_id = v.building_id AND d2.loser = v.action_id""")
def plan_exclusions(spark, sf_dir):
    table, scopes, _ = priced(spark, sf_dir)
    renamed = F.when(F.col("action_type") == "decor_density", "asset_variant_swap").when(
        F.col("action_type") == "furniture_translation", "furniture_scale_refinement").otherwise(F.col("action_type"))
    ranked = pl.rank_actions(table).withColumn("action_type", renamed)
    return pl.exclude_contradictions(ranked, scopes).select("building_id", "action_id", "rank", "excluded")


@query("ready_actions", "GR-10", oracle=f"""
WITH {ACTIONS}, done AS (SELECT building_id, action_id FROM acts WHERE LENGTH(action_id) % 2 = 0),
edges AS (SELECT DISTINCT a.building_id, a.action_id AS earlier_id, b.action_id AS later_id
 FROM acts a JOIN scopes s ON s.building_id = a.building_id AND s.action_id = a.action_id
 JOIN scopes t ON t.building_id = s.building_id AND t.kind = s.kind AND t.entity = s.entity
 JOIN acts b ON b.building_id = t.building_id AND b.action_id = t.action_id
 JOIN dim_ordering o ON o.earlier_type = a.action_type AND o.later_type = b.action_type WHERE a.action_id <> b.action_id)
SELECT building_id, action_id FROM acts a WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.building_id = a.building_id AND d.action_id = a.action_id)
 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.building_id = a.building_id AND e.later_id = a.action_id AND NOT EXISTS (SELECT 1 FROM done d WHERE d.building_id = e.building_id AND d.action_id = e.earlier_id))""")
def ready_actions(spark, sf_dir):
    acts, scopes = actions_and_scopes(spark, sf_dir)
    done = acts.filter(F.length("action_id") % 2 == 0).select("building_id", "action_id")
    return pl.ready_actions(acts, pl.ordering_edges(acts, scopes), done).select("building_id", "action_id")


@query("plan_diagnostics", "PN-11", oracle=f"""
WITH {PRICED} SELECT building_id, f AS findings_considered, g AS root_causes, m AS findings_merged, p AS proposed, d AS dropped FROM
 (SELECT building_id, COUNT(*) AS f FROM planned GROUP BY 1) JOIN
 (SELECT building_id, COUNT(*) AS g, CAST(COALESCE(SUM(findings) FILTER (findings > 1),0) AS BIGINT) AS m FROM grp GROUP BY 1) USING (building_id) JOIN
 (SELECT building_id, COUNT(*) AS p, COUNT(*) FILTER (unverifiable OR expected_gain < 0.002e0) AS d FROM priced GROUP BY 1) USING (building_id)""")
def plan_diagnostics(spark, sf_dir):
    found = planned(spark, sf_dir)
    return pl.plan_diagnostics(found, pl.group_findings(found), pl.filter_actions(priced(spark, sf_dir)[0]))
