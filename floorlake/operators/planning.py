"""From merged findings to ranked, ordered, mutually compatible actions.

Tables, all keyed by building first:
``actions``  building_id, action_id, action_type, target, confidence, evidence, axes (at most five)
``scopes``   building_id, action_id, kind ('object' | 'material' | 'room'), entity
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import dim
from ..session import cut_lineage
from .scale import rank_within, top_within

DEFAULT_EFFICACY = 0.3
UNVERIFIABLE_PENALTY = 0.25
OVERLAP_DECAY = 0.6
MIN_GAIN = 0.002
PLAN_LIMIT = 24


def clamp(value: Column, low, high) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def planned_findings(findings: DataFrame) -> DataFrame:
    """Adds ``scope`` (first object, else first material, else room, else building) and ``weight``."""
    material = F.col("material") if "material" in findings.columns else F.lit(None).cast("string")
    scope = (
        F.when(F.col("object_id") >= 0, F.concat(F.lit("object:"), F.col("object_id").cast("string")))
        .when(F.coalesce(material, F.lit("")) != "", F.concat(F.lit("material:"), material))
        .when(F.col("room_id").isNotNull(), F.concat(F.lit("room:"), F.col("room_id").cast("string")))
        .otherwise("building")
    )
    return findings.withColumn("scope", scope).withColumn("weight", F.col("severity") * F.col("confidence"))


def group_findings(planned: DataFrame, building: str = "building_id") -> DataFrame:
    """Root causes: one row per (subsystem, scope) that some action type answers."""
    spark = planned.sparkSession
    mapped = planned.join(F.broadcast(dim(spark, "dim_subsystem_actions")), "subsystem")
    return mapped.groupBy(building, "subsystem", "scope", "action_type").agg(
        F.least(F.lit(1.0), F.sum("weight")).alias("weight"),
        F.avg("confidence").alias("confidence"),
        F.count("*").alias("findings"),
        F.min("room_id").alias("room_id"),
        F.sort_array(F.collect_set("axis")).alias("axes"),
    )


def unactionable_findings(planned: DataFrame) -> DataFrame:
    spark = planned.sparkSession
    known = dim(spark, "dim_subsystem_actions").select("subsystem")
    rest = planned.join(F.broadcast(known), "subsystem", "left_anti")
    reasons = F.broadcast(dim(spark, "dim_unactionable"))
    missing = F.concat(F.lit("no action type answers '"), F.col("subsystem"), F.lit("'"))
    return rest.join(reasons, "subsystem", "left").withColumn("reason", F.coalesce("reason", missing))


def deduplicate_actions(candidates: DataFrame, building: str = "building_id") -> DataFrame:
    """One row per action id: highest confidence, strongest evidence seen last, union of axes.

    ``candidates`` carries ``ordinal``; the first candidate keeps its type and target, the last its evidence.
    """
    grouped = candidates.groupBy(building, "action_id").agg(
        F.min(F.struct("ordinal", "action_type", "target")).alias("first"),
        F.max(F.struct("ordinal", "evidence")).alias("last"),
        F.max("confidence").alias("confidence"),
        F.sum("triggers").alias("triggers"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("axes")))).alias("axes"),
    )
    return grouped.select(
        building, "action_id", F.col("first.action_type").alias("action_type"), F.col("first.target").alias("target"),
        "confidence", F.col("last.evidence").alias("evidence"), "triggers", "axes",
    )


def price_actions(actions: DataFrame, axis_scores: DataFrame, baselines: DataFrame, object_counts: DataFrame,
                  building: str = "building_id") -> DataFrame:
    """Expected gain, cost, risk and priority.

    ``axis_scores``: building, axis, score, measured (five rows a building); ``baselines``: building,
    baseline; ``object_counts``: building, action_id, objects.
    """
    headroom = axis_scores.groupBy(building).agg(
        F.map_from_entries(F.collect_list(F.struct(
            "axis", F.when(F.col("measured"), F.greatest(F.lit(0.0), 1 - F.col("score"))).otherwise(0.0)
        ))).alias("_headroom"),
        F.collect_set(F.when(~F.col("measured"), F.col("axis"))).alias("_unmeasured"),
    )
    joined = (
        actions.join(headroom, building, "left")
        .join(baselines, building, "left")
        .join(object_counts, [building, "action_id"], "left")
        .join(F.broadcast(dim(actions.sparkSession, "dim_efficacy")), "action_type", "left")
        .withColumn("objects", F.coalesce("objects", F.lit(0)))
    )
    no_axes = F.size("axes") == 0
    best_axis = F.array_max(F.transform("axes", lambda a: F.coalesce(F.try_element_at("_headroom", a), F.lit(0.0))))
    unverifiable = ~no_axes & (F.size(F.array_except("axes", "_unmeasured")) == 0)
    base_cost = F.when(F.col("action_type") == "camera_correction", 0.15).otherwise(1.0)
    priced = (
        joined.withColumn("headroom", F.when(no_axes, F.greatest(F.lit(0.0), 1 - F.col("baseline"))).otherwise(best_axis))
        .withColumn("unverifiable", F.coalesce(unverifiable, F.lit(False)))
        .withColumn("efficacy", F.coalesce("efficacy", F.lit(DEFAULT_EFFICACY)))
        .withColumn("expected_gain", clamp(
            F.coalesce("evidence", "confidence") * F.col("efficacy") * F.col("headroom")
            * F.when(F.col("unverifiable"), UNVERIFIABLE_PENALTY).otherwise(1.0), 0.0, 1.0))
        .withColumn("cost", F.round(base_cost + 0.03 * F.col("objects"), 4))
        .withColumn("risk", clamp((1 - F.col("confidence")) * 0.6 + F.least(F.lit(0.4), 0.05 * F.col("objects")), 0.0, 1.0))
        .withColumn("priority", F.round(F.col("expected_gain") * (1 - 0.5 * F.col("risk")) / (0.5 + F.col("cost")), 6))
    )
    return priced.drop("_headroom", "_unmeasured")


def action_order() -> list[Column]:
    return [F.round("priority", 6).desc(), F.round("cost", 6).asc(), F.asc("action_id")]


def rank_actions(actions: DataFrame, building: str = "building_id") -> DataFrame:
    return rank_within(actions, [building], action_order())


def filter_actions(actions: DataFrame, allowed: list[str] | None = None, include_unverifiable: bool = False,
                   min_gain: float = MIN_GAIN) -> DataFrame:
    """Adds ``rejection``: the first reason that applies, empty when the action stays."""
    permitted = F.col("action_type").isin(*allowed) if allowed else F.lit(True)
    reason = F.when(~permitted, "not enabled for this run")
    if not include_unverifiable:
        reason = reason.when(F.col("unverifiable"), "targets only unmeasured axes")
    return actions.withColumn(
        "rejection", reason.when(F.col("expected_gain") < min_gain, "below the gain floor").otherwise(""))


def exclude_contradictions(ranked: DataFrame, scopes: DataFrame, building: str = "building_id",
                           max_rounds: int = 50) -> DataFrame:
    """Adds ``excluded``: in rank order an action drops every later action that contradicts it.

    Conflicts meet on a hub - a shared target, or a shared object - and per hub only the best
    undecided rank of each action type is kept, so no pair is ever listed. Each round keeps the
    actions nothing undecided outranks and drops what contradicts them.
    """
    spark = ranked.sparkSession
    exclusive = dim(spark, "dim_exclusive")
    rules = exclusive.union(exclusive.select("right_type", "left_type")).toDF("other_type", "action_type")
    hubs = ranked.select(building, "action_id", "action_type", "rank", F.concat(F.lit("target:"), "target").alias("hub"),
                         F.lit(True).alias("is_target")).unionByName(
        scopes.filter("kind = 'object'").join(ranked.select(building, "action_id", "action_type", "rank"), [building, "action_id"])
        .select(building, "action_id", "action_type", "rank", F.concat(F.lit("object:"), "entity").alias("hub"), F.lit(False).alias("is_target")))
    hubs = cut_lineage(hubs.distinct())
    status = cut_lineage(ranked.select(building, "action_id", F.lit(None).cast("boolean").alias("kept")))

    for _ in range(max_rounds):
        live = hubs.join(status, [building, "action_id"])
        best = live.groupBy(building, "hub", F.col("action_type").alias("other_type")).agg(
            F.min(F.when(F.col("kept").isNull(), F.col("rank"))).alias("best_open"),
            F.min(F.when(F.col("kept"), F.col("rank"))).alias("best_kept"))
        by_rule = live.filter("kept IS NULL").join(F.broadcast(rules), "action_type").join(best, [building, "hub", "other_type"])
        same = live.filter("kept IS NULL AND is_target").join(
            best.withColumnRenamed("other_type", "action_type"), [building, "hub", "action_type"])
        pressure = by_rule.select(building, "action_id", "rank", "best_open", "best_kept").unionByName(
            same.select(building, "action_id", "rank", "best_open", "best_kept"))
        verdict = pressure.groupBy(building, "action_id").agg(
            F.bool_or(F.coalesce(F.col("best_kept") < F.col("rank"), F.lit(False))).alias("lost"),
            F.bool_or(F.coalesce(F.col("best_open") < F.col("rank"), F.lit(False))).alias("waiting"))
        status = cut_lineage(
            status.join(verdict, [building, "action_id"], "left").select(
                building, "action_id",
                F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("lost"), False)
                .when(~F.coalesce("waiting", F.lit(False)), True).alias("kept")))
        if status.filter("kept IS NULL").isEmpty():
            break
    else:
        raise RuntimeError("exclusion did not settle; raise max_rounds")
    return ranked.join(status, [building, "action_id"]).withColumn("excluded", ~F.col("kept")).drop("kept")


def ordering_edges(actions: DataFrame, scopes: DataFrame, building: str = "building_id") -> DataFrame:
    """Edges earlier -> later where a type rule applies and the two share an object, material or room."""
    rules = F.broadcast(dim(actions.sparkSession, "dim_ordering"))
    placed = scopes.join(actions.select(building, "action_id", "action_type"), [building, "action_id"])
    earlier = placed.select(building, "kind", "entity", F.col("action_id").alias("earlier_id"), F.col("action_type").alias("earlier_type"))
    later = placed.select(building, "kind", "entity", F.col("action_id").alias("later_id"), F.col("action_type").alias("later_type"))
    return (
        earlier.join(rules, "earlier_type").join(later, [building, "kind", "entity", "later_type"])
        .filter("earlier_id <> later_id").select(building, "earlier_id", "later_id").distinct()
    )


def order_plan(ranked: DataFrame, scopes: DataFrame, limit: int | None = None, building: str = "building_id") -> DataFrame:
    """All actions, or the first ``limit`` of a building, in the ready-first order with rank as tie-break.

    Always running the best ranked ready action sorts actions by the worst rank among themselves
    and everything before them; ties are inside the descendants of one action and resolve the same
    way there. The type rules are acyclic with three levels, so three such keys are the whole
    order. All three are group maxima over (entity, type), never over pairs.
    """
    rules = F.broadcast(dim(ranked.sparkSession, "dim_ordering"))
    nodes = cut_lineage(ranked.select(building, "action_id", "action_type", "rank"))
    links = cut_lineage(scopes.select(building, "action_id", "kind", "entity"))

    def from_parents(values: DataFrame, keys: list[str], value: str) -> DataFrame:
        """Per action, the largest ``value`` among direct predecessors (restricted to equal ``keys``)."""
        offered = (
            links.join(values, [building, "action_id"])
            .groupBy(building, "kind", "entity", F.col("action_type").alias("earlier_type"), *keys)
            .agg(F.max(value).alias("_v")).join(rules, "earlier_type")
        )
        wanted = links.join(values.select(building, "action_id", F.col("action_type").alias("later_type"), *keys), [building, "action_id"])
        return wanted.join(offered, [building, "kind", "entity", "later_type", *keys]).groupBy(building, "action_id").agg(F.max("_v").alias("_v"))

    def closure(values: DataFrame, keys: list[str], value: str) -> DataFrame:
        for _ in range(2):
            up = from_parents(values, keys, value)
            values = cut_lineage(values.join(up, [building, "action_id"], "left").withColumn(value, F.greatest(value, F.coalesce("_v", value))).drop("_v"))
        return values

    m0 = closure(nodes.withColumn("m0", F.col("rank")), [], "m0")
    rest = m0.filter("m0 <> rank").withColumn("m1", F.col("rank"))
    m1 = closure(rest, ["m0"], "m1")
    keyed = m0.join(m1.select(building, "action_id", "m1"), [building, "action_id"], "left").withColumn("m1", F.coalesce("m1", F.lit(0)))
    # A node that is its own bottleneck at one level precedes its descendants: 0 sorts first.
    order = [F.asc("m0"), F.asc("m1"), F.when(F.col("m1") == F.col("rank"), 0).otherwise(F.col("rank")).asc(), F.asc("rank")]
    return top_within(keyed, [building], order, limit, "position").select(building, "action_id", "action_type", "rank", "position")


def plan_gain(actions: DataFrame, baselines: DataFrame, building: str = "building_id") -> DataFrame:
    """Sum of expected gains, the k-th action on an axis counting 0.6^(k-1), capped at 1 - baseline.

    Terms past the 256th on one axis are below 1e-56 and cannot change a double rounded to 4 places,
    so the per-axis list is cut there before the shuffle.
    """
    lead = actions.withColumn("_axis", F.coalesce(F.try_element_at("axes", F.lit(1)), F.lit("*")))
    discounted = top_within(lead, [building, "_axis"], action_order(), 256, "_k").groupBy(building).agg(
        F.sum(F.col("expected_gain") * F.pow(F.lit(OVERLAP_DECAY), F.col("_k") - 1)).alias("total"))
    return discounted.join(baselines, building).select(
        building, F.round(F.least("total", F.greatest(F.lit(0.0), 1 - F.col("baseline"))), 4).alias("plan_gain"))


def ready_actions(ordered: DataFrame, edges: DataFrame, completed: DataFrame, building: str = "building_id") -> DataFrame:
    """Open actions all of whose predecessors are completed."""
    open_actions = ordered.join(completed, [building, "action_id"], "left_anti")
    waiting = edges.join(completed.withColumnRenamed("action_id", "earlier_id"), [building, "earlier_id"], "left_anti")
    blocked = waiting.select(building, F.col("later_id").alias("action_id")).distinct()
    return open_actions.join(blocked, [building, "action_id"], "left_anti")


def plan_diagnostics(planned: DataFrame, groups: DataFrame, priced: DataFrame, building: str = "building_id") -> DataFrame:
    a = planned.groupBy(building).agg(F.count("*").alias("findings_considered"))
    g = groups.groupBy(building).agg(F.count("*").alias("root_causes"),
                                     F.coalesce(F.sum(F.when(F.col("findings") > 1, F.col("findings"))), F.lit(0)).alias("findings_merged"))
    p = priced.groupBy(building).agg(F.count("*").alias("proposed"), F.count_if(F.col("rejection") != "").alias("dropped"))
    return reduce(lambda x, y: x.join(y, building, "left"), [a, g, p]).na.fill(0)
