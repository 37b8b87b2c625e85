"""Score rollups and finding merge: viewpoint -> room -> building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import dim
from .scale import top_within

FINDING_KEY = ["axis", "subsystem", "code", "room_id", "object_id"]
CORROBORATION = 0.05
CONFIDENCE_CAP = 0.99
MIN_VIEW_WEIGHT = 0.05
TOP_FINDINGS = 12


def combine_axes(scores: DataFrame, keys: list[str], weights: DataFrame | None = None) -> DataFrame:
    """One score per group from its axes; unmeasured axes count on neither side.

    ``scores``: keys, axis, score, confidence, measured. A group with nothing measured keeps
    score 0, confidence 0 and weight_used 0.
    """
    weights = weights if weights is not None else dim(scores.sparkSession, "dim_axis_weights")
    total = weights.agg(F.sum("weight").alias("_total"))
    joined = scores.join(F.broadcast(weights), "axis").crossJoin(F.broadcast(total))
    used = F.when(F.col("measured"), F.col("weight")).otherwise(0.0)
    grouped = joined.groupBy(*keys).agg(
        F.sum(used).alias("_used"),
        F.sum(used * F.col("score")).alias("_score"),
        F.sum(used * F.col("confidence")).alias("_confidence"),
        F.first("_total").alias("_total"),
        F.count_if("measured").alias("axes_measured"),
    )
    share = F.when(F.col("_total") > 0, F.col("_used") / F.col("_total")).otherwise(0.0)
    any_used = F.col("_used") > 0
    return grouped.select(
        *keys,
        F.when(any_used, F.col("_score") / F.col("_used")).otherwise(0.0).alias("score"),
        F.when(any_used, F.col("_confidence") / F.col("_used") * share).otherwise(0.0).alias("confidence"),
        F.when(any_used, share).otherwise(0.0).alias("weight_used"),
        "axes_measured",
    )


def merge_axes(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The same axis over several viewpoints (or rooms): confidence-weighted where measured."""
    weight = F.greatest(F.lit(MIN_VIEW_WEIGHT), F.col("confidence"))
    measured = F.col("measured")
    grouped = scores.groupBy(*keys, "axis").agg(
        F.sum(F.when(measured, F.col("score") * weight)).alias("_ws"),
        F.sum(F.when(measured, weight)).alias("_w"),
        F.avg(F.when(measured, F.col("confidence"))).alias("_c"),
        F.max(F.when(measured, F.col("score"))).alias("_max"),
        F.min(F.when(measured, F.col("score"))).alias("_min"),
        F.count_if(measured).alias("sources"),
    )
    found = F.col("sources") > 0
    return grouped.select(
        *keys,
        "axis",
        F.when(found, F.col("_ws") / F.col("_w")).otherwise(0.0).alias("score"),
        F.when(found, F.col("_c")).otherwise(0.0).alias("confidence"),
        found.alias("measured"),
        "sources",
        F.when(found, F.col("_max") - F.col("_min")).otherwise(0.0).alias("spread"),
        F.when(found, "").otherwise("not measured in any viewpoint").alias("reason"),
    )


def room_axes(view_axes: DataFrame, keys: list[str], room_objects: DataFrame | None = None) -> DataFrame:
    """Merged axes per room; a measured room-scope objects axis replaces the merged one."""
    columns = [*keys, "axis", "score", "confidence", "measured"]
    merged = merge_axes(view_axes, keys).select(*columns)
    if room_objects is None:
        return merged
    own = room_objects.filter("measured").select(*columns)
    replaced = merged.join(own.select(*keys, "axis"), [*keys, "axis"], "left_anti")
    return replaced.unionByName(own)


def building_rollup(room_axis_scores: DataFrame, rooms: DataFrame, building: str = "building_id") -> DataFrame:
    """Building score: area-weighted mean of assessed rooms, confidence from the merged axes.

    ``room_axis_scores``: room_id, axis, score, confidence, measured; ``rooms``: room_id, building, area.
    """
    keyed = room_axis_scores.join(rooms.select("room_id", building, "area"), "room_id")
    totals = combine_axes(keyed, [building, "room_id", "area"])
    weight = F.when(F.col("area") > 0.1, F.col("area")).otherwise(1.0)
    assessed = F.col("weight_used") > 0
    from_rooms = totals.groupBy(building).agg(
        (F.sum(F.when(assessed, F.col("score") * weight)) / F.sum(F.when(assessed, weight))).alias("room_mean"),
        F.count("*").alias("rooms_total"),
        F.count_if(assessed).alias("rooms_assessed"),
    )
    overall = combine_axes(merge_axes(keyed, [building]), [building])
    return overall.join(from_rooms, building).select(
        building,
        F.coalesce("room_mean", F.lit(0.0)).alias("score"),
        "confidence",
        "weight_used",
        "rooms_total",
        "rooms_assessed",
    )


def room_ids(viewpoint_rooms: DataFrame, graph_rooms: DataFrame, keys: list[str]) -> DataFrame:
    """Rooms with a render or in the graph."""
    return viewpoint_rooms.select(*keys).union(graph_rooms.select(*keys)).filter(F.col(keys[-1]).isNotNull()).distinct()


def severity_order(*ties: str) -> list[Column]:
    return [F.round("severity", 6).desc(), F.round("confidence", 6).desc(), F.asc("axis"), *[F.asc(t) for t in ties]]


def merge_findings(findings: DataFrame, keys: list[str] = FINDING_KEY) -> DataFrame:
    """One row per finding key: the worst instance, confidence raised by how many agreed.

    Aggregates per (key, viewpoint) first, so a key seen everywhere is already reduced to one row
    per viewpoint and task before it meets itself. The viewpoints themselves are in
    :func:`finding_viewpoints`.
    """
    worst = F.struct(
        (-F.round("severity", 6)).alias("s"), (-F.round("confidence", 6)).alias("c"), F.col("difference").alias("d"),
        F.col("viewpoint_id").alias("v"), F.col("severity").alias("severity"), F.col("confidence").alias("confidence"),
    )
    per_view = findings.groupBy(*keys, "viewpoint_id").agg(F.min(worst).alias("worst"), F.count("*").alias("n"))
    grouped = per_view.groupBy(*keys).agg(
        F.min("worst").alias("worst"),
        F.sum("n").alias("agreeing"),
        F.count("viewpoint_id").alias("viewpoints_seen"),
    )
    several = F.col("agreeing") > 1
    raised = F.least(F.lit(CONFIDENCE_CAP), F.col("worst.confidence") + CORROBORATION * (F.col("agreeing") - 1))
    return grouped.select(
        *keys,
        F.col("worst.severity").alias("severity"),
        F.when(several, raised).otherwise(F.col("worst.confidence")).alias("confidence"),
        F.col("worst.d").alias("difference"),
        F.when(several, F.lit(None)).otherwise(F.col("worst.v")).alias("viewpoint_id"),
        "agreeing",
        "viewpoints_seen",
    )


def finding_viewpoints(findings: DataFrame, keys: list[str] = FINDING_KEY) -> DataFrame:
    """Which viewpoints reported each finding, as a link table."""
    return findings.filter(F.col("viewpoint_id").isNotNull()).select(*keys, "viewpoint_id").distinct()


def top_findings(merged: DataFrame, keys: list[str], ties: list[str], limit: int = TOP_FINDINGS) -> DataFrame:
    return top_within(merged, keys, severity_order(*ties), limit)


def subsystem_pressure(findings: DataFrame, keys: list[str]) -> DataFrame:
    return (
        findings.filter(F.coalesce("subsystem", F.lit("")) != "")
        .groupBy(*keys, "subsystem")
        .agg(F.sum(F.col("severity") * F.col("confidence")).alias("pressure"), F.count("*").alias("findings"))
    )


def coverage(viewpoints: DataFrame, keys: list[str]) -> DataFrame:
    """``viewpoints``: keys, evaluated, has_reference."""
    return viewpoints.groupBy(*keys).agg(
        F.count("*").alias("viewpoints_total"),
        F.count_if("evaluated").alias("viewpoints_evaluated"),
        F.count_if("has_reference").alias("viewpoints_with_reference"),
        F.round(F.count_if("has_reference") / F.count("*"), 3).alias("reference_coverage"),
    )
