"""Analytics over refinement runs: append-only attempts ordered by (run_id, iteration)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scale import running_by_blocks

EPSILON = 0.002
MICRO = 1_000_000

ATTEMPT_SCHEMA = T.StructType([
    T.StructField("iteration", T.LongType()), T.StructField("action", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("target", T.StringType()), T.StructField("outcome", T.StringType()),
    T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
    T.StructField("expected_gain", T.DoubleType()), T.StructField("actual_gain", T.DoubleType()),
    T.StructField("score_before", T.DoubleType()), T.StructField("score_after", T.DoubleType()),
    T.StructField("axis_deltas", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("trigger_findings", T.ArrayType(T.StringType())),
    T.StructField("affected", T.StructType([
        T.StructField("rooms", T.ArrayType(T.StringType())), T.StructField("objects", T.ArrayType(T.StringType())),
        T.StructField("materials", T.ArrayType(T.StringType()))])),
    T.StructField("rollback_reason", T.StringType()), T.StructField("duration_ms", T.LongType()),
    T.StructField("timestamp", T.StringType()),
])
HISTORY_SCHEMA = T.StructType([
    T.StructField("history_version", T.StringType()), T.StructField("started_at", T.StringType()),
    T.StructField("duration_ms", T.LongType()), T.StructField("baseline_score", T.DoubleType()),
    T.StructField("final_score", T.DoubleType()), T.StructField("stop_reason", T.StringType()),
    T.StructField("stop_detail", T.StringType()), T.StructField("attempts", T.ArrayType(ATTEMPT_SCHEMA)),
])


def read_history(documents: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Run headers and attempts out of saved history documents (``run_id`` and a JSON text column)."""
    parsed = documents.withColumn("_h", F.from_json(text, HISTORY_SCHEMA))
    headers = parsed.select("run_id", "_h.baseline_score", "_h.final_score", "_h.stop_reason", "_h.started_at", "_h.duration_ms")
    attempts = parsed.select("run_id", F.inline("_h.attempts"))
    return headers, attempts.withColumnsRenamed({"action": "action_id", "type": "action_type"})


def accept(attempts: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """A gain of exactly epsilon is not an improvement."""
    return attempts.withColumn("accepted", F.round("measured_gain", 9) > epsilon)


def running_state(attempts: DataFrame, baseline: float) -> DataFrame:
    """State after every attempt: score, accepted so far, consecutive rejections.

    Gains are summed as whole millionths, so the trajectory is the same in any order.
    ``iteration`` numbers a run's attempts from 1 without gaps.
    """
    gain = F.when(F.col("accepted"), F.round(F.col("measured_gain") * MICRO).cast("long")).otherwise(F.lit(0).cast("long"))
    state = running_by_blocks(attempts, ["run_id"], "iteration", {
        "gain_micro": ("sum", gain),
        "accepted_count": ("sum", F.when(F.col("accepted"), 1).otherwise(0).cast("long")),
        "last_accepted": ("max", F.when(F.col("accepted"), F.col("iteration")).otherwise(F.lit(0).cast("long"))),
    })
    return state.withColumn("score", F.round(F.lit(baseline) + F.col("gain_micro") / MICRO, 6)).withColumn(
        "consecutive_rejections", F.col("iteration") - F.col("last_accepted"))


def stop_decisions(state: DataFrame, plan_size: int, target: float = 1.0, max_iterations: int = 12,
                   max_rejections: int = 3, epsilon: float = EPSILON, plateau_window: int = 3) -> DataFrame:
    """First iteration at which a run stops, and which rule fired first in the fixed order."""
    accepted = state.filter("accepted").select(
        "run_id", (F.col("accepted_count") + plateau_window).alias("accepted_count"), F.col("gain_micro").alias("_earlier"))
    joined = state.join(accepted, ["run_id", "accepted_count"], "left").withColumn(
        "_recent", (F.col("gain_micro") - F.coalesce("_earlier", F.lit(0))) / MICRO)
    reason = (
        F.when(F.col("score") >= target, "target_reached")
        .when(F.col("iteration") >= max_iterations, "max_iterations")
        .when(F.col("consecutive_rejections") >= max_rejections, "no_gain")
        .when(F.col("iteration") >= plan_size, "plan_exhausted")
        .when((F.col("accepted_count") >= plateau_window) & (F.col("_recent") < epsilon), "below_epsilon")
    )
    fired = joined.withColumn("reason", reason).filter("reason IS NOT NULL")
    return fired.groupBy("run_id").agg(F.min(F.struct("iteration", "reason", "score")).alias("s")).select(
        "run_id", F.col("s.iteration").alias("stop_iteration"), F.col("s.reason").alias("stop_reason"), F.col("s.score").alias("score"))


def by_type(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("action_type").agg(
        F.count("*").alias("attempted"), F.count_if("accepted").alias("accepted"),
        F.coalesce(F.sum(F.when(F.col("accepted"), F.col("measured_gain"))), F.lit(0.0)).alias("total_gain"),
        F.sum("expected_gain").alias("expected_gain"),
        F.round(F.count_if("accepted") / F.count("*"), 3).alias("acceptance_rate"))


def reason_head(column: str):
    head = F.trim(F.substring_index(F.coalesce(column, F.lit("")), ":", 1))
    return F.when(head == "", "unspecified").otherwise(head)


def rejection_reasons(attempts: DataFrame, reason: str = "reason") -> DataFrame:
    return attempts.filter(~F.col("accepted")).groupBy(reason_head(reason).alias("head")).agg(F.count("*").alias("n"))


def rollback_reasons(entries: DataFrame, reason: str = "reason") -> DataFrame:
    head = F.substring_index(F.coalesce(reason, F.lit("")), ":", 1)
    return entries.groupBy(F.when(head == "", "unknown").otherwise(head).alias("head")).agg(F.count("*").alias("n"))


def gain_by_room(attempts: DataFrame, attempt_rooms: DataFrame) -> DataFrame:
    """Gain per room of the accepted attempts; attempts touching no room count for '(building)'."""
    kept = attempts.filter("accepted").join(attempt_rooms, ["run_id", "iteration"], "left")
    return kept.groupBy(F.coalesce(F.col("room_id").cast("string"), F.lit("(building)")).alias("room")).agg(F.sum("measured_gain").alias("gain"))


def calibration(attempts: DataFrame) -> DataFrame:
    """Expected against measured gain of accepted attempts, per type and overall (type null)."""
    rolled = attempts.filter("accepted").rollup("action_type").agg(
        F.count("*").alias("samples"), F.sum("expected_gain").alias("expected"), F.sum("measured_gain").alias("actual"))
    return rolled.select(
        "action_type", "samples", (F.col("expected") / F.col("samples")).alias("mean_expected"),
        (F.col("actual") / F.col("samples")).alias("mean_actual"),
        ((F.col("expected") - F.col("actual")) / F.col("samples")).alias("mean_error"),
        F.when(F.col("expected") > 1e-9, F.col("actual") / F.col("expected")).alias("ratio"))


def deltas(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Score change of everything measured on both sides; negative means a regression."""
    b = before.select(*keys, F.col("score").alias("before"))
    a = after.select(*keys, F.col("score").alias("after"))
    return b.join(a, keys).withColumn("delta", F.col("after") - F.col("before")).withColumn("regressed", F.round("delta", 5) < 0)


def lost_axes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    return before.select(*keys).join(after.select(*keys), keys, "left_anti")


def run_metrics(state: DataFrame, baseline: float) -> DataFrame:
    """Per run: iterations, acceptance rate, gain per iteration, final score."""
    return state.groupBy("run_id").agg(
        F.count("*").alias("iterations"), F.count_if("accepted").alias("accepted"),
        F.round(F.count_if("accepted") / F.count("*"), 3).alias("acceptance_rate"),
        F.round(F.max("gain_micro") / MICRO / F.count("*"), 5).alias("gain_per_iteration"),
        F.round(F.lit(baseline) + F.max("gain_micro") / MICRO, 6).alias("final_score"))
