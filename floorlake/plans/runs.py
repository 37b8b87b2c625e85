"""Run analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import fx
from ..operators import evaluation as ev
from ..operators import runs as op
from .evaluation import ROOM_AXES, rounded
from .registry import query

RUNS = """att AS (SELECT *, seq - run_id*12 + 1 AS iteration, ROUND(measured_gain,9) > 0.002e0 AS accepted,
  CASE WHEN seq % 5 = 0 THEN 'constraint: locked' WHEN seq % 5 = 1 THEN 'no gain: measured' WHEN seq % 5 = 2 THEN '' ELSE 'failed' END AS reason FROM fx_attempts),
st AS (SELECT *, SUM(CASE WHEN accepted THEN CAST(ROUND(measured_gain*1000000) AS BIGINT) ELSE 0 END) OVER w AS g, SUM(CASE WHEN accepted THEN 1 ELSE 0 END) OVER w AS ac,
  iteration - MAX(CASE WHEN accepted THEN iteration ELSE 0 END) OVER w AS rej FROM att WINDOW w AS (PARTITION BY run_id ORDER BY iteration))"""


def attempts(spark, sf_dir):
    base = fx(spark, sf_dir, "fx_attempts")
    kind = F.col("seq") % 5
    return op.accept(base.withColumn("iteration", F.col("seq") - F.col("run_id") * 12 + 1).withColumn(
        "reason", F.when(kind == 0, "constraint: locked").when(kind == 1, "no gain: measured").when(kind == 2, "").otherwise("failed")))


@query("run_trajectory", "WN-05", oracle=f"""
WITH {RUNS} SELECT run_id, iteration, accepted, ROUND(0.4e0 + CAST(g AS DOUBLE)/1000000e0, 6) AS score, CAST(ac AS BIGINT) AS accepted_count, CAST(rej AS BIGINT) AS consecutive_rejections FROM st""")
def run_trajectory(spark, sf_dir):
    return op.running_state(attempts(spark, sf_dir), 0.4).select(
        "run_id", "iteration", "accepted", "score", "accepted_count", "consecutive_rejections")


@query("run_stop_replay", "WN-06", oracle=f"""
WITH {RUNS}, acc AS (SELECT run_id, ac, g FROM st WHERE accepted),
r AS (SELECT st.run_id, st.iteration, ROUND(0.4e0 + CAST(st.g AS DOUBLE)/1000000e0, 6) AS score, CASE WHEN ROUND(0.4e0 + CAST(st.g AS DOUBLE)/1000000e0, 6) >= 0.52e0 THEN 'target_reached' WHEN iteration >= 8 THEN 'max_iterations' WHEN rej >= 3 THEN 'no_gain' WHEN iteration >= 7 THEN 'plan_exhausted'
  WHEN st.ac >= 2 AND (st.g - COALESCE(acc.g, 0)) < 30000 THEN 'below_epsilon' END AS reason FROM st LEFT JOIN acc ON acc.run_id = st.run_id AND acc.ac = st.ac - 2)
SELECT run_id, MIN(iteration) AS stop_iteration, ARG_MIN(reason, iteration) AS stop_reason, ARG_MIN(score, iteration) AS score FROM r WHERE reason IS NOT NULL GROUP BY run_id""")
def run_stop_replay(spark, sf_dir):
    state = op.running_state(attempts(spark, sf_dir), 0.4)
    return op.stop_decisions(state, plan_size=7, target=0.52, max_iterations=8, epsilon=0.03, plateau_window=2)


@query("gain_by_action_type", "AG-25", oracle=f"""
WITH {RUNS} SELECT action_type, COUNT(*) AS attempted, COUNT(*) FILTER (accepted) AS accepted, RND(COALESCE(SUM(measured_gain) FILTER (accepted),0e0),5) AS total_gain,
 RND(SUM(expected_gain),5) AS expected_gain, ROUND(CAST(COUNT(*) FILTER (accepted) AS DOUBLE)/COUNT(*),3) AS acceptance_rate FROM att GROUP BY action_type""")
def gain_by_action_type(spark, sf_dir):
    return rounded(op.by_type(attempts(spark, sf_dir)), 5, "total_gain", "expected_gain")


@query("rejection_reason_heads", "AG-25", oracle=f"""
WITH {RUNS} SELECT CASE WHEN TRIM(SPLIT_PART(reason, ':', 1)) = '' THEN 'unspecified' ELSE TRIM(SPLIT_PART(reason, ':', 1)) END AS head, COUNT(*) AS n FROM att WHERE NOT accepted GROUP BY 1""")
def rejection_reason_heads(spark, sf_dir):
    return op.rejection_reasons(attempts(spark, sf_dir))


@query("rollback_reason_counts", "AG-31", oracle=f"""
WITH {RUNS} SELECT CASE WHEN SPLIT_PART(reason, ':', 1) = '' THEN 'unknown' ELSE SPLIT_PART(reason, ':', 1) END AS head, COUNT(*) AS n FROM att WHERE NOT accepted GROUP BY 1""")
def rollback_reason_counts(spark, sf_dir):
    return op.rollback_reasons(attempts(spark, sf_dir).filter("NOT accepted"))


@query("gain_by_room", "AG-25", oracle=f"""
WITH {RUNS} SELECT CASE WHEN seq % 4 = 0 THEN '(building)' ELSE CAST(seq % 100 AS VARCHAR) END AS room, RND(SUM(measured_gain),5) AS gain FROM att WHERE accepted GROUP BY 1""")
def gain_by_room(spark, sf_dir):
    rows = attempts(spark, sf_dir)
    links = rows.filter("seq % 4 <> 0").select("run_id", "iteration", (F.col("seq") % 100).alias("room_id"))
    return rounded(op.gain_by_room(rows, links), 5, "gain")


@query("estimate_calibration", "AG-26", oracle=f"""
WITH {RUNS} SELECT action_type, COUNT(*) AS samples, RND(AVG(expected_gain),5) AS mean_expected, RND(AVG(measured_gain),5) AS mean_actual, RND(AVG(expected_gain)-AVG(measured_gain),5) AS mean_error,
 RND(CASE WHEN SUM(expected_gain) > 1e-9 THEN SUM(measured_gain)/SUM(expected_gain) END,3) AS ratio FROM att WHERE accepted GROUP BY ROLLUP(action_type)""")
def estimate_calibration(spark, sf_dir):
    table = rounded(op.calibration(attempts(spark, sf_dir)), 5, "mean_expected", "mean_actual", "mean_error")
    return rounded(table, 3, "ratio")


HALVES = """h AS (SELECT room_id, axis, AVG(score) FILTER (viewpoint_id < 3 AND measured) AS b, AVG(score) FILTER (viewpoint_id >= 3 AND measured) AS a FROM fx_axis_scores GROUP BY room_id, axis)"""


def halves(spark, sf_dir):
    scores = fx(spark, sf_dir, "fx_axis_scores").filter("measured")
    mean = lambda part: scores.filter(part).groupBy("room_id", "axis").agg(F.avg("score").alias("score"))
    return mean("viewpoint_id < 3"), mean("viewpoint_id >= 3")


@query("axis_deltas", "AG-27", oracle=f"""
WITH {HALVES} SELECT room_id, axis, RND(b,5) AS before, RND(a,5) AS after, RND(a-b,5) AS delta, ROUND(a-b,5) < 0 AS regressed FROM h WHERE a IS NOT NULL AND b IS NOT NULL""")
def axis_deltas(spark, sf_dir):
    before, after = halves(spark, sf_dir)
    return rounded(op.deltas(before, after, ["room_id", "axis"]), 5, "before", "after", "delta")


@query("lost_axes", "AG-27", oracle=f"WITH {HALVES} SELECT room_id, axis FROM h WHERE b IS NOT NULL AND a IS NULL")
def lost_axes(spark, sf_dir):
    return op.lost_axes(*halves(spark, sf_dir), ["room_id", "axis"])


@query("run_metrics", "AG-27", oracle=f"""
WITH {RUNS} SELECT run_id, COUNT(*) AS iterations, COUNT(*) FILTER (accepted) AS accepted, ROUND(CAST(COUNT(*) FILTER (accepted) AS DOUBLE)/COUNT(*),3) AS acceptance_rate,
 ROUND(CAST(MAX(g) AS DOUBLE)/1000000e0/COUNT(*),5) AS gain_per_iteration, ROUND(0.4e0 + CAST(MAX(g) AS DOUBLE)/1000000e0,6) AS final_score FROM st GROUP BY run_id""")
def run_metrics(spark, sf_dir):
    return op.run_metrics(op.running_state(attempts(spark, sf_dir), 0.4), 0.4)


@query("history_documents", "SRC-10", oracle=f"""
WITH {RUNS} SELECT run_id, iteration, CONCAT('a', CAST(seq AS VARCHAR)) AS action_id, action_type, CASE WHEN accepted THEN 'accepted' ELSE 'rejected' END AS outcome, RND(expected_gain,6) AS expected_gain, RND(measured_gain,6) AS actual_gain FROM att""")
def history_documents(spark, sf_dir):
    """Attempts written as one JSON document per run and read back."""
    rows = attempts(spark, sf_dir)
    entry = F.struct(
        "iteration", F.concat(F.lit("a"), F.col("seq").cast("string")).alias("action"), F.col("action_type").alias("type"),
        F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("outcome"), "expected_gain", F.col("measured_gain").alias("actual_gain"))
    saved = rows.groupBy("run_id").agg(F.to_json(F.struct(F.lit(0.4).alias("baseline_score"), F.collect_list(entry).alias("attempts"))).alias("value"))
    _, read = op.read_history(saved)
    return rounded(read.select("run_id", "iteration", "action_id", "action_type", "outcome", "expected_gain", "actual_gain"), 6, "expected_gain", "actual_gain")
