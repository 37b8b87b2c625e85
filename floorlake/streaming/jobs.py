"""Job events: parsing, latest status, terminal filter, timeouts and the replayable log.

Every function takes a batch or a streaming DataFrame unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The ordered steps of a job, its failure state and the seconds allowed.
STEPS = ["QUEUED", "EXTRACTING_DXF", "GENERATING_GEOMETRY", "BUILDING_SCENE", "EXPORTING_GLB", "COMPLETED"]
FAILED = "FAILED"
TERMINAL = ["COMPLETED", FAILED]
TIMEOUTS = {"extract": 300, "step": 900, "analysis": 1800}

PAYLOAD = T.StructType([T.StructField("status", T.StringType()), T.StructField("message", T.StringType())])
EVENTS = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("raw", T.StringType())])


def parse_events(raw: DataFrame) -> DataFrame:
    """Adds status (null when unreadable or unknown) and message ('' when missing)."""
    parsed = F.from_json("raw", PAYLOAD)
    known = F.try_parse_json("raw").isNotNull() & parsed["status"].isin(*STEPS, FAILED)
    return raw.withColumns({"status": F.when(known, parsed["status"]), "message": F.when(known, F.coalesce(parsed["message"], F.lit("")))})


def dead_letters(events: DataFrame) -> DataFrame:
    return events.filter("status IS NULL")


def step_index(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STEPS]), status).cast("int") - 1


def progress(status: Column) -> Column:
    index = step_index(status)
    return F.when(index <= 0, 0.0).otherwise(index / (len(STEPS) - 1))


def latest_status(events: DataFrame) -> DataFrame:
    """Newest status per job and how far it got; FAILED keeps the step it died on.

    A plain grouped maximum: as a stream it runs in update mode with one state row per job.
    """
    order = F.struct("at", "event_id")
    step = F.when(F.col("status") != FAILED, F.struct("at", "event_id", "status"))
    grouped = events.filter("status IS NOT NULL").groupBy("job_id").agg(
        F.max(F.struct("at", "event_id", "status")).alias("_last"), F.max(step).alias("_step"), F.count("*").alias("events"), F.max(order).alias("_o"))
    on_step = F.coalesce("_step.status", F.lit(STEPS[0]))
    return grouped.select("job_id", F.col("_last.status").alias("status"), on_step.alias("step"), progress(on_step).alias("progress"), F.col("_last.status").isin(*TERMINAL).alias("finished"), "events")


def until_terminal(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batch form of the terminal filter: (events up to a job's first terminal one, later events)."""
    known = events.filter("status IS NOT NULL")
    first = known.filter(F.col("status").isin(*TERMINAL)).groupBy("job_id").agg(F.min(F.struct("at", "event_id")).alias("_end"))
    joined = known.join(first, "job_id", "left")
    late = F.col("_end").isNotNull() & (F.struct("at", "event_id") > F.col("_end"))
    return joined.filter(~late).drop("_end"), joined.filter(late).drop("_end")


def elapsed(events: DataFrame, limit_s: int = TIMEOUTS["step"]) -> DataFrame:
    return events.groupBy("job_id").agg(
        F.min("at").alias("started"), F.max("at").alias("updated"), ((F.unix_micros(F.max(F.col("at").cast("timestamp"))) - F.unix_micros(F.min(F.col("at").cast("timestamp")))) / 1e6).alias("elapsed_s"),
        F.bool_or(F.col("status").isin(*TERMINAL)).alias("finished")).withColumn("timed_out", ~F.col("finished") & (F.col("elapsed_s") > limit_s))


# -- stateful streams --------------------------------------------------------------

CLOSED = "job_id long, event_id long, at timestamp, status string, message string, late boolean"


def close_after_terminal(events: DataFrame, watermark: str = "10 minutes", keep_s: int = 3600) -> DataFrame:
    """Stream: marks every event after a job's terminal status as late; state is one flag per job, dropped after ``keep_s``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done = state.get[0] if state.exists else False
        for pdf in batches:
            late = []
            for status in pdf["status"]:
                late.append(done)
                done = done or status in TERMINAL
            yield pdf.assign(late=late)[["job_id", "event_id", "at", "status", "message", "late"]]
        state.update((done,))
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(mark, 0) + keep_s * 1000)

    timed = events.filter("status IS NOT NULL").withWatermark("at", watermark)
    return timed.groupBy("job_id").applyInPandasWithState(step, CLOSED, "done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def timeouts(events: DataFrame, limit_s: int = TIMEOUTS["step"], watermark: str = "10 minutes") -> DataFrame:
    """Stream: one row per job that stayed open longer than ``limit_s`` of event time after its last event."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            started, last = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "elapsed_s": [(last - started) / 1000.0], "reason": ["timed out"]})
            return
        started, last, done = (*state.get, False) if state.exists else (None, None, False)
        for pdf in batches:
            ms = pdf["at"].astype("int64") // (10 ** 3 if str(pdf["at"].dtype).find("us") > 0 else 10 ** 6)
            started = int(ms.min()) if started is None else min(started, int(ms.min()))
            last = int(ms.max()) if last is None else max(last, int(ms.max()))
            done = done or pdf["status"].isin(TERMINAL).any()
        if done:
            if state.exists:
                state.remove()
        else:
            state.update((started, last))
            state.setTimeoutTimestamp(max(last + limit_s * 1000, state.getCurrentWatermarkMs() + 1))
        return
        yield

    timed = events.filter("status IS NOT NULL").withWatermark("at", watermark)
    return timed.groupBy("job_id").applyInPandasWithState(step, "job_id long, elapsed_s double, reason string", "started long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def event_log(events: DataFrame, path: str, checkpoint: str, watermark: str = "1 hour"):
    """Stream: append-only replayable log; repeated deliveries of an event are dropped within the watermark."""
    unique = events.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["job_id", "event_id", "status"])
    dated = unique.withColumn("day", F.to_date("at"))
    return dated.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def replay(log: DataFrame, keys: list[str]) -> DataFrame:
    """The log of some jobs in order of arrival."""
    return log.dropDuplicates(["job_id", "event_id", "status"]).orderBy(*keys, "at", "event_id")
