"""Streams driven to completion over files, compared with their batch forms."""

import json
import tempfile

from pyspark.sql import functions as F

from floorlake.sources import documents, drawings
from floorlake.streaming import jobs

EVENTS = [
    (1, 1, "2024-01-01 00:00:00", {"status": "QUEUED", "message": "m"}), (1, 2, "2024-01-01 00:01:00", {"status": "BUILDING_SCENE"}),
    (1, 3, "2024-01-01 00:02:00", {"status": "FAILED", "message": "x"}), (1, 4, "2024-01-01 00:03:00", {"status": "EXPORTING_GLB"}),
    (2, 5, "2024-01-01 00:00:30", {"status": "EXTRACTING_DXF"}), (2, 6, "2024-01-01 00:00:40", {"status": "DANCING"}), (3, 7, "2024-01-01 09:00:00", {"status": "QUEUED"}),
]


def source(spark, extra=()):
    folder = tempfile.mkdtemp(prefix="events-")
    rows = [(j, e, at, json.dumps(p)) for j, e, at, p in EVENTS] + list(extra)
    df = spark.createDataFrame(rows, "job_id long, event_id long, at string, raw string").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(folder)
    return folder, df


def run(stream, mode, name, spark):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp(prefix="ckpt-")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_latest_status_as_stream(spark):
    folder, batch = source(spark)
    stream = jobs.parse_events(spark.readStream.schema(jobs.EVENTS).parquet(folder))
    got = {r["job_id"]: (r["status"], r["step"], r["finished"]) for r in run(jobs.latest_status(stream), "complete", "latest_status", spark).collect()}
    assert got[1] == ("EXPORTING_GLB", "EXPORTING_GLB", False) and got[2][0] == "EXTRACTING_DXF"
    closed, late = jobs.until_terminal(jobs.parse_events(batch))
    assert [r["event_id"] for r in late.collect()] == [4]
    assert {r["job_id"]: r["step"] for r in jobs.latest_status(closed).collect()}[1] == "BUILDING_SCENE"


def test_nothing_counts_after_terminal_in_the_stream(spark):
    folder, _ = source(spark)
    stream = jobs.parse_events(spark.readStream.schema(jobs.EVENTS).parquet(folder))
    rows = run(jobs.close_after_terminal(stream), "append", "closed", spark).collect()
    assert {r["event_id"] for r in rows if r["late"]} == {4}
    assert {r["event_id"] for r in rows} == {1, 2, 3, 4, 5, 7}


def test_event_log_drops_repeats(spark):
    extra = [(1, 1, "2024-01-01 00:00:00", json.dumps({"status": "QUEUED", "message": "m"}))]
    folder, _ = source(spark, extra)
    out = tempfile.mkdtemp(prefix="log-")
    stream = jobs.parse_events(spark.readStream.schema(jobs.EVENTS).parquet(folder)).filter("status IS NOT NULL")
    jobs.event_log(stream, out + "/log", out + "/ckpt").awaitTermination(120)
    assert spark.read.parquet(out + "/log").count() == 6


def test_bad_payloads_are_kept_apart(spark):
    _, batch = source(spark, [(9, 9, "2024-01-01 00:00:00", "{oops")])
    assert {r["event_id"] for r in jobs.dead_letters(jobs.parse_events(batch)).collect()} == {6, 9}


def test_truncated_answer_is_closed():
    text = 'note {"a": [1, 2, {"b": "x]"}, {"c": [1'
    assert json.loads(documents.close_brackets(text)) == {"a": [1, 2, {"b": "x]"}]}


def test_first_version_scene_reads_as_one_room(spark):
    docs = spark.createDataFrame([(1, '{"room": {"id": "r", "room_type": "kitchen"}}'), (2, '{"rooms": [{"id": "a"}, {"id": "b"}]}')], "building_id int, value string")
    assert sorted((r["building_id"], r["id"]) for r in documents.read_scene(docs)["rooms"].collect()) == [(1, "r"), (2, "a"), (2, "b")]


def test_old_polylines_arcs_solids_and_hatches(spark):
    pairs = ["0", "SECTION", "2", "ENTITIES",
             "0", "POLYLINE", "8", "A-WALL", "70", "1", "0", "VERTEX", "8", "A-WALL", "10", "0", "20", "0", "0", "VERTEX", "8", "A-WALL", "10", "4", "20", "0", "0", "VERTEX", "8", "A-WALL", "10", "4", "20", "3", "0", "SEQEND",
             "0", "ARC", "8", "A-DOOR", "10", "0", "20", "0", "40", "1", "50", "270", "51", "90", "0", "SOLID", "8", "X", "10", "0", "20", "0", "11", "1", "21", "0", "12", "0", "22", "1", "13", "1", "23", "1",
             "0", "HATCH", "8", "H", "2", "AR-PARQ1", "10", "0", "20", "0", "10", "0", "20", "0", "10", "2", "20", "0", "10", "2", "20", "2", "0", "ENDSEC", "0", "EOF"]
    entities = drawings.parse_entities(spark.createDataFrame([("d", "\n".join(pairs))], "drawing_id string, text string"))
    kinds = {r["dxftype"]: r["n"] for r in drawings.segments(entities).groupBy("dxftype").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"POLYLINE": 3, "ARC": 16, "SOLID": 4}
    hatch = drawings.hatches(entities).first()
    assert hatch["area"] == 2.0 and hatch["material"] == "wood"
