"""What keeps queries in proportion to their tables: joins on keys, work in several tasks, no shuffle of the pairs of a file."""

from pyspark.sql import functions as F

from floorlake import fixtures
from floorlake.operators import graph
from floorlake.operators import registration as rg
from floorlake.sources import drawings as dw


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark, folder, parts=400, suppliers=40):
    spark.range(parts).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{folder}/part.parquet")
    spark.range(suppliers).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).cast("int").alias("s_nationkey")).coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def test_counts_next_to_tables_keep_the_join_on_keys(spark, tmp_path):
    rows = fixtures.fx(spark, tables(spark, tmp_path), "fx_openings")
    read = rows.filter(F.floor(F.col("x") / 4).isNotNull() & F.floor(F.col("y") / 4).isNotNull())
    assert "HashJoin" in plan(read) or "SortMergeJoin" in plan(read)
    assert read.count() == 400
    assert read.filter("wall_id <> opening_id % 160").isEmpty()


def test_small_files_are_spread_over_tasks(spark, tmp_path, monkeypatch):
    folder = tables(spark, tmp_path)
    monkeypatch.setattr(fixtures, "SHARE", 256)
    read = fixtures.table(spark, folder, "part")
    assert read.rdd.getNumPartitions() > 4
    assert sorted(r.p_partkey for r in read.collect()) == list(range(400))
    monkeypatch.setattr(fixtures, "SHARE", 1 << 30)
    assert fixtures.table(spark, folder, "part").rdd.getNumPartitions() == 1


def test_whole_files_are_read_without_a_shuffle(spark, monkeypatch):
    rows = ["0", "SECTION", "2", "BLOCKS", "0", "BLOCK", "2", "B1", "0", "LINE", "8", "0", "10", "0", "20", "0", "11", "3", "21", "1", "0", "ENDBLK", "0", "LINE", "8", "after", "0", "ENDSEC",
            "0", "SECTION", "2", "ENTITIES", "0", "POLYLINE", "8", "P", "0", "VERTEX", "10", "1", "20", "2", "0", "VERTEX", "10", "x", "20", "3", "0", "SEQEND", "0", "TEXT", "3", "ab", "3", "cd", "1", "ef", "none", "x", "0", "EOF", "0"]
    files = spark.createDataFrame([("d", "\n".join(rows)), ("empty", ""), (None, "\n".join(rows))], "drawing_id string, text string")
    lines = spark.createDataFrame([("d", i, v) for i, v in enumerate(rows)], "drawing_id string, line_no long, line string")
    monkeypatch.setattr(dw, "cut_lineage", lambda df: df)
    found = dw.parse_entities(files)
    assert "Exchange" not in plan(found)
    split = dw.parse_lines(lines).select(*found.columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, split.collect()))
    got = {r.entity_no: (r.dxftype, r.section, r.block, r.owner_type, r.owner_no, r.text) for r in found.collect()}
    assert got[3] == ("LINE", "BLOCKS", "B1", None, None, "") and got[5][1:3] == ("BLOCKS", None)
    assert got[9][3:5] == ("POLYLINE", 8) and got[12] == ("TEXT", "ENTITIES", None, "SEQEND", 11, "abcdef")


def test_grams_of_labels_are_not_sent_to_every_task(spark, tmp_path):
    schema = "sheet_id long, uid long, match_key string, room_type string, confidence double, u double, v double, kind string, x double, y double"
    rows = [(s, 10 * s + k, name, "unknown", 0.9, 0.1, 0.2, "room_label", 1.0, 2.0) for s in range(3) for k, name in enumerate(("KITCHEN", "MASTER BEDROOM", "STORE"))]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/labels")
    labels = spark.read.parquet(f"{tmp_path}/labels")
    found = rg.candidates(labels, labels)
    by_gram = [line for line in plan(found).splitlines() if "Join" in line and "_g#" in line]
    assert by_gram and all("SortMergeJoin" in line for line in by_gram)
    assert sorted((r.image_label_id, r.cad_uid) for r in found.collect()) == [(r[1], r[1]) for r in rows]


def test_stacks_are_carried_in_few_rounds(spark, monkeypatch):
    """A stack of 40, a ring, and an object that rests twice on one thing and is listed twice."""
    links = [(1, k, k - 1) for k in range(1, 40)] + [(2, 0, 2), (2, 1, 0), (2, 2, 1)] + [(3, 1, 0), (3, 1, 0), (3, 2, 1)]
    objects = [(b, k, s, float(k), 0.0, 0.0) for b, k, s in [(1, 0, None), *links[:39], *links[39:], (3, 0, None)]]
    moved = [(1, 0), (1, 30), (2, 1), (3, 0)]
    rounds = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: rounds.append(0) or cut(df))
    found = graph.carry_children(
        spark.createDataFrame([(b, r, 0.0, 0.0, 1.0, 0.0, 0.0) for b, r in moved], "building_id long, root_id long, old_x double, old_y double, dx double, dy double, turn_deg double"),
        spark.createDataFrame(objects, "building_id long, object_id long, support_id long, x double, y double, rotation_deg double"))
    expected = [(1, r, k, k + 1.0) for r in (0, 30) for k in range(r + 1, 40)] + [(2, 1, k, k + 1.0) for k in (0, 2)]
    expected += [(3, 0, 1, 2.0)] * 4 + [(3, 0, 2, 3.0)] * 2  # both ways to it, each for both rows of object 1
    assert sorted((r.building_id, r.root_id, r.object_id, r.x) for r in found.collect()) == sorted(expected)
    assert len(rounds) <= 20


def test_many_drawings_share_a_file_and_come_apart_again(spark, tmp_path):
    texts = {k: "\n".join(f"{k}-{i}" if i % 7 else "" for i in range(300 * k + 1)) for k in range(40)}
    files = spark.createDataFrame(list(texts.items()), "drawing_id long, text string").repartition(2)
    dw.write_bundles(files, f"{tmp_path}/d")
    assert len(list(tmp_path.glob("d/part-*"))) == 2
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")  # drawings lie across splits
    try:
        found = dw.read_bundles(spark, f"{tmp_path}/d").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    lines = {}
    for r in found:
        lines.setdefault(int(r.drawing_id), {})[r.line_no] = r.line
    assert {k: "\n".join(v[i] for i in range(len(v))) for k, v in lines.items()} == texts
