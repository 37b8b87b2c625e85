"""Work on rooms that is done once, and category names that cost little a row."""

from pyspark.sql import functions as F

from floorlake.operators import incremental, rooms


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_category_names_are_looked_up_without_an_expression_a_name(spark, tmp_path):
    names = [" Side-Table ", "shelves", "MICROWAVE", "sofa bed", None, ""]
    spark.createDataFrame([(n,) for n in names], "category string").write.parquet(f"{tmp_path}/c")
    found = spark.read.parquet(f"{tmp_path}/c").withColumn("c", rooms.evidence_category(F.col("category")))
    assert {r.category: r.c for r in found.collect()} == {" Side-Table ": "bedside_table", "shelves": "bookshelf", "MICROWAVE": "oven", "sofa bed": "sofa_bed", None: None, "": ""}
    assert plan(found.select("c")).count("lower(") <= 2


def test_depths_find_rooms_and_neighbours_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    near = spark.createDataFrame([(1, a, b) for k in range(7) for a, b in ((k, k + 1), (k + 1, k))], "building_id long, room_id long, neighbour_id long").mapInPandas(look, "building_id long, room_id long, neighbour_id long")
    own = spark.createDataFrame([(1, k, 3 if k == 0 else 1) for k in range(8)], "building_id long, room_id long, doors long")
    found = rooms.infer_depths(own, near)
    assert {r.room_id: round(r.depth_normalised * 7) for r in found.collect()} == {k: k for k in range(8)}
    assert seen.value == 14


def test_hashes_of_rooms_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    hashes = spark.createDataFrame([(1, k, f"h{k}") for k in range(4)], "building_id long, room_id long, room_hash string").mapInPandas(look, "building_id long, room_id long, room_hash string")
    links = spark.createDataFrame([(1, k, k + 1) for k in range(3)], "building_id long, room_id long, neighbour_id long")
    assert incremental.with_neighbours(hashes, links).count() == 4
    assert len({r.room_hash for r in incremental.with_neighbours(hashes, links).collect()}) == 4
    assert seen.value == 8
