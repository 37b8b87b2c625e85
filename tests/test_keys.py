"""Ids that restart in every building or drawing, null group keys, edits given twice, and drawing details."""

import pytest
from pyspark.sql import functions as F

from floorlake.operators import drawings as dr
from floorlake.operators import edits as ed
from floorlake.operators import fusion
from floorlake.operators import spatial as sp
from floorlake.sources import drawings

RING = "array<struct<x:double,y:double>>"


def square(x, side=4.0):
    return [(x, 0.0), (x + side, 0.0), (x + side, side), (x, side)]


def test_points_of_two_buildings_with_one_id(spark):
    points = spark.createDataFrame([(1, 7, 1.0, 1.0), (2, 7, 11.0, 1.0)], "building_id long, object_id long, x double, y double")
    regions = spark.createDataFrame([(1, 5, square(0.0), 16.0), (2, 5, square(10.0), 16.0)], f"building_id long, room_id long, polygon {RING}, area double")
    found = sp.assign_regions(points, "object_id", regions, 0.5).collect()
    assert sorted((r.building_id, r.object_id, r.room_id, r.inside) for r in found) == [(1, 7, 5, True), (2, 7, 5, True)]
    walls = spark.createDataFrame([(1, 3, 0.0, 0.0, 4.0, 0.0), (2, 3, 10.0, 4.0, 14.0, 4.0)], "building_id long, wall_id long, sx double, sy double, ex double, ey double")
    near = sp.nearest_segment(points, "object_id", walls, "wall_id").collect()
    assert sorted((r.building_id, r.object_id, r.wall_id, r.distance) for r in near) == [(1, 7, 3, 1.0), (2, 7, 3, 3.0)]
    kept = sp.supersede(points.filter("building_id = 1"), points.withColumn("x", F.lit(1.0)), "object_id").collect()
    assert sorted(r.building_id for r in kept) == [1, 2]


OBJECTS = "building_id long, object_id long, support_id long, uncertain boolean, flags array<string>, category string, material string, color_hex string, asset string, asset_score double"
EDITS = "building_id long, op string, target_id string, key string, value string, ordinal long"


def objects(spark):
    rows = [(b, i, s, True, [], "sofa", "oak", "#000000", "", 0.5) for b in (1, 2) for i, s in ((5, None), (6, 5), (7, 6))]
    return spark.createDataFrame(rows, OBJECTS)


def test_edits_stay_in_their_building(spark):
    edits = spark.createDataFrame([(1, "remove_objects", "6", "", "", 1), (2, "keep_objects", "5", "", "", 2)], EDITS)
    left = ed.keep_uncertain(ed.remove_objects(objects(spark), edits), edits).collect()
    assert sorted((r.building_id, r.object_id, r.uncertain) for r in left) == [(1, 5, True), (2, 5, False), (2, 6, True), (2, 7, True)]


def test_the_last_value_counts(spark):
    edits = spark.createDataFrame([(1, "object_overrides", "5", "color_hex", "#FF0000", 1), (1, "object_overrides", "5", "color_hex", "#00FF00", 2)], EDITS)
    patched, _ = ed.override_appearance(objects(spark), edits)
    got = {(r.building_id, r.object_id): r.color_hex for r in patched.collect()}
    assert got[1, 5] == "#00FF00" and got[2, 5] == got[1, 6] == "#000000"


def test_duplicate_segments_of_drawings_and_polylines(spark):
    rows = [("a", 1, 0.0, 0.0, 1.0, 0.0), ("a", 1, 1.0, 0.0, 1.0, 1.0), ("a", 2, 1.0, 0.0, 0.0, 0.0), ("b", 2, 0.0, 0.0, 1.0, 0.0)]
    got = dr.distinct_segments(spark.createDataFrame(rows, "drawing_id string, entity_id long, sx double, sy double, ex double, ey double")).collect()
    assert sorted((r.drawing_id, r.entity_id, r.ey) for r in got) == [("a", 1, 0.0), ("a", 1, 1.0), ("b", 2, 0.0)]


def test_rows_without_a_group_are_one_group(spark):
    rows = [(1, None, 1, 0.0, 0.0, 1.0, 1.0, 0.9), (1, None, 2, 0.0, 0.0, 1.0, 0.9, 0.8), (1, 4, 3, 0.0, 0.0, 1.0, 0.9, 0.7)]
    boxes = spark.createDataFrame(rows, "building_id long, room_id long, box_id long, bx0 double, by0 double, bx1 double, by1 double, confidence double")
    assert sorted(r.box_id for r in fusion.suppress_overlaps(boxes, ["building_id", "room_id"]).collect()) == [1, 3]


def entities(spark, *parts, blocks=()):
    pairs = ["0", "SECTION", "2", "BLOCKS", *blocks, "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES", *parts, "0", "ENDSEC", "0", "EOF"]
    return drawings.parse_entities(spark.createDataFrame([("d", "\n".join(pairs))], "drawing_id string, text string"))


def pairs(**groups):
    return [x for k, v in groups.items() for x in (k.strip("_g"), str(v))]


@pytest.mark.parametrize(("groups", "want"), [
    ({"g70": 32, "g13": 0, "g23": 0, "g14": 4, "g24": 3, "g11": 9, "g21": 9, "g50": 0}, 4.0),
    ({"g70": 0, "g13": 0, "g23": 0, "g14": 4, "g24": 3, "g50": 90}, 3.0),
    ({"g70": 1, "g13": 0, "g23": 0, "g14": 4, "g24": 3}, 5.0),
    ({"g70": 1, "g13": 0, "g23": 0, "g14": 4, "g24": 3, "g42": 7}, 7.0),
    ({"g70": 2, "g13": 0, "g23": 0, "g14": 4, "g24": 3}, None),
])
def test_dimensions_measure_between_their_points(spark, groups, want):
    got = drawings.dimensions(entities(spark, "0", "DIMENSION", "8", "DIM", *pairs(**groups))).collect()
    assert [round(r.measurement, 9) for r in got] == ([] if want is None else [want])


def test_hatch_area_is_that_of_the_first_path(spark):
    first = ["93", "4", "10", "0", "20", "0", "10", "2", "20", "0", "10", "2", "20", "1", "10", "0", "20", "1"]
    second = ["93", "3", "10", "5", "20", "5", "10", "6", "20", "5", "10", "6", "20", "9"]
    got = drawings.hatches(entities(spark, "0", "HATCH", "8", "H", "2", "NET", "10", "0", "20", "0", "91", "2", *first, *second, "98", "1", "10", "1", "20", "1")).first()
    assert got.area == 2.0 and (got.x, got.y) == (1.0, 0.5)


def test_long_texts_are_joined_and_only_plain_text_and_solids_are_mirrored(spark):
    rows = entities(spark, "0", "MTEXT", "8", "T", "10", "3", "20", "0", "3", "MASTER ", "1", "BEDROOM", "230", "-1", "0", "TEXT", "8", "T", "10", "3", "20", "0", "1", "KITCHEN", "230", "-1",
                    "0", "SOLID", "8", "S", "10", "1", "20", "0", "11", "2", "21", "0", "12", "1", "22", "1", "13", "2", "23", "1", "230", "-1")
    got = {r.raw: (r.room_type, r.x) for r in drawings.texts(rows).collect()}
    assert got == {"MASTER BEDROOM": ("master_bedroom", 3.0), "KITCHEN": ("kitchen", -3.0)}
    assert {r.sx for r in drawings.segments(rows).filter("dxftype = 'SOLID'").collect()} == {-1.0, -2.0}


def test_blocks_of_any_size_and_depth_are_expanded(spark):
    def block(name, *parts):
        return ["0", "BLOCK", "2", name, *parts, "0", "ENDBLK"]

    def insert(name):
        return ["0", "INSERT", "8", "0", "2", name, "10", "1", "20", "0"]

    line = ["0", "LINE", "8", "0", "10", "0", "20", "0", "11", "1", "21", "0"]
    chain = [x for i in range(5) for x in block(f"B{i}", *insert(f"B{i + 1}"))] + block("B5", *(line * 600), *insert("B2"))
    rows = entities(spark, *insert("B0"), blocks=chain)
    placed = drawings.inserts(rows)
    got = drawings.expand_inserts(placed.filter("parent_block IS NULL"), drawings.segments(rows).filter("block IS NOT NULL"), placed.filter("parent_block IS NOT NULL"))
    assert got.count() == 600 and {(r.depth, r.sx, r.ex) for r in got.collect()} == {(6, 6.0, 7.0)}


def test_digests_tell_separators_and_nulls_apart(spark):
    from floorlake.functions.digest import row_digest

    rows = spark.createDataFrame([("a|b", "c", 1.0), ("a", "b|c", 1.0), ("", "c", 1.0), (None, "c", 1.0), ("~", "c", 1e30), (None, "c", float("nan"))], "p string, q string, d double")
    assert rows.select(row_digest(rows, ["p", "q", "d"]).alias("h")).distinct().count() == 6


def test_unreadable_pictures_are_listed(spark):
    import numpy as np

    from floorlake.functions.images import encode_png
    from floorlake.sources.documents import read_pixels, unreadable_images

    images = spark.createDataFrame([("good", encode_png(np.zeros((2, 2, 3)))), ("bad", b"\xff\xd8 no picture"), ("none", None)], "image_id string, content binary")
    assert sorted(map(tuple, unreadable_images(images).collect())) == [("bad", "not decodable here"), ("none", "no bytes")]
    assert {r.image_id for r in read_pixels(images.filter("content is not null")).collect()} == {"good"}


def test_nothing_is_cut_unless_asked(spark):
    from floorlake.operators.scale import top_within

    rows = spark.createDataFrame([(b, i) for b in (1, 2) for i in range(40)], "building_id long, object_id long")
    ranked = top_within(rows, ["building_id"], [F.desc("object_id")], None).collect()
    assert len(ranked) == 80 and all(r["rank"] == 40 - r.object_id for r in ranked)
    assert top_within(rows, ["building_id"], [F.desc("object_id")], 3).count() == 6
