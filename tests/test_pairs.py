"""Pairs of footprints against formulas worked out point by point, and the length of the methods Spark makes of them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from floorlake.functions import geometry as g
from floorlake.operators import pixels, placement, spatial, validation

SCHEMA = "building_id long, room_id long, object_id long, x double, y double, z double, width double, depth double, height double, rotation_deg double, support string, support_id long, category string, by_hand boolean"


def objects(spark, folder):
    rng = random.Random(5)
    rows = [(1, k % 2, k, rng.uniform(0, 6), rng.uniform(0, 6), 0.0, rng.uniform(0.3, 2.0), rng.uniform(0.3, 1.5), 1.0, rng.uniform(0, 360), "floor", None, "sofa", k % 5 == 0) for k in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/objects")
    flags = F.when(F.col("by_hand"), F.array(F.lit("position_set_by_user"))).otherwise(F.array().cast("array<string>"))
    return rows, spark.read.parquet(f"{folder}/objects").withColumn("flags", flags)


def corners(r):
    c, s = math.cos(math.radians(r[9])), math.sin(math.radians(r[9]))
    return [(r[3] + i * r[6] / 2 * c - j * r[7] / 2 * s, r[4] + i * r[6] / 2 * s + j * r[7] / 2 * c) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def depth(a, b):
    found = []
    for angle in (a[9], a[9] + 90, b[9], b[9] + 90):
        u = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        pa, pb = ([x * u[0] + y * u[1] for x, y in corners(r)] for r in (a, b))
        found.append(min(max(pa), max(pb)) - max(min(pa), min(pb)))
    return max(0.0, min(found))


def gap(a, b):
    def edge(p, q, r):
        t = max(0.0, min(1.0, ((p[0] - q[0]) * (r[0] - q[0]) + (p[1] - q[1]) * (r[1] - q[1])) / math.dist(q, r) ** 2))
        return math.dist(p, (q[0] + t * (r[0] - q[0]), q[1] + t * (r[1] - q[1])))
    return min(edge(p, o[i], o[i - 1]) for s, o in ((corners(a), corners(b)), (corners(b), corners(a))) for p in s for i in range(4))


def test_depths_and_gaps_match_the_corners(spark, tmp_path):
    rows, placed = objects(spark, tmp_path)
    pairs = [(a, b) for a in rows for b in rows if a[2] < b[2] and a[1] == b[1]]
    hit = {(r.a_object_id, r.b_object_id): r.penetration for r in validation.collisions(placed).collect()}
    assert hit == pytest.approx({(a[2], b[2]): depth(a, b) for a, b in pairs if depth(a, b) > 0.02}, abs=2e-9)
    narrow = {(r.a_object_id, r.b_object_id): r.gap for r in validation.narrow_gaps(placed).collect()}
    big = lambda r: r[6] * r[7] >= 0.15
    assert narrow == pytest.approx({(a[2], b[2]): gap(a, b) for a, b in pairs if big(a) and big(b) and depth(a, b) == 0 and gap(a, b) < 0.6}, abs=2e-9)
    by_hand = {(r.first_id, r.second_id) for r in validation.user_conflicts(placed).collect()}
    assert by_hand == {(a[2], b[2]) for a, b in pairs if (a[13] or b[13]) and depth(a, b) > 0.02}


def longest_method(spark, df):
    found = df._jdf.queryExecution().debug().codegenToSeq()
    return max(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size()))


@pytest.fixture
def planned_at_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_methods_of_pairs_are_short_enough_to_compile(spark, tmp_path, planned_at_once):
    """The JVM compiles no method of 8000 bytes or more; it would run a pair at a time in the interpreter."""
    _, placed = objects(spark, tmp_path)
    for found in (validation.collisions(placed), validation.narrow_gaps(placed), validation.user_conflicts(placed)):
        assert longest_method(spark, found) < 8000


def test_a_pair_is_measured_once(spark, tmp_path):
    _, placed = objects(spark, tmp_path)
    pairs = spatial.footprint_pairs(placed, placed, ["building_id", "room_id"], once="object_id")
    assert spatial.measured_pairs(pairs, "d", g.rect_overlap).count() == pairs.count()


def test_detections_are_placed_in_a_short_method(spark, tmp_path, planned_at_once):
    views = [(v, 0.0, 0.0, 1.6, 0.0, -10.0, 60.0, 1.5) for v in range(3)]
    spark.createDataFrame(views, "viewpoint_id long, x double, y double, z double, yaw double, pitch_deg double, vfov_deg double, aspect double").write.parquet(f"{tmp_path}/v")
    seen = [(v, k, 0.4, 0.6, 0.5 + 0.1 * k, 0.0, 1.0) for v in range(3) for k in range(5)]
    spark.createDataFrame(seen, "viewpoint_id long, object_id long, bx0 double, bx1 double, by1 double, actual_x double, actual_y double").write.parquet(f"{tmp_path}/d")
    found = pixels.displacements(spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/v"))
    # Below the optical axis, which falls 10 degrees, by the angle of its place in the picture.
    ways = {k: 1.6 / math.tan(math.radians(10) + math.atan(2 * 0.1 * k * math.tan(math.radians(30)))) for k in range(5)}
    assert sorted((r.viewpoint_id, r.object_id) for r in found.collect()) == [(v, k) for v in range(3) for k in range(5)]
    assert {r.object_id: r.implied_y for r in found.collect()} == pytest.approx(ways)
    assert longest_method(spark, found) < 8000


def test_outlines_are_only_read_for_objects_beside_others(spark, monkeypatch):
    monkeypatch.setattr(placement.g, "in_polygon", lambda *a: F.raise_error(F.lit("outline read")).cast("boolean"))
    monkeypatch.setattr(placement.g, "clamp_inside", lambda *a: F.raise_error(F.lit("outline read")).cast("struct<x:double,y:double>"))
    things = spark.createDataFrame([(1, 1, k, "sofa", float(k), 1.0, 0.0, 1.0, 1.0, 1.0, 0.0) for k in range(3)], "building_id long, room_id long, object_id long, category string, x double, y double, z double, width double, depth double, height double, rotation_deg double")
    room = spark.createDataFrame([(1, 1, 2.7)], "building_id long, room_id long, ceiling_height double").withColumn("polygon", g.box_polygon(F.lit(0.0), F.lit(0.0), F.lit(6.0), F.lit(6.0)))
    links = lambda p: spark.createDataFrame([(0, p, 1), (1, p, 2)], "subject_id long, predicate string, target_id long")
    assert sorted(r.x for r in placement.apply_relations(links("above"), things, room).collect()) == [1.0, 2.0]
    with pytest.raises(Exception, match="outline read"):
        placement.apply_relations(links("beside"), things, room).collect()
