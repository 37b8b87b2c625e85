"""Drawings over many splits, sheets fitted by votes, regions assigned exactly: against whole-file reading and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from floorlake.operators import registration as rg
from floorlake.operators.scale import greedy_matching
from floorlake.sources import drawings as dw


def drawing(n, seed):
    rnd = random.Random(seed)
    rows = ["0", "SECTION", "2", "ENTITIES"]
    for i in range(n):
        kind = rnd.randrange(6)
        if kind < 3:
            rows += ["0", "LINE", "8", f"A-WALL-{i % 3}", "10", str(i), "20", "1.5" if kind else "north", "11", str(i + 2), "21", "7"]
        elif kind == 3:
            rows += ["0", "LWPOLYLINE", "8", "P", "70", "1", "10", "0", "20", "0", "10", str(i), "20", "0", "10", str(i), "20", "4"]
        elif kind == 4:
            rows += ["0", "CIRCLE", "8", "C", "10", "1", "20", "1"] + (["40", "2"] if i % 2 else [])
        else:
            rows += ["0", "TEXT", "8", "T", "bad code", "x", "10", "1", "20", "2", "1", f"Kitchen {i}"]
    return "\n".join([*rows, "0", "ENDSEC", "0", "EOF"])


def test_drawings_are_read_over_many_splits(spark, tmp_path):
    folder = tmp_path / "d"
    folder.mkdir()
    for k, n in enumerate([700, 3, 0, 250]):
        (folder / f"f{k}.dxf").write_text(drawing(n, k).replace("\n", "\r\n" if k == 3 else "\n"))
    whole = dw.parse_entities(dw.read_files(spark, str(folder)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        lines = dw.read_lines(spark, str(folder))
        numbers = lines.groupBy("drawing_id").agg(F.count("*").alias("n"), F.count_distinct("line_no").alias("d"), F.min("line_no").alias("a"), F.max("line_no").alias("b")).collect()
        assert all(r.n == r.d and r.a == 0 and r.b == r.n - 1 for r in numbers)
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 8
        split = dw.parse_lines(lines)
        for table in (dw.skipped, dw.warnings, lambda e: dw.segments(dw.model_entities(e)), lambda e: dw.texts(dw.model_entities(e))):
            a, b = (sorted(map(repr, table(e).select(*sorted(table(whole).columns)).collect())) for e in (whole, split))
            assert a == b and a
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_entities_that_cannot_be_read_are_warnings(spark):
    text = "\n".join(["0", "SECTION", "2", "ENTITIES", "0", "LINE", "8", "W", "10", "1", "20", "1", "11", "2", "21", "x", "0", "INSERT", "10", "1", "20", "2", "0", "LINE", "8", "W", "10", "0", "20", "0", "11", "1", "21", "1", "no", "code", "0", "ENDSEC", "0", "EOF", "0"])
    entities = dw.parse_entities(spark.createDataFrame([("d", text)], "drawing_id string, text string"))
    got = {(r.dxftype, r.reason) for r in dw.warnings(entities).collect()}
    assert got == {("LINE", "group 21 is missing or no number"), ("INSERT", "no block name"), ("LINE", "1 pairs without a group code")}
    assert dw.segments(dw.model_entities(entities)).count() == 1
    assert {(r.dxftype, r.n) for r in dw.skipped(entities).collect()} == {("LINE", 1), ("INSERT", 1)}


def test_greedy_matching_is_the_ordered_fold(spark):
    rnd = random.Random(4)
    rows = [(g, rnd.randrange(12), rnd.randrange(12), rnd.randrange(6)) for g in range(3) for _ in range(70)]
    want = set()
    for g in range(3):
        left, right = set(), set()
        for r, a, b in sorted({(r, a, b) for k, a, b, r in rows if k == g}):
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                want.add((g, a, b, r))
    frame = spark.createDataFrame(sorted(set(rows)), "g int, a int, b int, r int").repartition(3)
    assert {(x.g, x.a, x.b, x.r) for x in greedy_matching(frame, ["g"], "a", "b", ["r"]).collect()} == want


def sheet(n, seed, wrong=0.3):
    """Candidates of one sheet: true ones under a known turn and scale with small errors, wrong ones anywhere."""
    rnd = np.random.default_rng(seed)
    scale, turn, tx, ty = 40.0, math.radians(33.0), -5.0, 60.0
    u, v = rnd.random(n), rnd.random(n)
    x = scale * (math.cos(turn) * u + math.sin(turn) * v) + tx + rnd.normal(0, 0.1, n)
    y = scale * (math.sin(turn) * u - math.cos(turn) * v) + ty + rnd.normal(0, 0.1, n)
    rows = []
    for i in range(n):
        if rnd.random() > wrong:
            rows.append((1, i, 1000000 + i, f"t{i}", float(u[i]), float(v[i]), float(x[i]), float(y[i]), 0.9))
        for j in rnd.integers(0, n, 1):
            if j != i:
                rows.append((1, i, 1000000 + int(j), f"t{i}", float(u[i]), float(v[i]), float(x[j]), float(y[j]), 0.6))
    return rows


def brute_best(rows, tolerance):
    """Support of the best fit over all pairs of candidates, inliers chosen one to one, closest first."""
    best = 0.0
    p = np.array([(r[4], r[5], r[6], r[7]) for r in rows])
    z, w = p[:, 0] - 1j * p[:, 1], p[:, 2] + 1j * p[:, 3]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][1] == rows[j][1] or rows[i][2] == rows[j][2] or abs(z[j] - z[i]) < 1e-9:
            continue
        a = (w[j] - w[i]) / (z[j] - z[i])
        if not 0.5 <= abs(a) <= 500:
            continue
        away = np.abs(a * (z - z[i]) + w[i] - w)
        near = [k for k in np.argsort(away, kind="stable") if away[k] <= tolerance]
        if sum(rows[k][8] for k in near) <= best:
            continue
        left, right, support = set(), set(), 0.0
        for k in near:
            if rows[k][1] not in left and rows[k][2] not in right:
                left.add(rows[k][1])
                right.add(rows[k][2])
                support += rows[k][8]
        best = max(best, support)
    return best


@pytest.mark.parametrize("n", [40, 1000])
def test_votes_find_the_transform(spark, n):
    rows = sheet(n, n)
    frame = spark.createDataFrame(rows, "sheet_id int, image_label_id int, cad_uid int, text string, u double, v double, x double, y double, weight double").repartition(4)
    bounds = spark.createDataFrame([(1, min(r[6] for r in rows), min(r[7] for r in rows), max(r[6] for r in rows), max(r[7] for r in rows))], "sheet_id int, x0 double, y0 double, x1 double, y1 double")
    found = rg.consensus(frame, bounds).first()
    assert abs(found.fit.scale - 40) < 0.3 and abs(found.fit.rotation_deg - 33) < 0.5
    true = sum(r[8] for r in rows if r[2] == 1000000 + r[1])
    assert found.support >= true - 1e-6
    if n < 100:
        assert found.support >= brute_best(rows, found.tolerance_m) - 1e-6


def test_regions_are_assigned_for_the_largest_sum(spark):
    rnd = random.Random(9)
    scores, order, want = [], [], {}
    for plan in range(12):
        types, rooms = rnd.randrange(1, 5), rnd.randrange(4, 7)
        table = [[rnd.choice([0.0, 0.1, 0.2, 0.5, 0.5, 1.2]) for _ in range(rooms)] for _ in range(types)]
        scores += [(plan, f"t{t}", plan * 100 + r, r + 1, table[t][r]) for t in range(types) for r in range(rooms)]
        order += [(plan, f"t{t}", t) for t in range(types)]
        best = max(itertools.permutations(range(rooms), types), key=lambda c: (round(sum(table[t][r] for t, r in enumerate(c)), 9), [-r for r in c]))
        want |= {(plan, f"t{t}"): plan * 100 + r if table[t][r] >= rg.MIN_ASSIGN else None for t, r in enumerate(best)}
    got = rg.assign_regions(spark.createDataFrame(scores, "building_id long, observed_type string, room_id long, region_order long, score double"), spark.createDataFrame(order, "building_id long, observed_type string, position int"))
    assert {(r.building_id, r.observed_type): r.room_id for r in got.collect()} == want


def test_more_types_than_regions_share_the_best(spark):
    scores = [(1, f"t{t}", 10 + r, r + 1, 1.0 + t * 0.1 + r * 0.01 * t) for t in range(4) for r in range(2)]
    order = [(1, f"t{t}", t) for t in range(4)]
    got = rg.assign_regions(spark.createDataFrame(scores, "building_id long, observed_type string, room_id long, region_order long, score double"), spark.createDataFrame(order, "building_id long, observed_type string, position int"))
    assert {r.observed_type: r.room_id for r in got.collect()} == {"t0": None, "t1": None, "t2": 10, "t3": 11}


def test_a_long_assignment_equals_brute_force_by_insertion():
    rnd = random.Random(1)
    for _ in range(40):
        n, m = rnd.randrange(1, 6), rnd.randrange(5, 8)
        value = [[rnd.randrange(50) for _ in range(m)] for _ in range(n)]
        found = rg.best_assignment(value)
        assert len(set(found)) == n
        assert sum(value[i][k] for i, k in enumerate(found)) == max(sum(value[i][k] for i, k in enumerate(c)) for c in itertools.permutations(range(m), n))
