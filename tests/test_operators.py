"""Hand-computed and brute-force checks of the order-dependent and iterative operators."""

import random

import pytest
from pyspark.sql import functions as F

from floorlake.operators import evaluation, fusion, graph, planning, runs, scale


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_noisy_or_of_two(spark):
    df = spark.createDataFrame([(0.9,), (0.8,)], "c double")
    assert df.agg(fusion.corroborated(F.col("c")).alias("c")).first()["c"] == pytest.approx(0.94)


def test_unmeasured_axes_are_excluded(spark):
    df = spark.createDataFrame([(1, "colour", 0.5, 1.0, True), (1, "layout", 0.0, 0.0, False)], "k int, axis string, score double, confidence double, measured boolean")
    got = evaluation.combine_axes(df, ["k"]).first()
    assert got["score"] == pytest.approx(0.5) and got["weight_used"] == pytest.approx(0.2)


def test_nothing_measured_keeps_zero_weight(spark):
    df = spark.createDataFrame([(1, "colour", 0.5, 1.0, False)], "k int, axis string, score double, confidence double, measured boolean")
    got = evaluation.combine_axes(df, ["k"]).first()
    assert (got["score"], got["confidence"], got["weight_used"]) == (0.0, 0.0, 0.0)


def test_gain_equal_to_epsilon_is_rejected(spark):
    df = spark.createDataFrame([(0.002,), (0.0021,)], "measured_gain double")
    assert [r["accepted"] for r in runs.accept(df).collect()] == [False, True]


def test_rank_within_matches_sorting_in_a_hot_group(spark):
    rng = random.Random(3)
    data = [(0 if i % 3 else i, rng.random(), i) for i in range(2000)]
    ranked = scale.rank_within(spark.createDataFrame(data, "k int, v double, i int"), ["k"], [F.desc("v"), F.asc("i")])
    got = {(r["k"], r["i"]): r["rank"] for r in ranked.collect()}
    for k in {d[0] for d in data}:
        for pos, (_, i) in enumerate(sorted((-v, i) for kk, v, i in data if kk == k), 1):
            assert got[(k, i)] == pos


def test_running_by_blocks_crosses_blocks(spark):
    df = spark.range(1, 101).select(F.lit(1).alias("k"), F.col("id").alias("iteration"))
    out = scale.running_by_blocks(df, ["k"], "iteration", {"s": ("sum", F.col("iteration")), "m": ("max", F.when(F.col("iteration") % 7 == 0, F.col("iteration")))}, block=8)
    for r in out.collect():
        i = r["iteration"]
        assert r["s"] == i * (i + 1) // 2 and r["m"] == (i - i % 7 or None)


def test_medians(spark):
    df = spark.createDataFrame([(1, 3.0, 1), (1, 1.0, 2), (1, 2.0, 3), (2, 1.0, 4), (2, 4.0, 5)], "k int, v double, i int")
    assert rows(scale.medians_within(df, ["k"], ["v"], "i")) == [(1, 2.0), (2, 2.5)]
    assert rows(scale.medians_within(df, ["k"], ["v"], "i", upper=True)) == [(1, 2.0), (2, 4.0)]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)]
    ids = sorted({x for e in edges for x in e} | {5000})
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(50)) and got[5000] == 5000


def test_topological_order_equals_ready_first_queue(spark):
    rules = {("camera_correction", "furniture_translation"), ("style_refinement", "material_adjustment"), ("style_refinement", "palette_adjustment"),
             ("palette_adjustment", "material_adjustment"), ("style_refinement", "asset_replacement"), ("asset_replacement", "furniture_scale_refinement"),
             ("decor_density", "furniture_translation"), ("camera_correction", "furniture_scale_refinement"), ("camera_correction", "furniture_rotation")}
    types = sorted({t for r in rules for t in r})
    rng = random.Random(11)
    actions = [(1, f"a{i}", rng.choice(types)) for i in range(60)]
    order = list(range(60))
    rng.shuffle(order)
    ranked = [(b, a, t, order[i] + 1) for i, (b, a, t) in enumerate(actions)]
    scopes = [(1, a, "room", str(rng.randrange(6))) for _, a, _ in actions for _ in range(rng.randrange(1, 3))]
    got = planning.order_plan(spark.createDataFrame(ranked, "building_id int, action_id string, action_type string, rank long"),
                              spark.createDataFrame(scopes, "building_id int, action_id string, kind string, entity string").distinct(), limit=100)
    got = [r["action_id"] for r in got.orderBy("position").collect()]

    places = {a: {e for _, x, _, e in scopes if x == a} for _, a, _, _ in ranked}
    kind = {a: t for _, a, t, _ in ranked}
    rank = {a: r for _, a, _, r in ranked}
    before = {a: {p for p in kind if p != a and (kind[p], kind[a]) in rules and places[p] & places[a]} for a in kind}
    want, done = [], set()
    while len(want) < len(kind):
        nxt = min((a for a in kind if a not in done and before[a] <= done), key=rank.get)
        want.append(nxt)
        done.add(nxt)
    assert got == want


def test_exclusion_keeps_what_a_dropped_action_would_have_dropped(spark):
    ranked = spark.createDataFrame([(1, "a", "asset_replacement", "o1", 1), (1, "b", "asset_variant_swap", "o1", 2), (1, "c", "furniture_scale_refinement", "o2", 3)],
                                   "building_id int, action_id string, action_type string, target string, rank long")
    scopes = spark.createDataFrame([(1, "b", "object", "o2"), (1, "c", "object", "o2")], "building_id int, action_id string, kind string, entity string")
    got = {r["action_id"]: r["excluded"] for r in planning.exclude_contradictions(ranked, scopes).collect()}
    assert got == {"a": False, "b": True, "c": False}


def brute_fusion(data, threshold=0.45):
    out = {}
    groups = {}
    for r in data:
        groups.setdefault((r[0], r[1]), []).append(r)
    for key, members in groups.items():
        images = {}
        for r in members:
            images.setdefault(r[2], []).append(r)
        seed = max(images, key=lambda i: (len(images[i]), i))
        look = lambda r: (int(r[4][1:3], 16) / 255, int(r[4][3:5], 16) / 255, int(r[4][5:7], 16) / 255, r[5], ["very_small", "small", "medium", "large", "very_large"].index(r[6]), r[7])
        size = lambda r: (-r[8], r[3])
        clusters = [[r] for r in sorted(images[seed], key=size)]
        for image in sorted(images):
            if image == seed:
                continue
            taken = set()
            for r in sorted(images[image], key=size):
                best, at = 0.0, -1
                for c, cluster in enumerate(clusters):
                    if c not in taken:
                        score = max(fusion.similarity(look(r), look(m)) for m in cluster)
                        if score > best:
                            best, at = score, c
                if at >= 0 and best >= threshold:
                    clusters[at].append(r)
                else:
                    clusters.append([r])
                    at = len(clusters) - 1
                taken.add(at)
        for c, cluster in enumerate(clusters):
            for r in cluster:
                out[(r[2], r[3])] = c
    return out


def test_object_fusion_equals_brute_force(spark):
    rng = random.Random(5)
    hexes = ["#8C5A3C", "#3F6B5E", "#D8C3A5", "#101010", "#FFFFFF"]
    data = [(room, cat, img, img * 100 + j + (50 if cat == "chair" else 0), rng.choice(hexes), rng.choice(["wood", "fabric"]), rng.choice(["small", "medium", "very_large"]), rng.choice(["grey", "oak", ""]), rng.random())
            for room in (1, 2) for cat in ("sofa", "chair") for img in range(room * 10, room * 10 + 4) for j in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(data, "room_id int, category string, image_id int, local_id int, color_hex string, material string, size_bucket string, label string, box_area double")
    want = brute_fusion(data)
    for shaken in (df, df.orderBy(F.rand(1)).repartition(7)):
        got = {(r["image_id"], r["local_id"]): r["cluster"] for r in fusion.fuse_objects(shaken, ["room_id"]).collect()}
        assert got == want


def test_suppression_compares_with_kept_boxes_only(spark):
    boxes = [(1, "a", 0.0, 0.0, 0.10, 1.0, 0.9), (1, "b", 0.03, 0.0, 0.13, 1.0, 0.8), (1, "c", 0.06, 0.0, 0.16, 1.0, 0.7), (1, "d", 0.0, 0.0, 0.10, 1.0, 0.1)]
    df = spark.createDataFrame(boxes, "g int, box_id string, bx0 double, by0 double, bx1 double, by1 double, confidence double")
    assert [r["box_id"] for r in fusion.suppress_overlaps(df, ["g"]).orderBy("box_id").collect()] == ["a", "c"]


def test_merge_is_independent_of_input_order(spark):
    data = [("colour", "ColourPalette", "x", 1, -1, v, 0.5, 0.4, float(v)) for v in range(3)]
    cols = "axis string, subsystem string, code string, room_id int, object_id int, viewpoint_id int, severity double, confidence double, difference double"
    df = spark.createDataFrame(data, cols)
    one = rows(evaluation.merge_findings(df))
    assert one == rows(evaluation.merge_findings(df.orderBy(F.rand(2)).repartition(5)))
    assert one[0][6] == pytest.approx(0.5)
