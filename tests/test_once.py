"""Formulas and tables that a query names several times are worked out once."""

import json

from pyspark.sql import functions as F

from floorlake import plans
from floorlake.functions import geometry as g
from floorlake.functions import text as tx
from floorlake.functions.binding import let
from floorlake.plans import planning
from floorlake.sources import documents


def analysed(df):
    return df._jdf.queryExecution().analyzed().toString()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark, folder):
    spark.range(600).select(
        F.col("id").alias("l_orderkey"), (F.col("id") * 7 % 90).alias("l_partkey"), (F.col("id") % 20).alias("l_suppkey"), (F.col("id") % 7).cast("int").alias("l_linenumber"),
        (F.col("id") % 50 + 1.0).alias("l_quantity"), (F.col("id") % 11 / 100).alias("l_discount"), (F.col("id") % 9 / 100).alias("l_tax"),
        F.when(F.col("id") % 4 == 0, "R").otherwise("N").alias("l_returnflag")).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(20).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).cast("int").alias("s_nationkey")).write.parquet(f"{folder}/supplier.parquet")
    spark.range(300).select(F.col("id").alias("o_orderkey"), (F.col("id") % 60).alias("o_custkey"), F.lit("F").alias("o_orderstatus")).write.parquet(f"{folder}/orders.parquet")
    spark.range(200).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type")).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_let_gives_nulls_and_values_on(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int").select(let(F.col("a") + 1, lambda b: F.coalesce(b * b, F.lit(-1))).alias("c"))
    assert [r.c for r in df.collect()] == [4, -1]


def test_terms_are_trimmed_once_and_found_by_rank(spark):
    for kind, (_, synonyms, default) in tx.VOCABULARIES.items():
        rows = tx.vocabulary_entries(kind)
        raws = [None, "", "  ", "Nothing_of_it", *[f"Big  {t.upper()}" for *_, t, _ in rows[::3]], *[f"{a[3]} {b[3]}" for a, b in zip(rows[::7], rows[3::5])], *[t for *_, t, _ in rows[::9]]]
        df = spark.createDataFrame([(r,) for r in raws], "raw string")
        found = df.select("raw", tx.normalise_term(F.col("raw"), kind).alias("name"))
        assert analysed(found).count("lower(") == 1

        def expected(raw):
            text = " ".join((raw or "").lower().replace("_", " ").split())
            exact = [r[4] for r in rows if r[0] == 1 and r[3] == text] + [c for t, c in dict(synonyms).items() if t == text]
            inside = sorted(r for r in rows if r[0] > 2 and r[3] in text)
            return default if text == "" else (exact + [r[4] for r in inside] + [default])[0]

        assert [(r.raw, r.name) for r in found.collect()] == [(r, expected(r)) for r in raws]


def test_grams_and_words_of_labels_are_taken_once(spark):
    df = spark.createDataFrame([("MASTER BEDROOM", "MASTER BED ROOM"), ("A B", "B A"), ("", "X"), (None, "X"), ("KITCHEN", "KITCHEN"), ("STORE", "HALL")], "a string, b string")
    found = df.select(tx.text_similarity(F.col("a"), F.col("b")).alias("s"), tx.word_jaccard(F.col("a"), F.col("b")).alias("j"))
    assert analysed(found).count("array_intersect(") == 2 and analysed(found).count("sequence(") == 2
    assert [(r.s, r.j) for r in found.collect()] == [(1.0, 0.25), (0.75, 0.5), (0.0, 0.5), (0.0, 0.5), (1.0, 1.0), (0.0, 0.0)]


def test_nearest_point_of_an_outline_is_found_once(spark):
    df = spark.createDataFrame([(5.0, 1.0, 0.5), (2.0, 1.0, 0.5), (0.1, 1.0, 0.5)], "x double, y double, m double").withColumn("p", g.box_polygon(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(2.0)))
    found = df.select(g.clamp_inside("x", "y", F.col("p"), F.col("m")).alias("to"))
    assert analysed(found).lower().count("hypot(") == 2
    assert [(r.to.x, r.to.y) for r in found.collect()] == [(3.5, 1.0), (2.0, 1.0), (0.5, 1.0)]


def test_answers_are_gone_through_once(spark):
    whole, broken = json.dumps({"objects": [{"category": "bed"}]}), '{"objects": [{"category": "bed"}, {"category": "so'
    raws = [whole, f"```json\n{whole}\n```", f"So: {whole} done", broken, "none", "", None, "[1]"]
    df = spark.createDataFrame(list(enumerate(raws)), "image_id int, raw string")
    found = documents.extract_answers(df)
    assert "Union" not in analysed(found)
    assert found.columns == ["image_id", "raw", "payload", "how"]
    got = {r.image_id: (r.payload, r.how) for r in found.collect()}
    assert [got[i][1] for i in range(8)] == ["whole", "fenced", "outermost", "repaired", "malformed", "malformed", "malformed", "malformed"]
    assert [got[i][0] for i in range(8)] == [whole, whole, whole, '{"objects": [{"category": "bed"}]}', None, None, None, None]
    kept = documents.flatten_objects(found).filter("reason <> ''")
    below = plan(kept).split("Generate inline", 1)
    assert len(below) == 2 and "contains(" not in below[0].split("Generate")[0]


def test_findings_are_merged_once_for_a_report_and_a_plan(spark, tmp_path):
    folder = tables(spark, tmp_path)
    assert "lineitem.parquet" not in plan(plans.QUERIES["building_report"](spark, folder))
    assert all("lineitem.parquet" not in plan(df) for df in planning.actions_and_scopes(spark, folder))


def test_objects_are_numbered_once_for_their_overrides(spark, tmp_path):
    assert "Window" not in plan(plans.QUERIES["transform_overrides"](spark, tables(spark, tmp_path)))


def test_answers_are_written_once_for_all_their_lists(spark, tmp_path):
    found = plans.QUERIES["answer_rejections"](spark, tables(spark, tmp_path))
    assert "events.parquet" not in plan(found)
    assert not found.isEmpty()
