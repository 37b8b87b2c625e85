"""JSON documents: geometry files, scene graphs, model answers, evaluation documents, pictures."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import dim
from ..functions import coerce
from ..functions import text as tx
from ..functions.binding import let
from ..functions.images import decode
from ..operators.scale import top_within

POINT = T.ArrayType(T.DoubleType())
WALL = T.StructType([T.StructField("start", POINT), T.StructField("end", POINT), T.StructField("source_entity", T.StringType()), T.StructField("layer", T.StringType())])
GEOMETRY = T.StructType([
    T.StructField("metadata", T.StructType([T.StructField("source", T.StringType()), T.StructField("scale_factor", T.DoubleType()), T.StructField("segment_count", T.LongType()), T.StructField("units", T.StringType())])),
    T.StructField("walls", T.ArrayType(WALL))])
XYZ = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])
SIZE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("width", "depth", "height")])
ROOM = T.StructType([T.StructField("id", T.StringType()), T.StructField("room_type", T.StringType()), T.StructField("style", T.StringType()), T.StructField("area", T.DoubleType()),
                     T.StructField("confidence", T.DoubleType()), T.StructField("polygon", T.ArrayType(POINT)), T.StructField("wall_ids", T.ArrayType(T.StringType()))])
OBJECT = T.StructType([T.StructField("id", T.StringType()), T.StructField("category", T.StringType()), T.StructField("room_id", T.StringType()), T.StructField("position", XYZ),
                       T.StructField("rotation_z", T.DoubleType()), T.StructField("dimensions", SIZE), T.StructField("support", T.StringType()), T.StructField("support_id", T.StringType()),
                       T.StructField("material", T.StringType()), T.StructField("color_hex", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("uncertain", T.BooleanType()),
                       T.StructField("locked", T.BooleanType()), T.StructField("flags", T.ArrayType(T.StringType())), T.StructField("source_images", T.ArrayType(T.StringType()))])
RELATION = T.StructType([T.StructField("subject", T.StringType()), T.StructField("predicate", T.StringType()), T.StructField("object", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("satisfied", T.BooleanType())])
LIGHT = T.StructType([T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("room_id", T.StringType()), T.StructField("position", XYZ), T.StructField("power_w", T.DoubleType()), T.StructField("color_temperature_k", T.DoubleType()), T.StructField("uncertain", T.BooleanType())])
OPENING = T.StructType([T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("wall_id", T.StringType()), T.StructField("room_id", T.StringType()), T.StructField("position", XYZ), T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType())])
SCENE_WALL = T.StructType([T.StructField("id", T.StringType()), T.StructField("start", POINT), T.StructField("end", POINT), T.StructField("height", T.DoubleType()), T.StructField("thickness", T.DoubleType())])
VIEW = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("room_id", T.StringType()), T.StructField("position", XYZ), T.StructField("yaw", T.DoubleType()), T.StructField("pitch_deg", T.DoubleType()), T.StructField("vertical_fov_deg", T.DoubleType()), T.StructField("aspect", T.DoubleType())])
SCENE_LISTS = {"rooms": ROOM, "walls": SCENE_WALL, "openings": OPENING, "lights": LIGHT, "objects": OBJECT, "relationships": RELATION, "viewpoints": VIEW}
SCENE = T.StructType([T.StructField("schema_version", T.StringType()), T.StructField("room", ROOM), *[T.StructField(k, T.ArrayType(v)) for k, v in SCENE_LISTS.items()]])


def read_geometry(documents: DataFrame, text: str = "value") -> DataFrame:
    """Wall rows of geometry files: drawing_id, wall_no, sx, sy, ex, ey, layer."""
    parsed = documents.withColumn("_d", F.from_json(text, GEOMETRY))
    walls = parsed.select("drawing_id", F.posexplode("_d.walls").alias("wall_no", "w"))
    return walls.select("drawing_id", "wall_no", *[F.get(F.col(f"w.{end}"), F.lit(i)).alias(name) for end, i, name in (("start", 0, "sx"), ("start", 1, "sy"), ("end", 0, "ex"), ("end", 1, "ey"))], "w.layer")


def write_geometry(walls: DataFrame) -> DataFrame:
    """One geometry document per drawing (its walls are one drawing's document by definition)."""
    wall = F.struct("wall_no", F.array("sx", "sy").alias("start"), F.array("ex", "ey").alias("end"), "layer")
    grouped = walls.groupBy("drawing_id").agg(F.array_sort(F.collect_list(wall)).alias("_w"), F.count("*").alias("segment_count"))
    listed = F.transform("_w", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["layer"].alias("layer")))
    return grouped.select("drawing_id", F.to_json(F.struct(F.struct("segment_count").alias("metadata"), listed.alias("walls"))).alias("value"))


def read_scene(documents: DataFrame, text: str = "value") -> dict[str, DataFrame]:
    """One table per list of a scene document; a first-version single ``room`` reads as a list of one."""
    parsed = documents.withColumn("_s", F.from_json(text, SCENE))
    rooms = F.coalesce("_s.rooms", F.when(F.col("_s.room").isNotNull(), F.array("_s.room")))
    lists = {name: rooms if name == "rooms" else F.col(f"_s.{name}") for name in SCENE_LISTS}
    return {name: parsed.select("building_id", F.inline(column)) for name, column in lists.items()}


def write_scene(building: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Scene documents back from the list tables (a document per building holds that building)."""
    out = None
    for name, df in tables.items():
        fields = [c for c in df.columns if c != building]
        one = df.groupBy(building).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = one if out is None else out.join(one, building, "full_outer")
    return out.select(building, F.to_json(F.struct(F.lit("2.0").alias("schema_version"), *tables)).alias("value"))


def write_evaluation(spark_tables: dict[str, DataFrame], path: str) -> None:
    """The four evaluation documents as JSON lines, partitioned by building."""
    for name, df in spark_tables.items():
        df.write.mode("overwrite").partitionBy("building_id").json(f"{path}/{name}")


# -- model answers ----------------------------------------------------------------

FENCE = r"(?m)^\s*```[a-zA-Z]*\s*$|```(?:json)?"


def close_brackets(text: str | None) -> str | None:
    """Cut a truncated object after its last complete part and close what is still open."""
    if not text or "{" not in text:
        return None
    body, stack, safe = text[text.index("{"):], [], None
    for token in re.finditer(r'"(?:\\.|[^"\\])*(?:"|$)|[{}\[\]]', body, re.S):
        mark = token.group()
        if mark in "{[":
            stack.append("}" if mark == "{" else "]")
        elif mark in "}]":
            if stack:
                stack.pop()
            safe = (token.end(), list(stack))
    end, open_ones = safe or (len(body), stack)
    return body[:end].rstrip().rstrip(",") + "".join(reversed(open_ones))


def extract_answers(answers: DataFrame, text: str = "raw") -> DataFrame:
    """Adds ``payload`` (valid JSON object text or null) and ``how`` it was found.

    Whole text, text without code fences, outermost braces - all as SQL expressions, each tried only where those before
    it fail; the Arrow repair function gets the text of rows that are still broken. Answers are gone through once.
    """
    good = lambda c: F.startswith(c, F.lit("{")) & F.try_parse_json(c).isNotNull()
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    tried = lambda c, how: let(c, lambda b: F.when(good(b), F.struct(b.alias("payload"), F.lit(how).alias("how"))))
    trimmed = strip(F.coalesce(text, F.lit("")))
    found = let(trimmed, lambda t: F.coalesce(
        tried(t, "whole"), tried(strip(F.regexp_replace(t, FENCE, "")), "fenced"), tried(F.regexp_extract(t, r"(?s)(\{.*\})", 1), "outermost")))

    @F.pandas_udf("string")
    def repair(values: pd.Series) -> pd.Series:
        return values.map(close_brackets)

    # Not deterministic to Spark, so that a filter on the payload does not repair a text twice.
    repair = repair.asNondeterministic()
    staged = answers.withColumn("_found", F.explode(F.array(found))).withColumn("_closed", repair(F.when(F.col("_found").isNull(), trimmed).otherwise("")))
    repaired = let(F.col("_closed"), lambda c: F.when(good(c), F.struct(c.alias("payload"), F.lit("repaired").alias("how"))))
    staged = staged.withColumn("_found", F.coalesce("_found", repaired))
    return staged.withColumns({"payload": F.col("_found.payload"), "how": F.coalesce("_found.how", F.lit("malformed"))}).drop("_found", "_closed")


def observed_lists(answers: DataFrame, name: str) -> DataFrame:
    """One row per entry of a list in the payload: image_id, position, item (variant)."""
    listed = F.try_variant_get(F.parse_json("payload"), f"$.{name}", "array<variant>")
    return answers.filter("payload IS NOT NULL").select("image_id", F.posexplode(listed).alias("position", "item"))


def _field(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("item", f"$.{path}", kind)


def _box() -> Column:
    part = lambda i, name: F.coalesce(_field(f"bbox[{i}]", "double"), _field(f"bbox.{name}", "double"))
    return F.struct(*[part(i, n).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def _confidence(default: float = 0.0) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), coerce.tolerant_number(_field("confidence"), default)))


def flatten_objects(answers: DataFrame) -> DataFrame:
    """Object rows with ``reason``: empty when kept, else why the entry is rejected."""
    category = F.coalesce(tx.normalise_term(F.coalesce(F.nullif(_field("category"), F.lit("")), _field("label")), "category"), tx.normalise_term(_field("label"), "category"))
    # What an explode returns stays where it is: no filter on the reason looks the names up again.
    rows = observed_lists(answers, "objects").select("image_id", "position", "item", F.inline(F.array(F.struct(
        category.alias("category"), _confidence().alias("confidence"), _box().alias("box"), F.coalesce(_field("label"), F.lit("")).alias("label")))))
    area = F.greatest(F.lit(0.0), F.col("box.x1") - F.col("box.x0")) * F.greatest(F.lit(0.0), F.col("box.y1") - F.col("box.y0"))
    reason = (F.when(F.col("item").isNull(), "object_not_object").when(F.col("category").isNull(), "unrecognised_category")
              .when(F.col("confidence") < coerce.UNCERTAIN, "below_confidence_floor").when(F.coalesce(area, F.lit(0.0)) <= 1e-6, "missing_or_empty_bbox").otherwise(""))
    prior = F.broadcast(dim(answers.sparkSession, "dim_objects").select("category", "obj_group", F.col("support").alias("_support")))
    stated = F.lower(F.trim(F.coalesce(_field("support"), F.lit(""))))
    return rows.join(prior, "category", "left").select(
        "image_id", "position", coerce.slug(_field("id"), "object").alias("local_id"), "category", "label", "obj_group", "box.*", coerce.size_bucket(_field("size_bucket")).alias("size_bucket"),
        F.when(stated.isin("floor", "wall", "ceiling", "on_object"), stated).otherwise(F.coalesce("_support", F.lit("floor"))).alias("support"),
        tx.normalise_term(_field("material"), "material").alias("material"), coerce.normalise_hex(_field("color_hex")).alias("color_hex"), "confidence",
        (F.col("confidence") < coerce.ACCEPT).alias("uncertain"), reason.alias("reason"))


def flatten_lights(answers: DataFrame) -> DataFrame:
    rows = observed_lists(answers, "lights").withColumns({"kind": tx.normalise_term(_field("kind"), "light"), "confidence": _confidence()})
    reason = F.when(F.col("kind").isNull(), "unrecognised_light_kind").when(F.col("confidence") < coerce.UNCERTAIN, "light_below_confidence_floor").otherwise("")
    prior = F.broadcast(dim(answers.sparkSession, "dim_lights").select("kind", F.col("kelvin").alias("_k"), F.col("mounting").alias("_m")))
    word = F.lower(F.trim(F.coalesce(_field("color_temperature"), F.lit(""))))
    kelvin = F.when(word == "warm", 2700.0).when(word == "neutral", 3500.0).when(word == "cool", 5000.0).when(word == "daylight", 6000.0).otherwise(F.col("_k"))
    count = F.greatest(F.lit(1), F.least(F.lit(24), coerce.tolerant_number(_field("count"), 1.0).cast("int")))
    return rows.join(prior, "kind", "left").select("image_id", "position", "kind", F.coalesce(F.nullif(F.lower(F.trim(_field("mounting"))), F.lit("")), "_m").alias("mounting"), count.alias("fixtures"), kelvin.alias("kelvin"), "confidence", reason.alias("reason"))


def flatten_openings(answers: DataFrame, name: str = "openings") -> DataFrame:
    """Openings, or structural elements with ``name='architecture'``."""
    kinds = ["door", "window", "archway", "niche"] if name == "openings" else ["column", "beam", "staircase", "partition", "false_ceiling", "niche"]
    short = "opening" if name == "openings" else "arch"
    rows = observed_lists(answers, name).withColumns({"kind": F.replace(F.lower(F.trim(F.coalesce(_field("kind"), F.lit("")))), F.lit(" "), F.lit("_")), "confidence": _confidence()})
    reason = F.when(~F.col("kind").isin(*kinds), f"unrecognised_{short}_kind").when(F.col("confidence") < coerce.UNCERTAIN, f"{short}_below_confidence_floor").otherwise("")
    return rows.select("image_id", "position", "kind", F.lower(F.trim(F.coalesce(_field("on_wall"), F.lit("unknown")))).alias("on_wall"), coerce.size_bucket(_field("size_bucket")).alias("size_bucket"), "confidence", reason.alias("reason"))


def flatten_labels(answers: DataFrame) -> DataFrame:
    rows = observed_lists(answers, "labels").withColumns({"text": F.trim(F.coalesce(_field("text"), F.lit(""))), "box": _box(), "confidence": _confidence(0.8)})
    reason = F.when(F.col("text") == "", "label_without_text").when(F.col("box.x0").isNull(), "label_without_bbox").otherwise("")
    return rows.select("image_id", "position", "text", tx.normalise_label(F.col("text")).alias("normalised"), "box.*", "confidence", reason.alias("reason"))


def rejections(*flattened: DataFrame) -> DataFrame:
    """Counts per image and reason over all lists."""
    out = None
    for df in flattened:
        one = df.filter("reason <> ''").select("image_id", "reason")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("image_id", "reason").agg(F.count("*").alias("n"))


# -- pictures ---------------------------------------------------------------------

PIXELS = "image_id string, prow long, pcol long, r double, g double, b double"


def list_images(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Pictures of the five picture extensions with their folder; with ``limit`` the first by name of each folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,webp,bmp}").option("recursiveFileLookup", "true").load(path)
    named = files.select("path", "length").withColumn("project", F.regexp_replace("path", "/[^/]*$", ""))
    return named if limit is None else top_within(named, ["project"], [F.asc("path")], limit)


def unreadable_images(images: DataFrame) -> DataFrame:
    """``images``: image_id, content -> image_id and reason of the pictures that ``read_pixels`` gives no rows for."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bad = [(i, "no bytes" if c is None or not len(c) else "not decodable here") for i, c in zip(pdf["image_id"], pdf["content"], strict=True) if c is None or decode(c) is None]
            yield pd.DataFrame(bad, columns=["image_id", "reason"])

    return images.select(F.col("image_id").cast("string"), "content").mapInPandas(check, "image_id string, reason string")


def read_pixels(images: DataFrame) -> DataFrame:
    """``images``: image_id, content (bytes) -> long pixel table with channels 0..1. Unreadable pictures give no rows; ``unreadable_images`` lists them."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for image_id, content in zip(pdf["image_id"], pdf["content"]):
                grid = decode(content)
                if grid is None:
                    continue
                h, w = grid.shape[:2]
                rows, cols = np.divmod(np.arange(h * w), w)
                flat = grid.reshape(-1, 3) / 255.0
                yield pd.DataFrame({"image_id": image_id, "prow": rows, "pcol": cols, "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]})

    return images.select(F.col("image_id").cast("string"), "content").mapInPandas(explode, PIXELS)


def resize(pixels: DataFrame, width: int = 256, nearest: bool = False) -> DataFrame:
    """Down to ``width`` columns: block means, or the pixel at the block centre for id and depth passes."""
    size = pixels.groupBy("image_id").agg((F.max("pcol") + 1).alias("_w"))
    factor = F.least(F.lit(1.0), F.lit(float(width)) / F.col("_w"))
    placed = pixels.join(size, "image_id").withColumns({"_r": F.floor((F.col("prow") + 0.5) * factor), "_c": F.floor((F.col("pcol") + 0.5) * factor)})
    if nearest:
        off = F.abs((F.col("prow") + 0.5) * factor - F.col("_r") - 0.5) + F.abs((F.col("pcol") + 0.5) * factor - F.col("_c") - 0.5)
        picked = placed.groupBy("image_id", "_r", "_c").agg(F.min(F.struct(F.round(off, 9).alias("o"), "prow", "pcol", "r", "g", "b")).alias("p"))
        return picked.select("image_id", F.col("_r").alias("prow"), F.col("_c").alias("pcol"), "p.r", "p.g", "p.b")
    return placed.groupBy("image_id", F.col("_r").alias("prow"), F.col("_c").alias("pcol")).agg(*[F.avg(c).alias(c) for c in "rgb"])
