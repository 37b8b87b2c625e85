"""Room classification: evidence rows, their fusion, the neighbour pass and plan-level checks.

Evidence is one long table: building_id, room_id, signal, tier, ordinal, label, score, weight,
authoritative, reason. Every rule table has a fixed size and is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import dim
from ..dims.rooms import ROOM_PRIORS, VISION_ALIASES
from ..session import cut_lineage
from .scale import top_within

KEYS = ["building_id", "room_id"]
TYPES = [row[0] for row in ROOM_PRIORS]
AUTHORITATIVE_BASE, AUTHORITATIVE_BAND, MAX_CONFIDENCE = 0.90, 0.09, 0.99
MIN_DECIDABLE, NEAR_TIE = 0.30, 0.08
METADATA, BLOCK, LAYER, TEXT, GEOMETRY, IMAGE = 1, 2, 3, 4, 5, 6


def _rows(df: DataFrame, signal, tier: int, label, score, weight=1.0, authoritative: bool = False, reason=None, ordinal=0) -> DataFrame:
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(*KEYS, col(signal).alias("signal"), F.lit(tier).alias("tier"), col(ordinal).cast("long").alias("ordinal"), col(label).alias("label"),
                     col(score).cast("double").alias("score"), col(weight).cast("double").alias("weight"), F.lit(authoritative).alias("authoritative"),
                     col(reason if reason is not None else signal).alias("reason"))


def canonical_room(room_type: Column) -> Column:
    return F.when(room_type == "master_bedroom", "bedroom").otherwise(room_type)


def _known(room_type: Column) -> Column:
    return room_type.isin(*TYPES)


def evidence_category(category: Column) -> Column:
    """Detected category to the one whose evidence it carries."""
    key = F.translate(F.lower(F.trim(category)), " -", "__")
    names = F.create_map(*[F.lit(v) for alias in dict(VISION_ALIASES).items() for v in alias])
    return F.coalesce(F.try_element_at(names, key), key)


def attribute_evidence(attributes: DataFrame) -> DataFrame:
    """``attributes``: keys, ordinal, text, room_type out of block attributes."""
    rows = attributes.withColumn("_t", canonical_room(F.col("room_type"))).filter(_known(F.col("_t")))
    return _rows(rows, "room_name_attribute", METADATA, F.col("_t"), 5.0, authoritative=True, ordinal=F.col("ordinal"), reason=F.concat(F.lit("block attribute names this room "), "text"))


def label_evidence(labels: DataFrame) -> DataFrame:
    """``labels``: keys, ordinal, text, room_type, confidence of the labels inside the room."""
    rows = labels.withColumn("_t", canonical_room(F.col("room_type"))).filter(_known(F.col("_t")))
    return _rows(rows, "room_label", TEXT, F.col("_t"), 4.5, F.greatest(F.lit(0.5), F.col("confidence")), True, F.concat(F.lit("text label "), "text"), F.col("ordinal"))


def block_evidence(blocks: DataFrame) -> DataFrame:
    """``blocks``: keys, category, kind, confidence. Repeats count with 1 + ln(n)/4."""
    spark = blocks.sparkSession
    grouped = blocks.withColumn("category", evidence_category(F.col("category"))).filter("category <> ''").groupBy(*KEYS, "category").agg(
        F.count("*").alias("n"), F.max("confidence").alias("best"), F.min("kind").alias("kind"))
    scored = grouped.join(F.broadcast(dim(spark, "dim_object_evidence").withColumnRenamed("score", "_s")), "category")
    weight = F.greatest(F.lit(0.4), F.col("best")) * (1 + 0.25 * F.log(F.col("n").cast("double")))
    signal = F.when(F.col("kind").isin("plumbing_fixture", "kitchen_fixture", "appliance"), "block_fixture").otherwise("block_furniture")
    return _rows(scored, signal, BLOCK, F.col("room_type"), F.col("_s"), weight, reason=F.concat(F.upper("category"), F.lit(" x"), F.col("n").cast("string"), F.lit(" block")))


def layer_evidence(layer_roles: DataFrame, blocks: DataFrame) -> DataFrame:
    """``layer_roles``: keys, role, n. A role whose kind already stands in the room as a block is skipped."""
    spark = layer_roles.sparkSession
    covered = blocks.select(*KEYS, F.col("kind").alias("role")).filter("role IN ('plumbing_fixture', 'casework', 'appliance', 'furniture')").distinct()
    open_roles = layer_roles.join(covered, [*KEYS, "role"], "left_anti")
    scored = open_roles.join(F.broadcast(dim(spark, "dim_layer_evidence").withColumnRenamed("score", "_s")), "role")
    return _rows(scored, "layer_role", LAYER, F.col("room_type"), F.col("_s"), F.least(F.lit(1.0), 0.5 + 0.1 * F.col("n")), reason=F.concat(F.col("n").cast("string"), F.lit(" entities on layer "), "role"))


def geometry_evidence(rooms: DataFrame) -> DataFrame:
    """Area, proportions and opening counts of every room against the fixed priors of all types.

    ``rooms``: keys, area, width, depth, doors, windows, openings_known.
    """
    priors = F.broadcast(dim(rooms.sparkSession, "dim_room_priors"))
    each = rooms.crossJoin(priors)
    area, lo, hi = F.col("area"), F.col("area_lo"), F.col("area_hi")
    offset = F.abs(area - F.col("area_typical")) / F.greatest(hi - lo, F.lit(1e-6))
    excess = F.when(area < lo, (lo - area) / F.greatest(lo * 0.4, F.lit(1e-6))).otherwise((area - hi) / F.greatest(hi * 0.4, F.lit(1e-6)))
    area_score = F.when((area >= lo) & (area <= hi), 1.2 * F.exp(-2.0 * offset * offset) + 0.3).otherwise(F.greatest(F.lit(-2.5), -1.2 * excess))
    short = F.least("width", "depth")
    aspect = F.when(short > 1e-6, F.greatest("width", "depth") / short).otherwise(1.0)
    aspect_score = F.when(aspect <= F.col("aspect_max"), 0.25).otherwise(F.greatest(F.lit(-2.0), -(aspect - F.col("aspect_max")) / F.col("aspect_max")))
    window_score = F.when(F.col("windows") == 0, 2.4 * (F.col("windowless") - 0.5)).otherwise(1.2 * (0.5 - F.col("windowless")))
    kind = F.col("room_type")
    door_score = (F.when(F.col("doors") <= 0, 0.0).when(F.col("doors") >= 3, F.when(kind.isin("hallway", "staircase"), 1.2).otherwise(-0.9))
                  .when((F.col("doors") == 1) & kind.isin("bathroom", "bedroom", "store", "utility"), 0.5).otherwise(0.0))
    known = each.filter("openings_known")
    return reduce(DataFrame.unionByName, [
        _rows(each.filter("area > 0"), "area", GEOMETRY, kind, area_score, reason=F.concat(F.round(area, 1).cast("string"), F.lit(" m2 floor area"))),
        _rows(each.filter("width > 0 AND depth > 0"), "aspect", GEOMETRY, kind, aspect_score, reason=F.concat(F.round(aspect, 1).cast("string"), F.lit(":1 proportions"))),
        _rows(known, "window_count", GEOMETRY, kind, window_score, reason=F.concat(F.col("windows").cast("string"), F.lit(" window(s)"))),
        _rows(known.filter("doors > 0"), "door_count", GEOMETRY, kind, door_score, reason=F.concat(F.col("doors").cast("string"), F.lit(" door(s)")))])


def vision_evidence(readings: DataFrame, objects: DataFrame) -> DataFrame:
    """``readings``: keys, room_type, confidence of the imagery; ``objects``: keys, category detected there."""
    spark = readings.sparkSession
    seen = readings.withColumn("_t", canonical_room(evidence_category(F.col("room_type")))).filter(_known(F.col("_t")) & (F.col("confidence") > 0))
    grouped = objects.withColumn("category", evidence_category(F.col("category"))).groupBy(*KEYS, "category").agg(F.count("*").alias("n"))
    scored = grouped.join(F.broadcast(dim(spark, "dim_object_evidence").withColumnRenamed("score", "_s")), "category")
    return _rows(seen, "vision", IMAGE, F.col("_t"), 3.0, F.greatest(F.lit(0.3), F.col("confidence")), reason=F.concat(F.lit("imagery reads as "), "_t")).unionByName(
        _rows(scored, "vision_object", IMAGE, F.col("room_type"), F.col("_s"), 0.5 * (1 + 0.2 * F.log(F.col("n").cast("double"))), reason=F.concat("category", F.lit(" detected in the imagery"))))


def topology_evidence(rooms: DataFrame, adjacency: DataFrame, typed: DataFrame) -> DataFrame:
    """Neighbour types and depth. ``typed``: keys, label of the previous pass; ``rooms``: keys, depth_normalised."""
    spark = rooms.sparkSession
    near = typed.filter("label <> 'unknown'").select("building_id", F.col("room_id").alias("neighbour_id"), F.col("label").alias("neighbour_type"))
    pairs = adjacency.join(near, ["building_id", "neighbour_id"]).groupBy(*KEYS, "neighbour_type").agg(F.count("*").alias("n"))
    weights = F.broadcast(dim(spark, "dim_room_adjacency").withColumnRenamed("weight", "_w"))
    beside = pairs.join(weights, "neighbour_type").groupBy(*KEYS, "room_type").agg(F.least(F.lit(2.0), F.sum(0.7 * F.col("_w") * F.col("n"))).alias("_s"))
    deep = rooms.filter("depth_normalised >= 0").crossJoin(F.broadcast(dim(spark, "dim_room_priors").select("room_type", "privacy")))
    privacy = 0.6 * (1 - 2 * F.abs(F.col("privacy") - F.col("depth_normalised")))
    return _rows(beside, "adjacency", GEOMETRY, F.col("room_type"), F.col("_s")).unionByName(_rows(deep, "privacy_depth", GEOMETRY, F.col("room_type"), privacy))


def _softmax(values: Column) -> Column:
    peak = F.array_max(values)
    weights = F.transform(values, lambda v: F.exp(v - peak))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))


def _at(array: Column, position: Column) -> Column:
    return F.try_element_at(array, position)


def _first_max(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)).cast("int")


def _second(values: Column, order: Column) -> Column:
    """struct(negated value, order, position) of the second largest, earlier order first on ties."""
    ranked = F.array_sort(F.zip_with(values, order, lambda v, o: F.struct((-v).alias("v"), o.alias("o"))))
    return _at(ranked, F.lit(2))


def fuse(evidence: DataFrame) -> DataFrame:
    """One label per room with confidence, decided_by, runner-up and conflict counts.

    All sums of a room are taken in one aggregate (a column per type, combined map-side); softmax,
    authority and margins are then arithmetic on arrays of the fixed fourteen types.
    """
    value = F.col("score") * F.col("weight")
    sums = lambda name, cond: [F.coalesce(F.sum(F.when((F.col("label") == t) & cond, value)), F.lit(0.0)).alias(f"{name}_{t}") for t in TYPES]
    claim = F.struct("tier", (-F.col("score")).alias("strength"), F.col("ordinal"), F.col("signal"), F.col("label"))
    grouped = evidence.groupBy(*KEYS).agg(
        *sums("all", F.lit(True)), *sums("ind", ~F.col("authoritative")),
        *[F.count_if(F.col("authoritative") & (F.col("label") == t)).alias(f"n_{t}") for t in TYPES],
        F.min(F.when(F.col("authoritative"), claim)).alias("primary"))
    pack = lambda name: F.array(*[F.col(f"{name}_{t}") for t in TYPES])
    types = F.array(*[F.lit(t) for t in TYPES])
    base = grouped.select(*KEYS, "primary", types.alias("types"), pack("all").alias("totals"), pack("ind").alias("independent"), pack("n").alias("claims"))
    ordinals = F.sequence(F.lit(0), F.lit(len(TYPES) - 1))

    steps = base.withColumns({"posterior": _softmax(F.col("totals")), "_ip": _softmax(F.col("independent")), "_stated": F.array_position("types", F.col("primary.label")).cast("int")})
    steps = steps.withColumns({"_best": _first_max(F.col("posterior")), "_challenger": _first_max(F.col("_ip")), "_others": F.filter("independent", lambda v, i: i != F.col("_stated") - 1)})
    margin = (_at(F.col("independent"), F.col("_stated")) - F.array_max("_others")) / 3.0
    split = F.aggregate("claims", F.lit(0).cast("long"), lambda a, n: a + n) - _at(F.col("claims"), F.col("_stated"))
    contested = (F.exists("independent", lambda v: F.abs(v) > 1e-9)) & (F.col("_challenger") != F.col("_stated")) & (F.array_max("_ip") > 0.5)
    stated = F.col("_stated").isNotNull()
    steps = steps.withColumns({"_split": F.when(stated, split).otherwise(0), "_contested": F.coalesce(stated & contested, F.lit(False)), "_agreement": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), margin))})
    sure = AUTHORITATIVE_BASE + AUTHORITATIVE_BAND * F.col("_agreement") - F.when(F.col("_split") > 0, 0.15).otherwise(0.0) - F.when(F.col("_contested"), 0.10).otherwise(0.0)
    free = F.least(F.array_max("posterior"), F.lit(MAX_CONFIDENCE))
    decidable = free >= MIN_DECIDABLE
    steps = steps.withColumn("_sure", F.greatest(F.lit(0.0), F.least(F.lit(MAX_CONFIDENCE), sure)))
    rest = F.aggregate(F.filter("posterior", lambda p, i: i != F.col("_stated") - 1), F.lit(0.0), lambda a, p: a + p)
    pinned = F.transform("posterior", lambda p, i: F.when(i == F.col("_stated") - 1, F.col("_sure")).otherwise(p / rest * (1 - F.col("_sure"))))
    steps = steps.withColumn("_final", F.when(stated, pinned).otherwise(F.col("posterior")))
    order = F.transform(ordinals, lambda o: F.when(o == F.col("_stated") - 1, -1).otherwise(o))
    steps = steps.withColumn("_runner", _second(F.col("_final"), F.when(stated, order).otherwise(ordinals)))
    runner = -F.col("_runner.v")
    label = F.when(stated, F.col("primary.label")).when(decidable, _at(F.col("types"), F.col("_best"))).otherwise("unknown")
    confidence = F.when(stated, F.col("_sure")).when(decidable, free).otherwise(0.0)
    tie = ~stated & decidable & (runner > 0) & (free - runner < NEAR_TIE)
    return steps.select(
        *KEYS, label.alias("label"), F.round(confidence, 4).alias("confidence"), F.coalesce("primary.signal", F.lit("")).alias("decided_by"),
        _at(F.col("types"), F.when(F.col("_runner.o") == -1, F.col("_stated")).otherwise(F.col("_runner.o") + 1)).alias("runner_up"), F.round(runner, 4).alias("runner_up_confidence"),
        F.col("_split").alias("authority_conflicts"), F.col("_contested").alias("contested"), F.coalesce(tie, F.lit(False)).alias("near_tie"))


def explain(evidence: DataFrame, results: DataFrame, limit: int | None = None) -> DataFrame:
    """The distinct reasons, with ``limit`` the strongest, for or against each room's label.

    ``results`` come of the same evidence, which is read twice: hand it over written (``cut_lineage``).
    """
    mine = evidence.join(results.select(*KEYS, "label"), [*KEYS, "label"]).withColumn("contribution", F.col("score") * F.col("weight")).filter(F.abs("contribution") >= 0.05)
    text = F.concat(F.when(F.col("contribution") > 0, "").otherwise("against: "), "reason")
    distinct = mine.groupBy(*KEYS, text.alias("reason")).agg(F.max(F.abs("contribution")).alias("strength"))
    return distinct if limit is None else top_within(distinct, KEYS, [F.round("strength", 9).desc(), F.asc("reason")], limit)


def classify(evidence: DataFrame, rooms: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Two passes: evidence alone, then with the neighbours' types and the depth in the plan."""
    evidence = cut_lineage(evidence)  # read by both
    first = fuse(evidence)
    return fuse(evidence.unionByName(topology_evidence(rooms, adjacency, first)))


def uniqueness_conflicts(results: DataFrame) -> DataFrame:
    """Rooms that repeat a type a plan usually has once; the most confident one keeps it.

    The winner per (building, type) is a grouped minimum, so no window holds a whole building.
    """
    single = dim(results.sparkSession, "dim_room_priors").filter("NOT repeatable").select(F.col("room_type").alias("label"))
    rows = results.join(F.broadcast(single), "label", "left_semi")
    winners = rows.groupBy("building_id", "label").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "room_id")).alias("w"))
    return rows.join(winners, ["building_id", "label"]).filter(F.col("room_id") != F.col("w.room_id")).select(
        "building_id", "room_id", F.col("label").alias("claimed"), F.col("w.room_id").alias("winner_id"), F.lit(0.4).alias("severity"))


def area_conflicts(rooms: DataFrame, ratio: float = 1.5) -> DataFrame:
    """``rooms``: keys, area, declared_area. Stated against measured floor area."""
    factor = F.greatest("area", "declared_area") / F.least("area", "declared_area")
    return rooms.filter("area > 0 AND declared_area > 0").withColumn("ratio", factor).filter(F.col("ratio") > ratio).select(
        *KEYS, "ratio", F.least(F.lit(0.95), 0.3 + 0.1 * F.col("ratio")).alias("severity"), (F.col("declared_area") > F.col("area")).alias("lost"))


def infer_depths(rooms: DataFrame, adjacency: DataFrame, min_rooms: int = 4, max_hops: int = 500) -> DataFrame:
    """Hops from the most entrance-like room over the deepest room of the building; -1 where unreachable.

    All buildings advance together, one join a hop, and only the rooms reached last are joined. Rooms and their
    neighbours are written first, or every hop would find them anew.
    """
    rooms, adjacency = cut_lineage(rooms.select(*KEYS, "doors")), cut_lineage(adjacency)
    degree = adjacency.groupBy(*KEYS).agg(F.count("*").alias("_degree"))
    ranked = rooms.join(degree, KEYS, "left").na.fill(0, ["_degree"])
    starts = ranked.groupBy("building_id").agg(
        F.min(F.struct((-F.col("doors")).alias("d"), (-F.col("_degree")).alias("n"), "room_id")).alias("s"), F.count("*").alias("_rooms")).filter(F.col("_rooms") >= min_rooms)
    reached = cut_lineage(starts.select("building_id", F.col("s.room_id").alias("room_id"), F.lit(0).alias("hops")))
    frontier = reached
    for hop in range(1, max_hops + 1):
        found = frontier.join(adjacency, KEYS).select("building_id", F.col("neighbour_id").alias("room_id")).distinct().join(reached, KEYS, "left_anti")
        frontier = cut_lineage(found.withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        reached = cut_lineage(reached.unionByName(frontier))
    else:
        raise RuntimeError("depth search did not settle; raise max_hops")
    furthest = reached.groupBy("building_id").agg(F.max("hops").alias("_far")).filter("_far > 0")
    depth = reached.join(furthest, "building_id").select(*KEYS, (F.col("hops") / F.col("_far")).alias("depth_normalised"))
    return rooms.select(*KEYS).join(depth, KEYS, "left").na.fill(-1.0, ["depth_normalised"])


def classification_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("building_id").agg(
        F.count("*").alias("rooms"), F.count_if(F.col("label") != "unknown").alias("identified"), F.count_if(F.col("label") == "unknown").alias("unidentified"),
        F.count_if(F.col("confidence") >= 0.65).alias("confident"), F.avg("confidence").alias("mean_confidence"),
        F.sum(F.col("authority_conflicts") + F.col("contested").cast("int") + F.col("near_tie").cast("int")).alias("conflicts"))


def specific_types(results: DataFrame, labels: DataFrame) -> DataFrame:
    """The more specific type a label states for a room of its parent type (first label wins)."""
    finer = labels.withColumn("_parent", canonical_room(F.col("room_type"))).filter("room_type <> _parent")
    first = finer.groupBy(*KEYS, F.col("_parent").alias("label")).agg(F.min(F.struct("ordinal", "room_type")).alias("f"))
    return results.join(first, [*KEYS, "label"], "left").withColumn("specific_type", F.coalesce("f.room_type", F.lit(""))).drop("f")


def contents_type(objects: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Room type from the distinct marker categories present; ties go to the alphabetically first type."""
    spark = objects.sparkSession
    present = objects.select(*keys, "category").distinct()
    hits = present.join(F.broadcast(dim(spark, "dim_room_markers")), "category").groupBy(*keys, "room_type").agg(F.count("*").alias("n"))
    best = hits.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "room_type")).alias("b"), F.sum("n").alias("_total"))
    scored = best.select(*keys, F.col("b.room_type").alias("room_type"), F.round(-F.col("b.n") / F.col("_total"), 3).alias("confidence"))
    return present.select(*keys).distinct().join(scored, keys, "left").na.fill({"room_type": "unknown", "confidence": 0.0})


def reconcile_type(declared: Column, declared_confidence: Column, inferred: Column, inferred_confidence: Column) -> tuple[Column, Column]:
    """Declared room type against the one its contents suggest: agreement adds 0.2, else the contents win."""
    kind = F.when(inferred == "unknown", declared).otherwise(inferred)
    confidence = (F.when(declared == "unknown", inferred_confidence).when(inferred == "unknown", declared_confidence)
                  .when(declared == inferred, F.least(F.lit(0.99), F.greatest(inferred_confidence, F.lit(0.6)) + 0.2)).otherwise(inferred_confidence * 0.8))
    return kind, confidence
