"""Label, layer and block naming rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import catalog, patterns
from .binding import let

SQ_FT = 0.09290304
# Formatting codes, annotation and measurement patterns.
FORMAT_CODES = r"(?i)\\[A-Za-z][^;\\]*;|\\[PXpx~]|[{}]|%%[udcpo]"
PUNCTUATION = r"[._/\\|,;:*#()\[\]{}\"']+"
DASHES = r"[-–—]+"
AREA = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(SQ\.?\s?M(?:TR?)?\.?|M2|M\^2|SQ\.?\s?FT?\.?|SFT|FT2)\b"
LENGTH = r"[0-9]+(?:\.[0-9]+)?(?:\s*'\s*(?:[-\s]*[0-9]+(?:\.[0-9]+)?\s*\")?)?"
PAIR = rf"({LENGTH})\s*[xX×]\s*({LENGTH})"
IMPERIAL = r"([0-9]+)\s*'\s*(?:[-\s]*([0-9]+(?:\.[0-9]+)?)\s*\")?"
AIA_NAME = r"^([A-Z])([A-Z0-9])?[-_]([A-Z]{4})(?:[-_]([A-Z]{4}))?(?:[-_]([A-Z]{4}))?(?:[-_]([A-Z0-9]{1,4}))?$"
ISO_NAME = r"^[A-Z]{1,2}([0-9]{2})[0-9]{0,2}"
ANONYMOUS_BLOCK = r"(?i)^(?:\*[A-Z][0-9]*|A\$[A-Z][0-9A-F]{4,})$"
BLOCK_PREFIX = r"(?i)^(?:_+|ACAD_|AEC_|ARCH_|BLK_|BLOCK_|DYN_|LIB_|STD_|M_|IMP_)+"
MEASURE_TAIL = r"\s+\d+(?:\s+\d+)?\s+(?:SQ\s+(?:M|FT)|SQM|SQFT|SFT|M2|MT|MM)\s*$"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_text(raw: Column) -> Column:
    return squeeze(F.regexp_replace(F.coalesce(raw, F.lit("")), FORMAT_CODES, " "))


def normalise_label(raw: Column) -> Column:
    text = F.regexp_replace(F.upper(clean_text(raw)), PUNCTUATION, " ")
    return squeeze(F.regexp_replace(text, DASHES, " "))


def number_or_null(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("double")


def parse_area(raw: Column) -> Column:
    """struct(m2, unit) of a floor-area annotation, null without one."""
    text = clean_text(raw)
    value = number_or_null(F.regexp_extract(text, AREA, 1))
    unit = F.regexp_replace(F.upper(F.regexp_extract(text, AREA, 2)), r"[ .]", "")
    feet = unit.isin("SQFT", "SFT", "SQF", "FT2")
    return F.when(value.isNotNull(), F.struct(
        F.when(feet, value * SQ_FT).otherwise(value).alias("m2"), F.when(feet, "sq_ft").otherwise("sq_m").alias("unit")))


def parse_length(token: Column) -> Column:
    """Metres from feet-inches or a bare number read as metres, millimetres or centimetres by its size."""
    feet = number_or_null(F.regexp_extract(token, IMPERIAL, 1))
    inches = F.coalesce(number_or_null(F.regexp_extract(token, IMPERIAL, 2)), F.lit(0.0))
    value = number_or_null(F.trim(token))
    metric = (F.when(value <= 0, None).when(value <= 30, value).when((value >= 300) & (value <= 30000), value / 1000)
              .when((value > 30) & (value < 300), value / 100))
    return F.when(feet.isNotNull(), feet * 0.3048 + inches * 0.0254).otherwise(metric)


def parse_dimension_pair(raw: Column) -> Column:
    text = clean_text(raw)
    a, b = parse_length(F.regexp_extract(text, PAIR, 1)), parse_length(F.regexp_extract(text, PAIR, 2))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b")))


def any_of(found: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in found)


def room_type_of(normalised: Column) -> Column:
    """First room type whose vocabulary occurs in the label, null for none."""
    return F.coalesce(*[F.when(normalised.rlike(any_of(ps)), F.lit(room)) for room, ps in patterns.ROOM_LABELS])


def parent_room(room_type: Column) -> Column:
    out = room_type
    for specific, parent in patterns.ROOM_PARENTS:
        out = F.when(room_type == specific, parent).otherwise(out)
    return out


def classify_texts(df: DataFrame, raw: str) -> DataFrame:
    """Adds role, room_type, confidence, area_m2, dim_a, dim_b and trailing index with the fixed precedence.

    Written as steps so every pattern is evaluated once per row and the generated code stays small.
    """
    text, label = F.col("_text"), F.col("_label")
    staged = df.withColumn("_text", clean_text(F.col(raw))).withColumn("_label", normalise_label(F.col(raw)))
    staged = staged.withColumn("_room", room_type_of(label)).withColumn("_area", parse_area(text)).withColumn("_pair", parse_dimension_pair(text))
    noise = (text == "") | label.rlike(patterns.TITLE_NOISE)
    staged = staged.withColumn("role", F.when(noise, "note").when(F.col("_room").isNotNull(), "room_label").when(F.col("_area").isNotNull(), "area")
                               .when(F.col("_pair").isNotNull(), "dimension").when(label.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), "number").otherwise("note"))
    role, is_room = F.col("role"), F.col("role") == "room_label"
    confidence = F.when(is_room, 0.94).when(role == "area", 0.90).when(role == "dimension", 0.85).when(role == "number", 0.50).otherwise(0.0)
    sized = is_room | (role == "dimension")
    return staged.withColumns({
        "room_type": F.when(is_room, F.col("_room")).otherwise(""), "confidence": confidence,
        "area_m2": F.when(is_room | (role == "area"), F.col("_area.m2")), "dim_a": F.when(sized, F.col("_pair.a")), "dim_b": F.when(sized, F.col("_pair.b")),
        "trailing": F.when(is_room, F.nullif(F.regexp_extract(label, r"\b([0-9]{1,2})\s*$", 1), F.lit("")).cast("int")),
    }).drop("_text", "_label", "_room", "_area", "_pair")


def _lookup(key: Column, pairs: list[tuple]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in pairs for v in pair]), key)


def classify_layers(names: DataFrame, column: str) -> DataFrame:
    """Adds role, confidence and convention of a layer name: AIA code, ISO element, keyword, unknown."""
    parts = {f"_{n}": F.regexp_extract("_upper", AIA_NAME, i) for n, i in (("discipline", 1), ("major", 3), ("minor", 4), ("minor2", 5))}
    staged = names.withColumn("_upper", F.upper(F.trim(F.coalesce(column, F.lit(""))))).withColumns(parts)
    minor = [(f"{a}-{b}", r) for a, b, r in patterns.AIA_MINOR]
    staged = staged.withColumns({
        "_aia": _lookup(F.col("_major"), patterns.AIA_MAJOR), "_iso": _lookup(F.regexp_extract("_upper", ISO_NAME, 1), patterns.ISO_ELEMENTS),
        "_spaced": F.regexp_replace("_upper", r"[-_./|]+", " "),
        "_fine": F.coalesce(_lookup(F.concat_ws("-", "_major", "_minor"), minor), _lookup(F.concat_ws("-", "_major", "_minor2"), minor))})
    # One pass over the ordered rules; the array is a constant and evaluation stops at the first hit.
    rules = F.array(*[F.when(F.col("_spaced").rlike(p), F.struct(F.lit(role).alias("role"), F.lit(c).alias("confidence"))) for p, role, c in patterns.LAYER_KEYWORDS])
    staged = staged.withColumn("_keyword", F.try_element_at(F.filter(rules, lambda r: r.isNotNull()), F.lit(1)))
    known = F.col("_discipline").isin(*[d for (d,) in patterns.AIA_DISCIPLINES])
    kind = (F.when(F.col("_upper").isin("", "0", "0.0"), "none").when(F.col("_aia").isNotNull(), "aia").when(F.col("_iso").isNotNull(), "iso13567")
            .when(F.col("_keyword").isNotNull(), "keyword").otherwise("none"))
    staged = staged.withColumn("convention", kind)
    is_ = lambda name: F.col("convention") == name
    return staged.withColumns({
        "role": F.when(is_("aia"), F.coalesce("_fine", "_aia")).when(is_("iso13567"), F.col("_iso")).when(is_("keyword"), F.col("_keyword.role")).otherwise("unknown"),
        "confidence": F.when(is_("aia"), F.when(known, 0.95).otherwise(0.80)).when(is_("iso13567"), 0.75).when(is_("keyword"), F.col("_keyword.confidence")).otherwise(0.0),
    }).drop("_upper", "_discipline", "_major", "_minor", "_minor2", "_aia", "_iso", "_spaced", "_fine", "_keyword")


def normalise_block_name(name: Column) -> Column:
    upper = F.upper(F.trim(F.coalesce(name, F.lit(""))))
    bare = F.regexp_replace(F.regexp_replace(upper, BLOCK_PREFIX, ""), r"[-_./|+]+", " ")
    return F.when(upper.rlike(ANONYMOUS_BLOCK), "").otherwise(squeeze(bare))


def _block_rule(normalised: Column) -> Column:
    return F.coalesce(*[
        F.when(normalised.rlike(any_of(ps)), F.struct(F.lit(c).alias("category"), F.lit(k).alias("kind"), F.lit(cc).alias("catalog_category")))
        for c, k, cc, ps in patterns.BLOCK_RULES])


def attribute(attributes: Column, tag: str) -> Column:
    """Value of a tag, whatever its case; empty when absent."""
    hits = F.map_values(F.map_filter(attributes, lambda k, _: F.upper(k) == tag.upper()))
    return F.coalesce(F.trim(F.try_element_at(hits, F.lit(1))), F.lit(""))


def classify_blocks(blocks: DataFrame, name: str = "name", attributes: str = "attributes") -> DataFrame:
    """Adds category, kind, catalog_category and confidence; an attribute beats the name.

    The four attribute values and the name go through one copy of the rule chain.
    """
    stated = [normalise_block_name(attribute(F.col(attributes), tag)) for tag in ("TYPE", "CATEGORY", "FAMILY", "SUBTYPE")]
    staged = blocks.withColumn("_texts", F.array(*stated, normalise_block_name(F.col(name))))
    staged = staged.withColumn("_hits", F.transform("_texts", lambda t: F.when(t != "", _block_rule(t))))
    staged = staged.withColumn("_stated", F.coalesce(*[F.col("_hits")[i] for i in range(4)])).withColumn("_hit", F.coalesce("_stated", F.col("_hits")[4]))
    empty = F.col("_texts")[4] == ""
    confidence = (F.when(empty | F.col("_hit").isNull(), 0.0).when(F.col("_stated").isNotNull(), 0.90)
                  .when(F.col("_hit.kind").isin("plumbing_fixture", "kitchen_fixture"), 0.92).otherwise(0.85))
    field = lambda f, default: F.when(empty, default).otherwise(F.coalesce(F.col(f"_hit.{f}"), F.lit(default)))
    return staged.withColumns({"category": field("category", ""), "kind": field("kind", "unknown"), "catalog_category": field("catalog_category", ""),
                               "confidence": confidence}).drop("_texts", "_hits", "_stated", "_hit")


def room_name_from_attributes(attributes: Column) -> Column:
    values = [attribute(attributes, tag) for tag in patterns.ROOM_NAME_TAGS]
    return F.coalesce(*[F.when((v != "") & ~v.rlike("^[0-9]+$"), v) for v in values], F.lit(""))


def area_from_attributes(attributes: Column) -> Column:
    values = [F.regexp_replace(attribute(attributes, tag), ",", "") for tag in patterns.AREA_TAGS]
    return F.coalesce(*[number_or_null(F.regexp_extract(v, r"([0-9]+(?:\.[0-9]+)?)", 1)) for v in values])


def classify_distinct(df: DataFrame, column: str, classify) -> DataFrame:
    """Classify the distinct values of ``column`` and join the verdict back.

    Names repeat heavily across drawings, so the rule chain runs once per name; ``distinct``
    combines map-side and AQE broadcasts the short list of names.
    """
    return df.join(classify(df.select(column).distinct(), column), column, "left")


# -- vocabulary ------------------------------------------------------------------

VOCABULARIES = {
    "category": ([r[0] for r in catalog.OBJECTS], catalog.CATEGORY_SYNONYMS, None),
    "material": ([r[0] for r in catalog.MATERIALS + catalog.SPECIES], catalog.MATERIAL_SYNONYMS, "unknown"),
    "style": ([r[0] for r in catalog.STYLES], catalog.STYLE_SYNONYMS, "unknown"),
    "light": ([r[0] for r in catalog.LIGHTS], catalog.LIGHT_SYNONYMS, None),
}


def vocabulary_entries(kind: str) -> list[tuple[int, int, int, str, str]]:
    """(tier, -length, declared order, term, canonical) of every way a term can be recognised."""
    keys, synonyms, _ = VOCABULARIES[kind]
    spoken = [(k.replace("_", " "), k) for k in keys]
    known = dict(synonyms)
    rows = [(1, 0, 0, t, k) for t, k in spoken] + [(2, 0, 0, t, c) for t, c in synonyms]
    rows += [(3, -len(t), i, t, known[t]) for i, (t, _) in enumerate(synonyms)]
    rows += [(4, -len(k), i, t, k) for i, (t, k) in enumerate(spoken) if not (kind == "style" and k == "unknown")]
    return rows


def normalise_term(raw: Column, kind: str) -> Column:
    """Canonical vocabulary term: exact, synonym, longest synonym inside, longest key inside, else the default.

    The terms looked for inside are in the order of their rank, so the first one found is the best.
    """
    _, synonyms, default = VOCABULARIES[kind]
    rows = vocabulary_entries(kind)
    inside: dict[str, str] = {}
    for *_, term, name in sorted(r for r in rows if r[0] > 2):
        inside.setdefault(term, name)

    def named(text: Column) -> Column:
        exact = F.coalesce(_lookup(text, [(r[3], r[4]) for r in rows if r[0] == 1]), _lookup(text, list(dict(synonyms).items())))
        best = F.try_element_at(F.filter(F.lit(list(inside)), lambda term: F.contains(text, term)), F.lit(1))
        return F.when(text == "", F.lit(default)).otherwise(F.coalesce(exact, _lookup(best, list(inside.items())), F.lit(default)))

    return let(squeeze(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), "_", " ")), named)


# -- similarity ------------------------------------------------------------------

MIN_SIMILARITY = 0.62
CONTAINMENT = 0.75


def bigrams(text: Column) -> Column:
    """Distinct character pairs, blanks ignored."""

    def pairs(tight: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.length(tight) - 1), lambda i: F.substr(tight, i, F.lit(2)))
        return F.when(F.length(tight) >= 2, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))

    return let(F.replace(text, F.lit(" "), F.lit("")), pairs)


def text_similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, CONTAINMENT where one has all words of the other, else the Dice share of bigrams from MIN_SIMILARITY on."""
    words = lambda t: F.array_distinct(F.split(t, " "))
    within = lambda w: (F.size(F.array_except(w["a"], w["b"])) == 0) | (F.size(F.array_except(w["b"], w["a"])) == 0)

    def dice(g: Column) -> Column:
        total = F.size(g["a"]) + F.size(g["b"])
        return F.when((F.size(g["a"]) > 0) & (F.size(g["b"]) > 0), 2.0 * F.size(F.array_intersect(g["a"], g["b"])) / total).otherwise(0.0)

    contained = let(F.struct(words(a).alias("a"), words(b).alias("b")), within)
    shared = let(F.struct(bigrams(a).alias("a"), bigrams(b).alias("b")), dice)
    return (F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).when(a == b, 1.0)
            .when(contained, CONTAINMENT).otherwise(let(shared, lambda d: F.when(d >= MIN_SIMILARITY, d).otherwise(0.0))))


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the words longer than two letters; 0.5 when a side has none."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"\s+"), lambda w: F.length(w) > 2))

    def share(w: Column) -> Column:
        union = F.size(F.array_union(w["a"], w["b"]))
        return F.when((F.size(w["a"]) == 0) | (F.size(w["b"]) == 0), 0.5).otherwise(F.size(F.array_intersect(w["a"], w["b"])) / union)

    return let(F.struct(words(a).alias("a"), words(b).alias("b")), share)


def strip_measurements(normalised: Column) -> Column:
    short = F.trim(F.regexp_replace(normalised, MEASURE_TAIL, ""))
    return F.when(short == "", normalised).otherwise(short)


def informative(key: Column) -> Column:
    return ~(key.isin(*patterns.UNINFORMATIVE) | (F.length(key) < 2) | key.rlike("|".join(patterns.BOILERPLATE)) | key.rlike("^[0-9 .,'\"-]+$"))
