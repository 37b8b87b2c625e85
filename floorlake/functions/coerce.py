"""Tolerant coercions of free-form values to typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims.catalog import SIZE_BUCKETS

DEFAULT_HEX = "#BFBFBF"
ACCEPT, UNCERTAIN = 0.65, 0.40


def tolerant_number(text: Column, default: float = 0.0) -> Column:
    """'1.2m' and '1,5' are numbers; null, text, infinities and booleans fall back to the default."""
    tight = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "m+$", ""), ",", "."))
    value = F.when(tight.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), tight).try_cast("double")
    return F.coalesce(F.when(F.abs(value) < float("inf"), value), F.lit(default))


def normalise_hex(text: Column, default: str = DEFAULT_HEX) -> Column:
    bare = F.upper(F.ltrim(F.trim(F.coalesce(text, F.lit(""))), F.lit("#")))
    long = F.regexp_replace(bare, "^(.)(.)(.)$", "$1$1$2$2$3$3")
    return F.when(long.rlike("^[0-9A-F]{6}$"), F.concat(F.lit("#"), long)).otherwise(default)


def slug(text: Column, default: str) -> Column:
    bare = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "_"))
    return F.coalesce(F.nullif(F.regexp_replace(bare, "^_+|_+$", ""), F.lit("")), F.lit(default))


def size_bucket(text: Column) -> Column:
    key = F.replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit(" "), F.lit("_"))
    return F.when(key.isin(*[b for b, _ in SIZE_BUCKETS]), key).otherwise("medium")


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= ACCEPT, "accept").when(confidence >= UNCERTAIN, "uncertain").otherwise("discard")
