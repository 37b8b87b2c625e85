"""Canonical content digests: the same rows give the same digest in any order and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGEST_LENGTH = 32
NULL = "~"


def framed(*fields: Column) -> Column:
    """Texts joined so that they can be told apart again: each after its length, a null as a sign of its own."""
    return F.concat(*[F.coalesce(F.concat(F.length(f).cast("string"), F.lit(":"), f), F.lit(NULL)) for f in fields])


def canonical(df: DataFrame, columns: list[str]) -> Column:
    """Fields framed as text in the given order; doubles as whole millionths."""
    types = dict(df.dtypes)

    def field(name: str) -> Column:
        col = F.col(name)
        if types[name] in ("double", "float"):
            # Not numbers, infinities and what is too large for a decimal keep their own text.
            return F.coalesce(F.round(col * 1000000).try_cast("decimal(38,0)").cast("string"), col.cast("string"))
        if types[name].startswith(("array", "map", "struct")):
            return F.to_json(col)
        return col.cast("string")

    return framed(*[field(c) for c in columns])


def digest(*parts: Column) -> Column:
    return F.substring(F.sha2(framed(*parts), 256), 1, DIGEST_LENGTH)


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    return F.substring(F.sha2(canonical(df, columns), 256), 1, DIGEST_LENGTH)


def multiset_digest(row: Column) -> Column:
    """Order-free aggregate of row digests.

    A sorted list would put a whole bucket into one row. Instead the two halves of every row digest
    are summed as exact decimals and hashed with the count, which combines map-side in constant space.
    """
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    return digest(F.count(row).cast("string"), F.coalesce(half(1).cast("string"), F.lit("0")), F.coalesce(half(16).cast("string"), F.lit("0")))
