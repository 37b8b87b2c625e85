"""Fixed dimension tables. Each is a list of rows rendered as an inline ``VALUES`` relation.

Spark plans an inline relation as a LocalRelation with an exact size, so every join against one
is a broadcast join of a few kilobytes that never grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (columns, rows). Filled by the modules imported at the bottom.
TABLES: dict[str, tuple[list[str], list[tuple]]] = {}


def define(name: str, columns: str, rows: list[tuple]) -> None:
    TABLES[name] = (columns.split(), rows)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return f"CAST({value} AS BIGINT)"
    if isinstance(value, float):
        return f"{value!r}e0" if "e" not in repr(value) else repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(name: str) -> str:
    """``SELECT * FROM (VALUES ...)``, the same text for every SQL engine."""
    columns, rows = TABLES[name]
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS {name}_v({', '.join(columns)})"


def dim(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(values_sql(name))


from . import assets, catalog, furnishing, images, patterns, planning, rooms, scoring  # noqa: E402,F401
