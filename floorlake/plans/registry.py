"""Registry of runnable queries: a Spark builder and, where SQL can say it, the oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import oracle_text

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, *covers: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    def register(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = build
        COVERS[name] = covers
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


def oracle_sql() -> dict[str, str]:
    return {name: oracle_text(body) for name, body in ORACLES.items()}
