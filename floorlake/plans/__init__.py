"""Runnable queries over the given tables."""

from . import drawings, edits, evaluation, fusion, graph, incremental, pixels, placement, planning, registration, review, rooms, runs, sources, spatial  # noqa: F401
from .registry import COVERS, ORACLES, QUERIES, oracle_sql  # noqa: F401
