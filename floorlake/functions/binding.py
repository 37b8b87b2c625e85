"""A name for the result of a formula inside a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once.

    Spark repeats a formula wherever it is named, and inside a lambda for every element; the variable of a lambda holds
    its result.
    """
    return F.transform(F.array(value), lambda bound: body(bound))[0]
