"""Building blocks that stay distributed when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row within its group, without putting a group into one task.

    Rows are range partitioned by (keys, order), so a hot group spreads over many partitions;
    each piece is numbered locally and shifted by the size of the pieces before it. ``order``
    must be a total order. The ranged rows are written once because both the numbering and the
    piece sizes must see the same partition boundaries.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_piece", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    pieces = ranged.groupBy(*keys, "_piece").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*keys, "_piece", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    local = Window.partitionBy(*keys, "_piece").orderBy(*order)
    return (
        ranged.withColumn("_local", F.row_number().over(local))
        .join(pieces, [*keys, "_piece"])
        .withColumn(name, (F.col("_local") + F.col("_shift")).cast("long"))
        .drop("_piece", "_local", "_shift")
    )


def top_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int | None, name: str = "rank") -> DataFrame:
    """The first ``limit`` rows of every group; all rows with their rank where ``limit`` is None.

    Spark cuts each map task's share to ``limit`` rows per group before the shuffle
    (WindowGroupLimit), so the reduce side holds at most tasks x limit rows of one group.
    """
    if limit is None:
        return rank_within(df, keys, order, name)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= limit)


def running_by_blocks(
    df: DataFrame, keys: Sequence[str], order: str, measures: dict[str, tuple[str, Column]], block: int = 4096
) -> DataFrame:
    """Inclusive running ``sum`` or ``max`` along a dense integer ``order`` column.

    ``measures``: output name -> ('sum' | 'max', column). A group is cut into blocks of ``block``
    consecutive positions. Only block totals run across blocks, so a group of n rows needs tasks
    of ``block`` rows and one of n/block rows.
    """
    df = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(block)))
    df = df.withColumns({f"_in_{n}": column for n, (_, column) in measures.items()})
    totals = df.groupBy(*keys, "_chunk").agg(
        *[getattr(F, how)(f"_in_{n}").alias(f"_shift_{n}") for n, (how, _) in measures.items()])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"_shift_{n}": getattr(F, how)(f"_shift_{n}").over(before) for n, (how, _) in measures.items()})
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({n: getattr(F, how)(f"_in_{n}").over(inside) for n, (how, _) in measures.items()})
    out = out.join(totals, [*keys, "_chunk"])
    for name, (how, _) in measures.items():
        if how == "sum":
            out = out.withColumn(name, F.coalesce(name, F.lit(0)) + F.coalesce(f"_shift_{name}", F.lit(0)))
        else:
            out = out.withColumn(name, F.greatest(name, f"_shift_{name}"))
    return out.drop("_chunk", *[f"_in_{n}" for n in measures], *[f"_shift_{n}" for n in measures])


def medians_within(df: DataFrame, keys: Sequence[str], columns: Sequence[str], tie: str, upper: bool = False) -> DataFrame:
    """Exact median of each column per group from distributed ranks.

    ``percentile`` would build the value map of a whole group in one task; here only the one or two
    middle rows of a group are looked at. ``upper`` takes the upper of two middle values.
    """
    out = None
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    for column in columns:
        ranked = rank_within(df.select(*keys, column, tie), keys, [F.asc(column), F.asc(tie)], "_rank").join(sizes, [*keys])
        half = F.floor(F.col("_n") / 2)
        middle = F.col("_rank") == half + 1
        if not upper:
            middle = middle | ((F.col("_n") % 2 == 0) & (F.col("_rank") == half))
        one = ranked.filter(middle).groupBy(*keys).agg(F.avg(column).alias(f"median_{column}"))
        out = one if out is None else out.join(one, [*keys])
    return out


def greedy_matching(rows: DataFrame, keys: Sequence[str], left: str, right: str, order: Sequence[str]) -> DataFrame:
    """One-to-one choice, best first: a row is taken unless a better one took its left or its right end.

    ``order`` names columns that, with both ends, order the rows of a group totally, smallest best. In each round
    the rows that are the best open ones of both their ends are taken, whatever the others do, and rows at their ends
    drop out; so a group of any size is a few grouped minima, and no group is listed in one place. Rounds end by
    the data: each takes at least the best open row of every group.
    """
    rank = F.struct(*order, left, right)
    open_rows, taken = cut_lineage(rows.withColumn("_rank", rank)), None
    while not open_rows.isEmpty():
        best = lambda end: open_rows.groupBy(*keys, end).agg(F.min("_rank").alias(f"_best_{end}"))  # noqa: B023, E731
        won = cut_lineage(open_rows.join(best(left), [*keys, left]).join(best(right), [*keys, right]).filter((F.col("_rank") == F.col(f"_best_{left}")) & (F.col("_rank") == F.col(f"_best_{right}"))).select(*open_rows.columns))
        taken = won if taken is None else taken.unionByName(won)
        rest = open_rows.join(won.select(*keys, left), [*keys, left], "left_anti").join(won.select(*keys, right), [*keys, right], "left_anti")
        open_rows = cut_lineage(rest)
    return (open_rows if taken is None else taken).drop("_rank")
