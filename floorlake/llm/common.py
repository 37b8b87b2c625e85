"""Shared helpers of the training-data operators: folders, components, batches of text."""

from __future__ import annotations

import contextlib
import ctypes
import posixpath
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 4 << 20


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that may be broadcast; a larger one is joined by shuffles.
BROADCAST_ROWS = 200_000


def sized(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcasting only where a count shows that it is small."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def trimmed(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``step`` over the batches of a task, after which the worker gives memory that it no longer uses back to the system.

    Workers live on between tasks and jobs, so what their allocators keep would add up from stage to stage.
    """

    def run(batches: Iterator) -> Iterator:
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return run


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it for ``folder``, a URI (file, hdfs, s3, gs) or an absolute path."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def join_path(folder: str, name: str) -> str:
    return posixpath.join(folder.rstrip("/"), name)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` (large_string) of at most ``limit`` bytes, or of one longer text."""
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    at, n = 0, len(texts)
    while at < n:
        to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch with their texts as large_string (null: empty), each bounded in bytes."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    for at, to in slices(texts, limit):
        yield batch.slice(at, to - at), texts.slice(at, to - at)


def components(links: DataFrame, nodes: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Connected components of ``links`` (two columns of one type) -> node, component (smallest node).

    Alternates large-star and small-star steps: every edge moves towards the smallest neighbour, so
    the number of edges never grows and hubs are never expanded into pairs. Each step is one
    grouped minimum (combined before the shuffle) and one join; a hub's rows are only on the
    side that adaptive execution may split. Rounds are logarithmic in the longest path; the loop
    ends when a round leaves the edge set as it was (count and order-free checksum).
    """
    a, b = nodes
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = written(edges, "links")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = written(small.where("u <> v").distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    tails = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return tails.union(heads)
