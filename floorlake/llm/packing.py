"""Packing of documents into token windows: best-fit decreasing over open windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, trimmed
from .units import library_encoder, with_end

WINDOW = 2048
#: Documents whose last pieces are packed together. Windows left open at the end of a group are
#: what packing all rows at once would save: a few in each group.
GROUP = 1 << 14


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree over the capacities.

    A node tells whether any capacity below it has an open window; the tightest window for a length is
    the leftmost marked leaf from there on.
    """

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.marked = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, capacity: int, name: int) -> None:
        self.open[capacity].append(name)
        node = capacity + self.size
        while node and not self.marked[node]:
            self.marked[node] = 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) with the least capacity that is no less than ``length``."""
        marked, node = self.marked, length + self.size
        while not marked[node]:
            while node & 1:  # a right child: what follows is right of its parent
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            if not node & (node - 1):  # past the right end of a level
                return None
        while node < self.size:
            node *= 2
            node += not marked[node]
        capacity = node - self.size
        name = self.open[capacity].pop()
        if not self.open[capacity]:
            marked[node] = 0
            node >>= 1
            while node and not (marked[2 * node] or marked[2 * node + 1]):
                marked[node] = 0
                node >>= 1
        return capacity, name


def document_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``window`` ids: full windows, then the rest -> doc_id, start, length, ids_crc32, doc_tokens."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, blanks=False)
        for whole in batches:
            for batch, texts in text_slices(whole, "text"):
                ids, at = with_end(*encoder(texts), end_id)
                sizes = np.diff(at)
                count = -(-sizes // window)
                owner = np.repeat(np.arange(len(sizes)), count)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                start = nth * window
                length = np.minimum(window, sizes[owner] - start)
                plain, place = ids.astype("<u4"), at[owner] + start
                crcs = [zlib.crc32(plain[p : p + n]) for p, n in zip(place, length, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(sizes[owner])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(cut), schema)


def pack_pieces(pieces: DataFrame, groups: int, window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, start, length, ...) -> the same with sequence_id and offset.

    Spark deals the pieces out to groups at random and sorts each by falling length, so a task reads its groups as a
    stream and holds only the open windows of one group. Pieces of full length have a window of
    their own. Sequences are numbered group by group: group * 2**32 + number.
    """
    # Rows of one document, or equal rows, may be dealt to different groups.
    dealt = pieces.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    names = pieces.columns
    dealt = dealt.repartition("bin").sortWithinPartitions("bin", F.desc("length"), "doc_id", "start", "ids_crc32")
    schema = ", ".join([*[f"{c} long" for c in names], "sequence_id long, offset long"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, windows, made = None, OpenWindows(window), 0
        for batch in batches:
            bins, lengths = batch.column("bin").to_pylist(), batch.column("length").to_pylist()
            sequence, offset = np.zeros(len(bins), np.int64), np.zeros(len(bins), np.int64)
            for i, (own, length) in enumerate(zip(bins, lengths, strict=True)):
                if own != group:
                    group, windows, made = own, OpenWindows(window), 0
                found = windows.take(length) if length < window else None
                if found is None:
                    found = window, made
                    made += 1
                capacity, name = found
                sequence[i], offset[i] = (own << 32) + name, window - capacity
                if capacity > length:
                    windows.put(capacity - length, name)
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return dealt.select(*names, "bin").mapInArrow(pack, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``: id, text -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; one row per piece.

    A document is its ids and ``end_id``; a null text counts as empty, so it is one piece of length 1. Documents longer
    than ``window`` are first cut into full windows. Null ids are kept, repeated rows are documents of
    their own. Other columns are not read.
    """
    groups = max(1, -(-docs.count() // group))
    return pack_pieces(document_pieces(docs, tokenizer, end_id, window, id_col, text_col), groups, window)
