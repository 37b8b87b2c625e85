"""Codes of vectors: 16 parts, each by the nearest of 64 entries of its codebook, found in a GNAT over the entries.

A GNAT (geometric near-neighbour access tree) splits the entries at some of them, the split points; every other
entry goes below the nearest split point, and for each split point and child the range of distances to what
lies below is kept. A query measures its distance to a split point that is still open; where the range of a
child cannot come as near as the best entry so far, the whole child is out. A child is only out if it is strictly
farther, with roots rounded outwards; ties and the order of entries are decided by whole numbers.

All numbers are whole: components are floor(256 x), distances squared. They are 64-bit numbers where that is
proven to be enough and Python's otherwise, in the same code. A round of fitting is one pass over the vectors in
which each task sums up its parts per entry; at most parts x entries sums reach the driver, however many
vectors there are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Split points of a node.
FANOUT = 8
#: Components of at most so many bits are held as 64-bit numbers.
NARROW = 24
#: Sums are handed on in digits of this many bits, so that they never overflow.
DIGIT = 40
#: Vectors of one task step; bounds the memory of a step.
STEP = 4096

_isqrt = np.frompyfunc(math.isqrt, 1, 1)


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly; Python's whole numbers where 64-bit ones might not be enough."""
    if not x.size or float(np.abs(x).max()) * SCALE < 1 << NARROW:
        return np.floor(x.astype(np.float64) * SCALE).astype(np.int64)
    flat = [math.floor(v * SCALE) if abs(v) < 1 << 52 else int(v) * SCALE for v in x.astype(np.float64).ravel().tolist()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(x.shape)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` from ``b``."""
    apart = a - b
    return (apart * apart).sum(axis=-1)


def roots(d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers no greater and no less than the square roots."""
    if d2.dtype == object:
        low = _isqrt(d2)
        return low, low + 1
    root = np.sqrt(d2.astype(np.float64))
    return np.nextafter(root, -1.0) * (1 - 1e-15), np.nextafter(root, np.inf) * (1 + 1e-15)


class Node:
    """A node of the tree over some entries (rows of ``entries``, by number)."""

    def __init__(self, entries: np.ndarray, members: np.ndarray):
        self.splits = self._far_apart(entries, members)
        rest = np.setdiff1d(members, self.splits)
        apart = np.stack([squared(entries[rest], entries[s]) for s in self.splits], axis=1) if len(rest) else np.zeros((0, len(self.splits)), np.int64)
        nearest = apart.argmin(axis=1) if len(rest) else np.zeros(0, np.int64)
        below = [rest[nearest == j] for j in range(len(self.splits))]
        self.children = [Node(entries, b) if len(b) else None for b in below]
        # Range of the distances from split point i to split point j and to all that lies below it.
        self.low, self.high = (np.empty((len(self.splits), len(self.splits)), object if entries.dtype == object else np.float64) for _ in range(2))
        for i, s in enumerate(self.splits):
            for j, t in enumerate(self.splits):
                low, high = roots(squared(entries[np.concatenate([[t], below[j]])], entries[s]))
                self.low[i, j], self.high[i, j] = low.min(), high.max()

    @staticmethod
    def _far_apart(entries: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Split points: the first entry, then again and again the one farthest from those chosen."""
        chosen = [members[0]]
        gap = squared(entries[members], entries[members[0]])
        while len(chosen) < min(FANOUT, len(members)):
            gap[np.isin(members, chosen)] = -1
            chosen.append(members[int(np.argmax(gap))])
            gap = np.minimum(gap, squared(entries[members], entries[chosen[-1]]))
        return np.array(chosen)


class Gnat:
    """Nearest entry of a codebook part for many queries at once; of entries equally near, the one of lowest number."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = Node(entries, np.arange(len(entries)))
        self.measured = 0

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """-> numbers of the entries, squared distances."""
        if (queries.dtype == object) != (self.entries.dtype == object):
            return Gnat(self.entries.astype(object)).nearest(queries.astype(object))
        n = len(queries)
        best, number = np.zeros(n, queries.dtype), np.full(n, -1)
        self._search(self.root, np.arange(n), queries, best, number)
        return number, best

    def _search(self, node: Node, rows: np.ndarray, queries: np.ndarray, best: np.ndarray, number: np.ndarray) -> None:
        open_ = np.ones((len(rows), len(node.splits)), bool)
        for i, s in enumerate(node.splits):
            at = np.flatnonzero(open_[:, i])
            own = rows[at]
            if not len(own):
                continue
            d2 = squared(queries[own], self.entries[s])
            self.measured += len(own)
            closer = (number[own] < 0) | (d2 < best[own]) | ((d2 == best[own]) & (s < number[own]))
            best[own[closer]], number[own[closer]] = d2[closer], s
            low, high = roots(d2)
            reach = roots(best[own])[1]
            # The nearest that anything below j can be to the query.
            bound = np.maximum(node.low[i][None, :] - high[:, None], low[:, None] - node.high[i][None, :])
            open_[at] &= ~(bound > reach[:, None]).astype(bool)
        for j, child in enumerate(node.children):
            if child is not None and open_[:, j].any():
                self._search(child, rows[open_[:, j]], queries, best, number)


def _steps(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of vectors of ``size`` components with their whole components, some at a time."""
    for whole in batches:
        for k in range(0, whole.num_rows, STEP):
            batch = whole.slice(k, STEP)
            lists = batch.column("vector")
            x = lists.flatten().to_numpy(zero_copy_only=False)
            yield batch, quantised(x.reshape(batch.num_rows, size))


def _part(x: np.ndarray, k: int, parts: int) -> np.ndarray:
    size = x.shape[1] // parts
    return x[:, k * size : (k + 1) * size]


def _summing(books: list[np.ndarray], size: int):
    trees = [Gnat(b) for b in books]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of one task per part, entry and position, as digits with the sum's sign; position -1 counts."""
        shape = (len(books), len(books[0]), size // len(books))
        total, count = np.zeros(shape, object), np.zeros(shape[:2], np.int64)
        for _, x in _steps(batches, size):
            for k, tree in enumerate(trees):
                own = _part(x, k, len(trees))
                number, _ = tree.nearest(own)
                count[k] += np.bincount(number, minlength=shape[1])
                step = np.zeros(shape[1:], own.dtype)
                np.add.at(step, number, own)
                total[k] += step
        rows = [(k, e, -1, 0, int(count[k, e])) for k in range(shape[0]) for e in range(shape[1]) if count[k, e]]
        for (k, e, position), value in np.ndenumerate(total):
            value, sign, digit = abs(int(value)), -1 if value < 0 else 1, 0
            while value:
                rows.append((k, e, position, digit, sign * (value & ((1 << DIGIT) - 1))))
                value, digit = value >> DIGIT, digit + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(),) * 4 + (pa.int64(),), strict=True)], ["part", "entry", "position", "digit", "value"])

    return sums


def _coding(books: list[np.ndarray], size: int):
    trees = [Gnat(b) for b in books]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _steps(batches, size):
            numbers, errors = zip(*[tree.nearest(_part(x, k, len(trees))) for k, tree in enumerate(trees)], strict=True)
            text = [bytes(row).hex() for row in np.stack(numbers, axis=1).astype(np.uint8)]
            whole = sum(e.astype(object) for e in errors).tolist()
            fitting = [e if e < 1 << 63 else None for e in whole]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(fitting, pa.int64())], ["vec_id", "label", "code", "error"])

    return codes


def fit_codebooks(usable: DataFrame, size: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """``usable``: vec_id, vector of ``size`` components -> the entries of each part."""
    first = usable.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = quantised(np.array([r[0] for r in first], np.float64).reshape(len(first), size))
    books = [_part(start, k, parts).copy() for k in range(parts)]
    for _ in range(rounds):
        found = usable.select("vector").mapInArrow(_summing(books, size), "part int, entry int, position int, digit int, value long")
        found = found.groupBy("part", "entry", "position", "digit").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
        sums: dict[tuple[int, int, int], int] = {}
        for r in found:
            sums[r.part, r.entry, r.position] = sums.get((r.part, r.entry, r.position), 0) + (int(r.value) << (DIGIT * r.digit))
        books = [b.astype(object) for b in books]
        for (k, e, position), count in sums.items():
            if position < 0:
                for i in range(size // parts):
                    books[k][e, i] = sums.get((k, e, i), 0) // count
        if all(abs(int(v)) < 1 << NARROW for b in books for v in b.ravel()):
            books = [b.astype(np.int64) for b in books]
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """-> vec_id, code, error, label_error, codebooks_sha256; one row per vector without null or non-finite components.

    The codebooks start as the parts of the vectors of smallest id (null ids last, then by components where an id repeats),
    fewer where there are fewer vectors. Rounds move each entry to the floor of its parts' mean; unused entries stay.
    ``label_error`` is the error of all rows of the label, null labels together. Vectors have as many
    components as the first one; one of another number takes no part and has a null code and error, as have
    all if that number cannot be cut into ``parts``. An error beyond 64 bits is null. Equal rows are rows of their own.
    Without vectors there are no rows. Other columns are not read.
    """
    kind = "array<float>" if vectors.select(vector_col).dtypes[0][1] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"), F.col(label_col).cast("string").alias("label"))
    # x - x is zero for finite numbers only; a null component gives a null sum.
    rows = rows.where("aggregate(vector, 0.0D, (s, x) -> s + (x - x)) = 0")
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector")).first()
    size = head[0] if head else 0
    fits = F.size("vector") == (size if size % parts == 0 else -1)
    usable = rows.where(fits)
    empty = "vec_id long, label string, code string, error long"
    if size % parts or head is None:
        digest, coded = codebooks_digest([]), rows.sparkSession.createDataFrame([], empty)
    else:
        books = fit_codebooks(usable.select("vec_id", "vector"), size, parts, entries, rounds)
        digest, coded = codebooks_digest(books), usable.mapInArrow(_coding(books, size), empty)
    other = rows.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = written(coded.union(other), "codes").withColumn("_key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    sums = coded.groupBy("_key").agg(F.sum("error").alias("label_error"))
    return coded.join(sized(written(sums, "label-errors")), "_key").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
