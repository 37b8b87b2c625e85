"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits the vectors again and again at the median of a random direction; vectors within
``spill`` of a cut go to both sides, so that close vectors are seldom parted. Vectors of one leaf and
one label are compared exactly, and the links of all leaves and trees are united. Cuts are fitted on
at most ``FIT_ROWS`` vectors, every vector is routed. A label has as many levels as give
leaves of about ``LEAF`` vectors, however many that are; a label of fewer is one leaf. Nodes that too few of the
fitting vectors reach are cut at the projection of the mean of the nearest node above that was fitted.

A link that several leaves find is counted in the first of them, which the two vectors' own lists of leaves
tell, so links are counted without being listed; of each leaf only one edge per vector goes on to
the components. Leaves of many vectors are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written
from .jaccard import _groups

THRESHOLD = 0.93
TREES = 6
LEAF = 1024
BLOCK = 4096
FIT_ROWS = 8192
#: Fitting vectors that a node needs for a median of its own.
LEAST = 16
#: Share of a node's fitting vectors near the cut beyond which the node is not split: most would go to both sides.
THICK = 0.6
SEED = 7


def direction(tree: int, path: int, size: int) -> np.ndarray:
    """The random unit direction of a node; ``path`` is 1 for the root, then 2p and 2p + 1."""
    d = np.random.default_rng((SEED, tree, path)).standard_normal(size)
    return d / np.linalg.norm(d)


def spill_width(threshold: float, size: int) -> float:
    """About two thirds of the standard deviation of how far two vectors at the threshold lie apart along a random direction."""
    return 0.65 * float(np.sqrt(max(2 * (1 - threshold), 0.0) / max(size, 1)))


class Tree:
    """Cuts of one tree by path; vectors within ``spill`` of a cut go to both sides."""

    def __init__(self, tree: int, sample: np.ndarray, spill: float):
        self.tree, self.size, self.spill = tree, sample.shape[1], spill
        self.whole: set[int] = set()
        self.cuts: dict[int, float] = {}
        self.centres: dict[int, np.ndarray] = {}
        level = {1: sample}
        while level:
            below = {}
            for path, rows in level.items():
                if len(rows) < LEAST:
                    self.centres[path] = rows.mean(axis=0) if len(rows) else np.zeros(self.size)
                    continue
                along = rows @ direction(tree, path, self.size)
                self.cuts[path] = float(np.median(along))
                low = along <= self.cuts[path]
                if low.all() or (np.abs(along - self.cuts[path]) <= spill).mean() > THICK:
                    self.whole.add(path)
                    continue
                below[2 * path], below[2 * path + 1] = rows[low], rows[~low]
            level = below

    def cut(self, path: int, along: np.ndarray) -> float:
        if path in self.cuts:
            return self.cuts[path]
        above = path
        while above not in self.centres:
            above >>= 1
        return float(self.centres[above] @ along)

    def route(self, rows: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
        """Leaves of the tree with ``depth`` levels -> (path, indices of the rows in it)."""
        leaves, open_nodes = [], [(1, np.arange(len(rows)), depth)]
        while open_nodes:
            path, index, left = open_nodes.pop()
            if not len(index):
                continue
            if not left or path in self.whole:
                leaves.append((path, index))
                continue
            d = direction(self.tree, path, self.size)
            along = rows[index] @ d - self.cut(path, d)
            open_nodes += [(2 * path, index[along <= self.spill], left - 1), (2 * path + 1, index[along > -self.spill], left - 1)]
        return leaves


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is made one first, so no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _unit(lists: pa.Array) -> np.ndarray:
    return unit_rows(lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()].astype(np.float64).reshape(len(lists), -1))


def _router(forest: list[Tree]):
    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("embedding").offsets.to_numpy())
            depths = batch.column("depth").to_numpy()
            for size, depth in sorted(set(zip(sizes.tolist(), depths.tolist(), strict=True))):
                own = np.flatnonzero((sizes == size) & (depths == depth))
                part = batch.take(pa.array(own))
                rows = _unit(part.column("embedding"))
                found = [(tree, path, index) for tree in range(len(forest) if depth else 1) for path, index in (forest[tree].route(rows, depth) if depth else [(1, np.arange(len(own)))])]
                where = np.concatenate([np.full(len(i), (tree << 56) + path, np.int64) for tree, path, i in found])
                index = np.concatenate([i for _, _, i in found])
                order = np.lexsort((where, index))
                counts = np.bincount(index, minlength=len(own))
                all_leaves = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(where[order]))
                take = pa.array(index)
                yield pa.RecordBatch.from_arrays([part.column("label").take(take), pa.array(where + 0), pa.array(np.full(len(index), size, np.int32)), part.column("rep").take(take), part.column("n").take(take), part.column("embedding").take(take), all_leaves.take(take)],
                                                 ["label", "leaf", "size", "rep", "n", "embedding", "leaves"])

    return routed


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value that each row of ``a`` and of ``b`` (ascending, padded with -1 and -2) have in common."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for k in range(a.shape[1]):
        hit = (b == a[:, k : k + 1]).any(axis=1)
        out = np.where(hit, np.minimum(out, a[:, k]), out)
    return out


def _padded(lists: list[list[int]], fill: int) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists))), fill, np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _heads(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component, for edges i - j."""
    head = np.arange(n)
    while True:
        low = np.minimum(head[i], head[j])
        new = head.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == head).all():
            return head
        head = new


def _comparer(threshold: float):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (label, leaf, size, lo, hi, rep) -> rep, links counted here, a linked head of the leaf."""
        for name, table in _groups(batches, ["label", "leaf", "size", "lo", "hi"]):
            table = table.combine_chunks()
            rep, n, part = (table.column(c).to_numpy() for c in ("rep", "n", "part"))
            lists = table.column("leaves").to_pylist()
            left, right = _padded(lists, -1), _padded(lists, -2)
            rows = _unit(table.column("embedding").chunk(0) if table.num_rows else pa.array([]))
            counts, found = np.zeros(len(rep), np.int64), []
            step = max(1, (1 << 21) // len(rep))
            for k in range(0, len(rep), step):
                i, j = np.nonzero(rows[k : k + step] @ rows.T >= threshold)
                i = i + k
                keep = i < j
                if name[3] != name[4]:
                    keep &= part[i] != part[j]
                i, j = i[keep], j[keep]
                for c in range(0, len(i), 1 << 18):
                    a, b = i[c : c + (1 << 18)], j[c : c + (1 << 18)]
                    mine = _first_shared(left[a], right[b]) == name[1]
                    counts += np.bincount(a[mine], n[b[mine]], len(rep)).astype(np.int64) + np.bincount(b[mine], n[a[mine]], len(rep)).astype(np.int64)
                found.append((i, j))
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            head = rep[_heads(len(rep), i, j)]
            linked = np.union1d(i, j)
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(counts[linked]), pa.array(head[linked])], ["rep", "links", "head"])

    return compared


def vector_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """``vectors``: id, vector, label -> vec_id, n_links, component_id, kept; one row per row.

    Two vectors of one label (not null) and one length link when a leaf holds both and their cosine
    is at least ``threshold``: the product of the vectors brought to length one, in double precision, so a cosine that
    is the threshold but for rounding may go either way. Vectors of any length but zero count. Vectors that are
    null, empty, zero, or hold null or non-finite components, have a null label or a null id, link with nothing and are their own component (null for a null id, which is not kept).
    Equal vectors (found by digests, and the job fails rather than merge others) are compared once and all count as links of each other. Rows of one
    id are vectors of their own under that id. Other columns are not read.
    """
    # Vectors of floats are moved as floats; all reckoning is in double precision.
    kind = "array<float>" if vectors.select(vector_col).dtypes[0][1] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"), F.col(label_col).cast("long").alias("label"))
    # x - x is zero for finite numbers only; a null component gives a null sum.
    sound = F.expr("aggregate(embedding, 0.0D, (s, x) -> s + (x - x)) = 0 and exists(embedding, x -> x <> 0)")
    rows = rows.withColumn("usable", F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    rows = rows.withColumns({"k": F.xxhash64("embedding"), "l": F.hash("embedding")})
    usable = rows.where("usable")
    same = F.when(F.min("embedding") == F.max("embedding"), F.min("vec_id")).otherwise(F.raise_error(F.lit("two vectors share a digest")))
    classes = usable.groupBy("label", "k", "l").agg(same.alias("low"), F.count("*").alias("n"), F.min("embedding").alias("embedding"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    sample = [r[0] for r in classes.orderBy("k", "l", "label").limit(FIT_ROWS).select("embedding").collect()]
    size = max((len(x) for x in sample), default=1)
    fitted = unit_rows(np.array([x for x in sample if len(x) == size], np.float64).reshape(-1, size)) if sample else np.zeros((0, size))
    forest = [Tree(tree, fitted, spill_width(threshold, size)) for tree in range(trees)]
    depths = classes.groupBy("label").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / LEAF))).cast("int").alias("depth"))
    routed = classes.join(depths, "label").select("label", "rep", "n", "embedding", F.when(F.size("embedding") == size, F.col("depth")).otherwise(0).alias("depth"))
    routed = written(routed.mapInArrow(_router(forest), f"label long, leaf long, size int, rep long, n long, embedding {kind}, leaves array<long>"), "leaves")
    blocks = routed.groupBy("label", "leaf", "size").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q"))
    spread = routed.join(blocks, ["label", "leaf", "size"]).withColumn("part", F.expr("cast(pmod(xxhash64(rep), q) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    spread = spread.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("q", "other")
    keys = ["label", "leaf", "size", "lo", "hi"]
    found = written(spread.repartition(*keys).sortWithinPartitions(*keys, "rep").mapInArrow(_comparer(threshold), "rep long, links long, head long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("rep").alias("a"), F.col("head").alias("b"))).withColumnRenamed("node", "rep").join(classes.select("rep", "low"), "rep")
    heads = reached.join(reached.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("rep", "component_id")
    told = classes.join(links, "rep", "left").join(heads, "rep", "left").select("label", "k", "l", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "low").alias("component_id"))
    rest = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    done = usable.join(told, ["label", "k", "l"]).select("vec_id", "n_links", "component_id").union(rest)
    return done.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
