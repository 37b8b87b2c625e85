"""Similarity join of documents on word shingles: exact Jaccard links and their components.

Method. Documents with one shingle set form a class. A class is put under the keys of its prefix:
with n shingles and a threshold of t percent any partner shares at least ceil(t*n/100) of them, so
two linked classes share one of their first n - ceil(t*n/100) + 1 shingles in any common order; the
order puts shingles of very many documents last. The rows of a key, sorted by set size, are a
tile: only sizes that can reach the threshold are compared in it, by parity bitmaps (bit h mod b
tells whether an odd number of the set's hashes fall there). Differing bits bound the symmetric
difference from below, so they bound the overlap from above; pairs that pass are decided by
intersecting the sorted arrays.

A tile first yields a star (every class against the leading class of its size band), then a chain
through it in a hashed order. What these link is one component, and pairs inside a component need
no test any more; the other pairs of a tile are tested in blocks of at most ``2 * BLOCK`` rows, so
neither a large group of near copies nor a passage that many documents share is expanded into
pairs or lands in one task. No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, text_slices, trimmed, written
from .shingles import mix, shingle_sets

WIDTH = 5
PERCENT = 80
#: Rows of one tile that are compared with as many others in one step.
BLOCK = 2048
#: Rows before it that a row of a tile is chained to.
CHAIN = 3
#: Bytes of text that are cut into shingles at once.
SLICE = 1 << 20
#: A shingle in at least one of this many documents comes last in the prefix order.
COMMON_SHARE = 2048
_KEYED = "key long, size int, place int, ck long"
_TILES = _KEYED + ", lead long"
_FACTS = "kind int, doc_id long, n_shingles long, ck long, twin long, sketch binary, shingle long, uses long"


def _class_key(own: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set."""
    a = mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(own))
    b = mix(own * np.uint64(0xD1342543DE82EF95) + np.uint64(1)).sum(dtype=np.uint64)
    return int(mix(np.array([a]))[:1].view(np.int64)[0]), int(np.array([b]).view(np.int64)[0])


def sketch(own: np.ndarray) -> bytes:
    """Parity bitmap of a set; its width is the first power of two that is no less than the set's size, 64 to 65536."""
    bits = min(max(64, 1 << (len(own) - 1).bit_length()), 1 << 16)
    return np.packbits((np.bincount((own >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def narrowed(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Parity bitmaps (rows of uint64) folded to fewer words; folding keeps the parities."""
    return np.bitwise_xor.reduce(bitmaps.reshape(len(bitmaps), -1, words), axis=1)


def _facts_of(width: int):
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            seen = []
            for batch, texts in text_slices(whole, "text", SLICE):
                flat, at = shingle_sets(texts, width)
                sizes = np.diff(at)
                keys = [_class_key(flat[at[i] : at[i + 1]]) if sizes[i] else (None, None) for i in range(len(sizes))]
                bitmaps = [sketch(flat[at[i] : at[i + 1]]) if sizes[i] else None for i in range(len(sizes))]
                yield _batch(_FACTS, kind=np.zeros(len(sizes), np.int32), doc_id=batch.column("doc_id"), n_shingles=sizes, ck=[k[0] for k in keys], twin=[k[1] for k in keys], sketch=bitmaps)
                seen.append(flat)
            # Counts of a batch, for those shingles that can be common over all documents.
            values, uses = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.empty(0, np.uint64), np.empty(0, np.int64))
            many = uses >= max(4, len(whole) // (2 * COMMON_SHARE))
            yield _batch(_FACTS, kind=np.ones(int(many.sum()), np.int32), shingle=values[many].view(np.int64), uses=uses[many].astype(np.int64))

    return facts


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def _batch(schema: str, **columns) -> pa.RecordBatch:
    """A batch of ``schema`` from the given columns; the others are null."""
    fields = [f.split(" ") for f in schema.split(", ")]
    n = len(next(iter(columns.values())))
    made = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], _TYPES[t]) if c in columns else pa.nulls(n, _TYPES[t]) for c, t in fields]
    return pa.RecordBatch.from_arrays(made, [c for c, _ in fields])


def _prefixes_of(width: int, percent: int, common: np.ndarray):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            done: set[int] = set()
            for batch, texts in text_slices(whole, "text", SLICE):
                known = np.asarray(batch.column("doc_id").is_valid())
                flat, at = shingle_sets(texts, width)
                late = np.zeros(len(flat), bool)
                if len(common):
                    late = common[np.minimum(np.searchsorted(common, flat), len(common) - 1)] == flat
                rows, owner = [], []
                for i in np.flatnonzero(np.diff(at) * known):
                    own, n = flat[at[i] : at[i + 1]], int(at[i + 1] - at[i])
                    ck = _class_key(own)[0]
                    if ck in done:
                        continue
                    done.add(ck)
                    length = n + (-percent * n // 100) + 1
                    behind = late[at[i] : at[i + 1]]
                    if behind.any():
                        own = np.concatenate([own[~behind], own[behind]])
                    rows.append(own[:length])
                    owner.append((ck, n, len(rows[-1])))
                if rows:
                    cks, sizes, lengths = (np.array(x, np.int64) for x in zip(*owner, strict=True))
                    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    yield _batch(_KEYED, key=np.concatenate(rows).view(np.int64), size=np.repeat(sizes, lengths).astype(np.int32), place=place.astype(np.int32), ck=np.repeat(cks, lengths))

    return prefixes


def _stars_of(percent: int):
    def leads(starts: np.ndarray, size: np.ndarray, ck: np.ndarray, first: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Leading class and its size for each row; ``starts`` begins a run, ``first`` leads the first row."""
        starts = starts.copy()
        starts[0] = True
        while True:
            run = np.cumsum(starts) - 1
            head, head_size = ck[starts], size[starts]
            head[0], head_size[0] = first
            out = np.flatnonzero(100 * head_size[run] < percent * size)
            if not len(out):
                return head[run], head_size[run]
            # The first row of a run that is out of its leader's band leads from there on.
            starts[out[np.concatenate([[True], run[out][1:] != run[out][:-1]])]] = True

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (key, size, ck) -> rows that have another of their key near in size, each with the leading class of its band.

        Sizes ascend, so a row without a neighbour in reach has no partner at all. One row waits for its successor.
        """
        names = ["key", "size", "ck", "place"]
        held = np.empty((4, 0), np.int64)  # the row that waits
        joined, first = False, (0, 0)  # whether it follows the row before, and its leader
        for b in batches:
            rows = np.concatenate([held, np.stack([b.column(c).to_numpy().astype(np.int64) for c in names])], axis=1)
            if not rows.shape[1]:
                continue
            fresh = np.ones(rows.shape[1], bool)
            fresh[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[2, 1:] != rows[2, :-1])
            rows = rows[:, fresh]
            key, size, ck, _ = rows
            near = np.ones(rows.shape[1], bool)
            near[1:] = (key[1:] == key[:-1]) & (100 * size[:-1] >= percent * size[1:])
            near[0] = joined
            lead, lead_size = leads(~near, size, ck, first if joined else (ck[0], size[0]))
            keep = near[:-1] | near[1:]
            if keep.any():
                yield _tile_rows(rows[:, :-1][:, keep], lead[:-1][keep])
            held, joined, first = rows[:, -1:], bool(near[-1]), (int(lead[-1]), int(lead_size[-1]))
        if joined:
            yield _tile_rows(held, np.array([first[0]]))

    return stars


def _tile_rows(rows: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
    key, size, ck, place = rows
    return _batch(_TILES, key=key, size=size.astype(np.int32), place=place.astype(np.int32), ck=ck, lead=lead)


def _words(bitmap: bytes) -> np.ndarray:
    return np.frombuffer(bitmap, np.uint64)


def _bounded(percent: int):
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs with bitmaps -> those whose bit counts allow the threshold."""
        for b in batches:
            n, sa, sb = b.num_rows, b.column("size_a").to_numpy(), b.column("size_b").to_numpy()
            keep = np.zeros(n, bool)
            for i, (x, y) in enumerate(zip(b.column("sketch_a"), b.column("sketch_b"), strict=True)):
                x, y = _words(x.as_py()), _words(y.as_py())
                words = min(len(x), len(y))
                apart = np.bitwise_count(narrowed(x[None], words) ^ narrowed(y[None], words)).sum()
                keep[i] = _reachable(int(sa[i]), int(sb[i]), int(apart), percent)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return bounded


def _reachable(size_a, size_b, apart, percent):
    """Whether sets of these sizes that differ in at least ``apart`` members may reach the threshold."""
    low, high = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    return ((size_a + size_b - apart) * (100 + percent) >= 2 * percent * (size_a + size_b)) & (100 * low >= percent * high)


def _pairs_of(percent: int):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block of a tile and size -> pairs across components that pass the bitmap bound."""
        for names, table in _groups(batches, ["key", "lo", "hi"]):
            size, ck, comp, part, place = (table.column(c).to_numpy() for c in ("size", "ck", "comp", "part", "place"))
            size, left = size.astype(np.int64), size.astype(np.int64) - place
            bitmaps = [_words(x) for x in table.column("sketch").to_pylist()]
            widths = np.array([len(x) for x in bitmaps])
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                wide = np.flatnonzero(widths == 2 * width)
                mine = np.stack([bitmaps[i] for i in rows])
                other = np.concatenate([mine, narrowed(np.stack([bitmaps[i] for i in wide]), int(width))]) if len(wide) else mine
                index = np.concatenate([rows, wide])
                step = max(1, (1 << 19) // (len(index) * int(width)))
                for k in range(0, len(rows), step):
                    at = rows[k : k + step]
                    apart = np.bitwise_count(mine[k : k + step, None, :] ^ other[None, :, :]).sum(axis=2, dtype=np.int64)
                    ok = _reachable(size[at][:, None], size[index][None, :], apart, percent) & (comp[at][:, None] != comp[index][None, :])
                    # In the first key that two classes share, what they share is no more than what either has from there on.
                    ok &= (100 + percent) * np.minimum(left[at][:, None], left[index][None, :]) >= percent * (size[at][:, None] + size[index][None, :])
                    ok &= (index[None, :] > at[:, None]) | (widths[index] != width)[None, :]
                    if names[1] != names[2]:
                        ok &= part[at][:, None] != part[index][None, :]
                    i, j = np.nonzero(ok)
                    if len(i):
                        a, b = ck[at[i]], ck[index[j]]
                        yield _batch("a long, b long", a=np.minimum(a, b), b=np.maximum(a, b))

    return pairs


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows of equal ``by`` columns, of which each group is known to be small."""
    held: list[pa.RecordBatch] = []
    name: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in by]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            key = tuple(int(c[lo]) for c in cols)
            if key != name and held:
                yield name, pa.Table.from_batches(held)
                held = []
            name = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield name, pa.Table.from_batches(held)


def _sets_of(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for _, texts in text_slices(whole, "text", SLICE):
                flat, at = shingle_sets(texts, width)
                keep = np.flatnonzero(np.diff(at))
                keys = [_class_key(flat[at[i] : at[i + 1]])[0] for i in keep]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([at[keep], at[-1:]]), pa.int32()), pa.array(flat.view(np.int64)))
                yield _batch("ck long, members array<long>", ck=keys, members=lists)

    return sets


def _linked_of(percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs with their sorted sets -> pairs that reach the threshold, by exact intersection."""
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("in_a"), b.column("in_b"), strict=True)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return linked


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``docs``: id, text -> doc_id, n_shingles, component_id, one row per row of ``docs``.

    Words are runs of other bytes than space and the five ASCII controls from tab on, A-Z folded;
    a document's set holds its distinct ``width``-word shingles (the whole sequence where there are
    fewer words). Two documents link when 100 * overlap >= ``percent`` * union; ``component_id`` is
    the smallest id that links reach. Null and empty texts and texts of separators have no shingles and link with
    nothing. A null id gives a null component and links with nothing. Repeated rows stay repeated
    rows of one component. Other columns are not read, whatever their names.

    Sets are held as 64-bit hashes; two digests of a set tell classes apart, and the job fails
    rather than merge two sets of one digest.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    facts = written(docs.mapInArrow(trimmed(_facts_of(width)), _FACTS), "facts")
    rows = facts.where("kind = 0")
    n = rows.count()
    # At most COMMON_SHARE times the mean set size, however many documents there are.
    frequent = facts.where("kind = 1").groupBy("shingle").agg(F.sum("uses").alias("uses")).where(F.col("uses") >= max(8, n // COMMON_SHARE))
    common = np.sort(np.array([r[0] for r in frequent.select("shingle").collect()], np.int64).view(np.uint64))

    classes = rows.where("ck is not null and doc_id is not null").groupBy("ck").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.min("twin").alias("_t"), F.max("twin").alias("_u"))
    classes = classes.select("ck", "doc_id", F.when(F.col("_t") == F.col("_u"), F.col("size")).otherwise(F.raise_error(F.lit("two shingle sets share a digest"))).alias("size"), "sketch")
    classes = written(classes, "classes")

    keyed = docs.mapInArrow(trimmed(_prefixes_of(width, percent, common)), _KEYED)
    tiles = written(keyed.repartition("key").sortWithinPartitions("key", "size", "ck").mapInArrow(trimmed(_stars_of(percent)), _TILES), "tiles")

    def decided(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of class keys that reach the threshold."""
        pairs = written(pairs, "pairs")
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("ck")).distinct().join(classes.select("ck", "doc_id"), "ck")
        nodes = written(nodes, "nodes")
        members = docs.join(nodes.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(trimmed(_sets_of(width)), "ck long, members array<long>")
        members = written(members.join(nodes.select("ck"), "ck", "left_semi").groupBy("ck").agg(F.first("members").alias("members")), "members")
        full = pairs.join(members.select(F.col("ck").alias("a"), F.col("members").alias("in_a")), "a").join(members.select(F.col("ck").alias("b"), F.col("members").alias("in_b")), "b")
        return written(full.mapInArrow(trimmed(_linked_of(percent)), "a long, b long"), "linked")

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose bitmaps allow the threshold."""
        for side in ("a", "b"):
            pairs = pairs.join(classes.select(F.col("ck").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
        return pairs.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(trimmed(_bounded(percent)), "a long, b long")

    def still_open(links: DataFrame) -> DataFrame:
        """Rows of the tiles that hold several components, with their component and the blocks ``q`` of the tile."""
        labels = components(links).select(F.col("node").alias("ck"), F.col("component").alias("comp"))
        labelled = written(tiles.select("key", "size", "place", "ck").join(labels, "ck", "left").withColumn("comp", F.coalesce("comp", "ck")), "labelled")
        keys = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).where("x <> y")
        return labelled.join(keys.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("q")), "key")

    lead = tiles.where("ck <> lead").select(F.least("ck", "lead").alias("a"), F.greatest("ck", "lead").alias("b")).distinct()
    links = decided(possible(lead))

    # A chain through each tile in an order of its own links groups whose copies are not all close to the leading one.
    mixed = still_open(links).withColumns({"turn": F.xxhash64("key", "ck"), "bin": F.expr("pmod(xxhash64(ck, key), q)")})
    along = Window.partitionBy("key", "bin").orderBy("turn", "ck")
    steps = F.array(*[F.struct(*[F.lag(c, k).over(along).alias(f"to_{c}") for c in ("ck", "comp", "size")]) for k in range(1, CHAIN + 1)])
    chain = mixed.select("ck", "comp", "size", steps.alias("steps")).select("ck", "comp", "size", F.explode("steps").alias("s")).select("ck", "comp", "size", "s.*")
    chain = chain.where(f"comp <> to_comp and 100 * least(size, to_size) >= {percent} * greatest(size, to_size)")
    links = written(links.union(decided(possible(chain.select(F.least("ck", "to_ck").alias("a"), F.greatest("ck", "to_ck").alias("b")).distinct()))), "linked")

    spread = still_open(links).withColumn("part", F.expr("cast(pmod(ck, q) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    spread = spread.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "size", "place", "ck", "comp", "part")
    spread = spread.join(classes.select("ck", "sketch"), "ck").select("key", "lo", "hi", "size", "place", "ck", "comp", "part", "sketch")
    rest = spread.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "size", "ck").mapInArrow(trimmed(_pairs_of(percent)), "a long, b long").distinct()
    links = links.union(decided(rest))

    reached = components(links).join(classes.select(F.col("ck").alias("node"), "doc_id"), "node")
    heads = reached.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    heads = reached.join(heads, "component").select(F.col("node").alias("ck"), "component_id")
    heads = classes.select("ck", "doc_id").join(heads, "ck", "left").select("ck", F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = rows.where("ck is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where("ck is not null and doc_id is not null").join(heads, "ck").select("doc_id", "n_shingles", "component_id").union(alone)
