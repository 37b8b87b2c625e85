"""Benchmark decontamination by suffix arrays of the training texts.

A shard is a slice of documents inside a task. Its words become dense ranks and its suffixes are put in
order: first by as many words as fit into one 64-bit key, then, among suffixes that are still equal, by
doubling the depth until it covers a window. Every suffix of every test item that is as long as a
window is looked up by binary search; the range of equal suffixes tells all its locations in the
shard, and the longest verbatim match at a location follows by reading on from there.

Documents are not shuffled, a document lies in one shard, and all memory is that of one shard and one
block of test items. The words of the test items are written to the shared folder once, and every
task reads them block by block, so the set of items may be of any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, new_folder, text_slices
from .shingles import word_hashes

WINDOW = 10
#: Test items in one block, and words of all blocks of a file set that a task keeps between shards.
ITEMS, KEPT_WORDS = 4096, 1 << 20

#: Bytes that part words: ASCII but for digits and letters.
_BREAKS = np.zeros(256, bool)
_BREAKS[:128] = True
for _low, _high in ("09", "AZ", "az"):
    _BREAKS[ord(_low) : ord(_high) + 1] = False


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo..hi-1, one range after the other, and the number of the range each is from."""
    size = hi - lo
    owner = np.repeat(np.arange(len(lo)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[owner], owner


class Shard:
    """Suffix array of a slice of documents, in order of their first ``depth`` words or more.

    ``rank`` numbers the shard's distinct words from 1 in order of their hashes; 0 stands for the end of a document.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, depth: int):
        self.at = np.concatenate([[0], np.cumsum(counts)])
        codes, known = pd.factorize(words)
        order = np.argsort(known)
        place = np.empty(len(known), np.int64)
        place[order] = np.arange(1, len(known) + 1)
        self.known, self.rank = known[order], place[codes]
        self.left = np.repeat(self.at[1:], counts) - np.arange(len(words))
        self.bits = max(1, len(known).bit_length())
        self.packed = max(1, min(62 // self.bits, depth))
        key = np.zeros(len(words), np.int64)
        for k in range(self.packed):
            key = (key << self.bits) | np.where(self.left > k, np.concatenate([self.rank[k:], np.zeros(min(k, len(words)), np.int64)]), 0)
        self.order = np.argsort(key)
        self.keys = key[self.order]
        self._refine(depth)

    def _refine(self, depth: int) -> None:
        n, done = len(self.order), self.packed
        if not n or done >= depth:
            return
        fresh = np.concatenate([[True], self.keys[1:] != self.keys[:-1]])
        while done < depth:
            head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            group = np.empty(n, np.int64)
            group[self.order] = head
            open_slots = np.flatnonzero(~fresh | ~np.concatenate([fresh[1:], [True]]))
            if not len(open_slots):
                return
            spots = self.order[open_slots]
            more = self.left[spots] > done
            if not more.any():
                return
            ahead = np.where(more, group[np.minimum(spots + done, n - 1)] + 1, 0)
            both = group[spots] * (n + 1) + ahead
            turn = np.argsort(both)
            self.order[open_slots], both = spots[turn], both[turn]
            fresh[open_slots] = np.concatenate([[True], both[1:] != both[:-1]])
            done *= 2

    def ranks_of(self, words: np.ndarray) -> np.ndarray:
        """Ranks of the shard for other words, -1 for words that it does not hold."""
        if not len(self.known):
            return np.full(len(words), -1)
        spot = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        return np.where(self.known[spot] == words, spot + 1, -1)

    def find(self, ranks: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffix array that begin with ranks[start : start + length], for all pairs (length at most the depth)."""
        low = np.zeros(len(start), np.int64)
        for k in range(self.packed):
            low = (low << self.bits) | np.where(length > k, ranks[np.minimum(start + k, len(ranks) - 1)], 0)
        free = np.maximum(self.packed - length, 0) * self.bits
        lo, hi = np.searchsorted(self.keys, low), np.searchsorted(self.keys, low + (np.int64(1) << free))
        deep = np.flatnonzero((hi > lo) & (length > self.packed))
        if len(deep):
            rest = int(length[deep].max()) - self.packed
            steps = np.arange(self.packed, self.packed + rest)
            inside = steps[None, :] < length[deep][:, None]
            wanted = np.where(inside, ranks[np.minimum(start[deep][:, None] + steps, len(ranks) - 1)], 0)
            first = self._bound(lo[deep], hi[deep], wanted, inside, steps, above=False)
            hi[deep] = self._bound(first, hi[deep], wanted, inside, steps, above=True)
            lo[deep] = first
        return lo, hi

    def _bound(self, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, inside: np.ndarray, steps: np.ndarray, above: bool) -> np.ndarray:
        """Binary search in [lo, hi): the first slot whose suffix is not below (``above``: is beyond) the wanted words."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            active = np.flatnonzero(lo < hi)
            if not len(active):
                return lo
            mid = (lo[active] + hi[active]) >> 1
            spot = self.order[mid]
            own = np.where(steps < self.left[spot][:, None], self.rank[np.minimum(spot[:, None] + steps, len(self.rank) - 1)], 0)
            apart = np.where(inside[active], own - wanted[active], 0)
            sign = np.take_along_axis(apart, (apart != 0).argmax(axis=1)[:, None], axis=1)[:, 0]
            below = sign <= 0 if above else sign < 0
            lo[active] = np.where(below, mid + 1, lo[active])
            hi[active] = np.where(below, hi[active], mid)

    def extended(self, ranks: np.ndarray, start: np.ndarray, stop: np.ndarray, spot: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Length of the longest verbatim match of ranks[start : stop] at ``spot``, where the first ``length`` are known to match."""
        length = length.copy()
        active = np.arange(len(spot))
        while len(active):
            size = length[active]
            active = active[(size < stop[active] - start[active]) & (size < self.left[spot[active]])]
            active = active[ranks[start[active] + length[active]] == self.rank[spot[active] + length[active]]]
            length[active] += 1
        return length


class Block:
    """Words of some test items, one after the other, with the windows in them."""

    def __init__(self, batch: pa.RecordBatch, window: int):
        lists = batch.column("words")
        self.items = batch.column("item").to_pylist()
        at = lists.offsets.to_numpy().astype(np.int64)
        self.words = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[at[0] : at[-1]]
        self.at = at - at[0]
        sizes = np.diff(self.at)
        # A window starts wherever as many words follow; an item of fewer words is one window.
        self.start, self.item = _ranges(self.at[:-1], self.at[:-1] + np.where(sizes >= window, sizes - window + 1, np.minimum(sizes, 1)))
        self.length = np.minimum(sizes, window)[self.item]


class Blocks:
    """The blocks of the written items, read anew for each shard unless they are few words."""

    def __init__(self, folder: str, window: int):
        self.folder, self.window, self.kept = folder, window, None

    def _read(self) -> Iterator[Block]:
        store, path = file_system(self.folder)
        for info in sorted(store.get_file_info(pafs.FileSelector(path)), key=lambda x: x.path):
            if info.path.endswith(".parquet"):
                with store.open_input_file(info.path) as file:
                    for batch in pq.ParquetFile(file).iter_batches(ITEMS, columns=["item", "words"]):
                        if batch.num_rows:
                            yield Block(batch, self.window)

    def __iter__(self) -> Iterator[Block]:
        if self.kept is not None:
            yield from self.kept
            return
        held, words = [], 0
        for block in self._read():
            words += len(block.words)
            held = [*held, block] if words <= KEPT_WORDS else []
            yield block
        if words <= KEPT_WORDS:
            self.kept = held


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch, texts in text_slices(whole, "text"):
            words, counts = word_hashes(texts, _BREAKS)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("item").cast(pa.string()), pa.ListArray.from_arrays(ends, pa.array(words.view(np.int64)))], ["item", "words"])


def _written_items(items: DataFrame, id_col: str, text_col: str) -> str:
    """The words of the items, in a folder of their own below the shared one."""
    folder = new_folder(items.sparkSession, "test-items")
    items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(_item_words, "item string, words array<long>").write.parquet(folder)
    return folder


def _found(shard: Shard, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """-> ranks of the block's words, the windows (by number) that occur in the shard, and their ranges."""
    ranks = shard.ranks_of(block.words)
    lacking = np.concatenate([[0], np.cumsum(ranks < 0)])
    windows = np.flatnonzero(lacking[block.start + block.length] == lacking[block.start])
    if not len(windows):
        return ranks, windows, windows, windows
    lo, hi = shard.find(ranks, block.start[windows], block.length[windows])
    met = hi > lo
    return ranks, windows[met], lo[met], hi[met]


def _reporter(folder: str, window: int):
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(folder, window)
        none = hashlib.sha256(b"").hexdigest()
        for whole in batches:
            for batch, texts in text_slices(whole, "text"):
                words, counts = word_hashes(texts, _BREAKS)
                shard = Shard(words, counts, window)
                edges = np.zeros(len(words) + 1, np.int64)
                pairs: list[set[str]] = [set() for _ in range(len(counts))]
                for block in blocks:
                    _, windows, lo, hi = _found(shard, block)
                    if not len(windows):
                        continue
                    # Equal windows have equal ranges: their places are listed once.
                    same, number = np.unique(np.stack([lo, hi, block.length[windows]]), axis=1, return_inverse=True)
                    slots, owner = _ranges(same[0], same[1])
                    spots = shard.order[slots]
                    edges += np.bincount(spots, minlength=len(edges)) - np.bincount(spots + same[2][owner], minlength=len(edges))
                    met = np.unique(np.stack([np.searchsorted(shard.at, spots, "right") - 1, owner]), axis=1)
                    items: list[set[str]] = [set() for _ in range(same.shape[1])]
                    for u, i in np.unique(np.stack([number.ravel(), block.item[windows]]), axis=1).T.tolist():
                        if block.items[i] is not None:
                            items[u].add(block.items[i])
                    for doc, u in met.T.tolist():
                        pairs[doc] |= items[u]
                hit = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
                hits = hit[shard.at[1:]] - hit[shard.at[:-1]]
                digests = [hashlib.sha256(",".join(sorted(p)).encode()).hexdigest() if p else none for p in pairs]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(p) for p in pairs], pa.int64()), pa.array(digests), pa.array(hits > 0)],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return report


def _matcher(folder: str, window: int):
    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(folder, window)
        for whole in batches:
            for batch, texts in text_slices(whole, "text"):
                words, counts = word_hashes(texts, _BREAKS)
                shard = Shard(words, counts, window)
                for block in blocks:
                    ranks, windows, lo, hi = _found(shard, block)
                    # The places of some windows at a time, so that very frequent ones do not fill the memory.
                    cuts = np.searchsorted(np.cumsum(hi - lo), np.arange(1 << 20, (hi - lo).sum() + 1, 1 << 20))
                    for own in np.split(np.arange(len(windows)), np.unique(cuts)):
                        slots, owner = _ranges(lo[own], hi[own])
                        spot, w = shard.order[slots], windows[own][owner]
                        start, item = block.start[w], block.item[w]
                        doc = np.searchsorted(shard.at, spot, "right") - 1
                        # One that can be read on to the left is a part of a longer match.
                        inner = (start > block.at[item]) & (spot > shard.at[doc])
                        inner &= ranks[np.maximum(start - 1, 0)] == shard.rank[np.maximum(spot - 1, 0)]
                        keep = np.flatnonzero(~inner)
                        if not len(keep):
                            continue
                        spot, w, start, item, doc = (x[keep] for x in (spot, w, start, item, doc))
                        size = shard.extended(ranks, start, block.at[item + 1], spot, block.length[w])
                        names = pa.array(block.items, pa.string()).take(pa.array(item))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array(doc)), pa.array(spot - shard.at[doc]), names, pa.array(start - block.at[item]), pa.array(size, pa.int64())],
                            ["doc_id", "doc_word", "item_id", "item_word", "n_words"],
                        )

    return matches


def verbatim_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """-> doc_id, doc_word, item_id, item_word, n_words: every longest verbatim match of an item in a document.

    ``doc_word`` and ``item_word`` are the 0-based numbers of the first words. A match is as long as the words agree on both
    sides, at least ``window`` words, or the whole of an item of fewer. Odd rows are those of ``contamination_report``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_matcher(_written_items(items, item_col, text_col), window), f"doc_id {kind}, doc_word long, item_id string, item_word long, n_words long")


def contamination_report(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """-> doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per row of ``docs``.

    A word is hit inside any occurrence of ``window`` consecutive words of an item, or of the whole of an item of fewer words;
    ``n_items`` items have such windows in the document, and ``items_sha256`` is of their ids as text, sorted and
    joined by commas. Words are runs of letters, digits and all characters beyond ASCII, A-Z folded; they are told apart by
    64-bit hashes. Null and empty texts have no words: such documents are clean and such items occur nowhere.
    Equal rows of either table are rows of their own, items of one id count once, and an item without an
    id hits words but is in no list. Without items every document is clean. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_reporter(_written_items(items, item_col, text_col), window), f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` without the documents in which an item occurs: all rows of an id go with any of them.

    Rows without an id stay only where their own text is clean, so they are judged row by row.
    """
    marked = docs.withColumn("_mark", F.xxhash64(F.col(text_col)))
    found = contamination_report(marked.select(F.struct(F.col(id_col).alias("i"), F.when(F.col(id_col).isNull(), F.col("_mark")).alias("m")).alias("_key"), F.col(text_col).alias("text")), items, window, "_key", "text", item_col)
    bad = found.where("contaminated").select(F.col("doc_id.i").alias("_i"), F.col("doc_id.m").alias("_m")).distinct()
    own = F.when(F.col(id_col).isNull(), F.col("_mark"))
    return marked.join(bad, F.col(id_col).eqNullSafe(F.col("_i")) & own.eqNullSafe(F.col("_m")), "left_anti").select(docs.columns)
