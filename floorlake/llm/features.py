"""Hashed text features of documents, and sparse linear models over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_slices
from .shingles import mix, word_hashes

BUCKETS = 1 << 20
#: Lengths of the word beginnings that are features, besides the word.
PREFIXES = (4, 5, 6)


def bucket(kind: int, hashes: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Bucket 1 to BUCKETS - 1 of each hash under its kind; 0 where there is none."""
    salted = mix(hashes ^ np.uint64((kind + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return np.where(present, (salted % np.uint64(BUCKETS - 1)).astype(np.int64) + 1, 0)


def string_hashes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each string without white space, and whether it is not empty."""
    hashes, counts = word_hashes(strings)
    present = counts > 0
    out = np.zeros(len(strings), np.uint64)
    out[present] = hashes[np.cumsum(counts)[present] - 1]
    return out, present


def unit_features(units: pa.Array) -> np.ndarray:
    """Buckets of each white-space separated unit, one column a kind: word, beginnings, other signs, shape; 0 for none."""
    letters = pc.replace_substring_regex(pc.utf8_lower(units), r"[^\p{L}]+", "")
    length = pc.utf8_length(letters).to_numpy()
    columns = [bucket(0, *string_hashes(letters))]
    for k in PREFIXES:
        hashes, present = string_hashes(pc.utf8_slice_codeunits(letters, 0, k))
        columns.append(bucket(k, hashes, present & (length >= k)))
    signs = pc.replace_substring_regex(pc.replace_substring_regex(units, r"[\p{L}]+", ""), r"\p{N}+", "0")
    columns.append(bucket(10, *string_hashes(pc.utf8_slice_codeunits(signs, 0, 8))))
    shouted = pc.match_substring_regex(units, r"\p{Lu}\p{Lu}").to_numpy(zero_copy_only=False)
    columns.append(bucket(11, np.full(len(units), 1, np.uint64), shouted))
    return np.stack(columns, axis=1)


def units_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct units of a slice of texts -> text and unit number of each distinct pair of them, units; with every unit's uses."""
    lists = pc.ascii_split_whitespace(texts)
    coded = pc.dictionary_encode(lists.flatten())
    codes = coded.indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    pairs, uses = np.unique(owner * max(len(coded.dictionary), 1) + codes, return_counts=True)
    return pairs, uses, coded.dictionary


def document_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text (flat, with offsets), with those of the text as a whole."""
    pairs, uses, units = units_of(texts)
    n = max(len(units), 1)
    owner, code = pairs // n, pairs % n
    rows = unit_features(units) if len(units) else np.zeros((0, 6), np.int64)
    every = rows[code]
    flat = np.concatenate([(owner[:, None] * BUCKETS + every)[every > 0], whole_features(texts, owner, uses, every)])
    flat = np.unique(flat)
    return flat % BUCKETS, np.searchsorted(flat, np.arange(len(texts) + 1) * BUCKETS)


def whole_features(texts: pa.Array, owner: np.ndarray, uses: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Keys (text * BUCKETS + bucket) of rounded shares: repeated units, units with signs, shouted units, and the length."""
    n = len(texts)
    total = np.bincount(owner, uses, n)
    safe = np.maximum(total, 1)
    shares = [1 - np.bincount(owner, minlength=n) / safe, np.bincount(owner, uses * (every[:, 4] > 0), n) / safe, np.bincount(owner, uses * (every[:, 5] > 0), n) / safe]
    values = [np.ceil(12 * s).astype(np.int64) for s in shares] + [np.ceil(np.log2(total + 1)).astype(np.int64)]
    return np.concatenate([np.arange(n) * BUCKETS + bucket(20 + k, v.astype(np.uint64), np.ones(n, bool)) for k, v in enumerate(values)])


def margins(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each text's distinct buckets; only units with a weight are followed."""
    pairs, uses, units = units_of(texts)
    n = max(len(units), 1)
    owner, code = pairs // n, pairs % n
    rows = unit_features(units) if len(units) else np.zeros((0, 6), np.int64)
    heavy = (weights[rows] != 0).any(axis=1) if len(rows) else np.zeros(0, bool)
    keep = heavy[code]
    every = rows[code[keep]]
    flat = np.unique(np.concatenate([(owner[keep][:, None] * BUCKETS + every)[every > 0], whole_features(texts, owner, uses, rows[code])]))
    return np.bincount(flat // BUCKETS, weights[flat % BUCKETS], len(texts))


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of text and other columns -> the other columns and ``features``."""
    for whole in batches:
        for batch, texts in text_slices(whole, "text"):
            flat, at = document_features(texts)
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32)))], [*rest, "features"])


class Sparse:
    """Binary rows over the features that enough rows have and whose rate differs enough between the classes of ``target``, and ``also`` some others."""

    def __init__(self, flat: np.ndarray, at: np.ndarray, target: np.ndarray, least: int = 5, apart: float = 3.0, also: np.ndarray | None = None):
        self.n = len(at) - 1
        row = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(at))
        df = np.bincount(flat, minlength=BUCKETS)
        hit = np.bincount(flat, target[row], BUCKETS)
        n, rate = max(self.n, 1), float(target.mean()) if len(target) else 0.0
        spread = np.sqrt(np.maximum(df * rate * (1 - rate) * (1 - df / n), 1e-9))
        self.kept = np.flatnonzero((df >= least) & (np.abs(hit - df * rate) > apart * spread))
        if also is not None:
            self.kept = np.union1d(self.kept, also)
        place = np.full(BUCKETS, -1, np.int32)
        place[self.kept] = np.arange(len(self.kept))
        self.col = place[flat]
        use = self.col >= 0
        self.col, self.row = self.col[use], row[use]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.row], len(self.kept))

    def spread(self, w: np.ndarray) -> np.ndarray:
        """Weights by bucket."""
        out = np.zeros(BUCKETS)
        out[self.kept] = w
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def descend(value_and_gradient, start: np.ndarray, rounds: int = 120, memory: int = 12) -> np.ndarray:
    """Limited-memory quasi-Newton descent with step halving, for smooth convex losses."""
    x = start.copy()
    value, grad = value_and_gradient(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        turn, saved = grad.copy(), []
        for s, y in reversed(past):
            a = (s @ turn) / (s @ y)
            turn -= a * y
            saved.append(a)
        if past:
            s, y = past[-1]
            turn *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(saved), strict=True):
            turn += (a - (y @ turn) / (s @ y)) * s
        slope, step = -(turn @ grad), 1.0
        if slope > -1e-10:
            break
        while step > 1e-8:
            new, new_grad = value_and_gradient(x - step * turn)
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * turn, new_grad - grad
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y)]
        x, value, grad = x + s, new, new_grad
    return x
