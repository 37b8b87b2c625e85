"""Word shingle hashes of many texts at once, over their raw UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Word separators of the shingle definition: space and the five ASCII controls from tab on.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_RANDOM = np.random.default_rng(20240229)
_CODE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_CODE[ord("A"):ord("Z") + 1] = _CODE[ord("a"):ord("z") + 1]
_BASE = int(_RANDOM.integers(1, 2**63, dtype=np.uint64)) | 5
_UNBASE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing permutation of 64-bit values, so that high and low bits are equally good."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _UNBASE, np.uint64)
        up[0] = down[0] = 1
        if size > 1 << 20:  # a very long text, or many at once: not kept
            return np.cumprod(up), np.cumprod(down)
        _POWERS.clear()
        _POWERS[size] = np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


def word_hashes(texts: pa.Array, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (ASCII case folded), and the number of words of each text.

    ``breaks`` tells for each byte whether it parts words.

    A word hash is a polynomial over per-byte random codes modulo 2**64, taken from differences of
    one running sum, so no Python object is made for a word.
    """
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    lo, hi = int(ends[0]), int(ends[-1])
    if n == 0 or hi == lo:
        return np.empty(0, np.uint64), np.zeros(n, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8, hi - lo, lo)
    ends = ends - lo
    inside = ~breaks[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = ends[1:-1]
    cut = cut[cut < len(data)]
    first[cut] |= inside[cut]  # a word never runs on into the next text
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tail = cut[cut > 0] - 1
    last[tail] |= inside[tail]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(data))
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * up[: len(data)], out=running[1:])
    words = mix((running[stops] - running[starts]) * down[starts])
    return words, np.diff(np.searchsorted(starts, ends))


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, as one flat array and offsets per text.

    A text with fewer than ``width`` words has its whole word sequence as its only shingle; one
    without words has none.
    """
    words, counts = word_hashes(texts)
    at = np.concatenate([[0], np.cumsum(counts)])
    rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(rolled)]
    rolled = mix(rolled)
    sets, sizes = [], np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        lo, hi = at[i], at[i + 1]
        if hi - lo >= width:
            own = np.sort(rolled[lo : hi - width + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif hi > lo:
            short = np.uint64(hi - lo)
            for w in words[lo:hi]:
                short = np.uint64((int(short) * 0x9E3779B97F4A7C15 + int(w)) & 0xFFFFFFFFFFFFFFFF)
            own = mix(np.array([short], np.uint64))
        else:
            continue
        sets.append(own)
        sizes[i] = len(own)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])
