"""Texts as sequences of units that a tokenizer treats on their own, each encoded once a batch."""

from __future__ import annotations

import itertools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units whose ids a worker keeps between batches, unless told otherwise; the others are encoded anew in each batch.
KEPT_UNITS = 150_000
#: Pieces that are encoded as one text.
JOINT = 1024

_WHITE = "\\s\\x0b\\x1c-\\x1f\\x85\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
#: A blank that no unit may begin with: it belongs to a longer run of white space.
_RUN = f"[{_WHITE}] ([{_WHITE}]|$)"
#: Separators for some readers that are none for the tokenizers' patterns.
_ODD = "[\\x1c-\\x1f]"
#: Letters, then ASCII punctuation: both tokenizers part them.
_WORD = r"^(?P<head> ?\p{L}+)(?P<tail>[!-/:-@\[-`{-~]*)$"

Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def gather(ids: np.ndarray, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered ``codes`` of (ids, at), one after the other, with their offsets."""
    lengths = np.diff(at)[codes]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return ids[np.repeat(at[codes] - ends[:-1], lengths) + np.arange(ends[-1])], ends


class UnitEncoder:
    """Ids of many texts from the ids of their units.

    A blank before a visible character always begins a new piece for both public tokenizers, so a
    text may be cut there; units of letters and punctuation are parted once more. ``encode`` maps
    strings to (ids, offsets). With ``blanks`` a unit carries the blank before it; without, white
    space is dropped and letters are folded. Texts in which a blank belongs to a longer run of
    white space go whole to ``encode``.
    """

    def __init__(self, encode: Encode, blanks: bool, kept: int = KEPT_UNITS):
        self.encode, self.blanks, self.most = encode, blanks, kept
        self.known: dict[str, int] = {}
        self.kept, self.kept_at = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, from those kept or by ``encode``."""
        places = np.fromiter(map(self.known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(places < 0)
        new, new_at = self.encode([pieces[i] for i in missing])
        places[missing] = len(self.kept_at) - 1 + np.arange(len(missing))
        ids, at = np.concatenate([self.kept, new]), np.concatenate([self.kept_at, self.kept_at[-1] + new_at[1:]])
        room = min(self.most - len(self.known), len(missing))
        if room > 0:
            for i in missing[:room]:
                self.known[pieces[i]] = len(self.known)
            self.kept, self.kept_at = ids[: at[len(self.known)]].copy(), at[: len(self.known) + 1].copy()
        return gather(ids, at, places)

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units."""
        parts = pc.extract_regex(units, _WORD)
        plain = pa.compute.is_valid(parts)
        head, tail = parts.field("head"), parts.field("tail")
        if not self.blanks:
            head = pc.ascii_lower(head)
        head = pc.if_else(plain, head, units)
        tail = pc.if_else(plain, tail, pa.scalar("", units.type))
        pieces = pa.concat_arrays([head, tail]).dictionary_encode()
        ids, at = self._ids_of(pieces.dictionary.to_pylist())
        codes = pieces.indices.to_numpy().reshape(2, -1).T.ravel()
        ids, at = gather(ids, at, codes)
        return ids, at[::2]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``texts``: large_string without nulls -> flat ids (int32) and offsets per text."""
        if not len(texts):
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        odd = pc.match_substring_regex(texts, _RUN if self.blanks else _ODD)
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(pc.if_else(odd, pa.scalar("", texts.type), texts), " ")
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = pc.dictionary_encode(lists.flatten())
        codes, units = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        if self.blanks:
            # The first unit of a text has no blank before it.
            first, place = np.unique(codes[bounds[:-1]], return_inverse=True)
            codes[bounds[:-1]] = len(units) + place
            blank = pc.binary_join_element_wise(pa.scalar(" ", units.type), units, pa.scalar("", units.type))
            units = pa.concat_arrays([blank, units.take(pa.array(first))])
        ids, at = self._units(units)
        out, ends = gather(ids, at, codes)
        offsets = ends[bounds]
        if len(whole):
            own, own_at = self.encode(texts.take(pa.array(whole)).to_pylist())
            parts, sizes, done = [], np.diff(offsets), 0
            for k, i in enumerate(whole):
                parts += [out[done : offsets[i]], own[own_at[k] : own_at[k + 1]]]
                done = offsets[i + 1]
                sizes[i] = own_at[k + 1] - own_at[k]
            out, offsets = np.concatenate([*parts, out[done:]]), np.concatenate([[0], np.cumsum(sizes)])
        return out, offsets


_LIBRARY: dict[tuple[str, bool], UnitEncoder] = {}


def library_encoder(path: str, blanks: bool, kept: int = KEPT_UNITS) -> UnitEncoder:
    """The encoder of this worker process for a file of the tokenizers library; a worker holds one at a time."""
    if (path, blanks) not in _LIBRARY:
        _LIBRARY.clear()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()

        # Bytes of each id: the byte-level vocabulary writes every byte as one character.
        size = np.array([len(tokenizer.id_to_token(i).removesuffix("</w>")) for i in range(tokenizer.get_vocab_size())], np.int64)

        def alone(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            lists = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes

        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Short pieces of letters are encoded as one text of many, which is then parted by byte lengths; the rest one by one."""
            ok = np.fromiter((len(t) < 100 and (t[:1] == " " and t[1:].isalpha() if blanks else t.isalpha()) for t in texts), bool, len(texts))
            rest, done = [np.flatnonzero(~ok)], []
            joint = np.flatnonzero(ok)
            for k in range(0, len(joint), JOINT):
                some = joint[k : k + JOINT]
                own = [texts[i] for i in some]
                ids = np.array(tokenizer.encode_batch_fast([("" if blanks else " ").join(own)], add_special_tokens=False)[0].ids, np.int32)
                ends, marks = np.cumsum(size[ids]), np.cumsum(np.fromiter((len(t.encode()) for t in own), np.int64, len(own)))
                cuts = np.searchsorted(ends, marks)
                if len(ends) and cuts[-1] == len(ends) - 1 and (ends[np.minimum(cuts, len(ends) - 1)] == marks).all():
                    done.append((some, ids, np.diff(cuts, prepend=-1)))
                else:
                    rest.append(some)
            single = np.concatenate(rest)
            for k in range(0, len(single), 4096):
                some = single[k : k + 4096]
                done.append((some, *alone([texts[i] for i in some])))
            if not done:
                return np.empty(0, np.int32), np.zeros(1, np.int64)
            index, ids, sizes = (np.concatenate(x) for x in zip(*done, strict=True))
            return gather(ids, np.concatenate([[0], np.cumsum(sizes)]), np.argsort(index))

        _LIBRARY[path, blanks] = UnitEncoder(encode, blanks, kept)
    return _LIBRARY[path, blanks]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The id ``end`` after the ids of each text."""
    return np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))


def each(ids: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        yield ids[lo:hi]
