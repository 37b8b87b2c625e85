"""Byte-level BPE as a streaming transducer, and the decoder back to text.

Let last(i) be the last token of the encoding of a text's first i bytes. Merges never cross a
boundary that stays, so the encoding of i bytes is the encoding of i - len(last(i)) bytes
and then last(i); and of all tokens that end at i exactly one may follow the last token before it:
the one with which no merge ever joins. So last(i) is found from left to right, from the matches of
an automaton over the vocabulary that end at i.

Lookahead. No token is longer than the longest product M of the merge list, so the encoding of
any longer text passes through a boundary among the last M positions read. What the paths of these
M positions share can no longer change and is emitted; M bytes of lookahead suffice, and only the
bytes behind the last shared boundary are held.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .units import UnitEncoder, gather

# The pattern by which byte-level tokenizers part texts before merging.
_PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_CLASSES = {"letters": regex.compile(r"\p{L}*"), "numbers": regex.compile(r"\p{N}*"), "others": regex.compile(r"[^\s\p{L}\p{N}]*"), "blanks": regex.compile(r"\s*")}
#: A piece that is longer than this is merged while it is read.
LONG_PIECE = 4096
_NEVER = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files -> byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeList:
    """Vocabulary and ordered merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = vocab[left], vocab[right]
            self.rank.setdefault((a, b), rank)
            self.made.setdefault(vocab[left + right], (a, b, rank))
        self.longest = self.sufficient_lookahead()
        self.automaton = ahocorasick.Automaton()
        for i, raw in self.bytes_of.items():
            if i in self.made or (len(raw) == 1 and i not in self.special.values()):
                self.automaton.add_word(raw.decode("latin-1"), (i, len(raw)))
        self.automaton.make_automaton()
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._follows: dict[tuple[int, int], bool] = {}

    def sufficient_lookahead(self) -> int:
        """Bytes behind a boundary after which it is final once all paths agree on it: the longest product."""
        return max((len(self.bytes_of[i]) for i in self.made), default=1)

    def _spine(self, token: int, side: int, known: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """The tokens at one edge of ``token`` in the order of merging, each with the rank that ends it."""
        found = known.get(token)
        if found is None:
            rule = self.made.get(token)
            if rule is None:
                found = [(token, _NEVER)]
            else:
                inner = self._spine(rule[side], side, known)
                found = [*inner[:-1], (inner[-1][0], rule[2]), (token, _NEVER)]
            known[token] = found
        return found

    def follows(self, a: int, b: int) -> bool:
        """Whether ``b`` may stand behind ``a``: no merge joins what stands at their common edge at any time."""
        known = self._follows.get((a, b))
        if known is not None:
            return known
        xs, ys = self._spine(a, 1, self._right), self._spine(b, 0, self._left)
        rank, i, j = self.rank, 0, 0
        while True:
            (x, x_end), (y, y_end) = xs[i], ys[j]
            merged = rank.get((x, y), _NEVER)
            # Of two merges of one rank the left one is done first.
            if merged < x_end and merged <= y_end and merged < _NEVER:
                result = False
                break
            if x_end == y_end == _NEVER:
                result = True
                break
            if x_end <= y_end:
                i += 1
            else:
                j += 1
        if len(self._follows) > 400_000:
            self._follows.clear()
        self._follows[a, b] = result
        return result


class PieceTransducer:
    """Bytes of one piece in, ids out as soon as they are stable."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.held, self.last = "", [(-1, 0)]

    def _read(self, raw: str) -> None:
        """Extend the last tokens over further bytes (as latin-1)."""
        keep = self.merges.longest - 1
        start = len(self.held)
        overlap = self.held[-keep:] if keep else ""
        shift = start - len(overlap)
        self.held += raw
        last, follows, at = self.last, self.merges.follows, start
        for end, (token, length) in self.merges.automaton.iter(overlap + raw):
            end += shift + 1
            if end > at and end - length >= 0:
                before = last[end - length][0]
                if before < 0 or follows(before, token):
                    last.append((token, length))
                    at = end

    def feed(self, raw: bytes) -> list[int]:
        self._read(raw.decode("latin-1"))
        n, longest = len(self.held), self.merges.longest
        if n < 4 * longest:
            return []
        # Walk all open paths back to the boundary that they share.
        open_ends = set(range(n - longest + 1, n + 1))
        while len(open_ends) > 1:
            far = max(open_ends)
            open_ends.remove(far)
            open_ends.add(far - self.last[far][1])
        shared = open_ends.pop()
        ids = self._path(shared)
        if ids:
            before = self.last[shared][0]
            self.held, self.last = self.held[shared:], [(before, 0), *self.last[shared + 1 :]]
        return ids

    def _path(self, end: int) -> list[int]:
        ids = []
        while end > 0:
            token, length = self.last[end]
            ids.append(token)
            end -= length
        return ids[::-1]

    def finish(self) -> list[int]:
        ids = self._path(len(self.held))
        self.held, self.last = "", [(-1, 0)]
        return ids


class StreamingEncoder:
    """Text in, ids out; holds a bounded tail of the text whatever its length and make-up."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.pieces = PieceTransducer(merges)
        self.text, self.run = "", ""

    def encode(self, text: str) -> list[int]:
        if (text[1:] if text[:1] == " " else text).isalpha() and len(text) < LONG_PIECE:
            self.pieces._read(text.encode().decode("latin-1"))
            return self.pieces.finish()
        return self.feed(text) + self.finish()

    def feed(self, text: str) -> list[int]:
        self.text += text
        ids: list[int] = []
        while True:
            hits = [(at, s) for s in self.merges.special if (at := self.text.find(s)) >= 0]
            if not hits:
                break
            at, special = min(hits)
            rest, self.text = self.text[at + len(special) :], self.text[:at]
            ids += self._pieces(len(self.text), True) + [self.merges.special[special]]
            self.text = rest
        ready = len(self.text)
        for special in self.merges.special:
            for k in range(min(len(special) - 1, len(self.text)), 0, -1):
                if self.text.endswith(special[:k]):
                    ready = min(ready, len(self.text) - k)
                    break
        return ids + self._pieces(ready, False)

    def finish(self) -> list[int]:
        return self._pieces(len(self.text), True)

    def _pieces(self, ready: int, final: bool) -> list[int]:
        """Ids of the pieces in the first ``ready`` characters that no further text can change; of all if ``final``."""
        ids: list[int] = []
        text, at = self.text[:ready], 0
        if self.run:
            at = self._run_on(text, 0, final, ids)
        while at < len(text):
            found = _PIECES.match(text, at)
            stop = found.end()
            if final or stop <= len(text) - 3:
                ids += self._piece(text[at:stop])
                at = stop
            elif stop - at > LONG_PIECE:
                first = text[at + (text[at] == " " and stop - at > 1) :][:1]
                self.run = "blanks" if first.isspace() else "letters" if regex.match(r"\p{L}", first) else "numbers" if regex.match(r"\p{N}", first) else "others"
                if self.run != "blanks" and text[at] == " ":
                    ids += self.pieces.feed(b" ")
                    at += 1
                at = self._run_on(text, at, final, ids)
                if self.run:
                    break
            else:
                break
        self.text = text[at:] + self.text[ready:]
        return ids

    def _run_on(self, text: str, at: int, final: bool, ids: list[int]) -> int:
        """Feed on a long piece of one class; the last blank of a run waits, as it may belong to the next piece."""
        stop = _CLASSES[self.run].match(text, at).end()
        over = final or stop < len(text)
        if self.run == "blanks" and stop > at and not (final and stop == len(text)):
            stop -= 1
        for k in range(at, stop, 1024):
            ids += self.pieces.feed(text[k : min(k + 1024, stop)].encode())
        if over:
            ids += self.pieces.finish()
            self.run = ""
        return stop

    def _piece(self, piece: str) -> list[int]:
        raw, ids = piece.encode(), []
        if len(raw) > LONG_PIECE:
            for k in range(0, len(raw), 1024):
                ids += self.pieces.feed(raw[k : k + 1024])
        else:
            self.pieces._read(raw.decode("latin-1"))
        return ids + self.pieces.finish()


class TextDecoder:
    """Ids in, text out: a UTF-8 state machine that holds at most three bytes of an unfinished character."""

    def __init__(self, merges: MergeList):
        size = max(merges.bytes_of) + 1
        self.flat = np.frombuffer(b"".join(merges.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(merges.bytes_of.get(i, b"")) for i in range(size)])])
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        return self.machine.decode(gather(self.flat, self.at, ids)[0].tobytes())

    def finish(self) -> str:
        text = self.machine.decode(b"", True)
        self.machine.reset()
        return text


_MODELS: dict[str, tuple[UnitEncoder, TextDecoder]] = {}


def model(path: str) -> tuple[UnitEncoder, TextDecoder]:
    """Encoder of many texts and decoder of this worker process for a vocabulary file."""
    if path not in _MODELS:
        merges = MergeList(path)
        streaming = StreamingEncoder(merges)

        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [streaming.encode(t) for t in texts]
            at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
            return np.fromiter((i for x in found for i in x), np.int32, int(at[-1])), at

        _MODELS[path] = UnitEncoder(encode, True), TextDecoder(merges)
    return _MODELS[path]


def encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = model(path)
        for whole in batches:
            for batch, texts in text_slices(whole, "text"):
                ids, at = encoder(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``: id, text -> doc_id, ids (array of int), one row per row; a null text counts as empty, an empty text has no ids.

    Ids are those of the tokenizers library for the file at ``path`` without added special tokens; special strings in a text
    are their ids. Row order, nulls and repeats of ids and other columns do not matter.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode_batches(path), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids -> doc_id, text; bytes that are no UTF-8 become replacement characters; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = model(path)
        for batch in batches:
            texts = [decoder.feed(np.asarray(ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else [], np.int64)) + decoder.finish() for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of what ``encode_documents`` and ``decode_documents`` give for each row, in one pass over the texts.

    -> doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256
    (the decoded text in UTF-8).
    """
    import hashlib

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = model(path)
        for whole in batches:
            for batch, texts in text_slices(whole, "text"):
                ids, at = encoder(texts)
                ids_sha, text_sha = [], []
                for lo, hi in zip(at[:-1], at[1:], strict=True):
                    ids_sha.append(hashlib.sha256(ids[lo:hi].astype("<u4").tobytes()).hexdigest())
                    seen = hashlib.sha256()
                    for k in range(lo, hi, 1 << 16):
                        seen.update(decoder.feed(ids[k : min(k + (1 << 16), hi)]).encode())
                    seen.update(decoder.finish().encode())
                    text_sha.append(seen.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
