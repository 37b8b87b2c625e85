"""BPE, token files and packing: against the tokenizers library and exact round trips."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from floorlake.llm import packing, tokenfile
from floorlake.llm.bpe import LONG_PIECE, MergeList, StreamingEncoder, TextDecoder, decode_documents, encode_documents, round_trip_digests
from floorlake.llm.units import library_encoder

BYTES, WORDS = path("byte_bpe_50k.json"), path("word_bpe_49k.json")
HARD = ["", "a  b", " x", "x ", "x \n y\n\n  z", "a\n \nX", "<|endoftext|>a <|endoftext|> b<|endo", "it's'll  x\x1cy \x1c z", "  x  y", "É é ǅ İ Σ ΑΣ", "a" * 500 + " " + "!" * 300, "tab\t x \ty", "  ", " ", "\n",
        "a\u0085 b", "a \u0085b c", "日本語テキスト🙂🙂", "the" * 3000, " " * 9000 + "x", "!'" * 5000 + "s", "́x" * 30, "12345 67 ²³", "aaaa" * 3000 + "'s", " \n" * 4000, "é É, foo-bar. \"Don't!\" foo. Foo, foo"]


def plain(file):
    t = Tokenizer.from_file(file)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def merges():
    return MergeList(BYTES)


def test_streaming_encoder_is_the_library(merges):
    rnd, library, encoder, held = random.Random(1), plain(BYTES), StreamingEncoder(merges), 0
    for text in HARD:
        want = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == want
        got, at = [], 0
        while at < len(text):
            n = rnd.choice([1, 2, 7, 100, 3000])
            got += encoder.feed(text[at : at + n])
            at += n
            held = max(held, len(encoder.text) + len(encoder.pieces.held))
        assert got + encoder.finish() == want
    assert held < 2 * LONG_PIECE
    assert merges.sufficient_lookahead() == max(len(merges.bytes_of[i]) for i in merges.made)


def test_decoder_is_the_library(merges):
    rnd, library, decoder = random.Random(2), plain(BYTES), TextDecoder(merges)
    for _ in range(200):
        ids = [rnd.choice([rnd.randrange(256), rnd.randrange(50257)]) for _ in range(rnd.randrange(12))]
        text = "".join(decoder.feed(np.array([i])) for i in ids) + decoder.finish()
        assert text == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize(("file", "blanks"), [(BYTES, True), (WORDS, False)])
def test_units_give_the_ids_of_whole_texts(file, blanks):
    library = plain(file)
    ids, at = library_encoder(file, blanks)(pa.array(HARD * 2, pa.large_string()))
    for i, text in enumerate(HARD * 2):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text[:60]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, ids string")


def test_documents_round_trip(spark):
    rows = list(enumerate(HARD)) + [(3, HARD[4]), (None, "a"), (99, None)]
    encoded = encode_documents(frame(spark, rows), BYTES)
    decoded = collections.Counter(map(tuple, decode_documents(encoded, BYTES).collect()))
    assert decoded == collections.Counter((i, t or "") for i, t in rows)
    assert round_trip_digests(frame(spark, rows), BYTES).count() == len(rows)
    assert round_trip_digests(frame(spark, []), BYTES).collect() == []


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, tokenfile.BLOCK, tokenfile.BLOCK + 1, 3 * tokenfile.BLOCK + 5])
def test_segments_round_trip_and_detect_damage(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.2, n) % 50257).astype(np.int32)
    offsets = np.concatenate([[0], np.sort(rng.integers(0, n + 1, 4)), [n]])
    raw = tokenfile.encode_segment(np.arange(5), np.array([True] * 4 + [False]), ids, offsets)
    doc_ids, known, got, at = tokenfile.decode_segment(raw)
    assert (got == ids).all() and (at == offsets).all() and doc_ids.tolist() == [0, 1, 2, 3, 4] and known.tolist() == [True] * 4 + [False]
    for place in rng.integers(8, len(raw), 5):
        broken = bytearray(raw)
        broken[place] ^= 4
        try:
            same = (tokenfile.decode_segment(bytes(broken))[2] == ids).all()
        except Exception:  # noqa: BLE001
            same = True
        assert same


def test_frequencies_fill_the_range():
    for counts in ([1], [1, 10**9], [10**6] * 50257, list(range(1, 60000)), [5, 5, 5]):
        freq = tokenfile.scaled(np.array(counts))
        assert freq.sum() == 1 << tokenfile.BITS and freq.min() >= 1


def test_token_files_keep_documents_in_order(spark):
    rows = [(i * 7 % 26, t) for i, t in enumerate(HARD)] + [(None, "null id"), (None, "null id"), (100, None), (100, "x"), (100, "x")]
    library = plain(BYTES)
    got = tokenfile.token_file_documents(frame(spark, rows).repartition(3), BYTES).orderBy("start").collect()
    assert len(got) == len(rows)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    at, want = 0, collections.Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert tokenfile.token_file_documents(frame(spark, []), BYTES).collect() == []


def test_open_windows_give_the_tightest():
    rnd, windows, open_now = random.Random(3), packing.OpenWindows(2048), []
    for k in range(20000):
        if rnd.random() < 0.5:
            c = rnd.randint(1, 2047)
            windows.put(c, k)
            open_now.append(c)
        else:
            length = rnd.randint(1, 2047)
            want = min((c for c in open_now if c >= length), default=None)
            got = windows.take(length)
            assert (got and got[0]) == want
            if want:
                open_now.remove(want)


def test_packing_is_best_fit_decreasing(spark):
    rnd = random.Random(9)
    lengths = [rnd.randint(1, 60) for _ in range(400)] + [100] * 3
    pieces = spark.createDataFrame([(i, 0, n, i, n) for i, n in enumerate(lengths)], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    got = packing.pack_pieces(pieces, 1, window=100).collect()
    room, used = [], 0
    for n in sorted(lengths, reverse=True):
        fit = min((c for c in room if c >= n), default=None)
        if fit is None:
            used += 1
            room.append(100 - n)
        else:
            room.remove(fit)
            room.append(fit - n)
    check_windows(got, 100)
    assert len({r.sequence_id for r in got}) == used


def check_windows(rows, window):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window


def test_documents_are_packed_whole(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(3, HARD[4]), (None, "a b c"), (99, None), (77, "word " * 9000)]
    library = plain(WORDS)
    got = packing.pack_documents(frame(spark, rows), WORDS, group=10).collect()
    check_windows(got, packing.WINDOW)
    want = collections.Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), packing.WINDOW):
            part = ids[k : k + packing.WINDOW]
            want[i, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    assert packing.pack_documents(frame(spark, []), WORDS).collect() == []
