"""Token-id files: blocks coded by a static range asymmetric numeral system, and their readers.

A file is a row of segments and a directory of them. A segment holds whole documents in order:

    frequency table   symbols and their frequencies out of 2**16, shared by the segment's blocks
    blocks            ``LANES`` interleaved coders each, over up to ``BLOCK`` ids; independent
    checkpoints       per block: byte offset, words, ids, crc32 of the ids
    documents         id, number of ids

Every part is found from the segment's header, so any segment of any file is decoded on its own by
a range read, and any block of it from its checkpoint alone. Coders are 32 bits wide and
renormalise by 16-bit words; id i of a block belongs to lane i mod LANES, and all blocks of a segment advance
together as numpy vectors.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, join_path, new_folder, text_slices, trimmed, written
from .units import library_encoder, with_end

MAGIC = b"RANSIDS1"
LANES = 32
BLOCK = 1 << 15
#: Ids of one segment, but for a single longer document.
SEGMENT = 1 << 21
#: Bytes of text that are encoded at once, and units whose ids a worker keeps.
SLICE, KEPT = 8 << 20, 1_000_000
BITS = 16
_HEADER = struct.Struct("<8sQQQQQ")
_LOW = np.uint64(1 << 16)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**16, none of them zero, in proportion to ``counts`` (all positive)."""
    total, room = int(counts.sum()), 1 << BITS
    if len(counts) > room:
        raise ValueError("more symbols than slots")
    freq = np.maximum(1, counts * room // total)
    over = int(freq.sum()) - room
    if over < 0:
        freq[np.argmax(counts)] -= over
    while over > 0:  # taken from the largest, which lose least
        order = np.argsort(-freq, kind="stable")
        take = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * over // room))
        take = np.minimum(take, np.maximum(0, over - np.concatenate([[0], np.cumsum(take)[:-1]])))
        freq[order] -= take
        over -= int(take.sum())
    return freq


class Table:
    """Symbols of a segment with their ranges."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols, freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.most = self.freq << np.uint64(16)

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols)), self.freq.astype(np.int64))


def encode_blocks(codes: np.ndarray, table: Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """``codes``: blocks x steps x lanes of table indices -> states (blocks x lanes) and each block's words."""
    blocks, steps, lanes = codes.shape
    turns = np.ascontiguousarray(codes.transpose(1, 0, 2)).reshape(steps, blocks * lanes)
    freq, start, most = table.freq[turns], table.start[turns], table.most[turns]
    state = np.full(blocks * lanes, _LOW)
    word = np.empty((steps, blocks * lanes), np.uint16)
    out = np.empty((steps, blocks * lanes), bool)
    for s in range(steps - 1, -1, -1):
        spill = state >= most[s]
        out[s] = spill
        word[s] = state
        state = np.where(spill, state >> np.uint64(16), state)
        whole = state // freq[s]
        state += whole * (np.uint64(1 << BITS) - freq[s]) + start[s]
    out, word = out.reshape(steps, blocks, lanes), word.reshape(steps, blocks, lanes)
    return state.astype(np.uint32).reshape(blocks, lanes), [word[:, b][out[:, b]] for b in range(blocks)]


def decode_blocks(states: np.ndarray, words: list[np.ndarray], steps: int, table: Table) -> np.ndarray:
    """Inverse of ``encode_blocks``."""
    blocks, lanes = states.shape
    state, slots = states.astype(np.uint64).ravel(), table.slots()
    freq, ahead = table.freq[slots], np.arange(1 << BITS, dtype=np.uint64) - table.start[slots]
    stream = np.concatenate([*words, np.zeros(1, np.uint16)]).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]]).astype(np.int64)
    codes = np.empty((steps, blocks * lanes), np.int32)
    for s in range(steps):
        slot = (state & np.uint64(0xFFFF)).astype(np.int64)
        codes[s] = slots[slot]
        state = freq[slot] * (state >> np.uint64(BITS)) + ahead[slot]
        need = state < _LOW
        turn = np.cumsum(need.reshape(blocks, lanes), axis=1)
        place = (at[:, None] + turn - 1).ravel()[need]
        state[need] = (state[need] << np.uint64(16)) | stream[place]
        at += turn[:, -1]
    return codes.reshape(steps, blocks, lanes).transpose(1, 0, 2)


def _blocks(n: int) -> tuple[int, int]:
    """Number of blocks of a segment of ``n`` ids, and the ids in each but the last."""
    blocks = -(-n // BLOCK)
    return blocks, -(-n // blocks) if blocks else 0


def encode_segment(doc_ids: np.ndarray, known: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> bytes:
    """One segment: documents with their ids (null document ids by ``known``)."""
    counts = np.bincount(ids) if len(ids) else np.ones(1, np.int64)
    symbols = np.flatnonzero(counts)
    freq = scaled(counts[symbols])
    blocks, size = _blocks(len(ids))
    body, points = [], np.zeros((0, 4), "<u8")
    if blocks:
        places = np.zeros(len(counts), np.int32)
        places[symbols] = np.arange(len(symbols))
        steps = -(-size // LANES)
        padded = np.full((blocks, steps * LANES), int(np.argmax(freq)), np.int32)
        for k in range(blocks):
            own = ids[k * size : (k + 1) * size]
            padded[k, : len(own)] = places[own]
        states, words = encode_blocks(padded.reshape(blocks, steps, LANES), Table(symbols, freq))
        body = [s.astype("<u4").tobytes() + w.astype("<u2").tobytes() for s, w in zip(states, words, strict=True)]
        plain = ids.astype("<u4")
        sizes = [len(ids[k * size : (k + 1) * size]) for k in range(blocks)]
        crcs = [zlib.crc32(plain[k * size : (k + 1) * size].tobytes()) for k in range(blocks)]
        points = np.array([np.concatenate([[0], np.cumsum([len(b) for b in body])[:-1]]), [len(w) for w in words], sizes, crcs], "<u8").T
    parts = [symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), b"".join(body), points.tobytes(),
             doc_ids.astype("<i8").tobytes() + known.astype("u1").tobytes() + np.diff(offsets).astype("<i8").tobytes()]
    return _HEADER.pack(MAGIC, len(symbols), len(parts[1]), len(body), len(doc_ids), zlib.crc32(parts[0] + parts[2] + parts[3])) + b"".join(parts)


def decode_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """-> document ids, whether they are known, flat ids, offsets; fails on a wrong checksum."""
    magic, symbols_n, body_n, blocks_n, docs_n, crc = _HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("no segment of token ids")
    at = [_HEADER.size]
    for n in (8 * symbols_n, body_n, 32 * blocks_n, 17 * docs_n):
        at.append(at[-1] + n)
    if zlib.crc32(raw[at[0] : at[1]] + raw[at[2] : at[4]]) != crc:
        raise ValueError("damaged directory of a segment")
    lists = np.frombuffer(raw, "<u4", 2 * symbols_n, at[0])
    table = Table(lists[:symbols_n].astype(np.int32), lists[symbols_n:].astype(np.int64))
    points = np.frombuffer(raw, "<u8", 4 * blocks_n, at[2]).reshape(-1, 4).astype(np.int64)
    ids = np.empty(0, np.int32)
    if blocks_n:
        states = np.stack([np.frombuffer(raw, "<u4", LANES, at[1] + p[0]) for p in points])
        words = [np.frombuffer(raw, "<u2", p[1], at[1] + p[0] + 4 * LANES) for p in points]
        codes = decode_blocks(states, words, -(-int(points[0, 2]) // LANES), table).reshape(blocks_n, -1)
        rows = [table.symbols[row[: point[2]]] for row, point in zip(codes, points, strict=True)]
        for row, point in zip(rows, points, strict=True):
            if zlib.crc32(row.astype("<u4").tobytes()) != point[3]:
                raise ValueError("damaged block of token ids")
        ids = np.concatenate(rows)
    doc_ids = np.frombuffer(raw, "<i8", docs_n, at[3])
    known = np.frombuffer(raw, "u1", docs_n, at[3] + 8 * docs_n).astype(bool)
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i8", docs_n, at[3] + 9 * docs_n))])
    return doc_ids, known, ids, offsets


_MANIFEST = "shard int, segment int, path string, place long, bytes long, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of ``docs`` in ascending id order to files in ``folder``; returns their manifest.

    One file per range of ids, ``shards`` of them (as many as shuffle partitions unless given), so
    files in order of ``shard`` hold the documents in order. Null ids come first, rows of equal id are ordered by a
    hash of their text; a null text has the end id only. A task that is run again writes a file of
    another name, and only files in the manifest count, so lost executors leave no wrong data.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(shards, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, blanks=True, kept=KEPT)
        store, base = file_system(folder)
        sink, path, place, segment, shard = None, "", 0, 0, 0
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            nonlocal place, segment, waiting
            doc_ids, known = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
            sizes, ids = np.concatenate([np.diff(w[3]) for w in waiting]), np.concatenate([w[2] for w in waiting])
            waiting = []
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            lo = 0
            while lo < len(sizes):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SEGMENT, side="right")) - 1)
                raw = encode_segment(doc_ids[lo:hi], known[lo:hi], ids[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
                sink.write(raw)
                yield pa.RecordBatch.from_pylist([{"shard": shard, "segment": segment, "path": path, "place": place, "bytes": len(raw), "n_docs": hi - lo, "n_tokens": int(offsets[hi] - offsets[lo])}], schema=schema)
                place, segment, lo = place + len(raw), segment + 1, hi

        schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("path", pa.string()), ("place", pa.int64()), ("bytes", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
        for whole in batches:
            for batch, texts in text_slices(whole, "text", SLICE):
                if sink is None:
                    shard = batch.column("shard")[0].as_py()
                    store.create_dir(base, recursive=True)
                    name = f"{shard:06d}-{uuid.uuid4().hex}.ids"
                    path = join_path(folder, name)
                    sink = store.open_output_stream(join_path(base, name))
                known = np.asarray(batch.column("doc_id").is_valid())
                waiting.append((batch.column("doc_id").fill_null(0).to_numpy(), known, *with_end(*encoder(texts), end_id)))
                if sum(len(w[2]) for w in waiting) >= SEGMENT:
                    yield from flush()
        if waiting:
            yield from flush()
        if sink is not None:
            sink.close()

    return written(rows.mapInArrow(trimmed(write), _MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files of a manifest -> doc_id, start, n_tokens, ids_crc32 (and ids).

    Segments are dealt out to tasks and read by range. ``start`` counts the ids of all documents
    before, over all files in order.
    """
    # Sums run within a shard, and over the shards' totals: one row per file, which is one per task of the writer.
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("total")).select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("ahead"))
    local = manifest.select("shard", "segment", "path", "place", "bytes", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("here"))
    starts = local.join(totals, "shard").select("shard", "segment", "path", "place", "bytes", (F.col("here") + F.col("ahead")).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = file_system(row["path"])
                with store.open_input_file(path) as file:
                    raw = file.read_at(row["bytes"], row["place"])
                doc_ids, known, ids, offsets = decode_segment(raw)
                plain = ids.astype("<u4")
                crcs = [zlib.crc32(plain[lo:hi].tobytes()) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
                columns = [pa.array(doc_ids, mask=~known), pa.array(offsets[:-1] + row["base"]), pa.array(np.diff(offsets)), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in schema.split(", ")])

    # One task per shuffle partition, however few bytes the manifest has.
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return starts.repartition(tasks, "shard", "segment").mapInArrow(read, schema)


def token_file_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``docs`` to token files in a folder of their own and read them back."""
    folder = folder or new_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer, folder, end_id))
