"""Web archives in ZIP packages: a writer of WARC records and a reader that never extracts.

A package holds two stored members: ``archive/data.warc`` and ``indexes/index.cdxj`` with one line
per record (its offset and length in the first). The reader parses the end-of-central-directory
record, its ZIP64 counterpart and the central directory, finds where stored members begin from
their local headers, reads the index, and then reads records by byte ranges.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, join_path, new_folder, written

DATA, INDEX = "archive/data.warc", "indexes/index.cdxj"
#: A package is closed once it holds this many bytes of records.
PACKAGE_BYTES = 64 << 20
#: Records within this many bytes are fetched by one read.
READ_BYTES = 4 << 20
#: Payloads of fewer bytes are never revisited.
REVISIT_BYTES = 100

_END, _END64, _LOCATOR64 = struct.Struct("<4s4H2LH"), struct.Struct("<4sQ2H2L4Q"), struct.Struct("<4sLQL")
_CENTRAL, _LOCAL = struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


class Member(NamedTuple):
    name: str
    method: int
    size: int
    packed: int
    header: int
    crc: int


def members(read_at, size: int) -> dict[str, Member]:
    """The central directory of a ZIP of ``size`` bytes; ``read_at(place, length)`` gives bytes."""
    tail_at = max(0, size - _END.size - _FULL16)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0:
        if at + _END.size <= len(tail) and at + _END.size + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no ZIP: the end of the central directory is missing")
    _, _, _, _, count, length, place, _ = _END.unpack_from(tail, at)
    if count == _FULL16 or length == _FULL32 or place == _FULL32:
        locator = read_at(tail_at + at - _LOCATOR64.size, _LOCATOR64.size) if tail_at + at >= _LOCATOR64.size else b""
        if locator[:4] == b"PK\x06\x07":
            end64 = _END64.unpack(read_at(_LOCATOR64.unpack(locator)[2], _END64.size))
            if end64[0] != b"PK\x06\x06":
                raise ValueError("damaged ZIP64 end of the central directory")
            count, length, place = end64[7:10]
    raw, at, found = read_at(place, length), 0, {}
    for _ in range(count):
        f = _CENTRAL.unpack_from(raw, at)
        if f[0] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        flags, method, crc, packed, full, names, extras, comments, header = f[3], f[4], f[7], f[8], f[9], f[10], f[11], f[12], f[16]
        name = raw[at + _CENTRAL.size : at + _CENTRAL.size + names]
        extra = raw[at + _CENTRAL.size + names : at + _CENTRAL.size + names + extras]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<2H", extra)
            if kind == 1:  # ZIP64: only the values that do not fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = next(wide) if full == _FULL32 else full
                packed = next(wide) if packed == _FULL32 else packed
                header = next(wide) if header == _FULL32 else header
            extra = extra[4 + n :]
        text = name.decode("utf-8" if flags & 0x800 else "cp437")
        found[text] = Member(text, method, full, packed, header, crc)
        at += _CENTRAL.size + names + extras + comments
    return found


def data_start(read_at, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    f = _LOCAL.unpack(read_at(member.header, _LOCAL.size))
    if f[0] != b"PK\x03\x04":
        raise ValueError(f"damaged local header of {member.name}")
    return member.header + _LOCAL.size + f[9] + f[10]


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the record of page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
              ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record; fails on a wrong frame or digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    warc = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(warc["content-length"])
    if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    head, _, payload = rest[:n].partition(b"\r\n\r\n")
    http = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    if warc["warc-type"] == "response" and "sha256:" + hashlib.sha256(payload).hexdigest() != warc["warc-payload-digest"]:
        raise ValueError("payload does not match its digest")
    return warc, http, payload


class PackageWriter:
    """A package of records as a stream; nothing of it is held but the index."""

    def __init__(self, sink):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, raw: bytes, key: str, kind: str) -> None:
        self.data.write(raw)
        self.lines.append(f"{key} 19700101000000 {json.dumps({'mime': 'text/html' if kind == 'response' else 'warc/revisit', 'offset': str(self.size), 'length': str(len(raw)), 'filename': 'data.warc'})}\n")
        self.size += len(raw)

    def close(self) -> int:
        self.data.close()
        with self.zip.open(INDEX, "w") as index:
            for line in self.lines:
                index.write(line.encode())
        self.zip.close()
        return len(self.lines)


def read_index(read_at, size: int) -> tuple[int, list[tuple[int, int]]]:
    """Where the records of a package begin, and (offset, length) of each."""
    found = members(read_at, size)
    index = found[INDEX]
    lines = read_at(data_start(read_at, index), index.size).decode().splitlines()
    places = [json.loads(x[x.index("{") :]) for x in lines]
    return data_start(read_at, found[DATA]), [(int(p["offset"]), int(p["length"])) for p in places]


_MANIFEST = "path string, bytes long, records long"


def marked_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """-> page_id, url, html (null: empty), digest, refers_to: what each page's record revisits (null: it is a response).

    Only digests of several pages are joined back; their number, not the pages', decides
    whether Spark broadcasts them, and a digest of very many pages is split by adaptive execution.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    many = rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    # Written first, so that its size is known when Spark chooses between a broadcast and a shuffle of all payloads.
    many = written(many, "repeated")
    return rows.join(many, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One record per row of ``pages`` into ZIP packages in ``folder``; returns their manifest (path, bytes, records).

    Rows of equal payload (of ``REVISIT_BYTES`` bytes or more) revisit the one of smallest id; a row without an id revisits too, and never is the one
    revisited. A null url has no target field, a null payload is empty, repeated rows are records of their own (rows that repeat the smallest id are
    responses). Every attempt of a task writes files of its own, and only those in the manifest count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        package, sink, path = None, None, ""

        def closed() -> pa.RecordBatch:
            records = package.close()
            size = sink.tell()
            sink.close()
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [records]})

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                page_id, url, html, digest, refers_to = (x.as_py() for x in row)
                if package is None:
                    store.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.wacz"
                    path, sink = join_path(folder, name), store.open_output_stream(join_path(base, name))
                    package = PackageWriter(sink)
                package.add(record(page_id, url, html.encode(), digest, refers_to), re.sub(r"\s", "_", str(page_id)), "response" if refers_to is None else "revisit")
                if package.size >= package_bytes:
                    yield closed()
                    package = None
        if package is not None:
            yield closed()

    return written(marked_pages(pages, id_col, url_col, payload_col).mapInArrow(write, _MANIFEST), "packages")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of all packages -> page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null for a revisit).

    A payload's size is that of the HTTP head, which a revisit keeps; a response's digest is checked against its payload.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    number = re.compile(r"<urn:page:(-?\d*)>")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = file_system(row["path"])
                with store.open_input_file(path) as file:
                    def read_at(place: int, length: int) -> bytes:
                        return file.read_at(length, place)

                    start, places = read_index(read_at, row["bytes"])
                    k = 0
                    while k < len(places):
                        to = k + 1
                        while to < len(places) and places[to][0] + places[to][1] - places[k][0] <= READ_BYTES and places[to][0] >= places[k][0]:
                            to += 1
                        first = places[k][0]
                        raw = read_at(start + first, places[to - 1][0] + places[to - 1][1] - first)
                        rows = []
                        for at, length in places[k:to]:
                            warc, http, payload = parse_record(raw[at - first : at - first + length])
                            own, other = (number.fullmatch(warc.get(f, "")) for f in ("warc-record-id", "warc-refers-to"))
                            rows.append((int(own[1]) if own and own[1] else None, warc.get("warc-target-uri"), int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha256:"),
                                         warc["warc-type"], int(other[1]) if other else None, payload if warc["warc-type"] == "response" else None))
                        columns = list(zip(*rows, strict=True))
                        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + with_payload]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], [f.split(" ")[0] for f in schema.split(", ")])
                        k = to

    # One task per shuffle partition, however few bytes the manifest has.
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(tasks, "path").mapInArrow(read, schema)


def archived_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to packages in a folder of their own and read them back."""
    return read_archives(write_archives(pages, folder or new_folder(pages.sparkSession, "archives")))
