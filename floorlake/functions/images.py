"""Small picture codec used inside tasks: Pillow where it is installed, plain PNG otherwise."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

try:
    from PIL import Image
except ImportError:
    Image = None

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def encode_png(grid: np.ndarray) -> bytes:
    """8-bit RGB array to PNG bytes."""
    h, w = grid.shape[:2]
    raw = np.hstack([np.zeros((h, 1), np.uint8), grid.astype(np.uint8).reshape(h, -1)]).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode(content: bytes) -> np.ndarray | None:
    """RGB array (height, width, 3) of 0..255, or None when the bytes are not a readable picture."""
    try:
        content = bytes(content)
        if Image is not None:
            return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))
        return _decode_png(content)
    except Exception:  # noqa: BLE001 - any damage means "not readable"
        return None


def _decode_png(content: bytes) -> np.ndarray | None:
    if not content.startswith(SIGNATURE):
        return None
    at, data, head = 8, b"", None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at:at + 8])
        body = content[at + 8:at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        data += body if kind == b"IDAT" else b""
        at += size + 12
    w, h, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlace or channels is None:
        return None
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.int64)
    for y in range(h):
        kind, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        up = out[y - 1] if y else np.zeros_like(line)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) % 256
        else:
            for x in range(len(line)):
                left = out[y, x - channels] if x >= channels else 0
                corner = up[x - channels] if x >= channels else 0
                guess = left if kind == 1 else (left + up[x]) // 2 if kind == 3 else min((left, up[x], corner), key=lambda v: abs(left + up[x] - corner - v))
                out[y, x] = (line[x] + guess) % 256
    grid = out.reshape(h, w, channels)
    return grid[:, :, :3] if channels >= 3 else np.repeat(grid[:, :, :1], 3, axis=2)
