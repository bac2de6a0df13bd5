"""Images are structs <bytes, path, width, height, mode>; sizes are columns, pixels are decoded only in Arrow batches.

A size that isn't given is read from the file's header.  PNG (8 bits, not interlaced)
and binary PPM/PGM are decoded here, the rest by Pillow where it is installed.
"""

from __future__ import annotations

import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from PIL import Image as Pillow
except ImportError:
    Pillow = None

IMAGE_TYPE = "struct<bytes: binary, path: string, width: int, height: int, mode: string>"
CHECK_TYPE = "struct<width: int, height: int, mode: string, readable: boolean>"
_PNG = b"\x89PNG\r\n\x1a\n"
_PNM = re.compile(rb"P[56]\s+(\d+)\s+(\d+)\s+\d+\s")
_MODES = {0: ("L", 1), 2: ("RGB", 3), 3: ("P", 1), 4: ("LA", 2), 6: ("RGBA", 4)}


def header(data: bytes) -> tuple[int, int, str] | None:
    """(width, height, mode) as a file's first bytes state it: PNG, PPM/PGM, JPEG, GIF, BMP."""
    if data[:8] == _PNG and len(data) >= 26 and data[12:16] == b"IHDR":
        w, h, _, colour = struct.unpack(">IIBB", data[16:26])
        return w, h, _MODES.get(colour, ("RGB", 3))[0]
    if data[:2] in (b"P5", b"P6"):
        head = _PNM.match(data)
        return (int(head[1]), int(head[2]), "L" if data[:2] == b"P5" else "RGB") if head else None
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return *struct.unpack("<HH", data[6:10]), "P"
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h), "RGB"
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if kind in (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
                h, w, channels = struct.unpack(">HHB", data[at + 5 : at + 10])
                return w, h, {1: "L", 4: "CMYK"}.get(channels, "RGB")
            at += 2 + size
    return None


def _png(data: bytes) -> tuple[tuple, bytes]:
    """A PNG's header fields and its pixels' bytes, filtered as they are; every chunk is checked."""
    at, head, body = 8, None, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + chunk) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + size
    if head is None:
        raise ValueError("no header")
    return head, zlib.decompress(b"".join(body))


def _pnm(data: bytes) -> np.ndarray:
    head = _PNM.match(data)
    if not head:
        raise ValueError("no header")
    w, h, channels = int(head[1]), int(head[2]), 3 if data[:2] == b"P6" else 1
    pixels = np.frombuffer(data, np.uint8)[head.end() :][: w * h * channels]
    if w < 1 or h < 1 or len(pixels) < w * h * channels:
        raise ValueError("wrong size of pixels")
    return pixels.reshape(h, w, channels)


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels."""
    if data[:8] == _PNG:
        (w, h, depth, colour, _, _, interlaced), raw = _png(data)
        if depth == 8 and colour in _MODES and colour != 3 and not interlaced:
            return _unfilter(raw, w, h, _MODES[colour][1])
    if data[:2] in (b"P5", b"P6"):
        return _pnm(data)
    if Pillow is None:
        raise ValueError("no decoder of this format is installed")
    with Pillow.open(io.BytesIO(data)) as image:
        return np.atleast_3d(np.asarray(image.convert("RGB")))


def verify(data: bytes) -> bool:
    """Whether a file is whole: checksums and sizes, without the pixels where the format allows."""
    try:
        if data[:8] == _PNG:
            (w, h, depth, colour, _, _, interlaced), raw = _png(data)
            row = 1 + (w * depth * _MODES[colour][1] + 7) // 8
            return w > 0 and h > 0 and (bool(interlaced) or len(raw) == h * row)
        if data[:2] in (b"P5", b"P6"):
            return _pnm(data).size > 0
        if Pillow is not None:
            return decode(data).size > 0
        return header(data) is not None and (data[:2] != b"\xff\xd8" or data.rstrip(b"\0")[-2:] == b"\xff\xd9")
    except Exception:  # whatever a damaged file makes a decoder do
        return False


def _unfilter(raw: bytes, w: int, h: int, channels: int) -> np.ndarray:
    out, stride = np.zeros((h, w * channels), np.uint8), w * channels
    if len(raw) != h * (stride + 1):
        raise ValueError("wrong size of pixels")
    lines = np.frombuffer(raw, np.uint8).reshape(h, stride + 1)
    above = np.zeros(stride, np.uint8)
    for y in range(h):
        kind, line = int(lines[y, 0]), lines[y, 1:]
        if kind == 1:  # differences from the left: sums along the row
            line = np.cumsum(line.reshape(w, channels), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = line + above
        elif kind:
            line = _predicted(kind, line.tolist(), above.tolist(), channels)
        out[y] = above = line
    return out.reshape(h, w, channels)


def _predicted(kind: int, line: list[int], above: list[int], channels: int) -> np.ndarray:
    """Averages and Paeth's predictor need the byte before: plain integers are the fastest without a decoder."""
    left, corner = [0] * channels, [0] * channels
    for x, v in enumerate(line):
        k = x % channels
        a, b = left[k], above[x]
        if kind == 3:
            v = (v + (a + b) // 2) & 255
        else:
            c = corner[k]
            p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            v = (v + (a if p <= q and p <= r else b if q <= r else c)) & 255
        line[x] = left[k] = v
        corner[k] = b
    return np.array(line, np.uint8)


def encode(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG."""
    h, w, channels = pixels.shape
    colour = {1: 0, 3: 2, 2: 4, 4: 6}[channels]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1).astype(np.uint8)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _checks(images: pa.StructArray, whole: bool) -> pa.StructArray:
    out = []
    for data, w, h, mode in zip(*(images.field(c).to_pylist() for c in ("bytes", "width", "height", "mode"))):
        ok = None
        if data is not None:
            found = header(data) if w is None or h is None else None
            w, h, mode = found or (w, h, mode)
            ok = verify(data) if whole else None
        if ok is None:
            ok = data is not None or bool(w and h and w > 0 and h > 0)
        out.append({"width": w, "height": h, "mode": mode, "readable": ok})
    kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("mode", pa.string()), ("readable", pa.bool_())])
    return pa.array(out, kind)


def checked(image: Column, whole: bool = True) -> Column:
    """CHECK_TYPE of an image, null for none; without ``whole`` only its header is read, and bytes count as readable."""
    parts = F.struct((image["bytes"] if whole else F.substring(image["bytes"], 1, 1 << 18)).alias("bytes"), *(image[c].alias(c) for c in ("width", "height", "mode")))

    @F.arrow_udf(CHECK_TYPE)
    def run(x: pa.Array) -> pa.Array:
        return _checks(x, whole)

    return F.when(image.isNotNull(), run(parts))


def checked_all(images: Column, whole: bool = True) -> Column:
    """The same for a list of images; an item that is null is unreadable."""

    @F.arrow_udf(f"array<{CHECK_TYPE}>")
    def run(x: pa.Array) -> pa.Array:
        n = pa.compute.fill_null(pa.compute.list_value_length(x), 0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, _checks(x.flatten(), whole))

    return F.when(images.isNotNull(), run(images))


def image_readable(image: Column) -> Column:
    """Whether an image has bytes that can be decoded; without bytes, whether its size is known and positive."""
    return F.coalesce(checked(image)["readable"], F.lit(False))
