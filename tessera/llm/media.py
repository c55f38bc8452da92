"""Media columns: lossless PNG in binary columns, read back with checksum tests, hashed by low-frequency cosines.

`to_png` stores a byte payload as an 8-bit grey image of 192 samples a row; `from_png` walks the chunks, tests every CRC,
inflates the image data and undoes the row filters in numpy; `cosine_hash` keeps the signs of the low frequencies of a
32 x 32 reduction of the image.

Null payloads count as empty, and an empty payload is one row of spaces. Damaged images raise ValueError in `from_png`.
Repeated rows, empty tables and extra columns are kept as they are; columns with an output's name are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from .common import map_columns

ROW = 192
PAD = b" "
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a pixel by PNG colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
SIDE, LOW = 32, 8


def padded(data: bytes) -> bytes:
    return data + PAD * (-len(data) % ROW if data else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 4, idat_bytes: int = 1 << 16) -> bytes:
    """payload (a positive multiple of ROW bytes) as a grey PNG. Each row has the filter, of none, sub and up, with the fewest distinct-looking bytes (least sum of magnitudes)."""
    if not payload or len(payload) % ROW:
        raise ValueError(f"the payload must be a positive multiple of {ROW} bytes")
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    tried = np.empty((3, len(image), ROW), np.uint8)
    tried[0] = image
    tried[1, :, 0], tried[1, :, 1:] = image[:, 0], image[:, 1:] - image[:, :-1]
    tried[2, 0], tried[2, 1:] = image[0], image[1:] - image[:-1]
    best = np.abs(tried.view(np.int8).astype(np.int16)).sum(2).argmin(0)
    rows = np.empty((len(image), ROW + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = best, tried[best, np.arange(len(image))]
    data = zlib.compress(rows.tobytes(), level)
    body = b"".join(_chunk(b"IDAT", data[k : k + idat_bytes]) for k in range(0, len(data), idat_bytes))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(image), 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def from_png(png: bytes) -> np.ndarray:
    """The samples, (height, bytes in a row), of an 8-bit PNG without interlacing; ValueError if a checksum or length is wrong."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, parts, ended = 8, None, [], False
    while at < len(png) and not ended:
        if at + 12 > len(png):
            raise ValueError("a chunk is cut off")
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        data = png[at + 8 : at + 8 + n]
        if len(data) < n or png[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"wrong checksum in chunk {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            parts.append(data)
        ended, at = kind == b"IEND", at + 12 + n
    if header is None or not ended:
        raise ValueError("a chunk is missing")
    width, height, depth, colour, _, _, interlaced = header
    if depth != 8 or interlaced or colour not in CHANNELS:
        raise ValueError("only 8-bit samples without interlacing are read")
    step = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if raw.size != height * (width * step + 1):
        raise ValueError("the image data has the wrong length")
    rows = raw.reshape(height, width * step + 1)
    return unfilter(rows[:, 0], rows[:, 1:], step)


def unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters; runs of none, sub and up rows at once, average and Paeth rows sample by sample."""
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    out = np.array(rows)
    sub = kinds == 1
    if sub.any():
        x = out[sub].reshape(int(sub.sum()), -1, step)
        out[sub] = np.add.accumulate(x, axis=1, dtype=np.uint8).reshape(len(x), -1)
    if not (kinds > 2).any():
        # an up row adds to the row above: sums along runs that begin at each row of another kind
        begins = np.flatnonzero((kinds != 2) | (np.arange(len(kinds)) == 0))
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(kinds)]):
            if b - a > 1:
                np.add.accumulate(out[a:b], axis=0, dtype=np.uint8, out=out[a:b])
        return out
    above = np.zeros(out.shape[1], np.uint8)
    for i, kind in enumerate(kinds.tolist()):
        row = out[i]
        if kind == 2:
            row += above
        elif kind > 2:
            up, line = above.tolist(), row.tolist()
            for k in range(len(line)):
                left = line[k - step] if k >= step else 0
                corner = up[k - step] if k >= step else 0
                if kind == 3:
                    guess = (left + up[k]) // 2
                else:
                    p = left + up[k] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up[k]), 1, up[k]), (abs(p - corner), 2, corner))[2]
                line[k] = (line[k] + guess) & 255
            out[i] = line
        above = out[i]
    return out


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


_BASIS = _cosines(SIDE, LOW + 1)


def _reduce(image: np.ndarray, side: int, axis: int) -> np.ndarray:
    """Means of side equal bands along axis; shorter axes repeat their samples."""
    n = image.shape[axis]
    if n < side:
        return np.take(image, np.arange(side) * n // side, axis)
    cut = np.arange(side) * n // side
    sizes = np.diff(np.append(cut, n))
    return np.add.reduceat(image, cut, axis) / (sizes[:, None] if axis == 0 else sizes)


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: for the LOW x LOW lowest frequencies but the mean row and column, whether each exceeds their median."""
    small = _reduce(_reduce(image.astype(np.float64), SIDE, 0), SIDE, 1)
    low = np.round((_BASIS @ small @ _BASIS.T)[1:, 1:], 6)
    return np.packbits(low.ravel() > np.median(low)).tobytes().hex()


def encode(df: DataFrame, col: str, out: str = "media", size: str = "n_bytes") -> DataFrame:
    """df with the PNG of the padded bytes (or UTF-8 text) in col and the number of bytes before padding; col itself goes."""

    def make():
        def run(values: pa.Array):
            data = [b"" if v is None else v.encode() if isinstance(v, str) else v for v in values.to_pylist()]
            return [pa.array([len(d) for d in data], pa.int64()), pa.array([to_png(padded(d)) for d in data], pa.binary())]

        return run

    return map_columns(df, [col], [StructField(size, LongType(), False), StructField(out, BinaryType(), False)], make, (col,))


def features(df: DataFrame, col: str = "media") -> DataFrame:
    """df with what is read back from the PNGs in col: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. col itself goes."""
    fields = [("payload_bytes", LongType()), ("payload_sha256", StringType()), ("tail_crc32", LongType()), ("media_bytes", LongType()), ("media_sha256", StringType()), ("feature", StringType())]

    def make():
        def run(values: pa.Array):
            rows = []
            for png in values.to_pylist():
                image = from_png(png)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(image)))
            return [pa.array([r[k] for r in rows], pa.int64() if isinstance(t, LongType) else pa.string()) for k, (_, t) in enumerate(fields)]

        return run

    return map_columns(df, [col], [StructField(n, t, False) for n, t in fields], make, (col,))
