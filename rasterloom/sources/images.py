"""Whole images from binary files, for prompting: decoders are tried in order and the first that reads wins."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_pnm(data: bytes) -> np.ndarray:
    """Binary PGM (P5) and PPM (P6), 8 or 16 bits."""
    if data[:2] not in (b"P5", b"P6"):
        raise ValueError("not a binary PNM")
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, top = fields
    bands = 3 if data[:2] == b"P6" else 1
    return np.frombuffer(data, ">u2" if top > 255 else "u1", width * height * bands, at + 1).reshape(height, width, bands)


def decode_npy(data: bytes) -> np.ndarray:
    out = np.load(io.BytesIO(data), allow_pickle=False)
    return out if out.ndim == 3 else out.reshape(*out.shape, 1)


#: Fixed values of the format: signature, and samples a pixel by colour type.
PNG, CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(raw: bytes, height: int, line: int, step: int) -> np.ndarray:
    """Rows of bytes; step: bytes a pixel, one at least."""
    rows = np.frombuffer(raw, np.uint8, height * (line + 1)).reshape(height, line + 1)
    out, above = np.zeros((height, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(height):
        how, row = int(rows[y, 0]), rows[y, 1:]
        if how == 0:
            out[y] = row
        elif how == 1:
            for c in range(step):
                out[y, c::step] = np.cumsum(row[c::step], dtype=np.uint8)
        elif how == 2:
            out[y] = row + above
        elif how in (3, 4):
            now, up = bytearray(row.tobytes()), above.tobytes()
            for i in range(line):
                a, c = (now[i - step], up[i - step]) if i >= step else (0, 0)
                b = up[i]
                if how == 3:
                    guess = (a + b) >> 1
                else:
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                now[i] = (now[i] + guess) & 255
            out[y] = np.frombuffer(now, np.uint8)
        else:
            raise ValueError("unknown filter")
        above = out[y]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """PNG of any colour type and depth without interlace; a palette becomes its colours. Checksums are tested."""
    if data[:8] != PNG:
        raise ValueError("not a PNG")
    at, head, palette, packed = 8, None, None, []
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body, end = data[at + 8 : at + 8 + size], at + 8 + size
        if zlib.crc32(name + body) != struct.unpack_from(">I", data, end)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            break
        at = end + 4
    if head is None or head[6] or head[3] not in CHANNELS:
        raise ValueError("no header, or an interlaced image")
    width, height, depth, colour = head[:4]
    bands = CHANNELS[colour]
    line = (width * bands * depth + 7) // 8
    rows = _unfiltered(zlib.decompress(b"".join(packed)), height, line, max(1, bands * depth // 8))
    if depth == 16:
        rows = np.ascontiguousarray(rows).view(">u2")
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : line * 8 // depth * depth].reshape(height, -1, depth)
        rows = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, : width * bands]
    out = rows.reshape(height, width, bands)
    if colour != 3:
        return out
    if palette is None or (out.size and out.max() >= len(palette)):
        raise ValueError("a palette entry is missing")
    return palette[out[:, :, 0]]


DECODERS: list[Callable[[bytes], np.ndarray]] = [decode_png, decode_pnm, decode_npy]


def decode(data: bytes, decoders: list[Callable[[bytes], np.ndarray]] | None = None) -> np.ndarray | None:
    for d in decoders or DECODERS:
        try:
            return d(data)
        except (ValueError, OSError, EOFError, struct.error, zlib.error):
            continue
    return None


def read(spark: SparkSession, path: str, decoders: list[Callable[[bytes], np.ndarray]] | None = None) -> DataFrame:
    """path, height, width, bands, samples (array of doubles, row by row, bands last); unreadable files have null samples."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                img = decode(bytes(content), decoders)
                out.append((p, *(img.shape if img is not None else (None,) * 3), img.astype(float).ravel().tolist() if img is not None else None))
            yield pd.DataFrame(out, columns=["path", "height", "width", "bands", "samples"]).astype({"height": "Int32", "width": "Int32", "bands": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, height int, width int, bands int, samples array<double>")


def pixels(images: DataFrame) -> DataFrame:
    """path, row, col, band, value."""
    at = images.filter("samples is not null").select("path", "width", "bands", F.posexplode("samples").alias("i", "value"))
    return at.select("path", F.expr("cast(i div (width * bands) as int)").alias("row"), F.expr("cast((i div bands) % width as int)").alias("col"), (F.col("i") % F.col("bands")).cast("int").alias("band"), "value")
