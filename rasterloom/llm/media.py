"""Media columns: lossless PNG in binary columns, read back chunk by chunk, and a low-frequency cosine hash.

The writer makes 8-bit greyscale images. The reader takes non-interlaced 8-bit greyscale, grey-alpha, RGB and
RGBA, tests the checksum of every chunk and undoes all five row filters in numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import slices

#: Fixed values of the format: signature, and channels by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 4: 2, 2: 3, 6: 4}
#: Samples in a row of a stored payload.
WIDTH = 64
NONE, SUB, UP, AVERAGE, PAETH = range(5)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: np.ndarray, row_filter: int = NONE, level: int = 3) -> bytes:
    """An 8-bit image of shape (height, width) or (height, width, channels) as PNG, each row under one filter."""
    img = samples[:, :, None] if samples.ndim == 2 else samples
    height, width, channels = img.shape
    kind = {v: k for k, v in CHANNELS.items()}[channels]
    flat = np.ascontiguousarray(img, np.uint8).reshape(height, width * channels)
    left = np.zeros_like(flat)
    left[:, channels:] = flat[:, :-channels]
    above = np.zeros_like(flat)
    above[1:] = flat[:-1]
    if row_filter == NONE:
        body = flat
    elif row_filter == SUB:
        body = flat - left
    elif row_filter == UP:
        body = flat - above
    elif row_filter == AVERAGE:
        body = flat - ((left.astype(np.uint16) + above) >> 1).astype(np.uint8)
    else:
        corner = np.zeros_like(flat)
        corner[1:, channels:] = flat[:-1, :-channels]
        body = flat - _paeth(left.astype(np.int16), above.astype(np.int16), corner.astype(np.int16)).astype(np.uint8)
    lines = np.empty((height, width * channels + 1), np.uint8)
    lines[:, 0] = row_filter
    lines[:, 1:] = body
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa_, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def unfilter(lines: np.ndarray, channels: int) -> np.ndarray:
    """Undo the row filters. Runs of rows with filter 0 or 2 go in one step each; Sub rows are prefix sums per channel."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    height, stride = out.shape
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), height]
    for a, b in zip(edges, edges[1:], strict=False):
        kind = int(kinds[a]) if a < b else NONE
        if kind > PAETH:
            raise ValueError(f"unknown row filter {kind}")
        if kind == SUB:
            rows = out[a:b].reshape(b - a, -1, channels)
            out[a:b] = np.add.accumulate(rows, axis=1, dtype=np.uint8).reshape(b - a, stride)
        elif kind == UP:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.add.accumulate(out[a:b], axis=0, dtype=np.uint8)
        elif kind in (AVERAGE, PAETH):
            for y in range(a, b):
                up = out[y - 1].astype(np.int16) if y else np.zeros(stride, np.int16)
                row = out[y].reshape(-1, channels)
                above = up.reshape(-1, channels)
                before, corner = np.zeros(channels, np.int16), np.zeros(channels, np.int16)
                for x in range(row.shape[0]):
                    guess = (before + above[x]) >> 1 if kind == AVERAGE else _paeth(before, above[x], corner)
                    row[x] = (row[x] + guess) & 255
                    before, corner = row[x].astype(np.int16), above[x]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples of shape (height, width, channels). A wrong signature, checksum, size or unsupported kind is a ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, body, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(part) < n or zlib.crc32(kind + part) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r}: wrong checksum or cut short")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise ValueError("no header or no end chunk")
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or colour not in CHANNELS or interlace:
        raise ValueError("only 8-bit images without palette and interlace")
    channels = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if raw.size != height * (width * channels + 1):
        raise ValueError("wrong number of samples")
    return unfilter(raw.reshape(height, -1), channels).reshape(height, width, channels)


@lru_cache(maxsize=4)
def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n) + 1)[None, :] * np.arange(k)[:, None] / (2 * n))


def cosine_hash(grey: np.ndarray, grid: int = 32, keep: int = 8) -> str:
    """16 hex digits: signs, against their median, of the keep x keep lowest cosine coefficients of the image
    averaged down (or repeated up) to grid x grid. Exact sums in float64 of integers, so equal images agree."""
    sums = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])
    spans = []
    for n in grey.shape:
        lo = np.arange(grid) * n // grid
        spans.append((lo, np.maximum(lo + 1, (np.arange(grid) + 1) * n // grid)))
    (y0, y1), (x0, x1) = spans
    total = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    mean = total / ((y1 - y0)[:, None] * (x1 - x0)[None, :])
    c = _cosines(grid, keep)
    low = np.round(c @ mean @ c.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def text_to_samples(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """UTF-8 bytes with zeros up to a positive multiple of width, as rows; and the unpadded length. Null is empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(width, -(-len(raw) // width) * width)
    return np.frombuffer(raw.ljust(size, b"\0"), np.uint8).reshape(-1, width), len(raw)


def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text", row_filter: int = UP, level: int = 3) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as one PNG in a binary column, its rows as differences from those above.

    Null and empty texts give one row of zeros; equal texts give equal media; repeated rows stay; null keys are
    kept; further columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [text_to_samples(x) for x in b.column(1).to_pylist()]
            media = [encode_png(s, row_filter, level) for s, _ in made]
            yield pa.record_batch([b.column(0), pa.array([n for _, n in made], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Decode to_media's column: payload facts and the hash of what was read back; error says why a row can't be read."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None, None, None, "null"
        seen = len(data), hashlib.sha256(data).hexdigest()
        try:
            img = decode_png(data)
        except (ValueError, struct.error, zlib.error) as e:
            return None, None, None, *seen, None, str(e)
        payload = img.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *seen, cosine_hash(img[:, :, 0]), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for b in slices(batches):
            cols = list(zip(*map(one, b.column(2).to_pylist()), strict=True)) or [()] * 7
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
