"""TIFF as a Spark data source, reader (tiles or strips) and tiled BigTIFF writer, without native libraries.

Reading plans one input partition per row of tiles (or strip) and reads only those tiles' bytes. Writing goes tile by tile:
tasks encode tiles, and one committer lays the encoded blobs out, so pixels are never gathered.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rasterloom.operators.tiling import Affine, tiff_block

#: Fixed values of the format: tag numbers, field types, sample kinds, compressions.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, TILE_W, TILE_L, TILE_OFF, TILE_LEN, FORMAT = 256, 257, 258, 259, 262, 277, 322, 323, 324, 325, 339
ROWS_STRIP, STRIP_OFF, STRIP_LEN, PLANES, PREDICTOR = 278, 273, 279, 284, 317
SCALE, TIEPOINT, NODATA, GEOKEYS = 33550, 33922, 42113, 34735
SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
KINDS = {("uint8"): (8, 1), ("uint16"): (16, 1), ("int16"): (16, 2), ("int32"): (32, 2), ("float32"): (32, 3), ("float64"): (64, 3)}
NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773


def lzw_encode(data: bytes) -> bytes:
    """Variable-width codes, most significant bit first, widening one code early."""
    table = {bytes([i]): i for i in range(256)}
    size, width, bits, n, out, now = 258, 9, 0, 0, bytearray(), b""

    def put(code: int) -> None:
        nonlocal bits, n
        bits, n = (bits << width) | code, n + width
        while n >= 8:
            out.append(bits >> (n - 8) & 255)
            n -= 8
            bits &= (1 << n) - 1

    put(256)
    for b in data:
        longer = now + bytes([b])
        if longer in table:
            now = longer
            continue
        put(table[now])
        table[longer] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4095:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        now = bytes([b])
    if now:
        put(table[now])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    table: list[bytes] = []
    width, bits, n, out, last = 9, 0, 0, bytearray(), b""
    for byte in data:
        bits, n = (bits << 8) | byte, n + 8
        if n < width:
            continue
        code = bits >> (n - width)
        n -= width
        bits &= (1 << n) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        last = entry
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    """Byte runs: a count below 128 precedes count + 1 literal bytes, one above 128 a byte repeated 257 - count times."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def profile(width: int, height: int, dtype: str = "uint8", bands: int = 1, nodata: float | None = 0, preferred: int = 256, compression: int = LZW) -> dict:
    """Writer settings: tiled only if both sides take a multiple of 16."""
    w, h = tiff_block(width, preferred), tiff_block(height, preferred)
    out = {"driver": "GTiff", "BIGTIFF": "YES", "compress": compression, "dtype": dtype, "count": bands, "width": width, "height": height, "nodata": nodata, "tiled": bool(w and h)}
    return out | ({"blockxsize": w, "blockysize": h} if w and h else {})


class TiffFile:
    """Header and tile index of a BigTIFF or classic little-endian TIFF; tiles are read on demand."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://")
        with open(self.path, "rb") as f:
            head = f.read(16)
            big = head[:4] == b"II+\0"
            if not big and head[:4] != b"II*\0":
                raise ValueError("not a little-endian TIFF")
            at = struct.unpack_from("<Q" if big else "<I", head, 8 if big else 4)[0]
            f.seek(at)
            count = struct.unpack("<Q" if big else "<H", f.read(8 if big else 2))[0]
            entry, inline = (20, 8) if big else (12, 4)
            raw = f.read(entry * count)
            self.tags: dict[int, tuple] = {}
            for i in range(count):
                tag, kind = struct.unpack_from("<HH", raw, i * entry)
                n = struct.unpack_from("<Q" if big else "<I", raw, i * entry + 4)[0]
                form = SIZES.get(kind)
                if form is None:
                    continue
                size = struct.calcsize("<" + form) * n
                body = raw[i * entry + entry - inline : i * entry + entry][:size]
                if size > inline:
                    f.seek(struct.unpack_from("<Q" if big else "<I", raw, i * entry + entry - inline)[0])
                    body = f.read(size)
                self.tags[tag] = (body[:n].rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(f"<{n}{form}" if len(form) == 1 else "<" + form * n, body)
        t = self.tags
        self.width, self.height, self.bands = t[WIDTH][0], t[LENGTH][0], t.get(SAMPLES, (1,))[0]
        if t.get(PLANES, (1,))[0] != 1 and self.bands > 1:
            raise ValueError("bands in planes of their own are not read")
        # a strip is a tile as wide as the image, and the last one ends with it
        self.tiled = TILE_W in t
        self.tile_w, self.tile_h = (t[TILE_W][0], t[TILE_L][0]) if self.tiled else (self.width, min(self.height, t.get(ROWS_STRIP, (self.height,))[0]))
        self.offsets, self.lengths = (t[TILE_OFF], t[TILE_LEN]) if self.tiled else (t[STRIP_OFF], t[STRIP_LEN])
        kind = (t[BITS][0], t.get(FORMAT, (1,))[0])
        self.dtype = next((k for k, v in KINDS.items() if v == kind), None)
        if self.dtype is None:
            raise ValueError(f"samples of {kind[0]} bits and format {kind[1]} are not read")
        self.across, self.down = -(-self.width // self.tile_w), -(-self.height // self.tile_h)
        self.nodata = float(t[NODATA][0]) if t.get(NODATA, ("",))[0].strip() else None
        s, p = t.get(SCALE), t.get(TIEPOINT)
        self.transform = Affine(s[0], 0, p[3] - p[0] * s[0], 0, -s[1], p[4] + p[1] * s[1]) if s and p else Affine()

    def tile(self, row: int, col: int) -> np.ndarray:
        """Samples (height, width, bands) of one tile or strip, cut to the image."""
        k = row * self.across + col
        rows = self.tile_h if self.tiled else min(self.tile_h, self.height - row * self.tile_h)
        if not self.lengths[k]:
            img = np.zeros((rows, self.tile_w, self.bands), self.dtype)
        else:
            with open(self.path, "rb") as f:
                f.seek(self.offsets[k])
                raw = f.read(self.lengths[k])
            how = self.tags.get(COMPRESSION, (1,))[0]
            unpack = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, 32946: zlib.decompress, PACKBITS: unpack_bits}.get(how)
            if unpack is None:
                raise ValueError(f"compression {how} is not read")
            img = np.frombuffer(unpack(raw), np.dtype(self.dtype).newbyteorder("<"), rows * self.tile_w * self.bands).reshape(rows, self.tile_w, self.bands)
            differences = self.tags.get(PREDICTOR, (1,))[0]
            if differences == 2 and img.dtype.kind in "iu":
                img = np.cumsum(img, axis=1, dtype=self.dtype)
            elif differences != 1:
                raise ValueError(f"predictor {differences} is not read")
        return img[: self.height - row * self.tile_h, : self.width - col * self.tile_w]


class _Tiles(InputPartition):
    def __init__(self, row: int, cols: tuple[int, int]):
        super().__init__((row, cols))


class TiffReader(DataSourceReader):
    def __init__(self, path: str, band: int | None, row0: int, row1: int):
        self.path, self.band, self.rows = path, band, (row0, row1)

    def partitions(self) -> list[InputPartition]:
        f = TiffFile(self.path)
        last = min(self.rows[1], f.height - 1)
        return [_Tiles(r, (0, f.across)) for r in range(self.rows[0] // f.tile_h, last // f.tile_h + 1)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        f, (row, (c0, c1)) = TiffFile(self.path), partition.value
        for col in range(c0, c1):
            img = f.tile(row, col)
            for b in range(f.bands) if self.band is None else [self.band]:
                v = img[:, :, b].astype(np.float64)
                r, c = np.indices(v.shape)
                bad = ~np.isfinite(v) | ((v == f.nodata) if f.nodata is not None and f.nodata == f.nodata else False)
                out = pa.record_batch(
                    [pa.array((r + row * f.tile_h).ravel(), pa.int32()), pa.array((c + col * f.tile_w).ravel(), pa.int32()), pa.array(np.full(v.size, b), pa.int32()), pa.array(v.ravel(), mask=bad.ravel())],
                    names=["row", "col", "band", "value"],
                )
                keep = out.column(0).to_numpy()
                yield out.filter(pa.array((keep >= self.rows[0]) & (keep <= self.rows[1])))


class TiffSource(DataSource):
    """spark.read.format("raster_tiff").load(path): row, col, band, value; options band, row_min, row_max prune tiles."""

    @classmethod
    def name(cls) -> str:
        return "raster_tiff"

    def schema(self) -> str:
        return "row int, col int, band int, value double"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return TiffReader(o["path"], int(o["band"]) if "band" in o else None, int(o.get("row_min", 0)), int(o.get("row_max", 2**31 - 1)))


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(TiffSource)
    reader = spark.read.format("raster_tiff")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def write(pixels: DataFrame, path: str, width: int, height: int, dtype: str = "uint8", nodata: float | None = 0, transform: Affine | None = None, compression: int = LZW, preferred: int = 256, value: str = "value") -> dict:
    """Write one band (row, col, value) as tiled BigTIFF; missing pixels are nodata. Returns the profile.

    Tiles are encoded in tasks; the driver streams encoded tiles, one at a time in file order, to the file.
    """
    p = profile(width, height, dtype, 1, nodata, preferred, compression)
    tw, th = p.get("blockxsize", 16), p.get("blockysize", 16)
    fill = 0 if nodata is None else nodata

    def run(key, pdf):
        import pandas as pd

        br, bc = int(key[0]), int(key[1])
        tile = np.full((th, tw), fill, dtype)
        tile[pdf["row"].to_numpy() - br * th, pdf["col"].to_numpy() - bc * tw] = pdf["v"].fillna(fill).to_numpy().astype(dtype)
        raw = tile.tobytes()
        body = {NONE: bytes, LZW: lzw_encode, DEFLATE: zlib.compress}[compression](raw)
        return pd.DataFrame({"k": [br * -(-width // tw) + bc], "body": [body]})

    tiles = pixels.select("row", "col", F.col(value).cast("double").alias("v"), F.floor(F.col("row") / th).cast("int").alias("br"), F.floor(F.col("col") / tw).cast("int").alias("bc"))
    made = tiles.groupBy("br", "bc").applyInPandas(run, "k long, body binary").orderBy("k")
    across, down = -(-width // tw), -(-height // th)
    offsets, sizes = [0] * (across * down), [0] * (across * down)
    bits, form = KINDS[dtype]
    t = transform or Affine()
    with open(path, "wb") as f:
        f.write(b"\0" * 16)
        for r in made.toLocalIterator():
            offsets[r["k"]], sizes[r["k"]] = f.tell(), len(r["body"])
            f.write(r["body"])
        tags = [
            (WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [bits]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (TILE_W, 4, [tw]), (TILE_L, 4, [th]),
            (TILE_OFF, 16, offsets), (TILE_LEN, 16, sizes), (FORMAT, 3, [form]), (SCALE, 12, [t.a, -t.e, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, t.c, t.f, 0.0]),
        ]
        if nodata is not None:
            tags.append((NODATA, 2, list((("nan" if nodata != nodata else f"{nodata:g}") + "\0").encode())))
        rows = []
        for tag, kind, values in tags:
            body = bytes(values) if kind == 2 else struct.pack(f"<{len(values)}{SIZES[kind]}", *values)
            if len(body) > 8:
                at = f.tell()
                f.write(body)
                body = struct.pack("<Q", at)
            rows.append(struct.pack("<HHQ", tag, kind, len(values)) + body.ljust(8, b"\0"))
        at = f.tell()
        f.write(struct.pack("<Q", len(rows)) + b"".join(rows) + b"\0" * 8)
        f.seek(0)
        f.write(b"II+\0" + struct.pack("<HHQ", 8, 0, at))
    return p
