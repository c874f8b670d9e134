"""Images and TIFF layouts that other programs write, and the shared folder on clusters."""

import struct
import types
import zlib

import numpy as np
import pytest


def _png(img: np.ndarray, colour: int, filters: list[int], palette: bytes = b"") -> bytes:
    """Encodes (height, width, bands) of 8 bits, row y by filters[y % n], straight from the format's definitions."""
    height, width, bands = img.shape
    rows, raw = img.reshape(height, -1).astype(int), bytearray()
    for y in range(height):
        how = filters[y % len(filters)]
        raw.append(how)
        for i in range(width * bands):
            a = rows[y, i - bands] if i >= bands else 0
            b = rows[y - 1, i] if y else 0
            c = rows[y - 1, i - bands] if y and i >= bands else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            raw.append((rows[y, i] - [0, a, b, (a + b) // 2, paeth][how]) % 256)
    return _chunks(width, height, 8, colour, bytes(raw), palette)


def _chunks(width: int, height: int, depth: int, colour: int, raw: bytes, palette: bytes = b"") -> bytes:
    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    packed = zlib.compress(raw)
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("colour", "bands"), [(0, 1), (4, 2), (2, 3), (6, 4)])
def test_png_filters(colour, bands):
    from rasterloom.sources import images

    img = np.random.default_rng(bands).integers(0, 256, (11, 7, bands), np.uint8)
    for filters in ([0], [1], [2], [3], [4], [4, 3, 2, 1, 0]):
        assert (images.decode(_png(img, colour, filters)) == img).all()


def test_png_depths_palette_and_damage():
    from rasterloom.sources import images

    wide = np.array([[[300], [65535]], [[0], [7]]])
    raw = b"".join(b"\0" + r.astype(">u2").tobytes() for r in wide)
    assert (images.decode(_chunks(2, 2, 16, 0, raw)) == wide).all()
    assert images.decode(_chunks(5, 1, 1, 0, b"\0\xa8"))[0, :, 0].tolist() == [1, 0, 1, 0, 1]
    assert images.decode(_chunks(3, 1, 4, 0, b"\0\x1f\x20"))[0, :, 0].tolist() == [1, 15, 2]
    index = np.array([[[1], [0]]], np.uint8)
    assert images.decode(_png(index, 3, [0], bytes([1, 2, 3, 4, 5, 6])))[0].tolist() == [[4, 5, 6], [1, 2, 3]]
    assert images.decode(_png(index + 1, 3, [0], bytes(6))) is None
    whole = _png(np.zeros((2, 2, 1), np.uint8), 0, [0])
    for damaged in (whole[:40], whole[:30] + b"?" + whole[31:], whole[:-14], b""):
        got = images.decode(damaged)
        assert got is None or (damaged == whole[:-14] and not got.any())


def _strips(img: np.ndarray, rows: int, compression: int, predictor: int) -> bytes:
    """A classic TIFF of 8 or 16 bits in strips of so many rows."""
    height, width, bands = img.shape
    bits = img.dtype.itemsize * 8
    if predictor == 2:
        img = np.concatenate([img[:, :1], img[:, 1:] - img[:, :-1]], axis=1)
    pack = {1: bytes, 8: zlib.compress, 32773: lambda x: b"".join(bytes([len(x[i : i + 100]) - 1]) + x[i : i + 100] for i in range(0, len(x), 100))}[compression]
    strips = [pack(np.ascontiguousarray(img[y : y + rows]).tobytes()) for y in range(0, height, rows)]
    at, offsets = 8, []
    for s in strips:
        offsets.append(at)
        at += len(s)
    tail, n = at + 4 * len(strips), len(strips)
    lists = struct.pack(f"<{n}I", *offsets) + struct.pack(f"<{n}I", *map(len, strips))
    value = lambda which: (offsets if which == 273 else [len(s) for s in strips])[0] if n == 1 else at if which == 273 else tail
    tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, bits), (259, 3, 1, compression), (262, 3, 1, 1), (273, 4, n, value(273)), (277, 3, 1, bands), (278, 4, 1, rows), (279, 4, n, value(279)), (317, 3, 1, predictor)]
    index = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4)
    return b"II*\0" + struct.pack("<I", at + len(lists)) + b"".join(strips) + lists + index


@pytest.mark.parametrize(("compression", "predictor", "dtype"), [(1, 1, "u1"), (8, 2, "u1"), (8, 2, "<u2"), (32773, 1, "u1"), (32773, 2, "<u2")])
def test_strips(tmp_path, compression, predictor, dtype):
    from rasterloom.sources.tiff import TiffFile

    img = np.random.default_rng(3).integers(0, 250, (10, 13, 2)).astype(dtype)
    for rows in (1, 4, 10):
        (tmp_path / "s.tif").write_bytes(_strips(img, rows, compression, predictor))
        f = TiffFile(str(tmp_path / "s.tif"))
        assert (f.across, f.down) == (1, -(-10 // rows))
        assert (np.concatenate([f.tile(r, 0) for r in range(f.down)]) == img).all()


def test_strips_and_png_in_spark(spark, tmp_path):
    from rasterloom.sources import images, tiff

    img = np.arange(60, dtype=np.uint8).reshape(6, 10, 1)
    (tmp_path / "s.tif").write_bytes(_strips(img, 4, 8, 2))
    got = tiff.read(spark, str(tmp_path / "s.tif"), row_min=2, row_max=4).collect()
    assert sorted((r["row"], r["col"], r["value"]) for r in got) == [(y, x, y * 10.0 + x) for y in range(2, 5) for x in range(10)]
    (tmp_path / "pngs").mkdir()
    (tmp_path / "pngs" / "a.png").write_bytes(_png(img, 0, [4]))
    (tmp_path / "pngs" / "b.png").write_bytes(b"no image")
    read = images.read(spark, str(tmp_path / "pngs")).cache()
    assert read.filter("samples is null").count() == 1
    assert images.pixels(read).filter("value <> row * 10 + col").count() == 0
    assert images.pixels(read).count() == 60


def test_byte_runs():
    from rasterloom.sources.tiff import unpack_bits

    assert unpack_bits(bytes([254, 7, 128, 2, 1, 2, 3])) == bytes([7, 7, 7, 1, 2, 3])
    assert unpack_bits(b"") == b""


def test_shared_folder_is_asked_for_on_a_cluster():
    from rasterloom.session import shared_dir

    unset = types.SimpleNamespace(isDefined=lambda: False)
    jvm = types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: unset))
    conf = types.SimpleNamespace(get=lambda key, default: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(_jsc=jvm, master="spark://host:7077")))
