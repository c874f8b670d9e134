import json
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.operators import regions, vector
from rasterloom.operators.tiling import Affine
from rasterloom.sinks import dxf, export, shapefile
from rasterloom.sources import ascii_grid, bundles, tiff


def cells(spark, where):
    return spark.createDataFrame(sorted(where), "row int, col int")


SHAPE = {(r, c) for r in range(2, 9) for c in range(3, 11)} - {(4, 5), (4, 6), (6, 7)} | {(12, 12), (13, 13)}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=40))
def test_traced_area_is_the_number_of_cells(where):
    rings = vector.trace(where)
    # holes run the other way, so signed areas add up to the cells
    assert sum(vector.shoelace(g) for g in rings) == len(where)
    assert all(g[0] == g[-1] and len(g) >= 5 for g in rings)


def test_polygonize_and_back(spark):
    parts = vector.polygonize(cells(spark, SHAPE)).cache()
    assert parts.count() == 3
    back = vector.rasterize(parts, 30, 30)
    assert {(r.row, r.col) for r in back.collect()} == SHAPE
    area = parts.select(F.sum(vector.polygon_area(F.col("rings")))).first()[0]
    assert area == len(SHAPE)


def test_simplify_and_smooth(spark):
    square = [(0.0, 0.0), (5.0, 0.1), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    assert vector.thin(square, 0.5) == [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    assert len(vector.round_corners(square)) == 11
    wavy = [(float(i), float(i % 2) * 3) for i in range(1000)] + [(999.0, 50.0), (0.0, 50.0), (0.0, 0.0)]
    assert len(vector.mask_ring(wavy)) <= vector.MAX_RING
    parts = vector.polygonize(cells(spark, SHAPE))
    got = vector.preview(vector.refine(parts, 1.0), 1.0, most=4).select("refined", "preview").collect()
    assert all(r.refined[0] == r.refined[-1] and len(r.preview) in (4, 5) for r in got)


def test_compose_and_versions(spark, tmp_path):
    users, new = cells(spark, {(0, 0), (0, 1)}), cells(spark, {(0, 1), (5, 5)}).withColumn("run_id", F.lit("r1"))
    draft = regions.compose(users, new)
    assert {(r.row, r.col, r.origin, r.run_id) for r in draft.collect()} == {(0, 0, "user", None), (0, 1, "user", None), (5, 5, "inference", "r1")}
    s = regions.DraftSession(spark, f"file://{tmp_path}/d")
    assert not s.active
    with pytest.raises(ValueError):
        s.current()
    s.publish(draft)
    s.fuse(lambda: regions.append_user(s.current(), cells(spark, {(9, 9)})))
    assert s.current().count() == 4 and s.dirty

    def fail():
        raise RuntimeError("broken")

    with pytest.raises(RuntimeError):
        s.fuse(fail)
    assert s.current().count() == 4
    s.mark_exported()
    assert not regions.DraftSession(spark, f"file://{tmp_path}/d").dirty
    s.undo_fusion()
    assert s.current().count() == 3
    with pytest.raises(ValueError):
        s.undo_fusion()


def test_normalise_renews_uuids(spark):
    rows = [(1, "a", "user", None, [1]), (2, "a", "INFERENCE ", "", [1]), (3, None, "x", "r", [1]), (4, "b", "user", None, [])]
    f = spark.createDataFrame(rows, "id int, feature_uuid string, origin string, run_id string, g array<int>")
    got = regions.normalise(f, "id", "g", "base").orderBy("id").collect()
    assert [r.source_id for r in got] == [1, 2, 3] and got[0].feature_uuid == "a" and len({r.feature_uuid for r in got}) == 3
    assert [(r.origin, r.run_id) for r in got] == [("user", None), ("inference", "base"), ("user", None)]


@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE])
def test_tiff_round_trip(spark, tmp_path, how):
    grid = np.random.default_rng(1).integers(0, 5, (50, 70))
    r, c = np.indices(grid.shape)
    df = spark.createDataFrame(list(zip(r.ravel().tolist(), c.ravel().tolist(), grid.ravel().tolist())), "row int, col int, value int")
    path = str(tmp_path / "x.tif")
    p = tiff.write(df, path, 70, 50, "uint8", None, Affine(2, 0, 100, 0, -2, 500), how, 32)
    assert p["blockxsize"] % 16 == 0 == p["blockysize"] % 16
    head = open(path, "rb").read(4)
    assert head == b"II+\0"
    f = tiff.TiffFile(path)
    assert (f.width, f.height, f.bands, f.transform.c, f.transform.a) == (70, 50, 1, 100, 2)
    got = tiff.read(spark, path).collect()
    assert {(x.row, x.col): x.value for x in got} == {(i, j): float(grid[i, j]) for i in range(50) for j in range(70)}
    assert tiff.read(spark, path, row_min=33, row_max=40).count() == 8 * 70


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=6000))
def test_lzw(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data * 8)) == data * 8


def test_exports(spark, tmp_path):
    c = cells(spark, SHAPE)
    export.export(c, "raster", str(tmp_path / "a.tif"), 30, 30)
    assert tiff.read(spark, str(tmp_path / "a.tif")).filter("value = 1").count() == len(SHAPE)
    export.export(c, "vector", str(tmp_path / "b.shp"), 30, 30, Affine(), "WKT")
    head = (tmp_path / "b.shp").read_bytes()
    assert struct.unpack(">i", head[:4])[0] == 9994 and struct.unpack(">i", head[24:28])[0] * 2 == len(head)
    assert struct.unpack("<I", (tmp_path / "b.dbf").read_bytes()[4:8])[0] == 3
    export.export(c, "dxf", str(tmp_path / "c.dxf"), 30, 30)
    text = (tmp_path / "c.dxf").read_text()
    assert text.count("LWPOLYLINE") == 3 and text.endswith("EOF\n")
    again = list(dxf.refit(text.splitlines(), (0.0, 0.0, 100.0, 100.0)))
    assert "104" in again and len(again) == len(text.splitlines())
    with pytest.raises(ValueError):
        export.export(c, "png", "x", 1, 1)
    with pytest.raises(OSError):
        export.export(c.limit(0), "dxf", str(tmp_path / "d.dxf"), 30, 30)
    assert shapefile.write(spark.createDataFrame([], f"class_id int, class_name string, rings {vector.RINGS}"), str(tmp_path / "e.shp")) == 0
    assert export.output_path("x", "dxf") == "x_final.dxf"


def test_ascii_grid(spark, tmp_path):
    text = "NCOLS 10\nNROWS 10\nXLLCENTER 1535380\nYLLCENTER 5083260\nDX 10\nDY 10\nNODATA_VALUE -9999\n" + "\n".join(" ".join(map(str, range(10))) for _ in range(10)) + "\n"
    (tmp_path / "g.asc").write_text(text)
    head, px = ascii_grid.read(spark, str(tmp_path / "g.asc"))
    s = px.agg(F.min("value"), F.max("value"), F.avg("value"), F.stddev_pop("value"), F.max("row")).first()
    assert head["ncols"] == 10 and s[:3] == (0, 9, 4.5) and abs(s[3] - 2.872281323269) < 1e-9 and s[4] == 9


def test_bundles(spark, tmp_path):
    for name, body in (("a", {"framework": "torch", "task": "segmentation", "display_name": "A"}), ("b", {"framework": "other"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text("﻿" + json.dumps(body))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "manifest.json").write_text("{broken")
    assert [r.name for r in bundles.scan(spark, str(tmp_path)).collect()] == ["A"]
    b = bundles.load(str(tmp_path / "a"))
    assert b.input_mode == "image" and b.channels() == []
    assert bundles.strip_prefix({"state_dict": {"module.x": 1, "y": 2}}) == {"x": 1, "y": 2}
    with pytest.raises(FileNotFoundError):
        bundles.load(str(tmp_path))


def test_messages_and_safety(spark):
    message = '{"polygons":[{"shell":[[0,0],[1,0],[1,1]],"holes":[]},{"shell":[[0,0],[9,0],[9,9],[0,9]],"holes":[[[1,1],[2,1],[2,2]]]},{"shell":[[0,0]]}]}'
    df = spark.createDataFrame([(message, [(5.0, 5.0)]), ('{"polygons":[]}', []), (message, [(20.0, 20.0)])], "m string, n array<struct<x:double,y:double>>")
    got = df.select(vector.message_polygon(F.col("m")).alias("rings"), "n")
    got = got.withColumn("safe", vector.safe_shape(F.element_at("rings", 1), F.element_at("rings", 1), F.col("n"), 0.5)).collect()
    assert len(got[0].rings) == 2 and len(got[0].rings[0]) == 5 and got[1].rings is None
    assert [r.safe for r in got] == [False, False, True]
    assert vector.tolerance_of(2, (1.0, 3.0)) == 6.0


def test_burn_and_images(spark, tmp_path):
    from rasterloom.sources import images

    shapes = vector.polygonize(cells(spark, SHAPE)).withColumn("class_id", F.lit(3))
    got = export.burn(shapes, 20, 15)
    assert got.count() == 300 and got.filter("value = 3").count() == len(SHAPE)
    img = np.arange(24, dtype="u1").reshape(2, 4, 3)
    (tmp_path / "a.ppm").write_bytes(b"P6\n# x\n4 2 255\n" + img.tobytes())
    np.save(tmp_path / "b.npy", img[:, :, 0])
    (tmp_path / "c.bin").write_bytes(b"junk")
    read = images.read(spark, str(tmp_path)).cache()
    rows = {r.path[-5:]: r for r in read.collect()}
    assert rows["a.ppm"].samples == img.astype(float).ravel().tolist() and rows["b.npy"].bands == 1 and rows["c.bin"].samples is None
    assert images.pixels(read).filter("band = 2 and row = 1 and col = 3 and path like '%ppm'").first().value == 23


def test_parts_of_all_rectangles_equal_flood_fill(spark):
    from collections import Counter

    from rasterloom.plans import fixtures as fx
    from rasterloom.plans import vector_queries as v

    d = "/root/testdata/sf0.001"
    left = {(r.row, r.col) for r in fx.cells(fx.rects(spark, d)).select("row", "col").collect()}
    want = Counter()
    while left:
        todo, n = [left.pop()], 0
        while todo:
            r, c = todo.pop()
            n += 1
            for x in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if x in left:
                    left.remove(x)
                    todo.append(x)
        want[n] += 1
    got = v.polygon_parts(spark, d).collect()
    assert Counter(r.n_cells for r in got) == want and all(r.area == r.n_cells for r in got)


def test_class_raster_by_pixel(spark):
    from rasterloom.plans import raster_queries as q

    d = "/root/testdata/sf0.001"
    keep = {r.comp_id for r in q.component_decisions(spark, d).collect() if r.decision == "keep"}
    ids = {r.label: r.comp_id for r in q.components.records(q._labels(spark, d), q.fx.WIDTH, q.fx.height(spark, d)).collect()}
    want = {(r.row, r.col) for r in q._labels(spark, d).collect() if ids[r.label] in keep}
    got = q.class_raster(spark, d).collect()
    assert {(r.row, r.col) for r in got if r.value == 1} == want and len(got) == q.fx.grid(spark, d).count()
