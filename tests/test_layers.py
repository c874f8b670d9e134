"""Layers, draft pointers, predictor answers, parameters and the whole plan from a file."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import image
from rasterloom.operators import layers, prompts, regions, rules, tiling
from rasterloom.plans import inference, postprocess

RINGS = "array<array<struct<x:double,y:double>>>"


def square(x, y, side):
    return [[(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]]


def test_layer_round_trip_and_fields(spark, tmp_path):
    df = spark.createDataFrame([(7, square(0.0, 0.0, 2.0))], f"source_id long, rings {RINGS}")
    uri = layers.write_layer(df, str(tmp_path / "a"))
    got = layers.read_layer(spark, uri)
    assert uri.endswith("|layername=draft") and got.columns[:6] == [c.split()[0] for c in regions.DRAFT.split(", ")]
    assert got.first().source_id == 7 and got.first().origin is None and layers.feature_count(got).first()[0] == 1 and layers.next_source_id(got).first()[0] == 8
    assert layers.next_source_id(got.limit(0)).first()[0] == 1
    assert len(layers.roi_layer(spark, (0, 1, 2, 3)).first().rings[0]) == 5


def test_parts_and_single_polygons(spark):
    rows = [(1, square(0.0, 0.0, 2.0)), (2, None), (3, []), (4, [[(0.0, 0.0)]])]
    got = layers.as_parts(spark.createDataFrame(rows, f"id long, rings {RINGS}")).collect()
    assert [(r.id, len(r.rings)) for r in got] == [(1, 1)]
    many = spark.createDataFrame([(1, [square(0.0, 0.0, 1.0), square(5.0, 5.0, 3.0), square(9.0, 9.0, 3.0)]), (2, [])], f"id long, parts array<{RINGS}>")
    one = layers.one_part(many).collect()
    assert len(one) == 1 and one[0].parts[0][0].x == 5.0


def test_pointer_survives_a_failed_write(spark, tmp_path, monkeypatch):
    s = regions.DraftSession(spark, str(tmp_path / "d"))
    df = spark.createDataFrame([(1,)], "id int")
    assert s.publish(df) == 1
    monkeypatch.setattr(regions.DraftSession, "_put", staticmethod(lambda fs, path, data: (fs.create(path, True).close(), (_ for _ in ()).throw(OSError("full")))))
    with pytest.raises(OSError):
        s.publish(df)
    monkeypatch.undo()
    again = regions.DraftSession(spark, str(tmp_path / "d"))
    assert again.state["current"] == 1 and again.current().count() == 1 and again.publish(df) == 2
    assert [p.name for p in (tmp_path / "d").iterdir() if p.name.endswith(".tmp")] == []
    (tmp_path / "d" / "pointer.json").write_text("")
    crc = tmp_path / "d" / ".pointer.json.crc"
    crc.unlink(missing_ok=True)
    assert regions.DraftSession(spark, str(tmp_path / "d")).state["current"] == 2


def test_commit_edits_marks_and_publishes(spark, tmp_path):
    s = regions.DraftSession(spark, str(tmp_path / "d"))
    before = spark.createDataFrame([("a", "g1"), ("b", "g2")], "feature_uuid string, wkb string")
    after = spark.createDataFrame([("a", "g1", "inference", "r1"), ("b", "new", "inference", "r1"), ("c", "g3", "inference", None)], "feature_uuid string, wkb string, origin string, run_id string")
    layers.commit_edits(s, after, before)
    assert {(r.feature_uuid, r.origin, r.run_id) for r in s.current().collect()} == {("a", "inference", "r1"), ("b", "user", None), ("c", "user", None)}


def test_latest_run_wins(spark):
    inf = spark.createDataFrame([(0, 0, "r9"), (0, 0, "r10"), (0, 1, "b"), (0, 1, "a")], "row int, col int, run_id string")
    got = {(r.row, r.col): r.run_id for r in regions.compose(inf.limit(0), inf).collect()}
    assert got == {(0, 0): "r10", (0, 1): "b"}
    timed = inf.withColumn("run_at", F.when(F.col("run_id") == "r9", 2).otherwise(1))
    assert regions.compose(inf.limit(0), timed).filter("col = 0").first().run_id == "r9"


def test_predictor_answers():
    a = np.arange(12).reshape(3, 2, 2)
    assert [m.tolist() for m in prompts.masks_of(a)] == a.tolist() == [m.tolist() for m in prompts.masks_of(a[:, None])]
    assert len(prompts.masks_of(a[0])) == 1 and prompts.low_resolution(a, 1).tolist() == [a[1].tolist()] and prompts.low_resolution(a, 5).tolist() == [a[0].tolist()]
    with pytest.raises(ValueError):
        prompts.masks_of(np.zeros((2, 3, 2, 2)))


def test_prompt_rules(spark):
    df = spark.createDataFrame([(1, False, None, 3, 0), (2, False, "m", 1, 0), (3, True, "m", 3, 1), (4, False, "m", 3, 0)], "id int, asked boolean, previous string, masks int, negatives int")
    multi = prompts.use_multimask(F.col("asked"), F.col("previous"))
    got = {r.id: (r.m, r.s) for r in df.select("id", multi.alias("m"), prompts.selector(multi, F.col("masks"), F.col("negatives")).alias("s")).collect()}
    assert got == {1: (True, "initial"), 2: (False, "only"), 3: (True, "prompt"), 4: (False, "prompt")}
    areas = spark.createDataFrame([(63.0,), (-64.0,), (100.0,)], "area double")
    assert prompts.large_contours(areas, 10, 10).count() == 2 and prompts.large_contours(areas, 10_000, 4_500).count() == 1
    points = "array<struct<x:double,y:double>>"
    req = spark.createDataFrame([(1, [(1.0, 2.0), (None, 1.0)], [], True), (2, [(None, None)], [], True), (3, [(1.0, 1.0)], None, False)], f"id int, p {points}, n {points}, inside boolean")
    out = {r.id: r.q for r in req.select("id", prompts.predict_request(F.col("id"), F.col("p"), F.col("n"), F.col("inside")).alias("q")).collect()}
    assert json.loads(out[1])["positive"] == [{"x": 1.0, "y": 2.0}] and out[2] is None and out[3] is None
    with pytest.raises(Exception, match="prompt point"):
        req.limit(1).select(prompts.prompt_points(F.array().cast(points), F.lit(None).cast(points))).collect()


def test_factors_and_classes(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0])], "row int, col int, planes array<double>")
    assert image.require_factors(image.named_factors(df, "planes", ["slope", "tpi"]), ["tpi"]).first()[:] == (0, 0, 2.0)
    with pytest.raises(Exception, match="factor planes"):
        image.named_factors(df, "planes", ["slope"]).collect()
    with pytest.raises(ValueError):
        image.require_factors(df, ["slope"])
    assert abs(df.select(image.softmax(F.col("planes"), 1)).first()[0] - 1 / (1 + np.exp(-1))) < 1e-12
    with pytest.raises(Exception, match="no class 2"):
        df.select(image.softmax(F.col("planes"), 2)).collect()


def test_runtime_metadata_and_device(spark):
    config = {"training_data": {"image_resolution_m": 1.0, "dem_resolution_m": 10.0}}
    got = postprocess.runtime_metadata(config, tiling.Affine(2, 0, 0, 0, -2, 0), "metre", {"resolution": 11.0, "crs_unit": "m"})
    assert [w["kind"] for w in got["resolution_warnings"]] == ["image_resolution_mismatch"] and got["resolution_warnings"][0]["relative_difference"] == 1.0
    assert postprocess.runtime_metadata(config, tiling.Affine(), "degree", None) == {"runtime_resolution": {"image_resolution_m": None, "image_crs_unit": "degree", "dem_resolution_m": None, "dem_crs_unit": None}, "resolution_warnings": []}
    assert inference.choose_device(spark)["tile_size"] == 512 and tiling.window_audit(None) is None and tiling.window_audit(tiling.Box(1, 2, 3, 4))["row_off"] == 2
    summary = rules.rules_summary({"rules": {"slope": {"enabled": False, "factor": "slope", "stat": "median", "operator": ">=", "slope_min_deg": 5}}, "rule_order": ["slope"]})
    assert summary["slope"]["threshold_key"] == "slope_min_deg" and summary["slope"]["threshold_value"] == 5.0


def test_run_from_file(spark, tmp_path):
    r, c = np.indices((30, 40))
    p = np.where((r > 4) & (r < 15) & (c > 3) & (c < 20), 0.9, 0.1)
    spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(r.ravel(), c.ravel(), p.ravel())], "row int, col int, p float").write.parquet(str(tmp_path / "p"))
    params = {"pixels": str(tmp_path / "p"), "config": {"min_area_m2": 10, "morph_open_size": 3}, "width": 40, "height": 30, "output": str(tmp_path / "out")}
    (tmp_path / "run.json").write_text(json.dumps(params))
    seen = []
    summary = postprocess.run_from_file(spark, str(tmp_path / "run.json"), lambda stage, percent: seen.append(stage))
    assert summary["kept"] == 1 and seen == ["load", "postprocess", "write", "audit"] and summary["contract"] == "explicit_dem_factors_v3"
    assert spark.read.parquet(str(tmp_path / "out" / "raster")).filter("value = 1").count() == int((p > 0.5).sum())
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        postprocess.run_from_file(spark, str(tmp_path / "bad.json"))
