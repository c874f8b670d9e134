import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rasterloom.operators import components, dem, rules, stats, stencil
from rasterloom.plans import postprocess


def pixels(spark, grid, name="p", kind="float"):
    r, c = np.indices(grid.shape)
    pdf = pd.DataFrame({"row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), name: grid.ravel()})
    return spark.createDataFrame(pdf, f"row int, col int, {name} {kind}")


def dense(df, shape, name):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["row"], r["col"]] = r[name]
    return out


def flood(mask, near):
    label, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        label[y, x] = n
        while todo:
            a, b = todo.pop()
            for r, c in near:
                if 0 <= a + r < mask.shape[0] and 0 <= b + c < mask.shape[1] and mask[a + r, b + c] and not label[a + r, b + c]:
                    label[a + r, b + c] = n
                    todo.append((a + r, b + c))
    return label


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 20), st.integers(1, 20), st.integers(0, 2**31), st.sampled_from([4, 8]))
def test_label_array_equals_flood_fill(h, w, seed, connectivity):
    mask = np.random.default_rng(seed).random((h, w)) < 0.55
    got = components.label_array(mask, connectivity)
    want = flood(mask, components.EIGHT if connectivity == 8 else components.FOUR)
    pairs = set(zip(got[mask].tolist(), want[mask].tolist()))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert (got[~mask] == -1).all()


@pytest.mark.parametrize("connectivity", [4, 8])
def test_labels_across_tiles(spark, connectivity):
    mask = np.random.default_rng(3).random((70, 50)) < 0.5
    df = pixels(spark, mask.astype("int32"), "m", "int").filter("m = 1")
    got = dense(components.label(df, connectivity, block=16).withColumn("label", __import__("pyspark.sql.functions", fromlist=["col"]).col("label") + 1), mask.shape, "label")
    want = flood(mask, components.EIGHT if connectivity == 8 else components.FOUR)
    pairs = set(zip(got[mask].tolist(), want[mask].tolist()))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


@pytest.mark.parametrize("kind", ["close", "open", "smooth"])
def test_frames_equal_tiles_and_numpy(spark, kind):
    mask = (np.random.default_rng(5).random((40, 37)) < 0.5).astype("int32")
    want = stencil.morphology(mask, 3, kind)
    df = pixels(spark, mask, "m", "int")
    frames = {"close": stencil.closing, "open": stencil.opening, "smooth": stencil.smooth}[kind](df, 3)
    assert np.array_equal(dense(frames, mask.shape, "m"), want)
    tiles = stencil.apply_tiles(df, lambda g, there: stencil.morphology(g, 3, kind), 4, 37, 40, 16)
    assert np.array_equal(dense(tiles, mask.shape, "m"), want)


def test_sides_below_one_are_rejected(spark):
    mask = pixels(spark, np.ones((3, 3), int), "m", "int")
    with pytest.raises(ValueError):
        stencil.closing(mask, 0)
    with pytest.raises(ValueError):
        stencil.morphology(np.ones((3, 3), int), 0, "open")


def test_threshold_is_32_bit_and_nan_safe(spark):
    df = spark.createDataFrame([(0, 0, 0.7), (0, 1, float("nan")), (0, 2, float("inf")), (0, 3, None), (0, 4, 0.69)], "row int, col int, p float")
    got = df.select(stats.above(df.p, 0.7).alias("a")).collect()
    assert [r.a for r in got] == [True, False, False, False, False]
    assert df.filter("col = 0").select(stats.histogram_bin(df.p)).count() == 1
    one = spark.createDataFrame([(0.29,)], "p float")
    assert one.select(stats.histogram_bin(one.p).alias("b")).first().b == 2900
    s = stats.probability_stats(df, 0.7).first()
    assert s["count"] == 2 and s["above"] == 1
    assert stats.histogram_percentiles(stats.probability_histogram(df.filter("p is null"))).count() == 0


RULES = {
    "slope": {"enabled": False, "slope_min_deg": 8.0, "factor": "slope", "stat": "median", "operator": ">="},
    "relief": {"enabled": False, "relief_min_m": 5.0, "factor": "relief", "stat": "median", "operator": ">="},
    "tpi": {"enabled": False, "tpi_max_ridge": 4.0, "factor": "tpi", "stat": "mean", "operator": "<="},
}


def contract(**enabled):
    meters = {"scale_mode": "meters", "window_m": 50.0, "unit": "m"}
    return {
        "threshold": 0.5, "morph_opening": False, "min_area_m2": 1, "rule_order": ["slope", "relief", "tpi"],
        "dem_factors": {"slope": {"method": "gradient"}, "aspect_sin": {"method": "aspect_sin"}, "aspect_cos": {"method": "aspect_cos"}, "tpi": {"method": "center_minus_local_mean", **meters}, "relief": {"method": "local_max_minus_min", **meters}},
        "training_data": {"image_resolution_m": 1.0, "dem_resolution_m": 1.0, "crs_unit": "m"},
        "rules": {k: v | {"enabled": k in enabled} for k, v in RULES.items()},
    }


def test_whole_plan_equals_brute_force(spark, tmp_path):
    """Closing, holes and areas of a random scene, in tiles that cut its components, against plain loops."""
    import json

    rng = np.random.default_rng(12)
    p = np.where(np.kron(rng.random((9, 13)) < 0.45, np.ones((5, 5))) + (rng.random((45, 65)) < 0.06) > 0, 0.8, 0.1).astype("float32")
    config = contract() | {"morph_closing": True, "closing_size": 2, "fill_holes": True, "max_hole_area_m2": 30, "min_area_m2": 20}
    r = postprocess.run(pixels(spark, p), None, None, config, 65, 45, block=16)

    def at(m, y, x):
        return 0 <= y < 45 and 0 <= x < 65 and m[y, x]

    def parts(m, steps):
        seen, out = np.zeros(m.shape, bool), []
        for start in zip(*np.nonzero(m)):
            if not seen[start]:
                todo, mine = [start], []
                seen[start] = True
                while todo:
                    y, x = todo.pop()
                    mine.append((y, x))
                    for dy, dx in steps:
                        if at(m, y + dy, x + dx) and not seen[y + dy, x + dx]:
                            seen[y + dy, x + dx] = True
                            todo.append((y + dy, x + dx))
                out.append(mine)
        return out

    on = p >= 0.5
    wide = np.array([[any(at(on, y + i, x + j) for i in (0, 1) for j in (0, 1)) for x in range(65)] for y in range(45)])
    m = np.array([[all(at(wide, y - i, x - j) for i in (0, 1) for j in (0, 1)) for x in range(65)] for y in range(45)])
    for hole in parts(~m, components.FOUR):
        if len(hole) <= 30 and not any(y in (0, 44) or x in (0, 64) for y, x in hole):
            for c in hole:
                m[c] = True
    found = parts(m, components.EIGHT)
    want = np.zeros(m.shape, int)
    for mine in found:
        for c in mine if len(mine) >= 20 else ():
            want[c] = 1
    assert (dense(r.class_raster, p.shape, "value") == want).all()
    s = postprocess.audit_summary(r, config).first()
    assert (s.component_count, s.kept) == (len(found), sum(len(x) >= 20 for x in found)) and s.post_opening_pixel_count == m.sum() and s.threshold_pixel_count == on.sum()
    summary = postprocess.write_audit(r, config, pixels(spark, p), str(tmp_path / "audit"))
    lines = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "audit" / "components")).collect()]
    assert sorted(x["comp_id"] for x in lines) == list(range(1, len(found) + 1)) and json.loads(spark.read.text(str(tmp_path / "audit" / "summary")).first().value) == json.loads(json.dumps(summary))


def test_sizes_of_a_config():
    assert postprocess.settings({"morph_open_size": 7, "closing_size": "4"})["morph_open_size"] == 7
    assert postprocess.settings({"opening_size": 5})["morph_open_size"] == 5 and postprocess.settings({"opening_size": 5, "morph_open_size": 2})["morph_open_size"] == 2
    with pytest.raises(ValueError):
        postprocess.settings({"morph_opening_size": 3})


def test_in_memory_fills_every_hole_and_refuses_large_rasters(spark):
    p = np.full((20, 20), 0.9, "float32")
    p[3:17, 3:17] = 0
    r, percents = postprocess.in_memory(pixels(spark, p), {"fill_holes": True, "min_area_m2": 1}, 20, 20)
    assert dense(r.class_raster, p.shape, "value").sum() == 400 and percents.count() == 4
    with pytest.raises(ValueError):
        postprocess.in_memory(pixels(spark, p), {}, 5000, 5000)


@pytest.mark.parametrize("size", [2, 3, 4, 5])
def test_even_elements_do_not_move(spark, size):
    m = (np.random.default_rng(size).random((14, 17)) < 0.5).astype(int)
    for kind, frame in (("close", stencil.closing), ("open", stencil.opening)):
        want = stencil.morphology(m, size, kind)
        assert (dense(frame(pixels(spark, m, "m", "int"), size), m.shape, "m") == want).all()
        inner = (slice(size, -size), slice(size, -size))
        assert (want[inner] >= m[inner] if kind == "close" else want <= m).all()


@pytest.mark.parametrize(("rule", "value", "keeps"), [("slope", 9, True), ("slope", 2, False), ("relief", 6, True), ("relief", 2, False), ("tpi", 3, True), ("tpi", 9, False)])
def test_each_rule(spark, rule, value, keeps):
    z = spark.createDataFrame([(1, 100, 0.0, float(value))], f"label long, pixel_count long, dem_fill_fraction double, {rule}_{RULES[rule]['stat']} double")
    got = rules.decide(z, contract(**{rule: True})).first()
    assert got.decision == ("keep" if keeps else "drop") and len(got.rule_evaluations) == 1


def test_cascade_order_gate_and_null(spark):
    c = contract(slope=True, relief=True, tpi=True)
    rows = [(1, 100, 0.0, 2.0, 1.0, 9.0), (2, 100, 0.6, 2.0, 1.0, 9.0), (3, 100, 0.0, 9.0, None, 1.0), (4, 0, 0.0, 9.0, 9.0, 1.0), (5, 100, 0.5, 9.0, 9.0, 4.0)]
    z = spark.createDataFrame(rows, "label long, pixel_count long, dem_fill_fraction double, slope_median double, relief_median double, tpi_mean double")
    got = {r.label: r for r in rules.decide(z, c).collect()}
    assert (got[1].decision, got[1].rule, len(got[1].rule_evaluations)) == ("drop", "slope", 1)
    assert (got[2].decision, got[2].rules_skipped) == ("keep", "dem_fill_fraction")
    assert (got[3].decision, got[3].rule, len(got[3].rule_evaluations)) == ("drop", "relief", 2)
    assert (got[4].decision, got[4].rule, got[4].threshold) == ("drop", "min_area_m2", 1.0)
    assert (got[5].decision, len(got[5].rule_evaluations)) == ("keep", 3)
    assert rules.decide(z, c | {"rule_order": ["tpi", "relief", "slope"]}).filter("label = 1").first().rule == "tpi"


def test_contract_errors():
    good = contract()
    rules.check_contract(good, dem.FACTORS)
    bad = [
        {**good, "dem_factors": dict(reversed(good["dem_factors"].items()))},
        {**good, "dem_factors": good["dem_factors"] | {"tpi": {"method": "center_minus_local_mean"}}},
        {**good, "training_data": {"image_resolution_m": 0, "dem_resolution_m": 1, "crs_unit": "m"}},
        {**good, "rules": good["rules"] | {"slope": {"enabled": False}}},
        {**good, "rules": good["rules"] | {"slope": RULES["slope"] | {"slope_min_deg": True}}},
        {**good, "rule_order": ["slope", "slope", "tpi"]},
        {**good, "rules": {"other": RULES["slope"]}, "rule_order": ["other"]},
    ]
    for b in bad:
        with pytest.raises(ValueError):
            rules.check_contract(b)
    with pytest.raises(ValueError):
        rules.check_contract(good, ("slope",))
    with pytest.raises(ValueError):
        rules.require_metric(good, "degree")


def test_nearest_fill(spark):
    rng = np.random.default_rng(3)
    z = np.where(rng.random((30, 150)) < 0.01, rng.random((30, 150)), np.nan)
    got = dense(dem.nearest_fill(pixels(spark, z, "z", "double")), z.shape, "z")
    have = np.argwhere(~np.isnan(z))
    for y in range(30):
        for x in range(150):
            d = ((have - [y, x]) ** 2).sum(axis=1)
            assert got[y, x] == z[tuple(have[int(np.argmin(d))])]
    far = np.full((2, 100), np.nan)
    far[0, 0] = 5.0
    assert (dense(dem.nearest_fill(pixels(spark, far, "z", "double")), far.shape, "z") == 5).all()
    assert dem.nearest_fill(pixels(spark, np.full((2, 3), np.nan), "z", "double")).filter("z is null").count() == 6


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 40), st.floats(0, 1), st.integers(0, 2**31))
def test_nearest_in_rows_equals_brute_force(h, w, share, seed):
    """Finds at few distances, so that ties abound; upper rows, then left columns win them."""
    rng = np.random.default_rng(seed)
    row, col = (x.ravel() for x in np.indices((h, w)))
    ask, have = rng.random(h * w) < 0.7, rng.random(h * w) < share
    src = (row + rng.integers(-3, 4, h * w))[have]
    got = dem.nearest_in_rows(row[ask], col[ask], row[have], col[have], src)
    for r, c, g in zip(row[ask], col[ask], got):
        near = [((s - r) ** 2 + (x - c) ** 2, s, x, i) for i, (y, x, s) in enumerate(zip(row[have], col[have], src)) if y == r]
        assert g == (min(near)[3] if near else -1)


def test_nearest_fill_across_stretches_and_batches(spark, monkeypatch):
    monkeypatch.setattr(dem, "STRETCH", 4)
    test_nearest_fill(spark)
    wide = np.full((3, 25_000), np.nan)  # a row is more than a batch
    wide[0, 0], wide[2, 24_999] = 1.0, 2.0
    got = dense(dem.nearest_fill(pixels(spark, wide, "z", "double")), wide.shape, "z")
    assert (got[:, :12_500] == 1).all() and (got[:, 12_500:] == 2).all()


def test_nearest_fill_of_tall_and_wide_grids_takes_no_quadratic_time(spark):
    import time

    for shape in ((60_000, 3), (3, 60_000)):
        long = spark.range(shape[0] * shape[1]).selectExpr(f"cast(id div {shape[1]} as int) as row", f"cast(id % {shape[1]} as int) as col")
        z = long.selectExpr("row", "col", f"case when row = {shape[0] - 1} and col = {shape[1] - 1} then 7.0d end as z")
        began = time.time()
        filled = dem.nearest_fill(z).filter("z = 7").groupBy("dem_filled").count().collect()
        assert {r["dem_filled"]: r["count"] for r in filled} == {True: 179_999, False: 1} and time.time() - began < 60


def test_flat_ground_has_no_aspect(spark):
    got = dem.factors(pixels(spark, np.full((4, 4), 7.0), "z", "double"), 3, 3).first()
    assert (got.slope, got.aspect_sin, got.aspect_cos, got.tpi, got.relief) == (0, 0, 0, 0, 0)


def test_keep_prompted(spark):
    mask = np.zeros((20, 20), int)
    mask[1:5, 1:5] = mask[10:14, 10:14] = 1
    labels = components.label(pixels(spark, mask, "m", "int").filter("m = 1"), 8)
    points = spark.createDataFrame([(2.0, 2.0, 1), (11.0, 11.0, 0)], "x double, y double, label int")
    got = components.keep_prompted(labels, points)
    assert got.count() == 16 and got.agg({"row": "max"}).first()[0] == 4
