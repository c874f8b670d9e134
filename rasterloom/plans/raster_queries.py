"""Queries over rasters: tiling, statistics, stencils, components, terrain, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import components, dem, rules, stats, stencil, tiling
from rasterloom.plans import fixtures as fx
from rasterloom.plans import postprocess
from rasterloom.session import materialize

#: A small contract for the queries; thresholds suit the derived elevation.
CONFIG = {
    "threshold": fx.THRESHOLD, "morph_opening": False, "min_area_m2": 3.0,
    "dem_factors": {
        "slope": {"method": "gradient", "unit": "degree"}, "aspect_sin": {"method": "aspect_sin", "unit": "ratio"}, "aspect_cos": {"method": "aspect_cos", "unit": "ratio"},
        "tpi": {"method": "center_minus_local_mean", "scale_mode": "meters", "window_m": 5.0, "unit": "m"}, "relief": {"method": "local_max_minus_min", "scale_mode": "meters", "window_m": 5.0, "unit": "m"},
    },
    "training_data": {"image_resolution_m": 1.0, "dem_resolution_m": 1.0, "crs_unit": "m"},
    "rules": {
        "slope": {"enabled": True, "slope_min_deg": 60.0, "factor": "slope", "stat": "median", "operator": ">="},
        "relief": {"enabled": True, "relief_min_m": 95.0, "factor": "relief", "stat": "median", "operator": ">="},
        "tpi": {"enabled": True, "tpi_max_ridge": 10.0, "factor": "tpi", "stat": "mean", "operator": "<="},
    },
    "rule_order": ["slope", "relief", "tpi"],
}
MASK = f"mask AS MATERIALIZED (SELECT row, col, CAST(p >= CAST({fx.THRESHOLD} AS FLOAT) AND isfinite(p) AS INTEGER) AS m, valid FROM prob)"


#: Side of the tiles of these queries: rasters here are 64 wide.
SIDE = 32
#: Order of pixels, tile by tile: components are numbered by their first one.
FIRST = "((row // 32) * 2 + col // 32) * 1024 + row % 32 * 32 + col % 32"


def _mask(spark: SparkSession, d: str) -> DataFrame:
    return fx.prob(spark, d).select("row", "col", stats.above(F.col("p"), fx.THRESHOLD).cast("int").alias("m"), "valid")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """In tiles of 32 x 32, so that components cross their borders."""
    return components.label(_mask(spark, d).filter("m = 1").select("row", "col"), 8, SIDE)


def _first(labels: DataFrame) -> DataFrame:
    """Name components by their first pixel, as the SQL does."""
    names = labels.groupBy("label").agg(F.min(F.col("row").cast("long") * fx.WIDTH + F.col("col")).alias("first"))
    return labels.join(names, "label").select("row", "col", F.col("first").alias("label"))


def window_plan(spark: SparkSession, d: str) -> DataFrame:
    return tiling.expand(tiling.tiles(spark, tiling.Box(0, 0, fx.WIDTH, fx.height(spark, d)), 48), 5, fx.WIDTH, fx.height(spark, d))


WINDOW_PLAN = """
WITH n AS (SELECT max(vec_id) + 1 AS h FROM embeddings),
t AS (SELECT CAST(r AS INTEGER) AS block_row, CAST(c AS INTEGER) AS block_col, r * 48 AS r0, c * 48 AS c0, least(h, r * 48 + 48) AS r1, least(64, c * 48 + 48) AS c1, h
      FROM n, generate_series(0, CAST((h - 1) // 48 AS BIGINT)) a(r), generate_series(0, 1) b(c))
SELECT block_row, block_col, CAST(greatest(0, r0 - 5) AS INTEGER) AS row_off, CAST(greatest(0, c0 - 5) AS INTEGER) AS col_off,
       CAST(least(h, r1 + 5) - greatest(0, r0 - 5) AS INTEGER) AS height, CAST(least(64, c1 + 5) - greatest(0, c0 - 5) AS INTEGER) AS width FROM t"""


def roi_window(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of a region of interest, and their sum."""
    box = tiling.roi_box({"mode": "canvas_intersection", "bounds": [10.2, -200.9, 40.7, -20.4]}, tiling.Affine(), fx.WIDTH, fx.height(spark, d))
    return fx.prob(spark, d).filter(tiling.in_box(box)).agg(F.count("*").alias("n"), F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("left"), F.max("col").alias("right"))


ROI_WINDOW = f"WITH {fx.PROB_SQL} SELECT count(*) AS n, min(row) AS top, max(row) AS bottom, min(col) AS \"left\", max(col) AS \"right\" FROM prob WHERE row BETWEEN 20 AND 200 AND col BETWEEN 10 AND 40"


def roi_outputs(spark: SparkSession, d: str) -> DataFrame:
    cores = fx.prob(spark, d).filter("row between 20 and 40 and col between 10 and 30").select("row", "col", "p", F.lit(1).alias("dem_filled"), F.col("valid").cast("int").alias("valid"))
    out = tiling.roi_outputs(spark, cores, fx.WIDTH, fx.height(spark, d))
    return out.select("row", "col", F.round(F.col("p").cast("double"), 6).alias("p"), "dem_filled", "valid")


ROI_OUTPUTS = f"""WITH {fx.PROB_SQL}, r AS (SELECT *, row BETWEEN 20 AND 40 AND col BETWEEN 10 AND 30 AS inside FROM prob)
SELECT row, col, CASE WHEN inside THEN round(CAST(p AS DOUBLE), 6) END AS p, CAST(inside AS INTEGER) AS dem_filled, CAST(inside AND valid AS INTEGER) AS valid FROM r"""


def halo_tiles(spark: SparkSession, d: str) -> DataFrame:
    wide = tiling.halo_pixels(fx.grid(spark, d), 32, 4, fx.WIDTH, fx.height(spark, d))
    return wide.groupBy("block_row", "block_col").agg(F.count("*").alias("pixels"), F.count_if("core").alias("core_pixels"))


HALO_TILES = f"""WITH {fx.PROB_SQL}, n AS (SELECT max(row) + 1 AS h FROM prob),
t AS (SELECT r, c, h FROM n, generate_series(0, CAST((h - 1) // 32 AS BIGINT)) a(r), generate_series(0, 1) b(c))
SELECT CAST(r AS INTEGER) AS block_row, CAST(c AS INTEGER) AS block_col, count(*) AS pixels,
       count(*) FILTER (row // 32 = r AND col // 32 = c) AS core_pixels
FROM t JOIN prob ON row BETWEEN r * 32 - 4 AND r * 32 + 35 AND col BETWEEN c * 32 - 4 AND c * 32 + 35 GROUP BY r, c"""


def prob_stats(spark: SparkSession, d: str) -> DataFrame:
    s = stats.probability_stats(fx.prob(spark, d), fx.THRESHOLD)
    return s.select(F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), F.round("mean", 6).alias("mean"), "count", "above")


PROB_STATS = f"""WITH {fx.PROB_SQL} SELECT round(CAST(min(p) AS DOUBLE), 6) AS min, round(CAST(max(p) AS DOUBLE), 6) AS max,
 round(avg(CAST(p AS DOUBLE)), 6) AS mean, count(p) AS count, CAST(count(*) FILTER (p >= CAST(0.1 AS FLOAT)) AS BIGINT) AS above FROM prob WHERE isfinite(p)"""


def prob_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.probability_histogram(fx.prob(spark, d))


BIN = "CAST(greatest(0, least(9999, trunc(p * CAST(10000 AS FLOAT)))) AS INTEGER)"
PROB_HISTOGRAM = f"WITH {fx.PROB_SQL} SELECT {BIN} AS bin, count(*) AS n FROM prob WHERE isfinite(p) GROUP BY 1"


def prob_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram_percentiles(stats.probability_histogram(fx.prob(spark, d)))


PROB_PERCENTILES = f"""WITH {fx.PROB_SQL}, h AS (SELECT {BIN} AS bin, count(*) AS n FROM prob WHERE isfinite(p) GROUP BY 1),
c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM h), q AS (SELECT unnest([50, 90, 95, 99]) AS percent)
SELECT CAST(percent AS INTEGER) AS percent, CAST((min(bin) + 0.5) / 10000 AS DOUBLE) AS value FROM c JOIN q ON upto >= ceil(total * percent / 100) GROUP BY percent"""


def exact_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.exact_percentiles(fx.prob(spark, d)).withColumn("value", F.round("value", 6))


EXACT_PERCENTILES = f"""WITH {fx.PROB_SQL}, v AS (SELECT quantile_cont(CAST(p AS DOUBLE), [0.5, 0.9, 0.95, 0.99]) AS v FROM prob)
SELECT CAST([50, 90, 95, 99][i] AS INTEGER) AS percent, round(v[i], 6) AS value FROM v, generate_series(1, 4) t(i)"""


def _morph(op):
    return lambda spark, d: op(_mask(spark, d)).filter("m = 1").select("row", "col")


def _slide(source: str, out: str, kind: str, r: int | tuple[int, int], axes: tuple[str, str] = ("row", "col")) -> str:
    """CTEs of one separable pass pair in SQL."""
    ctes, now = [], source
    back, on = r if isinstance(r, tuple) else (r, r)
    for i, axis in enumerate(axes):
        part, order = ("row", "col") if axis == "row" else ("col", "row")
        w = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {back} PRECEDING AND {on} FOLLOWING)"
        expr = f"max(m) OVER {w}" if kind == "dilate" else f"CASE WHEN count(*) OVER {w} < {back + on + 1} THEN 0 ELSE min(m) OVER {w} END"
        name = f"{out}{i}"
        ctes.append(f"{name} AS (SELECT row, col, {expr} AS m, valid FROM {now})")
        now = name
    return ", ".join(ctes)


def _morph_sql(steps: list[tuple[str, int | tuple[int, int]]], mask: str = "mask") -> str:
    """mask: mask, or dark, its complement."""
    ctes, now = [f"WITH {fx.PROB_SQL}", MASK, "dark AS (SELECT row, col, 1 - m AS m, valid FROM mask)"], mask
    for i, (kind, r) in enumerate(steps):
        ctes.append(_slide(now, f"s{i}_", kind, r))
        now = f"s{i}_1"
    return ", ".join(ctes) + f" SELECT row, col FROM {now} WHERE m = 1 AND valid"


def tiled_closing(spark: SparkSession, d: str) -> DataFrame:
    """The same closing by halo tiles and numpy."""
    mask = _mask(spark, d)
    out = stencil.apply_tiles(mask, lambda g, there: stencil.morphology(g, 3, "close"), 2, fx.WIDTH, fx.height(spark, d), 32)
    return out.join(mask.filter("valid").select("row", "col"), ["row", "col"]).filter("m = 1").select("row", "col")


def component_labels(spark: SparkSession, d: str) -> DataFrame:
    return _first(_labels(spark, d))


COMPONENT_LABELS = f"WITH RECURSIVE {fx.PROB_SQL}, {MASK}, fg AS MATERIALIZED (SELECT row, col FROM mask WHERE m = 1), {fx.components_sql('fg')} SELECT row, col, label FROM lab"


def component_records(spark: SparkSession, d: str) -> DataFrame:
    return components.records(_labels(spark, d), fx.WIDTH, fx.height(spark, d)).select("comp_id", "pixel_count", "border")


COMPONENT_RECORDS = f"""WITH RECURSIVE {fx.PROB_SQL}, {MASK}, fg AS MATERIALIZED (SELECT row, col FROM mask WHERE m = 1), {fx.components_sql('fg')},
n AS (SELECT max(row) AS last FROM prob)
SELECT CAST(row_number() OVER (ORDER BY min({FIRST})) AS INTEGER) AS comp_id, count(*) AS pixel_count, bool_or(row = 0 OR col = 0 OR col = 63 OR row = last) AS border
FROM lab, n GROUP BY label"""


def kept_components(spark: SparkSession, d: str) -> DataFrame:
    """Threshold, 8-connected components, area filter."""
    got = components.records(_labels(spark, d), fx.WIDTH, fx.height(spark, d))
    return got.filter("pixel_count >= 5").select("comp_id", "pixel_count", F.col("pixel_count").cast("double").alias("area_m2"))


KEPT_COMPONENTS = f"""WITH RECURSIVE {fx.PROB_SQL}, {MASK}, fg AS MATERIALIZED (SELECT row, col FROM mask WHERE m = 1), {fx.components_sql('fg')},
c AS (SELECT CAST(row_number() OVER (ORDER BY min({FIRST})) AS INTEGER) AS comp_id, count(*) AS pixel_count FROM lab GROUP BY label)
SELECT comp_id, pixel_count, CAST(pixel_count AS DOUBLE) AS area_m2 FROM c WHERE pixel_count >= 5"""


def hole_fill(spark: SparkSession, d: str) -> DataFrame:
    closed = materialize(stencil.closing(_mask(spark, d).withColumn("valid", F.lit(True)), 3), "closed")
    return components.fill_holes(closed, 4, fx.WIDTH, fx.height(spark, d), SIDE).filter("m = 1").select("row", "col")


HOLE_FILL = f"""WITH RECURSIVE {fx.PROB_SQL}, {MASK}, {_slide('mask', 'd', 'dilate', 1)}, {_slide('d1', 'e', 'erode', 1)},
closed AS MATERIALIZED (SELECT row, col, m FROM e1), bg AS MATERIALIZED (SELECT row, col FROM closed WHERE m = 0), {fx.components_sql('bg', eight=False)},
n AS (SELECT max(row) AS last FROM prob),
holes AS (SELECT label FROM lab, n GROUP BY label HAVING count(*) <= 4 AND NOT bool_or(row = 0 OR col = 0 OR col = 63 OR row = last))
SELECT row, col FROM closed WHERE m = 1 UNION ALL SELECT row, col FROM lab WHERE label IN (SELECT label FROM holes)"""


def dem_factors(spark: SparkSession, d: str) -> DataFrame:
    f = dem.factors(fx.dem(spark, d), 5, 5)
    return f.select("row", "col", *[F.round(c, 6).alias(c) for c in dem.FACTORS])


FACTOR_CTE = f"""WITH RECURSIVE {fx.PROB_SQL}, {fx.DEM_SQL},
g AS MATERIALIZED (
  SELECT row, col, z, dem_filled,
    CASE WHEN count(*) OVER x = 1 THEN 0 ELSE (coalesce(lead(z) OVER xo, z) - coalesce(lag(z) OVER xo, z)) / (CASE WHEN lead(z) OVER xo IS NULL OR lag(z) OVER xo IS NULL THEN 1 ELSE 2 END) END AS dx,
    CASE WHEN count(*) OVER y = 1 THEN 0 ELSE -(coalesce(lead(z) OVER yo, z) - coalesce(lag(z) OVER yo, z)) / (CASE WHEN lead(z) OVER yo IS NULL OR lag(z) OVER yo IS NULL THEN 1 ELSE 2 END) END AS dy,
    sum(z) OVER r2 AS s, count(*) OVER r2 AS n, min(z) OVER r2 AS lo, max(z) OVER r2 AS hi
  FROM dem WINDOW x AS (PARTITION BY row), y AS (PARTITION BY col), xo AS (PARTITION BY row ORDER BY col), yo AS (PARTITION BY col ORDER BY row),
    r2 AS (PARTITION BY row ORDER BY col ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
h AS MATERIALIZED (
  SELECT row, col, z, dem_filled, dx, dy, sqrt(dx * dx + dy * dy) AS st, sum(s) OVER c2 / sum(n) OVER c2 AS mean, min(lo) OVER c2 AS lo, max(hi) OVER c2 AS hi
  FROM g WINDOW c2 AS (PARTITION BY col ORDER BY row ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
fac AS MATERIALIZED (
  SELECT row, col, dem_filled, degrees(atan(st)) AS slope, CASE WHEN st = 0 THEN 0.0 ELSE -dx / st END AS aspect_sin, CASE WHEN st = 0 THEN 0.0 ELSE -dy / st END AS aspect_cos,
         z - mean AS tpi, hi - lo AS relief FROM h)"""
DEM_FACTORS = FACTOR_CTE + " SELECT row, col, " + ", ".join(f"round({c}, 6) AS {c}" for c in dem.FACTORS) + " FROM fac"


def dem_align(spark: SparkSession, d: str) -> DataFrame:
    """Elevation at twice the pixel size, resampled to the image's grid."""
    coarse = fx.dem(spark, d).filter("row % 2 = 0 and col % 2 = 0").select((F.col("row") / 2).cast("int").alias("row"), (F.col("col") / 2).cast("int").alias("col"), "z")
    out = dem.align(coarse, fx.grid(spark, d), tiling.Affine(2.0, 0, 0, 0, -2.0, 0), tiling.Affine())
    return out.withColumn("z", F.round("z", 6))


DEM_ALIGN = f"""WITH {fx.PROB_SQL}, {fx.DEM_SQL}, k AS MATERIALIZED (SELECT row // 2 AS row, col // 2 AS col, z FROM dem WHERE row % 2 = 0 AND col % 2 = 0),
a AS (SELECT row, col, (col + 0.5) / 2 - 0.5 AS u, (row + 0.5) / 2 - 0.5 AS v FROM prob),
b AS MATERIALIZED (SELECT row, col, CAST(floor(v) AS INTEGER) + r AS sr, CAST(floor(u) AS INTEGER) + c AS sc,
   (CASE c WHEN 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE r WHEN 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w
   FROM a, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) n(r, c))
SELECT b.row, b.col, round(CAST(sum(w * z) / sum(w) AS DOUBLE), 6) AS z FROM b JOIN k ON k.row = sr AND k.col = sc GROUP BY b.row, b.col"""


def zonal_stats(spark: SparkSession, d: str) -> DataFrame:
    labels = _labels(spark, d)
    z = rules.zonal_stats(labels, dem.factors(fx.dem(spark, d), 5, 5), fx.dem_filled(spark, d), ["slope", "tpi", "relief"])
    ids = components.records(labels, fx.WIDTH, fx.height(spark, d)).select("label", "comp_id")
    values = [c for c in z.columns if c not in ("label", "pixel_count")]
    return z.join(ids, "label").select("comp_id", "pixel_count", *[F.round(c, 6).alias(c) for c in values])


ZONES_CTE = f"""{FACTOR_CTE}, {MASK}, fg AS MATERIALIZED (SELECT row, col FROM mask WHERE m = 1), {fx.components_sql('fg')},
z AS MATERIALIZED (
  SELECT label, min({FIRST}) AS first_, count(*) AS pixel_count, CAST(sum(CAST(dem_filled AS INTEGER)) AS DOUBLE) / count(*) AS dem_fill_fraction,
  {", ".join(f"{fn}({c}) AS {c}_{s}" for c in ("slope", "tpi", "relief") for s, fn in (("median", "median"), ("mean", "avg"), ("min", "min"), ("max", "max")))}
  FROM lab JOIN fac USING (row, col) GROUP BY label),
zid AS (SELECT *, CAST(row_number() OVER (ORDER BY first_) AS INTEGER) AS comp_id FROM z)"""
ZONAL_STATS = ZONES_CTE + " SELECT comp_id, pixel_count, round(dem_fill_fraction, 6) AS dem_fill_fraction, " + ", ".join(f"round({c}_{s}, 6) AS {c}_{s}" for c in ("slope", "tpi", "relief") for s in rules.STATS) + " FROM zid"


def _result(spark: SparkSession, d: str) -> postprocess.Result:
    rules.check_contract(CONFIG, dem.FACTORS)
    pixels = fx.prob(spark, d).drop("valid")
    return postprocess.run(pixels, dem.factors(fx.dem(spark, d), 5, 5), fx.dem_filled(spark, d), CONFIG, fx.WIDTH, fx.height(spark, d), block=SIDE)


def component_decisions(spark: SparkSession, d: str) -> DataFrame:
    r = _result(spark, d).decisions
    return r.select("comp_id", "pixel_count", F.round("dem_fill_fraction", 6).alias("dem_fill_fraction"), "decision", "rule", "threshold", "rules_skipped", F.size("rule_evaluations").alias("evaluations"))


DECIDED_CTE = f"""{ZONES_CTE},
dec AS MATERIALIZED (
  SELECT *, CASE WHEN pixel_count < 3 THEN 'min_area_m2' WHEN dem_fill_fraction > 0.5 THEN NULL WHEN NOT coalesce(slope_median >= 60, false) THEN 'slope'
    WHEN NOT coalesce(relief_median >= 95, false) THEN 'relief' WHEN NOT coalesce(tpi_mean <= 10, false) THEN 'tpi' END AS rule FROM zid)"""
COMPONENT_DECISIONS = DECIDED_CTE + """ SELECT comp_id, pixel_count, round(dem_fill_fraction, 6) AS dem_fill_fraction, CASE WHEN rule IS NULL THEN 'keep' ELSE 'drop' END AS decision, rule,
 CAST(CASE rule WHEN 'min_area_m2' THEN 3.0 WHEN 'slope' THEN 60.0 WHEN 'relief' THEN 95.0 WHEN 'tpi' THEN 10.0 END AS DOUBLE) AS threshold,
 CASE WHEN pixel_count >= 3 AND dem_fill_fraction > 0.5 THEN 'dem_fill_fraction' END AS rules_skipped,
 CAST(CASE WHEN pixel_count < 3 OR dem_fill_fraction > 0.5 THEN 0 WHEN rule = 'slope' THEN 1 WHEN rule = 'relief' THEN 2 ELSE 3 END AS INTEGER) AS evaluations FROM dec"""


def class_raster(spark: SparkSession, d: str) -> DataFrame:
    """Every pixel."""
    return _result(spark, d).class_raster.select("row", "col", "value")


CLASS_RASTER = DECIDED_CTE + """, on_ AS MATERIALIZED (SELECT row, col FROM lab JOIN dec USING (label) WHERE rule IS NULL)
SELECT prob.row, prob.col, CAST(on_.row IS NOT NULL AS INTEGER) AS value FROM prob LEFT JOIN on_ ON on_.row = prob.row AND on_.col = prob.col"""


def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return postprocess.audit_summary(_result(spark, d), CONFIG)


AUDIT_SUMMARY = DECIDED_CTE + """, n AS (SELECT count(*) AS n FROM fg)
SELECT count(*) AS component_count, count(*) FILTER (rule IS NULL) AS kept, count(*) FILTER (rule IS NOT NULL) AS dropped, CAST(0.1 AS DOUBLE) AS threshold, CAST(3.0 AS DOUBLE) AS min_area_m2,
 'streaming_histogram_10000_bins' AS prob_stats_method, max(n) AS threshold_pixel_count, max(n) AS post_closing_pixel_count, max(n) AS post_fill_holes_pixel_count, max(n) AS post_smooth_pixel_count, max(n) AS post_opening_pixel_count
FROM dec, n"""


def dem_fill(spark: SparkSession, d: str) -> DataFrame:
    """Elevation with wide gaps, filled from the nearest cell."""
    z = fx.dem(spark, d).withColumn("z", F.when((F.col("row") % 40 < 8) & (F.col("col") % 16 < 3), F.col("z")))
    return dem.nearest_fill(z).withColumn("z", F.round("z", 6))


DEM_FILL = f"""WITH {fx.PROB_SQL}, {fx.DEM_SQL}, have AS (SELECT row, col, z FROM dem WHERE row % 40 < 8 AND col % 16 < 3),
near AS (
  SELECT d.row, d.col, first(h.z ORDER BY (h.row - d.row) * (h.row - d.row) + (h.col - d.col) * (h.col - d.col), h.row, h.col) AS z
  FROM dem d JOIN have h ON abs(h.row - d.row) <= 40 GROUP BY d.row, d.col)
SELECT row, col, round(CAST(z AS DOUBLE), 6) AS z, NOT (row % 40 < 8 AND col % 16 < 3) AS dem_filled FROM near"""


def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    config = {"threshold": fx.THRESHOLD, "morph_closing": True, "morph_close_size": 3, "smooth_boundary": True, "smooth_size": 2, "morph_opening": True, "opening_size": 3}
    return postprocess.stage_counts(postprocess.masks(fx.prob(spark, d), config, fx.WIDTH, fx.height(spark, d)))


STAGE_COUNTS = f"""WITH {fx.PROB_SQL}, t AS (SELECT row, col, CAST(p >= CAST(0.1 AS FLOAT) AND valid AS INTEGER) AS m, valid FROM prob),
{_slide('t', 'd', 'dilate', 1)}, {_slide('d1', 'e', 'erode', 1)}, c AS MATERIALIZED (SELECT row, col, CASE WHEN valid THEN m ELSE 0 END AS m, valid FROM e1),
{_slide('c', 'h', 'dilate', (0, 1))}, {_slide('h1', 'i', 'erode', (1, 0))}, {_slide('i1', 'j', 'erode', (1, 0))}, {_slide('j1', 'k', 'dilate', (0, 1))},
s AS MATERIALIZED (SELECT row, col, CASE WHEN valid THEN m ELSE 0 END AS m, valid FROM k1),
{_slide('s', 'f', 'erode', 1)}, {_slide('f1', 'g', 'dilate', 1)}, n AS (SELECT (SELECT sum(m) FROM t) AS a, (SELECT sum(m) FROM c) AS b, (SELECT sum(m) FROM s) AS s_, (SELECT sum(m) FROM g1 WHERE valid) AS o)
SELECT 'threshold' AS stage, CAST(a AS BIGINT) AS pixels FROM n UNION ALL SELECT unnest(['closing', 'fill']), CAST(b AS BIGINT) FROM n
UNION ALL SELECT 'smooth', CAST(s_ AS BIGINT) FROM n UNION ALL SELECT 'opening', CAST(o AS BIGINT) FROM n"""


def multiband_valid(spark: SparkSession, d: str) -> DataFrame:
    """Three bands; one is masked where the pixel is invalid."""
    bands = fx.prob(spark, d).withColumn("band", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    bands = bands.withColumn("value", F.when((F.col("band") < 2) | F.col("valid"), F.col("p").cast("double")))
    return stats.multiband_valid(bands).filter("not valid").select("row", "col")


MULTIBAND_VALID = f"WITH {fx.PROB_SQL} SELECT row, col FROM prob WHERE NOT valid"

QUERIES = {
    "kept_components": kept_components, "window_plan": window_plan, "roi_window": roi_window, "roi_outputs": roi_outputs, "halo_tiles": halo_tiles, "prob_stats": prob_stats, "prob_histogram": prob_histogram,
    "prob_percentiles": prob_percentiles, "exact_percentiles": exact_percentiles, "closing3": _morph(lambda m: stencil.closing(m, 3)), "opening3": _morph(lambda m: stencil.opening(m.withColumn("m", 1 - F.col("m")), 3)), "opening2": _morph(lambda m: stencil.opening(m, 2)), "closing4": _morph(lambda m: stencil.closing(m, 4)),
    "smooth3": _morph(lambda m: stencil.smooth(m, 3)), "tiled_closing": tiled_closing, "stage_counts": stage_counts, "component_labels": component_labels, "component_records": component_records,
    "hole_fill": hole_fill, "dem_factors": dem_factors, "dem_align": dem_align, "dem_fill": dem_fill, "zonal_stats": zonal_stats, "component_decisions": component_decisions, "class_raster": class_raster, "audit_summary": audit_summary, "multiband_valid": multiband_valid,
}
ORACLE_SQL = {
    "kept_components": KEPT_COMPONENTS, "window_plan": WINDOW_PLAN, "roi_window": ROI_WINDOW, "roi_outputs": ROI_OUTPUTS, "halo_tiles": HALO_TILES, "prob_stats": PROB_STATS, "prob_histogram": PROB_HISTOGRAM,
    "prob_percentiles": PROB_PERCENTILES, "exact_percentiles": EXACT_PERCENTILES, "closing3": _morph_sql([("dilate", 1), ("erode", 1)]), "opening3": _morph_sql([("erode", 1), ("dilate", 1)], "dark"), "opening2": _morph_sql([("erode", (1, 0)), ("dilate", (0, 1))]), "closing4": _morph_sql([("dilate", (1, 2)), ("erode", (2, 1))]),
    "smooth3": _morph_sql([("dilate", 1), ("erode", 1), ("erode", 1), ("dilate", 1)]), "tiled_closing": _morph_sql([("dilate", 1), ("erode", 1)]), "stage_counts": STAGE_COUNTS, "component_labels": COMPONENT_LABELS,
    "component_records": COMPONENT_RECORDS, "hole_fill": HOLE_FILL, "dem_factors": DEM_FACTORS, "dem_align": DEM_ALIGN, "dem_fill": DEM_FILL, "zonal_stats": ZONAL_STATS, "component_decisions": COMPONENT_DECISIONS, "class_raster": CLASS_RASTER,
    "audit_summary": AUDIT_SUMMARY, "multiband_valid": MULTIBAND_VALID,
}
