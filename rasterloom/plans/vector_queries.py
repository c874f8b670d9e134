"""Queries over drafts, polygons and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import layers, prompts, regions, vector
from rasterloom.plans import fixtures as fx
from rasterloom.session import materialize, table

ROI = "row BETWEEN 100 AND 250 AND col BETWEEN 50 AND 200"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return fx.cells(fx.rects(spark, d))


def _current(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    return regions.compose(c.filter("origin = 'user'"), c.filter("origin = 'inference'").select("row", "col", "run_id"))


CURRENT = f"""{fx.RECTS_SQL},
us AS MATERIALIZED (SELECT DISTINCT row, col FROM cells WHERE origin = 'user'),
inf AS MATERIALIZED (SELECT row, col, max(run_id) AS run_id FROM cells WHERE origin = 'inference' GROUP BY row, col),
cur AS MATERIALIZED (SELECT row, col, 'user' AS origin, CAST(NULL AS VARCHAR) AS run_id FROM us
  UNION ALL SELECT inf.row, inf.col, 'inference', run_id FROM inf ANTI JOIN us ON us.row = inf.row AND us.col = inf.col)"""


def compose(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d)


COMPOSE = f"WITH {CURRENT} SELECT * FROM cur"


def roi_merge(spark: SparkSession, d: str) -> DataFrame:
    new = _cells(spark, d).filter("id % 2 = 1 and origin = 'inference'").select("row", "col")
    return regions.roi_merge(_current(spark, d), new, F.expr(ROI), "new")


ROI_MERGE = f"""WITH {CURRENT}, fresh AS (SELECT DISTINCT row, col FROM cells WHERE id % 2 = 1 AND origin = 'inference' AND {ROI}),
both_ AS (SELECT row, col, run_id FROM cur WHERE origin = 'inference' AND NOT ({ROI}) UNION ALL SELECT row, col, 'new' FROM fresh)
SELECT row, col, 'user' AS origin, CAST(NULL AS VARCHAR) AS run_id FROM us
UNION ALL SELECT b.row, b.col, 'inference', b.run_id FROM both_ b ANTI JOIN us ON us.row = b.row AND us.col = b.col"""


def append_user(spark: SparkSession, d: str) -> DataFrame:
    area = _cells(spark, d).filter("id % 10 = 3").select("row", "col")
    return regions.append_user(_current(spark, d), area).select("row", "col", "origin")


APPEND_USER = f"""WITH {CURRENT}, u AS MATERIALIZED (SELECT row, col FROM us UNION SELECT row, col FROM cells WHERE id % 10 = 3),
i AS (SELECT row, col FROM cur WHERE origin = 'inference' EXCEPT SELECT row, col FROM u)
SELECT row, col, 'user' AS origin FROM u UNION ALL SELECT row, col, 'inference' FROM i"""


def region_difference(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    return regions.cells_of(c, "inference").join(regions.cells_of(c, "user"), ["row", "col"], "left_anti")


def region_intersection(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    return regions.cells_of(c, "inference").join(regions.cells_of(c, "user"), ["row", "col"], "left_semi")


SETS = f"WITH {fx.RECTS_SQL} SELECT row, col FROM cells WHERE origin = 'inference' {{}} SELECT row, col FROM cells WHERE origin = 'user'"


def _features(spark: SparkSession, d: str) -> DataFrame:
    r = fx.rects(spark, d)
    uuid = F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("u"), (F.col("id") % 1000).cast("string")))
    cells = F.when(F.col("id") % 17 == 0, F.array().cast("array<int>")).otherwise(F.array("row0", "col0"))
    return r.select("id", F.lit(1).alias("class_id"), F.lit("target").alias("class_name"), F.lit(0).alias("source_id"), uuid.alias("feature_uuid"), F.when(F.col("id") % 5 == 0, "other").otherwise(F.col("origin")).alias("origin"), "run_id", cells.alias("cells"))


def normalise_draft(spark: SparkSession, d: str) -> DataFrame:
    """New uuids are random: only whether one was renewed is returned."""
    f = _features(spark, d)
    out = regions.normalise(f, "id", "cells", "base").join(f.select("id", F.col("feature_uuid").alias("was")), "id")
    return out.select("id", "source_id", "origin", "run_id", (~F.col("feature_uuid").eqNullSafe(F.col("was"))).alias("renewed"))


NORMALISE_DRAFT = f"""WITH {fx.RECTS_SQL}, f AS (
  SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE 'u' || (id % 1000) END AS u, CASE WHEN id % 5 = 0 THEN 'user' ELSE origin END AS origin, run_id FROM rects WHERE id % 17 <> 0)
SELECT id, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS source_id, origin, CASE WHEN origin = 'inference' THEN coalesce(run_id, 'base') END AS run_id,
 u IS NULL OR row_number() OVER (PARTITION BY u ORDER BY id) > 1 AS renewed FROM f"""


def manual_changes(spark: SparkSession, d: str) -> DataFrame:
    r = fx.rects(spark, d).withColumn("feature_uuid", F.col("id").cast("string"))
    shape = F.concat_ws(",", "row0", "col0", "h", "w")
    before = r.filter("id % 7 <> 0").select("feature_uuid", shape.alias("wkb"))
    after = r.withColumn("h", F.when(F.col("id") % 3 == 0, F.col("h") + 1).otherwise(F.col("h"))).select("feature_uuid", "origin", "run_id", shape.alias("wkb"))
    return regions.mark_changes(after, before).select("feature_uuid", "origin", "run_id", "changed")


MANUAL_CHANGES = f"""WITH {fx.RECTS_SQL}, c AS (SELECT *, id % 7 = 0 OR id % 3 = 0 AS changed FROM rects)
SELECT CAST(id AS VARCHAR) AS feature_uuid, CASE WHEN changed THEN 'user' ELSE origin END AS origin, CASE WHEN NOT changed AND origin = 'inference' THEN run_id END AS run_id, changed FROM c"""


def polygon_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of all cells with cell counts; ring areas must equal them. The SQL of components over all cells is too
    slow: a test compares with a flood fill."""
    parts = vector.polygonize(regions.cells_of(_cells(spark, d), None))
    return parts.select("n_cells", F.round(vector.polygon_area(F.col("rings")), 6).alias("area"))


def polygon_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """rasterize(polygonize(cells)) = cells."""
    polygons = materialize(vector.polygonize(regions.cells_of(_cells(spark, d), None)), "polygons")
    return vector.rasterize(polygons, 400, 500)


POLYGON_ROUND_TRIP = f"WITH {fx.RECTS_SQL} SELECT DISTINCT row, col FROM cells"



def _rings(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("col0").cast("double"), F.col("row0").cast("double")
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(p(x, y), p(x + F.col("w"), y), p(x + F.col("w"), y + F.col("h")), p(x, y + F.col("h")), p(x, y))
    return fx.rects(spark, d).withColumn("rings", F.array(ring))


def rasterize_rects(spark: SparkSession, d: str) -> DataFrame:
    return vector.rasterize(_rings(spark, d), 400, 500)


RASTERIZE_RECTS = f"WITH {fx.RECTS_SQL} SELECT DISTINCT row, col FROM cells WHERE col < 400 AND row < 500"


def ring_area(spark: SparkSession, d: str) -> DataFrame:
    ring = F.element_at("rings", 1)
    return _rings(spark, d).select("id", vector.ring_area(ring).alias("area"), vector.vertex_count(F.col("rings")).alias("vertices"), vector.covers(ring, F.lit(100.5), F.lit(120.5)).alias("covers"))


RING_AREA = f"""WITH {fx.RECTS_SQL} SELECT id, CAST(h * w AS DOUBLE) AS area, CAST(5 AS INTEGER) AS vertices,
 col0 <= 100 AND 101 <= col0 + w AND row0 <= 120 AND 121 <= row0 + h AS covers FROM rects"""


def draft_extent(spark: SparkSession, d: str) -> DataFrame:
    return vector.extent(_rings(spark, d))


DRAFT_EXTENT = f"WITH {fx.RECTS_SQL} SELECT CAST(min(col0) AS DOUBLE) AS xmin, CAST(min(row0) AS DOUBLE) AS ymin, CAST(max(col0 + w) AS DOUBLE) AS xmax, CAST(max(row0 + h) AS DOUBLE) AS ymax FROM rects"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("session_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("idx"), F.col("l_discount").alias("score"), (F.col("l_quantity") / 50).alias("area_ratio"),
        (F.col("l_partkey") % 3).alias("raw_neg"), (F.col("l_partkey") % 2).alias("raw_miss"), (F.col("l_suppkey") % 3).alias("neg"), (F.col("l_suppkey") % 2).alias("miss"),
        (F.col("l_quantity") / 50).alias("area"), F.col("l_tax").alias("boundary"), (F.col("l_partkey") % 5 / 4.0).alias("previous"), (F.col("l_suppkey") % 7).alias("retention"),
    )


CANDIDATES = """cand AS MATERIALIZED (
  SELECT l_orderkey AS session_id, l_partkey * 10 + l_linenumber AS idx, l_discount AS score, l_quantity / 50 AS area, l_partkey % 3 AS raw_neg, l_partkey % 2 AS raw_miss,
         l_suppkey % 3 AS neg, l_suppkey % 2 AS miss, l_tax AS boundary, (l_partkey % 5) / 4.0::DOUBLE AS previous, l_suppkey % 7 AS retention FROM lineitem)"""


def initial_mask(spark: SparkSession, d: str) -> DataFrame:
    return prompts.initial_mask(_candidates(spark, d), ["session_id"]).withColumn("idx", F.col("idx").cast("long"))


INITIAL_MASK = f"""WITH {CANDIDATES}, r AS (SELECT session_id, idx, row_number() OVER (PARTITION BY session_id ORDER BY area >= 0.8,
 CASE WHEN area < 0.8 THEN -score ELSE area END, idx) AS k FROM cand) SELECT session_id, idx FROM r WHERE k = 1"""


def candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    return prompts.prompt_mask(_candidates(spark, d), ["session_id"]).withColumn("idx", F.col("idx").cast("long"))


CANDIDATE_RANK = f"""WITH {CANDIDATES}, r AS (SELECT session_id, idx, row_number() OVER (PARTITION BY session_id ORDER BY raw_neg, raw_miss, neg, miss,
 coalesce(previous > 0 AND area / previous < 0.08, false), coalesce(previous > 0 AND area / previous > 2.2, false), area >= 0.8, area >= 0.45 AND boundary > 0.08,
 retention DESC, score DESC, boundary, area, idx) AS k FROM cand) SELECT session_id, idx FROM r WHERE k = 1"""


def prompt_fallback(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    need = prompts.needs_fallback(F.col("miss"), F.col("neg"), F.col("area"), F.col("boundary"), F.col("previous"), F.col("raw_neg"))
    return c.groupBy(need.alias("fallback")).agg(F.count("*").alias("n"), F.sum(prompts.prompt_error(F.col("miss"), F.col("neg"))).alias("error"))


PROMPT_FALLBACK = f"""WITH {CANDIDATES} SELECT miss > 0 OR neg > 0 OR area >= 0.8 OR (area >= 0.45 AND boundary > 0.08) OR (previous > 0 AND area / previous > 2.2)
 OR (previous > 0 AND area / previous < 0.08 AND raw_neg > 0) AS fallback, count(*) AS n, CAST(sum(2 * miss + 3 * neg) AS BIGINT) AS error FROM cand GROUP BY 1"""


def crop_window(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    points = li.select(F.col("l_orderkey").alias("session_id"), (F.col("l_partkey") % 3000).cast("double").alias("x"), (F.col("l_suppkey") * 37 % 2000).cast("double").alias("y"))
    return prompts.crop_window(points, ["session_id"], 3000, 2000, 0.5)


CROP_WINDOW = """WITH p AS (SELECT l_orderkey AS session_id, CAST(l_partkey % 3000 AS DOUBLE) AS x, CAST(l_suppkey * 37 % 2000 AS DOUBLE) AS y FROM lineitem),
b AS (SELECT session_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY 1),
s AS (SELECT *, least(greatest(512.0, greatest(x1 - x0, y1 - y0) * 1.4), 3000.0) AS size FROM b),
t AS (SELECT session_id, least(size, 3000.0) AS fw, least(size, 2000.0) AS fh, greatest(0.0, least((x0 + x1) / 2 - least(size, 3000.0) / 2, 3000.0 - least(size, 3000.0))) AS lx,
 greatest(0.0, least((y0 + y1) / 2 - least(size, 2000.0) / 2, 2000.0 - least(size, 2000.0))) AS ly FROM s)
SELECT session_id, CAST(floor(lx) AS INTEGER) AS "left", CAST(floor(ly) AS INTEGER) AS top, CAST(least(3000, ceil(lx + fw)) AS INTEGER) AS "right", CAST(least(2000, ceil(ly + fh)) AS INTEGER) AS bottom FROM t"""


def prompt_hits(spark: SparkSession, d: str) -> DataFrame:
    """Points of part keys against the thresholded raster, per label."""
    pixels = fx.prob(spark, d).filter(F.col("p") >= F.lit(fx.THRESHOLD).cast("float"))
    points = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7 % 64).cast("double").alias("x"), (F.col("p_partkey") * 3 % 500).cast("double").alias("y"), (F.col("p_partkey") % 2).cast("int").alias("label"))
    return prompts.violations(prompts.point_hits(points, pixels, 1), ["label"])


PROMPT_HITS = f"""WITH {fx.PROB_SQL}, fg AS MATERIALIZED (SELECT row, col FROM prob WHERE p >= CAST(0.1 AS FLOAT)),
pt AS (SELECT p_partkey AS id, CAST(p_partkey * 7 % 64 AS INTEGER) AS x, CAST(p_partkey * 3 % 500 AS INTEGER) AS y, CAST(p_partkey % 2 AS INTEGER) AS label FROM part),
h AS (SELECT DISTINCT id FROM (SELECT id, x + a AS col, y + b AS row FROM pt, generate_series(-1, 1) t(a), generate_series(-1, 1) u(b)) c JOIN fg ON fg.row = c.row AND fg.col = c.col)
SELECT label, count(*) FILTER (label = 1 AND h.id IS NULL) AS misses, count(*) FILTER (label = 0 AND h.id IS NOT NULL) AS negative_hits FROM pt LEFT JOIN h USING (id) GROUP BY label"""


def latest_prompt(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "props")
    return prompts.latest(e, ["user_id"], "event_id", "props")


LATEST_PROMPT = "SELECT user_id, arg_max(props, event_id) AS props, count(*) AS queued FROM events GROUP BY user_id"

def _layers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as layers of a project: some are a session's own."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("layer_id"), F.when(k % 3 == 0, "1").alias("marker"), F.when(k % 4 == 0, " Draft ").otherwise(F.col("s_name")).alias("name"), (k % 5 == 0).alias("registered"), (k % 7 == 0).alias("in_session"), (k % 2 == 0).alias("usable"), k.alias("position"))


def stale_layers(spark: SparkSession, d: str) -> DataFrame:
    """Own layers that neither the current nor the session's nor the active ones protect."""
    x = _layers(spark, d)
    protected = layers.protected_ids(x.filter("layer_id % 6 = 0"), x.filter("in_session"), x.filter("layer_id = 9"))
    return layers.stale_layers(x, protected, F.col("marker") == "1").select("layer_id")


STALE_LAYERS = "SELECT s_suppkey AS layer_id FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 6 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey <> 9"


def orphan_nodes(spark: SparkSession, d: str) -> DataFrame:
    x = _layers(spark, d)
    return layers.orphan_nodes(x, x.filter("registered"), ("draft",)).select("layer_id")


ORPHAN_NODES = "SELECT s_suppkey AS layer_id FROM supplier WHERE s_suppkey % 5 <> 0 AND (s_suppkey % 3 = 0 OR s_suppkey % 4 = 0)"


def reusable_layer(spark: SparkSession, d: str) -> DataFrame:
    return layers.reusable_layer(_layers(spark, d).filter("not registered or layer_id > 20"))


REUSABLE_LAYER = """SELECT arg_min(s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey ELSE 1000000000 + s_suppkey END) AS layer_id FROM supplier
WHERE s_suppkey % 2 = 0 AND (s_suppkey % 5 <> 0 OR s_suppkey > 20) AND (s_suppkey % 5 = 0 OR s_suppkey % 7 = 0) HAVING count(*) > 0"""


def union_layers(spark: SparkSession, d: str) -> DataFrame:
    """Two layers with different columns, of one class, counted by what they lack."""
    r = fx.rects(spark, d).withColumn("label_value", (F.col("id") % 3).cast("int"))
    a, b = r.filter("origin = 'user'").drop("run_id"), r.filter("origin = 'inference'").drop("w")
    return layers.of_class(layers.union_layers([a, b]), 1).select("id", "origin", "run_id", "w")


UNION_LAYERS = f"""WITH {fx.RECTS_SQL} SELECT id, origin, CASE WHEN origin = 'inference' THEN run_id END AS run_id, CASE WHEN origin = 'user' THEN w END AS w
FROM rects WHERE id % 3 = 1 AND origin IN ('user', 'inference')"""


def prompt_points(spark: SparkSession, d: str) -> DataFrame:
    """Each order's lines as prompt points: positives first, then negatives."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"), (F.col("l_returnflag") == "R").alias("bad"))
    point = F.struct(F.col("l_linenumber").alias("n"), F.struct("x", F.col("l_linenumber").cast("double").alias("y")).alias("p"))
    g = x.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.when(~F.col("bad"), point))).alias("a"), F.sort_array(F.collect_list(F.when(F.col("bad"), point))).alias("b"))
    points = prompts.prompt_points(F.col("a.p"), F.col("b.p"))
    out = g.select("l_orderkey", F.posexplode(points).alias("at", "q"))
    return out.select("l_orderkey", "at", F.col("q.x").cast("double").alias("x"), F.col("q.y").cast("double").alias("y"), F.col("q.label").alias("label"))


PROMPT_POINTS = """SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R', l_linenumber, l_quantity) - 1 AS INTEGER) AS at,
 CAST(l_quantity AS DOUBLE) AS x, CAST(l_linenumber AS DOUBLE) AS y, CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS INTEGER) AS label FROM lineitem"""


QUERIES = {
    "stale_layers": stale_layers, "orphan_nodes": orphan_nodes, "reusable_layer": reusable_layer, "union_layers": union_layers, "prompt_points": prompt_points,
    "compose": compose, "roi_merge": roi_merge, "append_user": append_user, "region_difference": region_difference, "region_intersection": region_intersection, "normalise_draft": normalise_draft, "manual_changes": manual_changes,
    "polygon_parts": polygon_parts, "polygon_round_trip": polygon_round_trip, "rasterize_rects": rasterize_rects, "ring_area": ring_area, "draft_extent": draft_extent, "initial_mask": initial_mask, "candidate_rank": candidate_rank,
    "prompt_fallback": prompt_fallback, "crop_window": crop_window, "prompt_hits": prompt_hits, "latest_prompt": latest_prompt,
}
ORACLE_SQL = {
    "stale_layers": STALE_LAYERS, "orphan_nodes": ORPHAN_NODES, "reusable_layer": REUSABLE_LAYER, "union_layers": UNION_LAYERS, "prompt_points": PROMPT_POINTS,
    "compose": COMPOSE, "roi_merge": ROI_MERGE, "append_user": APPEND_USER, "region_difference": SETS.format("EXCEPT"), "region_intersection": SETS.format("INTERSECT"), "normalise_draft": NORMALISE_DRAFT, "manual_changes": MANUAL_CHANGES,
    "polygon_round_trip": POLYGON_ROUND_TRIP, "rasterize_rects": RASTERIZE_RECTS, "ring_area": RING_AREA, "draft_extent": DRAFT_EXTENT, "initial_mask": INITIAL_MASK, "candidate_rank": CANDIDATE_RANK,
    "prompt_fallback": PROMPT_FALLBACK, "crop_window": CROP_WINDOW, "prompt_hits": PROMPT_HITS, "latest_prompt": LATEST_PROMPT,
}
