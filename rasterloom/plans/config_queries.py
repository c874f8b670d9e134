"""Queries over configurations, protocols, images and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions import config, image
from rasterloom.operators.tiling import Affine
from rasterloom.plans import fixtures as fx
from rasterloom.plans import inference
from rasterloom.session import table
from rasterloom.streaming import protocol, sessions


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    """A JSON manifest per part: labels, framework and task vary with the key."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    k = F.col("id")
    names = F.when(k % 4 == 0, '["background"," TarGet "]').when(k % 4 == 1, '["target","background"]').when(k % 4 == 2, '["background","road"]').otherwise('["target","Target"]')
    text = F.concat(F.lit('{"framework":"'), F.when(k % 5 == 0, "other").otherwise("torch"), F.lit('","task":"segmentation","name":"m'), (k % 3).cast("string"), F.lit('","class_names":'), names, F.when(k % 7 == 0, ',"target_class_id":1}').otherwise("}"))
    return p.select("id", F.when(k % 13 == 0, "{broken").otherwise(text).alias("manifest"))


def bundle_scan(spark: SparkSession, d: str) -> DataFrame:
    m = _manifests(spark, d)
    good = m.filter(F.try_parse_json("manifest").isNotNull() & config.valid_bundle(F.col("manifest")))
    return good.select("id", config.display_name(F.col("manifest"), F.lit("dir")).alias("name"), config.strict_class_id(F.col("manifest")).alias("strict"), config.lenient_class_id(F.col("manifest")).alias("lenient"))


BUNDLE_SCAN = """SELECT p_partkey AS id, 'm' || (p_partkey % 3) AS name,
 CAST(CASE WHEN p_partkey % 4 = 0 THEN 1 WHEN p_partkey % 4 = 1 AND p_partkey % 7 <> 0 THEN 0 END AS INTEGER) AS strict,
 CAST(CASE WHEN p_partkey % 7 = 0 THEN 1 WHEN p_partkey % 4 = 0 THEN 1 WHEN p_partkey % 4 IN (1, 3) THEN 0 ELSE 1 END AS INTEGER) AS lenient
FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 5 <> 0"""


def config_merge(spark: SparkSession, d: str) -> DataFrame:
    """Event properties over defaults, entry by entry."""
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("over"))
    base = F.create_map(F.lit("k"), F.lit("-1"), F.lit("threshold"), F.lit("0.5"))
    merged = config.merge_json(base, F.coalesce("over", F.create_map().cast("map<string,string>")))
    return e.select("event_id", config.safe_int(merged["k"], -1).alias("k"), merged["threshold"].alias("threshold"))


CONFIG_MERGE = "SELECT event_id, CAST(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS INTEGER) AS k, coalesce(json_extract_string(props, '$.threshold'), '0.5') AS threshold FROM events"


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as one log per source."""
    docs = table(spark, d, "documents")
    lines = docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("seq", F.struct("doc_id", "at"))
    return protocol.diagnostics_report(protocol.diagnostics(lines, ["source"], "seq"), ["source"])


DIAGNOSTICS = """WITH s AS (SELECT source, doc_id, string_split(text, chr(10)) AS u FROM documents),
l AS (SELECT source, doc_id, generate_subscripts(u, 1) AS nth, unnest(u) AS line FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY source, line ORDER BY doc_id, nth) > 1 AS rep FROM l),
c AS (SELECT *, sum(CAST(NOT rep AS INTEGER)) OVER w AS n, sum(CASE WHEN rep THEN 0 ELSE length(line) END) OVER w AS ch FROM r WINDOW w AS (PARTITION BY source ORDER BY doc_id, nth ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, NOT rep AND n <= 256 AND ch <= 65536 AS kept FROM c)
SELECT source, count(*) FILTER (kept) AS kept, count(*) FILTER (rep) AS repeats, count(*) FILTER (NOT rep AND NOT kept) AS dropped FROM k GROUP BY source"""


def progress_events(spark: SparkSession, d: str) -> DataFrame:
    """Encode events as protocol lines, parse them, map to overall percent, keep the running maximum."""
    stages = F.element_at(F.array(*[F.lit(s) for s in protocol.RANGES]), (F.col("event_id") % 5 + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", "user_id", protocol.encode(F.struct(F.lit("progress").alias("type"), stages.alias("stage"), (F.col("event_id") % 11).cast("double").alias("current"), F.lit(10.0).alias("total"))).alias("value"))
    got = protocol.events(e).withColumn("percent", protocol.overall(F.col("stage"), F.col("current"), F.col("total")))
    return protocol.monotone(got, ["user_id"], "event_id").select("user_id", "event_id", F.round("percent", 6).alias("percent"), "emit")


PROGRESS_EVENTS = """WITH e AS (SELECT user_id, event_id, [0, 8, 18, 88, 98][event_id % 5 + 1] + least(1.0, (event_id % 11) / 10.0) * [8, 10, 70, 10, 2][event_id % 5 + 1] AS pc FROM events),
m AS (SELECT user_id, event_id, max(CAST(pc AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS percent FROM e)
SELECT user_id, event_id, round(percent, 6) AS percent, coalesce(floor(percent) > floor(lag(percent) OVER (PARTITION BY user_id ORDER BY event_id)), true) AS emit FROM m"""


def normalize_image(spark: SparkSession, d: str) -> DataFrame:
    p = fx.prob(spark, d).select("row", "col", F.lit(0).alias("band"), (F.col("p").cast("double") * 100).alias("value"))
    out = image.normalise(p, [0.1], [0.5], None, ["row"])
    return out.select("row", "col", F.round("value", 6).alias("value"))


NORMALIZE_IMAGE = f"""WITH {fx.PROB_SQL}, v AS (SELECT row, col, CAST(p AS DOUBLE) * 100 AS x FROM prob)
SELECT row, col, round((x / CASE WHEN max(x) OVER (PARTITION BY row) > 2 THEN 255.0 ELSE 1.0 END - 0.1) / 0.5, 6) AS value FROM v"""


def percentile_stretch(spark: SparkSession, d: str) -> DataFrame:
    p = fx.prob(spark, d).select("row", "col", (F.col("col") % 3).alias("band"), F.col("p").cast("double").alias("value"))
    return image.stretch(p).groupBy("band", "value").agg(F.count("*").alias("n"))


PERCENTILE_STRETCH = f"""WITH {fx.PROB_SQL}, v AS (SELECT col % 3 AS band, CAST(p AS DOUBLE) AS x FROM prob),
q AS (SELECT band, quantile_cont(x, 0.02) AS a, quantile_cont(x, 0.98) AS b FROM v GROUP BY band)
SELECT CAST(band AS INTEGER) AS band, CAST(trunc(greatest(0.0, least(255.0, (x - a) * 255.0 / (b - a)))) AS INTEGER) AS value, count(*) AS n FROM v JOIN q USING (band) GROUP BY 1, 2"""


def model_softmax(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(image.softmax(F.transform("embedding", lambda x: x.cast("double")), 3), 9).alias("p"))


MODEL_SOFTMAX = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT vec_id, round(exp(e[4]) / list_sum(list_transform(e, lambda x: exp(x))), 9) AS p FROM v"""


def _build():
    """A linear model: logit of class 1 is the band, of class 0 is 0."""
    return lambda x: np.stack([np.zeros_like(x[0]), x[0]])


def model_predict(spark: SparkSession, d: str) -> DataFrame:
    pixels = fx.prob(spark, d).select("row", "col", "valid", F.col("p").alias("b0"))
    out = inference.predict(pixels, ["b0"], [], _build, 1, fx.WIDTH, fx.height(spark, d), core=48, halo=4, mode="image")
    return out.groupBy("row").agg(F.count("p").alias("n"), F.round(F.avg(F.col("p").cast("double")), 4).alias("p"))


MODEL_PREDICT = f"WITH {fx.PROB_SQL} SELECT row, count(*) FILTER (valid) AS n, round(avg(1 / (1 + exp(-CAST(p AS DOUBLE)))) FILTER (valid), 4) AS p FROM prob GROUP BY row"


def affine_points(spark: SparkSession, d: str) -> DataFrame:
    """All pixel centres to map and back."""
    t = Affine(2.0, 0.5, 1000.0, 0.25, -2.0, 5000.0)
    g = fx.grid(spark, d)
    x, y = t.to_map(F.col("col") + 0.5, F.col("row") + 0.5)
    c, r = t.to_pixel(x, y)
    return g.select("row", "col", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(c, 6).alias("back_col"), F.round(r, 6).alias("back_row"))


AFFINE_POINTS = f"""WITH {fx.PROB_SQL} SELECT row, col, CAST(round(2.0 * (col + 0.5) + 0.5 * (row + 0.5) + 1000, 6) AS DOUBLE) AS x, CAST(round(0.25 * (col + 0.5) - 2.0 * (row + 0.5) + 5000, 6) AS DOUBLE) AS y,
 CAST(col + 0.5 AS DOUBLE) AS back_col, CAST(row + 0.5 AS DOUBLE) AS back_row FROM prob"""


def layer_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit(" a/b:"), F.col("n_name"), F.lit("|x,y ")).alias("raw"))
    return n.select("n_nationkey", config.layer_name(F.col("raw")).alias("layer"), config.source_path(F.col("raw")).alias("path"), config.base_name(F.concat(F.lit("/x/y/"), F.col("raw"), F.lit(".tif"))).alias("base"))


LAYER_NAMES = """SELECT n_nationkey, 'a_b_' || n_name || '_x_y' AS layer, ' a/b:' || n_name AS path, 'b:' || n_name || '|x,y ' AS base FROM nation"""


def prompt_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as operations of a prompt session; no SQL holds the state machine."""
    e = table(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    ops = e.select(F.col("user_id").cast("string").alias("session_id"), n.cast("long").alias("seq"), F.col("event_id"))
    op = F.when(F.col("seq") == 1, "init").when(F.col("seq") == 2, "set_image").when(F.col("event_id") % 9 == 0, "clear_context").otherwise("predict")
    message = F.when(op == "set_image", '{"image":"i"}').when(op == "predict", F.concat(F.lit('{"positive":[['), (F.col("event_id") % 100).cast("string"), F.lit(",5]]}")))
    return sessions.run(ops.select("session_id", "seq", op.alias("op"), message.alias("message")))


QUERIES = {
    "bundle_scan": bundle_scan, "config_merge": config_merge, "diagnostics": diagnostics, "progress_events": progress_events, "normalize_image": normalize_image, "percentile_stretch": percentile_stretch,
    "model_softmax": model_softmax, "model_predict": model_predict, "affine_points": affine_points, "layer_names": layer_names, "prompt_sessions": prompt_sessions,
}
ORACLE_SQL = {
    "bundle_scan": BUNDLE_SCAN, "config_merge": CONFIG_MERGE, "diagnostics": DIAGNOSTICS, "progress_events": PROGRESS_EVENTS, "normalize_image": NORMALIZE_IMAGE, "percentile_stretch": PERCENTILE_STRETCH,
    "model_softmax": MODEL_SOFTMAX, "model_predict": MODEL_PREDICT, "affine_points": AFFINE_POINTS, "layer_names": LAYER_NAMES,
}
