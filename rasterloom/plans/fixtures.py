"""Rasters, regions and candidates derived from the reference tables by the same arithmetic on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.session import table

WIDTH = 64
THRESHOLD = 0.1


def prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row = vec_id, col = position, p = component."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "p"))
    r, c = F.col("row"), F.col("col")
    return e.withColumn("valid", (r * 7 + c * 3) % 97 != 0)


def height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the raster: a number about it, from Parquet statistics."""
    return int(table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]) + 1


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob(spark, sf_dir).select("row", "col")


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = F.col("row"), F.col("col")
    return grid(spark, sf_dir).select("row", "col", ((r * 37 + c * 17 + r * c) % 101).cast("float").alias("z"))


def dem_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).select("row", "col", ((F.col("row") + F.col("col")) % 5 == 0).alias("dem_filled"))


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles from orders: origin user for finished ones, else inference; runs r0..r2."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    user = F.col("o_orderstatus") == "F"
    return o.select(
        k.alias("id"), ((k * 7) % 400).cast("int").alias("row0"), ((k * 13) % 300).cast("int").alias("col0"), (1 + k % 4).cast("int").alias("h"), (1 + F.col("o_custkey") % 5).cast("int").alias("w"),
        F.when(user, "user").otherwise("inference").alias("origin"), F.when(~user, F.concat(F.lit("r"), (k % 3).cast("string"))).alias("run_id"),
    )


def cells(rectangles: DataFrame) -> DataFrame:
    down = F.explode(F.sequence(F.col("row0"), F.col("row0") + F.col("h") - 1))
    out = rectangles.withColumn("row", down)
    return out.withColumn("col", F.explode(F.sequence(F.col("col0"), F.col("col0") + F.col("w") - 1))).select("row", "col", "origin", "run_id", "id")


#: The same tables in DuckDB.
PROB_SQL = """prob AS MATERIALIZED (
  SELECT CAST(vec_id AS INTEGER) AS row, CAST(i - 1 AS INTEGER) AS col, embedding[i] AS p,
         (vec_id * 7 + (i - 1) * 3) % 97 <> 0 AS valid
  FROM embeddings, generate_series(1, 64) t(i))"""
DEM_SQL = """dem AS MATERIALIZED (
  SELECT row, col, CAST((row * 37 + col * 17 + row * col) % 101 AS DOUBLE) AS z, (row + col) % 5 = 0 AS dem_filled FROM prob)"""
RECTS_SQL = """rects AS MATERIALIZED (
  SELECT o_orderkey AS id, CAST((o_orderkey * 7) % 400 AS INTEGER) AS row0, CAST((o_orderkey * 13) % 300 AS INTEGER) AS col0,
         CAST(1 + o_orderkey % 4 AS INTEGER) AS h, CAST(1 + o_custkey % 5 AS INTEGER) AS w,
         CASE WHEN o_orderstatus = 'F' THEN 'user' ELSE 'inference' END AS origin,
         CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'r' || (o_orderkey % 3) END AS run_id
  FROM orders),
cells AS MATERIALIZED (
  SELECT CAST(row0 + a AS INTEGER) AS row, CAST(col0 + b AS INTEGER) AS col, origin, run_id, id
  FROM rects, generate_series(0, 3) t(a), generate_series(0, 4) u(b) WHERE a < h AND b < w)"""


def components_sql(pixels: str, eight: bool = True, width: str = "64", name: str = "lab") -> str:
    """CTEs that label the pixels (row, col) of a relation by the smallest row * width + col of their component."""
    steps = "(-1,0),(1,0),(0,-1),(0,1)" + (",(-1,-1),(-1,1),(1,-1),(1,1)" if eight else "")
    return f"""{name}_px AS MATERIALIZED (SELECT CAST(row AS BIGINT) * {width} + col AS id, row, col FROM {pixels}),
{name}_st AS MATERIALIZED (SELECT * FROM (VALUES {steps}) o(dr, dc)),
{name}_ed AS MATERIALIZED (
  SELECT a.id AS s, b.id AS d FROM (SELECT id, row + dr AS row, col + dc AS col FROM {name}_px CROSS JOIN {name}_st) a
  JOIN {name}_px b ON a.row = b.row AND a.col = b.col),
{name}_rc AS (SELECT id, id AS root FROM {name}_px UNION SELECT e.d AS id, r.root FROM {name}_rc r JOIN {name}_ed e ON e.s = r.id),
{name}_lo AS MATERIALIZED (SELECT id, min(root) AS label FROM {name}_rc GROUP BY id),
{name} AS MATERIALIZED (SELECT p.row, p.col, l.label FROM {name}_px p JOIN {name}_lo l ON p.id = l.id)"""
