"""Tiles that arrive as files: thresholded and summarised as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterloom.operators import stats

TILE = "raster_id string, band int, block_row int, block_col int, row_off int, col_off int, height int, width int, data array<float>"


def tile_stream(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    return spark.readStream.schema(TILE).option("maxFilesPerTrigger", max_files).parquet(folder)


def tile_masks(tiles: DataFrame, threshold: float) -> DataFrame:
    """Each tile with its mask (0/1 array), valid and foreground counts; expressions only, so stateless and JVM-side."""
    good = F.transform("data", lambda v: stats.finite(v))
    mask = F.transform("data", lambda v: stats.above(v, threshold).cast("tinyint"))
    out = tiles.withColumn("mask", mask).withColumn("valid", F.size(F.filter(good, lambda v: v.isNotNull())))
    return out.withColumn("foreground", F.aggregate("mask", F.lit(0), lambda s, v: s + v.cast("int"))).drop("data")


def ingest(tiles: DataFrame, threshold: float, path: str, checkpoint: str) -> StreamingQuery:
    """Masks to a Parquet table partitioned by raster; all files present are read, then the query ends."""
    writer = tile_masks(tiles, threshold).writeStream.format("parquet").partitionBy("raster_id").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def pixels_of(tiles: DataFrame, value: str = "data", out: str = "p") -> DataFrame:
    """Long form of tile rows."""
    at = tiles.select("row_off", "col_off", "width", F.posexplode(value).alias("i", out))
    return at.select((F.col("row_off") + F.floor(F.col("i") / F.col("width"))).cast("int").alias("row"), (F.col("col_off") + F.col("i") % F.col("width")).cast("int").alias("col"), out)
