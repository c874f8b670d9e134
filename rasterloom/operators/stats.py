"""Thresholds and statistics of probability rasters. NoData is null: NaN and infinities become null on the way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Histogram bins and the percentiles of the audit.
BINS = 10_000
PERCENTS = (50, 90, 95, 99)


def finite(value: Column) -> Column:
    """value, or null where it is NaN or infinite (Spark orders NaN above every number)."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def above(p: Column, threshold: float) -> Column:
    """finite(p) >= threshold compared as 32-bit floats; null counts as false."""
    return F.coalesce(finite(p) >= F.lit(threshold).cast("float"), F.lit(False))


def histogram_bin(p: Column) -> Column:
    """Bin of p, the product truncated in 32-bit arithmetic."""
    scaled = (p * F.lit(float(BINS)).cast("float")).cast("float")
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), scaled.cast("int")))


def multiband_valid(bands: DataFrame) -> DataFrame:
    """row, col, valid: no band is masked."""
    return bands.groupBy("row", "col").agg(F.bool_and(finite(F.col("value")).isNotNull()).alias("valid"))


def probability_stats(pixels: DataFrame, threshold: float) -> DataFrame:
    p = finite(F.col("p"))
    return pixels.agg(
        F.min(p).cast("double").alias("min"), F.max(p).cast("double").alias("max"), (F.sum(p.cast("double")) / F.count(p)).alias("mean"),
        F.count(p).alias("count"), F.sum(above(F.col("p"), threshold).cast("long")).alias("above"),
    )


def probability_histogram(pixels: DataFrame) -> DataFrame:
    good = pixels.select(finite(F.col("p")).alias("p")).filter("p is not null")
    return good.groupBy(histogram_bin(F.col("p")).alias("bin")).agg(F.count("*").alias("n"))


def histogram_percentiles(histogram: DataFrame, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """percent, value: midpoint of the first bin whose running count reaches ceil(n percent / 100). At most BINS rows
    reach the single-partition window."""
    run = histogram.withColumn("upto", F.sum("n").over(Window.orderBy("bin")))
    run = run.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    hits = run.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    hits = hits.filter(F.col("upto") >= F.ceil(F.col("total") * F.col("percent") / 100))
    return hits.groupBy("percent").agg(((F.min("bin") + F.lit(0.5)) / BINS).alias("value"))


def exact_percentiles(pixels: DataFrame, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """Linear interpolation between sorted values."""
    got = pixels.agg(F.percentile(finite(F.col("p")).cast("double"), F.array(*[F.lit(q / 100) for q in percents])).alias("v"))
    return got.select(F.posexplode("v").alias("i", "value")).select(F.element_at(F.array(*[F.lit(q) for q in percents]), F.col("i") + 1).alias("percent"), "value")


def mask_count(mask: DataFrame) -> DataFrame:
    return mask.agg(F.sum(F.col("m").cast("long")).alias("n"))


def class_ids(features: DataFrame, fallback: list[int]) -> DataFrame:
    """Distinct class ids in order; the label list's where there is no feature."""
    found = F.sort_array(F.collect_set("class_id"))
    return features.agg(F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(i) for i in fallback])).alias("class_ids"))
