"""Image values: normalisation, stretching, channel order, softmax, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.stats import finite


def normalise(pixels: DataFrame, mean: list[float] | None = None, std: list[float] | None = None, scale: float | None = None, tile: list[str] | None = None) -> DataFrame:
    """(band, value) -> value / scale, then (value - mean) / std by band; a std of 0 counts as 1.

    Without scale it is 255 where the tile's greatest value is above 2, else 1 (so it depends on the tiling).
    """
    v = F.col("value").cast("double")
    if scale is None:
        top = F.max(finite(v)).over(Window.partitionBy(*(tile or [F.lit(0)])))
        v = v / F.when(top > 2, 255.0).otherwise(1.0)
    else:
        v = v / F.lit(float(scale))
    if mean and std and len(mean) == len(std):
        of = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), F.col("band") + 1)
        v = (v - of(mean)) / F.when(of(std) == 0, 1.0).otherwise(of(std))
    return pixels.withColumn("value", v)


def standardise(factors: DataFrame, names: list[str], mean: dict[str, float], std: dict[str, float], active: list[str] | None = None) -> DataFrame:
    """Named planes to zero mean and unit deviation; inactive ones become 0."""
    out = {n: F.when(F.lit(active is None or n in active), (F.col(n) - mean.get(n, 0.0)) / (std.get(n) or 1.0)).otherwise(0.0) for n in names}
    return factors.withColumns(out)


def stretch(pixels: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(band, value) -> value as 0..255: between two exact percentiles of the band, else its extremes, else 0."""
    v = finite(F.col("value").cast("double"))
    cut = pixels.groupBy("band").agg(F.percentile(v, F.array(F.lit(low), F.lit(high))).alias("q"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    narrow = F.col("q")[1] > F.col("q")[0]
    a, b = F.when(narrow, F.col("q")[0]).otherwise(F.col("lo")), F.when(narrow, F.col("q")[1]).otherwise(F.col("hi"))
    scaled = F.when(b > a, F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v - a) * 255.0 / (b - a)))).otherwise(0.0)
    return pixels.join(F.broadcast(cut), "band").withColumn("value", scaled.cast("int")).drop("q", "lo", "hi")


def to_rgb(pixels: DataFrame, order: str = "bgr") -> DataFrame:
    """Grey is repeated, BGR and BGRA are reordered; alpha goes."""
    if order == "gray":
        return pixels.withColumn("band", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    return pixels.filter("band < 3").withColumn("band", (2 - F.col("band")).cast("int"))


def softmax(logits: Column, index: int) -> Column:
    """Probability of one class of an array of logits; an index outside it is an error."""
    if index < 0:
        raise ValueError("a class index counts from 0")
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    short = F.raise_error(F.concat(F.lit(f"no class {index} among "), F.size(logits).cast("string"))).cast("double")
    return F.when(F.size(logits) <= index, short).otherwise(F.exp(F.get(logits, F.lit(index)) - top) / total)


def resize_nearest(pixels: DataFrame, height: int, width: int, new_height: int, new_width: int, grid: DataFrame) -> DataFrame:
    """grid (row, col of the new size) joined with the source cell floor(i * old / new)."""
    at = grid.select("row", "col", F.floor(F.col("row") * height / new_height).cast("int").alias("_r"), F.floor(F.col("col") * width / new_width).cast("int").alias("_c"))
    return at.join(pixels.withColumnsRenamed({"row": "_r", "col": "_c"}), ["_r", "_c"]).drop("_r", "_c")


def named_factors(pixels: DataFrame, planes: str, names: list[str]) -> DataFrame:
    """An array column of planes as one column per declared name; another number of planes is an error."""
    wrong = F.raise_error(F.concat(F.size(planes).cast("string"), F.lit(f" factor planes for {len(names)} names"))).cast("double")
    plane = lambda i: F.when(F.size(planes) == len(names), F.get(F.col(planes), F.lit(i))).otherwise(wrong)
    return pixels.withColumns({n: plane(i) for i, n in enumerate(names)}).drop(planes)


def require_factors(pixels: DataFrame, names: list[str]) -> DataFrame:
    """The named factor columns in their order; a missing one is an error."""
    if missing := [n for n in names if n not in pixels.columns]:
        raise ValueError(f"factors missing: {missing}")
    return pixels.select("row", "col", *names)
