"""Prompted masks: candidate ranking, selection, refinement rules, crops."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of the ranking rules and of the crop.
LARGE, EDGE_AREA, EDGE_RATIO, GROWTH, SHRINK = 0.8, 0.45, 0.08, 2.2, 0.08
CROP, SCALE_MIN, SCALE_MAX, SPAN = 1024, 0.25, 8.0, 1.4
LEAST_CONTOUR, CONTOUR_SHARE = 64.0, 2e-6


def initial_mask(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of candidates (idx, score, area_ratio) covering less than LARGE the best score, else the smallest area; the
    first index wins ties. One aggregation with struct ordering; no sort."""
    best = F.max(F.when(F.col("area_ratio") < LARGE, F.struct(F.col("score"), (-F.col("idx")).alias("i"))))
    least = F.min(F.struct("area_ratio", "idx"))
    return candidates.groupBy(*keys).agg(best.alias("b"), least.alias("l")).select(*keys, F.coalesce(-F.col("b.i"), F.col("l.idx")).cast("int").alias("idx"))


def result_rank(negative_hits: Column, positive_misses: Column, area: Column, boundary: Column, score: Column, previous: Column, retention: Column) -> list[Column]:
    """Ten numbers, greater is better, compared in order."""
    ratio = F.when(previous > 0, area / previous)
    flag = lambda c: -F.coalesce(c, F.lit(False)).cast("int")
    return [-negative_hits, -positive_misses, flag(ratio < SHRINK), flag(ratio > GROWTH), flag(area >= LARGE), flag((area >= EDGE_AREA) & (boundary > EDGE_RATIO)), retention, score, -boundary, -area]


def prompt_mask(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate with the greatest rank: raw negative hits and positive misses, then the cleaned mask's ten
    numbers; the earliest index wins ties. Columns: idx, raw_neg, raw_miss, neg, miss, area, boundary, score,
    previous, retention."""
    c = F.col
    ten = result_rank(c("neg"), c("miss"), c("area"), c("boundary"), c("score"), c("previous"), c("retention"))
    rank = F.struct(*[x.alias(f"k{i}") for i, x in enumerate([-c("raw_neg"), -c("raw_miss"), *ten, -c("idx")])])
    return candidates.groupBy(*keys).agg(F.max(rank).alias("r")).select(*keys, (-F.col("r.k12")).cast("int").alias("idx"))


def needs_fallback(misses: Column, hits: Column, area: Column, boundary: Column, previous: Column, negatives: Column) -> Column:
    """A violated prompt, a mask over almost the whole crop, a large one along the edge, or a jump in size."""
    ratio = F.when(previous > 0, area / previous)
    jump = F.coalesce(ratio > GROWTH, F.lit(False)) | (F.coalesce(ratio < SHRINK, F.lit(False)) & (negatives > 0))
    return (misses > 0) | (hits > 0) | (area >= LARGE) | ((area >= EDGE_AREA) & (boundary > EDGE_RATIO)) | jump


def prompt_error(misses: Column, hits: Column) -> Column:
    return misses * 2 + hits * 3


def mask_measures(pixels: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """area_ratio and boundary_ratio of masks given by foreground pixels: border pixels over 2 h + 2 w, corners twice."""
    edge = (F.col("row") == 0).cast("int") + (F.col("row") == height - 1).cast("int") + (F.col("col") == 0).cast("int") + (F.col("col") == width - 1).cast("int")
    return pixels.groupBy(*keys).agg((F.count("*") / (height * width)).alias("area_ratio"), (F.sum(edge) / (2 * height + 2 * width)).alias("boundary_ratio"))


def point_hits(points: DataFrame, pixels: DataFrame, reach: int = 2) -> DataFrame:
    """points (id, x, y, label) with hit: a mask pixel lies within +-reach of the point rounded half to even."""
    shift = F.sequence(F.lit(-reach), F.lit(reach))
    cells = points.withColumn("_r", F.explode(shift)).withColumn("_c", F.explode(shift))
    cells = cells.select("id", (F.bround("y") + F.col("_r")).cast("int").alias("row"), (F.bround("x") + F.col("_c")).cast("int").alias("col"))
    hit = cells.join(pixels.select("row", "col").distinct(), ["row", "col"], "left_semi").select("id").distinct().withColumn("hit", F.lit(True))
    return points.join(hit, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def violations(hits: DataFrame, keys: list[str]) -> DataFrame:
    return hits.groupBy(*keys).agg(F.count_if((F.col("label") == 1) & ~F.col("hit")).alias("misses"), F.count_if((F.col("label") == 0) & F.col("hit")).alias("negative_hits"))


def signature(points: Column) -> Column:
    """Coordinates rounded half to even at three decimals."""
    return F.transform(points, lambda p: F.struct(F.bround(p["x"], 3).alias("x"), F.bround(p["y"], 3).alias("y"), p["label"].alias("label")))


def extends(previous: Column, current: Column) -> Column:
    """previous is a prefix of current."""
    return (F.size(previous) == 0) | ((F.size(current) >= F.size(previous)) & (F.slice(current, F.lit(1), F.greatest(F.size(previous), F.lit(1))) == previous))


def crop_scale(scale: Column) -> Column:
    number = F.expr("try_cast(_s as double)") if isinstance(scale, str) else scale.try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (number <= 0), 1.0).otherwise(F.greatest(F.lit(SCALE_MIN), F.least(F.lit(SCALE_MAX), number)))


def crop_window(points: DataFrame, keys: list[str], width: int, height: int, scale: Column | float = 1.0) -> DataFrame:
    """left, top, right, bottom of the crop around each key's prompts (x, y): CROP * scale or SPAN times their extent,
    shifted into the image, rounded outward."""
    s = crop_scale(F.lit(scale) if not isinstance(scale, Column) else scale)
    box = points.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    size = F.least(F.greatest(F.lit(float(CROP)) * s, span * SPAN), F.lit(float(max(width, height))))
    out = box.withColumn("size", size)

    def side(a: str, b: str, whole: int) -> tuple[Column, Column]:
        fit = F.least(F.col("size"), F.lit(float(whole)))
        low = F.greatest(F.lit(0.0), F.least((F.col(a) + F.col(b)) / 2 - fit / 2, F.lit(float(whole)) - fit))
        return F.floor(low).cast("int"), F.least(F.lit(whole), F.ceil(low + fit)).cast("int")

    (left, right), (top, bottom) = side("x0", "x1", width), side("y0", "y1", height)
    return out.select(*keys, left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def to_crop(x: Column, left: Column, right: Column) -> Column:
    return (x - left) * F.lit(CROP - 1) / F.greatest(F.lit(1), right - left)


def from_crop(x: Column, left: Column, right: Column) -> Column:
    return F.bround(left + x * (right - left) / F.lit(CROP - 1))


def in_crop(x: Column, y: Column, c: str = "") -> Column:
    """Reuse test: inside, both ends included."""
    return (x >= F.col(f"{c}left")) & (x <= F.col(f"{c}right")) & (y >= F.col(f"{c}top")) & (y <= F.col(f"{c}bottom"))


def latest(events: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Queued prompts coalesce: the last value of each key."""
    return events.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.count("*").alias("queued"))


def undo(history: Column) -> Column:
    """A point history without its last point."""
    return F.when(F.size(history) > 0, F.slice(history, F.lit(1), F.size(history) - 1)).otherwise(history)


def prompt_points(positive: Column, negative: Column) -> Column:
    """Two arrays of (x, y) as one array of (x, y, label), positives first; without any point an error."""
    of = lambda points, label: F.transform(F.coalesce(points, F.array().cast("array<struct<x:double,y:double>>")), lambda p: F.struct(p["x"].cast("float").alias("x"), p["y"].cast("float").alias("y"), F.lit(label).alias("label")))
    both = F.concat(of(positive, 1), of(negative, 0))
    return F.when(F.size(both) > 0, both).otherwise(F.raise_error(F.lit("at least one prompt point is needed")).cast("array<struct<x:float,y:float,label:int>>"))


def predict_request(request_id: Column, positive: Column, negative: Column, inside: Column) -> Column:
    """A request as JSON; points that could not be mapped (null coordinates) are left out, and a request outside the image
    (inside false) or without a positive point is null."""
    whole = lambda points: F.filter(F.coalesce(points, F.array().cast("array<struct<x:double,y:double>>")), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    body = F.to_json(F.struct(request_id.alias("id"), F.lit("predict").alias("op"), whole(positive).alias("positive"), whole(negative).alias("negative")))
    return F.when(inside & (F.size(whole(positive)) > 0), body)


def use_multimask(asked: Column, previous: Column) -> Column:
    """Several candidates are asked for on request, or where there is no mask before."""
    return F.coalesce(asked, F.lit(False)) | previous.isNull()


def selector(multimask: Column, masks: Column, negatives: Column) -> Column:
    """Which rule picks the mask: initial, prompt or only (a single candidate)."""
    return F.when(multimask & (negatives > 0), "prompt").when(multimask, "initial").when(masks == 1, "only").otherwise("prompt")


def large_contours(contours: DataFrame, height: int, width: int, area: str = "area") -> DataFrame:
    """Contours of at least LEAST_CONTOUR cells and CONTOUR_SHARE of the mask."""
    return contours.filter(F.abs(F.col(area)) >= max(LEAST_CONTOUR, CONTOUR_SHARE * height * width))


def masks_of(masks: np.ndarray) -> list[np.ndarray]:
    """The candidates of a predictor's answer (one mask, or many, or many of one channel) as planes, in their order."""
    masks = np.asarray(masks)
    if masks.ndim == 4 and masks.shape[1] == 1:
        masks = masks[:, 0]
    if masks.ndim not in (2, 3):
        raise ValueError(f"masks of shape {masks.shape}")
    return [masks] if masks.ndim == 2 else list(masks)


def low_resolution(masks: np.ndarray, index: int) -> np.ndarray:
    """The chosen candidate's low-resolution mask with its leading axis; the first one where the index is past the end."""
    masks = np.asarray(masks)
    if masks.ndim < 2:
        return masks
    if masks.ndim == 2:
        return masks[None]
    return masks[index : index + 1] if index < len(masks) else masks[:1]
