"""Connected components of masks, their records, and hole filling.

Pixels are labelled inside tiles in numpy; labels that touch across tile borders become edges of a small graph whose
components are found by alternating stars; then labels are renamed. A label is a position code that grows tile by
tile and in scan order inside a tile, so the smallest label of a component also orders components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.graph import connected_components
from rasterloom.operators.ranking import global_rank
from rasterloom.operators.tiling import BLOCK
from rasterloom.session import materialize

FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]
EIGHT = [*FOUR, (-1, -1), (-1, 1), (1, -1), (1, 1)]


def label_array(mask: np.ndarray, connectivity: int) -> np.ndarray:
    """The smallest flat position of each pixel's component, -1 on background: neighbours' minima with pointer jumps."""
    h, w = mask.shape
    size = h * w
    parent = np.append(np.where(mask.ravel(), np.arange(size), size), size)
    ids = np.pad(np.arange(size).reshape(h, w), 1, constant_values=size)
    fore = np.flatnonzero(mask.ravel())
    near = [(r, c) for r, c in (EIGHT if connectivity == 8 else FOUR)]
    around = [ids[1 + r : 1 + r + h, 1 + c : 1 + c + w].ravel()[fore] for r, c in near]
    while True:
        low = parent[fore]
        for n in around:
            low = np.minimum(low, parent[n])
        new = parent.copy()
        np.minimum.at(new, parent[fore], low)
        new[fore] = np.minimum(new[fore], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, parent):
            break
        parent = new
    return np.where(mask.ravel(), parent[:size], -1).reshape(h, w)


def label(pixels: DataFrame, connectivity: int = 8, block: int = BLOCK) -> DataFrame:
    """row, col, label of foreground pixels (one row each: row int, col int), label being the smallest of its component.

    No grid size is needed: tiles come from the coordinates. Only pixels on tile borders enter the graph.
    """
    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        br, bc = int(pdf["block_row"].iloc[0]), int(pdf["block_col"].iloc[0])
        r, c = pdf["row"].to_numpy() - br * block, pdf["col"].to_numpy() - bc * block
        mask = np.zeros((r.max() + 1, c.max() + 1), bool)
        mask[r, c] = True
        low = label_array(mask, connectivity)[r, c]
        code = ((br << 20) + bc) * (block * block) + low // mask.shape[1] * block + low % mask.shape[1]
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "label": code})

    tiled = pixels.select("row", "col", F.floor(F.col("row") / block).cast("int").alias("block_row"), F.floor(F.col("col") / block).cast("int").alias("block_col"))
    found = materialize(tiled.groupBy("block_row", "block_col").applyInPandas(local, "row int, col int, label long"), "labels-local")
    rim = found.filter(f"row % {block} in (0, {block - 1}) or col % {block} in (0, {block - 1})")
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in (EIGHT if connectivity == 8 else FOUR)])
    out = rim.withColumn("step", F.explode(steps)).select((F.col("row") + F.col("step.r")).alias("row"), (F.col("col") + F.col("step.c")).alias("col"), F.col("label").alias("src"))
    edges = out.join(rim.withColumnRenamed("label", "dst"), ["row", "col"]).filter("src <> dst").select("src", "dst").distinct()
    roots = connected_components(edges)
    return found.join(roots, F.col("label") == F.col("id"), "left").select("row", "col", F.coalesce("root", "label").alias("label"))


def sizes(labels: DataFrame, width: int, height: int) -> DataFrame:
    """label, pixel_count, border: whether the component touches the image's border."""
    edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == height - 1) | (F.col("col") == width - 1)
    return labels.groupBy("label").agg(F.count("*").alias("pixel_count"), F.bool_or(edge).alias("border"))


def records(labels: DataFrame, width: int, height: int) -> DataFrame:
    """sizes with comp_id, which numbers components by their first pixel, tile by tile of the labelling."""
    return global_rank(sizes(labels, width, height), ["label"], "comp_id")


def fill_holes(mask: DataFrame, max_pixels: int | None, width: int, height: int, block: int = BLOCK, hole_connectivity: int = 4) -> DataFrame:
    """Dense mask (row, col, m[, valid]) with small background components that do not touch the border set to 1.

    max_pixels None fills all of them. Invalid pixels count as background, and are cleared again afterwards.
    """
    empty = mask.filter("m = 0").select("row", "col")
    holes = label(empty, hole_connectivity, block)
    small = sizes(holes, width, height).filter("not border")
    small = small if max_pixels is None else small.filter(F.col("pixel_count") <= max_pixels)
    fill = holes.join(small.select("label"), "label", "left_semi").select("row", "col", F.lit(1).alias("fill"))
    out = mask.join(fill, ["row", "col"], "left").withColumn("m", F.greatest("m", F.coalesce("fill", F.lit(0)))).drop("fill")
    return out.withColumn("m", F.when(F.col("valid"), F.col("m")).otherwise(0)) if "valid" in mask.columns else out


def hole_limit(max_area: float, pixel_area: float) -> int:
    """At least one pixel, so a limit of 0 still fills single pixels."""
    return max(1, int(max_area / pixel_area))


def near_points(labels: DataFrame, points: DataFrame, reach: int = 2) -> DataFrame:
    """point columns with the labels within +-reach cells: a band join made equi by exploding each point's cells."""
    shift = F.sequence(F.lit(-reach), F.lit(reach))
    cells = points.withColumn("_r", F.explode(shift)).withColumn("_c", F.explode(shift))
    cells = cells.withColumn("row", (F.bround("y") + F.col("_r")).cast("int")).withColumn("col", (F.bround("x") + F.col("_c")).cast("int")).drop("_r", "_c")
    return cells.join(labels, ["row", "col"]).drop("row", "col").distinct()


def keep_prompted(labels: DataFrame, points: DataFrame, reach: int = 2, disc: int = 4) -> DataFrame:
    """Pixels of components that positives hit, less those that only negatives hit, less discs around hit negatives,
    then again only components that positives hit. Without positives nothing is kept by hits, only removed.

    points: x, y, label (1 positive, 0 negative).
    """
    positive, negative = points.filter("label = 1").select("x", "y"), points.filter("label = 0").select("x", "y")
    hit = near_points(labels, positive, reach).select("label").distinct()
    missed = near_points(labels, negative, reach).select("label").distinct().join(hit, "label", "left_anti")
    left = labels.join(missed, "label", "left_anti")
    any_positive = positive.limit(1).count() > 0
    if any_positive:
        left = left.join(hit, "label", "left_semi")
    bad = near_points(labels, negative, reach).select("x", "y").distinct()
    span = F.sequence(F.lit(-disc), F.lit(disc))
    erased = bad.withColumn("_r", F.explode(span)).withColumn("_c", F.explode(span)).filter(f"_r * _r + _c * _c <= {disc * disc}")
    erased = erased.select((F.bround("y") + F.col("_r")).cast("int").alias("row"), (F.bround("x") + F.col("_c")).cast("int").alias("col")).distinct()
    left = left.join(erased, ["row", "col"], "left_anti")
    if not any_positive:
        return left.select("row", "col")
    again = label(left.select("row", "col"), 8)
    return again.join(near_points(again, positive, reach).select("label").distinct(), "label", "left_semi").select("row", "col")
