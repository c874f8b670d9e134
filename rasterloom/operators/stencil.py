"""Neighbourhood operators: binary morphology with square elements, focal statistics, gradients.

Two physical forms with equal results. Frames: a square element is separable, so an operator is a window along
rows and one along columns; consecutive passes on the same axis share a shuffle (a closing takes three, not four).
Tiles: pixels are replicated into the tiles whose halo they lie in, one numpy call runs per tile, cores are kept;
one shuffle whatever the number of passes. Outside the image counts as background, so erosion eats the border.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.tiling import halo_pixels


def _odd(size: int) -> int:
    if size < 1 or size % 2 == 0:
        raise ValueError("a focal window needs an odd side")
    return size // 2


def reach(size: int, kind: str) -> tuple[int, int]:
    """Cells before and after that an element of any side covers: an even one reaches further back when it erodes and
    further on when it dilates, so closing and opening do not move."""
    if size < 1:
        raise ValueError("a structuring element needs a side of at least 1")
    back, on = size // 2, size - 1 - size // 2
    return (back, on) if kind == "erode" else (on, back)


def _frame(axis: str, before: int, after: int):
    part, order = ("row", "col") if axis == "row" else ("col", "row")
    return Window.partitionBy(part).orderBy(order).rangeBetween(-before, after)


def _pass(mask: DataFrame, axis: str, size: int, kind: str) -> DataFrame:
    w = _frame(axis, *reach(size, kind))
    if kind == "dilate":
        return mask.withColumn("m", F.max("m").over(w))
    return mask.withColumn("m", F.when(F.count("m").over(w) < size, F.lit(0)).otherwise(F.min("m").over(w)))


def dilate(mask: DataFrame, size: int, axes: tuple[str, str] = ("row", "col")) -> DataFrame:
    for axis in axes:
        mask = _pass(mask, axis, size, "dilate")
    return mask


def erode(mask: DataFrame, size: int, axes: tuple[str, str] = ("row", "col")) -> DataFrame:
    for axis in axes:
        mask = _pass(mask, axis, size, "erode")
    return mask


def _masked(mask: DataFrame) -> DataFrame:
    """Clear invalid pixels, if the mask carries a column valid."""
    return mask.withColumn("m", F.when(F.col("valid"), F.col("m")).otherwise(F.lit(0))) if "valid" in mask.columns else mask


def _close(mask: DataFrame, size: int) -> DataFrame:
    return erode(dilate(mask, size), size, ("col", "row"))


def _open(mask: DataFrame, size: int) -> DataFrame:
    return dilate(erode(mask, size), size, ("col", "row"))


def closing(mask: DataFrame, size: int = 5) -> DataFrame:
    """Dense mask (row, col, m 0/1[, valid]) -> closed mask. Size 1 changes nothing but invalid pixels."""
    return _masked(_close(mask, size))


def opening(mask: DataFrame, size: int = 3) -> DataFrame:
    return _masked(_open(mask, size))


def smooth(mask: DataFrame, size: int = 3) -> DataFrame:
    """Closing, then opening; invalid pixels are cleared once, at the end."""
    return _masked(_open(_close(mask, size), size))


def focal(pixels: DataFrame, value: str, size: int | tuple[int, int], **aggregates: str) -> DataFrame:
    """Add focal means, minima and maxima over a window of size x size (or across x down) cut off at the image's edge.

    aggregates: new column -> "mean" | "min" | "max". Nulls are left out.
    """
    r, s = map(_odd, size if isinstance(size, tuple) else (size, size))
    along, across = _frame("row", r, r), _frame("col", s, s)
    first, second, final = {}, {}, {}
    for out, kind in aggregates.items():
        if kind == "mean":
            first |= {f"_{out}_s": F.sum(F.col(value).cast("double")).over(along), f"_{out}_n": F.count(value).over(along)}
            second |= {f"_{out}_s": F.sum(f"_{out}_s").over(across), f"_{out}_n": F.sum(f"_{out}_n").over(across)}
            final[out] = F.col(f"_{out}_s") / F.col(f"_{out}_n")
        else:
            agg = {"min": F.min, "max": F.max}[kind]
            first[f"_{out}"] = agg(value).over(along)
            second[f"_{out}"] = agg(f"_{out}").over(across)
            final[out] = F.col(f"_{out}")
    done = pixels.withColumns(first).withColumns(second).withColumns(final)
    return done.drop(*first)


def gradient(pixels: DataFrame, value: str, pixel_x: float, pixel_y: float) -> DataFrame:
    """Add dz_dx (eastward) and dz_dy (northward, rows running south): central differences, one-sided at the edge."""
    v = F.col(value).cast("double")

    def slope(part: str, order: str, step: float) -> Column:
        w = Window.partitionBy(part).orderBy(order)
        a, b = F.lag(v).over(w), F.lead(v).over(w)
        steps = a.isNotNull().cast("int") + b.isNotNull().cast("int")
        return F.when(steps == 0, 0.0).otherwise((F.coalesce(b, v) - F.coalesce(a, v)) / (F.greatest(steps, F.lit(1)) * step))

    return pixels.withColumn("dz_dx", slope("row", "col", pixel_x)).withColumn("dz_dy", -slope("col", "row", pixel_y))


def apply_tiles(pixels: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], halo: int, width: int, height: int, block: int = 512, value: str = "m") -> DataFrame:
    """row, col, value: fn(values, present) on each tile grown by a halo, cut back to its core.

    fn gets a dense array (0 where no row is) and the array of which cells have rows, and returns an array of the
    same shape; it is any stencil whose reach is at most halo.
    """
    kind = dict(pixels.dtypes)[value]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(pdf["row"].min()), int(pdf["col"].min())
        r, c = pdf["row"].to_numpy() - top, pdf["col"].to_numpy() - left
        grid = np.zeros((r.max() + 1, c.max() + 1), pdf[value].to_numpy().dtype)
        there = np.zeros(grid.shape, bool)
        grid[r, c], there[r, c] = pdf[value].to_numpy(), True
        out = fn(grid, there)
        core = pdf["core"].to_numpy()
        return pd.DataFrame({"row": pdf["row"].to_numpy()[core], "col": pdf["col"].to_numpy()[core], value: out[r[core], c[core]]})

    wide = halo_pixels(pixels.select("row", "col", value), block, halo, width, height)
    return wide.groupBy("block_row", "block_col").applyInPandas(run, f"row int, col int, `{value}` {kind}")


def morphology(grid: np.ndarray, size: int, kind: str) -> np.ndarray:
    """dilate | erode | close | open | smooth of a 0/1 array, background outside."""
    def slide(a: np.ndarray, step: str) -> np.ndarray:
        for axis in (0, 1):
            wide = np.pad(a, [reach(size, "dilate" if step == "d" else "erode") if i == axis else (0, 0) for i in range(2)])
            a = (np.max if step == "d" else np.min)(np.stack([np.take(wide, range(i, i + a.shape[axis]), axis=axis) for i in range(size)]), axis=0)
        return a

    steps = {"dilate": "d", "erode": "e", "close": "de", "open": "ed", "smooth": "deed"}[kind]
    for s in steps:
        grid = slide(grid, s)
    return grid
