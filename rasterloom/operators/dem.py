"""Elevation: alignment to an image grid, nearest fill, terrain factors.

Definitions (the factor formulas are this engine's own): slope is the angle in degrees of the gradient (central
differences, one-sided at the edge); aspect_sin and aspect_cos are of the downslope azimuth, clockwise from north, 0
on flat ground; tpi is the value less its focal mean; relief is focal maximum less focal minimum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators import stencil
from rasterloom.operators.stats import finite
from rasterloom.operators.tiling import Affine

#: Names in order and the methods that a contract may state.
FACTORS = ("slope", "aspect_sin", "aspect_cos", "tpi", "relief")
METHODS = {"slope": "gradient", "aspect_sin": "aspect_sin", "aspect_cos": "aspect_cos", "tpi": "center_minus_local_mean", "relief": "local_max_minus_min"}
MAX_WINDOW_CELLS = 16 * 1024 * 1024
#: Rows of a stretch of one column, which one window holds; a number that no distance or place reaches.
STRETCH, NEVER = 1024, np.iinfo(np.int64).max


def factors(dem: DataFrame, tpi_size: int | tuple[int, int], relief_size: int | tuple[int, int], pixel_x: float = 1.0, pixel_y: float = 1.0) -> DataFrame:
    """row, col, z -> the five factors. Sizes are cells of a square window, or across and
    down. Windows along rows and columns are shared by all factors that need them."""
    z = dem.select("row", "col", finite(F.col("z").cast("double")).alias("z"))
    z = stencil.gradient(z, "z", pixel_x, pixel_y)
    z = stencil.focal(z, "z", tpi_size, _mean="mean")
    z = stencil.focal(z, "z", relief_size, _min="min", _max="max")
    steep = F.sqrt(F.col("dz_dx") * F.col("dz_dx") + F.col("dz_dy") * F.col("dz_dy"))
    return z.select(
        "row", "col", F.degrees(F.atan(steep)).alias("slope"),
        F.when(steep == 0, 0.0).otherwise(-F.col("dz_dx") / steep).alias("aspect_sin"), F.when(steep == 0, 0.0).otherwise(-F.col("dz_dy") / steep).alias("aspect_cos"),
        (F.col("z") - F.col("_mean")).alias("tpi"), (F.col("_max") - F.col("_min")).alias("relief"),
    )


def align(dem: DataFrame, grid: DataFrame, source: Affine, target: Affine) -> DataFrame:
    """row, col, z, of grid's pixels: bilinear between the four cells around each pixel centre.

    Centres are mapped to source cells by arithmetic, so the join is equi on cell numbers. Null cells are left out
    and the other weights scaled up; a pixel without any is null (fill it with nearest_fill).
    """
    x, y = target.to_map(F.col("col") + 0.5, F.col("row") + 0.5)
    u, v = source.to_pixel(x, y)
    at = grid.select("row", "col", (u - 0.5).alias("u"), (v - 0.5).alias("v"))
    near = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1)])
    at = at.withColumn("n", F.explode(near)).withColumn("src_row", (F.floor("v") + F.col("n.r")).cast("int")).withColumn("src_col", (F.floor("u") + F.col("n.c")).cast("int"))
    fu, fv = F.col("u") - F.floor("u"), F.col("v") - F.floor("v")
    at = at.withColumn("w", F.when(F.col("n.c") == 1, fu).otherwise(1 - fu) * F.when(F.col("n.r") == 1, fv).otherwise(1 - fv))
    cells = dem.select(F.col("row").alias("src_row"), F.col("col").alias("src_col"), finite(F.col("z").cast("double")).alias("z")).filter("z is not null")
    hit = at.filter("w > 0").join(cells, ["src_row", "src_col"], "left")
    weight = F.when(F.col("z").isNotNull(), F.col("w"))
    return hit.groupBy("row", "col").agg((F.sum(weight * F.col("z")) / F.sum(weight)).alias("z"))


def nearest_fill(dem: DataFrame) -> DataFrame:
    """row, col, z, dem_filled: nulls take the value of the nearest cell that has one, however far (Euclidean in cells;
    ties: upper row, then left column). Rows have all columns of the grid. A grid without any value stays null.

    Two passes. Down the columns, frames that end at the cell find the nearest value above and below, in stretches of
    rows; a stretch's first and last value reach the others through a running last over stretches. Then each row is
    searched among its cells' finds. Work grows as cells times the logarithm of a row; a task holds one row, or as many
    short ones as a batch has. dem is read twice.
    """
    row, have = F.col("row"), F.when(F.col("z").isNotNull(), F.col("row"))
    clean = dem.select("row", "col", finite(F.col("z").cast("double")).alias("z")).withColumn("_stretch", F.floor(row / STRETCH))
    ends = clean.groupBy("col", "_stretch").agg(F.min(have).alias("lo"), F.min_by("z", have).alias("lo_z"), F.max(have).alias("hi"), F.max_by("z", have).alias("hi_z"))
    column = Window.partitionBy("col")
    above, below = (column.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_stretch"), F.col("_stretch").desc()))
    ends = ends.select("col", "_stretch", *[F.last(c, True).over(w).alias("_" + c) for w, cs in ((above, ("hi", "hi_z")), (below, ("lo", "lo_z"))) for c in cs])
    stretch = Window.partitionBy("col", "_stretch")
    above, below = (stretch.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (row, row.desc()))
    near = clean.join(ends, ["col", "_stretch"], "left")
    near = near.withColumn("_up", F.coalesce(F.last(have, True).over(above), "_hi")).withColumn("_up_z", F.coalesce(F.last("z", True).over(above), "_hi_z"))
    near = near.withColumn("_down", F.coalesce(F.last(have, True).over(below), "_lo")).withColumn("_down_z", F.coalesce(F.last("z", True).over(below), "_lo_z"))
    take = F.col("_down").isNull() | (row - F.col("_up") <= F.col("_down") - row)
    near = near.select(row.cast("int").alias("row"), F.col("col").cast("int").alias("col"), "z", *[F.when(take, F.col("_up" + c)).otherwise(F.col("_down" + c)).alias(n) for c, n in (("", "src"), ("_z", "value"))])

    def fill(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
        z, value = (b.column(i).fill_null(0.0).to_numpy(zero_copy_only=False) for i in (2, 4))
        row, col, src = (b.column(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 3))
        empty, found = (b.column(i).is_null().to_numpy(zero_copy_only=False) == missing for i, missing in ((2, True), (3, False)))
        todo, known = np.flatnonzero(empty), np.flatnonzero(found)
        best = nearest_in_rows(row[todo], col[todo], row[known], col[known], src[known])
        got = best >= 0
        out, left = z.copy(), empty.copy()
        out[todo[got]] = value[known[best[got]]]
        left[todo[got]] = False
        return pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.float64(), mask=left), pa.array(empty)], names=["row", "col", "z", "dem_filled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.column(0).to_numpy(zero_copy_only=False)
            if held and rows[0] != last:
                yield fill(held)
                held = []
            last = rows[-1]
            if cut := int(np.searchsorted(rows, last)):
                yield fill([*held, b.slice(0, cut)])
                held = []
            held.append(b.slice(cut))
        if held:
            yield fill(held)

    return near.repartition("row").sortWithinPartitions("row", "col").mapInArrow(run, "row int, col int, z double, dem_filled boolean")


def nearest_in_rows(row: np.ndarray, col: np.ndarray, of: np.ndarray, at: np.ndarray, src: np.ndarray) -> np.ndarray:
    """For each cell (row, col) the place of the find (of: its row, at: its column, src: the row of its value) in the same
    row that is nearest, -1 if the row has none. Cells and finds lie in the order of rows, then columns.

    A further column's find, once nearer, stays nearer for all cells to the right. So the answers of a row ascend, and
    the middle cell's answer bounds both halves: all middles of one depth, in all rows, are searched at once.
    """
    n, best = len(row), np.full(len(row), -1, np.int64)
    start, end = np.searchsorted(row, row, "left"), np.searchsorted(row, row, "right")
    first, last = np.searchsorted(of, row, "left"), np.searchsorted(of, row, "right") - 1
    number, size = np.arange(n) - start + 1, end - start
    has = first <= last
    step = 1 << int(size.max(initial=0)).bit_length()
    while step := step >> 1:
        mid = np.flatnonzero(has & (number & (2 * step - 1) == step))
        if not len(mid):
            continue
        lo, hi = first[mid], last[mid]
        left, right = number[mid] > step, number[mid] + step <= size[mid]
        lo[left], hi[right] = best[mid[left] - step], best[mid[right] + step]
        many = hi - lo + 1
        edge = np.cumsum(many) - many
        i = np.arange(many.sum()) + np.repeat(lo - edge, many)
        d = (src[i] - np.repeat(row[mid], many)) ** 2 + (at[i] - np.repeat(col[mid], many)) ** 2
        for key in (src[i], i):
            d = np.where(d == np.repeat(np.minimum.reduceat(d, edge), many), key, NEVER)
        best[mid] = np.minimum.reduceat(d, edge)
    return best
