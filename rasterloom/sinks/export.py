"""Exports of a draft: raster, shapefile or drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import regions, tiling, vector
from rasterloom.operators.tiling import Affine
from rasterloom.sinks import dxf, shapefile
from rasterloom.sources import tiff

ENDINGS = {"raster": "_final.tif", "vector": "_final.shp", "dxf": "_final.dxf"}


def dissolved(cells: DataFrame, transform: Affine) -> DataFrame:
    """class_id, class_name, rings in map coordinates: all cells of the draft together, one row per part."""
    parts = vector.polygonize(cells)
    return parts.select(F.lit(regions.CLASS_ID).alias("class_id"), F.lit(regions.CLASS_NAME).alias("class_name"), vector.to_map(F.col("rings"), transform).alias("rings"))


def export(cells: DataFrame, kind: str, path: str, width: int, height: int, transform: Affine | None = None, crs_wkt: str = "") -> str:
    """Write cells (row, col) and return the path."""
    t = transform or Affine()
    if kind == "raster":
        tiff.write(cells.select("row", "col").distinct().withColumn("value", F.lit(1)), path, width, height, "uint8", 0, t)
    elif kind == "vector":
        shapefile.write(dissolved(cells, t), path, crs_wkt)
    elif kind == "dxf":
        shapes = dissolved(cells, t)
        e = vector.extent(shapes).first()
        if e[0] is None:
            raise OSError("nothing to draw")
        dxf.write(shapes, path, tuple(e))
    else:
        raise ValueError(f"unknown export {kind!r}")
    return path


def output_path(base: str, kind: str) -> str:
    return base + ENDINGS[kind]


def burn(polygons: DataFrame, width: int, height: int, value: str = "class_id", background: int = 0) -> DataFrame:
    """row, col, value on the full grid: each cell takes the value of the polygon over it, the greatest of several."""
    cells = vector.rasterize(polygons, width, height, keep=(value,)).groupBy("row", "col").agg(F.max(value).alias("value"))
    grid = tiling.full_grid(polygons.sparkSession, width, height)
    return grid.join(cells, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(background)))
