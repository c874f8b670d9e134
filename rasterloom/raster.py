"""A raster as a chain of lazy operators: Raster(...).threshold(0.5).close(3).components()."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import components, dem, rules, stats, stencil, tiling
from rasterloom.operators.tiling import Affine, Box


@dataclass(frozen=True)
class Raster:
    """pixels: row int, col int, p (a probability) or m (a mask) and, if known, valid."""

    pixels: DataFrame
    width: int
    height: int
    transform: Affine = field(default_factory=Affine)
    crs_wkt: str = ""
    crs_unit: str | None = None

    def with_pixels(self, pixels: DataFrame) -> Raster:
        return replace(self, pixels=pixels)

    def transform_with(self, fn: Callable[[DataFrame], DataFrame]) -> Raster:
        return self.with_pixels(fn(self.pixels))

    def window(self, box: Box | None) -> DataFrame:
        return tiling.read_window(self.pixels, box)

    def region(self, roi: dict | None) -> Raster:
        """Only the pixels of a region of interest; the grid stays."""
        return self.with_pixels(self.pixels.filter(tiling.in_box(tiling.roi_box(roi, self.transform, self.width, self.height))))

    def threshold(self, value: float) -> Raster:
        valid = F.coalesce(F.col("valid"), F.lit(False)) if "valid" in self.pixels.columns else F.lit(True)
        return self.with_pixels(self.pixels.select("row", "col", (stats.above(F.col("p"), value) & valid).cast("int").alias("m"), valid.alias("valid")))

    def close(self, size: int = 5) -> Raster:
        return self.with_pixels(stencil.closing(self.pixels, size))

    def open(self, size: int = 3) -> Raster:
        return self.with_pixels(stencil.opening(self.pixels, size))

    def smooth(self, size: int = 3) -> Raster:
        return self.with_pixels(stencil.smooth(self.pixels, size))

    def fill_holes(self, max_area: float) -> Raster:
        limit = components.hole_limit(max_area, self.transform.pixel_area)
        return self.with_pixels(components.fill_holes(self.pixels, limit, self.width, self.height))

    def components(self, connectivity: int = 8) -> DataFrame:
        return components.label(self.pixels.filter("m = 1").select("row", "col"), connectivity)

    def terrain(self, tpi_m: float, relief_m: float) -> DataFrame:
        """Factors of an elevation raster (column z) with windows in meters."""
        x, y = self.transform.pixel_size
        return dem.factors(self.pixels, tiling.window_cells(tpi_m, self.transform), tiling.window_cells(relief_m, self.transform), x, y)

    def decide(self, factors: DataFrame | None, filled: DataFrame | None, config: dict) -> DataFrame:
        labels = self.components()
        enabled = rules.ordered_rules(config)
        zones = rules.zonal_stats(labels, factors, filled, sorted({r["factor"] for r in enabled}), sorted({r["stat"] for r in enabled}))
        return rules.decide(zones, config, self.transform.pixel_area)
