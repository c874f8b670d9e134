"""Tile models as iterator UDFs: a tile's bands and factors in, a probability per core pixel out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators.tiling import halo_pixels


def assemble(image: np.ndarray, factors: np.ndarray | None, mode: str):
    """(image, factors) for dual inputs, their channels in one stack for concat, else the image."""
    if mode == "dual":
        return image, factors
    return np.concatenate([image, factors]) if mode == "concat" else image


def pad(tile: np.ndarray, size: int) -> np.ndarray:
    """Edge values repeated below and to the right up to size x size."""
    return np.pad(tile, [(0, 0)] * (tile.ndim - 2) + [(0, size - tile.shape[-2]), (0, size - tile.shape[-1])], mode="edge")


def class_probability(output, index: int) -> np.ndarray:
    """Softmax over the first axis of logits (an array, a mapping with a known key, or a sequence), one class of it."""
    if isinstance(output, dict):
        output = next(output[k] for k in ("logits", "out", "pred", "prediction") if k in output)
    elif isinstance(output, (list, tuple)):
        output = output[0]
    z = np.asarray(output, np.float64)
    z = z[0] if z.ndim == 4 else z
    if index >= z.shape[0]:
        raise ValueError(f"class {index} of {z.shape[0]} channels")
    e = np.exp(z - z.max(axis=0, keepdims=True))
    return (e[index] / e.sum(axis=0)).astype(np.float32)


def predict(pixels: DataFrame, bands: list[str], factors: list[str], build: Callable[[], Callable], class_index: int, width: int, height: int, core: int = 448, halo: int = 32, mode: str = "dual") -> DataFrame:
    """row, col, p: pixels hold one column per band and factor and a column valid; null p where not valid.

    build() makes the model once in each worker process. Tiles are cores grown by a halo; only cores are kept, so
    tiles need no blending. One shuffle: each pixel goes to the tiles that need it.
    """
    held: dict[str, Callable] = {}
    size = core + 2 * halo

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model = held.get("m") or held.setdefault("m", build())
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        top, left = r.min(), c.min()
        shape = (r.max() - top + 1, c.max() - left + 1)

        def stack(names: list[str]) -> np.ndarray:
            out = np.zeros((len(names), *shape), np.float32)
            for i, n in enumerate(names):
                out[i, r - top, c - left] = pdf[n].fillna(0).to_numpy()
            return pad(out, size)

        p = class_probability(model(assemble(stack(bands), stack(factors) if factors else None, mode)), class_index)
        mine = pdf["core"].to_numpy()
        value = pd.Series(p[r[mine] - top, c[mine] - left], dtype=object).where(pdf["valid"].to_numpy()[mine], None)
        return pd.DataFrame({"row": r[mine], "col": c[mine], "p": value})

    wide = halo_pixels(pixels.select("row", "col", "valid", *bands, *factors), core, halo, width, height)
    return wide.groupBy("block_row", "block_col").applyInPandas(run, "row int, col int, p float")


def zero_nodata(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """NoData to 0 after validity is noted: a pixel is valid if no band is null."""
    valid = F.lit(True)
    for b in bands:
        valid = valid & F.col(b).isNotNull() & ~F.isnan(F.col(b))
    return pixels.withColumn("valid", valid).withColumns({b: F.coalesce(F.nanvl(F.col(b), F.lit(0.0)), F.lit(0.0)) for b in bands})


def choose_device(spark: SparkSession) -> dict:
    """Tile size, overlap, batch and precision by what the cluster gives a task: a GPU if its resource profile asks for one."""
    asked = spark.conf.get("spark.task.resource.gpu.amount", None)
    if asked and float(asked) > 0:
        return {"name": "cuda", "use_amp": True, "tile_size": 1024, "overlap": 128, "batch_size": 1}
    return {"name": "cpu", "use_amp": False, "tile_size": 512, "overlap": 64, "batch_size": 1}
