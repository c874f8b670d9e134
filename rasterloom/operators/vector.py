"""Polygons: tracing cells to rings, scan conversion, ring measures, simplification and smoothing.

A polygon is array<array<struct<x, y>>>: the outer ring first, then holes, closed. Rings run in grid coordinates
(x = column, y = row) unless a transform is applied; cells are 4-connected, so rings that touch in a corner stay apart.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import components
from rasterloom.operators.tiling import Affine

RINGS = "array<array<struct<x:double,y:double>>>"
#: Vertices of an accepted shape, of a preview, points of a traced mask's ring, and accepted area ratios.
MAX_VERTICES, MAX_PREVIEW, MAX_RING, MIN_RATIO, MAX_RATIO = 2000, 6000, 320, 0.75, 1.25


def trace(cells: set[tuple[int, int]]) -> list[list[tuple[float, float]]]:
    """Rings of a 4-connected set of (row, col): directed edges with the cell on the right, joined corner to corner.

    At a corner where two cells touch diagonally the sharper right turn keeps their rings apart. The ring of the
    greatest area is the outer one.
    """
    nxt: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in cells:
        for a, b, side in (((c, r), (c + 1, r), (r - 1, c)), ((c + 1, r), (c + 1, r + 1), (r, c + 1)), ((c + 1, r + 1), (c, r + 1), (r + 1, c)), ((c, r + 1), (c, r), (r, c - 1))):
            if side not in cells:
                nxt.setdefault(a, []).append(b)
    rings = []
    while nxt:
        start = min(nxt)
        ring, at, step = [start], start, (0, 0)
        while True:
            ends = nxt[at]
            # the turn to the right (y grows downwards) of the last step comes first
            pick = max(ends, key=lambda e: step[0] * (e[1] - at[1]) - step[1] * (e[0] - at[0])) if len(ends) > 1 else ends[0]
            ends.remove(pick)
            if not ends:
                del nxt[at]
            turn = (pick[0] - at[0], pick[1] - at[1])
            if turn == step:
                ring[-1] = pick
            else:
                ring.append(pick)
            at, step = pick, turn
            if at == start:
                break
        rings.append([(float(x), float(y)) for x, y in ring])
    return sorted(rings, key=lambda g: -abs(shoelace(g)))


def shoelace(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def polygonize(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """part, rings, n_cells for each 4-connected part of row, col. A part must fit a task; tiles bound it otherwise."""
    parts = components.label(cells.select("row", "col").distinct(), 4)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = trace(set(zip(pdf["row"].tolist(), pdf["col"].tolist(), strict=True)))
        return pd.DataFrame({"part": [int(pdf["label"].iloc[0])], "rings": [[[{"x": x, "y": y} for x, y in g] for g in rings]], "n_cells": [len(pdf)]})

    return parts.groupBy("label").applyInPandas(run, f"part long, rings {RINGS}, n_cells long")


def rasterize(polygons: DataFrame, width: int, height: int, geometry: str = "rings", keep: tuple[str, ...] = ()) -> DataFrame:
    """row, col (and kept columns) of cells whose centres lie inside, by even-odd scan lines; spans are exploded in the
    plan, so a large polygon costs a row per scan line in Python, not one per cell."""
    columns = ", ".join(f"`{c}` {dict(polygons.dtypes)[c]}" for c in keep)

    def run(batches):
        for pdf in batches:
            out = []
            for rec in pdf.to_dict("records"):
                edges = [(a["x"], a["y"], b["x"], b["y"]) for g in rec[geometry] for a, b in zip(g, g[1:], strict=False) if a["y"] != b["y"]]
                if not edges:
                    continue
                e = np.array(edges)
                top, bottom = max(0, math.ceil(e[:, [1, 3]].min() - 0.5)), min(height - 1, math.floor(e[:, [1, 3]].max() - 0.5))
                for row in range(top, bottom + 1):
                    y = row + 0.5
                    hit = e[(np.minimum(e[:, 1], e[:, 3]) <= y) & (np.maximum(e[:, 1], e[:, 3]) > y)]
                    x = np.sort(hit[:, 0] + (y - hit[:, 1]) * (hit[:, 2] - hit[:, 0]) / (hit[:, 3] - hit[:, 1]))
                    for a, b in zip(x[::2], x[1::2], strict=False):
                        c0, c1 = max(0, math.ceil(a - 0.5)), min(width - 1, math.ceil(b - 0.5) - 1)
                        if c0 <= c1:
                            out.append((row, c0, c1, *(rec[k] for k in keep)))
            yield pd.DataFrame(out, columns=["row", "c0", "c1", *keep])

    spans = polygons.select(geometry, *keep).mapInPandas(run, "row int, c0 int, c1 int" + (", " + columns if keep else ""))
    return spans.select("row", F.explode(F.sequence("c0", "c1")).alias("col"), *keep).distinct()


def ring_area(ring: Column) -> Column:
    """Absolute shoelace area of a closed ring."""
    pairs = F.zip_with(ring, F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), a["x"] * b["y"] - b["x"] * a["y"]).otherwise(0.0))
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)) / 2


def polygon_area(rings: Column) -> Column:
    areas = F.transform(rings, ring_area)
    return F.when(F.size(rings) == 0, 0.0).otherwise(2 * F.element_at(areas, 1) - F.aggregate(areas, F.lit(0.0), lambda s, v: s + v))


def vertex_count(rings: Column) -> Column:
    return F.aggregate(rings, F.lit(0), lambda s, g: s + F.size(g))


def closed(ring: Column) -> Column:
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    return F.when((F.size(ring) == 0) | (first == last), ring).otherwise(F.concat(ring, F.array(first)))


def outer_rings(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.element_at(p, 1))


def to_map(rings: Column, t: Affine) -> Column:
    def point(p):
        x, y = t.to_map(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(rings, lambda g: F.transform(g, point))


def extent(polygons: DataFrame, geometry: str = "rings") -> DataFrame:
    points = polygons.select(F.explode(F.flatten(geometry)).alias("p"))
    return points.agg(F.min("p.x").alias("xmin"), F.min("p.y").alias("ymin"), F.max("p.x").alias("xmax"), F.max("p.y").alias("ymax"))


def largest(rings: Column) -> Column:
    """The ring of the greatest area, the first of equals."""
    best = F.array_max(F.transform(rings, ring_area))
    return F.element_at(F.filter(rings, lambda g: ring_area(g) == best), 1)


def thin(ring: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker on a closed ring, split at the vertex farthest from its first; at least four points stay."""
    if len(ring) <= 4:
        return ring
    p = np.array(ring[:-1])
    far = int(np.argmax(((p - p[0]) ** 2).sum(axis=1)))
    p = np.concatenate([p, p[:1]])
    keep = np.zeros(len(p), bool)
    keep[[0, far, len(p) - 1]] = True
    todo = [(0, far), (far, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, q = p[b] - p[a], p[a + 1 : b] - p[a]
        size = math.hypot(*d)
        off = np.abs(q[:, 0] * d[1] - q[:, 1] * d[0]) / size if size else np.hypot(q[:, 0], q[:, 1])
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    out = [tuple(x) for x in p[keep].tolist()]
    return out if len(out) >= 4 else ring


def round_corners(ring: list[tuple[float, float]], rounds: int = 1, offset: float = 0.25) -> list[tuple[float, float]]:
    """Corner cutting: each edge keeps the part between offset and 1 - offset."""
    for _ in range(rounds):
        cut = []
        for a, b in zip(ring, ring[1:], strict=False):
            for t in (offset, 1 - offset):
                cut.append((a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t))
        ring = [*cut, cut[0]]
    return ring


def mask_ring(ring: list[tuple[float, float]], most: int = MAX_RING) -> list[tuple[float, float]]:
    """A traced ring of at most `most` points: tolerance from 0.3 % of its length (1 at least), times 1.6 up to eight
    rounds, then every n-th point."""
    length = sum(math.dist(a, b) for a, b in zip(ring, ring[1:], strict=False))
    tolerance, out = max(1.0, 0.003 * length), ring
    for _ in range(8):
        out = thin(ring, tolerance)
        if len(out) <= most:
            return out
        tolerance *= 1.6
    return out[:: -(-len(out) // most)]


def refine(polygons: DataFrame, tolerance: float, geometry: str = "rings", smooth: bool = True) -> DataFrame:
    """Adds refined: the first acceptable of smoothed, simplified and original outer ring: at most MAX_VERTICES
    vertices and an area ratio between MIN_RATIO and MAX_RATIO."""
    def safe(g, original) -> bool:
        area = abs(shoelace(original))
        return 4 <= len(g) <= MAX_VERTICES and area > 0 and MIN_RATIO <= abs(shoelace(g)) / area <= MAX_RATIO

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(column: pd.Series) -> pd.Series:
        out = []
        for rings in column:
            ring = [(p["x"], p["y"]) for p in rings[0]] if rings is not None and len(rings) else []
            plain = thin(ring, tolerance)
            tries = ([round_corners(plain)] if smooth and len(plain) > 3 else []) + [plain]
            best = next((g for g in tries if safe(g, ring)), ring)
            out.append([{"x": float(x), "y": float(y)} for x, y in best])
        return pd.Series(out)

    return polygons.withColumn("refined", run(F.col(geometry)))


def preview(polygons: DataFrame, tolerance: float, geometry: str = "rings", most: int = MAX_PREVIEW) -> DataFrame:
    """Adds preview: the outer ring simplified at 1, 2, 4 and 8 times tolerance until it has at most `most` points,
    else its bounding box."""
    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(column: pd.Series) -> pd.Series:
        out = []
        for rings in column:
            ring = [(p["x"], p["y"]) for p in rings[0]]
            got = next((g for g in (ring, *(thin(ring, tolerance * k) for k in (1, 2, 4, 8))) if len(g) <= most), None)
            if got is None:
                xs, ys = [p[0] for p in ring], [p[1] for p in ring]
                got = [(min(xs), min(ys)), (max(xs), min(ys)), (max(xs), max(ys)), (min(xs), max(ys)), (min(xs), min(ys))]
            out.append([{"x": float(x), "y": float(y)} for x, y in got])
        return pd.Series(out)

    return polygons.withColumn("preview", run(F.col(geometry)))


def covers(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against a closed ring, as an expression."""
    edges = F.zip_with(ring, F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crossing = lambda e: F.coalesce(((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0))), F.lit(False))
    return F.size(F.filter(edges, crossing)) % 2 == 1


def near_ring(ring: Column, x: Column, y: Column, reach: Column | float) -> Column:
    """The point lies within reach of the ring's line."""
    edges = F.zip_with(ring, F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def close(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        t = F.coalesce(((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        px, py = x - e["a"]["x"] - t * dx, y - e["a"]["y"] - t * dy
        return F.coalesce(px * px + py * py <= reach * reach, F.lit(False))

    return F.exists(edges, close)


def safe_shape(ring: Column, original: Column, negatives: Column, reach: float) -> Column:
    """Few enough vertices, an area close to the original's, and no negative prompt (array of x, y) inside or within
    reach of its line."""
    ratio = ring_area(ring) / F.nullif(ring_area(original), F.lit(0.0))
    hit = F.exists(negatives, lambda p: covers(ring, p["x"], p["y"]) | near_ring(ring, p["x"], p["y"], reach))
    return F.coalesce((F.size(ring) >= 4) & (F.size(ring) <= MAX_VERTICES) & ratio.between(MIN_RATIO, MAX_RATIO) & ~F.coalesce(hit, F.lit(False)), F.lit(False))


def message_polygon(message: Column) -> Column:
    """Rings of the largest polygon of a mask message, {"polygons": [{"shell": [[x, y], ...], "holes": [...]}]}; null
    where no shell has three points."""
    got = F.from_json(message, "polygons array<struct<shell:array<array<double>>,holes:array<array<array<double>>>>>")["polygons"]
    points = lambda g: F.transform(g, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    rings = F.transform(F.filter(got, lambda p: F.size(p["shell"]) >= 3), lambda p: F.concat(F.array(closed(points(p["shell"]))), F.transform(F.coalesce(p["holes"], F.array().cast("array<array<array<double>>>")), lambda h: closed(points(h)))))
    sized = F.transform(rings, lambda r: F.struct(ring_area(F.element_at(r, 1)).alias("area"), r.alias("rings")))
    best = F.array_max(F.transform(sized, lambda s: s["area"]))
    return F.get(F.filter(sized, lambda s: s["area"] == best), 0)["rings"]


def tolerance_of(pixels: float, pixel_size: tuple[float, float]) -> float:
    """A tolerance given in pixels, in map units."""
    return pixels * max(pixel_size)
