"""Drawing exchange files: closed polylines of outer rings, and a view that fits them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYER, MARGIN = "target", 0.02


def number(v: float) -> str:
    return f"{v:.12g}"


def lines(polygons: DataFrame, geometry: str = "rings", layer: str = LAYER) -> DataFrame:
    """value: the text of one polyline per polygon, outer ring only (holes are dropped), as DXF code and value lines."""
    @F.udf("string")
    def text(ring) -> str:
        out = ["0", "LWPOLYLINE", "8", layer, "90", str(len(ring) - 1), "70", "1"]
        for p in ring[:-1]:
            out += ["10", number(p["x"]), "20", number(p["y"])]
        return "\n".join(out)

    outer = polygons.select(F.element_at(F.col(geometry), 1).alias("ring")).filter(F.size("ring") >= 4)
    return outer.select(text("ring").alias("value"))


def header(extent: tuple[float, float, float, float]) -> list[str]:
    x0, y0, x1, y1 = extent
    dx, dy = (x1 - x0) * MARGIN, (y1 - y0) * MARGIN
    out = ["0", "SECTION", "2", "HEADER"]
    for name, x, y in (("$EXTMIN", x0, y0), ("$EXTMAX", x1, y1), ("$LIMMIN", x0 - dx, y0 - dy), ("$LIMMAX", x1 + dx, y1 + dy)):
        out += ["9", name, "10", number(x), "20", number(y)]
    view = ["0", "ENDSEC", "0", "SECTION", "2", "TABLES", "0", "TABLE", "2", "VPORT", "70", "1", "0", "VPORT", "2", "*Active", "70", "0"]
    width, height = x1 - x0 + 2 * dx, y1 - y0 + 2 * dy
    view += ["12", number((x0 + x1) / 2), "22", number((y0 + y1) / 2), "40", number(max(height, 1e-9)), "41", number(width / max(height, 1e-9))]
    return [*out, *view, "0", "ENDTAB", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES"]


def write(polygons: DataFrame, path: str, extent: tuple[float, float, float, float], geometry: str = "rings", layer: str = LAYER) -> int:
    """One file; entities are streamed partition by partition. No ring at all is an error."""
    n = 0
    with open(path, "w") as f:
        f.write("\n".join(header(extent)) + "\n")
        for r in lines(polygons, geometry, layer).toLocalIterator():
            f.write(r["value"] + "\n")
            n += 1
        f.write("0\nENDSEC\n0\nEOF\n")
    if not n:
        raise OSError("nothing to draw")
    return n


def pairs(source: Iterable[str]) -> Iterator[tuple[str, str]]:
    it = iter(source)
    for code in it:
        yield code.strip(), next(it, "").rstrip("\n")


def refit(source: Iterable[str], extent: tuple[float, float, float, float]) -> Iterator[str]:
    """The lines of a drawing with extents, limits and the active view replaced; everything else passes through."""
    x0, y0, x1, y1 = extent
    dx, dy = (x1 - x0) * MARGIN, (y1 - y0) * MARGIN
    points = {"$EXTMIN": (x0, y0), "$EXTMAX": (x1, y1), "$LIMMIN": (x0 - dx, y0 - dy), "$LIMMAX": (x1 + dx, y1 + dy)}
    height = max(y1 - y0 + 2 * dy, 1e-9)
    view = {"12": (x0 + x1) / 2, "22": (y0 + y1) / 2, "40": height, "41": (x1 - x0 + 2 * dx) / height}
    variable, held = None, None

    def entity(rows: list[tuple[str, str]]) -> Iterator[str]:
        active, left = ("2", "*Active") in rows, dict(view)
        for code, value in rows:
            yield code
            yield number(left.pop(code)) if active and code in left else value

    for code, value in pairs(source):
        if code == "0" and held is not None:
            yield from entity(held)
            held = None
        if code == "0" and value == "VPORT":
            held = [(code, value)]
            continue
        if held is not None:
            held.append((code, value))
            continue
        if code == "9":
            variable = value
        elif variable in points and code in ("10", "20"):
            value = number(points[variable][code == "20"])
        yield code
        yield value
    if held is not None:
        yield from entity(held)


