"""ESRI ASCII grids as pixels, parsed in the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> tuple[dict[str, float], DataFrame]:
    """(header, pixels): header keys in lower case; pixels row, col, value with NODATA_VALUE as null.

    The header is at most seven short lines and is read first; rows keep their order by line offset in the file.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")).filter(F.trim("text") != "")
    word = F.split(F.trim("text"), r"\s+")
    head = lines.filter(F.col("text").rlike(r"^\s*[A-Za-z]")).select(F.lower(word[0]).alias("k"), word[1].cast("double").alias("v")).collect()
    header = {r["k"]: r["v"] for r in head}
    body = lines.filter(~F.col("text").rlike(r"^\s*[A-Za-z]"))
    nodata = header.get("nodata_value")
    value = F.col("v").cast("double")
    pixels = body.select((F.col("line") - len(header)).cast("int").alias("row"), F.posexplode(word).alias("col", "v"))
    return header, pixels.select("row", "col", F.when(value != F.lit(nodata if nodata is not None else float("nan")), value).alias("value"))
