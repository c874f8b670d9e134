"""Vector layers of drafts: scan and write, fields, union, geometry kinds, and which layers a session may remove or reuse.

A layer is a Parquet folder; its address may end in |layername=draft. Geometries are rings (array of points) of one
polygon, or parts: arrays of such polygons.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import regions, vector

#: Fixed value: what follows the path in a draft layer's address.
LAYER = "|layername=draft"
RINGS = "array<array<struct<x:double,y:double>>>"


def layer_uri(path: str) -> str:
    return path + LAYER


def read_layer(spark: SparkSession, uri: str) -> DataFrame:
    """The features behind a path or a layer address."""
    return spark.read.parquet(uri.split("|")[0])


def with_fields(features: DataFrame, fields: str = regions.DRAFT) -> DataFrame:
    """Missing fields are added as nulls, present ones cast; further columns stay behind them."""
    kinds = dict(f.split() for f in fields.split(", "))
    have = set(features.columns)
    made = [(F.col(n) if n in have else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()]
    return features.select(*made, *[c for c in features.columns if c not in kinds])


def write_layer(features: DataFrame, path: str, fields: str = regions.DRAFT) -> str:
    """Write a layer over what is there, from the executors; returns its address."""
    with_fields(features, fields).write.mode("overwrite").parquet(path)
    return layer_uri(path)


def roi_ring(bounds: tuple[float, float, float, float]) -> Column:
    """The closed ring of a rectangle (xmin, ymin, xmax, ymax)."""
    x0, y0, x1, y1 = map(float, bounds)
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners])


def roi_layer(spark: SparkSession, bounds: tuple[float, float, float, float]) -> DataFrame:
    """A region of interest as a layer of one polygon."""
    return with_fields(spark.range(1).select(F.array(roi_ring(bounds)).cast(RINGS).alias("rings")))


def union_layers(layers: list[DataFrame]) -> DataFrame:
    """All features of all layers, columns matched by name and null where a layer lacks them."""
    if not layers:
        raise ValueError("no layer to join")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def as_parts(features: DataFrame, geometry: str = "rings") -> DataFrame:
    """One polygon becomes an array of one part; features without a ring of three corners go."""
    sound = F.exists(F.col(geometry), lambda ring: F.size(ring) >= 3)
    return features.filter(F.coalesce(sound, F.lit(False))).withColumn(geometry, F.array(F.col(geometry)))


def one_part(features: DataFrame, geometry: str = "parts") -> DataFrame:
    """For layers of single polygons: the part with the greatest area, the first of equal ones; empty features go."""
    sized = F.transform(F.col(geometry), lambda rings, i: F.struct(vector.polygon_area(rings).alias("area"), (-i).alias("at"), rings.alias("rings")))
    best = F.array_max(F.transform(sized, lambda s: F.struct(s["area"].alias("area"), s["at"].alias("at"))))
    return features.filter(F.size(geometry) > 0).withColumn(geometry, F.get(F.col(geometry), -best["at"]))


def of_class(features: DataFrame, class_id: int, label: str = "label_value") -> DataFrame:
    """Only polygons of one class."""
    return features.filter(F.col(label) == class_id)


def protected_ids(*layers: DataFrame, key: str = "layer_id") -> DataFrame:
    """The ids that must not be removed: of the current, the session's and the active layers together."""
    return reduce(lambda a, b: a.unionByName(b), [x.select(key) for x in layers]).filter(F.col(key).isNotNull()).distinct()


def stale_layers(layers: DataFrame, protected: DataFrame, own: Column, key: str = "layer_id") -> DataFrame:
    """A session's own layers that are not protected."""
    return layers.filter(own).join(protected, key, "left_anti")


def orphan_nodes(nodes: DataFrame, layers: DataFrame, names: tuple[str, ...], key: str = "layer_id") -> DataFrame:
    """Tree nodes (key, name, marker) without a registered layer that carry the marker or an old name."""
    named = F.lower(F.trim("name")).isin(*[n.strip().lower() for n in names])
    return nodes.filter((F.coalesce(F.col("marker"), F.lit("")) == "1") | named).join(layers.select(key), key, "left_anti")


def reusable_layer(candidates: DataFrame, key: str = "layer_id") -> DataFrame:
    """One row at most: the first usable registered candidate (columns usable, registered, in_session, position), else
    the first usable one from the session's folder."""
    rank = F.when(F.col("registered"), 0).when(F.col("in_session"), 1)
    best = candidates.filter("usable").filter(rank.isNotNull()).agg(F.min_by(key, F.struct(rank.alias("rank"), F.col("position"))).alias(key))
    return best.filter(F.col(key).isNotNull())


def feature_count(features: DataFrame) -> DataFrame:
    return features.agg(F.count("*").alias("features"))


def next_source_id(features: DataFrame) -> DataFrame:
    return features.agg((F.coalesce(F.max("source_id"), F.lit(0)) + 1).alias("source_id"))


def commit_edits(session: regions.DraftSession, edited: DataFrame, snapshot: DataFrame, geometry: str = "wkb") -> int:
    """At the end of an edit: mark what differs from the snapshot as the user's and publish it as the next version. If
    that fails the draft stays at the version before, which rolls the edit back."""
    return session.publish(with_fields(regions.mark_changes(edited, snapshot, geometry).drop("changed")))
