"""Connected components of an edge table, by alternating stars; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.session import materialize

#: Up to so many edges (about 1 MB) one task finishes the graph with a disjoint set; more go through star rounds first.
SMALL = 50_000


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src <> dst").distinct()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for b in batches:
        for s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(s), root(d)
            parent[max(a, c)] = min(a, c)
    ids = list(parent)
    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], names=["id", "root"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """id, root for every node of edges (src long, dst long); root is the smallest id of its component.

    A graph of at most SMALL edges is solved in one task. Else each round does a large star (a node hands its smallest neighbour to its larger neighbours) and a small star
    (to its smaller ones), which halves depths as it flattens; rounds grow with the logarithm of the longest path.
    Minima are pre-aggregated and written before they are joined, so both join sides are plain shuffles and
    Spark can split a hub's partition. Null ends and self loops are ignored.
    """
    now = materialize(_canonical(edges.filter("src is not null and dst is not null")), "cc-edges")
    mark = None
    n = now.count()
    for _ in range(max_rounds):
        if n <= SMALL:
            return materialize(now.coalesce(1).mapInArrow(_finish, "id long, root long"), "cc-roots")
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = materialize(both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low")), "cc-min")
        large = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        large = materialize(large.filter("src <> dst").distinct(), "cc-large")
        least = materialize(large.groupBy("src").agg(F.min("dst").alias("low")), "cc-min")
        small = large.join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(least.withColumnRenamed("low", "dst"))
        now = materialize(_canonical(small), "cc-edges")
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        n = mark[0]
        if was == mark:
            break
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return now.select(F.col("src").alias("id"), F.col("dst").alias("root")).unionByName(now.select(F.col("dst").alias("id"), F.col("dst").alias("root")).distinct())
