"""Exact top-k by inner product with multi-resolution segment statistics.

Every vector is summarised by the means and deviations of its segments, at a coarse and a fine segmentation. In a
segment of w components, |q - x|^2 >= w ((mean q - mean x)^2 + (dev q - dev x)^2), which bounds a distance from
below and, as q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, a score from above: q.x <= sum of w (mean q mean x + dev q
dev x). A block of candidates is tested coarse, then fine, against each query's k-th best score so far; survivors
get their exact integer product. Bounds are widened by their rounding error, so no answer is lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.session import materialize, shared_dir

#: Queries that are broadcast together: of 64 components, about 4 MB.
QUERY_BLOCK = 8192
#: Candidates per step.
STEP = 2048
LONG = 2**63 - 1


def summary(v: np.ndarray, segments: int) -> np.ndarray:
    """[sqrt(w) mean, sqrt(w) deviation] of each segment: inner products of summaries bound those of vectors."""
    edges = np.linspace(0, v.shape[1], min(segments, v.shape[1]) + 1).astype(int)
    parts = []
    for a, b in zip(edges, edges[1:], strict=False):
        w = b - a
        parts += [v[:, a:b].mean(axis=1) * np.sqrt(w), v[:, a:b].std(axis=1) * np.sqrt(w)]
    return np.stack(parts, axis=1) if parts else np.zeros((len(v), 1))


class Block:
    """A block of queries of one dimension with the k best candidates so far of each."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, resolutions: tuple[int, ...]):
        self.rows_, self.ids, self.v, self.k, self.resolutions = row, ids, vectors, k, resolutions
        self.levels = [summary(vectors, r) for r in resolutions]
        self.norm = np.sqrt((vectors * vectors).sum(axis=1))
        self.score = np.full((len(ids), k), -np.inf)
        self.best = np.full((len(ids), k), LONG, np.int64)
        self.most = np.abs(vectors).max(initial=0)

    def offer(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Fold candidates in (row tells rows apart). Components are integers: products are exact in float64 below 2^53, else in the
        64-bit mantissas of long doubles (beyond 2^63 scores stop at the largest long)."""
        kind = np.float64 if self.most * np.abs(x).max(initial=0) * self.v.shape[1] < 2**53 else np.longdouble
        if kind is np.longdouble:
            self.score = self.score.astype(kind)
        slack = np.sqrt((x * x).sum(axis=1)) * 1e-9
        least = self.score[:, -1]
        alive = np.ones((len(self.ids), len(ids)), bool)
        if np.isfinite(least).any():
            for r, level in zip(self.resolutions, self.levels, strict=True):
                other = summary(x, r)
                rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
                bound = level[rows] @ other[cols].T + self.norm[rows][:, None] * slack[cols][None, :]
                alive[np.ix_(rows, cols)] &= bound >= least[rows][:, None]
        rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not rows.size:
            return
        exact = self.v[rows].astype(kind, copy=False) @ x[cols].T.astype(kind, copy=False)
        exact[~alive[np.ix_(rows, cols)] | (self.rows_[rows][:, None] == row[cols][None, :])] = -np.inf
        score = np.concatenate([self.score[rows], exact], axis=1)
        names = np.concatenate([self.best[rows], np.broadcast_to(ids[cols], exact.shape)], axis=1)
        # only those at or above the k-th largest can enter; ties at it go to the smaller id
        kth = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1]
        keep = score >= kth[:, None]
        for i in range(len(rows)):
            at = np.flatnonzero(keep[i])
            at = at[np.lexsort((names[i][at], -score[i][at]))][: self.k]
            self.score[rows[i]], self.best[rows[i]] = score[i][at], names[i][at]

    def found(self) -> tuple[np.ndarray, ...]:
        q, j = np.nonzero(np.isfinite(self.score))
        return self.rows_[q], self.ids[q], self.best[q, j], np.clip(self.score[q, j].astype(np.longdouble), -LONG, LONG).astype(np.int64)


def quantize(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * x) as doubles. Vectors that are null, or hold null or non-finite components, go."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale).cast("double"))
    good = F.col(vector).isNotNull() & F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.filter(good & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), x.alias("v"))


def _by_dimension(b: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, vectors) of row, vec_id, v, for each dimension."""
    row, ids, lists = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in b.columns[:3])
    row, ids = row.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield row[at], ids[at], flat[first[at][:, None] + np.arange(d)[None, :]]


def topk(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, resolutions: tuple[int, ...] = (4, 16)) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row with all other rows.

    Ties go to the smaller id. A row never answers itself; rows that repeat its id or vector are other rows: each query
    row has its own k answers, and each repeated row is an answer of its own. Only vectors of the same dimension are
    compared. Queries are handled in blocks of about QUERY_BLOCK, split by hash of the row: a block is broadcast, meets
    all rows where they lie, each task sends at most k rows per query to the merge, and its answers are written before
    the next block is read, so the driver and the executors hold one block at a time. Null ids take no part; an empty
    table gives an empty result; further columns are ignored.
    """
    spark = vectors.sparkSession
    ready = quantize(vectors, key, vector, scale).withColumn("query", is_query(F.col("vec_id")))
    ready = materialize(ready.withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    n = ready.filter("query").count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    schema = "query_row long, query_id long, vec_id long, score long"
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    path = f"{shared_dir(spark)}/rasterloom/topk-{uuid.uuid4().hex}"
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    written = False
    for i in range(blocks):
        mine = ready.filter(F.col("query") & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == i)).select("row", "vec_id", "v").toArrow()
        if not mine.num_rows:
            continue
        held = spark.sparkContext.broadcast(mine.combine_chunks())

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            queries = {v.shape[1]: Block(row, ids, v, k, resolutions) for row, ids, v in _by_dimension(held.value)}
            for b in batches:
                for row, ids, x in _by_dimension(b):
                    if x.shape[1] in queries:
                        for a in range(0, len(ids), STEP):
                            queries[x.shape[1]].offer(row[a : a + STEP], ids[a : a + STEP], x[a : a + STEP])
            for block in queries.values():
                yield pa.record_batch([pa.array(c, pa.int64()) for c in block.found()], names=["query_row", "query_id", "vec_id", "score"])

        out = ready.select("row", "vec_id", "v").mapInArrow(run, schema)
        ranked = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        ranked.write.mode("append").parquet(path)
        written = True
        held.destroy()
    return spark.read.schema(empty.schema).parquet(path) if written else empty
