"""SimHash near-duplicate groups: fingerprints linked at a Hamming radius through sharded BK-trees.

The 64 bits are cut into r + 3 equal bands. Two fingerprints within radius r agree on at least three bands, so every link
lies in a shard: the fingerprints that share the values of some three bands (for radius 3: 20 tables with keys of about 32
bits, so shards of unrelated fingerprints stay small up to billions of documents). In a shard a BK-tree keys children by their Hamming distance to the
parent and a search follows only edges within the radius. A shard of more than SHARD fingerprints is split into
chunks and each pair of chunks is searched in a cell of its own, so no task holds a hot shard; cells hold trees
of proven size, which is why they travel with the shuffle rather than as one broadcast of all documents' trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import slices
from rasterloom.operators.graph import connected_components
from rasterloom.session import materialize

#: Fixed values of the contract.
BITS, SEED, SHINGLE, RADIUS = 64, 42, 3, 3
#: Distinct fingerprints in a chunk of a shard.
SHARD = 1024
MASK = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of XXH64 over word shingles, repeats included; 0 where there is no word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(h), 65_536):
        bits = np.unpackbits(h[a : a + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


class BKTree:
    """Integers by Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        new = len(self.values)
        if new:
            while True:
                d = (value ^ self.values[at]).bit_count()
                if not d:
                    return
                if (below := self.children[at].get(d)) is None:
                    self.children[at][d] = new
                    break
                at = below
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(self.values[at])
            todo += [n for e, n in self.children[at].items() if -radius <= e - d <= radius]
        return found


def cell_links(first: list[int], second: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what is within radius inside first (second None), or across first and second: a forest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    tree, edges = BKTree(), []

    def search(value: int) -> None:
        for other in tree.within(value, radius):
            a, b = root(value), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((value, other))

    if second is None:
        for value in first:
            search(value)
            tree.add(value)
    else:
        for value in first:
            tree.add(value)
        for value in second:
            search(value)
    return edges


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(x) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """src, dst: edges between distinct fingerprints (column fp) that connect all within the radius."""
    spark = distinct.sparkSession
    bands = radius + 3
    edges_at = [BITS * i // bands for i in range(bands + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges_at, edges_at[1:], strict=False)]
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    values = [F.col("fp").bitwiseAND(F.lit(signed(sum(three)))) for three in combinations(masks, 3)]
    rows = distinct.select("fp", F.posexplode(F.array(*values)).alias("band", "value"))
    shards = materialize(rows.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-shards")
    shared = rows.join(shards, ["band", "value"]).withColumn("chunks", F.ceil(F.col("n") / SHARD).cast("int"))
    shared = shared.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    cells = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("band", "value", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), (F.col("chunk") > F.col("other")).alias("late"), "fp")
    # a row of chunk c goes to the cells (c, d) for d >= c as the first side, and to (d, c) for d < c as the second
    cell = ["band", "value", "i", "j"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(parts, *cell).sortWithinPartitions(*cell, "late", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, second, out = None, [], [], []

        def close() -> None:
            if now and (second or now[2] == now[3]) and len(first) + len(second) > 1:
                out.extend(cell_links(first, second if now[2] != now[3] else None, radius))

        def flush() -> pa.RecordBatch:
            a = np.array([x for x, _ in out], np.uint64).view(np.int64)
            b = np.array([y for _, y in out], np.uint64).view(np.int64)
            return pa.record_batch([pa.array(a), pa.array(b)], names=["src", "dst"])

        for b in batches:
            for *key, late, fp in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != now:
                    close()
                    now, first, second = key, [], []
                (second if late else first).append(fp & MASK)
            if len(out) > 10_000:
                yield flush()
                out.clear()
        close()
        yield flush()

    return dealt.mapInArrow(run, "src long, dst long")


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: fingerprints within the radius, and what is reachable through them, form a group
    named by its smallest doc_id.

    Null and empty texts have fingerprint 0 and are linked like any other. Exact ties (equal fingerprints) collapse
    before the search, so copies cost one aggregation. Repeated rows stay; a null doc_id is kept and never names a
    group that has another id; further columns are ignored; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, key, text), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected_components(links(distinct.select("fp"), radius))
    named = distinct.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named, "simhash-roots")
    names = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
    known = materialize(named.join(names, "root").select("fp", "component_id"), "simhash-groups")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def hex_print(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
