"""Near copies by SimHash, completed and verified: documents whose sets of five-word shingles have a Jaccard similarity of
at least 0.8.

Candidates are texts whose SimHash fingerprints over five-word shingles the BK-trees of the SimHash operator link. At a
similarity of 0.8 such fingerprints differ by some 9 bits, so the trees alone miss most pairs below 0.95, and a radius wide
enough would need thousands of tables. The pairs that they miss come from the minima of the same shingles' hashes, cut into
BANDS bands of ROWS values: two texts of similarity s share a band with probability 1 - (1 - s^ROWS)^BANDS, 0.9999 at 0.8.
Texts that are reachable through links and shared bands form a block, and inside a block shingle sets are compared exactly,
so neither way decides. In the order of
(doc_id, text hash), a text goes if it is similar to one that stays; so no two texts of a block that stay are similar,
and every text that goes is similar to one that stays.

A block of more than BLOCK texts is first compared with its LEADERS smallest texts, in cells of bounded size, again
as long as a leader sends away MANY texts and more on average. What is undecided then is either small enough for one task, or
has few similar pairs (some MANY a text, if later texts are like the leaders; more pairs cost time and disk, not exactness):
cells of two parts of the block find them all, and the order decides along the pairs. So the rounds do not grow with the texts of
a block that stay; the comparisons do, with their square, as before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm import simhash
from rasterloom.llm.common import slices
from rasterloom.operators.graph import SMALL, connected_components
from rasterloom.session import materialize

#: Fixed values of the contract: words in a shingle, and the least similarity LEAST / 10.
SHINGLE, LEAST = 5, 8
BANDS, ROWS, SEED = 24, 5, 42
#: Undecided texts of a block that one task compares, and texts of a larger block that decide the rest in one round.
BLOCK, LEADERS = 512, 64
#: Texts that a leader must send away on average for one more round of leaders.
MANY = 8
_RANDOM = np.random.default_rng(SEED)
_XOR, _TIMES = (_RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1) for _ in range(2))
_FOLD = _RANDOM.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of SHINGLE lower-cased words; a shorter text is one run."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    spans = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64))


class Sets:
    """Sets of hashes (none empty), numbered densely once, so that one is compared with all that were added in one pass."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets], np.int64)
        names, ids = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
        self.sets = np.split(ids.astype(np.int32), np.cumsum(self.sizes)[:-1])
        self.marks = np.zeros(len(names), np.int32)
        self.flat = np.empty(len(ids), np.int32)
        self.starts, self.added = np.zeros((2, len(sets)), np.int64)
        self.n = self.end = 0

    def add(self, k: int) -> None:
        self.starts[self.n], self.added[self.n] = self.end, k
        self.flat[self.end : self.end + self.sizes[k]] = self.sets[k]
        self.n, self.end = self.n + 1, self.end + int(self.sizes[k])

    def similar(self, k: int) -> np.ndarray:
        """The added sets for which |a and b| / |a or b| >= LEAST / 10, in integers."""
        if not self.n:
            return self.added[:0]
        self.marks[self.sets[k]] = 1
        both = np.add.reduceat(self.marks[self.flat[: self.end]], self.starts[: self.n], dtype=np.int64)
        self.marks[self.sets[k]] = 0
        added = self.added[: self.n]
        return added[10 * both >= LEAST * (self.sizes[added] + self.sizes[k] - both)]


def bands(text: str | None) -> np.ndarray:
    found, least = shingles(text), np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for a in range(0, len(found), 4096):
        mixed = (found[a : a + 4096, None] ^ _XOR) * _TIMES
        least = np.minimum(least, mixed.min(axis=0))
    return (least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64).view(np.int64)


def node(text: str = "text") -> Column:
    """Names a text, whatever row it is in."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node, fp, bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [bands(x) for x in b.column(2).to_pylist()]
            values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * BANDS, pa.int32()), values)
            fps = np.array([simhash.fingerprint(x, SHINGLE) for x in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps), lists], names=["doc_id", "node", "fp", "bands"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node().alias("node"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, node long, fp long, bands array<long>")


_TEXTS = "block long, node long, least long, text string"


def _in_order(t: pa.Table) -> list[tuple[int, int, int | None, str]]:
    rows = zip(*(t.column(c).to_pylist() for c in ("block", "node", "least", "text")), strict=True)
    return sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[1]))


def decide(rows: list[tuple], kept: list[np.ndarray]) -> list[tuple]:
    """The rows (in order) that are similar neither to kept nor to an earlier row that stays; kept grows by them."""
    mine = [shingles(r[3]) for r in rows]
    sets, stay = Sets(kept + mine), []
    first = len(kept)
    for k in range(first):
        sets.add(k)
    for k, r in enumerate(rows):
        if not len(sets.similar(first + k)):
            sets.add(first + k)
            kept.append(mine[k])
            stay.append(r)
    return stay


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "node", "least", "text"])


def _nodes(rows: list[tuple]) -> pa.Table:
    return pa.table({"node": pa.array([r[1] for r in rows], pa.int64())})


def _leaders(t: pa.Table) -> pa.Table:
    out = _table(decide(_in_order(t), []))
    return out.append_column("parts", pa.array([t.column("parts")[0].as_py()] * out.num_rows, pa.int32()))


def _undecided(t: pa.Table) -> pa.Table:
    """Of a cell, the texts that are similar to no leader."""
    leads = np.array(t.column("leads").to_pylist(), bool)
    rows = [_in_order(t.filter(pa.array(x))) for x in (leads, ~leads)]
    sets = Sets([shingles(r[3]) for x in rows for r in x])
    for k in range(len(rows[0])):
        sets.add(k)
    out = _table([r for k, r in enumerate(rows[1], len(rows[0])) if not len(sets.similar(k))])
    return out.append_column("was", pa.array([pc.max(t.column("n")).as_py()] * out.num_rows, pa.int64()))


_LINKS = "block long, node long, least long, before long"


def _links(t: pa.Table) -> pa.Table:
    """node, least, before: the similar pairs inside a part of a block, or across two; before is the text that is first in order."""
    rows, part = _in_order(t), dict(zip(t.column("node").to_pylist(), t.column("part").to_pylist(), strict=True))
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    sets, found = Sets([shingles(r[3]) for r in rows]), []
    for k in range(len(rows)) if i != j else ():
        if part[rows[k][1]] == i:
            sets.add(k)
    for k in range(len(rows)):
        if i == j or part[rows[k][1]] == j:
            found += [(rows[max(k, x)], rows[min(k, x)][1]) for x in sets.similar(k).tolist()]
        if i == j:
            sets.add(k)
    out = pa.table([pa.array([r[c] for r, _ in found], pa.int64()) for c in range(3)], names=["block", "node", "least"])
    return out.append_column("before", pa.array([x for _, x in found], pa.int64()))


def _gone(t: pa.Table) -> pa.Table:
    rows = zip(*(t.column(c).to_pylist() for c in ("node", "least", "before")), strict=True)
    gone: set[int] = set()
    for node, _, before in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
        if before not in gone:
            gone.add(node)
    return pa.table({"node": pa.array(list(gone), pa.int64())})


def _along_links(texts: DataFrame) -> DataFrame:
    """node of every text (block, node, least, text, n: texts of the block) that stays, from all similar pairs of a block."""
    parts = F.ceil(F.col("n") / max(1, BLOCK // 2)).cast("int")  # two parts are BLOCK texts
    dealt = texts.withColumn("parts", parts).withColumn("part", F.pmod("node", "parts").cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("block", "node", "least", "text", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    links = materialize(cells.groupBy("block", "i", "j").applyInArrow(_links, _LINKS), "near-links")
    gone, was, n = [], None, links.count()
    # texts that come after no similar text stay, and send away what is similar to them; few pairs, or long chains, go to one task a block
    while n > SMALL and (was is None or 10 * n < 9 * was):
        stay = links.select(F.col("before").alias("node")).distinct().join(links.select("node"), "node", "left_anti")
        out = materialize(links.join(stay.withColumnRenamed("node", "before"), "before", "left_semi").select("node").distinct(), "near-out")
        links = links.join(out, "node", "left_anti").join(out.withColumnRenamed("node", "before"), "before", "left_anti")
        links = materialize(links.select("block", "node", "least", "before"), "near-links")
        gone, was, n = [*gone, out], n, links.count()
    stay = texts.select("node")
    for out in [*gone, materialize(links.groupBy("block").applyInArrow(_gone, "node long"), "near-out")]:
        stay = stay.join(out, "node", "left_anti")
    return stay


def staying(texts: DataFrame) -> DataFrame:
    """node of every text (block, node, least, text) that stays."""
    columns = ["block", "node", "least", "text"]
    kept, small, sparse = [], [], []
    texts = texts.select(*columns, F.lit(None).cast("long").alias("was"))
    while True:
        # was: the block's texts before the last round of leaders
        sizes = texts.groupBy("block").agg(F.count("*").alias("n"), F.max("was").alias("was")).filter(F.col("n") > BLOCK)
        few = F.coalesce(F.col("was") - F.col("n") < (1 + MANY) * LEADERS, F.lit(False))
        sizes = materialize(sizes.select("block", "n", few.alias("few")), "near-sizes")
        small.append(texts.join(sizes, "block", "left_anti").select(*columns))
        n, n_few = sizes.agg(F.count("*"), F.count_if("few")).first()
        if n_few:
            sparse.append(texts.select(*columns).join(sizes.filter("few").select("block", "n"), "block"))
        if n == n_few:
            break
        large = texts.select(*columns).join(sizes.filter("not few").select("block", "n"), "block").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
        rank = F.row_number().over(Window.partitionBy("block").orderBy(F.col("least").asc_nulls_last(), "node"))
        first = materialize(large.withColumn("rank", rank).filter(F.col("rank") <= LEADERS).drop("rank", "n"), "near-first")
        leaders = first.groupBy("block", "parts").applyInArrow(_leaders, f"{_TEXTS}, parts int")
        leaders = materialize(leaders, "near-leaders")
        others = large.join(first.select("node"), "node", "left_anti").withColumn("part", F.pmod("node", "parts").cast("int"))
        sent = leaders.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        cells = others.select(*columns, "part", "n", F.lit(False).alias("leads")).unionByName(sent.select(*columns, "part", F.lit(None).cast("long").alias("n"), F.lit(True).alias("leads")))
        kept.append(leaders.select("node"))
        texts = materialize(cells.groupBy("block", "part").applyInArrow(_undecided, f"{_TEXTS}, was long"), "near-texts")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    kept.append(union(small).groupBy("block").applyInArrow(lambda t: _nodes(decide(_in_order(t), [])), "node long"))
    return union([*kept, _along_links(union(sparse))] if sparse else kept)


def _linked(distinct: DataFrame) -> DataFrame:
    """src, dst: texts (node, fp) that the SimHash operator's trees link, or whose fingerprints are equal."""
    prints = materialize(distinct.groupBy("fp").agg(F.min("node").alias("low")), "near-prints")
    same = distinct.join(prints, "fp").filter("node <> low").select(F.col("node").alias("src"), F.col("low").alias("dst"))
    name = lambda end: prints.select(F.col("fp").alias(end), F.col("low").alias(f"{end}_node"))
    found = simhash.links(prints.select("fp")).join(name("src"), "src").join(name("dst"), "dst")
    return same.unionByName(found.select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst")))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and others) that stay: of equal texts one row, the one of the smallest doc_id, and of
    near copies those that no kept one is similar to. A null doc_id comes last; rows with the same doc_id are told
    apart by their texts; texts without words are copies of each other; an empty table gives an empty result."""
    prints = signatures(docs)
    distinct = materialize(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "near-distinct")
    rows = distinct.select("node", F.posexplode("bands").alias("band", "value"))
    shared = rows.groupBy("band", "value").agg(F.min("node").alias("low"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = materialize(shared, "near-shared")
    edges = rows.join(shared, ["band", "value"]).select(F.col("node").alias("src"), F.col("low").alias("dst"))
    blocks = connected_components(edges.unionByName(_linked(distinct.select("node", "fp")))).select(F.col("id").alias("node"), F.col("root").alias("block"))
    members = materialize(blocks.join(distinct.select("node", "least"), "node"), "near-members")

    # the first row of (text, smallest id) stands for a text; the join deals rows as dropping its repeats needs them. Both
    # small sides grow with the documents, so they are hashed in a shuffle at every size
    place = ["__node", "__near_id", "__near_null"]
    numbered = lambda t, i: t.withColumns({"__near_id": F.coalesce(F.col(i).cast("long"), F.lit(0)), "__near_null": F.col(i).isNull()})
    named = numbered(docs.withColumn("__node", node()), "doc_id")
    mine = lambda t: numbered(t.withColumnRenamed("node", "__node"), "least").hint("shuffle_hash")
    texts = named.select(*place, "text").join(mine(members), place).dropDuplicates(place)
    texts = materialize(texts.select("block", F.col("__node").alias("node"), "least", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "near-texts")
    gone = members.select("node").join(staying(texts), "node", "left_anti")
    stay = materialize(distinct.select("node", "least").join(materialize(gone, "near-gone"), "node", "left_anti"), "near-stay")
    return named.join(mine(stay).select(*place), place).dropDuplicates(place).select(*docs.columns)
