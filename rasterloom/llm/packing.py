"""Pack token pieces into windows by minimum bin slack.

Documents longer than a window are cut into whole windows and a rest. Rests are packed by a plan over their
lengths only: a histogram of at most window - 1 lengths. For the longest length left, a bitset subset-sum over
the multiset of remaining lengths finds the filling that comes closest to the window, and walking the layers
back gives how often each length is used. That pattern is then repeated as long as its lengths last, so every
step leaves some length k with fewer pieces than it used, at most window / k: there are at most some
window * ln(window) patterns, whatever the number of documents. Pieces find their window by their rank among
pieces of the same length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import slices
from rasterloom.llm.tokens import Encoder, tokenizer_path
from rasterloom.session import materialize

CUT = "doc_id long, start long, length long, doc_tokens long, ids binary, shard int, rank long"


class Pattern(NamedTuple):
    """counts: (length, times in a window); windows: how many windows are filled so."""

    counts: tuple[tuple[int, int], ...]
    windows: int


def fill(gap: int, lengths: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths (length -> how many there are) whose sum is the largest up to gap: length -> times."""
    reach, full, layers = 1, (1 << (gap + 1)) - 1, []
    for length in sorted((x for x in lengths if x <= gap and lengths[x]), reverse=True):
        left, step = min(lengths[length], gap // length), 1
        while left:
            n = min(step, left)
            layers.append((length, n, reach))
            reach |= (reach << (length * n)) & full
            left, step = left - n, step * 2
        if reach >> gap & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, n, before in reversed(layers):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + n
            at -= length * n
    return used


def plan(histogram: dict[int, int], window: int) -> list[Pattern]:
    """Patterns that use up the histogram (length -> pieces). Lengths from 1 to window."""
    left, patterns = {k: v for k, v in histogram.items() if v}, []
    for length in sorted(left, reverse=True):
        while left[length]:
            left[length] -= 1
            used = fill(window - length, left)
            left[length] += 1
            used[length] = used.get(length, 0) + 1
            windows = min(left[k] // n for k, n in used.items())
            patterns.append(Pattern(tuple(sorted(used.items(), reverse=True)), windows))
            for k, n in used.items():
                left[k] -= n * windows
    return patterns


def cut(docs: DataFrame, window: int = 2048, key: str = "doc_id", text: str = "text", end_id: int = 1, tokenizer: str | None = None, kind: str = "byte") -> DataFrame:
    """Encode every whole text, append end_id, cut: pieces with ids (little-endian unsigned 32-bit, binary), and shard
    and rank, which number the pieces of each length within a task."""
    where = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        encoder, tail = Encoder.shared(where, kind), int(end_id).to_bytes(4, "little")
        for b in slices(batches):
            rows: list[tuple] = []
            for name, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                ids += tail
                n = len(ids) // 4
                for a in range(0, n, window):
                    size = min(window, n - a)
                    rows.append((name, a, size, n, ids[4 * a : 4 * (a + size)], shard, int(seen[size])))
                    seen[size] += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids", "shard", "rank"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, CUT)


def place(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces (length, shard, rank; other columns are carried along)."""
    counts = pieces.groupBy("shard", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = materialize(counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long")), "pack-firsts")
    histogram = {int(r[0]): int(r[1]) for r in firsts.groupBy("length").agg(F.sum("_n")).collect()}
    starts: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for p in plan(histogram, window):
        offset = 0
        for length, times in p.counts:
            starts.setdefault(length, []).append((used.get(length, 0), times, base, offset))
            used[length] = used.get(length, 0) + times * p.windows
            offset += length * times
        base += p.windows
    tables = {k: np.array(v, np.int64).T for k, v in starts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = b.column(b.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            window_id, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                first, times, at, off = tables[int(n)]
                mine = np.flatnonzero(length == n)
                k = np.searchsorted(first, rank[mine], "right") - 1
                inside = rank[mine] - first[k]
                window_id[mine] = at[k] + inside // times[k]
                offset[mine] = off[k] + inside % times[k] * n
            yield pa.record_batch([*b.columns, pa.array(window_id), pa.array(offset)], names=[*b.schema.names, "sequence_id", "offset"])

    ranked = pieces.join(firsts.drop("_n"), ["shard", "length"]).withColumn("_rank", F.col("_first") + F.col("rank")).drop("_first", "shard", "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema).drop("_rank")


def pack(docs: DataFrame, window: int = 2048, **options) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids, sequence_id, offset of every piece.

    Null and empty texts are one piece of the end id alone; long texts fill whole windows; repeated rows are packed
    each; null keys are kept; an empty table gives no piece; further columns are ignored.
    """
    return place(materialize(cut(docs, window, **options), "pack-pieces"), window)
