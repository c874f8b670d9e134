"""Token files: ids of many documents concatenated, with document ends as an Elias-Fano sequence.

A file (one shard) is: magic, version, id width in bytes, number of documents and of ids; null document ids as a bit
vector; document ids less the least, and ends of documents, each as its number of low bits, the packed low bits, and
the high bits as unary gaps; ids. Ends are non-decreasing numbers up to n_tokens: each keeps its
floor(log2(n_tokens / n_docs)) low bits packed and its high part as a one in a bit vector of at most 2 n_docs bits, so a
boundary costs about 2 + log2(mean length) bits instead of 64; sorted document ids likewise (ids in no order, or over
2^62 apart, stay a table). select(i) finds the i-th one through samples (ones before every 512-bit block), and
span(lo, hi) reads a run of values from there.

Executors cannot in general open files in the cluster's store from Python, so a shard is one binary cell of a
Parquet table that Spark writes and reads: that keeps Spark's commit protocol and any file system.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import slices
from rasterloom.llm.tokens import Encoder, tokenizer_path
from rasterloom.operators.ranking import prefix_before
from rasterloom.session import materialize

#: Fixed values of the format.
MAGIC, VERSION, HEADER = b"RLTK", 2, "<4sHHQQ"
#: Low bits, bytes of low and of high bits of an Elias-Fano sequence; so many low bits say that it is a table.
PART, TABLE = "<BQQ", 255
#: Ids in a shard, at most, unless one document alone has more.
SHARD_TOKENS = 2_000_000
#: The largest documents column a writer holds: rows come sorted, so this only bounds shards of empty documents.
SHARD_DOCS = 50_000


class EliasFano:
    """Non-decreasing non-negative integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        per_block = np.bitwise_count(np.pad(high, (0, -high.size % 64))).reshape(-1, 64).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(per_block)])

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = v.size, int(v[-1]) if v.size else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        high = np.zeros(n + (top >> bits) + 1, np.uint8)
        high[(v >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        low = (v[:, None] >> np.arange(bits, dtype=np.uint64)[None, :]) & np.uint64(1) if bits else np.zeros((0, 0))
        return cls(n, bits, np.packbits(low.astype(np.uint8).ravel()), np.packbits(high))

    def select(self, i: int) -> int:
        """The i-th value, from 0, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.before, i, "right")) - 1
        bits = np.unpackbits(self.high[block * 64 : block * 64 + 64])
        at = block * 512 + int(np.flatnonzero(bits)[i - int(self.before[block])])
        return ((at - i) << self.low_bits) | self._low(i)

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-(a + self.low_bits) // 8)])[a % 8 : a % 8 + self.low_bits]
        return int((bits.astype(np.int64) << np.arange(self.low_bits)).sum())

    def span(self, lo: int, hi: int) -> np.ndarray:
        """Values lo to hi - 1, decoding only the blocks that hold them."""
        if lo >= hi:
            return np.zeros(0, np.int64)
        first, last = (np.searchsorted(self.before, [lo, hi - 1], "right") - 1).tolist()
        ones = np.flatnonzero(np.unpackbits(self.high[first * 64 : last * 64 + 64]))
        skip = lo - int(self.before[first])
        high = ones[skip : skip + hi - lo] + first * 512 - np.arange(lo, hi)
        if not self.low_bits:
            return high.astype(np.int64)
        a, n = lo * self.low_bits, (hi - lo) * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-(a + n) // 8)])[a % 8 : a % 8 + n].reshape(hi - lo, self.low_bits).astype(np.int64)
        return (high.astype(np.int64) << self.low_bits) | (bits << np.arange(self.low_bits)[None, :]).sum(axis=1)

    def values(self) -> np.ndarray:
        return self.span(0, self.n)

    def parts(self) -> list[bytes]:
        return [struct.pack(PART, self.low_bits, self.low.size, self.high.size), self.low.tobytes(), self.high.tobytes()]


def _names(doc_ids: list[int | None]) -> list[bytes]:
    """Null bits and the ids: null ids repeat the id before them."""
    null = np.packbits(np.array([x is None for x in doc_ids], np.uint8))
    least = min((x for x in doc_ids if x is not None), default=0)
    filled, last = [], least
    for x in doc_ids:
        last = last if x is None else x
        filled.append(last)
    if all(a <= b for a, b in zip(filled, filled[1:], strict=False)) and last - least < 1 << 62:
        body = EliasFano.build(np.array([x - least for x in filled], np.int64)).parts()
    else:
        body = [struct.pack(PART, TABLE, 8 * len(filled), 0), np.array(filled, "<i8").tobytes()]
    return [null.tobytes(), struct.pack("<q", least), *body]


def write_shard(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One file of documents' ids (little-endian unsigned 32-bit each)."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    ends = EliasFano.build(np.cumsum([len(x) // 4 for x in ids]))
    width = 2 if not flat.size or int(flat.max()) < 1 << 16 else 4
    head = struct.pack(HEADER, MAGIC, VERSION, width, len(ids), flat.size)
    return b"".join([head, *_names(doc_ids), *ends.parts(), flat.astype(f"<u{width}").tobytes()])


class Shard:
    """Random access to a file: ids(i) of the i-th document, without decoding the others."""

    def __init__(self, data: bytes):
        magic, version, width, self.n_docs, self.n_tokens = struct.unpack_from(HEADER, data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        at = struct.calcsize(HEADER)
        view = np.frombuffer(data, np.uint8)

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return view[at - size : at]

        null = np.unpackbits(take(-(-self.n_docs // 8)), count=self.n_docs).astype(bool)
        (least,) = struct.unpack("<q", take(8).tobytes())
        low_bits, n_low, n_high = struct.unpack(PART, take(struct.calcsize(PART)).tobytes())
        names = take(n_low).view("<i8") if low_bits == TABLE else EliasFano(self.n_docs, low_bits, take(n_low), take(n_high)).values() + least
        self.doc_ids = [None if n else int(x) for x, n in zip(names, null, strict=True)]
        low_bits, n_low, n_high = struct.unpack(PART, take(struct.calcsize(PART)).tobytes())
        self.ends = EliasFano(self.n_docs, low_bits, take(n_low), take(n_high))
        self.flat = take(width * self.n_tokens).tobytes()
        self.width = width

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return np.frombuffer(self.flat, f"<u{self.width}")[a:b]

    def all_ids(self) -> np.ndarray:
        return np.frombuffer(self.flat, f"<u{self.width}")


def write_tokens(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 1, tokenizer: str | None = None, kind: str = "word") -> DataFrame:
    """Encode every whole text, append end_id, and write shards in ascending key order: part, shard, n_docs, n_tokens, data.

    Null texts count as empty; null keys come first; repeated keys stay as rows of their own, in the order of a hash of
    their texts (null before others), so reruns agree; an empty table gives no shard; further columns are ignored. Texts are
    dealt by ranges of key and hash, so no task holds more than its share.
    """
    spark = docs.sparkSession
    where = tokenizer or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, names, held, n = TaskContext.get().partitionId(), 0, [], [], 0
        encoder, tail = Encoder.shared(where, kind), int(end_id).to_bytes(4, "little")

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([shard], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([n], pa.int64()), pa.array([write_shard(names, held)], pa.binary())], names=["part", "shard", "n_docs", "n_tokens", "data"])

        for b in slices(batches):
            for name, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                if names and (n + len(ids) // 4 + 1 > SHARD_TOKENS or len(names) >= SHARD_DOCS):
                    yield flush()
                    shard, names, held, n = shard + 1, [], [], 0
                names.append(name)
                held.append(ids + tail)
                n += len(ids) // 4 + 1
        if names:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = ["doc_id", "_tie"]
    ranged = slim.withColumn("_tie", F.xxhash64("text") + F.col("text").isNotNull().cast("long")).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_tie")
    made = ranged.mapInArrow(run, "part int, shard long, n_docs long, n_tokens long, data binary")
    if path is None:
        return materialize(made, "token-shards")
    made.write.parquet(path)
    return spark.read.parquet(path)


def read_shards(shards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, firsts), from the files alone. documents: part, shard, doc_id, inside, n_tokens, ids (little-endian
    unsigned 32-bit, binary), inside being the offset in the shard's ids, found by select. firsts: part,
    shard, first: the ids in all shards before (one small row for each shard of some 2 million ids).
    """
    sizes = shards.select("part", "shard", "n_tokens", F.lit(0).alias("_all"))
    first = prefix_before(sizes, ["_all"], "part", ["shard"], F.col("n_tokens"), "first").select("part", "shard", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for part, number, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(data)
                flat = shard.all_ids()
                for lo in range(0, shard.n_docs, 1000):
                    hi = min(lo + 1000, shard.n_docs)
                    begin = shard.ends.select(lo - 1) if lo else 0
                    ends = shard.ends.span(lo, hi)
                    starts = np.concatenate([[begin], ends[:-1]])
                    run_ids = flat[begin : ends[-1]].astype("<u4").tobytes()
                    ids = [run_ids[4 * (x - begin) : 4 * (y - begin)] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield pa.record_batch(
                        [pa.array([part] * (hi - lo), pa.int32()), pa.array([number] * (hi - lo), pa.int64()), pa.array(shard.doc_ids[lo:hi], pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(ids, pa.binary())],
                        names=["part", "shard", "doc_id", "inside", "n_tokens", "ids"],
                    )

    read = shards.select("part", "shard", "data").mapInArrow(run, "part int, shard long, doc_id long, inside long, n_tokens long, ids binary")
    return read, first


def with_starts(documents: DataFrame, firsts: DataFrame) -> DataFrame:
    """Replace inside by start: the ids of all documents before, over all shards."""
    return documents.join(firsts, ["part", "shard"]).withColumn("start", F.col("first") + F.col("inside")).drop("first", "inside", "part", "shard")


def read_tokens(shards: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids, start of every document."""
    return with_starts(*read_shards(shards))
