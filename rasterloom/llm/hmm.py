"""Score texts with a hidden Markov language model.

Tokens are lower-cased words and one end per document. States emit classes: each frequent word is a class of its own,
and all others share classes by a hash; the end has its own. The number of classes grows with the training vocabulary
(a power of two, one to 64 distinct words or so, from 4,096 to 262,144, half of them for single words), and a class emits its words
by their smoothed counts. So the model is a proper distribution over texts:

    P(text) = P_hmm(classes of its tokens) * product over tokens of (c + 0.1) / M_class,

c a token's training count, M_class the sum of (c + 0.1) over the class's training words plus 0.1 for unseen ones.
Baum-Welch starts from random emissions around the class frequencies, and in each round its counts are summed over
all training documents, ROUNDS times (a caller may let it end where a round gains little): tasks run the scaled forward and backward recursions over whole documents (keeping the forward
variables of one span of steps at a time, and those before each span) and send one table of counts each. What is the same
in each round is done once before them: documents that step together are stored as one group, step by step, by places among the
group's own classes. Scores
run the scaled forward recursion over whole documents. Documents are dealt by length, as those of a task step together.

Counts of at most FREQUENT most frequent words are broadcast (fixed size); all others are joined in a shuffle, so
counts are exact for every word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import crc_mod, slices
from rasterloom.session import materialize

#: Fixed value of the base score's smoothing.
ADD = 0.1
STATES, ROUNDS = 8, 15
#: Bounds of the number of classes, and distinct training words for each class between them.
LEAST_CLASSES, MOST_CLASSES, WORDS_A_CLASS = 4096, 262_144, 64
FREQUENT = 100_000
#: Tokens that a training task reads (fewer if that leaves cores idle); tokens and documents that step together at most
#: (or one document); tokens in a stretch of steps, which fits a core's cache, and tokens whose forward variables are held.
TASK_TOKENS, TOGETHER, SIDE_BY_SIDE, STRETCH, HOLD = 16_000_000, 4_000_000, 4096, 16_384, 2_000_000
#: So many documents step together at least, where TOGETHER allows it; more only while they have at most HOLD tokens.
ABREAST = 512
#: Weight, in tokens, of the class frequencies in each state's emissions, and of the mean in each transition row.
SMOOTH = 200.0
#: A count that no word reaches.
NEVER = 1 << 62
#: Distinct words that a counting task or a word cache holds at once.
HELD = 400_000


def words(text: str | None) -> list[bytes]:
    """bytes.lower changes A-Z alone and bytes.split cuts at exactly the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_places(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """words() of many texts: the distinct words (binary), each token's place among them in the order of the texts, and
    each text's number of tokens. Python then handles a word once for all its tokens."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, sizes = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.binary_length(flat).to_numpy(zero_copy_only=False) == 0  # before leading and after trailing white space
    if blank.any():
        sizes = sizes - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[blank], minlength=len(sizes))
        flat = flat.filter(pa.array(~blank))
    coded = flat.dictionary_encode()
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes


def as_list(distinct: pa.Array) -> list[bytes]:
    """The words as Python values; one join and one split take a tenth of the time of to_pylist()."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), b"\n")
    return joined[0].as_py().split(b"\n") if len(distinct) else []


class Classes(NamedTuple):
    """0: end of document; 1 to own: words of their own; the rest: by hash. Words counted `least` times are their own."""

    total: int
    own: int
    least: int

    def of(self, word: bytes) -> int:
        return 1 + self.own + zlib.crc32(word) % (self.total - 1 - self.own)

    def assigned(self, frequent: list[tuple[bytes, int]]) -> list[int]:
        """The class of each frequent word (word, count)."""
        out, at = [], 0
        for w, c in frequent:
            at += w != b"" and c >= self.least
            out.append(0 if w == b"" else at if c >= self.least else self.of(w))
        return out


class Codes(dict):
    """word -> index among the frequent words, else -(class + 1), remembered for a bounded number of words."""

    def __init__(self, frequent: list[bytes], classes: Classes):
        super().__init__((w, i) for i, w in enumerate(frequent))
        self.frequent, self.classes = frequent, classes

    def __missing__(self, word: bytes) -> int:
        self[word] = code = -1 - self.classes.of(word)
        return code

    def trim(self) -> None:
        if len(self) > HELD + len(self.frequent):
            self.clear()
            self.update((w, i) for i, w in enumerate(self.frequent))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary, empty: end of document), c: counts in all rows of docs; summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return out

        for b in slices(batches):
            for x in b.column(0).to_pylist():
                seen.update(words(x))
                seen[b""] += 1
            if len(seen) > HELD:
                yield flush()
        yield flush()

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word binary, c long")
    return found.groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, types: int) -> tuple[list[tuple[bytes, int]], Classes]:
    """At most FREQUENT words with their counts: those in the highest steps of log2(c) / 16 that fit; and the classes of a
    vocabulary of so many types, half of them for the words of the highest steps that fit. A histogram of a few hundred
    steps picks both, so tasks send only words that are kept."""
    step = F.floor(F.log2("c") * 16).cast("int")
    found = counts.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.col("s").desc()).collect()

    def least(most: int) -> tuple[int, int]:
        """The lowest count of the highest steps with at most `most` words, and how many words those are."""
        count, total = NEVER, 0
        for _, n, lowest in found:
            if total + n > most:
                break
            count, total = lowest, total + n
        return count, total

    total = min(MOST_CLASSES, max(LEAST_CLASSES, 1 << (types // WORDS_A_CLASS).bit_length()))
    often, alone = least(FREQUENT)[0], least(min(FREQUENT, total // 2))
    kept = sorted((bytes(r["word"]), int(r["c"])) for r in counts.filter(F.col("c") >= often).collect())
    return kept, Classes(total, sum(w != b"" and c >= alone[0] for w, c in kept), alone[0])


def kind(classes: int) -> str:
    """Class ids as stored: little-endian unsigned 16-bit where they fit, else 32-bit."""
    return "<u2" if classes <= 1 << 16 else "<u4"


def encode(docs: DataFrame, frequent: list[tuple[bytes, int]], key: str, text: str, held_out, classes: Classes) -> DataFrame:
    """One row per document: row, doc_id, held_out, n_tokens, the frequent words' part of the sums, class ids (as kind()
    says), and its other words with their counts."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [w for w, _ in held.value]
        logs = np.log10(np.array([c for _, c in held.value], np.float64) + ADD)
        group = np.array(classes.assigned(held.value), np.int64)
        codes = Codes(known, classes)
        end = codes[b""] if b"" in codes else None
        for b in slices(batches):
            distinct, at, sizes = word_places(b.column(3))
            n, doc = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
            code = np.fromiter(map(codes.__getitem__, as_list(distinct)), np.int64, len(distinct))
            often, of, log = code >= 0, -1 - code, np.zeros(len(code))
            of[often], log[often] = group[code[often]], logs[code[often]]
            ids = np.zeros(len(at) + n, kind(classes.total))  # the end's class is 0
            ids[np.arange(len(at)) + doc] = of[at]
            log, n_often = np.bincount(doc, log[at], n), np.bincount(doc[often[at]], minlength=n)
            rest = ~often[at]
            doc, at = doc[rest], at[rest]
            if end is not None:
                log, n_often = log + logs[end], n_often + 1
            else:
                doc, at = np.append(doc, np.arange(n)), np.append(at, np.full(n, len(distinct)))
            distinct = pa.concat_arrays([distinct, pa.array([b""], pa.binary())])
            pair, times = np.unique(doc * len(distinct) + at, return_counts=True)
            ends = np.append(0, np.cumsum(np.bincount(pair // len(distinct), minlength=n))).astype(np.int32)
            rare = pa.ListArray.from_arrays(ends, distinct.take(pa.array(pair % len(distinct))))
            bounds = (np.append(0, np.cumsum(sizes + 1)) * ids.itemsize).astype(np.int32)
            held_ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
            codes.trim()
            cols = [pa.array(sizes + 1), pa.array(log, pa.float64()), pa.array(n_often, pa.int64()), held_ids, rare, pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))]
            yield pa.record_batch([*b.columns[:3], *cols], names=["row", "doc_id", "held_out", "n_tokens", "log_often", "n_often", "classes", "rare", "times"])

    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, log_often double, n_often long, classes binary, rare array<binary>, times array<int>")


class Hmm:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: (classes, states)

    @classmethod
    def random(cls, share: np.ndarray, states: int, seed: int = 7) -> Hmm:
        """share: frequency of each class."""
        rng = np.random.default_rng(seed)
        emit = share[:, None] * rng.gamma(4.0, 0.25, (len(share), states))
        move = np.full((states, states), 0.02) + np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0, keepdims=True))

    def _forward(self, emit: np.ndarray, ids: np.ndarray, off: np.ndarray, a: int, b: int, alpha: np.ndarray | None, room: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions over their scales, forward variables (both tokens by states) and scales of steps a to b; alpha: the
        variables of step a - 1; room: where the first two are written. emit: classes by states, so that a token's emissions
        lie together; its type is that of the results. A product with ones sums a token's states and repeats the sum for each."""
        kind_, base = emit.dtype, off[a]
        move, start, ones = self.move.astype(kind_), self.start.astype(kind_), np.ones_like(self.move, kind_)
        seen, out = (x[: off[b] - base] for x in room)
        np.take(emit, ids[base : off[b]], axis=0, mode="clip", out=seen)
        scale = np.empty_like(seen)
        edges = (off[a : b + 1] - base).tolist()
        for lo, hi in zip(edges, edges[1:], strict=False):
            now, s = out[lo:hi], scale[lo:hi]
            if alpha is None:
                np.multiply(start, seen[lo:hi], out=now)
            else:
                np.dot(alpha[: hi - lo], move, out=now)
                now *= seen[lo:hi]
            np.dot(now, ones, out=s)
            now /= s
            alpha = now
        seen /= scale
        return seen, out, scale[:, 0]

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 likelihood of each whole sequence by the scaled forward recursion; sequences step together."""
        order, ids, off = time_major(docs)
        out, alpha, emit = np.zeros(len(docs)), None, np.ascontiguousarray(self.emit, np.float64)
        room = rooms(off, STRETCH, emit)
        for a, b in stretches(off):
            _, held, scale = self._forward(emit, ids, off, a, b, alpha, room)
            logs, edges = np.log10(scale), (off[a : b + 1] - off[a]).tolist()
            for lo, hi in zip(edges, edges[1:], strict=False):
                out[: hi - lo] += logs[lo:hi]
            alpha = held[edges[-2] : edges[-1]].copy()
        back = np.empty(len(docs))
        back[order] = out
        return back

    def counts(self, docs: list[np.ndarray], total: dict[str, np.ndarray]) -> float:
        """Add expected counts of whole sequences to total, return their log10 likelihood."""
        _, ids, off = time_major(docs)
        found, at = places(ids, len(self.emit))
        return self.group_counts(found, at, off, np.ascontiguousarray(self.emit, np.float32), total)

    def group_counts(self, found: np.ndarray, ids: np.ndarray, off: np.ndarray, emit: np.ndarray, total: dict[str, np.ndarray]) -> float:
        """Add expected counts of a group (classes found in it; each token's place among them, step by step; where steps
        begin) to total, return its log10 likelihood: Baum-Welch with scaled recursions, sequences stepping together. emit:
        the emissions as 32-bit floats. Each step's variables are 32-bit floats, their sums 64-bit. Forward variables of the
        last span of at most HOLD tokens are held, others computed again from those before their span."""
        emit, spans, log, alpha, befores = emit[found], list(stretches(off, HOLD)), 0.0, None, []
        room, sums = rooms(off, HOLD, emit), np.zeros((len(self.start), len(found)))
        back, moved, after = np.ascontiguousarray(self.move.T, np.float32), np.zeros_like(self.move), np.zeros((0, len(self.start)), np.float32)

        def forward(span: tuple[int, int], alpha: np.ndarray | None) -> tuple[float, np.ndarray | None]:
            gained, base = 0.0, off[span[0]]
            for a, b in stretches(off, STRETCH, *span):
                _, out, scale = self._forward(emit, ids, off, a, b, alpha, tuple(x[off[a] - base :] for x in room))
                gained, alpha = gained + float(np.log10(scale).sum(dtype=np.float64)), out[off[b - 1] - off[a] :]
            return gained, alpha

        for span in spans:
            befores.append(alpha)
            gained, alpha = forward(span, alpha)
            log, alpha = log + gained, alpha.copy()
        for i in range(len(spans) - 1, -1, -1):
            a, b = spans[i]
            if i < len(spans) - 1:
                forward((a, b), befores[i])
            seen, out = room
            edges = (off[a : b + 1] - off[a]).tolist()
            for t in range(b - a - 1, -1, -1):
                lo, hi = edges[t], edges[t + 1]
                n = len(after)
                if n:
                    now = out[lo : lo + n]
                    moved += np.dot(now.T, after)
                    beta = np.dot(after, back)
                    now *= beta
                    after = seen[lo:hi]
                    after[:n] *= beta
                else:
                    after = seen[lo:hi]
            if not a:
                total["start"] += out[: edges[1]].sum(axis=0)
            after = after.copy()
            at = ids[off[a] : off[b]].astype(np.intp)
            for state in range(len(sums)):
                sums[state] += np.bincount(at, out[: len(at), state], len(found))
        total["emit"][found] += sums.T
        total["move"] += moved * self.move
        return log

    def zeros(self) -> dict[str, np.ndarray]:
        return {"start": np.zeros_like(self.start), "move": np.zeros_like(self.move), "emit": np.zeros_like(self.emit)}

    @classmethod
    def estimate(cls, total: dict[str, np.ndarray], share: np.ndarray) -> Hmm:
        """New probabilities from expected counts, drawn towards the class frequencies and the mean transition."""
        emit = total["emit"] + SMOOTH * share[:, None]
        move = total["move"] + SMOOTH / len(total["move"]) ** 2
        start = total["start"] + 1.0
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0, keepdims=True))


def time_major(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, ids, off): documents from long to short; their ids step by step, those of step t from off[t] on."""
    sizes = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    active = np.searchsorted(-sizes, -np.arange(sizes.max(initial=0)), "left")
    off = np.concatenate([[0], np.cumsum(active)]).astype(np.int64)
    ids = np.empty(off[-1], np.int32)
    if len(ids):
        flat = np.concatenate([docs[i] for i in order])
        step = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids[off[step] + np.repeat(np.arange(len(docs)), sizes)] = flat
    return order, ids, off


def stretches(off: np.ndarray, most: int = 0, first: int = 0, last: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs (a, b) of the steps from first to last, of at most so many tokens (STRETCH), or of one step."""
    a, steps = first, len(off) - 1 if last is None else last
    while a < steps:
        b = max(a + 1, int(np.searchsorted(off, off[a] + (most or STRETCH), "right")) - 1)
        yield a, min(b, steps)
        a = min(b, steps)


def rooms(off: np.ndarray, most: int, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two tables with a row for each token of any of stretches(off, most)."""
    rows = max(most, int(np.diff(off).max(initial=0)))
    return tuple(np.empty((min(rows, int(off[-1])), emit.shape[1]), emit.dtype) for _ in range(2))


def places(ids: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, frequent ones first so that their emissions lie together, and each id's place among them."""
    times = np.bincount(ids, minlength=classes)
    found = np.flatnonzero(times)
    found = found[np.argsort(-times[found], kind="stable")]
    place = np.zeros(classes, kind(max(2, len(found))))
    place[found] = np.arange(len(found))
    return found.astype(np.int32), place[ids]


def _class_ids(column: pa.Array, classes: int) -> list[np.ndarray]:
    return [np.frombuffer(x, kind(classes)) for x in column.to_pylist()]


def dealt(coded: DataFrame) -> DataFrame:
    """coded, dealt so that documents of like length lie together and each part has its share of the tokens: a length class
    (powers of two) takes as many parts as its tokens need."""
    spark = coded.sparkSession
    size = F.floor(F.log2("n_tokens")).cast("int")
    found = {r["s"]: int(r["n"]) for r in coded.groupBy(size.alias("s")).agg(F.sum("n_tokens").alias("n")).collect()}
    if not found:
        return coded
    share = max(1, min(TASK_TOKENS, -(-sum(found.values()) // spark.sparkContext.defaultParallelism)))
    parts, at = {s: -(-n // share) for s, n in sorted(found.items())}, 0
    first = {}
    for s, n in parts.items():
        first[s], at = at, at + n
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[size]
    return coded.withColumn("_part", table(first) + F.pmod(F.xxhash64("row"), table(parts)).cast("int")).repartitionByRange(at, "_part").drop("_part")


GROUP = "tokens int, found binary, ids binary, off binary"


def grouped(training: DataFrame, classes: int) -> DataFrame:
    """One row for each group of documents of training (classes binary) that step together: their number of tokens, the
    classes found in them, each token's place among those, step by step, and where steps begin. All rounds read it."""

    def close(waiting: list[np.ndarray]) -> pa.RecordBatch:
        _, ids, off = time_major(waiting)
        found, at = places(ids, classes)
        return pa.record_batch([pa.array([len(ids)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (found, at, off))], names=["tokens", "found", "ids", "off"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for b in batches:
            for d in _class_ids(b.column(0), classes):
                many = n + len(d)
                if waiting and (many > TOGETHER or len(waiting) >= (ABREAST if many > HOLD else SIDE_BY_SIDE)):
                    yield close(waiting)
                    waiting, n = [], 0
                waiting.append(d)
                n += len(d)
        if waiting:
            yield close(waiting)

    return training.select("classes").mapInArrow(run, GROUP)


def baum_welch(groups: DataFrame, hmm: Hmm, share: np.ndarray) -> tuple[Hmm, float]:
    """The model after one round, and the digits a token of the model before it. One round over all groups. A task sums its counts and sends them in 16 parts; each
    part is summed over 16 tasks first (beyond 1,024 tasks over a 64th of them), so a merging task reads a bounded share."""
    spark = groups.sparkSession
    held = spark.sparkContext.broadcast(hmm)
    classes, states = hmm.emit.shape
    blocks, size = 16, classes // 16

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m = held.value
        total, log, emit = m.zeros(), 0.0, np.ascontiguousarray(m.emit, np.float32)
        for b in batches:
            for i in range(b.num_rows):
                found, ids, off = (np.frombuffer(x[i].as_buffer(), "u1") for x in b.columns[1:])
                found = found.view("<i4")
                log += m.group_counts(found, ids.view(kind(max(2, len(found)))), off.view("<i8"), emit, total)
        parts = [total["emit"][i * size : (i + 1) * size].astype(np.float32).tobytes() for i in range(blocks)]
        parts.append(np.concatenate([total["start"], total["move"].ravel(), [log]]).astype(np.float32).tobytes())
        n = len(parts)
        yield pa.record_batch([pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array(parts, pa.binary())], names=["part", "task", "sums"])

    def merge(key, table: pa.Table, kinds: type) -> pa.Table:
        order = np.argsort(table.column("task").to_numpy(), kind="stable")
        sums = table.column("sums").to_pylist()
        total = sum((np.frombuffer(sums[i], kinds) for i in order), np.float64(0.0)).astype(np.float64)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([int(table.column("task").to_numpy().min())], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, task int, sums binary"
    sent = groups.mapInArrow(local, schema)
    once = sent.groupBy("part", F.expr("task div 16 % 64").alias("salt")).applyInArrow(lambda key, t: merge(key, t, np.float32), schema)
    done = once.groupBy("part").applyInArrow(lambda key, t: merge(key, t, np.float64), schema)
    got = {r["part"]: np.frombuffer(r["sums"], np.float64) for r in done.collect()}
    total, log = hmm.zeros(), 0.0
    if got:
        total["emit"] = np.concatenate([got[i].reshape(size, states) for i in range(blocks)])
        total["start"], total["move"] = got[blocks][:states].copy(), got[blocks][states:-1].reshape(states, states).copy()
        log = float(got[blocks][-1])
    return Hmm.estimate(total, share), log / max(1.0, float(total["emit"].sum()))


def fit(training: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS, least_gain: float = -np.inf) -> Hmm:
    """At most so many rounds, each over all rows of training, from random emissions; the last is the first that finds
    the likelihood risen by less than least_gain digits a token."""
    hmm, was = Hmm.random(share, states), -np.inf
    groups = materialize(grouped(training, len(share)), "lm-training")
    for _ in range(rounds):
        hmm, now = baum_welch(groups, hmm, share)
        if now - was < least_gain:
            break
        was = now
    return hmm


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 10, held: int = 0, states: int = STATES, rounds: int = ROUNDS, least_gain: float = -np.inf) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Null and empty texts are one end token; very long texts are scored whole; repeated rows are rows of their own,
    in training too; a null key counts as the empty text for the split; further columns are ignored; an empty table
    gives an empty result. With no training rows all counts are 0, and scores come from the smoothing alone.
    """
    out_of = crc_mod(F.col(key), modulus) == held
    counts = materialize(word_counts(docs.filter(~out_of), text), "lm-counts")
    facts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_all, n_types = int(facts[0]), int(facts[1])
    often, classes = frequent_words(counts, n_types)
    mass = np.zeros(classes.total)
    mass[1 + classes.own :] = ADD  # unseen words share the hashed classes alone
    for (_, c), k in zip(often, classes.assigned(often), strict=True):
        if k <= classes.own:
            mass[k] = c + ADD
    mass[0] = mass[0] or ADD
    hashed = counts.filter((F.col("c") < classes.least) & (F.length("word") > 0))
    by = (F.crc32("word") % (classes.total - 1 - classes.own) + 1 + classes.own).cast("int")
    sums = hashed.groupBy(by.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()
    np.add.at(mass, sums.column("k").to_numpy(), sums.column("c").to_numpy() + ADD * sums.column("n").to_numpy())
    share = mass / mass.sum()
    coded = materialize(encode(docs, often, key, text, out_of, classes), "lm-coded")
    training = dealt(coded.filter("not held_out").select("row", "n_tokens", "classes"))

    hmm = fit(training, share, states, rounds, least_gain)

    rare = coded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts, "word", "left")
    log = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(ADD)) * F.col("times")
    sums = found.groupBy("row").agg(F.sum(log).alias("log_rare"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_rare"))

    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((hmm, np.log10(mass)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, logs = sent.value
        names = ["row", "doc_id", "held_out", "n_tokens", "log_often", "n_often", "log_class"]

        def close(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            for b in whole:
                ids = _class_ids(b.column(6), len(logs))
                mine = m.scores(ids) - np.array([logs[x].sum() for x in ids])
                yield pa.record_batch([*b.columns[:6], pa.array(mine)], names=names)

        waiting, n = [], 0
        for b in slices(batches):
            waiting.append(b)
            n += b.num_rows
            if n >= 4096:
                yield from close(waiting)
                waiting, n = [], 0
        if waiting:
            yield from close(waiting)

    scored = coded.select("row", "doc_id", "held_out", "n_tokens", "log_often", "n_often", "classes").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, log_often double, n_often long, log_class double")
    whole = scored.join(sums, "row", "left").withColumn("_log", F.col("log_often") + F.coalesce("log_rare", F.lit(0.0)))
    total = float(np.log10(n_all + ADD * (n_types + 1)))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_often") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("_log") - F.col("n_tokens") * F.lit(total)).alias("base_score"), (F.col("_log") + F.col("log_class")).alias("score"),
    )
