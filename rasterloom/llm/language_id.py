"""Language by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts every substring of it. A text is parsed greedily:
each phrase is the longest match from where the last one ended. The phrases needed, times log2 of the automaton's
text length, estimate the bits of coding the text with that language's text (normalised phrases); the language
needing fewest wins.

Greedy parsing never follows suffix links, so the automaton is used as a deterministic one: where no transition
exists the phrase ends and the next begins with that character. All blocks of BLOCK symbols of a batch of texts step
through it together in numpy, each as if a phrase began with it. Then blocks are stepped through again from the state
that the block before ended in, as far as the states differ (greedy parses soon meet), until no block's end changes: the
phrases are those of the whole text. Each language has its own letters; transitions are a plain table where that is
small, else sorted keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import crc_mod, slices

#: Training bound: documents and characters for each language; documents in order of a hash of id and text,
#: longer ones cut to the same length so that they fit.
SAMPLE_DOCS, SAMPLE_CHARS = 96, 48_000
BLOCK = 384
#: Cells of a language's table of transitions; beyond that, sorted keys.
TABLE = 16_000_000
ENDS = np.int32(1 << 30)


def transitions(text: np.ndarray) -> list[dict[int, int]]:
    """The suffix automaton of text: of each state, the states that symbols lead to."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def suffix_automaton(text: np.ndarray, symbols: int) -> np.ndarray:
    """Transitions of the suffix automaton of text, a table of states x symbols with -1 where there is none."""
    rows = transitions(text)
    table = np.full((len(rows), symbols), -1, np.int32)
    for state, row in enumerate(rows):
        for c, to in row.items():
            table[state, c] = to
    return table


class Automaton:
    """Greedy steps over one language's text of symbols 0 .. symbols - 1. State `none` has no transitions: it is the one
    before a text, and the one after a symbol that the language lacks, which is a phrase of its own."""

    def __init__(self, text: np.ndarray, symbols: int):
        rows = transitions(text)
        self.symbols, self.none = symbols, len(rows)
        self.start = np.full(symbols, self.none, np.int32) + ENDS
        for c, to in rows[0].items():
            self.start[c] = to + ENDS
        n = sum(map(len, rows))
        keys = np.fromiter((i * symbols + c for i, row in enumerate(rows) for c in row), np.int64, n)
        to = np.fromiter((x for row in rows for x in row.values()), np.int32, n)
        self.table = None
        if (len(rows) + 1) * symbols <= TABLE:
            self.table = np.tile(self.start, len(rows) + 1)
            self.table[keys] = to
        else:
            order = np.argsort(keys)
            self.keys, self.to = np.append(keys[order], np.int64(1 << 62)), np.append(to[order], np.int32(0))

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states, plus ENDS where a phrase begins."""
        if self.table is not None:
            return self.table[state * self.symbols + symbol]
        key = state.astype(np.int64) * self.symbols + symbol
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], self.start[symbol])


class Model:
    """Built once per worker from the bounded labelled sample."""

    def __init__(self, sample: tuple[tuple[str, str], ...]):
        """sample: (language, text), languages in order."""
        letters = sorted({ch for _, text in sample for ch in text.lower() if ch.isalpha()})
        self.symbols = len(letters) + 2  # 0: anything but letters, last: letters that no language has
        self.letter = np.fromiter((chr(cp).isalpha() for cp in range(0x110000)), bool, 0x110000)
        self.code = np.where(self.letter, self.symbols - 1, 0).astype(np.int32)
        for i, ch in enumerate(letters):
            for form in {ch, ch.upper()}:
                if len(form) == 1:
                    self.code[ord(form)] = i + 1
        self.names = sorted({lang for lang, _ in sample})
        self.local, self.automata, self.bits = [], [], []
        for name in self.names:
            text = np.concatenate([np.concatenate([[0], self._symbols(t)]) for lang, t in sample if lang == name])
            own = np.union1d(text, [0])
            local = np.full(self.symbols, len(own), np.int32)  # the last symbol: letters of others
            local[own] = np.arange(len(own))
            self.local.append(local)
            self.automata.append(Automaton(local[text], len(own) + 1))
            self.bits.append(np.log2(max(2, len(text))))

    @staticmethod
    def points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")

    def _symbols(self, text: str) -> np.ndarray:
        return self.squeeze(self.code[self.points(text)])

    @staticmethod
    def squeeze(s: np.ndarray) -> np.ndarray:
        """Runs of what is no letter count once."""
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        return s[keep]

    def phrases(self, parts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each symbol sequence under each language: shape (sequences, languages)."""
        owner = np.repeat(np.arange(len(parts)), [-(-len(p) // BLOCK) for p in parts])
        total = np.zeros((len(parts), len(self.names)))
        if not len(owner):
            return total
        grid = np.zeros((len(owner), BLOCK), np.int32)
        size = np.zeros(len(owner), np.int64)
        at = 0
        for p in parts:
            n = -(-len(p) // BLOCK)
            grid[at : at + n].ravel()[: len(p)] = p
            size[at : at + n] = np.minimum(BLOCK, len(p) - BLOCK * np.arange(n))
            at += n
        order = np.argsort(-size, kind="stable")
        columns = np.ascontiguousarray(grid[order].T)
        left = np.searchsorted(-size[order], -np.arange(BLOCK), "left")
        place = np.empty(len(owner), np.int64)
        place[order] = np.arange(len(owner))
        follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # blocks that continue a text; the ones before are full
        later, earlier = place[follows], place[follows - 1]
        for k, automaton in enumerate(self.automata):
            symbols, none = self.local[k][columns], automaton.none
            seen = np.zeros(symbols.shape, np.int32)
            state = np.full(len(owner), none, np.int32)
            for j in range(BLOCK):
                n = left[j]
                if not n:
                    break
                seen[j, :n] = automaton.step(state[:n], symbols[j, :n])
                state[:n] = seen[j, :n] & (ENDS - 1)
            begun = np.full(len(owner), none, np.int32)
            while True:
                begin = seen[BLOCK - 1, earlier] & (ENDS - 1)
                changed = begin != begun[later]
                if not changed.any():
                    break
                todo, state = later[changed], begin[changed]
                begun[todo] = state
                for j in range(BLOCK):
                    inside = todo < left[j]
                    todo, state = todo[inside], state[inside]
                    if not len(todo):
                        break
                    now, was = automaton.step(state, symbols[j, todo]), seen[j, todo]
                    seen[j, todo] = now
                    apart = (now ^ was) & (ENDS - 1) != 0
                    todo, state = todo[apart], now[apart] & (ENDS - 1)
            back = np.zeros(len(owner))
            back[order] = (seen >> 30).sum(axis=0)
            total[:, k] = np.bincount(owner, back, len(parts))
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
        """(language or und, score, bits a symbol under the best language beyond two phrases) of each text."""
        points = [self.points(t) if t else np.zeros(0, np.uint32) for t in texts]
        sure = [i for i, p in enumerate(points) if p.size and self.names and self.letter[p].any()]
        parts = [self.squeeze(self.code[points[i]]) for i in sure]
        bits = self.phrases(parts) * np.array(self.bits)[None, :] if sure else np.zeros((0, 1))
        out: list[tuple[str, float, float | None]] = [("und", 0.0, None)] * len(texts)
        for i, part, b in zip(sure, parts, bits, strict=True):
            best = int(np.argmin(b))
            score = 1.0 / np.exp2(np.maximum(b[best] - b, -1000.0)).sum()
            out[i] = (self.names[best], float(score), float(max(0.0, b[best] - 2 * self.bits[best]) / len(part)))
        return out


@lru_cache(maxsize=2)
def model(sample: tuple[tuple[str, str], ...]) -> Model:
    return Model(sample)


def sample(docs: DataFrame, train=None, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_language: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[tuple[str, str], ...]:
    """The bounded labelled sample: of each non-null language, documents by hash order up to the bounds. A document gives its
    first characters only where all of them would pass the bound, so no language with a text is left out.

    The row_number filter keeps at most docs_per_language rows of a language in each partition before the shuffle.
    """
    slim = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    slim = slim.filter(train) if train is not None else slim
    slim = slim.select(F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key), F.col(text)).alias("order"), F.substring(F.col(text).cast("string"), 1, chars).alias("text"))
    first = Window.partitionBy("lang").orderBy("order")
    chosen = slim.select("lang", "order").withColumn("at", F.row_number().over(first)).filter(F.col("at") <= docs_per_language).select("lang", "order").distinct()
    rows = slim.join(F.broadcast(chosen), ["lang", "order"]).dropDuplicates(["lang", "order"]).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["order"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return tuple((name, t) for name, mine in texts.items() for t in _fitted(mine, chars))


def _fitted(texts: list[str], chars: int) -> list[str]:
    """The texts cut to the greatest equal length at which they fit chars together; shorter ones stay whole."""
    room, most = chars, chars
    for i, n in enumerate(sorted(map(len, texts))):
        most = room // (len(texts) - i)
        if n > most:
            break
        room -= n
    else:
        return texts
    return [t[:most] for t in texts if t[:most]]


def identify(docs: DataFrame, learned: tuple[tuple[str, str], ...], text: str = "text") -> DataFrame:
    """docs with lang_pred, score and bits_per_symbol added; only text is read.

    und with score 0: text null, empty or without a letter, or nothing was learned. score: the winner's share of
    2^-bits over the languages. Ties go to the first language by code point. Columns that clash with the new ones
    are replaced; all rows stay, repeated ones too; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(learned)
    new = ["lang_pred", "score", "bits_per_symbol"]
    docs = docs.drop(*new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(held.value)
        for b in slices(batches):
            got = list(zip(*m.predict(b.column(b.schema.get_field_index("__language_text")).to_pylist()), strict=True)) or [(), (), ()]
            cols = [pa.array(c, k) for c, k in zip(got, (pa.string(), pa.float64(), pa.float64()), strict=True)]
            keep = [i for i, n in enumerate(b.schema.names) if n != "__language_text"]
            yield pa.record_batch([*(b.column(i) for i in keep), *cols], names=[*(b.schema.names[i] for i in keep), *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn("__language_text", F.col(text).cast("string")).mapInArrow(run, schema + ", lang_pred string, score double, bits_per_symbol double")


def training_rows(key: str = "doc_id", modulus: int = 4, held: int = 2):
    """The rows learned from: those whose crc32 of the key is not held out."""
    return crc_mod(F.col(key), modulus) != held
