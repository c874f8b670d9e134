"""Mix sources to target weights along a low-discrepancy schedule.

Slots are laid out by golden-ratio points: slot t owns the point frac(t * phi), and the cumulative target
shares say which source that point falls to. Each source's documents form a shuffled stream of words; the
stream, repeated as often as the target asks, is cut into as many equal blocks as the source has slots, and
the r-th slot of a source takes its r-th block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import word_count
from rasterloom.operators.ranking import prefix_before
from rasterloom.session import materialize

#: The fractional part of the golden ratio, and of it times 2^20: products stay exact to about 1e-10 for any slot number.
PHI, PHI_20 = 0.6180339887498949, math.modf(0.6180339887498949 * (1 << 20))[0]
#: Rows for each range of the shuffle order or of the slots, while there are less of them than ranges: both grow with the
#: square root of the rows, so neither a range nor the list of ranges outgrows a task.
LEAST_RANGE = 64


def ranges(rows: int) -> int:
    """How many bits number the ranges of so many rows."""
    return min(32, max(0, rows // LEAST_RANGE).bit_length(), (rows.bit_length() + 1) // 2 + 3)


#: Sources up to this count are broadcast (some 100 bytes each); beyond it Spark plans the join.
BROADCAST_SOURCES = 100_000


def target_shares(sources: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, source_size -> src (1..n by code point, null last), weight, target.

    Targets share the total size by weight. None passes cap times its source's size: the excess is shared by
    weight among the others until none is above (water filling; the capped sources come first by size / weight).
    """
    every = Window.partitionBy(F.lit(0))
    ring = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    s = sources.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    s = s.withColumn("weight", F.element_at(ring, ((F.col("src") - 1) % len(weights) + 1).cast("int")))
    first = Window.orderBy(F.col("source_size") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * cap).over(first), F.lit(0)))
    s = s.withColumn("_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(first), F.lit(0)))
    s = s.withColumn("_capped", F.col("_left") * F.col("weight") > F.col("source_size") * cap * F.col("_weight"))
    free = F.when(~F.col("_capped"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), "src", "_left", "_weight"))
    s = s.withColumn("_free", F.min(free).over(every))
    top = (F.col("source_size") * cap).cast("double")
    share = (F.col("_free._left") * F.col("weight")).cast("double") / F.col("_free._weight")
    return s.select(*[c for c in sources.columns if c != "source_size"], "src", "source_size", "weight", F.when(F.col("_capped"), top).otherwise(F.least(share, top)).alias("target"))


def schedule(shares: DataFrame, slots: int) -> DataFrame:
    """slot, src, block: slot t goes to the source in whose cumulative share frac(t * phi) lies; block ranks it there.

    A source with a quota that no point falls to gets one slot after the others.
    """
    spark = shares.sparkSession
    total = Window.partitionBy(F.lit(0))
    up = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    cells = 4096
    bounds = shares.filter("quota > 0").select("src", F.sum("target").over(up).alias("_up"), "target", F.sum("target").over(total).alias("_all"))
    bounds = bounds.select("src", ((F.col("_up") - F.col("target")) / F.col("_all")).alias("lo"), (F.col("_up") / F.col("_all")).alias("hi"), F.max("src").over(total).alias("_last"))
    bounds = bounds.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("src")), F.lit(0.0))).withColumn("hi", F.when(F.col("src") == F.col("_last"), 2.0).otherwise(F.col("hi")))
    bounds = materialize(bounds.drop("_last"), "mix-bounds")
    by_cell = bounds.select("src", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    high, low = F.shiftright("slot", 20), F.col("slot").bitwiseAND((1 << 20) - 1)
    whole = high * F.lit(PHI_20) - F.floor(high * F.lit(PHI_20)) + low * F.lit(PHI)
    points = spark.range(slots).withColumnRenamed("id", "slot").select("slot", (whole - F.floor(whole)).alias("u"))
    points = points.withColumn("cell", F.least(F.floor(F.col("u") * cells), F.lit(cells - 1)))
    hit = points.join(by_cell, (points.cell == by_cell.cell) & (points.u >= by_cell.lo) & (points.u < by_cell.hi)).select("slot", "src")
    hit = materialize(hit, "mix-slots")
    none = bounds.join(hit.select("src").distinct(), "src", "left_anti").select((F.lit(slots) + F.row_number().over(Window.orderBy("src")) - 1).cast("long").alias("slot"), "src")
    drawn = hit.unionByName(none).withColumn("_range", F.shiftright("slot", max(0, slots.bit_length() - ranges(slots))))
    return prefix_before(drawn, ["src"], "_range", ["slot"], F.lit(1), "block").drop("_range")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, block_words: int = 1024, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, pieces) of the mix.

    rows: one per document: row, key, source, size, src, source_size, target. pieces: slot, src, block, row, key,
    pass, start, words: which words of a document a slot takes, at offset `offset` of its block. Documents are
    shuffled within their source by md5 of the key. Words sum to floor(target) in each source, and no document is
    taken more than cap times. Null texts have size 0 and are never taken; a null source is a source of its own,
    the last; repeated rows count as rows of their own; null keys shuffle as the empty key; an empty table gives
    empty results; further columns are ignored.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("order"),
    )
    sized = materialize(sized.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    shares = materialize(target_shares(sums, weights, cap).withColumn("quota", F.floor("target")), "mix-shares")
    facts = shares.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*"), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    near = F.broadcast(shares) if facts[1] <= BROADCAST_SOURCES else shares
    rows = sized.join(near, sized["source"].eqNullSafe(near["source"])).select("row", "key", sized["source"], "size", "order", "src", "source_size", "target", "quota")
    slots = max(1, -(-int(facts[0]) // block_words))
    drawn = materialize(schedule(shares, slots), "mix-schedule")
    counts = drawn.groupBy("src").agg(F.count("*").alias("blocks"))
    counts = counts.join(shares.select("src", "source_size", "quota"), "src")
    counts = counts.select("src", "blocks", F.expr("quota div blocks").alias("base"), F.expr("quota % blocks").alias("longer"))
    prefix = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    ranged = rows.filter("size > 0 and quota > 0").withColumn("_range", F.shiftright(prefix, 32 - ranges(int(facts[2]))))
    placed = prefix_before(ranged, ["src"], "_range", ["order", "key", "row"], F.col("size"), "at")
    placed = placed.join(F.broadcast(counts) if facts[1] <= BROADCAST_SOURCES else counts, "src")
    runs = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(cap))))
    runs = runs.withColumn("_from", F.col("pass") * F.col("source_size") + F.col("at")).filter("_from < quota")
    runs = runs.withColumn("_to", F.least(F.col("_from") + F.col("size"), F.col("quota")))
    edge = "case when {x} < longer * (base + 1) then {x} div (base + 1) else longer + ({x} - longer * (base + 1)) div base end"
    runs = runs.withColumn("block", F.explode(F.expr(f"sequence({edge.format(x='_from')}, {edge.format(x='(_to - 1)')})")))
    begin = "block * base + least(block, longer)"
    runs = runs.withColumn("_begin", F.expr(begin)).withColumn("_end", F.expr("_begin + base + case when block < longer then 1 else 0 end"))
    runs = runs.withColumn("_a", F.greatest("_from", "_begin")).withColumn("words", F.least("_to", "_end") - F.col("_a"))
    pieces = runs.select("src", "block", "row", "key", "pass", (F.col("_a") - F.col("_from")).alias("start"), (F.col("_a") - F.col("_begin")).alias("offset"), "words")
    return rows.drop("order", "quota"), pieces.join(drawn, ["src", "block"]).select("slot", *pieces.columns)


def taken(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row per document: rows and the words that the mix takes from it, repeats counted."""
    sums = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
