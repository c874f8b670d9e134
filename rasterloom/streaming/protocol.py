"""JSON-line protocols: events, replies, bounded diagnostics, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the protocol; the prefix is what an installation chooses.
PREFIX, MAX_LINES, MAX_CHARS = "EVENT ", 256, 64 * 1024
RANGES = {"load": (0, 8), "dem": (8, 18), "predict": (18, 88), "postprocess": (88, 98), "write": (98, 100)}
EVENT = "type string, stage string, current double, total double, message string, percent double"


def events(lines: DataFrame, value: str = "value", prefix: str = PREFIX) -> DataFrame:
    """Lines that begin with the prefix, parsed; others and broken JSON are left out. Works on streams too."""
    body = F.from_json(F.substr(F.col(value), F.lit(len(prefix) + 1)), EVENT, {"mode": "PERMISSIVE"})
    return lines.filter(F.startswith(F.col(value), F.lit(prefix))).select(body.alias("e"), *[c for c in lines.columns if c != value]).filter("e.type is not null").select("e.*", *[c for c in lines.columns if c != value])


def event_stream(spark: SparkSession, folder: str, prefix: str = PREFIX) -> DataFrame:
    return events(spark.readStream.text(folder), prefix=prefix)


def encode(payload: Column, prefix: str = PREFIX) -> Column:
    return F.concat(F.lit(prefix), F.to_json(payload))


def overall(stage: Column, current: Column, total: Column) -> Column:
    """Percent of the whole run from a stage's own progress."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), current / F.nullif(total, F.lit(0.0))))
    out = F.lit(None).cast("double")
    for name, (a, b) in RANGES.items():
        out = F.when(stage == name, a + F.coalesce(share, F.lit(0.0)) * (b - a)).otherwise(out)
    return out


def monotone(progress: DataFrame, keys: list[str], order: str, value: str = "percent") -> DataFrame:
    """The running maximum, and whether its whole percent grew: what is worth emitting."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(order)
    out = progress.withColumn(value, F.max(value).over(upto))
    return out.withColumn("emit", F.coalesce(F.floor(value) > F.floor(F.lag(value).over(before)), F.lit(True)))


def diagnostics(lines: DataFrame, keys: list[str], order: str | Column, value: str = "line", max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> DataFrame:
    """The first max_lines different lines of each key, as long as their length sums to max_chars at most; kept tells
    which rows stay, so that repeats and drops can be counted."""
    same = Window.partitionBy(*keys, value).orderBy(order)
    run = Window.partitionBy(*keys).orderBy(order)
    out = lines.withColumn("repeat", F.row_number().over(same) > 1)
    fresh = (~F.col("repeat")).cast("int")
    out = out.withColumn("_n", F.sum(fresh).over(run)).withColumn("_c", F.sum(fresh * F.length(value)).over(run))
    return out.withColumn("kept", ~F.col("repeat") & (F.col("_n") <= max_lines) & (F.col("_c") <= max_chars)).drop("_n", "_c")


def diagnostics_report(marked: DataFrame, keys: list[str]) -> DataFrame:
    return marked.groupBy(*keys).agg(F.count_if("kept").alias("kept"), F.count_if("repeat").alias("repeats"), F.count_if(~F.col("repeat") & ~F.col("kept")).alias("dropped"))


def match_replies(requests: DataFrame, replies: DataFrame, timeout_s: int = 60) -> DataFrame:
    """request id, reply, timed_out: replies within the timeout. Columns id, ts; a stream-stream join with watermarks."""
    within = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("b.ts") >= F.col("a.ts")) & (F.col("b.ts") <= F.col("a.ts") + F.expr(f"interval {timeout_s} seconds"))
    return requests.alias("a").join(replies.alias("b"), within, "left").select(F.col("a.id").alias("id"), F.col("b.ts").alias("reply_ts"), F.col("b.ts").isNull().alias("timed_out"))
