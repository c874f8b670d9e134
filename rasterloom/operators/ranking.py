"""Prefix sums and ranks within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.session import materialize


def prefix_before(df: DataFrame, group: list[str], bucket: str, order: list[Column | str], value: Column, out: str) -> DataFrame:
    """Add `out`: the sum of value over the rows of the same group that come earlier.

    bucket must be monotone in the order. Totals by (group, bucket) are pre-aggregated and
    their running sum is joined back, so a hot group is spread over its buckets. group columns
    and bucket must not be null. df is read twice: pass a table or a cheap projection.
    """
    keys = [*group, bucket]
    total = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select(*keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("long").alias("_offset"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offset, keys)
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inner), F.lit(0)).cast("long"))
        .drop("_offset")
    )


def global_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add out: 1, 2, ... over the whole table by order (unique), without sorting it in one task.

    Rows are dealt by ranges of the order and written with their range's number; ranges are counted, and a window
    runs in each. The only single-task window is over one count per range.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).withColumn("_all", F.lit(0)), "rank-ranges")
    return prefix_before(parts, ["_all"], "_range", list(order), F.lit(1), out).withColumn(out, (F.col(out) + 1).cast("int")).drop("_range", "_all")
