"""Places of rows within their keys, found without a window over all rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.plans.placement import stage


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """`df` with the place (from 0, without gaps) of every row among the rows with equal `keys`, ordered by `order`.

    Rows are dealt by ranges of (keys, order) and numbered inside each range as they are written; a range knows how many rows
    of each key lie in the ranges before it. That table has at most one row per range, and one more per key, so a key with
    most of the rows is numbered by as many tasks as any other part of the table of its size. Null keys are a key like any
    other, and nulls come first. Rows that are equal in keys and order take their places in any order.
    """
    n_bits = 33  # monotonically_increasing_id: the number of the partition above, the row's number in it below
    cut = stage(
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_range", F.shiftright("_at", n_bits))
    counts = cut.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_first", "_before")
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return cut.join(offsets, on).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))
