"""Joins whose answer is a product: many rows and many members under each key, such as served rows and credentials.

`handed_out` is such a join worked out in tiles. The members of a key are cut into lists of at most `TILE`; a list meets the rows of its
key one after another, and only then is it opened. Up to there a row moves once per list, not once per member. Rows of one list lie
together, so a stored answer repeats a short sequence of members, and everything else stays the same for a whole list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.plans.placement import lookup_join, stage

TILE = 512
SLICE = 65_536  # rows of a key that a list meets in one place; keys with more are spread


def handed_out(
    rows: DataFrame, members: DataFrame, keys: Sequence[str], each: str, row: str, *, null_safe: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """`lookup_join(rows, members, keys, null_safe=null_safe)`, in tiles. `each` is the column that tells the members of a key apart,
    all others of `members` should have few values within a key. The rows of a key are spread by the column `row` over `slices` places;
    without it they are counted first, which runs `rows` once more."""
    if rows.isStreaming:
        return lookup_join(rows, members, keys, null_safe=null_safe)
    known = [k for k in keys if k not in null_safe]
    group = [c for c in members.columns if c != each]
    place = F.row_number().over(Window.partitionBy(*group).orderBy(each)) - 1
    listed = F.transform(F.collect_list(F.struct(each)), lambda m: m[each])  # keeps a NULL member
    at, kept = ["__tile", "__slice"], [c for c in group if c not in keys]
    # NULLs and capabilities not held come last: Parquet gives up its dictionary for a column that begins with NULLs alone.
    order = [F.col(c).desc_nulls_last() for c in [*kept, *null_safe, *known]]
    lists = stage(
        (members.dropna(subset=known) if known else members).withColumn("__n", F.floor(place / TILE)).groupBy(*group, "__n").agg(listed.alias("__each"))
        .orderBy(*order, "__n").withColumn("__tile", F.monotonically_increasing_id())
    )
    index = lists.select(*group, "__tile")
    if slices is None:
        sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("__slices"))
        index = lookup_join(index, sizes, keys, null_safe=null_safe)
    else:
        index = index.withColumn("__slices", F.lit(slices).cast("long"))
    index = stage(index)
    met = lookup_join(rows, index, keys, null_safe=null_safe).withColumn("__slice", F.pmod(F.xxhash64(row), "__slices"))
    spread = index.select("__tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__slices") - 1)).alias("__slice"))
    opened = lists.select("__tile", "__each").join(spread, "__tile")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small until the lists are opened: not to be merged
    return met.repartition(n, *at).join(opened.hint("merge"), at).select(*rows.columns, *kept, F.explode("__each").alias(each))
