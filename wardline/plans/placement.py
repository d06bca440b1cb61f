"""Staged tables, and joins of a fact with a lookup side.

`lookup_join` is a plain join without hints: nothing runs while a query is built, the planner broadcasts a side whose size
it knows to be small, and adaptive execution turns a shuffled join into a broadcast or splits a hot key from real sizes.
`spread_join` is for lookup sides too large to broadcast whose hot keys are known.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.session import scratch


def stage(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and read it back: lineage is cut and its size is known."""
    path = scratch(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_join(
    fact: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner", *, null_safe: Sequence[str] = ()
) -> DataFrame:
    """Join a fact to a lookup side on shared key names; fact keys are kept, lookup keys dropped."""
    renamed = lookup.select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c) for c in lookup.columns if c not in keys]
    )
    condition: Column = F.lit(True)
    for k in keys:
        fact_key, lookup_key = F.col(k), F.col(f"__{k}")
        condition = condition & (fact_key.eqNullSafe(lookup_key) if k in null_safe else fact_key == lookup_key)
    return fact.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def spread_join(fact: DataFrame, lookup: DataFrame, key: str, count: str, share: int = 1000) -> DataFrame:
    """Inner join on `key`, of which `lookup` has one row with the number of the fact's rows that bear it in `count`.

    Keys with more than one in `share` of the counted rows are broadcast: there are fewer than `share` of them, whatever the
    sizes. All other keys are joined by a shuffle, in which none has more than that part of the rows. `count` is dropped.
    """
    limit = (lookup.agg(F.sum(count)).first()[0] or 0) // share
    side = lookup.withColumnRenamed(key, "__key")
    hot, rest = side.filter(F.col(count) > limit).drop(count), side.filter(F.col(count) <= limit).drop(count)
    same = F.col(key) == F.col("__key")
    by_shuffle = fact.join(F.broadcast(hot.select("__key")), same, "left_anti").join(rest, same)
    return fact.join(F.broadcast(hot), same).union(by_shuffle).drop("__key")
