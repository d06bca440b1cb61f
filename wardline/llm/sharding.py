"""Shards of near equal bytes for indivisible groups, by Karmarkar-Karp differencing.

A group is all documents of one text; it is never split. A partial partition of some groups into `shards` subsets is its
subset sums in falling order. The two with the largest spreads are combined over and over: the largest subset of one joins
the smallest of the other, and so on, so that their spreads cancel. The last one left is the result.

One task can't hold all groups of a large table. While there are more than `most` units, they are dealt into blocks of about
`block`, and a block packs its units into bundles, by the same differencing into as many subsets as it shall have bundles; as
many units, evenly through the sizes, stay loose, so that the last step has fine units to even out with. Bundles and loose
units are the units of the next level: an eighth as many, or more if that comes nearer to `most`. So a task never sees more than about `block` or `most` units,
whatever the input, and a group heavier than the others ends up alone in its bundle. A group that outweighs a shard's fair
share is kept whole too and makes its shard larger than the others, which then share the rest.

A null text is empty; size is UTF-8 bytes plus `overhead`, so that is `overhead` for it. Repeated rows are copies like others
and share a shard. An empty table gives an empty result. Only doc_id and text are looked at. Ties are broken by a text's md5
and reruns agree.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.text import body, stage
from wardline.plans.placement import spread_join
from wardline.plans.ranking import ranked

SHARDS = 40
OVERHEAD = 16
BLOCK = 8192
MOST = 16384
FEWER = 8
TASKS = 10_000


def differenced(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The subset (0 to ways - 1) of every unit, by largest differencing. Equal spreads: the unit or combination first made goes first."""
    n = len(sizes)
    if ways == 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    sums: dict[int, np.ndarray] = {}
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def taken() -> tuple[int, np.ndarray]:
        spread, i = heapq.heappop(heap)
        if i >= n:
            return i, sums.pop(i)
        lone = np.zeros(ways, dtype=np.int64)
        lone[0] = -spread
        return i, lone

    while len(heap) > 1:
        (i, a), (j, b) = taken(), taken()
        both = a + b[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        k = n + len(made)
        made.append((i, j, order.astype(np.int16)))
        sums[k] = both - both[-1]
        heapq.heappush(heap, (-int(both[0] - both[-1]), k))
    out = np.zeros(n, dtype=np.int64)
    places = {heap[0][1]: np.arange(ways)}
    for k in range(n + len(made) - 1, n - 1, -1):
        i, j, order = made[k - n]
        at = np.empty(ways, dtype=np.int64)
        at[order] = places.pop(k)
        for child, where in ((i, at), (j, at[::-1])):
            if child < n:
                out[child] = where[0]
            else:
                places[child] = where
    return out


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["size", "unit"], ascending=[False, True], kind="stable").reset_index(drop=True)


def _bundle(level: int, share: float):
    """Of n units, n * share bundles and as many loose units."""
    def job(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        bundles = max(math.ceil(len(pdf) * share), 1)
        loose = np.diff(np.floor(np.arange(len(pdf) + 1) * share)) > 0
        of = pdf["unit"].astype(object).to_numpy().copy()
        subset = differenced(pdf["size"].to_numpy()[~loose], bundles)
        of[~loose] = [f"{level}-{pdf['block'].iloc[0]}-{b}" for b in subset]
        return pd.DataFrame({"unit": pdf["unit"], "size": pdf["size"], "bundle": of})

    return job


def _last(shards: int):
    def job(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        return pd.DataFrame({"unit": pdf["unit"], "shard": differenced(pdf["size"].to_numpy(), shards)})

    return job


def placed(units: DataFrame, shards: int = SHARDS, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """(unit, shard) for a staged table of (unit, size) with distinct units."""
    levels: list[DataFrame] = []
    while (n := units.count()) > most:
        blocks = math.ceil(n / block)
        dealt = units.withColumn("block", F.pmod(F.xxhash64("unit", F.lit(len(levels))), F.lit(blocks)).cast("int"))
        packed = stage(dealt.repartition(min(blocks, TASKS), "block").groupBy("block").applyInPandas(
            _bundle(len(levels), min(max(1 / FEWER, 0.75 * most / n), 0.5) / 2), "unit string, size long, bundle string"))
        levels.append(packed)
        units = stage(packed.groupBy("bundle").agg(F.sum("size").alias("size")).withColumnRenamed("bundle", "unit"))
    out = units.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_last(shards), "unit string, shard int")
    for packed in reversed(levels):
        out = packed.join(out.withColumnsRenamed({"unit": "_unit"}), F.col("bundle") == F.col("_unit")).select("unit", "shard")
    return out


def shard(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (the row's place in its shard, by doc_id) of every document."""
    text = body("text")
    narrow = stage(docs.select(
        "doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("unit")))
    groups = stage(narrow.groupBy("unit").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    where = stage(placed(groups.select("unit", "size"), shards, block, most))
    sized = groups.select(F.col("unit").alias("_u"), "n").join(where, F.col("_u") == F.col("unit")).select("unit", "n", "shard")
    dealt = spread_join(narrow, stage(sized), "unit", "n").select("doc_id", "size", "text_crc32", "shard", "unit")
    return ranked(dealt, ["shard"], ["doc_id", "unit"], "slot").drop("unit")
