"""Merkle trees over the stored chunks of served sets.

A leaf is one chunk of row ids; a node covers the nodes of the level below whose numbers lie in its range of `FAN`, each with its
number, so that a missing, added or moved chunk changes it like an edited one. `LEVELS` levels over the chunk number end in one root
per set, whatever the number of chunks; no group has more than `FAN` members. The root goes into the sealed event, the nodes can be
stored beside the rows: rows are then checked against leaves, leaves against the root, and one chunk can be proved with the
`FAN` - 1 siblings of each level, without the others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 256
LEVELS = 4  # 256^4 chunks
EMPTY = hashlib.sha256(b"").hexdigest()


def leaf_hash(chunk: str = "chunk", ids: str = "row_ids") -> Column:
    """Hash of a chunk's number and its ids as they are stored, in their order."""
    return F.sha2(F.concat_ws(":", F.col(chunk).cast("string"), F.array_join(F.col(ids).cast("array<string>"), ",")), 256)


def leaves(chunks: DataFrame, by: str = "set_id") -> DataFrame:
    """(set, level 0, node, hash, n of ids) of every stored chunk. A chunk that is stored twice is two members of its parent."""
    return chunks.select(by, F.lit(0).alias("level"), F.col("chunk").alias("node"), leaf_hash().alias("hash"), F.size("row_ids").cast("long").alias("n"))


def _parents(nodes: DataFrame, level: int, by: str) -> DataFrame:
    """The level above. Its top level has one node per set."""
    above = F.floor(F.col("node") / FAN) if level < LEVELS else F.lit(0).cast("long")
    listed = F.array_sort(F.collect_list(F.struct("node", "hash")))
    said = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])), ",")
    return nodes.groupBy(by, above.alias("node")).agg(F.sha2(said, 256).alias("hash"), F.sum("n").alias("n")).select(
        by, F.lit(level).alias("level"), "node", "hash", "n")


def tree(chunks: DataFrame, by: str = "set_id") -> DataFrame:
    """(set, level, node, hash, n): leaves at level 0, the root at level LEVELS; n counts the ids below."""
    below = leaves(chunks, by)
    out = below
    for level in range(1, LEVELS + 1):
        below = _parents(below, level, by)
        out = out.unionByName(below)
    return out


def roots(chunks: DataFrame, by: str = "set_id") -> DataFrame:
    """(set, root, n of its ids). A set without rows has no chunk and no row here: its root is EMPTY."""
    below = leaves(chunks, by)
    for level in range(1, LEVELS + 1):
        below = _parents(below, level, by)
    return below.select(by, F.col("hash").alias("root"), "n")


def bad_chunks(chunks: DataFrame, stored: DataFrame, by: str = "set_id") -> DataFrame:
    """(set, chunk, fault) where the rows no longer fit the stored leaves: edited (also ids in another order), missing or added."""
    now = leaves(chunks, by).groupBy(by, "node").agg(F.min("hash").alias("now"), F.count("*").alias("n"))
    was = stored.filter("level = 0").select(by, "node", F.col("hash").alias("was"))
    met = now.join(was, [by, "node"], "full")
    fault = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull() | (F.col("n") > 1), "added").when(
        F.col("now") != F.col("was"), "edited")
    return met.select(by, F.col("node").alias("chunk"), fault.alias("fault")).filter("fault is not null")


def bad_sets(chunks: DataFrame, sealed_roots: DataFrame, by: str = "set_id") -> DataFrame:
    """(set, root, now) where the rows stored for a set do not give the root that was sealed (set, root)."""
    now = roots(chunks, by).select(by, F.col("root").alias("now"))
    met = sealed_roots.select(by, "root").join(now, by, "full")
    held = F.coalesce("now", F.lit(EMPTY))
    return met.withColumn("now", held).filter(~F.coalesce("root", F.lit(EMPTY)).eqNullSafe(F.col("now")))


def proofs(stored: DataFrame, wanted: DataFrame, by: str = "set_id") -> DataFrame:
    """(set, chunk, level, members): for each wanted (set, chunk), the (node, hash) members of its parent at every level, of which one
    is the chunk's own branch. At most FAN members a level."""
    asked = wanted.select(by, "chunk").distinct()
    steps = asked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    # The number of the parent of the branch at this level; the top parent covers everything.
    parent = F.floor(F.col("chunk") / F.pow(F.lit(float(FAN)), F.col("level") + 1)).cast("long")
    steps = steps.withColumn("parent", F.when(F.col("level") < LEVELS - 1, parent).otherwise(0))
    nodes = stored.filter(F.col("level") < LEVELS).withColumn(
        "parent", F.when(F.col("level") < LEVELS - 1, F.floor(F.col("node") / FAN)).otherwise(0))
    met = steps.join(nodes, [by, "level", "parent"])
    return met.groupBy(by, "chunk", "level").agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("members"))


def proved_all(claimed: DataFrame, stored: DataFrame, sealed_roots: DataFrame, by: str = "set_id") -> DataFrame:
    """`proved` for many chunks, from the nodes themselves: the siblings that chunks have in common are hashed once and held
    against the level above, from the root down, and do not go into the proof of each of up to FAN chunks below them."""
    sound = sealed_roots.select(by, F.lit(0).cast("long").alias("parent"), F.col("root").alias("said"))
    for level in range(LEVELS - 1, -1, -1):
        parent = F.floor(F.col("node") / FAN) if level < LEVELS - 1 else F.lit(0).cast("long")
        lists = stored.filter(F.col("level") == level).groupBy(by, parent.alias("parent")).agg(
            F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("members"))
        said = F.array_join(F.transform("members", lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])), ",")
        listed = lists.withColumn("said", F.sha2(said, 256)).join(sound, [by, "parent", "said"], "left_semi")
        sound = listed.select(by, F.inline("members")).select(by, F.col("node").alias("parent"), F.col("hash").alias("said"))
    held = sound.distinct().select(by, F.col("parent").alias("chunk"), F.col("said").alias("leaf"), F.lit(True).alias("holds"))
    met = claimed.select(by, "chunk", leaf_hash().alias("leaf")).join(held, [by, "chunk", "leaf"], "left")
    return met.select(by, "chunk", F.coalesce("holds", F.lit(False)).alias("holds"))


def proved(claimed: DataFrame, given: DataFrame, sealed_roots: DataFrame, by: str = "set_id") -> DataFrame:
    """(set, chunk, holds): whether the ids of a claimed chunk (set, chunk, row_ids), with its proof, lead to the sealed root.

    Each level must list the branch's own hash, and its members must hash to what the next level lists, up to the root."""
    by_level = given.groupBy(by, "chunk").agg(F.map_from_entries(F.collect_list(F.struct("level", "members"))).alias("proof"))
    met = claimed.join(by_level, [by, "chunk"], "left").join(sealed_roots.select(by, "root"), by, "left")
    start = F.struct(leaf_hash().alias("hash"), F.lit(True).alias("holds"))

    def step(acc: Column, level: Column) -> Column:
        members = F.element_at("proof", level)
        own = F.floor(F.col("chunk") / F.pow(F.lit(float(FAN)), level)).cast("long")
        listed = F.exists(members, lambda x: (x["node"] == own) & (x["hash"] == acc["hash"]))
        said = F.array_join(F.transform(members, lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])), ",")
        return F.struct(F.sha2(said, 256).alias("hash"), (acc["holds"] & F.coalesce(listed, F.lit(False))).alias("holds"))

    end = F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step)
    return met.select(by, "chunk", F.coalesce(end["holds"] & (end["hash"] == F.col("root")), F.lit(False)).alias("holds"))
