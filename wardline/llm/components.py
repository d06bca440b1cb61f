"""Connected components over links, as DataFrame rounds: no link or label ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.text import discard, stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable over `links`, for every node that has a link.

    Alternates two star steps until the links are flat stars: every node's larger neighbours are tied to its smallest
    neighbour or itself, then its smaller ones are. Both keep the components, and together they flatten them in
    logarithmically many rounds; links that are stars around their smallest node need one. Minima are partial before the
    shuffle, so a hub costs no task more than the others.
    """
    edges = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    first = True
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        flatter = stage(_star(_star(both, larger=True), larger=False).distinct())
        if not first:
            discard(edges)
        edges, first = flatter, False
        if _flat(edges):
            break
    flat = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return flat.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def _flat(edges: DataFrame) -> bool:
    """Whether every upper node has one link and none is itself a lower node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    per_node = ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    return per_node.filter("ups > 1 or (ups = 1 and downs = 1)").isEmpty()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Tie neighbours v of u to m = min(u, its neighbours): the larger ones (v > u), or u and all smaller ones."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    joined = edges.join(least, F.col("u") == F.col("_u"))
    tied = joined.filter("v > u").select("v", "m") if larger else joined.select(F.explode(F.array("u", "v")).alias("v"), "m")
    return tied.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
