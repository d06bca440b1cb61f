"""Centroid clustering of integer vectors by JVM expressions alone.

A vector's squared distance to a centroid is the aggregate of a zip_with between its components and the centroid as a literal
array; the least of an array of (distance, number) structs is its cluster, which settles ties by the smaller number. New
centroids come from one grouped sum per component, with partial sums before the shuffle: `k` rows of sums reach the driver in each
round, and nothing else does. All arithmetic is exact in 64 bits, so results don't depend on how rows are dealt.

Only vectors with exactly `width` components, none null, NaN or infinite, are kept; repeated rows are vectors of their own. Components
become floor(64 * x). Beyond 2^27 in magnitude a component counts as 2^27, so that squared distances fit a long. The vectors of
least hash start as centroids: a null vec_id has none and comes last, equal hashes go by components; with fewer vectors than `k`
there are fewer centroids. An empty table gives an empty result. Columns other than vec_id and embedding are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.text import stage

WIDTH = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
FAR = float(1 << 27)

Centroids = list[list[int]]


def whole(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """(vec_id, q): the kept vectors with integer components."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).filter(
        (F.size("e") == width) & ~F.exists("e", odd))
    scaled = lambda x: F.floor(F.least(F.greatest(x * F.lit(float(SCALE)), F.lit(-FAR)), F.lit(FAR))).cast("bigint")
    return kept.select("vec_id", F.transform("e", scaled).alias("q"))


def start(kept: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> Centroids:
    """The `k` vectors whose ids have the least hashes."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["q"] for r in kept.withColumn("_by", by).orderBy(F.col("_by").asc_nulls_last(), "q").select("q").limit(k).collect()]


def squared(q: Column, centroid: list[int]) -> Column:
    against = F.expr(f"array({', '.join(f'{x}L' for x in centroid)})")
    return F.aggregate(F.zip_with(q, against, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def nearest(centroids: Centroids) -> Column:
    """(distance, cluster) of the nearest centroid."""
    return F.array_min(F.array(*[
        F.struct(squared(F.col("q"), c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)]))


def moved(kept: DataFrame, centroids: Centroids) -> Centroids:
    """Centroids at the floored mean of their vectors; those without vectors stay."""
    width = len(centroids[0])
    near = kept.select(nearest(centroids)["cluster"].alias("cluster"), "q")
    sums = near.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("q", F.lit(i))).alias(f"s{i}") for i in range(width)])
    out = list(centroids)
    for r in sums.collect():  # at most one row per centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid (its components)."""
    kept = stage(whole(vectors, width))
    centroids = start(kept, k, seed)
    if not centroids:
        return kept.select("vec_id", F.lit(0).alias("cluster"), *[
            F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.col("q").alias("centroid"))
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    final = stage(kept.select("vec_id", nearest(centroids).alias("best")).select("vec_id", "best.cluster", "best.distance"))
    totals = {r["cluster"]: r["s"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    of_cluster = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))
    return final.select(
        "vec_id", "cluster", "distance",
        of_cluster([totals.get(i, 0) for i in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(totals.values())).cast("bigint").alias("inertia"),
        of_cluster([",".join(map(str, c)) for c in centroids], "string").alias("listed"),
    ).withColumn("centroid", F.split("listed", ",").cast("array<bigint>")).drop("listed")
