"""Clusters against a plain loop over integers."""

from __future__ import annotations

import hashlib
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    cs = [q for _, q in sorted(kept, key=key)[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), i) for i, c in enumerate(cs))

    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        cs = [[sum(x) // len(mine) for x in zip(*mine, strict=True)] if (mine := [q for (_, q), o in zip(kept, of, strict=True) if o == i]) else c for i, c in enumerate(cs)]
    got = [(i, *near(q)) for i, q in kept]
    inertia = {}
    for _, d, c in got:
        inertia[c] = inertia.get(c, 0) + d
    return sorted(((i is None, i or 0), c, d, inertia[c], sum(inertia.values()), cs[c]) for i, d, c in got)


def found(df):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in df.collect())


def drawn(seed, n, width):
    r = random.Random(seed)
    f32 = lambda x: pa.array([x], pa.float32())[0].as_py()
    middle = [[r.uniform(-1, 1) for _ in range(width)] for _ in range(5)]
    return [(i, [f32(m + r.gauss(0, 0.2)) for m in r.choice(middle)]) for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "k"), [(1, 300, 16), (2, 40, 5), (3, 7, 16)])
def test_clusters_are_those_of_a_plain_loop(spark, seed, n, k):
    rows = drawn(seed, n, 8)
    rows += [(None, rows[0][1]), (None, rows[1][1]), rows[2], rows[2], (rows[3][0], rows[4][1])]  # null ids, a repeated row, one id twice
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA).withColumns({"q": F.lit(1), "cluster": F.lit(2), "distance": F.lit(3)})
    got = found(centroids.cluster(df.repartition(5), k=k, width=8))
    assert got == plain(rows, k, 3)


def test_only_whole_vectors_are_kept(spark):
    good = [0.5] * 8
    rows = [(1, good, 0), (2, good[:7], 0), (3, [*good, 0.1], 0), (4, [*good[:7], None], 0), (5, [*good[:7], float("nan")], 0),
            (6, [*good[:7], float("-inf")], 0), (7, None, 0), (8, [], 0), (9, [-0.001] * 8, 0), (10, [3e38, -3e38] * 4, 0)]
    out = {r.vec_id: r for r in centroids.cluster(spark.createDataFrame(rows, SCHEMA), width=8).collect()}
    assert set(out) == {1, 9, 10}
    assert out[9].centroid == [-1] * 8 and out[10].centroid == [1 << 27, -(1 << 27)] * 4 and out[1].inertia == 0


def test_ties_and_empty_centroids(spark):
    """All vectors alike: the first cluster takes them all, the others stay where they began."""
    out = centroids.cluster(spark.createDataFrame([(i, [0.25] * 8, 0) for i in range(50)], SCHEMA), width=8).collect()
    assert len(out) == 50 and {(r.cluster, r.distance, r.inertia) for r in out} == {(0, 0, 0)}


def test_empty_table(spark):
    out = centroids.cluster(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_no_python_runs_in_tasks(spark):
    kept = centroids.whole(spark.createDataFrame([(1, [0.5] * 8, 0)], SCHEMA), 8)
    plan = kept.select(centroids.nearest([[1] * 8, [2] * 8]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
