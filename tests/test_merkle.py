"""Trees over chunks: a plain tree in Python, faults by kind, proofs of single chunks."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.helpers import frame
from wardline.operators import merkle
from wardline.plans.placement import stage

CHUNKS = "set_id string, chunk long, row_ids array<long>"
ROWS = [("a", c, [c * 4096 + k for k in range(3)]) for c in (0, 1, 5, 63, 64, 65, 4095, 4096, 700_000)] + [("b", 7, [28672])] + [
    ("wide", c, [c * 4096]) for c in range(200)]


def plain_root(rows):
    level = {c: hashlib.sha256(f"{c}:{','.join(map(str, ids))}".encode()).hexdigest() for c, ids in rows}
    for depth in range(1, merkle.LEVELS + 1):
        above = {}
        for n, h in sorted(level.items()):
            above.setdefault(n // merkle.FAN if depth < merkle.LEVELS else 0, []).append(f"{n}:{h}")
        level = {n: hashlib.sha256(",".join(x).encode()).hexdigest() for n, x in above.items()}
    (root,) = level.values()
    return root


@pytest.fixture(scope="module")
def chunks(spark):
    return stage(frame(spark, ROWS, CHUNKS).repartition(3))


@pytest.fixture(scope="module")
def nodes(chunks):
    return stage(merkle.tree(chunks))


@pytest.fixture(scope="module")
def sealed(chunks):
    return stage(merkle.roots(chunks))


def test_root_is_that_of_a_plain_tree(sealed, nodes):
    want = {s: plain_root([(c, ids) for t, c, ids in ROWS if t == s]) for s in ("a", "b", "wide")}
    assert {r.set_id: r.root for r in sealed.collect()} == want
    assert {r.set_id: r.hash for r in nodes.filter(F.col("level") == merkle.LEVELS).collect()} == want


def test_no_node_has_more_members_than_the_fan(nodes):
    parents = nodes.filter(F.col("level") < merkle.LEVELS).groupBy("set_id", "level", F.floor(F.col("node") / merkle.FAN)).count()
    assert parents.agg(F.max("count")).first()[0] <= merkle.FAN


EDITS = {
    "id changed": (("a", 5, [20480, 20481, 20483]), "edited"), "id dropped": (("a", 5, [20480, 20481]), "edited"),
    "ids swapped": (("a", 5, [20481, 20480, 20482]), "edited"), "chunk dropped": (None, "missing"),
}


@pytest.mark.parametrize("what", EDITS)
def test_faults_are_found_and_placed(spark, chunks, nodes, sealed, what):
    row, fault = EDITS[what]
    now = chunks.filter("not (set_id = 'a' and chunk = 5)")
    now = now.unionByName(frame(spark, [row], CHUNKS)) if row else now
    assert [tuple(r) for r in merkle.bad_chunks(now, nodes).collect()] == [("a", 5, fault)]
    assert [r.set_id for r in merkle.bad_sets(now, sealed).collect()] == ["a"]


def test_swapped_chunks_and_added_ones(spark, chunks, nodes, sealed):
    swapped = chunks.withColumn("chunk", F.when(F.expr("set_id = 'a' and chunk = 0"), 1).when(F.expr("set_id = 'a' and chunk = 1"), 0).otherwise(F.col("chunk")))
    assert sorted(tuple(r) for r in merkle.bad_chunks(swapped, nodes).collect()) == [("a", 0, "edited"), ("a", 1, "edited")]
    more = chunks.unionByName(frame(spark, [("b", 9, [36864]), ("b", 7, [28672]), ("c", 0, [1])], CHUNKS))
    assert sorted(tuple(r) for r in merkle.bad_chunks(more, nodes).collect()) == [("b", 7, "added"), ("b", 9, "added"), ("c", 0, "added")]
    assert sorted(r.set_id for r in merkle.bad_sets(more, sealed).collect()) == ["b", "c"]
    assert merkle.bad_sets(chunks.filter("set_id <> 'b'"), sealed).first().now == merkle.EMPTY
    assert merkle.bad_chunks(chunks, nodes).isEmpty() and merkle.bad_sets(chunks, sealed).isEmpty()


def test_one_chunk_is_proved_without_the_others(spark, chunks, nodes, sealed):
    wanted = frame(spark, [("a", 5), ("a", 700_000), ("wide", 130), ("b", 7)], "set_id string, chunk long")
    given = stage(merkle.proofs(nodes, wanted))
    assert given.groupBy("set_id", "chunk").count().filter(F.col("count") != merkle.LEVELS).isEmpty()
    real = chunks.join(wanted, ["set_id", "chunk"])
    assert [r.holds for r in merkle.proved(real, given, sealed).collect()] == [True] * 4
    forged = real.withColumn("row_ids", F.expr("transform(row_ids, x -> x + 1)"))
    assert [r.holds for r in merkle.proved(forged, given, sealed).collect()] == [False] * 4
    cut = given.withColumn("members", F.when(F.col("level") == 2, F.expr("transform(members, m -> named_struct('node', m.node, 'hash', sha2(m.hash, 256)))")).otherwise(F.col("members")))
    assert [r.holds for r in merkle.proved(real, cut, sealed).collect()] == [False] * 4
    assert [r.holds for r in merkle.proved(frame(spark, [("b", 8, [1])], CHUNKS), given, sealed).collect()] == [False]


def test_no_rows(spark):
    assert merkle.roots(frame(spark, [], CHUNKS)).isEmpty() and merkle.tree(frame(spark, [], CHUNKS)).isEmpty()
