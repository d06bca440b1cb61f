"""Places within keys, without a window over the rows of a key."""

from __future__ import annotations

import random
from collections import defaultdict

from tests.helpers import frame
from wardline.plans.placement import spread_join
from wardline.plans.ranking import ranked


def test_places_are_those_of_a_sort(spark):
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.5 else r.choice(["a", "b", None]), r.choice([None, *range(500)]), i) for i in range(3000)]
    df = frame(spark, rows, "k string, o long, i long").repartition(7)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranked(df, ["k"], ["o", "i"], "at")
        assert out.select("k").filter("k = 'hot'").rdd.getNumPartitions() >= 1
        got = {(x.k, x.o, x.i): x["at"] for x in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    by = defaultdict(list)
    for k, o, i in rows:
        by[k].append((o is not None, o or 0, i))
    want = {(k, o if has else None, i): at for k, v in by.items() for at, (has, o, i) in enumerate(sorted(v))}
    assert got == want


def test_no_window_holds_the_rows_of_a_key(spark):
    out = ranked(frame(spark, [("a", 1), ("a", 2)], "k string, o long"), ["k"], ["o"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate")  # the window stands over the counts of the ranges
    assert sorted((x.o, x.place) for x in out.collect()) == [(1, 0), (2, 1)]


def test_empty(spark):
    assert ranked(frame(spark, [], "k string, o long"), ["k"], ["o"]).count() == 0


def test_spread_join_is_the_plain_join(spark):
    rows = [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}", i) for i in range(600)]
    fact = frame(spark, rows, "k string, i long")
    lookup = fact.filter("k is not null and k <> 'k3'").groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "length(k) AS v")
    got = spread_join(fact, lookup, "k", "n", share=10)
    assert got.columns == ["k", "i", "v"]
    assert sorted(map(tuple, got.collect())) == sorted((k, i, len(k)) for k, i in rows if k not in (None, "k3"))
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
