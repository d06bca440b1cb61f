"""A lookup join is the plain join: no hint, nothing run while it is built, hot keys left to adaptive execution."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.helpers import frame
from wardline.plans import placement


def _bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def hot_fact(spark):
    """A third of the fact sits on one key."""
    return spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
                                   .otherwise(F.concat(F.lit("k"), F.col("id") % 11)).alias("k"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_equals_plain(spark, hot_fact, how):
    lookup = frame(spark, [("hot", 1), ("hot", 2), ("k1", 3), (None, 4), ("k9", 5)], "k string, v long")
    got = placement.lookup_join(hot_fact, lookup, ["k"], how, null_safe=["k"])
    right = lookup.withColumnRenamed("k", "k2")
    want = hot_fact.join(right, hot_fact["k"].eqNullSafe(right["k2"]), how).drop("k2")
    assert got.columns == want.columns
    assert _bag(got) == _bag(want)


def test_small_side_is_left_to_the_planner(spark):
    lookup = frame(spark, [("a", 1)], "k string, v long")
    joined = placement.lookup_join(spark.range(5).select(F.chr(F.col("id") + 97).alias("k")), lookup, ["k"])
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_large_lookup_is_neither_run_nor_repeated_while_built(spark, tmp_path):
    lookup = spark.range(10).select(F.assert_true(F.col("id") < 0).cast("string").alias("k"), F.col("id").alias("v"))
    plan = placement.lookup_join(spark.range(5).select(F.col("id").cast("string").alias("k")), lookup, ["k"])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text and "salt" not in text


def test_hot_key_is_split_by_adaptive_execution(spark, tmp_path):
    saved = {}
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in settings.items():
        saved[k] = spark.conf.get(k, None)
        spark.conf.set(k, v)
    try:
        fact = spark.range(0, 60_000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
        joined = placement.lookup_join(fact, frame(spark, [("hot", 1), ("7", 2)], "k string, v long"), ["k"])
        joined.write.format("noop").mode("overwrite").save()
        assert len(joined.collect()) == 20_001
        assert "skewed" in joined._jdf.queryExecution().executedPlan().toString() or "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
