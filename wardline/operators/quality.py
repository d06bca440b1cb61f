"""Constraints as jobs: keys, references and value domains, each one pass over its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.plans.placement import lookup_join


def dup_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values held by more than one row (NULL counts as a value)."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose non-NULL reference finds no parent.

    Values are made distinct before the anti join, so a hot value is checked once; the rows come back by a semi
    join against the few values that failed.
    """
    values = child.select(fk).filter(F.col(fk).isNotNull()).distinct()
    missing = lookup_join(values, parent.select(F.col(pk).alias(fk)).distinct(), [fk], "left_anti")
    return lookup_join(child, missing, [fk], "left_semi")


def domain_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): every rule counted in the same scan. A rule that is NULL holds, as a CHECK does."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()])
    return counts.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("r")
    ).select("r.rule", "r.violations")
