"""Answers with a row for every (credential, row): lists of credentials meet the rows, and are opened last."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.helpers import auths, creds, frame
from wardline import catalog
from wardline.operators import guard, query
from wardline.plans import tiles
from wardline.plans.placement import lookup_join

HANDED_OUT = [
    "row_policy", "join_shipment_auth", "guarded_scan", "late_mask_scan", "select_columns", "caller_params", "expected_access",
    "agg_visible_values", "join_forbidden", "in_boundary", "agg_string", "set_missing_extra", "audit_rows",
]
PLAN, KIRA, MINA = ("bo-plan", "g-trade", "d-plan"), ("bo-kira", "g-trade", None), ("cb-mina", "g-cobalt", None)


def _bag(df, columns=None):
    return sorted(map(tuple, df.select(columns or df.columns).collect()), key=repr)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def scopes(spark, world, now):
    return auths(world, creds(spark, PLAN, KIRA, MINA), now)


@pytest.mark.parametrize("slices", [None, 1, 3])
def test_equals_the_plain_join(spark, monkeypatch, slices):
    monkeypatch.setattr(tiles, "TILE", 2)
    monkeypatch.setattr(tiles, "SLICE", 2)
    rows = frame(spark, [(i, "a" if i % 3 else "b", None if i % 4 else "p") for i in range(12)] + [(1, "a", None), (99, None, "p")],
                 "id bigint, k string, p string")
    members = frame(spark, [("a", None, "x", True), ("a", None, "x", True), ("a", None, "y", True), ("a", None, None, True), ("a", None, "z", False),
                            ("b", "p", "x", None), ("a", "p", "x", True), (None, "p", "x", True), ("c", None, "x", True)],
                    "k string, p string, who string, may boolean")
    got = tiles.handed_out(rows, members, ["k", "p"], "who", "id", null_safe=["p"], slices=slices)
    want = lookup_join(rows, members, ["k", "p"], null_safe=["p"])
    assert _bag(got, want.columns) == _bag(want) != []


def test_a_row_moves_once_per_list(spark):
    rows = spark.range(1000).select("id", F.lit("k").alias("k"))
    members = spark.range(100).select(F.lit("k").alias("k"), F.col("id").cast("string").alias("who"))
    met = tiles.handed_out(rows, members, ["k"], "who", "id")
    assert met.count() == 100_000
    plan = _plan(met)
    assert plan.index("Generate explode(__each") < plan.index("Join") < plan.index("RepartitionByExpression")


@pytest.mark.parametrize("name", HANDED_OUT)
def test_lists_are_opened_last(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "Generate explode(__each" in plan and "Join" not in plan[:plan.index("Generate explode(__each")]


def test_stored_answer_is_short(spark, world, tmp_path):
    """The members of a cell come in the same sequence row after row, so that storage can leave the repeats out."""
    cell = dict(owner_org="alpina", region="NORD", classification="public", partner_org=None)
    rows = world["shipment"].limit(1).crossJoin(spark.range(4000)).withColumns({"shipment_id": F.col("id"), **{k: F.lit(v).cast("string") for k, v in cell.items()}}).drop("id")
    who = spark.range(500).select(
        F.concat(F.lit("credential-"), F.sha2(F.col("id").cast("string"), 256)).alias("auth_id"), F.lit("alpina").alias("provider_org"), F.lit("bo").alias("grantee_org"),
        F.array(F.lit("NORD")).alias("region_scope"), F.lit("public").alias("max_classification"), F.lit(True).alias("allow_cost"), F.lit(True).alias("allow_contact"))
    mixed = rows.unionByName(rows.withColumns({"shipment_id": F.col("shipment_id") + 4000, "partner_org": F.lit("bo")})).repartition(3, "shipment_id")
    out = str(tmp_path / "answer")
    guard.visible(mixed, who).select("auth_id", "shipment_id").write.parquet(out)
    size = sum(f.stat().st_size for f in (tmp_path / "answer").glob("*.parquet"))
    assert spark.read.parquet(out).count() == 4_000_000 and size < 4_000_000 * 0.3


# --- limits and aggregates of all credentials -------------------------------
@pytest.mark.parametrize("n", [1, 7, 30])
def test_first_rows_lie_with_the_first_credentials(world, scopes, n):
    from wardline.operators import caller

    twice = scopes.unionByName(scopes.filter("subject = 'bo-kira'"))
    some = guard.first_credentials(world["shipment"], twice, n)
    asked = lambda who: caller.limit_caller(caller.sort_caller(
        guard.guarded(world["shipment"], who), [("auth_id", "asc"), ("unit_cost_usd", "desc")]), n).select("auth_id", "shipment_id").collect()
    assert asked(some) == asked(twice) != []
    assert n > 1 or some.select("auth_id").distinct().count() == 1


def test_only_the_first_credentials_meet_the_rows(spark, monkeypatch):
    real, met = guard.visible, []
    monkeypatch.setattr(guard, "visible", lambda rows, who: met.append(who) or real(rows, who))
    assert catalog.QUERIES["limit_all"](spark, "/root/testdata/sf0.001").count() <= 100
    assert [who.select("auth_id").distinct().count() <= 100 for who in met] == [True]
    assert "n_rows" in _plan(met[0])


def test_credentials_of_equal_scope_are_aggregated_once(spark, world, scopes, monkeypatch):
    named = scopes.withColumn("auth_id", F.explode(F.array(*[F.concat("auth_id", F.lit(f"#{i}")) for i in range(4)])))
    twice = named.unionByName(named.filter("auth_id like 'bo-kira%#1'"))  # resolved twice: its rows count twice, as in the guarded relation
    real, met = guard.visible, []
    monkeypatch.setattr(guard, "visible", lambda rows, who: met.append(who) or real(rows, who))
    asked, where = "count(*) AS n, sum(units % 7) AS odd, count(DISTINCT carrier) AS carriers", "100 / (units + 1) < 5"
    got = query.aggregate(world["shipment"], twice, asked, where)
    plain = query.aggregate(world["shipment"], twice, f"{asked}, max(auth_id) AS me", where)
    assert _bag(got) == _bag(plain, got.columns) != []
    assert {r.me for r in plain.filter("n > 0").collect()} == {r.auth_id for r in plain.filter("n > 0").collect()}
    assert met[0].count() == 5 < met[1].count() == 13  # three scopes once, and the one that counts twice
