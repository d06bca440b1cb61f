"""Answers per credential come from policy cells: no row is made for every (credential, row)."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.helpers import auths, creds, frame
from wardline import catalog
from wardline.operators import audit, guard, leaks, merkle, query
from wardline.plans.placement import stage

FOLDED = [
    "leak_eval", "leak_compare", "join_arms", "leak_rollup", "agg_family", "leak_controls", "join_expected", "leak_overmask", "leak_mask_holds", "caller_order", "limit_caller", "set_missing_extra",
]


@pytest.fixture(scope="module")
def scopes(spark, world, now):
    return auths(world, creds(spark, ("bo-plan", "g-trade", "d-plan"), ("bo-kira", "g-trade", None), ("cb-mina", "g-cobalt", None)), now)


@pytest.mark.parametrize("name", FOLDED)
def test_the_fact_is_not_joined_with_credentials(spark, monkeypatch, name):
    real = guard.visible

    def visible(shipments, who):
        assert "n_rows" in shipments.columns, "rows, not cells or kinds"
        return real(shipments, who)

    monkeypatch.setattr(guard, "visible", visible)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").columns


def test_leaks_counted_on_cells(world, scopes):
    asked = lambda v: (v("unit_cost_usd") > 40) | v("contact_email").like("desk3@%")
    rows = leaks.disclosed(guard.visible(world["shipment"], scopes), asked)
    want = leaks._count_leaks(rows, ["attack_id"])
    got = leaks.disclosed_counts(world["shipment"], scopes, asked)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) != []


def test_matches_counted_on_kinds(world, scopes):
    kinds, fewer = leaks.kinds(world["shipment"]), scopes.withColumn("region_scope", F.slice("region_scope", 1, 1))
    rows = lambda who: guard.visible(world["shipment"], who)
    want = leaks.match_rows(rows(fewer), rows(scopes))
    got = leaks.match_kinds(guard.visible(kinds, fewer), guard.visible(kinds, scopes), kinds)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert got.agg(F.max("n_missing")).first()[0] > 0


def test_shown_values_counted_on_cells(world, scopes):
    columns = list(guard.CAPS)
    want = leaks.value_counts(guard.guarded(world["shipment"], scopes), columns)
    got = leaks.long_counts(leaks.shown_counts(world["shipment"], scopes, columns), columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


@pytest.mark.parametrize("where", [None, "units % 3 = 1", "unit_cost_usd IS NULL OR units > 20"])
def test_first_rows_found_in_cells(world, scopes, where):
    order = "unit_cost_usd desc, units"
    at = F.row_number().over(Window.partitionBy("auth_id").orderBy(*query.sort_keys(order)))
    want = query.read(world["shipment"], scopes, where).withColumn("position", at).filter("position <= 3")
    got = query.top(world["shipment"], scopes, order, 3, where)
    assert sorted(map(tuple, got.select("auth_id", "position", "shipment_id").collect())) == sorted(
        map(tuple, want.select("auth_id", "position", "shipment_id").collect())) != []


def test_chunks_proved_together(spark):
    chunk = "set_id string, chunk bigint, row_ids array<bigint>"
    nodes = stage(merkle.tree(frame(spark, [("a", 0, [1, 2]), ("a", 255, [3]), ("a", 256, [4]), ("a", 70000, [5]), ("b", 0, [1, 2])], chunk)))
    claimed = frame(spark, [("a", 0, [1, 2]), ("a", 255, [9]), ("a", 256, [4]), ("a", 70000, [5]), ("b", 0, [2, 1]), ("b", 7, [1])], chunk)
    roots = nodes.filter(F.col("level") == merkle.LEVELS).select("set_id", F.col("hash").alias("root"))
    hurt = nodes.withColumn("hash", F.when(F.expr("set_id = 'a' and level = 1 and node = 1"), "00").otherwise(F.col("hash")))
    for stored in (nodes, hurt):
        want = merkle.proved(claimed, merkle.proofs(stored, claimed), roots).collect()
        got = merkle.proved_all(claimed, stored, roots).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 6


def test_grants_of_equal_terms_are_checked_once(spark, world):
    terms = ("alpina", "borealis", "public")
    grants = frame(spark, [("g1", *terms), ("g2", *terms), ("g3", "alpina", "borealis", None), ("g4", None, None, None)],
                   "grant_id string, provider_org string, grantee_org string, max_classification string")
    events = frame(spark, [(i, "read", "allow", "s", f"g{i}") for i in (1, 2, 3, 4, 5)],
                   "seq bigint, action string, decision string, set_id string, grant_id string")
    rows = frame(spark, [("s", 3), ("s", 18), ("s", 46)], "set_id string, shipment_id bigint")
    _, _, bad = audit._checked(events, rows, world["shipment"], grants, None)
    counts = {r.seq: r.n_bad for r in audit.reconcile(events, rows, world["shipment"], grants).collect()}
    assert counts[1] == counts[2] < counts[3] == 3 and not {4, 5} & counts.keys()
    assert bad.count() == counts[1] + 3  # not once more for g2
    found = audit.reconcile_rows(events, rows, world["shipment"], grants)
    assert {r.seq: r["count"] for r in found.groupBy("seq").count().collect()} == counts


@pytest.mark.parametrize("name", ["agg_string", "join_forbidden", "agg_leak_lists", "agg_visible_values", "in_boundary"])
def test_rows_are_worked_on_once_per_scope(spark, monkeypatch, name):
    real = guard.visible

    def visible(shipments, who):
        assert "scope_id" in who.columns, "credentials, not scopes"
        return real(shipments, who)

    monkeypatch.setattr(guard, "visible", visible)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").columns
