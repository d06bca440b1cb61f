"""Expected answers of the small scenario: who sees which rows and columns, and who is refused."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.helpers import auths, creds, edit, frame, rows_by_auth
from wardline.operators import auth, expected, guard, leaks

KIRA, PLAN, ROUTE, MINA = (
    ("bo-kira", "g-trade", None), ("bo-plan", "g-trade", "d-plan"), ("bo-route", "g-trade", "d-route"),
    ("cb-mina", "g-cobalt", None),
)
NORD = [3, 18, 21, 30, 36, 45]
GOLDEN = {
    KIRA: sorted([*NORD, 1, 10, 13, 28, 31, 40]), PLAN: NORD, ROUTE: NORD,
    MINA: [2, 5, 7, 10, 12, 15, 17, 20, 22, 25, 27, 30, 32, 35, 37, 40, 42, 45],
}
REFUSED = [
    ("bo-kira", "g-asked", None), ("bo-plan", "g-trade", None), ("bo-idle", "g-trade", "d-plan"),
    ("bo-kira", "g-none", None), ("cb-bot", "g-trade", "d-plan"), ("bo-kira", "g-trade", "d-plan"),
    ("bo-kira", "g-trade", "d-none"), (None, None, None),
]


def key(c):
    return "/".join((c[0], c[1], c[2] or "direct"))


def test_rows_and_refusals(spark, world, now):
    who = auths(world, creds(spark, *GOLDEN, *REFUSED), now)
    got = rows_by_auth(guard.guarded(world["shipment"], who))
    assert got == {key(c): ids for c, ids in GOLDEN.items()}
    assert {r.auth_id for r in who.collect()} == {key(c) for c in GOLDEN}


def test_masks(spark, world, now):
    shown = guard.guarded(world["shipment"], auths(world, creds(spark, *GOLDEN), now))
    counts = {r.auth_id: r for r in shown.groupBy("auth_id").agg(
        F.count("unit_cost_usd").alias("cost"), F.count("margin_pct").alias("margin"), F.count("contact_email").alias("mail"),
        F.count("contact_phone").alias("phone")).collect()}
    assert [tuple(counts[key(c)][1:]) for c in (KIRA, PLAN, ROUTE)] == [(12, 12, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert tuple(counts[key(MINA)][1:]) == (18, 18, 9, 9)


def test_independent_derivation_agrees(spark, world, now):
    asked = creds(spark, *GOLDEN, *REFUSED)
    scopes = expected.expected_scopes(asked, world["data_grant"], world["delegation"], world["principal"], "2024-01-16 00:00:01")
    assert rows_by_auth(expected.expected_rows(world["shipment"], scopes)) == {key(c): ids for c, ids in GOLDEN.items()}


def test_totals_equal_row_level(spark, world, now):
    who = auths(world, creds(spark, *GOLDEN), now)
    counts = {r.auth_id: r.n_rows for r in guard.visible_counts(world["shipment"], who).collect()}
    assert counts == {key(c): len(ids) for c, ids in GOLDEN.items()}


def test_policy_predicate_equals_cells(spark, world, now):
    who = auths(world, creds(spark, *GOLDEN), now)
    s = world["shipment"]
    plain = s.join(who, guard.row_policy(s, who)).select("auth_id", "shipment_id")
    assert rows_by_auth(plain) == {key(c): ids for c, ids in GOLDEN.items()}


def test_expired_grant_refuses(spark, world):
    late = F.lit("2024-01-16 00:00:02").cast("timestamp")  # expiry is strict
    who = auths(world, creds(spark, ("bo-lev", "g-brief", None), KIRA), late)
    assert [r.subject for r in who.collect()] == ["bo-kira"]


@pytest.mark.parametrize("table,row_key,row,column,dead", [
    ("data_grant", "grant_id", "g-trade", "revoked_at", {KIRA, PLAN, ROUTE}),
    ("delegation", "delegation_id", "d-plan", "revoked_at", {PLAN, ROUTE}),
    ("delegation", "delegation_id", "d-plan", "expires_at", {PLAN, ROUTE}),
    ("delegation", "delegation_id", "d-route", "revoked_at", {ROUTE}),
    ("principal", "principal_id", "bo-kira", "disabled_at", {KIRA, PLAN, ROUTE}),
    ("principal", "principal_id", "bo-plan", "disabled_at", {PLAN, ROUTE}),
    ("principal", "principal_id", "bo-route", "disabled_at", {ROUTE}),
])
def test_anything_dead_kills_what_depends_on_it(spark, world, now, table, row_key, row, column, dead):
    changed = edit(world, table, row_key, row, **{column: F.lit("2024-01-16").cast("timestamp")})
    alive = {r.auth_id for r in auths(changed, creds(spark, *GOLDEN), now).collect()}
    assert alive == {key(c) for c in set(GOLDEN) - dead}


def test_lenient_rule_lets_a_disabled_middle_agent_pass(spark, world, now):
    changed = edit(world, "principal", "principal_id", "bo-plan", disabled_at=F.lit("2024-01-16").cast("timestamp"))
    loose = auths(changed, creds(spark, ROUTE), now, every_hop_disabled=False)
    assert loose.count() == 1


def _chain(spark, world, rows):
    """The scenario with more delegations: (id, delegator, delegatee, depth, parent, regions)."""
    start, end = (dt.datetime(2024, m, 1, tzinfo=dt.timezone.utc) for m in (1, 2))
    extra = frame(spark, [(i, "g-trade", a, b, d, p, r, False, False, "test", start, end, None, None) for i, a, b, d, p, r in rows],
                  world["delegation"].schema)
    return {**world, "delegation": world["delegation"].unionByName(extra)}


def test_three_hops_empty_scope_cycle_and_missing_parent(spark, world, now):
    w = _chain(spark, world, [
        ("d3", "bo-route", "bo-idle", 3, "d-route", ["nord", "nord", "west"]), ("d-sued", "bo-kira", "bo-idle", 1, None, ["sued"]),
        ("c1", "bo-plan", "bo-idle", 2, "c2", ["nord"]), ("c2", "bo-idle", "bo-plan", 2, "c1", ["nord"]),
        ("lost", "bo-plan", "bo-idle", 2, "d-gone", ["nord"]), ("d4", "bo-idle", "bo-plan", 4, "d3", ["nord"]),
    ])
    who = auths(w, creds(spark, *[("bo-idle", "g-trade", d) for d in ("d3", "d-sued", "c1", "lost")], ("bo-plan", "g-trade", "d4")), now)
    got = {r.delegation_id: (r.region_scope, r.chain_depth, r.chain) for r in who.collect()}
    assert got == {
        "d3": (["nord"], 3, ["d3", "d-route", "d-plan"]), "d-sued": ([], 1, ["d-sued"]),
        "d4": (["nord"], 4, ["d4", "d3", "d-route", "d-plan"]),  # deeper than the rules create, but whole
    }
    counts = {r.auth_id: r.n_rows for r in guard.visible_counts(w["shipment"], who).collect()}
    assert sorted(counts.values()) == [0, 6, 6]  # authorised with nothing to see is not a refusal


def test_chain_walk_stops_at_the_hop_limit(spark, world):
    w = _chain(spark, world, [("c1", "a", "b", 2, "c2", ["nord"]), ("c2", "b", "a", 2, "c1", ["nord"])])
    walk = auth.chain_walk(w["delegation"])
    hops = {r.leaf_id: r.n for r in walk.groupBy("leaf_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert hops == {"d-plan": 1, "d-route": 2, "d-cargo": 1, "c1": 9, "c2": 9}


def test_unknown_class_is_hidden(spark, world, now):
    odd = edit(world, "shipment", "shipment_id", 3, classification=F.lit(None).cast("string"))
    who = auths(odd, creds(spark, PLAN), now)
    assert rows_by_auth(guard.guarded(odd["shipment"], who)) == {key(PLAN): NORD[1:]}
    open_ceiling = edit(world, "data_grant", "grant_id", "g-trade", max_classification=F.lit("secret"))
    assert guard.guarded(world["shipment"], auths(open_ceiling, creds(spark, PLAN), now)).count() == 0


# --- side channels ---------------------------------------------------------
THRESHOLDS = (0, 15, 50, 65, 200)


def test_side_channels_of_the_agent(spark, world, now):
    who = auths(world, creds(spark, PLAN), now)
    cells = leaks.side_channel_cells(world["shipment"], THRESHOLDS)
    sets = {r.arm: (r.n_sets, r.leaks) for r in leaks.predicate_leak(cells, who, len(THRESHOLDS)).collect()}
    assert sets == {"mask_first": (1, False), "mask_last": (5, True)}
    order = {r.arm: r.order_differs for r in leaks.order_leak(cells, who).collect()}
    assert order == {"mask_first": False, "mask_last": True}
    totals = {r.arm: (r.sum_cost, r.max_margin, r.n_rows) for r in leaks.aggregate_leak(cells, who).collect()}
    assert totals == {"mask_first": (0, 0, 6), "mask_last": (309, 39, 6)}


@pytest.mark.parametrize("threshold,n", list(zip(THRESHOLDS, (6, 5, 3, 2, 0), strict=True)))
def test_late_masking_shows_the_predicate(spark, world, now, threshold, n):
    who = auths(world, creds(spark, PLAN), now)
    assert guard.late_masked(world["shipment"], who, F.col("unit_cost_usd") > threshold).count() == n
    assert guard.guarded(world["shipment"], who).filter(F.col("unit_cost_usd") > threshold).count() == 0


def test_late_masking_shows_the_order(spark, world, now):
    who = auths(world, creds(spark, PLAN), now)
    raw = guard.visible(world["shipment"], who).orderBy(F.col("unit_cost_usd").desc())
    assert [r.shipment_id for r in raw.collect()] == [30, 21, 18, 45, 36, 3]


def test_ablation_against_dropping_each_clause(spark, world, now):
    who = auths(world, creds(spark, *GOLDEN), now)
    got = {(r.auth_id, r.clause): r.n_exposed for r in leaks.ablate(world["shipment"], who).collect()}
    s = world["shipment"]
    clauses = {"owner": guard.row_owner, "region": guard.row_region, "ceiling": guard.row_ceiling, "partner": guard.row_partner}
    for name in clauses:
        keep = [f(s, who) for n, f in clauses.items() if n != name]
        cond = keep[0] & keep[1] & keep[2] & ~clauses[name](s, who)
        want = {r.auth_id: r.n for r in s.join(who, cond).groupBy("auth_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert {a: n for (a, c), n in got.items() if c == name} == want
    assert {c for _, c in got} == set(clauses)  # every clause keeps something out


def test_cardinality(spark, world, now):
    row = leaks.cardinality(world["shipment"], auths(world, creds(spark, PLAN), now)).first()
    assert (row.n_true, row.n_served) == (60, 6)

