from __future__ import annotations

import datetime as dt

import pytest

from tests.helpers import frame
from wardline.operators import governance

UTC = dt.timezone.utc
DAY = {n: dt.datetime(2024, 1, 16, tzinfo=UTC) + dt.timedelta(days=n) for n in (0, 1, 2, 5, 20, 60)}
BASE = dict(grant_id="g-trade", delegator="bo-kira", delegatee="bo-idle", depth=1, parent_delegation=None, region_scope=["nord"],
            allow_cost=False, allow_contact=False, purpose="test", created_at=DAY[0], expires_at=DAY[1], revoked_at=None, revoked_reason=None)
SUB = {**BASE, "delegator": "bo-plan", "depth": 2, "parent_delegation": "d-plan"}

# proposal → the rule it breaks
RULES = {
    "ok_first": (BASE, None), "ok_sub": (SUB, None), "ok_equal_expiry": ({**SUB, "expires_at": DAY[0] + dt.timedelta(days=7)}, None),
    "to_human": ({**BASE, "delegatee": "bo-lev"}, "delegatee_not_agent"),
    "to_nobody": ({**BASE, "delegatee": "zz"}, "delegatee_unknown"),
    "no_grant": ({**BASE, "grant_id": "g-none"}, "grant_unknown"),
    "not_mine": ({**BASE, "delegator": "bo-lev"}, "delegator_not_grantee"),
    "first_with_parent": ({**BASE, "parent_delegation": "d-plan"}, "first_hop_with_parent"),
    "sub_no_parent": ({**SUB, "parent_delegation": None}, "parent_required"),
    "sub_lost_parent": ({**SUB, "parent_delegation": "d-none"}, "parent_unknown"),
    "not_parent_holder": ({**SUB, "delegator": "bo-idle", "delegatee": "bo-route"}, "delegator_not_parent_holder"),
    "depth_skip": ({**SUB, "depth": 3}, "depth_step"),
    "other_grant": ({**SUB, "grant_id": "g-cobalt"}, "parent_other_grant"),
    "wider_than_parent": ({**SUB, "region_scope": ["nord", "west"]}, "regions_exceed_parent"),
    "columns_over_parent": ({**SUB, "allow_cost": True}, "columns_exceed_parent"),
    "outlives_parent": ({**SUB, "expires_at": DAY[20]}, "outlives_parent"),
    "wider_than_grant": ({**BASE, "region_scope": ["nord", "west", "sued"]}, "regions_exceed_grant"),
    "columns_over_grant": ({**BASE, "allow_contact": True}, "columns_exceed_grant"),
    "outlives_grant": ({**BASE, "expires_at": DAY[60]}, "outlives_grant"),
}


def proposals(spark, world, cases):
    names = world["delegation"].columns
    return frame(spark, [[{**c, "delegation_id": n}[k] for k in names] for n, c in cases.items()], world["delegation"].schema)


def test_one_proposal_per_rule(spark, world):
    batch = proposals(spark, world, {n: c for n, (c, _) in RULES.items()})
    judged = governance.check_delegations(batch, world["data_grant"], world["delegation"], world["principal"])
    assert {r.delegation_id: r.reason for r in judged.collect()} == {n: want for n, (_, want) in RULES.items()}


def test_parents_of_the_same_batch(spark, world):
    batch = proposals(spark, world, {
        "b1": {**BASE, "delegatee": "bo-plan"}, "b2": {**SUB, "parent_delegation": "b1", "delegatee": "bo-route"},
        "b3": {**BASE, "delegator": "bo-route", "depth": 3, "parent_delegation": "b2"},
        "bad1": {**BASE, "expires_at": DAY[60], "delegatee": "bo-plan"}, "bad2": {**SUB, "parent_delegation": "bad1"},
        "deep": {**BASE, "depth": 4, "parent_delegation": "b3"},
    })
    judged = governance.create_delegations(batch, world["data_grant"], world["delegation"], world["principal"])
    assert {r.delegation_id: r.reason for r in judged.collect()} == {
        "b1": None, "b2": None, "b3": None, "bad1": "outlives_grant", "bad2": "parent_unknown", "deep": "depth_out_of_range"}


def test_grants_go_to_humans_and_enter_unapproved(spark, world):
    rows = world["data_grant"].limit(1).collect()[0].asDict()
    batch = frame(spark, [[{**rows, "grant_id": g, "grantee_principal": p}[k] for k in world["data_grant"].columns]
                          for g, p in (("n1", "bo-lev"), ("n2", "bo-plan"), ("n3", "zz"))], world["data_grant"].schema)
    judged = governance.check_grants(batch, world["principal"])
    assert {r.grant_id: r.reason for r in judged.collect()} == {"n1": None, "n2": "grantee_not_human", "n3": "grantee_unknown"}
    after = governance.request_grants(world["data_grant"], batch, world["principal"]).filter("grant_id LIKE 'n%'").collect()
    assert [(r.grant_id, r.approved_at, r.approved_by) for r in after] == [("n1", None, None)]


def test_approval(spark, world, now):
    cmds = frame(spark, [(1, "g-asked", "bo-kira"), (2, "g-asked", "bo-plan"), (3, "g-asked", "zz"), (4, "g-zz", "al-ines"),
                         (5, "g-asked", "al-jonas"), (6, "g-asked", "al-ines"), (7, "g-asked", "al-jonas")],
                 "cmd_id long, grant_id string, approver string")
    reasons = {r.cmd_id: r.reason for r in governance.check_approvals(cmds, world["data_grant"], world["principal"]).collect()}
    assert reasons == {1: "approver_other_org", 2: "approver_not_human", 3: "approver_not_human", 4: "grant_unknown", 5: None, 6: None, 7: None}
    after = governance.approve(cmds, world["data_grant"], world["principal"], now).filter("grant_id = 'g-asked'").first()
    assert after.approved_by == "al-jonas" and after.approved_at is not None


def test_revocation_is_once_but_every_command_is_recorded(spark, world, now):
    cmds = frame(spark, [(2, "g-trade", "al-ines", "second"), (1, "g-trade", "al-ines", "first"), (3, "g-zz", "al-ines", "none")],
                 "cmd_id long, grant_id string, actor string, reason string")
    after = governance.revoke_grants(cmds, world["data_grant"], now)
    again = governance.revoke_grants(frame(spark, [(9, "g-trade", "x", "later")], cmds.schema), after, now)
    assert {r.grant_id: r.revoked_reason for r in again.collect() if r.revoked_at} == {"g-trade": "first"}
    events = governance.change_events(cmds, world["data_grant"], "grant.revoke").collect()
    assert sorted((e.cmd_id, e.request) for e in events) == [
        (1, '{"grant_id":"g-trade","reason":"first"}'), (2, '{"grant_id":"g-trade","reason":"second"}')]


@pytest.mark.parametrize("kind,target,dead", [
    ("grant", "g-trade", {"d-plan", "d-route"}), ("delegation", "d-plan", {"d-plan", "d-route"}),
    ("delegation", "d-route", {"d-route"}), ("principal", "bo-kira", {"d-plan", "d-route"}),
    ("principal", "bo-route", {"d-route"}), ("principal", "cb-mina", {"d-cargo"}), ("grant", "g-brief", set()),
])
def test_cascade(spark, world, now, kind, target, dead):
    cmds = frame(spark, [(1, kind, target)], "cmd_id long, kind string, target string")
    hit = governance.cascade(cmds, world["data_grant"], world["delegation"], world["principal"], now)
    assert {r.delegation_id for r in hit.collect()} == dead


def test_toggle(spark, world, now):
    cmds = frame(spark, [(1, "bo-kira", False), (2, "bo-lev", False), (3, "bo-lev", True)], "cmd_id long, principal_id string, enable boolean")
    off = {r.principal_id for r in governance.toggle(cmds, world["principal"], now).collect() if r.disabled_at}
    assert off == {"bo-kira"}


def test_review(spark, world, now):
    found = governance.review(world["data_grant"], world["delegation"], world["principal"], now, 3)
    assert {(r.finding, r.item) for r in found.collect()} == {("contact_on", "g-cobalt"), ("expiry_far_out", "d-plan")}
