"""Attacks on the shared rows as data: forged and borrowed authority gets nothing, predicates on masked columns give nothing away,
and callers with honest authority get exactly their rows."""

from __future__ import annotations

import base64
import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import auths, creds, frame, rows_by_auth
from tests.test_credentials import FUTURE, PASSED, at, token
from wardline.operators import auth, credentials, guard, leaks

AGENT = {"sub": "bo-plan", "grant_id": "g-trade", "delegation_id": "d-plan", "exp": FUTURE}
NORD = [3, 18, 21, 30, 36, 45]
MINE = [2, 5, 7, 10, 12, 15, 17, 20, 22, 25, 27, 30, 32, 35, 37, 40, 42, 45]

# name → (claims, rows): an honest caller must lose nothing
CONTROLS = {
    "customer": ({"sub": "bo-kira", "grant_id": "g-trade", "exp": FUTURE}, sorted([*NORD, 1, 10, 13, 28, 31, 40])),
    "agent": (AGENT, NORD),
    "agent_of_agent": ({**AGENT, "sub": "bo-route", "delegation_id": "d-route"}, NORD),
    "other_customer": ({"sub": "cb-mina", "grant_id": "g-cobalt", "exp": FUTURE}, MINE),
    "other_agent": ({"sub": "cb-bot", "grant_id": "g-cobalt", "delegation_id": "d-cargo", "exp": FUTURE}, [i for i in MINE if i % 3]),
}


def altered(**claims):
    """The agent's token with other claims under the signature it had."""
    body = base64.b64encode(json.dumps({**AGENT, **claims}).encode()).decode()
    return f"{body}.{token(AGENT).split('.')[1]}"


FORGED = {
    "other_subject": altered(sub="bo-kira", delegation_id=None), "wider_grant": altered(grant_id="g-asked"),
    "other_delegation": altered(delegation_id="d-cargo"), "later_expiry": altered(exp=FUTURE + 1), "other_key_named": altered(kid="k2"),
    "own_key": token(AGENT, b"own key"), "unsigned": token(AGENT).split(".")[0], "no_mac": token(AGENT).split(".")[0] + ".", "empty": "",
    "nothing": None, "two_macs": token(AGENT) + "." + token(AGENT).split(".")[1], "expired": token({**AGENT, "exp": PASSED}),
    "no_expiry": token({k: v for k, v in AGENT.items() if k != "exp"}), "unknown_key": token({**AGENT, "kid": "k9"}),
}
BORROWED = {
    "agent_holds_grant": {**AGENT, "delegation_id": None}, "another_agent": {**AGENT, "sub": "bo-idle"}, "foreign_agent": {**AGENT, "sub": "cb-bot"},
    "foreign_grant": {**AGENT, "grant_id": "g-cobalt"}, "foreign_delegation": {**AGENT, "delegation_id": "d-cargo"},
    "parents_delegation": {**AGENT, "sub": "bo-route"}, "childs_delegation": {**AGENT, "delegation_id": "d-route"},
    "delegator_as_delegatee": {**AGENT, "sub": "bo-kira"}, "not_approved": {"sub": "bo-kira", "grant_id": "g-asked", "exp": FUTURE},
    "no_such_grant": {**AGENT, "grant_id": "g-none"}, "no_such_delegation": {**AGENT, "delegation_id": "d-none"},
    "colleague": {"sub": "bo-lev", "grant_id": "g-trade", "exp": FUTURE}, "provider": {"sub": "al-ines", "grant_id": "g-trade", "exp": FUTURE},
    "stranger": {"sub": "do-otto", "grant_id": "g-trade", "exp": FUTURE}, "no_subject": {"grant_id": "g-trade", "exp": FUTURE},
    "spaced_subject": {**AGENT, "sub": " bo-plan"}, "upper_subject": {**AGENT, "sub": "BO-PLAN"},
}


@pytest.fixture(scope="module")
def answers(spark, world, keys, now):
    """Every token verified, resolved and served in one job: name → rows."""
    presented = {**FORGED, **{n: token(c) for n, c in BORROWED.items()}, **{n: token(c) for n, (c, _) in CONTROLS.items()}}
    df = frame(spark, list(presented.items()), "name string, token string")
    said = credentials.verify_tokens(df, keys, at()).filter("verified").select("name", F.col("sub").alias("subject"), "grant_id", "delegation_id")
    who = auths(world, auth.credentials_of(said), now)
    rows = rows_by_auth(guard.guarded(world["shipment"], who))
    return {r.name: rows.get(r.auth_id, []) for r in guard.with_auth_id(said).select("name", "auth_id").collect()}


def test_forged_tokens_are_not_verified(answers):
    assert not answers.keys() & FORGED.keys()


def test_borrowed_authority_sees_nothing(answers):
    assert {n: answers[n] for n in BORROWED} == dict.fromkeys(BORROWED, [])


def test_honest_callers_lose_nothing(answers):
    assert {n: answers[n] for n in CONTROLS} == {n: rows for n, (_, rows) in CONTROLS.items()}


# predicate on a masked column → the agent's rows that it would give away, and those it may have
PROBES = {
    "cost_above": (lambda v: v("unit_cost_usd") > 65, [21, 30], []),
    "cost_is": (lambda v: v("unit_cost_usd") == F.lit("60.20").cast("decimal(12,2)"), [18], []),
    "margin_below": (lambda v: v("margin_pct") < 15, [30], []),
    "mail_like": (lambda v: v("contact_email").like("%@borealis%"), [3, 18, 21, 36], []),
    "mail_or_units": (lambda v: v("contact_email").like("desk3@%") | (v("units") == 5), [3], [30]),
}


@pytest.mark.parametrize("probe", PROBES)
def test_a_predicate_on_a_masked_column(spark, world, now, probe):
    asked, given_away, open_rows = PROBES[probe]
    found = leaks.disclosed(guard.visible(world["shipment"], auths(world, creds(spark, ("bo-plan", "g-trade", "d-plan")), now)), asked)
    got = {r.shipment_id: {a.arm: (a.served, a.leaks, a.n_values) for a in r.arms} for r in found.collect()}
    hidden = lambda i: 2 if i in (30, 45) else 4  # noqa: E731  rows without a partner have no contact
    assert got == {
        **{i: {"mask_first": (False, False, 0), "mask_last": (True, True, 0), "no_mask": (True, True, hidden(i))} for i in given_away},
        **{i: {"mask_first": (True, False, 0), "mask_last": (True, False, 0), "no_mask": (True, False, hidden(i))} for i in open_rows},
    }


def test_outcomes_over_arms(spark, world, now):
    who = auths(world, creds(spark, ("bo-plan", "g-trade", "d-plan"), ("bo-kira", "g-trade", None)), now)
    attacks = frame(spark, [("bo-plan/g-trade/d-plan", "agent", False, "allow"), ("bo-kira/g-trade/direct", "human", False, "allow"),
                            ("x", "human", True, "deny"), ("y", "human", True, "allow")],
                    "attack_id string, family string, must_deny boolean, decision string")
    found = leaks.disclosed(guard.visible(world["shipment"], who), lambda v: v("unit_cost_usd") > 65)
    out = leaks.evaluate(attacks, found)
    got = {(r.attack_id[:7], r.arm): (r.n_leaked_rows, r.n_leaked_values, r.bypassed) for r in out.collect()}
    agent = {"mask_first": (0, 0, False), "mask_last": (2, 0, True), "no_mask": (2, 6, True)}
    assert {arm: got["bo-plan", arm] for arm in agent} == agent
    assert got["bo-kira", "mask_first"] == got["bo-kira", "mask_last"] == (0, 0, False)  # may see costs
    assert got["bo-kira", "no_mask"][1] > 0 and got["x", "no_mask"] == (0, 0, False) and got["y", "mask_first"] == (0, 0, True)
    assert [tuple(r) for r in leaks.compare(out, "mask_first", "mask_last").collect()] == [("bo-plan/g-trade/d-plan", "agent", False, True)]
    rolled = {(r.arm, r.family): (r.total, r.n_bypassed) for r in leaks.rollup(out).collect()}
    assert rolled["mask_first", "ALL"] == (4, 1) and rolled["mask_last", "agent"] == (1, 1) and len(rolled) == 9
