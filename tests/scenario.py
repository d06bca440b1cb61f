"""A small invented world for the tests: a freight company that shares its shipments with two customers.

People and permissions are written out; shipments follow a rule, so that every region, class and partner meets every other and each
row has its own units and cost. The expected answers in the tests are stated by row id.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from wardline.schemas import DELEGATION, GRANT, ORG, PRINCIPAL, SHIPMENT

ORGS = [("alpina", "Alpina Rail"), ("borealis", "Borealis Foods"), ("cobalt", "Cobalt Tools"), ("dorado", "Dorado Shoes")]
# principal → (organisation, kind, owner)
PRINCIPALS = {
    "al-ines": ("alpina", "human", None), "al-jonas": ("alpina", "human", None),
    "bo-kira": ("borealis", "human", None), "bo-lev": ("borealis", "human", None),
    "bo-plan": ("borealis", "agent", "bo-kira"), "bo-route": ("borealis", "agent", "bo-plan"), "bo-idle": ("borealis", "agent", "bo-lev"),
    "cb-mina": ("cobalt", "human", None), "cb-bot": ("cobalt", "agent", "cb-mina"), "do-otto": ("dorado", "human", None),
}
REGIONS, CLASSES = ("nord", "west", "sued"), ("public", "internal", "restricted")
CARRIERS, STATES = ("rail", "road", "sea", "air"), ("open", "moving", "late")
N_SHIPMENTS = 60


def shipment(i: int) -> dict:
    """Row `i`: up to 45 Alpina's, up to 52 Borealis's, then Cobalt's."""
    owner = "alpina" if i <= 45 else "borealis" if i <= 52 else "cobalt"
    partner = (None, "borealis", "cobalt", "borealis", "dorado")[i % 5] if owner == "alpina" else ("alpina", None)[i % 2]
    return dict(
        shipment_id=i, owner_org=owner, region=REGIONS[i % 3], classification=CLASSES[i // 3 % 3], partner_org=partner,
        carrier=CARRIERS[i % 4], status=STATES[i * i % 3], units=13 * i % 97 + 3, unit_cost_usd=Decimal(37 * i % 101) + Decimal("0.20"),
        margin_pct=Decimal(11 * i % 53) + Decimal("0.30"), contact_email=partner and f"desk{i}@{partner}.example",
        contact_phone=partner and f"+00-{i:04}")


def grants(t: datetime) -> list[dict]:
    def one(name, org, who, regions, ceiling, life, cost=False, contact=False, approved=True):
        return dict(
            grant_id=name, provider_org="alpina", grantee_org=org, grantee_principal=who, region_scope=regions, max_classification=ceiling,
            allow_cost=cost, allow_contact=contact, requested_at=t, approved_at=t if approved else None,
            approved_by="al-ines" if approved else None, expires_at=t + life)

    month = timedelta(days=30)
    return [
        one("g-trade", "borealis", "bo-kira", ["nord", "west"], "internal", month, cost=True),
        one("g-brief", "borealis", "bo-lev", ["nord"], "public", timedelta(seconds=2)),
        one("g-asked", "borealis", "bo-kira", list(REGIONS), "restricted", month, cost=True, contact=True, approved=False),
        one("g-cobalt", "cobalt", "cb-mina", list(REGIONS), "restricted", month, cost=True, contact=True),
    ]


def delegations(t: datetime) -> list[dict]:
    def one(name, grant, giver, taker, regions, days, purpose, parent=None, depth=1):
        return dict(
            delegation_id=name, grant_id=grant, delegator=giver, delegatee=taker, depth=depth, parent_delegation=parent, region_scope=regions,
            allow_cost=False, allow_contact=False, purpose=purpose, created_at=t, expires_at=t + timedelta(days=days))

    return [
        one("d-plan", "g-trade", "bo-kira", "bo-plan", ["nord"], 7, "plans the week"),
        one("d-route", "g-trade", "bo-plan", "bo-route", ["nord"], 1, "finds routes for the plan", "d-plan", 2),
        one("d-cargo", "g-cobalt", "cb-mina", "cb-bot", ["west", "sued"], 2, "counts cargo"),
    ]


def world(spark: SparkSession, as_of: datetime) -> dict[str, DataFrame]:
    """The tables under the fixed schemas, with every time relative to `as_of`."""
    def make(rows, schema):
        # an Arrow table this small becomes a local relation, whose size the planner knows
        return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(schema)))

    people = [dict(principal_id=p, org_id=org, kind=kind, display_name=p, owner_principal=owner) for p, (org, kind, owner) in PRINCIPALS.items()]
    return {
        "org": make([dict(org_id=o, name=n) for o, n in ORGS], ORG), "principal": make(people, PRINCIPAL),
        "shipment": make([{**shipment(i), "updated_at": as_of} for i in range(1, N_SHIPMENTS + 1)], SHIPMENT),
        "data_grant": make(grants(as_of), GRANT), "delegation": make(delegations(as_of), DELEGATION),
    }
