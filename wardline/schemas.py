"""Fixed schemas. Nothing in this package infers a schema from data."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

S, L, I, D, B, TS, NTZ = (
    StringType(), LongType(), IntegerType(), DoubleType(), BooleanType(), TimestampType(), TimestampNTZType(),
)


def _st(**cols) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in cols.items()])


# --- supplied tables -------------------------------------------------------
BASE = {
    "region": _st(r_regionkey=I, r_name=S),
    "nation": _st(n_nationkey=I, n_name=S, n_regionkey=I),
    "customer": _st(c_custkey=L, c_name=S, c_nationkey=I, c_acctbal=D, c_mktsegment=S),
    "orders": _st(o_orderkey=L, o_custkey=L, o_orderstatus=S, o_totalprice=D, o_orderdate=NTZ, o_orderpriority=S),
    "events": _st(event_id=L, ts=NTZ, user_id=L, event_type=S, value=D, props=S),
}

# --- governance tables -----------------------------------------------------
ORG = _st(org_id=S, name=S)

PRINCIPAL = _st(principal_id=S, org_id=S, kind=S, display_name=S, owner_principal=S, disabled_at=TS)

SHIPMENT = _st(
    shipment_id=L, owner_org=S, region=S, classification=S, partner_org=S, carrier=S, status=S, units=I,
    unit_cost_usd=DecimalType(12, 2), margin_pct=DecimalType(5, 2), contact_email=S, contact_phone=S, updated_at=TS,
)

GRANT = _st(
    grant_id=S, provider_org=S, grantee_org=S, grantee_principal=S, region_scope=ArrayType(S),
    max_classification=S, allow_cost=B, allow_contact=B, requested_at=TS, approved_at=TS, approved_by=S,
    expires_at=TS, revoked_at=TS, revoked_reason=S,
)

DELEGATION = _st(
    delegation_id=S, grant_id=S, delegator=S, delegatee=S, depth=I, parent_delegation=S,
    region_scope=ArrayType(S), allow_cost=B, allow_contact=B, purpose=S, created_at=TS, expires_at=TS,
    revoked_at=TS, revoked_reason=S,
)

SIGNING_KEY = _st(kid=S, secret=BinaryType(), created_at=TS)

# One row per read or governance change. The exact row ids live in SERVED_ROWS, keyed by `set_id`:
# a single array per event would grow with the shared table.
AUDIT_EVENT = _st(
    seq=L, event_ts=TS, subject=S, acting_for=S, grant_id=S, delegation_id=S, chain=S, provider_org=S,
    grantee_org=S, action=S, resource=S, request=S, decision=S, deny_reason=S, row_count=L, set_id=S,
    row_digest=S, columns_served=ArrayType(S), columns_masked=ArrayType(S), kid=S, segment=L, prev_hash=S, hash=S,
)

SERVED_ROWS = _st(set_id=S, chunk=L, row_ids=ArrayType(L))

GOVERNANCE = {
    "org": ORG, "principal": PRINCIPAL, "shipment": SHIPMENT, "data_grant": GRANT, "delegation": DELEGATION,
    "audit_event": AUDIT_EVENT, "served_rows": SERVED_ROWS,
}

# --- column groups of the shared relation (fixed values) --------------------
BASE_COLUMNS = [
    "shipment_id", "owner_org", "region", "classification", "partner_org", "carrier", "status", "units", "updated_at",
]
COST_COLUMNS = ["unit_cost_usd", "margin_pct"]
CONTACT_COLUMNS = ["contact_email", "contact_phone"]
ALL_COLUMNS = BASE_COLUMNS + COST_COLUMNS + CONTACT_COLUMNS
