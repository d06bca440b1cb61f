"""A second derivation of what a credential should see, in SQL, sharing no code with `auth` or `guard`.

Rules are tested one by one at the given time and regions are met by membership, so a fault in the interval or
cell reasoning of the main path cannot hide here. The join that hands rows to credentials is the one of `plans/tiles.py`,
which tests hold against the plain join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from wardline.plans.tiles import handed_out

_SCOPE = """
WITH hop AS (
  SELECT d.delegation_id, d.grant_id, d.delegator, d.delegatee, d.depth, d.parent_delegation, d.region_scope,
    d.allow_cost, d.allow_contact,
    NOT (coalesce(d.revoked_at <= timestamp(:at), false) OR d.expires_at <= timestamp(:at) OR coalesce(p.disabled_at <= timestamp(:at), false)) AS alive
  FROM {delegations} d LEFT JOIN {principals} p ON p.principal_id = d.delegatee
), held AS (
  SELECT g.*, coalesce(p.disabled_at <= timestamp(:at), false) AS holder_off
  FROM {grants} g LEFT JOIN {principals} p ON p.principal_id = g.grantee_principal
  WHERE g.approved_at <= timestamp(:at) AND g.expires_at > timestamp(:at) AND NOT coalesce(g.revoked_at <= timestamp(:at), false)
), direct AS (
  SELECT c.subject, c.grant_id, c.delegation_id, h.provider_org, h.grantee_org, h.max_classification,
    h.region_scope AS regions, h.allow_cost, h.allow_contact
  FROM {credentials} c JOIN held h ON h.grant_id = c.grant_id
  WHERE c.delegation_id IS NULL AND c.subject = h.grantee_principal AND NOT h.holder_off
), delegated AS (
  SELECT c.subject, c.grant_id, c.delegation_id, h.provider_org, h.grantee_org, h.max_classification,
    filter(h.region_scope, r -> array_contains(x.region_scope, r) AND coalesce(array_contains(y.region_scope, r), true)
      AND coalesce(array_contains(z.region_scope, r), true)) AS regions,
    h.allow_cost AND x.allow_cost AND coalesce(y.allow_cost, true) AND coalesce(z.allow_cost, true) AS allow_cost,
    h.allow_contact AND x.allow_contact AND coalesce(y.allow_contact, true) AND coalesce(z.allow_contact, true) AS allow_contact
  FROM {credentials} c JOIN held h ON h.grant_id = c.grant_id
  JOIN hop x ON x.delegation_id = c.delegation_id
  LEFT JOIN hop y ON y.delegation_id = x.parent_delegation
  LEFT JOIN hop z ON z.delegation_id = y.parent_delegation
  WHERE NOT h.holder_off AND x.alive AND x.grant_id = c.grant_id AND x.delegatee = c.subject
    AND (x.parent_delegation IS NULL OR (y.alive AND y.grant_id = c.grant_id))
    AND (y.parent_delegation IS NULL OR (z.alive AND z.grant_id = c.grant_id)) AND z.parent_delegation IS NULL
    AND coalesce(z.delegator, y.delegator, x.delegator) = h.grantee_principal AND coalesce(z.depth, y.depth, x.depth) = 1
)
SELECT *, concat_ws('/', subject, grant_id, coalesce(delegation_id, 'direct')) AS auth_id
FROM (SELECT * FROM direct UNION ALL SELECT * FROM delegated)
"""

# A rule reads four attributes of a row, so it is tested once for every combination of them that occurs.
_KINDS = "SELECT DISTINCT owner_org, region, classification, partner_org FROM {shipments}"

_ADMITTED = """
SELECT a.auth_id, s.owner_org, s.region, s.classification, s.partner_org, a.allow_cost, a.allow_contact
FROM {kinds} s JOIN (SELECT *, explode(array_distinct(regions)) AS reg FROM {scopes}) a
  ON s.owner_org = a.provider_org AND s.region = a.reg
WHERE decode(s.classification, 'public', 1, 'internal', 2, 'restricted', 3)
   <= decode(a.max_classification, 'public', 1, 'internal', 2, 'restricted', 3)
  AND coalesce(s.partner_org, a.grantee_org) = a.grantee_org
"""


def expected_scopes(credentials: DataFrame, grants: DataFrame, delegations: DataFrame, principals: DataFrame, at: str) -> DataFrame:
    return credentials.sparkSession.sql(
        _SCOPE, args={"at": at}, credentials=credentials, grants=grants,
        delegations=delegations, principals=principals,
    )


def expected_rows(shipments: DataFrame, scopes: DataFrame) -> DataFrame:
    spark, read = shipments.sparkSession, ["owner_org", "region", "classification", "partner_org"]
    admitted = spark.sql(_ADMITTED, kinds=spark.sql(_KINDS, shipments=shipments), scopes=scopes)
    met = handed_out(shipments.select("shipment_id", *read), admitted, read, "auth_id", "shipment_id", null_safe=["partner_org"])
    return met.select("auth_id", "shipment_id", "allow_cost", "allow_contact")
