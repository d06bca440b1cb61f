"""Governance tables derived from the supplied tables.

Each text runs unchanged in Spark SQL and in DuckDB: `{customer}` and the like are filled with a DataFrame on
the Spark side and with the plain table name in the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.sources.tables import base_tables

ORG = """
SELECT concat('org-', CAST(r_regionkey AS STRING)) AS org_id, r_name AS name FROM {region}
"""

PRINCIPAL = """
SELECT concat('p-', CAST(c_custkey AS STRING)) AS principal_id,
  concat('org-', CAST(n_regionkey AS STRING)) AS org_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'human' ELSE 'agent' END AS kind, c_name AS display_name,
  CASE WHEN c_custkey % 3 <> 0 THEN concat('p-', CAST(c_custkey - 1 AS STRING)) END AS owner_principal,
  CASE WHEN c_custkey % 17 = 4 THEN TIMESTAMP '2024-01-20 00:00:00' END AS disabled_at
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

GRANT = """
SELECT concat('g-', CAST(c_custkey AS STRING)) AS grant_id,
  concat('org-', CAST((n_regionkey + 1) % 5 AS STRING)) AS provider_org,
  concat('org-', CAST(n_regionkey AS STRING)) AS grantee_org,
  concat('p-', CAST(c_custkey AS STRING)) AS grantee_principal,
  split(CASE c_custkey % 4 WHEN 0 THEN 'EUROPE,ASIA' WHEN 1 THEN 'EUROPE' WHEN 2 THEN 'AFRICA,ASIA,AMERICA'
        ELSE 'MIDDLE EAST,EUROPE' END, ',') AS region_scope,
  CASE c_custkey % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'restricted' ELSE 'internal' END AS max_classification,
  c_custkey % 2 = 0 AS allow_cost, c_custkey % 5 = 0 AS allow_contact,
  TIMESTAMP '2024-01-01 00:00:00' AS requested_at,
  CASE WHEN c_custkey % 11 <> 5 THEN TIMESTAMP '2024-01-01 00:00:00' END AS approved_at,
  CASE WHEN c_custkey % 11 <> 5 THEN concat('p-', CAST(c_custkey + 3 AS STRING)) END AS approved_by,
  CASE WHEN c_custkey % 7 = 3 THEN TIMESTAMP '2024-01-10 00:00:00' ELSE TIMESTAMP '2024-03-01 00:00:00' END AS expires_at,
  CASE WHEN c_custkey % 13 = 6 THEN TIMESTAMP '2024-01-15 00:00:00' END AS revoked_at,
  CASE WHEN c_custkey % 13 = 6 THEN 'contract ended' END AS revoked_reason
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0
"""

DELEGATION = """
SELECT concat('d-', CAST(c AS STRING)) AS delegation_id,
  concat('g-', CAST(CASE WHEN c % 47 = 5 AND b >= 3 THEN b - 3 ELSE b END AS STRING)) AS grant_id,
  concat('p-', CAST(CASE WHEN c % 31 = 3 THEN c ELSE c - 1 END AS STRING)) AS delegator,
  concat('p-', CAST(CASE WHEN c % 29 = 6 THEN b ELSE c END AS STRING)) AS delegatee,
  CAST(CASE WHEN dep = 2 AND c % 37 = 4 THEN 3 ELSE dep END AS INT) AS depth,
  CASE WHEN dep = 2 AND c % 41 <> 9 THEN concat('d-', CAST(c - 1 AS STRING))
       WHEN dep = 1 AND c % 43 = 8 THEN concat('d-', CAST(c + 1 AS STRING)) END AS parent_delegation,
  split(CASE WHEN c % 10 = 7 THEN 'EUROPE,ASIA,AFRICA,AMERICA,MIDDLE EAST' WHEN b % 4 <> 2 THEN 'EUROPE'
             WHEN dep = 1 THEN 'AFRICA,ASIA' ELSE 'ASIA' END, ',') AS region_scope,
  b % 2 = 0 AND c % 8 < 4 AS allow_cost, c % 9 = 1 AS allow_contact,
  concat('purpose ', CAST(c % 4 AS STRING), ' for the planning desk of that week') AS purpose,
  CAST(NULL AS TIMESTAMP) AS created_at,
  CASE WHEN c % 12 = 1 THEN TIMESTAMP '2024-04-01 00:00:00' WHEN c % 23 = 2 THEN TIMESTAMP '2024-02-15 00:00:00'
       WHEN c % 14 = 3 THEN TIMESTAMP '2024-01-12 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS expires_at,
  CASE WHEN c % 19 = 8 THEN TIMESTAMP '2024-01-18 00:00:00' END AS revoked_at,
  CASE WHEN c % 19 = 8 THEN 'task finished' END AS revoked_reason
FROM (SELECT c_custkey AS c, c_custkey - c_custkey % 3 AS b, c_custkey % 3 AS dep
      FROM {customer} WHERE c_custkey % 3 <> 0) k
"""

SHIPMENT = """
SELECT o_orderkey AS shipment_id,
  concat('org-', CAST(o_orderkey % 5 AS STRING)) AS owner_org, r_name AS region,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'restricted' WHEN o_orderpriority IN ('2-HIGH','3-MEDIUM') THEN 'internal'
       ELSE 'public' END AS classification,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE concat('org-', CAST(o_custkey % 5 AS STRING)) END AS partner_org,
  c_mktsegment AS carrier, o_orderstatus AS status, CAST(o_orderkey % 400 AS INT) AS units,
  CAST(CAST(floor(o_totalprice) AS BIGINT) AS DECIMAL(12,2)) AS unit_cost_usd,
  CAST(o_orderkey % 50 AS DECIMAL(5,2)) AS margin_pct,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE concat(c_name, '@example.test') END AS contact_email,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE concat('+', CAST(o_custkey AS STRING)) END AS contact_phone,
  CAST(o_orderdate AS TIMESTAMP) AS updated_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey
"""

# One presented request per event: who asks, under what, for which columns, with `units = k` as the bound
# predicate. `token_exp` is when the one long-lived token the subject holds runs out.
REQUEST = """
SELECT event_id AS request_id, CAST(ts AS TIMESTAMP) AS event_ts, concat('p-', CAST(user_id AS STRING)) AS subject,
  concat('g-', CAST(user_id - user_id % 3 AS STRING)) AS grant_id,
  CASE WHEN user_id % 3 <> 0 AND event_id % 20 <> 0 THEN concat('d-', CAST(user_id AS STRING)) END AS delegation_id,
  event_type AS action, props AS request,
  split(CASE event_type WHEN 'click' THEN
      'shipment_id,owner_org,region,classification,partner_org,carrier,status,units,updated_at,unit_cost_usd,margin_pct,contact_email,contact_phone'
    WHEN 'purchase' THEN 'shipment_id,region,unit_cost_usd,contact_email' WHEN 'error' THEN 'shipment_id,secret_notes'
    WHEN 'view' THEN 'shipment_id,region,carrier,status'
    ELSE 'shipment_id,owner_org,region,classification,partner_org,carrier,status,units,updated_at' END, ',') AS columns,
  TIMESTAMP '2024-01-11 00:00:00' + (user_id % 10) * INTERVAL '1' DAY AS token_exp
FROM {events}
"""

# Claims each request signs. `kid` is what the token says, `sign_kid` the key really used.
CLAIM = """
SELECT request_id, event_ts, subject AS sub, CASE WHEN delegation_id IS NOT NULL THEN concat('p-', substr(grant_id, 3)) END AS act_as,
  grant_id, delegation_id, CASE request_id % 29 WHEN 6 THEN '1704844800' WHEN 7 THEN 'soon' WHEN 12 THEN NULL ELSE '1709251200' END AS exp,
  concat('j-', CAST(request_id AS STRING)) AS jti, split(delegation_id, ',') AS chain,
  CASE WHEN request_id % 29 = 10 THEN 'k-99' WHEN request_id % 4 = 0 THEN NULL
       ELSE concat('k-', CAST(1 + request_id % 24 AS STRING)) END AS kid,
  CASE WHEN request_id % 29 IN (10, 11) THEN 'k-7' WHEN request_id % 4 = 0 THEN 'default'
       ELSE concat('k-', CAST(1 + request_id % 24 AS STRING)) END AS sign_kid
FROM {gov_request}
"""

# How a signed token is damaged on its way, by request: other claims under the old signature, bad base64, three parts,
# empty, absent, bytes that are not text, text that is not JSON, no signature.
PRESENTED = """
CASE request_id % 29 WHEN 1 THEN concat('eyJzdWIiOiJwLTMiLCJncmFudF9pZCI6ImctMyIsImV4cCI6IjE3MDkyNTEyMDAifQ==.', split_part(token, '.', 2))
  WHEN 2 THEN concat('!!!.', split_part(token, '.', 2)) WHEN 3 THEN concat(token, '.x') WHEN 4 THEN '' WHEN 5 THEN NULL
  WHEN 8 THEN concat('/wA=.', split_part(token, '.', 2)) WHEN 9 THEN concat('bm90IGpzb24=.', split_part(token, '.', 2))
  WHEN 13 THEN split_part(token, '.', 1) ELSE token END
"""

# One audit token per principal; some name an organisation that is not theirs.
AUDIT_CLAIM = """
SELECT principal_id AS sub, CASE WHEN CAST(substr(principal_id, 3) AS BIGINT) % 5 = 2 THEN 'org-0' ELSE org_id END AS audit_org,
  '1709251200' AS exp, 'default' AS kid FROM {gov_principal}
"""

# Test keys, one per nation plus `default`; a deployment reads its own key table instead.
KEY = """
SELECT CASE WHEN n_nationkey = 0 THEN 'default' ELSE concat('k-', CAST(n_nationkey AS STRING)) END AS kid,
  concat('test key of ', n_name) AS secret_text FROM {nation}
"""

TEXTS = {
    "gov_org": ORG, "gov_principal": PRINCIPAL, "gov_grant": GRANT, "gov_delegation": DELEGATION,
    "gov_shipment": SHIPMENT, "gov_request": REQUEST, "gov_key_text": KEY, "gov_claim": CLAIM,
    "gov_audit_claim": AUDIT_CLAIM,
}
USES = {
    "gov_org": ("region",), "gov_principal": ("customer", "nation"), "gov_grant": ("customer", "nation"),
    "gov_delegation": ("customer",), "gov_shipment": ("orders", "customer", "nation", "region"),
    "gov_request": ("events",), "gov_key_text": ("nation",),
}


class Derived:
    """Lazy access to the derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.base = base_tables(spark, sf_dir)

    def _table(self, name: str, **sources: DataFrame) -> DataFrame:
        return self.spark.sql(TEXTS[name], **(sources or {t: self.base[t] for t in USES[name]}))

    @cached_property
    def orgs(self) -> DataFrame:
        return self._table("gov_org")

    @cached_property
    def principals(self) -> DataFrame:
        return self._table("gov_principal")

    @cached_property
    def grants(self) -> DataFrame:
        return self._table("gov_grant")

    @cached_property
    def delegations(self) -> DataFrame:
        return self._table("gov_delegation")

    @cached_property
    def shipments(self) -> DataFrame:
        return self._table("gov_shipment")

    @cached_property
    def requests(self) -> DataFrame:
        return self._table("gov_request")


    @cached_property
    def keys(self) -> DataFrame:
        return self._table("gov_key_text").select("kid", F.sha2("secret_text", 256).alias("secret_hex"))

    @cached_property
    def claims(self) -> DataFrame:
        return self._table("gov_claim", gov_request=self.requests)

    @cached_property
    def audit_claims(self) -> DataFrame:
        return self._table("gov_audit_claim", gov_principal=self.principals)


def oracle_ctes() -> str:
    """The same texts as a CTE list for the oracle, with plain table names."""
    plain = {t: t for t in ("region", "nation", "customer", "orders", "events", "gov_request", "gov_principal")}
    texts = ",\n".join(f"{name} AS ({text.format(**plain)})" for name, text in TEXTS.items())
    return texts + ",\ngov_key AS (SELECT kid, sha256(secret_text) AS secret_hex FROM gov_key_text)"
