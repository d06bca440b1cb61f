"""Credentials, authorisation and governance changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.oracle import AS_OF, CTES, hmac_sql, live
from wardline.catalog.registry import Context, query
from wardline.operators import auth, credentials, expected, governance
from wardline.plans.placement import lookup_join

T = f"TIMESTAMP '{AS_OF}'"
ARR = "array_to_string(list_sort(list_distinct({0})), ',')"


def regions(col="region_scope"):
    return F.array_join(F.array_sort(F.array_distinct(col)), ",")


# --- credentials -----------------------------------------------------------
@query("sign_claims", """SELECT request_id, token FROM (SELECT request_id, concat(body, '.', @SIGN@) AS token FROM (
  SELECT c.request_id, p.ipad, p.opad, base64(encode(CAST(to_json({sub: c.sub, grant_id: c.grant_id, exp: c.exp}) AS VARCHAR))) AS body
  FROM gov_claim c JOIN pad p ON p.kid = c.sign_kid))""".replace("@SIGN@", hmac_sql("body")))
def sign_claims(c: Context):
    return credentials.sign_claims(c.claims, c.keys, ["sub", "grant_id", "exp"], kid="sign_kid").select("request_id", "token")


@query("verify_tokens", "SELECT request_id, verified, sub, grant_id, delegation_id FROM ver")
def verify_tokens(c: Context):
    return c.verified.select("request_id", "verified", "sub", "grant_id", "delegation_id")


@query("verify_reason", "SELECT request_id, stage FROM tok_stage")
def verify_reason(c: Context):
    return credentials.inspect_tokens(c.tokens, c.keys, F.col("event_ts")).select("request_id", "stage")


@query("viewer_org", "SELECT sub, viewer_org FROM viewer")
def viewer_org(c: Context):
    return c.viewers.select("sub", "viewer_org")


@query("join_cred_key", """SELECT t.request_id, p.kid IS NOT NULL AS known FROM tok_doc t LEFT JOIN pad p
  ON p.kid = CASE WHEN json_valid(t.doc) THEN coalesce(t.doc->>'$.kid', 'default') END""")
def join_cred_key(c: Context):
    said = credentials.claimed(c.tokens, ("kid", "sub"))
    doc_ok = F.get(F.split("token", "\\."), F.lit(1)).isNotNull() & F.get(F.split("token", "\\."), F.lit(2)).isNull()
    kid = F.when(doc_ok & F.col("claimed_sub").isNotNull(), F.coalesce("claimed_kid", F.lit("default")))
    known = c.keys.select("kid", F.lit(True).alias("known"))
    joined = lookup_join(said.withColumn("kid", kid), known, ["kid"], "left")
    return joined.select("request_id", F.coalesce("known", F.lit(False)).alias("known"))


@query("join_cred_grant", """SELECT v.request_id, v.grant_id, g.provider_org FROM ver v JOIN gov_grant g ON g.grant_id = v.grant_id
  AND g.approved_at <= v.event_ts AND g.expires_at > v.event_ts AND (g.revoked_at IS NULL OR g.revoked_at > v.event_ts)""")
def join_cred_grant(c: Context):
    from wardline.functions.scalars import grant_live

    g = c.grants.select("grant_id", "provider_org", "approved_at", "revoked_at", "expires_at")
    joined = lookup_join(c.verified, g, ["grant_id"])
    return joined.filter(grant_live("approved_at", "revoked_at", "expires_at", F.col("event_ts"))).select(
        "request_id", "grant_id", "provider_org"
    )


@query("join_cred_delegation", """SELECT v.request_id, d.delegation_id FROM ver v JOIN gov_delegation d
  ON d.delegation_id = v.delegation_id AND d.grant_id = v.grant_id AND d.delegatee = v.sub""")
def join_cred_delegation(c: Context):
    d = c.delegations.select("delegation_id", "grant_id", F.col("delegatee").alias("sub"))
    joined = lookup_join(c.verified, d, ["delegation_id", "grant_id", "sub"])
    return joined.select("request_id", "delegation_id")


@query("join_viewer", "SELECT viewer_org, count(*) AS n FROM viewer GROUP BY viewer_org")
def join_viewer(c: Context):
    return c.viewers.groupBy("viewer_org").agg(F.count(F.lit(1)).alias("n"))


# --- authorisation ---------------------------------------------------------
_AUTH_SQL = f"""SELECT q.request_id, q.subject, q.grantee_principal AS acting_for, q.provider_org, q.grantee_org, q.grant_id,
  q.delegation_id, {ARR.format('q.regions')} AS regions, q.max_classification, q.allow_cost, q.allow_contact, q.chain_depth
  FROM req q WHERE q.allowed"""
AUTH_OUT = [
    "request_id", "subject", "acting_for", "provider_org", "grantee_org", "grant_id", "delegation_id",
    "max_classification", "allow_cost", "allow_contact", "chain_depth",
]


def _allowed(c: Context):
    return auth.judge(c.requests, c.resolved).filter("decision = 'allow'").select(*AUTH_OUT, regions().alias("regions"))


@query("current_auth", _AUTH_SQL)
def current_auth(c: Context):
    return _allowed(c)


@query("auth_direct", _AUTH_SQL + " AND q.delegation_id IS NULL")
def auth_direct(c: Context):
    return _allowed(c).filter("delegation_id IS NULL")


@query("auth_delegated", _AUTH_SQL + " AND q.delegation_id IS NOT NULL")
def auth_delegated(c: Context):
    return _allowed(c).filter("delegation_id IS NOT NULL")


@query("join_state_asof", f"""SELECT q.request_id, q.event_ts >= TIMESTAMP '2024-01-15' AS late_half, f.subject IS NOT NULL AS in_force
  FROM gov_request q LEFT JOIN fact f ON f.subject = q.subject AND f.grant_id = q.grant_id
  AND f.delegation_id IS NOT DISTINCT FROM q.delegation_id AND f.fits AND {live('q.event_ts')}""")
def join_state_asof(c: Context):
    judged = auth.judge(c.requests, c.resolved)
    return judged.select(
        "request_id", (F.col("event_ts") >= F.lit("2024-01-15").cast("timestamp")).alias("late_half"),
        (F.col("decision") == "allow").alias("in_force"),
    )


@query("deny_listing", "SELECT request_id, subject AS claimed_sub, 'no_live_authorization' AS deny_reason FROM req WHERE NOT allowed")
def deny_listing(c: Context):
    return auth.denied(c.requests, c.resolved).select("request_id", F.col("subject").alias("claimed_sub"), "deny_reason")


@query("auth_outcomes", """SELECT allowed, count(*) AS n FROM req GROUP BY allowed""")
def auth_outcomes(c: Context):
    outcome = auth.explain_outcomes(c.requests, c.grants, c.delegations, c.principals)
    return outcome.groupBy(F.col("outcome").startswith("allow").alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


@query("whoami", f"""SELECT auth_id, provider_org, grantee_org, {ARR.format('regions')} AS regions, max_classification, allow_cost,
  allow_contact, chain_depth FROM auths""")
def whoami(c: Context):
    return c.auths.select(
        "auth_id", "provider_org", "grantee_org", regions().alias("regions"), "max_classification", "allow_cost",
        "allow_contact", "chain_depth",
    )


@query("expected_access", "SELECT auth_id, shipment_id, allow_cost, allow_contact FROM vis")
def expected_access(c: Context):
    scopes = expected.expected_scopes(c.presented, c.grants, c.delegations, c.principals, AS_OF)
    return expected.expected_rows(c.shipments, scopes)


@query("chain_walk", """WITH RECURSIVE up AS (
  SELECT delegation_id AS leaf_id, 0 AS hop, delegation_id, parent_delegation FROM gov_delegation
  UNION ALL SELECT u.leaf_id, u.hop + 1, d.delegation_id, d.parent_delegation FROM up u JOIN gov_delegation d
    ON d.delegation_id = u.parent_delegation WHERE u.hop < 8)
SELECT leaf_id, hop, delegation_id FROM up""")
def chain_walk(c: Context):
    return auth.chain_walk(c.delegations)


@query("anti_disabled", f"""SELECT c.subject, c.grant_id, c.delegation_id FROM cred c JOIN gov_grant g ON g.grant_id = c.grant_id
  LEFT JOIN gov_delegation d ON d.delegation_id = c.delegation_id LEFT JOIN gov_delegation a ON a.delegation_id = d.parent_delegation
  LEFT JOIN gov_delegation b ON b.delegation_id = a.parent_delegation
  WHERE NOT EXISTS (SELECT 1 FROM gov_principal p WHERE p.disabled_at <= {T}
    AND p.principal_id IN (g.grantee_principal, d.delegatee, a.delegatee, b.delegatee))""".replace(T, "TIMESTAMP '2024-01-25 00:00:00'"))
def anti_disabled(c: Context):
    at = F.lit("2024-01-25").cast("timestamp")
    walk = auth.chain_walk(c.delegations).join(c.delegations.select("delegation_id", "delegatee"), "delegation_id")
    people = walk.select(F.col("leaf_id").alias("delegation_id"), F.col("delegatee").alias("principal_id"))
    held = c.presented.join(c.grants.select("grant_id", "grantee_principal"), "grant_id")
    holders = held.select(*auth.CREDENTIAL, F.col("grantee_principal").alias("principal_id"))
    chain = c.presented.join(people, "delegation_id").select(*auth.CREDENTIAL, "principal_id")
    off = c.principals.filter(F.col("disabled_at") <= at).select("principal_id")
    dead = lookup_join(holders.unionByName(chain), off, ["principal_id"], "left_semi").select(*auth.CREDENTIAL).distinct()
    return lookup_join(held.select(*auth.CREDENTIAL), dead, auth.CREDENTIAL, "left_anti", null_safe=["delegation_id"])


# --- governance changes ----------------------------------------------------
# Command batches, one row per customer; the same texts feed the oracle.
_CMD_APPROVE = """SELECT CAST(substr(principal_id, 3) AS BIGINT) AS cmd_id, concat('g-', CAST(CAST(substr(principal_id, 3) AS BIGINT) - CAST(substr(principal_id, 3) AS BIGINT) % 2 AS STRING)) AS grant_id,
  concat('p-', CAST(CAST(substr(principal_id, 3) AS BIGINT) + CAST(substr(principal_id, 3) AS BIGINT) % 8 AS STRING)) AS approver FROM {gov_principal}"""
_CMD_GRANT = """SELECT CAST(substr(principal_id, 3) AS BIGINT) AS cmd_id,
  concat('g-', CAST(CAST(substr(principal_id, 3) AS BIGINT) * 3 % 1000 AS STRING)) AS grant_id, owner_principal AS actor,
  concat('incident ', CAST(CAST(substr(principal_id, 3) AS BIGINT) % 7 AS STRING)) AS reason FROM {gov_principal} WHERE kind = 'agent'"""
_CMD_DELEG = """SELECT CAST(substr(principal_id, 3) AS BIGINT) AS cmd_id, concat('d-', substr(principal_id, 3)) AS delegation_id,
  owner_principal AS actor, concat('incident ', CAST(CAST(substr(principal_id, 3) AS BIGINT) % 7 AS STRING)) AS reason
  FROM {gov_principal} WHERE CAST(substr(principal_id, 3) AS BIGINT) % 5 = 0"""
_CMD_TOGGLE = """SELECT CAST(substr(principal_id, 3) AS BIGINT) AS cmd_id,
  concat('p-', CAST(CAST(substr(principal_id, 3) AS BIGINT) * 2 % 900 AS STRING)) AS principal_id, kind = 'human' AS enable FROM {gov_principal}"""
_PROPOSE = """SELECT concat('g-new-', substr(principal_id, 3)) AS grant_id, 'org-0' AS provider_org, org_id AS grantee_org,
  CASE WHEN CAST(substr(principal_id, 3) AS BIGINT) % 50 = 0 THEN 'p-nobody' ELSE principal_id END AS grantee_principal,
  split('EUROPE,ASIA', ',') AS region_scope, 'internal' AS max_classification, false AS allow_cost, false AS allow_contact,
  TIMESTAMP '2024-01-16 00:00:00' AS requested_at, TIMESTAMP '2024-01-16 00:00:00' AS approved_at, 'p-3' AS approved_by,
  TIMESTAMP '2024-02-15 00:00:00' AS expires_at, TIMESTAMP '2024-01-16 00:00:00' AS revoked_at, 'x' AS revoked_reason FROM {gov_principal}"""


def batch(c: Context, text: str):
    return c.spark.sql(text, gov_principal=c.principals)


def cmd(text: str) -> str:
    return "(" + text.format(gov_principal="gov_principal") + ")"


_GRANT_REASON = "CASE WHEN p.principal_id IS NULL THEN 'grantee_unknown' WHEN p.kind <> 'human' THEN 'grantee_not_human' END"


@query("grant_check", f"""SELECT g.grant_id, {_GRANT_REASON} AS reason FROM {cmd(_PROPOSE)} g
  LEFT JOIN gov_principal p ON p.principal_id = g.grantee_principal""")
def grant_check(c: Context):
    return governance.check_grants(batch(c, _PROPOSE), c.principals).select("grant_id", "reason")


@query("grant_request", f"""SELECT grant_id, provider_org, approved_by, approved_at IS NOT NULL AS approved FROM gov_grant
UNION ALL SELECT g.grant_id, g.provider_org, NULL, false FROM {cmd(_PROPOSE)} g
  LEFT JOIN gov_principal p ON p.principal_id = g.grantee_principal WHERE {_GRANT_REASON} IS NULL""")
def grant_request(c: Context):
    after = governance.request_grants(c.grants, batch(c, _PROPOSE), c.principals)
    return after.select("grant_id", "provider_org", "approved_by", F.col("approved_at").isNotNull().alias("approved"))


_APPROVAL = f"""SELECT k.cmd_id, k.grant_id, k.approver, g.provider_org, g.grantee_org, CASE WHEN g.grant_id IS NULL THEN 'grant_unknown'
    WHEN p.kind IS DISTINCT FROM 'human' THEN 'approver_not_human' WHEN p.org_id IS DISTINCT FROM g.provider_org THEN 'approver_other_org' END AS reason
  FROM {cmd(_CMD_APPROVE)} k LEFT JOIN gov_grant g ON g.grant_id = k.grant_id LEFT JOIN gov_principal p ON p.principal_id = k.approver"""


@query("grant_approve", f"""WITH a AS ({_APPROVAL}), last AS (SELECT grant_id, arg_max(approver, cmd_id) AS by_whom FROM a WHERE reason IS NULL GROUP BY grant_id)
SELECT g.grant_id, CASE WHEN l.grant_id IS NOT NULL THEN {T} ELSE g.approved_at END IS NOT NULL AS approved,
  coalesce(l.by_whom, g.approved_by) AS approved_by FROM gov_grant g LEFT JOIN last l ON l.grant_id = g.grant_id""")
def grant_approve(c: Context):
    after = governance.approve(batch(c, _CMD_APPROVE), c.grants, c.principals, c.as_of)
    return after.select("grant_id", F.col("approved_at").isNotNull().alias("approved"), "approved_by")


@query("grant_approve_reason", f"WITH a AS ({_APPROVAL}) SELECT cmd_id, reason FROM a")
def grant_approve_reason(c: Context):
    return governance.check_approvals(batch(c, _CMD_APPROVE), c.grants, c.principals).select("cmd_id", "reason")


def _revoked_sql(key: str, table: str, commands: str) -> str:
    return f"""WITH k AS (SELECT {key}, arg_min(reason, cmd_id) AS reason FROM {cmd(commands)} GROUP BY {key})
SELECT t.{key}, strftime(CASE WHEN k.{key} IS NOT NULL AND t.revoked_at IS NULL THEN {T} ELSE t.revoked_at END, '%Y-%m-%d') AS revoked_on,
  CASE WHEN k.{key} IS NOT NULL AND t.revoked_at IS NULL THEN k.reason ELSE t.revoked_reason END AS revoked_reason
FROM {table} t LEFT JOIN k ON k.{key} = t.{key}"""


@query("grant_revoke", _revoked_sql("grant_id", "gov_grant", _CMD_GRANT))
def grant_revoke(c: Context):
    after = governance.revoke_grants(batch(c, _CMD_GRANT), c.grants, c.as_of)
    return after.select("grant_id", F.date_format("revoked_at", "yyyy-MM-dd").alias("revoked_on"), "revoked_reason")


@query("grant_revoke_events", f"""SELECT k.cmd_id, k.actor AS subject, k.grant_id, g.provider_org,
  CAST(json_object('grant_id', k.grant_id, 'reason', k.reason) AS VARCHAR) AS request
  FROM {cmd(_CMD_GRANT)} k JOIN gov_grant g ON g.grant_id = k.grant_id""")
def grant_revoke_events(c: Context):
    return governance.change_events(batch(c, _CMD_GRANT), c.grants, "grant.revoke").select(
        "cmd_id", "subject", "grant_id", "provider_org", "request"
    )


@query("delegation_revoke", _revoked_sql("delegation_id", "gov_delegation", _CMD_DELEG))
def delegation_revoke(c: Context):
    after = governance.revoke_delegations(batch(c, _CMD_DELEG), c.delegations, c.as_of)
    return after.select("delegation_id", F.date_format("revoked_at", "yyyy-MM-dd").alias("revoked_on"), "revoked_reason")


@query("delegation_revoke_events", f"""SELECT k.cmd_id, k.actor AS subject, d.delegator AS acting_for, d.grant_id, g.grantee_org
  FROM {cmd(_CMD_DELEG)} k JOIN gov_delegation d ON d.delegation_id = k.delegation_id JOIN gov_grant g ON g.grant_id = d.grant_id""")
def delegation_revoke_events(c: Context):
    events = governance.change_events(batch(c, _CMD_DELEG), c.grants, "delegation.revoke", c.delegations)
    return events.select("cmd_id", "subject", "acting_for", "grant_id", "grantee_org")


_SUBSET = "len(list_filter({0}, lambda r: NOT list_contains({1}, r))) = 0"
_RULES = f"""CASE WHEN g.grant_id IS NULL THEN 'grant_unknown' WHEN k.principal_id IS NULL THEN 'delegatee_unknown'
  WHEN k.kind <> 'agent' THEN 'delegatee_not_agent'
  WHEN d.depth = 1 AND d.delegator <> g.grantee_principal THEN 'delegator_not_grantee'
  WHEN d.depth = 1 AND d.parent_delegation IS NOT NULL THEN 'first_hop_with_parent'
  WHEN d.depth > 1 AND d.parent_delegation IS NULL THEN 'parent_required'
  WHEN d.depth > 1 AND p.delegation_id IS NULL THEN 'parent_unknown'
  WHEN d.depth > 1 AND p.delegatee <> d.delegator THEN 'delegator_not_parent_holder'
  WHEN d.depth > 1 AND p.depth <> d.depth - 1 THEN 'depth_step'
  WHEN d.depth > 1 AND p.grant_id <> d.grant_id THEN 'parent_other_grant'
  WHEN d.depth > 1 AND NOT ({_SUBSET.format('d.region_scope', 'p.region_scope')}) THEN 'regions_exceed_parent'
  WHEN d.depth > 1 AND ((d.allow_cost AND NOT p.allow_cost) OR (d.allow_contact AND NOT p.allow_contact)) THEN 'columns_exceed_parent'
  WHEN d.depth > 1 AND d.expires_at > p.expires_at THEN 'outlives_parent'
  WHEN NOT ({_SUBSET.format('d.region_scope', 'g.region_scope')}) THEN 'regions_exceed_grant'
  WHEN (d.allow_cost AND NOT g.allow_cost) OR (d.allow_contact AND NOT g.allow_contact) THEN 'columns_exceed_grant'
  WHEN d.expires_at > g.expires_at THEN 'outlives_grant' END"""
_CONTEXT = """FROM gov_delegation d LEFT JOIN gov_grant g ON g.grant_id = d.grant_id
  LEFT JOIN gov_principal k ON k.principal_id = d.delegatee"""


@query("delegation_check", f"SELECT d.delegation_id, {_RULES} AS reason {_CONTEXT} LEFT JOIN gov_delegation p ON p.delegation_id = d.parent_delegation")
def delegation_check(c: Context):
    return governance.check_delegations(c.delegations, c.grants, c.delegations, c.principals).select("delegation_id", "reason")


@query("delegation_create", f"""WITH a1 AS (SELECT d.*, {_RULES} AS reason {_CONTEXT}
    LEFT JOIN (SELECT * FROM gov_delegation LIMIT 0) p ON p.delegation_id = d.parent_delegation WHERE d.depth = 1),
  a2 AS (SELECT d.*, {_RULES} AS reason {_CONTEXT} LEFT JOIN (SELECT * FROM a1 WHERE reason IS NULL) p
    ON p.delegation_id = d.parent_delegation WHERE d.depth = 2),
  a3 AS (SELECT d.*, {_RULES} AS reason {_CONTEXT} LEFT JOIN (SELECT * FROM a1 WHERE reason IS NULL UNION ALL
    SELECT * FROM a2 WHERE reason IS NULL) p ON p.delegation_id = d.parent_delegation WHERE d.depth = 3)
SELECT delegation_id, reason FROM a1 UNION ALL SELECT delegation_id, reason FROM a2 UNION ALL SELECT delegation_id, reason FROM a3""")
def delegation_create(c: Context):
    return governance.create_delegations(c.delegations, c.grants, None, c.principals).select("delegation_id", "reason")


@query("join_rule_context", f"""SELECT d.delegation_id, g.grantee_principal AS holder, p.delegatee AS parent_holder, k.kind AS delegatee_kind
  {_CONTEXT} LEFT JOIN gov_delegation p ON p.delegation_id = d.parent_delegation""")
def join_rule_context(c: Context):
    ctx = governance.rule_context(c.delegations, c.grants, c.delegations, c.principals)
    return ctx.select("delegation_id", F.col("g_holder").alias("holder"), F.col("p_holder").alias("parent_holder"), "delegatee_kind")


_CMD_KILL = """SELECT CAST(substr(principal_id, 3) AS BIGINT) AS cmd_id,
  CASE CAST(substr(principal_id, 3) AS BIGINT) % 3 WHEN 0 THEN 'grant' WHEN 1 THEN 'delegation' ELSE 'principal' END AS kind,
  concat(CASE CAST(substr(principal_id, 3) AS BIGINT) % 3 WHEN 0 THEN 'g-' WHEN 1 THEN 'd-' ELSE 'p-' END, substr(principal_id, 3)) AS target
  FROM {gov_principal}"""


# Every delegation presented by its own delegatee, judged by the rules of `fact` and their times; then who is in its chain.
_ALL_FACTS = CTES["fact"].replace(
    "FROM cred c", "FROM (SELECT delegatee AS subject, grant_id, delegation_id FROM gov_delegation) c").rstrip().removesuffix(")")


@query("revoke_cascade", f"""WITH every_fact AS ({_ALL_FACTS}),
l AS (SELECT f.delegation_id, f.grant_id, f.grantee_principal, f.chain,
    (SELECT list(d.delegatee) FROM gov_delegation d WHERE list_contains(f.chain, d.delegation_id)) AS people
  FROM every_fact f WHERE f.fits AND {live(T)})
SELECT DISTINCT k.cmd_id, l.delegation_id FROM l JOIN {cmd(_CMD_KILL)} k ON (k.kind = 'grant' AND k.target = l.grant_id)
  OR (k.kind = 'delegation' AND list_contains(l.chain, k.target))
  OR (k.kind = 'principal' AND (k.target = l.grantee_principal OR list_contains(l.people, k.target)))""")
def revoke_cascade(c: Context):
    return governance.cascade(batch(c, _CMD_KILL), c.grants, c.delegations, c.principals, c.as_of)


@query("principal_toggle", f"""WITH k AS (SELECT principal_id, arg_max(enable, cmd_id) AS enable FROM {cmd(_CMD_TOGGLE)} GROUP BY principal_id)
SELECT p.principal_id, strftime(CASE WHEN k.enable THEN NULL WHEN NOT k.enable THEN {T} ELSE p.disabled_at END, '%Y-%m-%d') AS disabled_on
FROM gov_principal p LEFT JOIN k ON k.principal_id = p.principal_id""")
def principal_toggle(c: Context):
    after = governance.toggle(batch(c, _CMD_TOGGLE), c.principals, c.as_of)
    return after.select("principal_id", F.date_format("disabled_at", "yyyy-MM-dd").alias("disabled_on"))


@query("grant_list", f"""SELECT grant_id, provider_org, grantee_org, grantee_principal, array_to_string(region_scope, ',') AS regions,
  max_classification, allow_cost, allow_contact, approved_by, strftime(expires_at, '%Y-%m-%d') AS expires,
  coalesce(approved_at <= {T}, false) AND coalesce(revoked_at > {T}, true) AND expires_at > {T} AS live FROM gov_grant""")
def grant_list(c: Context):
    return governance.list_grants(c.grants, c.as_of)


@query("delegation_list", """SELECT delegation_id, grant_id, delegator, delegatee, depth, parent_delegation,
  array_to_string(region_scope, ',') AS regions, allow_cost, substr(purpose, 1, 28) AS purpose,
  strftime(expires_at, '%m-%d %H:%M') AS expires, revoked_at IS NOT NULL AS revoked FROM gov_delegation""")
def delegation_list(c: Context):
    return governance.list_delegations(c.delegations)


@query("sort_listing", """SELECT grant_id, depth, delegation_id FROM gov_delegation""")
def sort_listing(c: Context):
    return governance.list_delegations(c.delegations).select("grant_id", "depth", "delegation_id")


@query("broad_review", f"""WITH g AS (SELECT * FROM gov_grant WHERE coalesce(approved_at <= {T}, false) AND coalesce(revoked_at > {T}, true) AND expires_at > {T})
SELECT 'contact_on' AS finding, grant_id AS item FROM g WHERE allow_contact
UNION ALL SELECT 'expiry_far_out', delegation_id FROM gov_delegation WHERE expires_at > {T} + INTERVAL 30 DAY AND coalesce(revoked_at > {T}, true)
UNION ALL SELECT 'grantee_elsewhere', grant_id FROM g LEFT JOIN gov_principal p ON p.principal_id = g.grantee_principal
  WHERE p.org_id IS DISTINCT FROM g.grantee_org""")
def broad_review(c: Context):
    return governance.review(c.grants, c.delegations, c.principals, c.as_of, 30)
