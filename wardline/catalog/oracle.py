"""SQL the queries are checked against: CTEs that restate the rules independently of the Spark code.

Here a request is judged by testing every rule at its own time in a WHERE clause, and the row policy is the plain
four-clause predicate; the Spark side uses live intervals and policy cells.
"""

from __future__ import annotations

import re

from wardline.sources.derived import PRESENTED, oracle_ctes

AS_OF = "2024-01-16 00:00:00"

_RANK = "CASE {c} WHEN 'public' THEN 1 WHEN 'internal' THEN 2 WHEN 'restricted' THEN 3 END"


def rank(column: str) -> str:
    return _RANK.format(c=column)


def live(t: str, alias: str = "f") -> str:
    """Every time rule of a resolved credential at `t`."""
    a = alias
    ends = ["g_exp", "g_rev", "g_dis", "e0", "r0", "x0", "e1", "r1", "x1", "e2", "r2", "x2"]
    return f"({a}.approved_at <= {t} AND " + " AND ".join(f"coalesce({a}.{e} > {t}, true)" for e in ends) + ")"


FACTS = """
cred AS (SELECT DISTINCT subject, grant_id, delegation_id FROM gov_request),
hop AS (SELECT d.*, p.disabled_at FROM gov_delegation d LEFT JOIN gov_principal p ON p.principal_id = d.delegatee),
fact AS (
  SELECT c.subject, c.grant_id, c.delegation_id, g.provider_org, g.grantee_org, g.grantee_principal,
    g.max_classification, g.approved_at, g.expires_at AS g_exp, g.revoked_at AS g_rev, gp.disabled_at AS g_dis,
    d.expires_at AS e0, d.revoked_at AS r0, d.disabled_at AS x0, a.expires_at AS e1, a.revoked_at AS r1,
    a.disabled_at AS x1, b.expires_at AS e2, b.revoked_at AS r2, b.disabled_at AS x2,
    CASE WHEN c.delegation_id IS NULL THEN 0 ELSE d.depth END AS chain_depth,
    [x FOR x IN [d.delegation_id, a.delegation_id, b.delegation_id] IF x IS NOT NULL] AS chain,
    list_filter(g.region_scope, lambda r: (d.delegation_id IS NULL OR list_contains(d.region_scope, r))
      AND (a.delegation_id IS NULL OR list_contains(a.region_scope, r))
      AND (b.delegation_id IS NULL OR list_contains(b.region_scope, r))) AS regions,
    g.allow_cost AND coalesce(d.allow_cost, true) AND coalesce(a.allow_cost, true) AND coalesce(b.allow_cost, true) AS allow_cost,
    g.allow_contact AND coalesce(d.allow_contact, true) AND coalesce(a.allow_contact, true) AND coalesce(b.allow_contact, true) AS allow_contact,
    coalesce(CASE WHEN c.delegation_id IS NULL THEN c.subject = g.grantee_principal
      ELSE d.grant_id = c.grant_id AND d.delegatee = c.subject
        AND (d.parent_delegation IS NULL OR a.delegation_id IS NOT NULL)
        AND (a.parent_delegation IS NULL OR b.delegation_id IS NOT NULL) AND b.parent_delegation IS NULL
        AND coalesce(a.grant_id = c.grant_id, true) AND coalesce(b.grant_id = c.grant_id, true)
        AND coalesce(b.delegator, a.delegator, d.delegator) = g.grantee_principal
        AND coalesce(b.depth, a.depth, d.depth) = 1 END, false) AS fits
  FROM cred c JOIN gov_grant g ON g.grant_id = c.grant_id
  LEFT JOIN gov_principal gp ON gp.principal_id = g.grantee_principal
  LEFT JOIN hop d ON d.delegation_id = c.delegation_id
  LEFT JOIN hop a ON a.delegation_id = d.parent_delegation
  LEFT JOIN hop b ON b.delegation_id = a.parent_delegation
),
auths AS (
  SELECT f.*, concat_ws('/', f.subject, f.grant_id, coalesce(f.delegation_id, 'direct')) AS auth_id
  FROM fact f WHERE f.fits AND @LIVE_AS_OF@
),
vis AS (
  SELECT a.auth_id, a.allow_cost, a.allow_contact, a.grantee_org, s.* FROM gov_shipment s JOIN auths a
    ON s.owner_org = a.provider_org AND list_contains(a.regions, s.region) AND @RANK_ROW@ <= @RANK_MAX@
    AND (s.partner_org IS NULL OR s.partner_org = a.grantee_org)
),
guarded AS (
  SELECT auth_id, shipment_id, owner_org, region, classification, partner_org, carrier, status, units, updated_at,
    CASE WHEN allow_cost THEN unit_cost_usd END AS unit_cost_usd, CASE WHEN allow_cost THEN margin_pct END AS margin_pct,
    CASE WHEN allow_contact THEN contact_email END AS contact_email,
    CASE WHEN allow_contact THEN contact_phone END AS contact_phone
  FROM vis
),
req AS (
  SELECT r.*, f.provider_org, f.grantee_org, f.grantee_principal, f.regions, f.max_classification, f.allow_cost,
    f.allow_contact, f.chain_depth, f.chain, f.fits IS NOT NULL AS allowed
  FROM gov_request r LEFT JOIN fact f ON f.subject = r.subject AND f.grant_id = r.grant_id
    AND f.delegation_id IS NOT DISTINCT FROM r.delegation_id AND f.fits AND @LIVE_EVENT@
),
rd AS (
  SELECT q.*, CAST(q.request->>'$.k' AS BIGINT) AS k, list_contains(q.columns, 'secret_notes') AS unknown_cols,
    q.allowed AND NOT list_contains(q.columns, 'secret_notes') AS ok
  FROM req q
),
rd_rows AS (
  SELECT q.request_id, s.shipment_id FROM rd q JOIN gov_shipment s ON q.ok AND s.units = q.k
    AND s.owner_org = q.provider_org AND list_contains(q.regions, s.region)
    AND @RANK_ROW@ <= @RANK_Q@ AND (s.partner_org IS NULL OR s.partner_org = q.grantee_org)
),
@MERKLE rd@ev AS (
  SELECT q.request_id AS seq, q.event_ts, CASE WHEN q.ok THEN q.subject END AS subject,
    CASE WHEN q.ok THEN q.grantee_principal END AS acting_for, q.grant_id, q.delegation_id,
    CASE WHEN q.ok THEN q.provider_org END AS provider_org, CASE WHEN q.ok THEN q.grantee_org END AS grantee_org,
    CASE WHEN q.ok THEN 'allow' ELSE 'deny' END AS decision,
    CASE WHEN q.unknown_cols THEN 'unknown columns: ["secret_notes"]' WHEN NOT q.ok THEN 'no_live_authorization' END AS deny_reason,
    coalesce(h.n, 0) AS row_count,
    CASE WHEN q.ok THEN coalesce(h.root, '@EMPTY@') END AS row_digest,
    q.subject AS presented, q.columns, q.allow_cost, q.allow_contact, q.ok, q.k, to_json(coalesce(q.chain, [])) AS chain
  FROM rd q LEFT JOIN rd_head h USING (request_id)
),
pad AS (
  SELECT kid, unhex(list_aggregate(list_transform(range(0, 64), lambda i: printf('%02x', xor(CAST(concat('0x', substr(rpad(secret_hex, 128, '0'), 2*i+1, 2)) AS INT), 54))), 'string_agg', '')) AS ipad,
    unhex(list_aggregate(list_transform(range(0, 64), lambda i: printf('%02x', xor(CAST(concat('0x', substr(rpad(secret_hex, 128, '0'), 2*i+1, 2)) AS INT), 92))), 'string_agg', '')) AS opad
  FROM gov_key
),
tok AS (
  SELECT request_id, event_ts, @PRESENTED@ AS token FROM (
    SELECT request_id, event_ts, concat(body, '.', @SIGN@) AS token FROM (
      SELECT c.*, p.ipad, p.opad, base64(encode(CAST(to_json({sub: c.sub, act_as: c.act_as, grant_id: c.grant_id,
        delegation_id: c.delegation_id, exp: c.exp, jti: c.jti, chain: c.chain, kid: c.kid}) AS VARCHAR))) AS body
      FROM gov_claim c JOIN pad p ON p.kid = c.sign_kid))
),
tok_doc AS (
  SELECT *, CASE WHEN len(parts) = 2 THEN TRY(decode(from_base64(parts[1]))) END AS doc
  FROM (SELECT *, string_split(token, '.') AS parts FROM tok)
),
tok_stage AS (
  SELECT t.request_id, t.event_ts, t.doc, CASE WHEN t.token IS NULL OR t.token = '' THEN 'absent'
      WHEN len(t.parts) <> 2 THEN 'not_two_parts' WHEN t.doc IS NULL THEN 'bad_base64' WHEN NOT json_valid(t.doc) THEN 'bad_json'
      WHEN p.ipad IS NULL THEN 'unknown_key' WHEN @VERIFY@ <> t.parts[2] THEN 'bad_signature'
      WHEN try_cast(t.doc->>'$.exp' AS DOUBLE) IS NULL THEN 'no_expiry'
      WHEN try_cast(t.doc->>'$.exp' AS DOUBLE) <= epoch(t.event_ts) THEN 'expired' END AS stage
  FROM tok_doc t LEFT JOIN pad p ON p.kid = CASE WHEN json_valid(t.doc) THEN coalesce(t.doc->>'$.kid', 'default') END
),
ver AS (
  SELECT request_id, event_ts, stage IS NULL AS verified, CASE WHEN stage IS NULL THEN doc->>'$.sub' END AS sub,
    CASE WHEN stage IS NULL THEN doc->>'$.grant_id' END AS grant_id,
    CASE WHEN stage IS NULL THEN doc->>'$.delegation_id' END AS delegation_id FROM tok_stage
),
viewer AS (
  SELECT a.sub, a.audit_org AS viewer_org FROM gov_audit_claim a JOIN gov_principal p ON p.principal_id = a.sub
    AND p.org_id = a.audit_org AND p.kind = 'human' AND (p.disabled_at IS NULL OR p.disabled_at > @AS_OF@)
),
suspect AS (
  SELECT * REPLACE (CASE WHEN seq % 7 = 5 THEN concat('g-', CAST(CAST(substr(grant_id, 3) AS BIGINT) + 3 AS VARCHAR)) ELSE grant_id END AS grant_id)
  FROM ev
)
"""


def hmac_sql(message: str, ipad: str = "ipad", opad: str = "opad") -> str:
    return f"sha256({opad} || unhex(sha256({ipad} || encode({message}))))"


def merkle_ctes(of: str) -> str:
    """`{of}_head` (request_id, n, root) of `{of}_rows` (request_id, shipment_id): chunks of 4096 ids, nodes of 256, four levels."""
    levels = "".join(f"""{of}_n{k} AS (
  SELECT request_id, {'0' if k == 4 else 'below // 256'} AS node, CAST(sum(n) AS BIGINT) AS n,
    sha256(string_agg(concat(below, ':', hash), ',' ORDER BY below)) AS hash
  FROM (SELECT request_id, node AS below, n, hash FROM {of}_n{k - 1}) GROUP BY request_id, {'' if k == 4 else 'below // 256'}
),
""".replace("request_id, \n)", "request_id\n)") for k in range(1, 5))
    return f"""{of}_n0 AS (
  SELECT request_id, shipment_id // 4096 AS node, count(*) AS n,
    sha256(concat(shipment_id // 4096, ':', string_agg(CAST(shipment_id AS VARCHAR), ',' ORDER BY shipment_id))) AS hash
  FROM {of}_rows GROUP BY request_id, shipment_id // 4096
),
{levels}{of}_head AS (
  SELECT request_id, n, hash AS root FROM {of}_n4
),
"""


EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing

FACTS = (
    FACTS.replace("@MERKLE rd@", merkle_ctes("rd")).replace("@EMPTY@", EMPTY).replace("@LIVE_AS_OF@", live(f"TIMESTAMP '{AS_OF}'"))
    .replace("@LIVE_EVENT@", live("r.event_ts"))
    .replace("@RANK_ROW@", rank("s.classification"))
    .replace("@RANK_MAX@", rank("a.max_classification"))
    .replace("@RANK_Q@", rank("q.max_classification"))
    .replace("@PRESENTED@", PRESENTED.strip())
    .replace("@SIGN@", hmac_sql("body"))
    .replace("@VERIFY@", hmac_sql("t.parts[1]", "p.ipad", "p.opad"))
    .replace("@AS_OF@", f"TIMESTAMP '{AS_OF}'")
)


def _split_ctes(text: str) -> dict[str, str]:
    """Name → text of each CTE of a comma-separated list whose entries start at the beginning of a line."""
    found = re.split(r"(?m)^(\w+) AS \(", text.strip())
    return {n: b.rstrip().rstrip(",").rstrip() for n, b in zip(found[1::2], found[2::2], strict=True)}


CTES = {**_split_ctes(oracle_ctes()), **_split_ctes(FACTS)}


def with_prelude(sql: str) -> str:
    """Put in front of `sql` the CTEs it uses, directly or through others, in their order."""
    need: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(CTES[name])
    own = sql.strip()
    lead = ",\n".join(f"{n} AS ({CTES[n]}" for n in CTES if n in need)
    if not lead:
        return own
    if own.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {lead},\n{own[len('WITH RECURSIVE'):]}"
    if own.upper().startswith("WITH"):
        return f"WITH {lead},\n{own[4:]}"
    return f"WITH {lead}\n{own}"
