"""Sources, data quality, and the guarded relation with the caller's filters over it."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.oracle import rank
from wardline.catalog.registry import Context, query
from wardline.functions.crypto import key_pads
from wardline.operators import guard, quality, query as asks
from wardline.plans.placement import lookup_join
from wardline.schemas import ALL_COLUMNS, BASE_COLUMNS
from wardline.session import scratch
from wardline.sources import sinks, tables

DOUBLE = {"unit_cost_usd": "double", "margin_pct": "double"}


def as_double(df, columns=("unit_cost_usd", "margin_pct")):
    """Decimals as doubles, so both engines print them alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns if c in df.columns})


SQL_GUARDED = """SELECT auth_id, shipment_id, owner_org, region, classification, partner_org, carrier, status, units,
  updated_at, CAST(unit_cost_usd AS DOUBLE) AS unit_cost_usd, CAST(margin_pct AS DOUBLE) AS margin_pct, contact_email,
  contact_phone FROM guarded"""


# --- sources ---------------------------------------------------------------
@query("src_tables", """
SELECT 'org' AS table_name, count(*) AS n_rows FROM gov_org UNION ALL SELECT 'principal', count(*) FROM gov_principal
UNION ALL SELECT 'shipment', count(*) FROM gov_shipment UNION ALL SELECT 'data_grant', count(*) FROM gov_grant
UNION ALL SELECT 'delegation', count(*) FROM gov_delegation UNION ALL SELECT 'request', count(*) FROM gov_request""")
def src_tables(c: Context):
    return tables.table_counts({
        "org": c.orgs, "principal": c.principals, "shipment": c.shipments, "data_grant": c.grants,
        "delegation": c.delegations, "request": c.requests,
    })


@query("src_keys", "SELECT kid, lower(hex(ipad)) AS ipad, lower(hex(opad)) AS opad FROM pad")
def src_keys(c: Context):
    return key_pads(c.keys).select("kid", F.lower(F.hex("ipad")).alias("ipad"), F.lower(F.hex("opad")).alias("opad"))


@query("src_audit_json", """
SELECT seq, CASE WHEN NOT ok THEN presented END AS claimed_sub, CASE WHEN ok THEN k END AS k FROM ev""")
def src_audit_json(c: Context):
    back = tables.request_fields(c.events, {"claimed_sub": "claimed_sub", "k": "k"})
    return back.select("seq", "claimed_sub", F.col("k").cast("long").alias("k"))


@query("sink_audit", "SELECT CAST(event_ts AS DATE)::VARCHAR AS event_date, decision, count(*) AS n FROM ev GROUP BY ALL")
def sink_audit(c: Context):
    path = scratch(c.spark, "audit")
    sinks.append_audit(c.events, path)
    stored = c.spark.read.parquet(path)
    return stored.groupBy(F.col("event_date").cast("string").alias("event_date"), "decision").agg(F.count(F.lit(1)).alias("n"))


@query("sink_report", "SELECT decision, count(*) AS n FROM ev GROUP BY ALL")
def sink_report(c: Context):
    path = scratch(c.spark, "report")
    sinks.write_report(c.events.groupBy("decision").agg(F.count(F.lit(1)).alias("n")), path)
    return c.spark.read.schema("decision string, n long").json(path)


@query("sink_trail_csv", """
SELECT seq, decision, coalesce(deny_reason, '') AS deny_reason, row_count FROM ev""")
def sink_trail_csv(c: Context):
    path = scratch(c.spark, "trail")
    sinks.export_trail(c.events, path)
    stored = c.spark.read.option("header", True).option("escape", '"').csv(path)
    return stored.select(
        F.col("seq").cast("long").alias("seq"), "decision", F.coalesce("deny_reason", F.lit("")).alias("deny_reason"),
        F.col("row_count").cast("long").alias("row_count"),
    )


# --- data quality ----------------------------------------------------------
# Keys, each checked over its table with some rows put in twice.
_KEYS = [
    ("orders", "o_orderkey"), ("gov_principal", "principal_id"), ("gov_shipment", "shipment_id"), ("gov_grant", "grant_id"),
    ("gov_delegation", "delegation_id"), ("gov_request", "request_id"), ("gov_key", "kid"),
]
_TWICE, _LOST = "%77", "%7"


def _tables(c: Context):
    return {
        "orders": c.base["orders"], "gov_principal": c.principals, "gov_shipment": c.shipments, "gov_grant": c.grants,
        "gov_delegation": c.delegations, "gov_request": c.requests, "gov_key": c.keys,
        "org": c.principals.select("org_id").distinct(),
    }


@query("dq_unique", " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, CAST({k} AS VARCHAR) AS key, count(*) AS n
  FROM (SELECT {k} FROM {t} UNION ALL SELECT {k} FROM {t} WHERE CAST({k} AS VARCHAR) LIKE '{_TWICE}') GROUP BY {k} HAVING count(*) > 1"""
    for t, k in _KEYS))
def dq_unique(c: Context):
    tables, out = _tables(c), None
    for name, key in _KEYS:
        rows = tables[name].select(key)
        planted = rows.unionByName(rows.filter(F.col(key).cast("string").like(_TWICE)))
        one = quality.dup_keys(planted, key).select(F.lit(name).alias("table_name"), F.col("key").cast("string").alias("key"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# References, each checked against its parent table with some rows taken out.
_REFERENCES = [
    ("gov_principal", "org_id", "org", "org_id", "principal_id"), ("gov_principal", "owner_principal", "gov_principal", "principal_id", "principal_id"),
    ("gov_shipment", "owner_org", "org", "org_id", "shipment_id"), ("gov_shipment", "partner_org", "org", "org_id", "shipment_id"),
    ("gov_grant", "provider_org", "org", "org_id", "grant_id"), ("gov_grant", "grantee_org", "org", "org_id", "grant_id"),
    ("gov_grant", "grantee_principal", "gov_principal", "principal_id", "grant_id"), ("gov_grant", "approved_by", "gov_principal", "principal_id", "grant_id"),
    ("gov_delegation", "grant_id", "gov_grant", "grant_id", "delegation_id"), ("gov_delegation", "delegator", "gov_principal", "principal_id", "delegation_id"),
    ("gov_delegation", "delegatee", "gov_principal", "principal_id", "delegation_id"),
    ("gov_delegation", "parent_delegation", "gov_delegation", "delegation_id", "delegation_id"),
    ("gov_request", "grant_id", "gov_grant", "grant_id", "request_id"), ("gov_request", "delegation_id", "gov_delegation", "delegation_id", "request_id"),
    ("gov_request", "subject", "gov_principal", "principal_id", "request_id"),
]


def _parent(table: str, pk: str) -> str:
    source = "gov_principal" if table == "org" else table
    return f"(SELECT DISTINCT {pk} AS pk FROM {source} WHERE {pk} NOT LIKE '{'%3' if table == 'org' else _LOST}')"


@query("dq_references", " UNION ALL ".join(
    f"""SELECT '{t}.{fk}' AS reference, CAST({item} AS VARCHAR) AS item FROM {t} WHERE {fk} IS NOT NULL AND {fk} NOT IN {_parent(parent, pk)}"""
    for t, fk, parent, pk, item in _REFERENCES))
def dq_references(c: Context):
    tables, out = _tables(c), None
    for child, fk, parent, pk, item in _REFERENCES:
        left = tables[parent].filter(~F.col(pk).like("%3" if parent == "org" else _LOST))
        one = quality.orphans(tables[child], fk, left, pk).select(
            F.lit(f"{child}.{fk}").alias("reference"), F.col(item).cast("string").alias("item"))
        out = one if out is None else out.unionByName(one)
    return out


@query("dq_domains", """
SELECT 'kind' AS rule, count(*) FILTER (WHERE NOT coalesce(kind IN ('human', 'agent'), true)) AS violations FROM gov_principal
UNION ALL SELECT 'agent_has_owner', count(*) FILTER (WHERE kind = 'agent' AND owner_principal IS NULL) FROM gov_principal
UNION ALL SELECT 'depth', count(*) FILTER (WHERE NOT depth BETWEEN 1 AND 3) FROM gov_delegation
UNION ALL SELECT 'first_hop_has_no_parent', count(*) FILTER (WHERE depth = 1 AND parent_delegation IS NOT NULL) FROM gov_delegation
UNION ALL SELECT 'classification', count(*) FILTER (WHERE NOT coalesce(classification IN ('public', 'internal', 'restricted'), true)) FROM gov_shipment
UNION ALL SELECT 'partner_present', count(*) FILTER (WHERE partner_org IS NULL) FROM gov_shipment
UNION ALL SELECT 'owner_present', count(*) FILTER (WHERE owner_org IS NULL) FROM gov_shipment
UNION ALL SELECT 'ceiling', count(*) FILTER (WHERE NOT coalesce(max_classification IN ('public', 'internal', 'restricted'), true)) FROM gov_grant
UNION ALL SELECT 'low_ceiling', count(*) FILTER (WHERE max_classification = 'public') FROM gov_grant
UNION ALL SELECT 'approved', count(*) FILTER (WHERE approved_at IS NULL) FROM gov_grant
UNION ALL SELECT 'decision', count(*) FILTER (WHERE NOT coalesce(decision IN ('allow', 'deny'), true)) FROM ev
UNION ALL SELECT 'refusal_has_reason', count(*) FILTER (WHERE decision = 'deny' AND deny_reason IS NULL) FROM ev
UNION ALL SELECT 'reader_known', count(*) FILTER (WHERE subject IS NULL) FROM ev""")
def dq_domains(c: Context):
    principal = quality.domain_violations(c.principals, {
        "kind": F.col("kind").isin("human", "agent"),
        "agent_has_owner": (F.col("kind") != "agent") | F.col("owner_principal").isNotNull(),
    })
    delegation = quality.domain_violations(c.delegations, {
        "depth": F.col("depth").between(1, 3),
        "first_hop_has_no_parent": (F.col("depth") != 1) | F.col("parent_delegation").isNull(),
    })
    shipment = quality.domain_violations(c.shipments, {
        "classification": F.col("classification").isin("public", "internal", "restricted"),
        "partner_present": F.col("partner_org").isNotNull(),
        "owner_present": F.col("owner_org").isNotNull(),
    })
    grant = quality.domain_violations(c.grants, {
        "ceiling": F.col("max_classification").isin("public", "internal", "restricted"),
        "low_ceiling": F.col("max_classification") != "public",
        "approved": F.col("approved_at").isNotNull(),
    })
    event = quality.domain_violations(c.events, {
        "decision": F.col("decision").isin("allow", "deny"),
        "refusal_has_reason": (F.col("decision") != "deny") | F.col("deny_reason").isNotNull(),
        "reader_known": F.col("subject").isNotNull(),
    })
    return principal.unionByName(delegation).unionByName(shipment).unionByName(grant).unionByName(event)


# --- the four clauses: rows each clause alone lets a credential see ---------
def _clause_count(c: Context, keys: list[str], scope):
    cells = guard.policy_cells(c.shipments).groupBy(*keys).agg(F.sum("n_rows").alias("n"))
    safe = [k for k in keys if k == "partner_org"]
    met = lookup_join(scope, cells, keys, null_safe=safe)
    per = met.groupBy("auth_id").agg(F.sum("n").alias("n"))
    return c.auths.select("auth_id").join(per, "auth_id", "left").select(
        "auth_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows")
    )


def _clause_sql(condition: str) -> str:
    return f"SELECT a.auth_id, count(s.shipment_id) AS n_rows FROM auths a LEFT JOIN gov_shipment s ON {condition} GROUP BY a.auth_id"


@query("row_owner", _clause_sql("s.owner_org = a.provider_org"))
def row_owner(c: Context):
    return _clause_count(c, ["owner_org"], c.auths.select("auth_id", F.col("provider_org").alias("owner_org")))


@query("row_region", _clause_sql("list_contains(a.regions, s.region)"))
def row_region(c: Context):
    return _clause_count(c, ["region"], c.auths.select("auth_id", F.explode(F.array_distinct("region_scope")).alias("region")))


@query("row_ceiling", _clause_sql(f"{rank('s.classification')} <= {rank('a.max_classification')}"))
def row_ceiling(c: Context):
    return _clause_count(c, ["class_rank"], c.auths.select("auth_id", F.explode(guard.admitted_ranks()).alias("class_rank")))


@query("row_partner", _clause_sql("(s.partner_org IS NULL OR s.partner_org = a.grantee_org)"))
def row_partner(c: Context):
    return _clause_count(c, ["partner_org"], c.auths.select("auth_id", F.explode(guard.admitted_partners()).alias("partner_org")))


@query("row_policy", "SELECT auth_id, shipment_id FROM vis")
def row_policy(c: Context):
    return guard.visible(c.shipments, c.auths).select("auth_id", "shipment_id")


@query("mask_cost", """
SELECT auth_id, count(*) AS n_rows, count(unit_cost_usd) AS n_cost, count(margin_pct) AS n_margin,
  CAST(sum(unit_cost_usd) AS DOUBLE) AS cost FROM guarded GROUP BY auth_id""")
def mask_cost(c: Context):
    """Folded to policy cells, like every total of a caller; credentials that see no row are left out."""
    asked = "count(*) AS n_rows, count(unit_cost_usd) AS n_cost, count(margin_pct) AS n_margin, sum(unit_cost_usd) AS cost"
    return as_double(asks.aggregate(c.shipments, c.auths, asked).filter("n_rows > 0"), ["cost"])


@query("mask_contact", """
SELECT auth_id, count(*) AS n_rows, count(contact_email) AS n_email, count(contact_phone) AS n_phone,
  max(contact_email) AS last_email FROM guarded GROUP BY auth_id""")
def mask_contact(c: Context):
    asked = "count(*) AS n_rows, count(contact_email) AS n_email, count(contact_phone) AS n_phone, max(contact_email) AS last_email"
    return asks.aggregate(c.shipments, c.auths, asked).filter("n_rows > 0")


@query("guarded_scan", SQL_GUARDED)
def guarded_scan(c: Context):
    return as_double(c.guarded)


@query("late_mask_scan", SQL_GUARDED.replace("FROM guarded", """FROM (SELECT auth_id, shipment_id, owner_org, region,
  classification, partner_org, carrier, status, units, updated_at, CASE WHEN allow_cost THEN unit_cost_usd END AS unit_cost_usd,
  CASE WHEN allow_cost THEN margin_pct END AS margin_pct, CASE WHEN allow_contact THEN contact_email END AS contact_email,
  CASE WHEN allow_contact THEN contact_phone END AS contact_phone FROM vis WHERE unit_cost_usd > 200000)"""))
def late_mask_scan(c: Context):
    return as_double(guard.late_masked(c.shipments, c.auths, F.col("unit_cost_usd") > 200000))


# --- caller queries --------------------------------------------------------
@query("select_columns", "SELECT auth_id, shipment_id, region, contact_email FROM guarded")
def select_columns(c: Context):
    return guard.select_columns(c.guarded, ["shipment_id", "region", "contact_email"])


@query("caller_filter", """
SELECT auth_id, shipment_id, CAST(unit_cost_usd AS DOUBLE) AS unit_cost_usd FROM guarded
WHERE unit_cost_usd > 100000 AND status = 'F' AND units BETWEEN 100 AND 250""")
def caller_filter(c: Context):
    kept = asks.read(c.shipments, c.auths, "unit_cost_usd > 100000 AND status = 'F' AND units BETWEEN 100 AND 250")
    return as_double(kept.select("auth_id", "shipment_id", "unit_cost_usd"))


@query("caller_params", "SELECT auth_id, shipment_id, status, units FROM guarded WHERE status = 'O' AND units BETWEEN 10 AND 60")
def caller_params(c: Context):
    kept = asks.read(
        c.shipments, c.auths, "status = :status AND units BETWEEN :low AND :high", {"status": "O", "low": 10, "high": 60}
    )
    return kept.select("auth_id", "shipment_id", "status", "units")


@query("caller_order", """
SELECT * FROM (SELECT auth_id, shipment_id, units, row_number() OVER (PARTITION BY auth_id
  ORDER BY CAST(unit_cost_usd AS DOUBLE) DESC NULLS LAST, units, shipment_id) AS position FROM guarded WHERE units % 3 = 1) WHERE position <= 4""")
def caller_order(c: Context):
    """ORDER BY and LIMIT of a caller, for every credential; masked keys sort as NULL."""
    top = asks.top(c.shipments, c.auths, "unit_cost_usd desc, units", 4, "units % 3 = 1")
    return top.select("auth_id", "shipment_id", "units", "position")


@query("caller_aggregate", """
SELECT a.auth_id, count(g.shipment_id) AS n, CAST(sum(g.units) AS BIGINT) AS total, CAST(max(g.unit_cost_usd) AS DOUBLE) AS dearest,
  count(g.margin_pct) AS margins FROM auths a LEFT JOIN guarded g ON g.auth_id = a.auth_id AND g.units BETWEEN 100 AND 300 AND g.status <> 'P'
GROUP BY a.auth_id""")
def caller_aggregate(c: Context):
    """Folded to policy cells: the fact is scanned once and joined with nothing."""
    asked = "count(*) AS n, sum(units) AS total, max(unit_cost_usd) AS dearest, count(margin_pct) AS margins"
    out = asks.aggregate(c.shipments, c.auths, asked, "units BETWEEN :low AND :high AND status <> 'P'", {"low": 100, "high": 300})
    return as_double(out, ["dearest"])


@query("caller_aggregate_rows", """
SELECT a.auth_id, count(g.shipment_id) AS n, CAST(sum(g.units % 7) AS BIGINT) AS odd, count(DISTINCT g.carrier) AS carriers
FROM auths a LEFT JOIN guarded g ON g.auth_id = a.auth_id AND g.unit_cost_usd > 50000 AND 100 / (g.units + 1) < 5 GROUP BY a.auth_id""")
def caller_aggregate_rows(c: Context):
    """Aggregates that are no sums of cells, under a predicate that must stay above the policy."""
    return asks.aggregate(
        c.shipments, c.auths, "count(*) AS n, sum(units % 7) AS odd, count(DISTINCT carrier) AS carriers",
        "unit_cost_usd > 50000 AND 100 / (units + 1) < 5")


SQL_PROBE = f"""
SELECT q.request_id, s.shipment_id FROM (SELECT *, UNNEST({{ids}}) AS probe FROM req WHERE allowed) q
JOIN gov_shipment s ON s.shipment_id = q.probe AND s.owner_org = q.provider_org AND list_contains(q.regions, s.region)
  AND {rank('s.classification')} <= {rank('q.max_classification')} AND (s.partner_org IS NULL OR s.partner_org = q.grantee_org)"""


def _probe(c: Context, ids):
    """Requests each look up ids of their own; a hidden id gives no row, like one that does not exist."""
    from wardline.operators.auth import judge

    asked = judge(c.requests, c.resolved).filter("decision = 'allow'").withColumn("shipment_id", F.explode(ids))
    scope = asked.select("request_id", "shipment_id", "provider_org", "region_scope", "max_classification", "grantee_org")
    met = scope.join(guard.ranked(c.shipments).select("shipment_id", *guard.CELL), "shipment_id")
    return met.filter(
        (F.col("owner_org") == F.col("provider_org")) & F.array_contains("region_scope", F.col("region"))
        & (F.col("class_rank") <= guard.class_rank("max_classification"))
        & (F.col("partner_org").isNull() | (F.col("partner_org") == F.col("grantee_org")))
    ).select("request_id", "shipment_id")


@query("probe_point", SQL_PROBE.format(ids="[request_id + 1]"))
def probe_point(c: Context):
    return _probe(c, F.array(F.col("request_id") + 1))


@query("probe_any", SQL_PROBE.format(ids="[request_id + 1, request_id + 2, request_id + 400, request_id * 2]"))
def probe_any(c: Context):
    r = F.col("request_id")
    return _probe(c, F.array_distinct(F.array(r + 1, r + 2, r + 400, r * 2))).distinct()


@query("probe_other_owner", """
SELECT a.auth_id, count(g.shipment_id) AS n_foreign FROM auths a
LEFT JOIN guarded g ON g.auth_id = a.auth_id AND g.owner_org <> a.provider_org GROUP BY a.auth_id""")
def probe_other_owner(c: Context):
    """The owner of every cell a credential is let into, next to the provider of its grant: no join with the fact."""
    scope = guard.scope_cells(c.auths, keep=("auth_id", "provider_org"))
    let_in = lookup_join(scope, guard.policy_cells(c.shipments), guard.CELL, null_safe=["partner_org"])
    foreign = F.when(F.col("owner_org") != F.col("provider_org"), F.col("n_rows")).otherwise(0)
    per = let_in.groupBy("auth_id").agg(F.sum(foreign).alias("n"))
    return c.auths.select("auth_id").join(per, "auth_id", "left").select("auth_id", F.coalesce("n", F.lit(0)).alias("n_foreign"))


THRESHOLDS = (0, 50000, 150000, 300000, 10000000)


@query("probe_threshold", """
SELECT a.auth_id, t.threshold, count(g.shipment_id) AS n_rows FROM auths a
CROSS JOIN (SELECT UNNEST([0, 50000, 150000, 300000, 10000000]) AS threshold) t
LEFT JOIN guarded g ON g.auth_id = a.auth_id AND g.unit_cost_usd > t.threshold GROUP BY ALL""")
def probe_threshold(c: Context):
    from wardline.operators.leaks import side_channel_cells

    cells = side_channel_cells(c.shipments, THRESHOLDS)
    per = guard.totals(cells, c.auths, *[F.sum(f"above_{i}").alias(f"above_{i}") for i in range(len(THRESHOLDS))])
    seen = lambda i: F.when(F.col("allow_cost"), F.coalesce(f"above_{i}", F.lit(0))).otherwise(0).cast("long")
    pairs = F.array(*[F.struct(F.lit(t).alias("threshold"), seen(i).alias("n_rows")) for i, t in enumerate(THRESHOLDS)])
    return per.select("auth_id", F.inline(pairs))


@query("column_split", """
SELECT seq, array_to_string([x FOR x IN columns IF NOT ((x IN ('unit_cost_usd', 'margin_pct') AND NOT allow_cost) OR
  (x IN ('contact_email', 'contact_phone') AND NOT allow_contact))], ',') AS served,
  array_to_string([x FOR x IN columns IF ((x IN ('unit_cost_usd', 'margin_pct') AND NOT allow_cost) OR
  (x IN ('contact_email', 'contact_phone') AND NOT allow_contact))], ',') AS masked FROM ev WHERE ok""")
def column_split(c: Context):
    return c.events.filter("decision = 'allow'").select(
        "seq", F.array_join("columns_served", ",").alias("served"), F.array_join("columns_masked", ",").alias("masked")
    )


assert set(BASE_COLUMNS) < set(ALL_COLUMNS)
