"""Scalar rules, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.oracle import AS_OF, hmac_sql, rank
from wardline.catalog.registry import Context, query
from wardline.functions import crypto
from wardline.functions import scalars as fn
from wardline.plans.placement import lookup_join

T = f"TIMESTAMP '{AS_OF}'"


@query("fn_class_rank", f"SELECT shipment_id, {rank('classification')} AS class_rank FROM gov_shipment")
def fn_class_rank(c: Context):
    return c.shipments.select("shipment_id", fn.class_rank("classification").alias("class_rank"))


@query("fn_grant_live", f"""SELECT grant_id, coalesce(approved_at <= {T}, false) AND (revoked_at IS NULL OR revoked_at > {T})
  AND expires_at > {T} AS live FROM gov_grant""")
def fn_grant_live(c: Context):
    return c.grants.select("grant_id", fn.grant_live("approved_at", "revoked_at", "expires_at", c.as_of).alias("live"))


@query("fn_hop_live", f"SELECT delegation_id, (revoked_at IS NULL OR revoked_at > {T}) AND expires_at > {T} AS live FROM gov_delegation")
def fn_hop_live(c: Context):
    return c.delegations.select("delegation_id", fn.hop_live("revoked_at", "expires_at", c.as_of).alias("live"))


@query("fn_hmac_sha256", f"""SELECT principal_id, {hmac_sql("display_name")} AS mac FROM gov_principal
  JOIN pad ON kid = CASE WHEN CAST(substr(principal_id, 3) AS BIGINT) % 25 = 0 THEN 'default'
    ELSE concat('k-', CAST(CAST(substr(principal_id, 3) AS BIGINT) % 25 AS VARCHAR)) END""")
def fn_hmac_sha256(c: Context):
    n = F.substring("principal_id", 3, 20).cast("long") % 25
    keyed = c.principals.withColumn("kid", F.when(n == 0, "default").otherwise(F.concat(F.lit("k-"), n.cast("string"))))
    joined = lookup_join(keyed, crypto.key_pads(c.keys), ["kid"])
    return joined.select("principal_id", crypto.hmac_hex(F.col("display_name"), "ipad", "opad").alias("mac"))


@query("fn_b64", "SELECT request_id, doc FROM (SELECT request_id, TRY(decode(from_base64(parts[1]))) AS doc FROM tok_doc)")
def fn_b64(c: Context):
    return c.tokens.select("request_id", fn.decode_text(F.get(F.split("token", "\\."), F.lit(0))).alias("doc"))


@query("fn_json_get", "SELECT event_id, props->>'$.k' AS k, props->>'$.none' AS missing FROM events")
def fn_json_get(c: Context):
    return c.base["events"].select("event_id", fn.json_get("props", "k").alias("k"), fn.json_get("props", "none").alias("missing"))


@query("fn_split", "SELECT request_id, CASE WHEN len(parts) = 2 THEN parts[2] END AS signature FROM tok_doc")
def fn_split(c: Context):
    return c.tokens.select("request_id", fn.split_token("token")[1].alias("signature"))


@query("fn_epoch", "SELECT request_id, try_cast(exp AS DOUBLE) <= epoch(event_ts) AS reached FROM gov_claim")
def fn_epoch(c: Context):
    return c.claims.select("request_id", fn.epoch_reached("exp", F.col("event_ts")).alias("reached"))


@query("fn_distinct_from", "SELECT shipment_id, partner_org IS DISTINCT FROM owner_org AS differs FROM gov_shipment")
def fn_distinct_from(c: Context):
    return c.shipments.select("shipment_id", fn.distinct_from("partner_org", "owner_org").alias("differs"))


@query("fn_coalesce", "SELECT shipment_id, coalesce(partner_org, owner_org) AS org FROM gov_shipment")
def fn_coalesce(c: Context):
    return c.shipments.select("shipment_id", F.coalesce("partner_org", "owner_org").alias("org"))


@query("fn_concat_ws", """SELECT shipment_id, concat_ws('|', owner_org, partner_org, '', carrier) AS joined,
  concat(CASE WHEN partner_org IS NULL THEN '-' ELSE concat(length(partner_org), ':', partner_org) END,
         concat(length(carrier), ':', carrier)) AS prefixed FROM gov_shipment""")
def fn_concat_ws(c: Context):
    return c.shipments.select(
        "shipment_id", F.concat_ws("|", "owner_org", "partner_org", F.lit(""), "carrier").alias("joined"),
        crypto.length_prefixed(F.col("partner_org"), F.col("carrier")).alias("prefixed"),
    )


@query("fn_array_text", "SELECT grant_id, CAST(to_json(region_scope) AS VARCHAR) AS regions FROM gov_grant")
def fn_array_text(c: Context):
    return c.grants.select("grant_id", fn.array_text("region_scope").alias("regions"))


@query("fn_any", "SELECT grant_id, list_contains(region_scope, 'ASIA') AS has_asia FROM gov_grant")
def fn_any(c: Context):
    return c.grants.select("grant_id", fn.any_of(F.lit("ASIA"), "region_scope").alias("has_asia"))


@query("fn_unnest", "SELECT grant_id, UNNEST(region_scope) AS region FROM gov_grant")
def fn_unnest(c: Context):
    return c.grants.select("grant_id", F.explode("region_scope").alias("region"))


@query("fn_json_build", "SELECT grant_id, CAST(json_object('grant_id', grant_id, 'approver', approved_by) AS VARCHAR) AS doc FROM gov_grant WHERE approved_by IS NOT NULL")
def fn_json_build(c: Context):
    built = F.to_json(F.struct("grant_id", F.col("approved_by").alias("approver")))
    return c.grants.filter("approved_by IS NOT NULL").select("grant_id", built.alias("doc"))


@query("fn_interval", """SELECT event_id, strftime(ts + (event_id % 40) * INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS in_days,
  strftime(ts + (event_id % 30) * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS in_hours FROM events""")
def fn_interval(c: Context):
    at = F.col("ts").cast("timestamp")
    text = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    return c.base["events"].select(
        "event_id", text(fn.plus_days(at, (F.col("event_id") % 40).cast("int"))).alias("in_days"),
        text(fn.plus_hours(at, (F.col("event_id") % 30).cast("int"))).alias("in_hours"),
    )


@query("fn_date_format", "SELECT request_id, strftime(event_ts, '%Y-%m-%d') AS day, strftime(event_ts, '%m-%d %H:%M') AS minute FROM gov_request")
def fn_date_format(c: Context):
    return c.requests.select(
        "request_id", F.date_format("event_ts", "yyyy-MM-dd").alias("day"), F.date_format("event_ts", "MM-dd HH:mm").alias("minute")
    )


@query("fn_join_list", "SELECT delegation_id, array_to_string(region_scope, ',') AS regions FROM gov_delegation")
def fn_join_list(c: Context):
    return c.delegations.select("delegation_id", fn.join_list("region_scope").alias("regions"))


@query("fn_prefix", "SELECT delegation_id, substr(purpose, 1, 28) AS purpose FROM gov_delegation")
def fn_prefix(c: Context):
    return c.delegations.select("delegation_id", F.substring("purpose", 1, 28).alias("purpose"))


@query("fn_round", """SELECT o_orderkey, CAST(round(CAST(o_orderkey AS DECIMAL(12,2)) / 4, 0) AS BIGINT) AS nearest,
  round(o_orderkey / CAST(7 AS DOUBLE), 4) AS four FROM orders""")
def fn_round(c: Context):
    key = F.col("o_orderkey")
    return c.base["orders"].select(
        "o_orderkey", fn.rounded_long(key.cast("decimal(12,2)") / 4).alias("nearest"),
        F.round(key.cast("double") / F.lit(7.0), 4).alias("four"),
    )
