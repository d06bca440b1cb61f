"""Revocation replay and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.oracle import hmac_sql, live, rank
from wardline.catalog.registry import Context, query
from wardline.functions.crypto import length_prefixed
from wardline.operators import auth, guard, replay, sets
from wardline.plans.placement import lookup_join, stage
from wardline.session import scratch
from wardline.sources import sinks
from wardline.sources.tables import load
from wardline.streaming import jobs

DAY = 86400
TTL, WAIT = DAY, 5 * DAY
BOUNDS = {"live": DAY, "cache": TTL + DAY, "token": 20 * DAY}

_ENDS = "f.g_exp, f.g_rev, f.g_dis, f.e0, f.r0, f.x0, f.e1, f.r1, f.x1, f.e2, f.r2, f.x2"
_REV = "least(f.g_rev, f.r0, f.r1, f.r2)"
_CRED_EQ = "{0}.subject = {1}.subject AND {0}.grant_id = {1}.grant_id AND {0}.delegation_id IS NOT DISTINCT FROM {1}.delegation_id"

# The cache, request by request: a hit keeps the fill, a miss refills while the authority lives.
_CACHE = f"""WITH RECURSIVE line AS MATERIALIZED (SELECT q.request_id, q.event_ts, q.subject, q.grant_id, q.delegation_id, q.allowed AS live,
    row_number() OVER (PARTITION BY q.subject, q.grant_id, q.delegation_id ORDER BY q.event_ts, q.request_id) AS n FROM req q),
walk AS (
  SELECT request_id, event_ts, subject, grant_id, delegation_id, n, live AS allowed, CASE WHEN live THEN event_ts END AS fill FROM line WHERE n = 1
  UNION ALL
  SELECT x.request_id, x.event_ts, x.subject, x.grant_id, x.delegation_id, x.n, coalesce(x.event_ts < w.fill + INTERVAL 1 DAY, false) OR x.live,
    CASE WHEN coalesce(x.event_ts < w.fill + INTERVAL 1 DAY, false) THEN w.fill WHEN x.live THEN x.event_ts END
  FROM walk w JOIN line x ON {_CRED_EQ.format('x', 'w')} AND x.n = w.n + 1)"""

_POLICY = f"""s.owner_org = {{0}}.provider_org AND {rank('s.classification')} <= {rank('{0}.max_classification')}
  AND (s.partner_org IS NULL OR s.partner_org = {{0}}.grantee_org)"""
_TRIALS = f"""{_CACHE},
revs AS (SELECT f.subject, f.grant_id, f.delegation_id, {_REV} AS rev FROM fact f WHERE f.fits AND {_REV} = least({_ENDS}) AND f.approved_at < {_REV}),
nlive AS (SELECT f.subject, f.grant_id, f.delegation_id, count(s.shipment_id) AS n_rows FROM fact f LEFT JOIN gov_shipment s
  ON list_contains(f.regions, s.region) AND {_POLICY.format('f')} WHERE f.fits GROUP BY ALL),
tscope AS (SELECT c.subject, c.grant_id, c.delegation_id, coalesce(d.region_scope, g.region_scope) AS regions, g.provider_org, g.grantee_org, g.max_classification
  FROM cred c JOIN gov_grant g ON g.grant_id = c.grant_id LEFT JOIN gov_delegation d ON d.delegation_id = c.delegation_id),
ntok AS (SELECT t.subject, t.grant_id, t.delegation_id, count(s.shipment_id) AS n_rows FROM tscope t LEFT JOIN gov_shipment s
  ON list_contains(t.regions, s.region) AND {_POLICY.format('t')} GROUP BY ALL),
judged AS (
  SELECT 'live' AS mode, q.request_id, q.event_ts, q.subject, q.grant_id, q.delegation_id, q.allowed, n.n_rows FROM req q LEFT JOIN nlive n ON {_CRED_EQ.format('n', 'q')}
  UNION ALL SELECT 'cache', q.request_id, q.event_ts, q.subject, q.grant_id, q.delegation_id, q.allowed, n.n_rows FROM walk q LEFT JOIN nlive n ON {_CRED_EQ.format('n', 'q')}
  UNION ALL SELECT 'token', q.request_id, q.event_ts, q.subject, q.grant_id, q.delegation_id, q.event_ts < q.token_exp, n.n_rows FROM gov_request q LEFT JOIN ntok n ON {_CRED_EQ.format('n', 'q')}),
halt AS (SELECT m.mode, r.subject, r.grant_id, r.delegation_id, r.rev, min(j.event_ts) FILTER (WHERE j.event_ts >= r.rev AND (NOT j.allowed OR coalesce(j.n_rows, 0) = 0)) AS halted_at
  FROM revs r CROSS JOIN (SELECT UNNEST(['live', 'cache', 'token']) AS mode) m LEFT JOIN judged j ON j.mode = m.mode AND {_CRED_EQ.format('j', 'r')} GROUP BY ALL),
trial AS (SELECT h.mode, h.subject, h.grant_id, h.delegation_id,
    least(coalesce((epoch_us(h.halted_at) - epoch_us(h.rev)) / 1e6, {WAIT}), {WAIT}) AS halt_latency_s,
    coalesce(sum(CASE WHEN j.allowed AND (h.halted_at IS NULL OR j.event_ts < h.halted_at) THEN coalesce(j.n_rows, 0) ELSE 0 END), 0) AS rows_after,
    count(j.request_id) AS requests_after
  FROM halt h LEFT JOIN judged j ON j.mode = h.mode AND {_CRED_EQ.format('j', 'h')} AND j.event_ts >= h.rev
    AND epoch_us(j.event_ts) - epoch_us(h.rev) < {WAIT * 1000000} AND (h.halted_at IS NULL OR j.event_ts <= h.halted_at)
  GROUP BY h.mode, h.subject, h.grant_id, h.delegation_id, h.rev, h.halted_at)
"""


def _row_counts(c: Context, scopes):
    """Rows a full read serves, per credential."""
    counts = guard.visible_counts(c.shipments, guard.with_auth_id(scopes))
    return guard.with_auth_id(scopes.select(*auth.CREDENTIAL)).join(counts, "auth_id").drop("auth_id")


def _token_scopes(c: Context):
    g = c.grants.select("grant_id", "provider_org", "grantee_org", "max_classification", F.col("region_scope").alias("g_regions"))
    d = c.delegations.select("delegation_id", F.col("region_scope").alias("d_regions"))
    df = c.presented.join(g, "grant_id").join(d, "delegation_id", "left")
    return df.withColumn("region_scope", F.coalesce("d_regions", "g_regions"))


def _judged(c: Context, *modes: str):
    """Requests as each way of checking judges them, with the rows a full read would serve."""
    how = {
        "live": lambda: replay.replay_live(c.requests, c.resolved), "token": lambda: replay.replay_token(c.requests),
        "cache": lambda: replay.replay_cache(c.requests, c.resolved, TTL),
    }
    narrow = sets.stack(*[
        how[m]().select("request_id", "event_ts", *auth.CREDENTIAL, "allowed", F.lit(m).alias("mode"),
                        F.lit(m == "token").alias("by_token")) for m in modes
    ])
    counts = [_row_counts(c, _token_scopes(c) if by_token else c.resolved).withColumn("by_token", F.lit(by_token))
              for by_token in sorted({m == "token" for m in modes})]
    return lookup_join(narrow, sets.stack(*counts), [*auth.CREDENTIAL, "by_token"], "left", null_safe=["delegation_id"])


def _trials(c: Context, *modes: str):
    judged = _judged(c, *modes)
    revoked = replay.revocations(c.resolved).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    halts = stage(replay.first_denial(judged, revoked, WAIT, ["mode"]))
    trials = replay.until_halt(judged, halts, WAIT, ["mode"])
    bound = F.create_map(*[F.lit(x) for m in modes for x in (m, float(BOUNDS[m]))])
    return trials.withColumn("bound_s", bound[F.col("mode")])


@query("replay_live", "SELECT request_id, allowed FROM req")
def replay_live(c: Context):
    return replay.replay_live(c.requests, c.resolved).select("request_id", "allowed")


@query("replay_cache", f"{_CACHE} SELECT request_id, allowed FROM walk")
def replay_cache(c: Context):
    return replay.replay_cache(c.requests, c.resolved, TTL).select("request_id", "allowed")


@query("win_cache_epochs", f"{_CACHE} SELECT subject, grant_id, delegation_id, epoch_us(max(fill)) AS refreshed_us FROM walk WHERE fill IS NOT NULL GROUP BY ALL")
def win_cache_epochs(c: Context):
    fills = replay.last_refresh(c.requests, c.resolved, TTL)
    return fills.select(*auth.CREDENTIAL, F.unix_micros("refreshed_at").alias("refreshed_us"))


@query("replay_token", "SELECT request_id, event_ts < token_exp AS allowed FROM gov_request")
def replay_token(c: Context):
    return replay.replay_token(c.requests).select("request_id", "allowed")


@query("join_token_scope", f"""SELECT d.delegation_id, count(s.shipment_id) AS n_rows FROM (SELECT d.delegation_id, d.region_scope AS regions, g.provider_org, g.grantee_org, g.max_classification
  FROM gov_delegation d JOIN gov_grant g ON g.grant_id = d.grant_id) d LEFT JOIN gov_shipment s ON list_contains(d.regions, s.region) AND {_POLICY.format('d')} GROUP BY d.delegation_id""")
def join_token_scope(c: Context):
    scopes = replay.token_scope(c.delegations, c.grants).withColumn("auth_id", F.col("delegation_id"))
    return guard.visible_counts(c.shipments, scopes).withColumnRenamed("auth_id", "delegation_id")


@query("replay_inflight", f"""SELECT q.request_id FROM (SELECT *, event_ts + (request_id % 2000) * INTERVAL 1 MINUTE AS end_ts FROM gov_request) q
  JOIN fact f ON {_CRED_EQ.format('f', 'q')} AND f.fits AND {live('q.event_ts')} WHERE q.event_ts < {_REV} AND q.end_ts >= {_REV}""")
def replay_inflight(c: Context):
    ends = c.requests.withColumn("end_ts", F.col("event_ts") + F.make_dt_interval(mins=(F.col("request_id") % 2000).cast("int")))
    return replay.replay_inflight(ends, c.resolved).select("request_id")


@query("win_first_denial", f"{_TRIALS} SELECT subject, grant_id, delegation_id, halt_latency_s FROM trial WHERE mode = 'live'")
def win_first_denial(c: Context):
    halts = replay.first_denial(_judged(c, "live"), replay.revocations(c.resolved), WAIT)
    return halts.select(*auth.CREDENTIAL, "halt_latency_s")


@query("win_rows_until_halt", f"{_TRIALS} SELECT mode, subject, grant_id, delegation_id, CAST(rows_after AS BIGINT) AS rows_after, requests_after FROM trial WHERE mode IN ('cache', 'token')")
def win_rows_until_halt(c: Context):
    return _trials(c, "cache", "token").select("mode", *auth.CREDENTIAL, "rows_after", "requests_after")


_CASES = " ".join(f"WHEN '{m}' THEN {b}" for m, b in BOUNDS.items())
_SUMMARY = """SELECT mode, {bound}count(*) AS trials, round(avg(halt_latency_s), 4) AS halt_mean_s, round(max(halt_latency_s), 4) AS halt_max_s,
  CAST(max(rows_after) AS BIGINT) AS rows_after_max, round(avg(rows_after), 2) AS rows_after_mean,
  count(*) FILTER (WHERE halt_latency_s <= b) AS n_within, bool_and(halt_latency_s <= b) AS all_within FROM
  (SELECT t.*, CASE mode {cases} END AS b FROM trial t) GROUP BY mode"""
_SUMMARY, _SUMMARY_BOUND = (_SUMMARY.format(bound=bound, cases=_CASES) for bound in ("", "CAST(max(b) AS DOUBLE) AS declared_bound_s, "))


@query("replay_summary", f"{_TRIALS} {_SUMMARY}")
def replay_summary(c: Context):
    return replay.mode_summary(_trials(c, *BOUNDS)).drop("declared_bound_s")


@query("agg_mode_summary", f"{_TRIALS} {_SUMMARY_BOUND}")
def agg_mode_summary(c: Context):
    return replay.mode_summary(_trials(c, *BOUNDS))


# --- streaming -------------------------------------------------------------
@query("stream_guarded", f"""WITH v AS (SELECT q.request_id, q.event_ts, q.columns, q.k, x.sub AS subject, x.grant_id, x.delegation_id
    FROM ver x JOIN (SELECT *, CAST(request->>'$.k' AS BIGINT) AS k FROM gov_request) q ON q.request_id = x.request_id),
j AS (SELECT v.*, f.provider_org, f.grantee_org, f.regions, f.max_classification,
    f.fits IS NOT NULL AND NOT list_contains(v.columns, 'secret_notes') AS ok FROM v LEFT JOIN fact f ON {_CRED_EQ.format('f', 'v')} AND f.fits AND {live('v.event_ts')})
SELECT j.request_id, CASE WHEN j.ok THEN 'allow' ELSE 'deny' END AS decision, count(s.shipment_id) AS row_count,
    CASE WHEN NOT j.ok THEN coalesce(j.subject, CASE WHEN json_valid(n.said) THEN n.said->>'$.sub' END) END AS claimed_sub FROM j LEFT JOIN gov_shipment s
  ON j.ok AND s.units = j.k AND list_contains(j.regions, s.region) AND {_POLICY.format('j')}
  LEFT JOIN (SELECT request_id, TRY(decode(from_base64(parts[1]))) AS said FROM tok_doc) n ON n.request_id = j.request_id GROUP BY ALL""")
def stream_guarded(c: Context):
    base = scratch(c.spark, "stream-guarded")
    for name, df in (("data_grant", c.grants), ("delegation", c.delegations),
                     ("principal", c.principals), ("shipment", c.shipments)):
        df.write.parquet(f"{base}/gov/{name}")
    asked = c.requests.select("request_id", "columns", "request")
    presented = c.tokens.join(asked, "request_id")
    presented.write.parquet(f"{base}/tokens")
    tokens = c.spark.readStream.schema(presented.schema).parquet(f"{base}/tokens")

    def governance():
        return {**load(c.spark, f"{base}/gov", ("data_grant", "delegation", "principal", "shipment")), "keys": c.keys}

    jobs.stream_guarded(tokens, governance, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return c.spark.read.parquet(f"{base}/out/events").select(
        F.col("seq").alias("request_id"), "decision", "row_count", F.get_json_object("request", "$.claimed_sub").alias("claimed_sub"))


@query("stream_audit", f"""WITH RECURSIVE line AS (SELECT event_id AS seq, event_id // 256 AS segment, event_id % 256 + 1 AS pos, ipad, opad,
    concat(length(CAST(event_id AS VARCHAR)), ':', event_id, length(event_type), ':', event_type, length(props), ':', props) AS body FROM events JOIN pad ON kid = 'default'),
numbered AS MATERIALIZED (SELECT * FROM line),
link AS (SELECT segment, pos, seq, {hmac_sql("concat('0:', body)")} AS hash FROM numbered WHERE pos = 1
  UNION ALL SELECT x.segment, x.pos, x.seq, {hmac_sql("concat('64:', l.hash, x.body)", 'x.ipad', 'x.opad')} FROM link l JOIN numbered x ON x.segment = l.segment AND x.pos = l.pos + 1)
SELECT seq, pos, hash FROM link""")
def stream_audit(c: Context):
    base = scratch(c.spark, "stream-audit")
    source = c.spark.readStream.schema(c.base["events"].schema).option("pathGlobFilter", "events.parquet").parquet(c.sf_dir)
    outcomes = source.select(F.col("event_id").alias("seq"), F.lit("default").alias("kid"), "event_type", "props")
    body = length_prefixed(F.col("seq").cast("string"), F.col("event_type"), F.col("props"))
    jobs.stream_audit(outcomes, c.keys, body, f"{base}/out", f"{base}/checkpoint", 256).awaitTermination()
    return c.spark.read.parquet(f"{base}/out").select("seq", "pos", "hash")


@query("stream_denials", """SELECT strftime(date_trunc('day', event_ts), '%Y-%m-%d') AS day, presented AS claimed_sub, count(*) AS n
  FROM ev WHERE decision = 'deny' GROUP BY ALL""")
def stream_denials(c: Context):
    base = scratch(c.spark, "stream-denials")
    sinks.append_audit(c.events.select("seq", "event_ts", "subject", "decision", "request"), f"{base}/in")
    source = c.spark.readStream.schema("seq long, event_ts timestamp, subject string, decision string, request string").parquet(f"{base}/in")
    jobs.stream_denials(source, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    counts = jobs.latest_counts(c.spark.read.parquet(f"{base}/out"))
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "claimed_sub", "n")
