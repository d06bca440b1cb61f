"""Revocation replay: how long a caller keeps succeeding after its authority ends, under three ways of checking.

All times come from the event table. `live` judges every request by the state at its own time, `cache` serves
from an authorisation cached for `ttl`, `token` looks at the token's expiry only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.auth import CREDENTIAL, live_at
from wardline.plans.placement import lookup_join, stage

US = 1_000_000


def _with_scope(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    keep = resolved.select(*CREDENTIAL, "opens_at", "closes_at")
    return lookup_join(requests, keep, CREDENTIAL, "left", null_safe=["delegation_id"])


def replay_live(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """Requests with `allowed`, each judged by the state at its own time."""
    df = _with_scope(requests, resolved)
    return df.withColumn("allowed", F.coalesce(live_at(F.col("event_ts")), F.lit(False))).drop("opens_at", "closes_at")


def _reach(times: DataFrame, lo: int, hi: int, ttl: int, slots: int) -> DataFrame:
    """Per credential `c` and time `t`: the time before it (`prev`) and the first one at least `ttl` later (`exit`).

    Every time also asks for what comes at `t + ttl`. Times and asks meet in slots of equal length; what a slot cannot
    answer is read off the slots around it, of which a credential has at most `slots`.
    """
    width = (hi - lo) // slots + 1
    mark = lambda x, event: F.struct(x.alias("x"), F.lit(event).alias("event"))
    marks = times.select("c", F.explode(F.array(mark(F.col("t"), True), mark(F.col("t") + ttl, False))).alias("m")).select("c", "m.*")
    cut = marks.filter(F.col("x") <= hi).withColumn("slot", F.floor((F.col("x") - lo) / width))
    time = F.when(F.col("event"), F.col("x"))
    inside, around = Window.partitionBy("c", "slot"), Window.partitionBy("c").rowsBetween(Window.unboundedPreceding, -1)
    near = cut.withColumn("after", F.min(time).over(inside.orderBy(F.desc("x"), F.desc("event")))).withColumn(
        "before", F.max(time).over(inside.orderBy("x", "event").rowsBetween(Window.unboundedPreceding, -1)))
    far = cut.groupBy("c", "slot").agg(F.min(time).alias("first"), F.max(time).alias("last")).select(
        "c", "slot", F.min("first").over(around.orderBy(F.desc("slot"))).alias("later"),
        F.max("last").over(around.orderBy("slot")).alias("earlier"))
    met = near.join(far, ["c", "slot"])
    event = F.col("event")
    return met.groupBy("c", F.when(event, F.col("x")).otherwise(F.col("x") - ttl).alias("t")).agg(
        F.max(F.when(event, F.coalesce("before", "earlier"))).alias("prev"),
        F.max(F.when(~event, F.coalesce("after", "later"))).alias("exit"))


def last_refresh(requests: DataFrame, resolved: DataFrame, ttl_s: int, slots: int = 1 << 16) -> DataFrame:
    """(credential, refreshed_at): when the cache was last filled before the authority ended.

    A credential's live interval is contiguous, so while it lasts every miss refills the cache: the first request at
    or after the end of the last fill. That chain is followed by doubling: time is cut into cells, at first of one
    `ttl`, and every time at which the chain may enter a cell knows its last fill there (`leave`) and the entry of a
    later cell that follows (`exit`). Each round joins neighbouring cells, by equality on (credential, time), and keeps
    the entries of the wider cells only: about half as many, so all rounds together cost about as much as the first,
    and a busy credential is spread over all tasks.
    """
    if ttl_s <= 0:
        raise ValueError("a cache has to keep its entries for a time")
    ttl = ttl_s * US
    live = _with_scope(requests, resolved).filter(live_at(F.col("event_ts")))
    times = stage(live.select(F.struct(*CREDENTIAL).alias("c"), F.unix_micros("event_ts").alias("t")).distinct())
    lo, hi = times.agg(F.min("t"), F.max("t")).first()
    if lo is None:
        return live.select(*CREDENTIAL, F.col("event_ts").alias("refreshed_at"))
    nodes, cell = stage(_reach(times, lo, hi, ttl, slots).withColumn("leave", F.col("t"))), ttl
    while cell <= hi - lo:
        cell *= 2
        start = lambda c: F.col(c) - (F.col(c) - lo) % cell  # noqa: B023, E731
        stays = F.coalesce(start("exit") == start("t"), F.lit(False))
        onward = nodes.select(F.col("c").alias("_c"), F.col("t").alias("_t"), F.col("leave").alias("_leave"), F.col("exit").alias("_exit"))
        entry = nodes.filter(F.col("prev").isNull() | (F.col("prev") < start("t") + ttl))
        moved = entry.filter(stays).join(onward, (F.col("c") == F.col("_c")) & (F.col("exit") == F.col("_t"))).select(
            "c", "t", "prev", F.col("_exit").alias("exit"), F.col("_leave").alias("leave"))
        nodes = stage(moved.unionByName(entry.filter(~stays)))
    return nodes.filter(F.col("prev").isNull()).select("c.*", F.timestamp_micros("leave").alias("refreshed_at"))


def replay_cache(requests: DataFrame, resolved: DataFrame, ttl_s: int, slots: int = 1 << 16) -> DataFrame:
    """Requests with `allowed` under an authorisation cache: filled on a miss, kept `ttl_s`, dropped on a refusal.

    While the authority lives every request is allowed, hit or miss; once it has ended only what is left of the
    last fill is.
    """
    fills = last_refresh(requests, resolved, ttl_s, slots)
    df = lookup_join(_with_scope(requests, resolved), fills, CREDENTIAL, "left", null_safe=["delegation_id"])
    cached = (F.col("event_ts") >= F.col("closes_at")) & (
        F.unix_micros("event_ts") < F.unix_micros("refreshed_at") + F.lit(ttl_s * US)
    )
    allowed = F.coalesce(live_at(F.col("event_ts")), F.lit(False)) | F.coalesce(cached, F.lit(False))
    return df.withColumn("allowed", allowed).drop("opens_at", "closes_at", "refreshed_at")


def replay_token(requests: DataFrame, expiry: str = "token_exp") -> DataFrame:
    """Requests with `allowed` where only the token's own expiry is checked."""
    return requests.withColumn("allowed", F.coalesce(F.col("event_ts") < F.col(expiry), F.lit(False)))


def token_scope(delegations: DataFrame, grants: DataFrame) -> DataFrame:
    """Scope a token-only check serves: the delegation's regions under the grant's ceiling, dead or not."""
    g = grants.select("grant_id", "provider_org", "grantee_org", "max_classification")
    d = delegations.select("delegation_id", "grant_id", F.col("region_scope"))
    return lookup_join(d, g, ["grant_id"])


def replay_inflight(requests: DataFrame, resolved: DataFrame, end: str = "end_ts") -> DataFrame:
    """Requests that were running when their authority was revoked: they started before and end after it."""
    keep = resolved.filter(F.col("revoked_at").isNotNull()).select(*CREDENTIAL, "opens_at", "closes_at", "revoked_at")
    df = lookup_join(requests, keep, CREDENTIAL, null_safe=["delegation_id"])
    running = (F.col("event_ts") < F.col("revoked_at")) & (F.col(end) >= F.col("revoked_at"))
    return df.filter(live_at(F.col("event_ts")) & running).drop("opens_at", "closes_at")


def revocations(resolved: DataFrame) -> DataFrame:
    """(credential, revoked_at) for credentials that were live when they were revoked."""
    return resolved.filter(
        (F.col("revoked_at") == F.col("closes_at")) & (F.col("opens_at") < F.col("revoked_at"))
    ).select(*CREDENTIAL, "revoked_at")


def first_denial(judged: DataFrame, revoked: DataFrame, max_wait_s: int, by: Sequence[str] = ()) -> DataFrame:
    """Per revoked credential: when it first got nothing (refused or empty) after the revocation, if within the wait.

    `judged` carries `allowed` and `n_rows`. Several ways of checking are measured in one pass when both sides carry
    the columns `by`.
    """
    key = [*by, *CREDENTIAL]
    after = lookup_join(judged, revoked, key, null_safe=["delegation_id"]).filter(
        F.col("event_ts") >= F.col("revoked_at")
    )
    nothing = ~F.col("allowed") | (F.coalesce("n_rows", F.lit(0)) == 0)
    halts = after.groupBy(*key).agg(F.min(F.when(nothing, F.col("event_ts"))).alias("halted_at"))
    df = lookup_join(revoked, halts, key, "left", null_safe=["delegation_id"])
    wait = (F.unix_micros("halted_at") - F.unix_micros("revoked_at")) / F.lit(float(US))
    return df.withColumn("halt_latency_s", F.least(F.coalesce(wait, F.lit(float(max_wait_s))), F.lit(float(max_wait_s))))


def until_halt(judged: DataFrame, halts: DataFrame, max_wait_s: int, by: Sequence[str] = ()) -> DataFrame:
    """Per revoked credential: rows served and requests made from the revocation until the halt."""
    key = [*by, *CREDENTIAL]
    df = lookup_join(judged, halts.select(*key, "revoked_at", "halted_at"), key, null_safe=["delegation_id"])
    in_wait = (F.col("event_ts") >= F.col("revoked_at")) & (
        F.unix_micros("event_ts") - F.unix_micros("revoked_at") < F.lit(max_wait_s * US)
    )
    before = F.coalesce(F.col("event_ts") < F.col("halted_at"), F.lit(True))
    upto = F.coalesce(F.col("event_ts") <= F.col("halted_at"), F.lit(True))
    agg = df.filter(in_wait & upto).groupBy(*key).agg(
        F.sum(F.when(before & F.col("allowed"), F.coalesce("n_rows", F.lit(0))).otherwise(0)).alias("rows_after"),
        F.count(F.lit(1)).alias("requests_after"),
    )
    out = lookup_join(halts, agg, key, "left", null_safe=["delegation_id"])
    return out.withColumn("rows_after", F.coalesce("rows_after", F.lit(0)).cast("long")).withColumn(
        "requests_after", F.coalesce("requests_after", F.lit(0)).cast("long")
    )


def mode_summary(trials: DataFrame, bound: Column | str = "bound_s", by: str = "mode") -> DataFrame:
    """Latency and damage per mode, against the declared bound.

    The mean is taken over whole microseconds, so that it does not hang on the order of rows; ties go to the even digit.
    """
    bound = F.col(bound) if isinstance(bound, str) else bound
    inside = F.col("halt_latency_s") <= bound
    mean = F.sum(F.round(F.col("halt_latency_s") * US).cast("long")) / F.count("halt_latency_s") / F.lit(float(US))
    return trials.groupBy(by).agg(
        F.count(F.lit(1)).alias("trials"), F.max(bound).alias("declared_bound_s"),
        F.bround(mean, 4).alias("halt_mean_s"), F.round(F.max("halt_latency_s"), 4).alias("halt_max_s"),
        F.max("rows_after").alias("rows_after_max"), F.round(F.avg("rows_after"), 2).alias("rows_after_mean"),
        F.count_if(inside).alias("n_within"), F.bool_and(inside).alias("all_within"),
    )
