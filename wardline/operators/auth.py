"""Resolving credentials to their effective scope.

A credential is a distinct (subject, grant_id, delegation_id). It is resolved once, however many requests
present it, into its scope and the half-open interval [opens_at, closes_at) in which it is live. Judging a
request at its own time is then an equality join plus an interval test: no request is ever joined to the
delegation chain itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalars import scope_intersect
from wardline.plans.placement import lookup_join, stage

CREDENTIAL = ["subject", "grant_id", "delegation_id"]
MAX_DEPTH = 3  # fixed value: longest chain the creation rules allow
WALK_HOPS = 8  # fixed value: most ancestors followed on unchecked data
NO_AUTH = "no_live_authorization"  # fixed value: reason stored with a refusal

SCOPE = [
    "acting_for", "provider_org", "grantee_org", "region_scope", "max_classification", "allow_cost",
    "allow_contact", "chain_depth", "opens_at", "closes_at",
]


def chain_walk(delegations: DataFrame, max_hops: int = WALK_HOPS) -> DataFrame:
    """(leaf_id, hop, delegation_id): every delegation's ancestors, itself at hop 0, at most `max_hops` up.

    A cycle stops at the hop limit. Only rows with a parent go into a level's join, and the walk ends when none has one;
    the path rides along as an array of at most `max_hops + 1` ids and is unnested once at the end.
    """
    links = delegations.select(F.col("delegation_id").alias("__id"), F.col("parent_delegation").alias("__up"))
    walk = delegations.select(
        F.col("delegation_id").alias("leaf_id"), F.array("delegation_id").alias("path"),
        F.col("parent_delegation").alias("up"),
    )

    def climb(rows: DataFrame) -> DataFrame:
        return rows.join(links, F.col("up") == F.col("__id"), "left").select(
            "leaf_id",
            F.when(F.col("__id").isNull(), F.col("path")).otherwise(F.concat("path", F.array("__id"))).alias("path"),
            F.col("__up").alias("up"),
        )

    return _levels(walk, climb, max_hops).select("leaf_id", F.posexplode("path").alias("hop", "delegation_id"))


def _levels(rows: DataFrame, climb: Callable[[DataFrame], DataFrame], max_hops: int) -> DataFrame:
    """Climb with the rows that still have an `up`, at most `max_hops` times; those without one are done and stay aside."""
    done, rows = rows.filter(F.col("up").isNull()), rows.filter(F.col("up").isNotNull())
    for _ in range(max_hops):
        rows = stage(climb(rows))
        done = done.unionByName(rows.filter(F.col("up").isNull()))
        rows = rows.filter(F.col("up").isNotNull())
        if rows.isEmpty():
            return done
    return done.unionByName(rows)


def hop_facts(delegations: DataFrame, principals: DataFrame) -> DataFrame:
    """Delegations with the time their delegatee was disabled."""
    disabled = principals.filter(F.col("disabled_at").isNotNull()).select(
        F.col("principal_id").alias("delegatee"), "disabled_at"
    )
    return delegations.join(disabled, "delegatee", "left")


def chain_facts(delegations: DataFrame, principals: DataFrame, max_hops: int = WALK_HOPS) -> DataFrame:
    """Per delegation, everything its chain to the root says: scope, times, and whether it hangs together."""
    hops = stage(hop_facts(delegations, principals))  # read once per level below
    up = hops.select(
        F.col("delegation_id").alias("u_id"), F.col("grant_id").alias("u_grant"), F.col("delegator").alias("u_delegator"),
        F.col("depth").alias("u_depth"), F.col("parent_delegation").alias("u_parent"),
        F.col("region_scope").alias("u_regions"), F.col("allow_cost").alias("u_cost"),
        F.col("allow_contact").alias("u_contact"), F.col("created_at").alias("u_created"),
        F.least("expires_at", "revoked_at").alias("u_closes"), F.col("disabled_at").alias("u_disabled"),
        F.col("revoked_at").alias("u_revoked"),
    )
    chain = hops.select(
        "delegation_id", F.col("grant_id").alias("d_grant"), "delegatee", F.col("depth").alias("leaf_depth"),
        F.array("delegation_id").alias("chain"), F.array_distinct("region_scope").alias("regions"),
        F.col("allow_cost").alias("cost"), F.col("allow_contact").alias("contact"),
        F.col("created_at").alias("chain_created"), F.least("expires_at", "revoked_at").alias("leaf_closes"),
        F.col("disabled_at").alias("leaf_disabled"), F.col("revoked_at").alias("chain_revoked"),
        F.col("delegator").alias("root_delegator"), F.col("depth").alias("root_depth"),
        F.lit(None).cast("timestamp").alias("anc_closes"), F.lit(None).cast("timestamp").alias("mid_disabled"),
        F.lit(False).alias("anc_missing"), F.lit(False).alias("anc_other_grant"),
        F.col("parent_delegation").alias("up"),
    )

    def climb(rows: DataFrame) -> DataFrame:
        found = F.col("u_id").isNotNull()
        return rows.join(up, F.col("up") == F.col("u_id"), "left").select(
            "delegation_id", "d_grant", "delegatee", "leaf_depth",
            F.when(found, F.concat("chain", F.array("u_id"))).otherwise(F.col("chain")).alias("chain"),
            F.when(found, scope_intersect("regions", "u_regions")).otherwise(F.col("regions")).alias("regions"),
            (F.col("cost") & F.coalesce("u_cost", F.lit(True))).alias("cost"),
            (F.col("contact") & F.coalesce("u_contact", F.lit(True))).alias("contact"),
            F.greatest("chain_created", "u_created").alias("chain_created"),
            "leaf_closes", "leaf_disabled", F.least("chain_revoked", "u_revoked").alias("chain_revoked"),
            F.coalesce("u_delegator", "root_delegator").alias("root_delegator"),
            F.coalesce("u_depth", "root_depth").alias("root_depth"),
            F.least("anc_closes", "u_closes").alias("anc_closes"),
            F.least("mid_disabled", "u_disabled").alias("mid_disabled"),
            (F.col("anc_missing") | (F.col("up").isNotNull() & ~found)).alias("anc_missing"),
            (F.col("anc_other_grant") | F.coalesce(F.col("u_grant") != F.col("d_grant"), F.lit(False))).alias(
                "anc_other_grant"
            ),
            F.col("u_parent").alias("up"),
        )

    return _levels(chain, climb, max_hops).withColumn("anc_too_deep", F.col("up").isNotNull()).drop("up")


def credentials_of(requests: DataFrame) -> DataFrame:
    """Distinct credentials presented. The partial distinct runs before the shuffle, so a credential that
    makes a third of all requests costs one row per input task."""
    return requests.select(*CREDENTIAL).distinct()


def credential_facts(
    credentials: DataFrame, grants: DataFrame, delegations: DataFrame, principals: DataFrame,
    max_hops: int = WALK_HOPS,
) -> DataFrame:
    """One row per credential whose grant exists, with every fact a decision needs."""
    granted = grants.select(
        "grant_id", "provider_org", "grantee_org", "grantee_principal", F.col("region_scope").alias("g_regions"),
        "max_classification", F.col("allow_cost").alias("g_cost"), F.col("allow_contact").alias("g_contact"),
        F.col("approved_at").alias("g_approved"), F.col("expires_at").alias("g_expires"),
        F.col("revoked_at").alias("g_revoked"),
    )
    holder = principals.filter(F.col("disabled_at").isNotNull()).select(
        F.col("principal_id").alias("grantee_principal"), F.col("disabled_at").alias("grantee_disabled")
    )
    facts = credentials.select(*CREDENTIAL).join(granted.join(holder, "grantee_principal", "left"), "grant_id")
    chains = stage(chain_facts(delegations, principals, max_hops))
    # A direct credential has no chain: it stays out of the join, where all of these would meet under one NULL key.
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in chains.schema if f.name != "delegation_id"]
    direct = facts.filter(F.col("delegation_id").isNull()).select("*", *none)
    return direct.unionByName(facts.filter(F.col("delegation_id").isNotNull()).join(chains, "delegation_id", "left"))


def _direct() -> Column:
    return F.col("delegation_id").isNull()


def _fits(every_hop: bool) -> Column:
    """Rules that do not depend on time."""
    direct = F.col("subject") == F.col("grantee_principal")
    delegated = (
        F.col("d_grant").isNotNull() & (F.col("d_grant") == F.col("grant_id"))
        & F.col("delegatee").eqNullSafe(F.col("subject"))
        & ~F.col("anc_missing") & ~F.col("anc_too_deep") & ~F.col("anc_other_grant")
        & (F.col("root_delegator") == F.col("grantee_principal")) & (F.col("root_depth") == 1)
    )
    return F.col("g_approved").isNotNull() & F.when(_direct(), direct).otherwise(delegated)


def resolve(
    credentials: DataFrame, grants: DataFrame, delegations: DataFrame, principals: DataFrame,
    *, every_hop_disabled: bool = True, max_hops: int = WALK_HOPS,
) -> DataFrame:
    """Credentials that are ever live, with scope, chain and live interval.

    `every_hop_disabled=False` checks only the grantee and the two ends of the chain for disabled principals.
    """
    facts = credential_facts(credentials, grants, delegations, principals, max_hops).filter(_fits(every_hop_disabled))
    ends = ["g_expires", "g_revoked", "grantee_disabled", "leaf_closes", "anc_closes", "leaf_disabled"]
    ends += ["mid_disabled"] if every_hop_disabled else []
    both = lambda g, d: F.when(_direct(), F.col(g)).otherwise(F.col(g) & F.col(d))
    return facts.select(
        *CREDENTIAL, F.col("grantee_principal").alias("acting_for"), "provider_org", "grantee_org",
        F.when(_direct(), F.array_distinct("g_regions")).otherwise(scope_intersect("regions", "g_regions")).alias(
            "region_scope"
        ),
        "max_classification", both("g_cost", "cost").alias("allow_cost"),
        both("g_contact", "contact").alias("allow_contact"),
        F.when(_direct(), F.lit(0)).otherwise(F.col("leaf_depth")).alias("chain_depth"),
        F.greatest("g_approved", "chain_created").alias("opens_at"), F.least(*ends).alias("closes_at"),
        F.coalesce("chain", F.array().cast("array<string>")).alias("chain"),
        F.least("g_revoked", "chain_revoked").alias("revoked_at"),
    )


def live_at(at: Column) -> Column:
    """Interval test; an open end never closes."""
    return (F.col("opens_at") <= at) & F.coalesce(F.col("closes_at") > at, F.lit(True))


def current_auth(credentials, grants, delegations, principals, as_of: Column, **rules) -> DataFrame:
    """Zero or one row per credential: its scope at `as_of`."""
    return resolve(credentials, grants, delegations, principals, **rules).filter(live_at(as_of))


def judge(requests: DataFrame, resolved: DataFrame, at: str = "event_ts") -> DataFrame:
    """Every request with its authorisation at its own time, or NULL scope and a refusal reason.

    The resolved side has one row per credential, so the left join cannot multiply requests.
    """
    scope = resolved.select(*CREDENTIAL, *[c for c in resolved.columns if c not in CREDENTIAL])
    joined = lookup_join(requests, scope, CREDENTIAL, "left", null_safe=["delegation_id"])
    ok = F.coalesce(F.col("provider_org").isNotNull() & live_at(F.col(at)), F.lit(False))
    blank = [F.when(F.col("__ok"), F.col(c)).alias(c) for c in scope.columns if c not in CREDENTIAL]
    return joined.withColumn("__ok", ok).select(
        *requests.columns, *blank,
        F.when(F.col("__ok"), "allow").otherwise("deny").alias("decision"),
        F.when(~F.col("__ok"), NO_AUTH).alias("deny_reason"),
    )


def denied(requests: DataFrame, resolved: DataFrame, at: str = "event_ts") -> DataFrame:
    """Requests with no live authorisation (an anti join on credential and interval)."""
    return judge(requests, resolved, at).filter(F.col("decision") == "deny")


def explain_outcomes(
    requests: DataFrame, grants: DataFrame, delegations: DataFrame, principals: DataFrame, at: str = "event_ts"
) -> DataFrame:
    """First rule that refuses each request, for operators; the caller only ever learns `NO_AUTH`."""
    facts = credential_facts(credentials_of(requests), grants, delegations, principals)
    df = lookup_join(requests, facts, CREDENTIAL, "left", null_safe=["delegation_id"])
    t = F.col(at)
    gone = lambda c: F.coalesce(F.col(c) <= t, F.lit(False))
    direct = F.col("delegation_id").isNull()
    rules = [
        ("grant_unknown", F.col("provider_org").isNull()),
        ("grant_unapproved", ~F.coalesce(F.col("g_approved") <= t, F.lit(False))),
        ("grant_revoked", gone("g_revoked")),
        ("grant_expired", gone("g_expires")),
        ("subject_not_grantee", direct & (F.col("subject") != F.col("grantee_principal"))),
        ("grantee_disabled", direct & gone("grantee_disabled")),
        ("allow_direct", direct),
        ("leaf_unknown", F.col("d_grant").isNull()),
        ("leaf_other_grant", F.col("d_grant") != F.col("grant_id")),
        ("subject_not_delegatee", ~F.col("delegatee").eqNullSafe(F.col("subject"))),
        ("leaf_dead", gone("leaf_closes")),
        ("ancestor_missing", F.col("anc_missing")),
        ("ancestor_dead", gone("anc_closes")),
        ("ancestor_other_grant", F.col("anc_other_grant")),
        ("chain_too_deep", F.col("anc_too_deep")),
        ("root_not_grantee", (F.col("root_delegator") != F.col("grantee_principal")) | (F.col("root_depth") != 1)),
        ("chain_grantee_disabled", gone("grantee_disabled")),
        ("leaf_disabled", gone("leaf_disabled")),
        ("middle_disabled", gone("mid_disabled")),
    ]
    outcome = reduce(lambda acc, r: acc.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0]))
    outcome = outcome.otherwise(F.concat(F.lit("allow_depth_"), F.col("leaf_depth").cast("string")))
    return df.select(*requests.columns, outcome.alias("outcome"))
