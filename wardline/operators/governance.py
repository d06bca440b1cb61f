"""Checks and state changes over batches of governance commands.

Every function takes the current state as DataFrames and a batch of commands, and returns the judged commands
or the next state. Commands carry `cmd_id`, which fixes their order inside a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalars import grant_live, is_subset
from wardline.operators.auth import live_at, resolve
from wardline.plans.placement import lookup_join, stage


def _first_failing(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that is true; a rule that is NULL does not fail."""
    out = F.when(rules[0][1], rules[0][0])
    for name, broken in rules[1:]:
        out = out.when(broken, name)
    return out


# --- grants ----------------------------------------------------------------
def check_grants(proposals: DataFrame, principals: DataFrame) -> DataFrame:
    """Add `reason` (NULL when acceptable): a grant goes to a known human."""
    kinds = principals.select(F.col("principal_id").alias("grantee_principal"), F.col("kind").alias("__kind"))
    return (
        lookup_join(proposals, kinds, ["grantee_principal"], "left")
        .withColumn(
            "reason",
            _first_failing(
                ("grantee_unknown", F.col("__kind").isNull()), ("grantee_not_human", F.col("__kind") != "human")
            ),
        )
        .drop("__kind")
    )


def request_grants(grants: DataFrame, proposals: DataFrame, principals: DataFrame) -> DataFrame:
    """State after acceptable proposals enter unapproved."""
    accepted = check_grants(proposals, principals).filter(F.col("reason").isNull()).drop("reason")
    fresh = accepted.select(
        *[F.lit(None).cast(grants.schema[c].dataType).alias(c)
          if c in ("approved_at", "approved_by", "revoked_at", "revoked_reason") else F.col(c) for c in grants.columns]
    )
    return grants.unionByName(fresh)


def check_approvals(commands: DataFrame, grants: DataFrame, principals: DataFrame) -> DataFrame:
    """Commands (cmd_id, grant_id, approver) with `reason` and the grant's two organisations."""
    known = grants.select("grant_id", "provider_org", "grantee_org", F.lit(True).alias("__known"))
    people = principals.select(
        F.col("principal_id").alias("approver"), F.col("kind").alias("__kind"), F.col("org_id").alias("__org")
    )
    df = lookup_join(commands, known, ["grant_id"], "left")
    df = lookup_join(df, people, ["approver"], "left")
    return df.withColumn(
        "reason",
        _first_failing(
            ("grant_unknown", F.col("__known").isNull()),
            ("approver_not_human", ~F.col("__kind").eqNullSafe(F.lit("human"))),
            ("approver_other_org", ~F.col("__org").eqNullSafe(F.col("provider_org"))),
        ),
    ).drop("__known", "__kind", "__org")


def approve(commands: DataFrame, grants: DataFrame, principals: DataFrame, at: Column) -> DataFrame:
    """Grants after the acceptable approvals; of several for one grant the last by `cmd_id` stands."""
    ok = check_approvals(commands, grants, principals).filter(F.col("reason").isNull())
    last = ok.groupBy("grant_id").agg(F.max_by("approver", "cmd_id").alias("__by"))
    return lookup_join(grants, last, ["grant_id"], "left").select(
        *[c for c in grants.columns if c not in ("approved_at", "approved_by")],
        F.when(F.col("__by").isNotNull(), at).otherwise(F.col("approved_at")).alias("approved_at"),
        F.coalesce("__by", "approved_by").alias("approved_by"),
    )


def _first_command(commands: DataFrame, key: str) -> DataFrame:
    return commands.groupBy(key).agg(F.min_by("reason", "cmd_id").alias("__reason"))


def _set_revoked(state: DataFrame, commands: DataFrame, key: str, at: Column) -> DataFrame:
    hit = _first_command(commands.filter(F.col(key).isNotNull()), key).withColumn("__hit", F.lit(True))
    now = F.col("__hit").isNotNull() & F.col("revoked_at").isNull()
    return lookup_join(state, hit, [key], "left").select(
        *[c for c in state.columns if c not in ("revoked_at", "revoked_reason")],
        F.when(now, at).otherwise(F.col("revoked_at")).alias("revoked_at"),
        F.when(now, F.col("__reason")).otherwise(F.col("revoked_reason")).alias("revoked_reason"),
    )


def revoke_grants(commands: DataFrame, grants: DataFrame, at: Column) -> DataFrame:
    """Grants after (cmd_id, grant_id, actor, reason) commands; an earlier revocation keeps its time and reason."""
    return _set_revoked(grants, commands, "grant_id", at)


def revoke_delegations(commands: DataFrame, delegations: DataFrame, at: Column) -> DataFrame:
    return _set_revoked(delegations, commands, "delegation_id", at)


def change_events(commands: DataFrame, grants: DataFrame, action: str, delegations: DataFrame | None = None) -> DataFrame:
    """One audit event per accepted command, also where nothing changed. Unknown targets give none."""
    orgs = grants.select("grant_id", "provider_org", "grantee_org")
    if delegations is not None:
        held = delegations.select("delegation_id", "grant_id", F.col("delegator").alias("acting_for"))
        commands = lookup_join(commands, held, ["delegation_id"])
    else:
        commands = commands.withColumn("acting_for", F.lit(None).cast("string")).withColumn(
            "delegation_id", F.lit(None).cast("string")
        )
    df = lookup_join(commands, orgs, ["grant_id"])
    detail = {
        "grant.approve": F.struct("grant_id", F.col("actor").alias("approver")),
        "grant.revoke": F.struct("grant_id", "reason"),
        "delegation.revoke": F.struct("delegation_id", "reason"),
    }[action]
    return df.select(
        "cmd_id", F.col("actor").alias("subject"), "acting_for", "grant_id", "delegation_id", "provider_org",
        "grantee_org", F.lit(action).alias("action"),
        F.lit("delegation" if delegations is not None else "data_grant").alias("resource"),
        F.to_json(detail).alias("request"), F.lit("allow").alias("decision"), F.lit(1).cast("long").alias("row_count"),
    )


# --- delegations -----------------------------------------------------------
def rule_context(proposals: DataFrame, grants: DataFrame, parents: DataFrame, principals: DataFrame) -> DataFrame:
    """Proposals with their grant, their parent and the kind of their delegatee alongside."""
    g = grants.select(
        "grant_id", F.col("grantee_principal").alias("g_holder"), F.col("region_scope").alias("g_regions"),
        F.col("allow_cost").alias("g_cost"), F.col("allow_contact").alias("g_contact"),
        F.col("expires_at").alias("g_expires"),
    )
    p = parents.select(
        F.col("delegation_id").alias("parent_delegation"), F.col("delegatee").alias("p_holder"),
        F.col("depth").alias("p_depth"), F.col("grant_id").alias("p_grant"), F.col("region_scope").alias("p_regions"),
        F.col("allow_cost").alias("p_cost"), F.col("allow_contact").alias("p_contact"),
        F.col("expires_at").alias("p_expires"), F.lit(True).alias("p_found"),
    )
    k = principals.select(F.col("principal_id").alias("delegatee"), F.col("kind").alias("delegatee_kind"))
    df = lookup_join(proposals, g, ["grant_id"], "left")
    df = lookup_join(df, p, ["parent_delegation"], "left")
    return lookup_join(df, k, ["delegatee"], "left")


def delegation_reason() -> Column:
    """First creation rule a proposal breaks, over the columns of `rule_context`; NULL when it may be created."""
    first, deeper = F.col("depth") == 1, F.col("depth") > 1
    wider = lambda own, limit: F.col(own) & ~F.col(limit)
    return _first_failing(
        ("grant_unknown", F.col("g_holder").isNull()),
        ("delegatee_unknown", F.col("delegatee_kind").isNull()),
        ("delegatee_not_agent", F.col("delegatee_kind") != "agent"),
        ("delegator_not_grantee", first & (F.col("delegator") != F.col("g_holder"))),
        ("first_hop_with_parent", first & F.col("parent_delegation").isNotNull()),
        ("parent_required", deeper & F.col("parent_delegation").isNull()),
        ("parent_unknown", deeper & F.col("p_found").isNull()),
        ("delegator_not_parent_holder", deeper & (F.col("p_holder") != F.col("delegator"))),
        ("depth_step", deeper & (F.col("p_depth") != F.col("depth") - 1)),
        ("parent_other_grant", deeper & (F.col("p_grant") != F.col("grant_id"))),
        ("regions_exceed_parent", deeper & ~is_subset("region_scope", "p_regions")),
        ("columns_exceed_parent", deeper & (wider("allow_cost", "p_cost") | wider("allow_contact", "p_contact"))),
        ("outlives_parent", deeper & (F.col("expires_at") > F.col("p_expires"))),
        ("regions_exceed_grant", ~is_subset("region_scope", "g_regions")),
        ("columns_exceed_grant", wider("allow_cost", "g_cost") | wider("allow_contact", "g_contact")),
        ("outlives_grant", F.col("expires_at") > F.col("g_expires")),
        ("depth_out_of_range", ~F.col("depth").between(1, 3)),
    )


def check_delegations(proposals: DataFrame, grants: DataFrame, parents: DataFrame, principals: DataFrame) -> DataFrame:
    """Proposals with `reason`; parents are looked up in `parents`."""
    context = rule_context(proposals, grants, parents, principals).withColumn("reason", delegation_reason())
    return context.select(*proposals.columns, "reason")


def create_delegations(
    proposals: DataFrame, grants: DataFrame, existing: DataFrame | None, principals: DataFrame
) -> DataFrame:
    """Judge a batch whose rows may be each other's parents: depth 1, then 2, then 3.

    A parent counts only if it already stands or was accepted in an earlier pass, so a child of a refused row is
    refused too.
    """
    standing = existing if existing is not None else proposals.limit(0)
    judged = None
    for depth in (1, 2, 3):
        batch = proposals.filter(F.col("depth") == depth)
        result = stage(check_delegations(batch, grants, standing, principals))  # each pass builds on the last
        judged = result if judged is None else judged.unionByName(result)
        standing = standing.unionByName(result.filter(F.col("reason").isNull()).select(*standing.columns))
    other = proposals.filter(~F.col("depth").between(1, 3) | F.col("depth").isNull())
    return judged.unionByName(other.withColumn("reason", F.lit("depth_out_of_range")))


def cascade(
    commands: DataFrame, grants: DataFrame, delegations: DataFrame, principals: DataFrame, as_of: Column
) -> DataFrame:
    """(cmd_id, delegation_id): live delegations each command kills.

    A command is (cmd_id, kind, target) with kind grant, delegation or principal. Live is what `resolve` says of the
    delegatee's own credential. Such a delegation is unnested into the few things its life depends on: its grant, the
    grantee, every delegation of its chain and its delegatee. These meet the commands by equality.
    """
    own = delegations.select(F.col("delegatee").alias("subject"), "grant_id", "delegation_id")
    live = stage(resolve(own, grants, delegations, principals).filter(live_at(as_of)).select(
        "grant_id", "delegation_id", "acting_for", "chain"))
    needs = lambda df, kind, target: df.select("delegation_id", F.lit(kind).alias("kind"), F.col(target).alias("target"))
    hops = live.select("delegation_id", F.explode("chain").alias("__hop"))
    people = lookup_join(hops, delegations.select(F.col("delegation_id").alias("__hop"), "delegatee"), ["__hop"])
    depends = needs(hops, "delegation", "__hop").unionByName(needs(people, "principal", "delegatee")).unionByName(
        needs(live, "principal", "acting_for")).unionByName(needs(live, "grant", "grant_id"))
    hits = lookup_join(depends, commands.select("cmd_id", "kind", "target"), ["kind", "target"])
    return hits.select("cmd_id", "delegation_id").distinct()


# --- principals and listings -----------------------------------------------
def toggle(commands: DataFrame, principals: DataFrame, at: Column) -> DataFrame:
    """Principals after (cmd_id, principal_id, enable) commands; the last one per principal stands."""
    last = commands.groupBy("principal_id").agg(F.max_by("enable", "cmd_id").alias("__enable"))
    return lookup_join(principals, last, ["principal_id"], "left").withColumn(
        "disabled_at",
        F.when(F.col("__enable"), F.lit(None).cast("timestamp"))
        .when(~F.col("__enable"), at)
        .otherwise(F.col("disabled_at")),
    ).drop("__enable")


def list_grants(grants: DataFrame, as_of: Column) -> DataFrame:
    return grants.select(
        "grant_id", "provider_org", "grantee_org", "grantee_principal", F.array_join("region_scope", ",").alias("regions"),
        "max_classification", "allow_cost", "allow_contact", "approved_by",
        F.date_format("expires_at", "yyyy-MM-dd").alias("expires"),
        grant_live("approved_at", "revoked_at", "expires_at", as_of).alias("live"),
    ).orderBy("grant_id")


def list_delegations(delegations: DataFrame) -> DataFrame:
    return delegations.select(
        "delegation_id", "grant_id", "delegator", "delegatee", "depth", "parent_delegation",
        F.array_join("region_scope", ",").alias("regions"), "allow_cost", F.substring("purpose", 1, 28).alias("purpose"),
        F.date_format("expires_at", "MM-dd HH:mm").alias("expires"), F.col("revoked_at").isNotNull().alias("revoked"),
    ).orderBy("grant_id", "depth", "delegation_id")


def review(grants: DataFrame, delegations: DataFrame, principals: DataFrame, as_of: Column, horizon_days: int) -> DataFrame:
    """(finding, item): live grants that carry personal data, live delegations that run far past `as_of`, and
    grants whose holder is not of the organisation they name."""
    live = grants.filter(grant_live("approved_at", "revoked_at", "expires_at", as_of))
    personal = live.filter("allow_contact").select(F.lit("contact_on").alias("finding"), F.col("grant_id").alias("item"))
    far = delegations.filter(
        (F.col("expires_at") > as_of + F.make_dt_interval(F.lit(horizon_days)))
        & F.coalesce(F.col("revoked_at") > as_of, F.lit(True))
    ).select(F.lit("expiry_far_out").alias("finding"), F.col("delegation_id").alias("item"))
    home = principals.select(F.col("principal_id").alias("grantee_principal"), F.col("org_id").alias("__home"))
    stray = lookup_join(live, home, ["grantee_principal"], "left").filter(
        ~F.col("__home").eqNullSafe(F.col("grantee_org"))
    ).select(F.lit("grantee_elsewhere").alias("finding"), F.col("grant_id").alias("item"))
    return personal.unionByName(far).unionByName(stray)
