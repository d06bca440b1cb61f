"""Registration of queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.oracle import AS_OF, with_prelude
from wardline.operators import audit, auth, credentials, guard
from wardline.plans.placement import stage
from wardline.sources.derived import PRESENTED, Derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


CLAIM_FIELDS = ["sub", "act_as", "grant_id", "delegation_id", "exp", "jti", "chain", "kid"]


class Context(Derived):
    """Frames the queries share, each built at most once per query."""

    as_of = property(lambda self: F.lit(AS_OF).cast("timestamp"))

    @cached_property
    def presented(self) -> DataFrame:
        return auth.credentials_of(self.requests)

    @cached_property
    def resolved(self) -> DataFrame:
        """Written once, so that everything in one query sees the same authorisations and knows their size."""
        return stage(auth.resolve(self.presented, self.grants, self.delegations, self.principals))

    @cached_property
    def auths(self) -> DataFrame:
        """Scope of every presented credential at the fixed time."""
        return guard.with_auth_id(self.resolved.filter(auth.live_at(self.as_of)))

    @cached_property
    def guarded(self) -> DataFrame:
        return guard.guarded(self.shipments, self.auths)

    @cached_property
    def tokens(self) -> DataFrame:
        """Presented tokens, some of them damaged or forged."""
        signed = credentials.sign_claims(self.claims, self.keys, CLAIM_FIELDS, kid="sign_kid")
        return signed.select("request_id", "event_ts", F.expr(PRESENTED).alias("token"))

    @cached_property
    def verified(self) -> DataFrame:
        return credentials.verify_tokens(self.tokens, self.keys, F.col("event_ts"))

    @cached_property
    def audit_tokens(self) -> DataFrame:
        signed = credentials.sign_claims(self.audit_claims, self.keys, ["sub", "audit_org", "exp"])
        return signed.select(F.col("sub").alias("holder"), "token")

    @cached_property
    def viewers(self) -> DataFrame:
        return credentials.viewer_orgs(self.audit_tokens, self.keys, self.principals, self.as_of)

    @cached_property
    def suspect_events(self) -> DataFrame:
        """The trail with some reads filed under a neighbouring grant: what reconciliation must find."""
        moved = F.concat(F.lit("g-"), (F.substring("grant_id", 3, 20).cast("long") + 3).cast("string"))
        return self.events.withColumn("grant_id", F.when(F.col("seq") % 7 == 5, moved).otherwise(F.col("grant_id")))

    @cached_property
    def judged_reads(self) -> DataFrame:
        asked = F.to_json(F.struct(
            "columns", F.lit("units = :k").alias("where"), F.get_json_object("request", "$.k").try_cast("long").alias("k")))
        return audit.judged_reads(self.requests.withColumn("asked", asked), self.resolved)

    @cached_property
    def served_rows(self) -> DataFrame:
        return audit.served_rows(self.judged_reads, self.shipments)

    @cached_property
    def served_chunks(self) -> DataFrame:
        """The rows of every served set as they are stored, written once."""
        return stage(audit.chunked(self.served_rows, ["set_id"]))

    @cached_property
    def events(self) -> DataFrame:
        return audit.read_events(self.judged_reads, audit.set_headers(self.served_rows))


def query(name: str, sql: str | None = None):
    """Register a query under `name`; `sql` may use every CTE of the prelude."""

    def register(fn: Callable[[Context], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Context(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_prelude(sql)
        return fn

    return register
