"""Signing and verifying presented tokens in bulk.

A token is `base64(claims JSON) . hex HMAC of that base64 text`. Every failure yields NULL claims, never an
error, so a forged token cannot be told from an absent one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.crypto import hmac_hex, key_pads
from wardline.functions.scalars import decode_text, distinct_from, epoch_reached, json_get, split_token
from wardline.plans.placement import lookup_join

# The order in which a token is refused (our own names).
STAGES = (
    "absent", "not_two_parts", "bad_base64", "bad_json", "unknown_key", "bad_signature", "no_expiry", "expired",
)


def sign_claims(
    claims: DataFrame, keys: DataFrame, fields: list[str], out: str = "token", kid: str = "kid"
) -> DataFrame:
    """Issue one token per row: `fields` (columns of `claims`) become the claims, signed under the key named in `kid`.

    A NULL there means the key called `default`.
    """
    encoded = F.base64(F.encode(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), "UTF-8"))
    body = F.translate(encoded, "\r\n", "")  # Spark may wrap base64 text into lines
    payload = claims.withColumn("__body", body).withColumn("__kid", F.coalesce(F.col(kid), F.lit("default")))
    pads = key_pads(keys).withColumnRenamed("kid", "__kid")
    signed = lookup_join(payload, pads, ["__kid"], "left")
    token = F.concat_ws(".", F.col("__body"), hmac_hex(F.col("__body"), "ipad", "opad"))
    return signed.withColumn(out, token).drop("__body", "__kid", "ipad", "opad")


def inspect_tokens(tokens: DataFrame, keys: DataFrame, at: Column, token: str = "token") -> DataFrame:
    """Add `stage` (NULL when the token is good) and `claims` (JSON text, set only when it is good)."""
    parts = tokens.withColumn("__parts", split_token(token))
    decoded = parts.withColumn("__doc", decode_text(F.get(F.col("__parts"), F.lit(0))))
    # `json_object_keys` is NULL for anything that is not a JSON object
    shaped = decoded.withColumn("__ok", F.json_object_keys("__doc").isNotNull()).withColumn(
        "__kid", F.when(F.col("__ok"), F.coalesce(json_get("__doc", "kid"), F.lit("default")))
    )
    keyed = lookup_join(shaped, key_pads(keys).withColumnRenamed("kid", "__kid"), ["__kid"], "left")
    expected = hmac_hex(F.get(F.col("__parts"), F.lit(0)), "ipad", "opad")
    exp = json_get("__doc", "exp")
    stage = (
        F.when(F.col(token).isNull() | (F.col(token) == ""), "absent")
        .when(F.col("__parts").isNull(), "not_two_parts")
        .when(F.col("__doc").isNull(), "bad_base64")
        .when(~F.col("__ok"), "bad_json")
        .when(F.col("ipad").isNull(), "unknown_key")
        .when(distinct_from(expected, F.get(F.col("__parts"), F.lit(1))), "bad_signature")
        .when(exp.try_cast("double").isNull(), "no_expiry")
        .when(epoch_reached(exp, at), "expired")
    )
    return (
        keyed.withColumn("stage", stage)
        .withColumn("claims", F.when(F.col("stage").isNull(), F.col("__doc")))
        .drop("__parts", "__doc", "__ok", "__kid", "ipad", "opad")
    )


def verify_tokens(
    tokens: DataFrame, keys: DataFrame, at: Column, fields: tuple[str, ...] = ("sub", "grant_id", "delegation_id"),
    token: str = "token",
) -> DataFrame:
    """Good tokens' claims as columns; NULL in all of them otherwise."""
    seen = inspect_tokens(tokens, keys, at, token)
    verified = seen.withColumn("verified", F.col("claims").isNotNull())
    for name in fields:
        verified = verified.withColumn(name, json_get("claims", name))
    return verified.drop("stage", "claims")


def claimed(tokens: DataFrame, fields: tuple[str, ...], token: str = "token") -> DataFrame:
    """What a token says, unverified: only for the record of a refusal."""
    doc = decode_text(F.get(F.split(F.col(token), "\\."), F.lit(0)))
    return tokens.select("*", *[json_get(doc, f).alias(f"claimed_{f}") for f in fields])


def viewer_orgs(tokens: DataFrame, keys: DataFrame, principals: DataFrame, at: Column) -> DataFrame:
    """Audit tokens whose subject is a live human of the organisation the token names."""
    good = verify_tokens(tokens, keys, at, ("sub", "audit_org")).filter(
        F.col("verified") & F.col("audit_org").isNotNull()
    )
    live = principals.filter((F.col("kind") == "human") & F.coalesce(F.col("disabled_at") > at, F.lit(True)))
    live = live.select(F.col("principal_id").alias("sub"), F.col("org_id").alias("audit_org"))
    return lookup_join(good, live, ["sub", "audit_org"], "left_semi").withColumnRenamed("audit_org", "viewer_org")
