"""Scalar rules as Column builders. All run inside whole-stage codegen; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Cols = Column | str


def _c(x: Cols) -> Column:
    return F.col(x) if isinstance(x, str) else x


def class_rank(classification: Cols) -> Column:
    # fixed values: the order of the three classes
    c = _c(classification)
    return F.when(c == "public", 1).when(c == "internal", 2).when(c == "restricted", 3)


def grant_live(approved_at: Cols, revoked_at: Cols, expires_at: Cols, as_of: Column) -> Column:
    """Approved, not revoked and strictly before expiry, each as known at `as_of`."""
    approved, revoked = _c(approved_at), _c(revoked_at)
    return (
        F.coalesce(approved <= as_of, F.lit(False))
        & F.coalesce(revoked > as_of, F.lit(True))
        & F.coalesce(_c(expires_at) > as_of, F.lit(False))
    )


def hop_live(revoked_at: Cols, expires_at: Cols, as_of: Column) -> Column:
    return F.coalesce(_c(revoked_at) > as_of, F.lit(True)) & F.coalesce(_c(expires_at) > as_of, F.lit(False))


def distinct_from(a: Cols, b: Cols) -> Column:
    return ~_c(a).eqNullSafe(_c(b))


def scope_intersect(a: Cols, b: Cols) -> Column:
    """Regions allowed by both sides, each once; never NULL."""
    return F.coalesce(F.array_intersect(_c(a), _c(b)), F.array().cast("array<string>"))


def is_subset(inner: Cols, outer: Cols) -> Column:
    return F.size(F.array_except(_c(inner), _c(outer))) == 0


def any_of(x: Cols, arr: Cols) -> Column:
    return F.array_contains(_c(arr), _c(x))


def split_token(token: Cols) -> Column:
    """The two parts of a token, or NULL unless there are exactly two."""
    parts = F.split(_c(token), "\\.")
    return F.when(F.size(parts) == 2, parts)


def decode_text(b64: Cols) -> Column:
    """base64 → UTF-8 text, NULL where either step fails."""
    return F.try_validate_utf8(F.try_to_binary(_c(b64), F.lit("base64")).cast("string"))


def json_get(doc: Cols, field: str) -> Column:
    return F.get_json_object(_c(doc), f"$.{field}")


def epoch_reached(exp: Cols, at: Column) -> Column:
    """True once `exp` (epoch seconds as text) is at or before `at`; NULL where it is not a number."""
    return _c(exp).try_cast("double") <= F.unix_micros(at) / F.lit(1e6)


def array_text(arr: Cols) -> Column:
    """Canonical text of an array: its JSON."""
    return F.to_json(_c(arr))


def join_list(arr: Cols, sep: str = ",") -> Column:
    return F.array_join(_c(arr), sep)


def rounded_long(x: Cols) -> Column:
    """Nearest integer, halves away from zero; a bare cast would cut the fraction off."""
    return F.round(_c(x), 0).cast("long")


def plus_days(at: Column, n: Column | int) -> Column:
    return at + F.make_dt_interval(F.lit(n) if isinstance(n, int) else n)


def plus_hours(at: Column, n: Column | int) -> Column:
    return at + F.make_dt_interval(F.lit(0), F.lit(n) if isinstance(n, int) else n)
