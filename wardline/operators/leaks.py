"""Measuring what a caller's query gives away.

Arms are compared over the same rows: the guarded relation (masks before the caller's query) and the control
(masks after it), and for whole attacks a third without masks. Result sets and orders are compared through aggregates that decide the same question: sets cut
by `column > t` are nested, so two are equal exactly when their sizes are; ascending and descending order on a key
agree exactly when the key takes at most one value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalars import rounded_long
from wardline.operators.guard import (
    CAPS, CELL, SEEN_BY, guarded_cells, masked_columns, policy_cells, scope_cells, to_credentials, totals, visible_cells,
)
from wardline.plans.placement import lookup_join, stage

ARMS = ("mask_first", "mask_last")
OUTCOME_ARMS = (*ARMS, "no_mask")  # the last serves raw rows: what the measure shows when masks are missing


# --- served against forbidden ----------------------------------------------
def visible_values(served: DataFrame, columns: Sequence[str], by: Sequence[str] = ("auth_id",)) -> DataFrame:
    """Distinct non-NULL (row, column, value) handed out, values as text."""
    text = served.select(*by, "shipment_id", *[F.col(c).cast("string").alias(c) for c in columns])
    long = text.unpivot([*by, "shipment_id"], list(columns), "column", "value")
    return long.filter(F.col("value").isNotNull()).distinct()


def disclosed(visible: DataFrame, asked: Callable[[Callable[[str], Column]], Column], by: str = "attack_id") -> DataFrame:
    """The rows of `visible` (raw values and capabilities) that the caller's predicate picks in any arm, in one pass.

    `asked` builds the predicate from a function that gives a column's value: the masked one in `mask_first`, the raw one in the other
    arms. `arms` says per arm whether the row is served, whether that gives away a value the credential may not see (the predicate holds,
    but would not if every column without capability were NULL), and how many masked values come with it.
    """
    return _disclosed(visible, asked, F.col("auth_id").alias(by), "shipment_id")


def _disclosed(visible: DataFrame, asked: Callable[[Callable[[str], Column]], Column], *keep: Column | str) -> DataFrame:
    masked = list(CAPS)
    rows = visible.withColumn("shown", F.struct(*masked_columns(masked)))
    holds = lambda value: F.coalesce(asked(value), F.lit(False))
    real = holds(F.col)
    seen = holds(lambda c: F.col(f"shown.{c}") if c in CAPS else F.col(c))
    secret = real & ~holds(lambda c: F.when(F.col(CAPS[c]), F.col(c)) if c in CAPS else F.col(c))  # apart from the masks measured
    came = lambda source: sum((~F.col(CAPS[c]) & F.col(f"{source}{c}").isNotNull()).cast("long") for c in masked)
    arms = {"mask_first": (seen, "shown."), "mask_last": (real, "shown."), "no_mask": (real, "")}
    return rows.select(
        *keep,
        F.array(*[
            F.struct(F.lit(arm).alias("arm"), served.alias("served"), (served & secret).alias("leaks"),
                     F.when(served, came(source)).otherwise(0).alias("n_values"))
            for arm, (served, source) in arms.items()
        ]).alias("arms"),
    ).filter(real | seen)


def leaked_rows(found: DataFrame, arm: str, by: str = "attack_id") -> DataFrame:
    """(attack, row) given away in one arm."""
    return found.filter(F.exists("arms", lambda a: (a["arm"] == arm) & a["leaks"])).select(by, "shipment_id")


_LEAKED = [(f"rows_{arm}", f"values_{arm}") for arm in OUTCOME_ARMS]


def _count_leaks(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Leaked rows and values per arm, of what `disclosed` found."""
    return found.groupBy(*by).agg(*[
        t for i, (rows, values) in enumerate(_LEAKED)
        for t in (F.count_if(F.col("arms")[i]["leaks"]).alias(rows), F.sum(F.col("arms")[i]["n_values"]).alias(values))])


def disclosed_counts(
    shipments: DataFrame, auths: DataFrame, asked: Callable[[Callable[[str], Column]], Column], by: str = "attack_id"
) -> DataFrame:
    """What `disclosed` finds, counted per credential without a row for every (credential, row): a row's part depends on its
    cell and the capabilities alone, so the fact is folded to these in one scan and the credentials meet the counts."""
    cells = _count_leaks(_disclosed(visible_cells(shipments, auths), asked, *SEEN_BY), SEEN_BY)
    per = to_credentials(cells, auths).groupBy(F.col("auth_id").alias(by))
    return per.agg(*[F.sum(x).alias(x) for pair in _LEAKED for x in pair])


def evaluate(attacks: DataFrame, found: DataFrame, key: str = "attack_id") -> DataFrame:
    """Per arm and attack (key, family, must_deny, decision): what leaked, and whether the attack got through."""
    return outcomes(attacks, _count_leaks(found, [key]), key)


def outcomes(attacks: DataFrame, counts: DataFrame, key: str = "attack_id") -> DataFrame:
    """`evaluate` from counts per attack."""
    df = lookup_join(attacks, counts, [key], "left")
    per_arm = F.array(*[
        F.struct(F.lit(arm).alias("arm"), *[F.coalesce(f"{n}_{arm}", F.lit(0)).cast("long").alias(f"n_leaked_{n}") for n in ("rows", "values")])
        for arm in OUTCOME_ARMS])
    df = df.select(*attacks.columns, F.inline(per_arm))
    wrongly_allowed = F.col("must_deny") & (F.col("decision") == "allow")
    return df.withColumn("bypassed", (F.col("n_leaked_rows") > 0) | (F.col("n_leaked_values") > 0) | wrongly_allowed)


def compare(outcomes: DataFrame, a: str, b: str, key: str = "attack_id") -> DataFrame:
    """Attacks whose outcome differs between two arms."""
    per = outcomes.groupBy(key, "family").agg(*[
        F.bool_or(F.when(F.col("arm") == arm, F.col("bypassed"))).alias(name) for arm, name in ((a, "bypassed_a"), (b, "bypassed_b"))])
    return per.filter(F.col("bypassed_a") != F.col("bypassed_b"))


def rollup(outcomes: DataFrame) -> DataFrame:
    """Attacks and bypasses per arm and family, and per arm where family is 'ALL'."""
    return (
        outcomes.rollup("arm", "family")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("bypassed").alias("n_bypassed"), F.grouping_id().alias("__g"))
        .filter(F.col("__g") < 3)
        .select("arm", F.when(F.col("__g") == 1, "ALL").otherwise(F.col("family")).alias("family"), "total", "n_bypassed")
    )


# --- positive controls -----------------------------------------------------
def kinds(shipments: DataFrame) -> DataFrame:
    """One row per combination of the four attributes the policy reads, with `n_rows`; `shipment_id` is the combination as text.
    Rows of one kind are served or withheld together, so a derivation of access can be held against another on these."""
    read = ["owner_org", "region", "classification", "partner_org"]
    folded = shipments.groupBy(*read).agg(F.count(F.lit(1)).alias("n_rows"))
    return folded.withColumn("shipment_id", F.to_json(F.struct(*read)))


def match_kinds(served: DataFrame, expected: DataFrame, of: DataFrame, key: str = "auth_id") -> DataFrame:
    """`match_rows` in numbers of rows, where `served` and `expected` are derived from the kinds `of`."""
    s = served.select(key, "shipment_id", F.lit(True).alias("__s"))
    e = expected.select(key, "shipment_id", F.lit(True).alias("__e"))
    both = lookup_join(s.join(e, [key, "shipment_id"], "full_outer"), of.select("shipment_id", "n_rows"), ["shipment_id"])
    rows_of = lambda which: F.sum(F.when(which, F.col("n_rows")).otherwise(0))
    return both.groupBy(key).agg(
        rows_of(F.col("__s").isNull()).alias("n_missing"), rows_of(F.col("__e").isNull()).alias("n_extra"),
        rows_of(F.col("__s").isNotNull()).alias("n_served"),
    )


def match_rows(served: DataFrame, expected: DataFrame, key: str = "auth_id") -> DataFrame:
    """Per credential: rows expected but not served, and served but not expected."""
    s = served.select(key, "shipment_id", F.lit(1).alias("__s"))
    e = expected.select(key, "shipment_id", F.lit(1).alias("__e"))
    both = s.join(e, [key, "shipment_id"], "full_outer")
    return both.groupBy(key).agg(
        F.count_if(F.col("__s").isNull()).alias("n_missing"), F.count_if(F.col("__e").isNull()).alias("n_extra"),
        F.count("__s").alias("n_served"),
    )


def controls(served: DataFrame, expected: DataFrame, served_masks: DataFrame, expected_masks: DataFrame) -> DataFrame:
    """Exactness per credential: rows in both directions and the masked column list."""
    return exactness(match_rows(served, expected), served_masks, expected_masks)


def exactness(rows: DataFrame, served_masks: DataFrame, expected_masks: DataFrame) -> DataFrame:
    """`controls` from rows matched already."""
    masks = served_masks.select("auth_id", F.col("masked").alias("__got")).join(
        expected_masks.select("auth_id", F.col("masked").alias("__want")), "auth_id", "full_outer"
    )
    df = masks.join(rows, "auth_id", "left").select(
        "auth_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_missing", "n_extra", "n_served")],
        F.col("__got").eqNullSafe(F.col("__want")).alias("masks_match"),
    )
    return df.withColumn("exact", (F.col("n_missing") == 0) & (F.col("n_extra") == 0) & F.col("masks_match"))


def value_counts(guarded: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-NULL values per credential and column, in long form."""
    wide = guarded.groupBy("auth_id").agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(c) for c in columns])
    return long_counts(wide, columns)


def long_counts(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    return wide.unpivot(["auth_id", "n_rows"], list(columns), "column", "n_values")


def shown_counts(shipments: DataFrame, auths: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(auth_id, n_rows, a count per column) of the guarded relation: masked rows are folded per cell and capabilities."""
    cells = guarded_cells(shipments, auths).groupBy(*SEEN_BY).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(c) for c in columns])
    return to_credentials(cells, auths).groupBy("auth_id").agg(*[F.sum(c).alias(c) for c in ("n_rows", *columns)])


def overmasked(guarded: DataFrame, allowed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(auth_id, column): columns the credential may see, non-NULL by nature, that came out all NULL."""
    return overmasked_counts(value_counts(guarded, columns), allowed)


def overmasked_counts(counts: DataFrame, allowed: DataFrame) -> DataFrame:
    counts = counts.filter((F.col("n_values") == 0) & (F.col("n_rows") > 0))
    return lookup_join(counts, allowed.select("auth_id", "column"), ["auth_id", "column"], "left_semi")


def mask_coverage(guarded: DataFrame, masked: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(auth_id, column, n_values): values that came through a mask; none when masking holds."""
    return mask_coverage_counts(value_counts(guarded, columns), masked)


def mask_coverage_counts(counts: DataFrame, masked: DataFrame) -> DataFrame:
    return lookup_join(counts.filter(F.col("n_values") > 0), masked.select("auth_id", "column"), ["auth_id", "column"], "left_semi")


def unmasked_values(shipments: DataFrame, auths: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(auth_id, column, n_values): what would come through if nothing were masked, counted per policy cell in one scan."""
    cells = policy_cells(shipments, *[F.count(c).alias(c) for c in columns])
    per = totals(cells, auths, *[F.sum(c).alias(c) for c in columns])
    hidden = [F.struct(F.lit(c).alias("column"), F.when(~F.col(CAPS[c]), F.col(c)).alias("n_values")) for c in columns]
    return per.select("auth_id", F.inline(F.array(*hidden))).filter(F.col("n_values") > 0)


# --- side channels ---------------------------------------------------------
def side_channel_cells(shipments: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Everything the channels below need, folded to one row per policy cell in one scan."""
    return policy_cells(
        shipments,
        F.sum("unit_cost_usd").alias("cost_sum"), F.max("unit_cost_usd").alias("cost_max"),
        F.min("unit_cost_usd").alias("cost_min"), F.max("margin_pct").alias("margin_max"),
        *[F.count_if(F.col("unit_cost_usd") > F.lit(t)).alias(f"above_{i}") for i, t in enumerate(thresholds)],
    )


def _arms(df: DataFrame) -> DataFrame:
    """Every credential once per arm, with `sees`: whether the query there meets the real cost values."""
    arm = df.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in ARMS])))
    return arm.withColumn("sees", (F.col("arm") == "mask_last") | F.col("allow_cost"))


def predicate_leak(cells: DataFrame, auths: DataFrame, n_thresholds: int) -> DataFrame:
    """Per arm and credential: how many different result sets the thresholds cut out. A masked column must give
    one; a credential that may see the column is reported but cannot leak."""
    per_auth = totals(cells, auths, *[F.sum(f"above_{i}").alias(f"above_{i}") for i in range(n_thresholds)])
    sizes = F.array(*[F.when(F.col("sees"), F.coalesce(f"above_{i}", F.lit(0))).otherwise(0) for i in range(n_thresholds)])
    out = _arms(per_auth).withColumn("n_sets", F.size(F.array_distinct(sizes)).cast("long"))
    return out.select("arm", "auth_id", "n_sets", (~F.col("allow_cost") & (F.col("n_sets") > 1)).alias("leaks"))


def order_leak(cells: DataFrame, auths: DataFrame) -> DataFrame:
    """Per arm and credential: does ordering by the masked cost give a different order each way?"""
    per_auth = totals(cells, auths, F.min("cost_min").alias("lo"), F.max("cost_max").alias("hi"))
    differs = F.col("sees") & F.coalesce(F.col("lo") < F.col("hi"), F.lit(False))
    return _arms(per_auth).select("arm", "auth_id", differs.alias("order_differs"), (differs & ~F.col("allow_cost")).alias("leaks"))


def aggregate_leak(cells: DataFrame, auths: DataFrame) -> DataFrame:
    """Per arm and credential: count, cost total and highest margin as the caller gets them, rounded, and the truth."""
    per_auth = totals(
        cells, auths, F.sum("n_rows").alias("n"), F.sum("cost_sum").alias("true_sum"), F.max("margin_max").alias("true_max")
    )
    shown = lambda c: rounded_long(F.coalesce(F.when(F.col("sees"), F.col(c)), F.lit(0)))
    return _arms(per_auth).select(
        "arm", "auth_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"), shown("true_sum").alias("sum_cost"),
        shown("true_max").alias("max_margin"), rounded_long(F.coalesce("true_sum", F.lit(0))).alias("truth_sum"),
        rounded_long(F.coalesce("true_max", F.lit(0))).alias("truth_max"),
    )


def cardinality(shipments: DataFrame, auths: DataFrame) -> DataFrame:
    """(auth_id, n_true, n_served): rows that exist against rows that are served."""
    cells = stage(policy_cells(shipments))  # the total is the sum of the cells: one scan of the fact
    served = totals(cells, auths, F.sum("n_rows").alias("n"), keep=())
    whole = F.coalesce(cells.agg(F.sum("n_rows")).scalar(), F.lit(0)).cast("long")
    return served.select("auth_id", whole.alias("n_true"), F.coalesce("n", F.lit(0)).cast("long").alias("n_served"))


# --- ablation --------------------------------------------------------------
CLAUSE_KEY = {"owner": "owner_org", "region": "region", "ceiling": "class_rank", "partner": "partner_org"}


def ablate(shipments: DataFrame, auths: DataFrame) -> DataFrame:
    """(auth_id, clause, n_exposed): rows that would be exposed as well if one clause of the policy were dropped.

    Works on policy cells: for each clause the other three stay equality keys, and the cells the scope already
    admits are taken out.
    """
    cells = stage(policy_cells(shipments))  # one scan of the fact for all four clauses
    scope = stage(scope_cells(auths, keep=("auth_id",)))
    out = None
    for clause, dropped in CLAUSE_KEY.items():
        rest = [c for c in CELL if c != dropped]
        wider = scope.select("auth_id", *rest).distinct()
        safe = [c for c in rest if c == "partner_org"]
        reach = lookup_join(wider, cells, rest, null_safe=safe)
        extra = lookup_join(reach, scope, ["auth_id", *CELL], "left_anti", null_safe=["partner_org"])
        one = extra.groupBy("auth_id").agg(F.sum("n_rows").alias("n_exposed")).withColumn("clause", F.lit(clause))
        out = one if out is None else out.unionByName(one)
    return out.select("auth_id", "clause", F.col("n_exposed").cast("long").alias("n_exposed"))
