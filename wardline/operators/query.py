"""Caller queries as data: WHERE, ORDER BY, LIMIT and aggregates as text, planned against the guarded relation.

A predicate is parsed and analysed by Spark and cut into its conjuncts. A conjunct of comparisons alone cannot raise an error, so
it may run on any row: on shared columns it is put on the fact, where it reaches the scan. On a masked column it is decided above
the masks; if it cannot hold for a NULL, the same test on the raw value goes before the policy as a wider filter. All other
conjuncts run above the fence, on rows the policy has let through. The conjuncts' analysed texts, sorted, with parameters bound, are
the canonical form of the predicate: two spellings of one predicate ask for the same served set.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardline.functions.crypto import length_prefixed
from wardline.operators import guard
from wardline.operators.caller import fence, refuse_reach
from wardline.plans.placement import lookup_join
from wardline.schemas import ALL_COLUMNS, SHIPMENT

# Catalyst nodes that raise no error on any value.
COMPARISONS = {"EqualTo", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "In", "Between"}
LEAVES = {"AttributeReference", "Literal", "With", "CommonExpressionRef", "CommonExpressionDef"}
CALM = COMPARISONS | LEAVES | {"And", "Or", "Not", "EqualNullSafe", "IsNull", "IsNotNull", "Coalesce", "StartsWith", "EndsWith", "Contains"}
ORDER_ITEM = re.compile(r"\s*(\w+)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?\s*", re.I)
FOLDED = re.compile(r"\s*(count|sum|min|max)\s*\(\s*(\*|\w+)\s*\)(?:\s+as\s+(\w+))?\s*", re.I)


@dataclass(frozen=True)
class Conjunct:
    text: str
    columns: frozenset[str]
    calm: bool  # raises no error on any row
    strict: bool  # does not hold if a column in it is NULL

    @property
    def masked(self) -> bool:
        return any(c in guard.CAPS for c in self.columns)

    @property
    def on_fact(self) -> bool:
        """May go on the fact, before the policy join: as it is, or on raw values as a wider filter."""
        return self.calm and (not self.masked or self.strict)

    @property
    def above(self) -> bool:
        """Must be decided on the guarded row."""
        return not self.calm or self.masked


@dataclass(frozen=True)
class CallerQuery:
    query_id: str
    columns: tuple[str, ...]
    where: str | None = None
    args: dict[str, Any] = field(default_factory=dict)
    order_by: str | None = None
    limit: int = 0

    def asked(self) -> str:
        """What the caller asked for, as it goes on record."""
        return json.dumps({
            "columns": list(self.columns), "where": self.where, "params": self.args, "order_by": self.order_by, "limit": self.limit or None})


def _nodes(e) -> list:
    children = e.children()
    return [e, *[x for i in range(children.size()) for x in _nodes(children.apply(i))]]


def _calm(spark: SparkSession, e) -> bool:
    """Whether evaluating `e` cannot raise. What has no column in it is the same for every row and tells nothing."""
    if e.foldable():
        return True
    name, children = e.getClass().getSimpleName(), e.children()
    below = [children.apply(i) for i in range(children.size())]
    if name == "Cast":
        widens = spark._jvm.org.apache.spark.sql.catalyst.expressions.Cast.canUpCast(below[0].dataType(), e.dataType())
        return widens and _calm(spark, below[0])
    if name == "Like":  # a pattern from the row may be malformed
        return below[1].foldable() and _calm(spark, below[0])
    return name in CALM and all(_calm(spark, c) for c in below)


def _strict(e) -> bool:
    """Whether a NULL in any column makes `e` other than true: comparisons of columns and constants, negated or not."""
    names = [n.getClass().getSimpleName() for n in _nodes(e)]
    if names[0] == "IsNotNull" and names[1:] == ["AttributeReference"]:
        return True
    if "Not" in names and "Between" in names:
        return False
    inner = {"And", "GreaterThanOrEqual", "LessThanOrEqual"} if "Between" in names else set()
    return names[0] in COMPARISONS | {"Not", "Like"} and set(names) <= COMPARISONS | LEAVES | {"Not", "Like", "Cast"} | inner


def _analysed(spark: SparkSession, schema: StructType, text: str, args: dict[str, Any]):
    """(the analysed condition, the name of the view it speaks of)."""
    view = f"guarded_{uuid4().hex}"
    spark.createDataFrame([], schema).createOrReplaceTempView(view)
    try:
        plan = spark.sql(f"SELECT * FROM {view} WHERE ({text})", args=args)._jdf.queryExecution().analyzed()
    finally:
        spark.catalog.dropTempView(view)
    while plan.getClass().getSimpleName() != "Filter":
        plan = plan.children().apply(0)
    return plan.condition(), view


def conjuncts(spark: SparkSession, where: str | None, args: dict[str, Any] | None = None, schema: StructType = SHIPMENT) -> list[Conjunct]:
    """The predicate's conjuncts in canonical order; refused if it reaches outside the row."""
    if where is None:
        return []
    refuse_reach(spark, where)
    condition, view = _analysed(spark, schema, where, args or {})
    todo, out = [condition], {}
    while todo:
        e = todo.pop()
        if e.getClass().getSimpleName() == "And":
            todo += [e.left(), e.right()]
            continue
        text = re.sub(rf"\b{view}\.(\w+)", lambda m: m[1].lower(), e.sql())
        columns = frozenset(n.name().lower() for n in _nodes(e) if n.getClass().getSimpleName() == "AttributeReference")
        out[text] = Conjunct(text, columns, _calm(spark, e), _strict(e))
    return [out[t] for t in sorted(out)]


def canonical(parts: Sequence[Conjunct]) -> str:
    return " AND ".join(p.text for p in parts)


def ordering(order_by: str | None) -> list[tuple[str, bool, bool]]:
    """(column, descending, nulls first) of an ORDER BY text over shared columns; NULLs come last unless it says otherwise."""
    out = []
    for item in (order_by or "").split(",") if order_by else []:
        m = ORDER_ITEM.fullmatch(item)
        if not m or m[1].lower() not in ALL_COLUMNS:
            raise PermissionError(f"order by {item.strip()} is refused")
        out.append((m[1].lower(), (m[2] or "asc").lower() == "desc", (m[3] or "last").lower() == "first"))
    return out


def sort_keys(order_by: str | None, tie: str = "shipment_id") -> list[Column]:
    """A total order: the keys, then the row id."""
    way = {(False, False): "asc_nulls_last", (False, True): "asc_nulls_first", (True, False): "desc_nulls_last", (True, True): "desc_nulls_first"}
    return [*[getattr(F.col(c), way[down, first])() for c, down, first in ordering(order_by)], F.col(tie)]


def read(
    shipments: DataFrame, auths: DataFrame, where: str | None = None, args: dict[str, Any] | None = None,
    relation: Callable[[DataFrame, DataFrame], DataFrame] = guard.guarded,
) -> DataFrame:
    """The guarded rows that the predicate keeps. Conjuncts that raise nothing reach the scan of `shipments`. `relation` may be
    `guard.guarded_cells`: the same masked rows without their credentials."""
    parts = conjuncts(shipments.sparkSession, where, args)
    for p in parts:
        if p.on_fact:
            shipments = shipments.filter(F.expr(p.text))
    rows = relation(shipments, auths)
    for p in parts:
        if p.calm and p.above:
            rows = rows.filter(F.expr(p.text))
    rest = [p.text for p in parts if not p.calm]
    return fence(rows).filter(F.expr(" AND ".join(rest))) if rest else rows


def top(
    shipments: DataFrame, auths: DataFrame, order_by: str, n: int, where: str | None = None, args: dict[str, Any] | None = None
) -> DataFrame:
    """The first `n` guarded rows of every credential, with their `position`.

    The first rows of a credential are among the first of each of its cells, as it sees them. Those are found once for all
    credentials, so that a credential meets at most `n` rows a cell.
    """
    def first(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        at = F.row_number().over(Window.partitionBy(*by).orderBy(*sort_keys(order_by)))
        return rows.withColumn("position", at).filter(F.col("position") <= n)

    cells = first(read(shipments, auths, where, args, guard.guarded_cells), guard.SEEN_BY).drop("position")
    return first(guard.to_credentials(cells, auths), ["auth_id"])


def aggregate(
    shipments: DataFrame, auths: DataFrame, asked: str, where: str | None = None, args: dict[str, Any] | None = None
) -> DataFrame:
    """One row per credential with the aggregates of `asked` ("count(*) AS n, sum(units) AS total"), also for those who see no row.

    Counts, sums and extremes of columns under a predicate that lies on the fact are folded to policy cells in one scan;
    anything else runs on the guarded rows, once for all credentials that see the same ones.
    """
    spark = shipments.sparkSession
    refuse_reach(spark, f"struct({asked})")
    parts = conjuncts(spark, where, args)
    items = [FOLDED.fullmatch(x) for x in asked.split(",")]
    known = all(m and m[3] and (m[2] == "*" and m[1].lower() == "count" or m[2].lower() in ALL_COLUMNS) for m in items)
    if known and not any(p.above for p in parts):
        for p in parts:
            shipments = shipments.filter(F.expr(p.text))
        return _folded(shipments, auths, [(m[1].lower(), m[2].lower(), m[3]) for m in items if m])
    names_them = re.search(r"\bauth_id\b", asked, re.I)  # then the answer is not the same for credentials of equal scope
    scopes, holders = (auths, None) if names_them else guard.once_per_holding(auths)
    rows = fence(read(shipments, scopes, where, args))
    view = f"guarded_{uuid4().hex}"
    rows.createOrReplaceTempView(view)
    try:
        per = spark.sql(f"SELECT auth_id, struct({asked}) AS answer FROM {view} GROUP BY auth_id")
        none = spark.sql(f"SELECT struct({asked}) AS answer FROM {view} WHERE false")
    finally:
        spark.catalog.dropTempView(view)
    if holders is not None:
        per = lookup_join(holders, per.withColumnRenamed("auth_id", "scope_id"), ["scope_id"]).drop("scope_id")
    out = auths.select("auth_id").join(per, "auth_id", "left")
    return out.select("auth_id", F.coalesce("answer", none.scalar()).alias("answer")).select("auth_id", "answer.*")


def _folded(shipments: DataFrame, auths: DataFrame, items: list[tuple[str, str, str]]) -> DataFrame:
    fold = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    again = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    cells = guard.policy_cells(shipments, *[
        fold[fn](F.lit(1) if c == "*" else F.col(c)).alias(f"x{i}") for i, (fn, c, _) in enumerate(items)])
    per = guard.totals(cells, auths, *[again[fn](f"x{i}").alias(f"x{i}") for i, (fn, _, _) in enumerate(items)])

    def shown(i: int, fn: str, column: str, name: str) -> Column:
        value = F.col(f"x{i}")
        if column in guard.CAPS:
            value = F.when(F.col(guard.CAPS[column]), value)
        return (F.coalesce(value, F.lit(0)) if fn == "count" else value).alias(name)

    return per.select("auth_id", *[shown(i, *item) for i, item in enumerate(items)])


# --- many callers, many queries, one scan ----------------------------------
SCOPE = ("provider_org", "grantee_org", "region_scope", "max_classification", "allow_cost", "allow_contact")


def query_keys(spark: SparkSession, queries: Sequence[CallerQuery]) -> dict[str, tuple[list[Conjunct], str]]:
    """query_id → (conjuncts, key of what it asks): queries with the same key and scope serve the same rows."""
    out = {}
    for q in queries:
        parts = conjuncts(spark, q.where, q.args)
        order = ",".join(f"{c}{' desc' * d}{' first' * n}" for c, d, n in ordering(q.order_by)) if q.limit else ""
        out[q.query_id] = (parts, json.dumps([canonical(parts), order, q.limit]))
    return out


def with_queries(requests: DataFrame, queries: Sequence[CallerQuery]) -> DataFrame:
    """Requests that name a query by `query_id`, with its columns, its text for the record and its key."""
    spark = requests.sparkSession
    keys = query_keys(spark, queries)
    rows = [(q.query_id, list(q.columns), q.asked(), keys[q.query_id][1]) for q in queries]
    known = spark.createDataFrame(rows, "query_id string, columns array<string>, asked string, query_key string")
    return lookup_join(requests.drop("columns", "asked", "query_key"), known, ["query_id"])


def query_set_id() -> Column:
    """Text id of a served set: the same rows of the same scope. Capabilities count, because predicates see masked values."""
    cap = lambda c: F.col(c).cast("string")
    return F.sha2(length_prefixed(
        F.col("provider_org"), F.col("grantee_org"), F.array_join(F.array_sort("region_scope"), ","), F.col("max_classification"),
        cap("allow_cost"), cap("allow_contact"), F.col("query_key")), 256)


def served(judged: DataFrame, shipments: DataFrame, queries: Sequence[CallerQuery]) -> DataFrame:
    """(set_id, shipment_id) of every distinct set that the allowed requests of `judged` ask for.

    The fact is scanned once for all queries: a row is tagged with the queries whose calm conjuncts it meets, and joined by cell and
    query with the sets; what must be decided above the masks is then tested on the joined, masked and fenced row.
    """
    spark = shipments.sparkSession
    keys = query_keys(spark, queries)
    distinct: dict[str, CallerQuery] = {}
    for q in queries:
        distinct.setdefault(keys[q.query_id][1], q)
    numbered = list(distinct.items())
    plans = [(keys[q.query_id][0], q) for _, q in numbered]

    def all_of(texts: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.expr(t) for t in texts], F.lit(True))

    tags = F.array_compact(F.array(*[
        F.when(all_of([p.text for p in parts if p.on_fact]), F.lit(i)) for i, (parts, _) in enumerate(plans)]))
    rows = guard.ranked(shipments).withColumn("query", F.explode(tags))
    numbers = spark.createDataFrame([(key, i) for i, (key, _) in enumerate(numbered)], "query_key string, query int")
    sets = judged.filter("decision = 'allow'").select("set_id", "query_key", *SCOPE).dropDuplicates(["set_id"])
    cells = guard.scope_cells(lookup_join(sets, numbers, ["query_key"]), keep=("set_id", "query", "allow_cost", "allow_contact"))
    met = lookup_join(rows, cells, [*guard.CELL, "query"], null_safe=["partner_org"])
    shown = met.select("set_id", "query", *guard.masked_columns(ALL_COLUMNS))
    for calm in (True, False):
        tests = [(i, [p.text for p in parts if p.above and p.calm == calm]) for i, (parts, _) in enumerate(plans)]
        tests = [(i, texts) for i, texts in tests if texts]
        if tests:
            shown = shown if calm else fence(shown)
            keep = F.lit(True)
            for i, texts in tests:
                keep = F.when(F.col("query") == i, F.coalesce(all_of(texts), F.lit(False))).otherwise(keep)
            shown = shown.filter(keep)
    out = None
    limited = {i: q for i, (_, q) in enumerate(plans) if q.limit}
    free = shown.filter(~F.col("query").isin(list(limited))) if limited else shown
    out = free.select("set_id", "shipment_id")
    for i, q in limited.items():  # the rank filter keeps `limit` rows per set before the shuffle too
        at = F.row_number().over(Window.partitionBy("set_id").orderBy(*sort_keys(q.order_by)))
        out = out.union(shown.filter(F.col("query") == i).withColumn("at", at).filter(F.col("at") <= q.limit).select("set_id", "shipment_id"))
    return out
