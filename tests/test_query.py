"""Caller queries as data: what reaches the scan, what stays above the policy, what counts as the same query."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.helpers import auths, creds
from wardline.operators import caller, guard, query
from wardline.plans.placement import stage

AGENT = ("bo-plan", "g-trade", "d-plan")
KIRA = ("bo-kira", "g-trade", None)


@pytest.fixture(scope="module")
def facts(world):
    """The shared rows as a Parquet table, so that filters can be seen at its scan."""
    return stage(world["shipment"])


@pytest.fixture(scope="module")
def scopes(spark, world, now):
    return stage(auths(world, creds(spark, AGENT, KIRA), now))


def ids(df):
    return sorted((r.auth_id, r.shipment_id) for r in df.select("auth_id", "shipment_id").collect())


@pytest.mark.parametrize(("text", "calm", "strict"), [
    ("units > 100", True, True), ("units BETWEEN 1 AND 2", True, True), ("status LIKE 'F%'", True, True), ("status IN ('F', 'O')", True, True),
    ("unit_cost_usd > 100000", True, True), ("status = 'F' OR units = 2", True, False), ("margin_pct IS NULL", True, False),
    ("margin_pct IS NOT NULL", True, True), ("NOT (units = 4)", True, True), ("units <=> 3", True, False), ("coalesce(units, 1) = 1", True, False),
    ("NOT (units BETWEEN 1 AND 2)", True, False), ("1 / (shipment_id - 3) < 5", False, False), ("units + 1 > 2", False, False),
    ("CAST(carrier AS INT) = 3", False, True), ("status LIKE carrier", False, True), ("upper(status) = 'F'", False, False),
])
def test_what_may_run_on_any_row(spark, text, calm, strict):
    (part,) = query.conjuncts(spark, text)
    assert (part.calm, part.strict) == (calm, strict)


@pytest.mark.parametrize("same", [
    ("units > 100 AND status = 'F'", {}), ("STATUS = 'F' and (Units > 100)", {}), ("status = :s AND units > :u AND units > 100", {"s": "F", "u": 100}),
])
def test_one_predicate_has_one_form(spark, same):
    assert query.canonical(query.conjuncts(spark, *same)) == query.canonical(query.conjuncts(spark, "status = 'F' AND units > 100"))


def test_other_values_are_another_predicate(spark):
    form = lambda **args: query.canonical(query.conjuncts(spark, "carrier = :c", args))
    assert form(c="DHL") != form(c="UPS") and form(c="x' OR '1'='1") == "(carrier = 'x\\' OR \\'1\\'=\\'1')"


@pytest.mark.parametrize("text", [
    "units > 20", "units > 20 AND status <> 'none'", "unit_cost_usd > 50", "unit_cost_usd IS NULL", "margin_pct IS NOT NULL AND units > 5",
    "contact_email LIKE '%@%'", "1 / (units + 1) < 2 AND units > 20", "NOT (unit_cost_usd = 50)", "unit_cost_usd > 50 OR units > 20", "upper(region) = region",
])
def test_reading_is_filtering_the_guarded_relation(facts, scopes, text):
    want = caller.caller_filter(guard.guarded(facts, scopes), text)
    got = query.read(facts, scopes, text)
    assert got.columns == want.columns and ids(got) == ids(want)


@pytest.mark.parametrize("hidden", [6, 2, 4])
def test_a_hidden_row_cannot_raise_an_error(spark, world, now, facts, hidden):
    one = auths(world, creds(spark, AGENT), now)
    assert query.read(facts, one, "1 / (shipment_id - :x) < 5", {"x": hidden}).count() == 6
    assert query.read(facts, one, "1 / (shipment_id - :x) < 5 AND units > -1", {"x": hidden}).count() == 6


def scan_of(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return " ".join(line for line in plan.splitlines() if "FileScan" in line and "shipment_id" in line)


def test_calm_conjuncts_reach_the_scan(spark, facts, scopes, request):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.maxMetadataStringLength"))
    scan = scan_of(query.read(facts, scopes, "status = 'F' AND units BETWEEN 100 AND 250 AND unit_cost_usd > 1000 AND 1 / units > 0"))
    pushed = scan[scan.index("PushedFilters"):]
    for said in ("EqualTo(status,F)", "GreaterThanOrEqual(units,100)", "LessThanOrEqual(units,250)", "GreaterThan(unit_cost_usd,"):
        assert said in pushed, said


def test_the_rest_stays_above_the_join(facts, scopes):
    plan = query.read(facts, scopes, "1 / units > 0 AND status = 'F'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("(1.0 / ") < plan.index("Join") < plan.index("status#", plan.index("Join"))


@pytest.mark.parametrize("text", ["units > (SELECT 1)", "my_udf(units) > 1", "reflect('java.lang.System', 'exit', 0) = 1"])
def test_reaching_out_is_refused(spark, facts, scopes, text):
    with pytest.raises(PermissionError):
        query.read(facts, scopes, text)
    with pytest.raises(PermissionError):
        query.aggregate(facts, scopes, f"max({text})")


def test_order_texts():
    assert query.ordering("units desc, Carrier NULLS FIRST,shipment_id asc") == [("units", True, False), ("carrier", False, True), ("shipment_id", False, False)]
    for text in ("secret", "units; drop", "units desc nulls", "1 / units"):
        with pytest.raises(PermissionError):
            query.ordering(text)


def plain_aggregate(facts, scopes, where):
    rows = guard.guarded(facts, scopes)
    rows = rows.filter(where) if where else rows
    per = rows.groupBy("auth_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("units").alias("total"), F.max("unit_cost_usd").alias("dearest"), F.count("margin_pct").alias("margins"))
    out = scopes.select("auth_id").join(per, "auth_id", "left").fillna(0, ["n", "margins"])
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("where", [None, "units > 20", "unit_cost_usd > 50", "1 / (units + 1) < 2", "units < 0"])
def test_aggregates_over_cells_and_rows_agree(facts, scopes, where):
    got = query.aggregate(facts, scopes, "count(*) AS n, sum(units) AS total, max(unit_cost_usd) AS dearest, count(margin_pct) AS margins", where)
    assert got.columns == ["auth_id", "n", "total", "dearest", "margins"]
    assert sorted(map(tuple, got.collect())) == plain_aggregate(facts, scopes, where)
    spelled = query.aggregate(facts, scopes, "count(*) AS n, sum(units + 0) AS total, max(unit_cost_usd) AS dearest, count(margin_pct) AS margins", where)
    assert sorted(map(tuple, spelled.collect())) == plain_aggregate(facts, scopes, where)


def test_folded_aggregates_do_not_join_the_fact(facts, scopes):
    plan = query.aggregate(facts, scopes, "count(*) AS n, sum(units) AS total", "units > 20")._jdf.queryExecution().optimizedPlan().toString()
    join, scan = plan.rindex("Join"), plan.index("shipment_id") if "shipment_id" in plan else len(plan)
    assert plan.index("Aggregate", join) < len(plan) and scan > 0


QUERIES = [
    query.CallerQuery("all", ("shipment_id", "carrier")),
    query.CallerQuery("some", ("shipment_id",), "units > :u", {"u": 20}),
    query.CallerQuery("same", ("shipment_id", "status"), "(UNITS > 20)"),
    query.CallerQuery("dear", ("shipment_id", "unit_cost_usd"), "unit_cost_usd > 50 AND 1 / (units + 1) < 2"),
    query.CallerQuery("none", ("shipment_id",), "margin_pct IS NULL"),
    query.CallerQuery("top", ("shipment_id",), "units > 0", order_by="units desc", limit=2),
]


def test_many_queries_in_one_scan_serve_what_each_alone_does(spark, facts, scopes):
    asked = None
    for q in QUERIES:
        one = scopes.withColumn("query_id", F.lit(q.query_id))
        asked = one if asked is None else asked.unionByName(one)
    judged = stage(query.with_queries(asked, QUERIES).withColumn("decision", F.lit("allow")).withColumn("set_id", query.query_set_id()))
    rows = query.served(judged, facts, QUERIES)
    got = {}
    for r in judged.select("auth_id", "query_id", "set_id").join(rows, "set_id").collect():
        got.setdefault((r.auth_id, r.query_id), []).append(r.shipment_id)
    for q in QUERIES:
        for a in [r.auth_id for r in scopes.select("auth_id").collect()]:
            want = query.read(facts, scopes, q.where, q.args).filter(F.col("auth_id") == a)
            want = want.orderBy(*query.sort_keys(q.order_by)).limit(q.limit) if q.limit else want
            assert sorted(got.get((a, q.query_id), [])) == sorted(r.shipment_id for r in want.collect()), (a, q.query_id)
    sets = {(r.auth_id, r.query_id): r.set_id for r in judged.collect()}
    assert all(sets[a, "some"] == sets[a, "same"] != sets[a, "all"] for a, _ in sets)
    assert rows.count() == rows.distinct().count()
