"""Sources, sinks and data-quality jobs."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests.helpers import frame
from wardline import schemas
from wardline.operators import quality
from wardline.session import shared_dir
from wardline.sources import sinks, tables


def test_scenario_sizes(world):
    assert {n: df.count() for n, df in world.items()} == {"org": 4, "principal": 10, "shipment": 60, "data_grant": 4, "delegation": 3}


def test_load_round_trip(spark, world, tmp_path):
    for name, df in world.items():
        df.write.parquet(str(tmp_path / name))
    back = tables.load(spark, str(tmp_path), tuple(world))
    assert {n: df.schema for n, df in back.items()} == {n: schemas.GOVERNANCE[n] for n in world}
    assert back["shipment"].exceptAll(world["shipment"]).count() == 0


def test_scan_reads_only_what_is_asked(spark, world, tmp_path):
    world["shipment"].write.partitionBy("owner_org", "region").parquet(str(tmp_path / "shipment"))
    scan = tables.load(spark, str(tmp_path), ("shipment",))["shipment"].filter("owner_org = 'cobalt' AND units > 80").select("shipment_id")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(owner_org" in plan and "GreaterThan(units,80)" in plan and "unit_cost_usd" not in plan
    assert [r.shipment_id for r in scan.collect()] == [59]


def test_append_never_overwrites(spark, tmp_path):
    path = str(tmp_path / "audit")
    for i in (1, 2):
        sinks.append_audit(frame(spark, [(i,)], "seq long").withColumn("event_ts", F.lit("2024-01-16").cast("timestamp")), path)
    assert sorted(r.seq for r in spark.read.parquet(path).collect()) == [1, 2]


def test_report_and_export(spark, tmp_path):
    report = frame(spark, [("a", 1)], "name string, n long")
    sinks.write_report(report, str(tmp_path / "r"))
    assert spark.read.schema(report.schema).json(str(tmp_path / "r")).collect() == report.collect()
    with pytest.raises(Exception, match="exist"):
        sinks.write_report(report, str(tmp_path / "r"))
    trail = frame(spark, [(1, ["a", "b,\"c"], 'x, "y"')], "seq long, columns_served array<string>, request string")
    sinks.export_trail(trail, str(tmp_path / "t"))
    row = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "t")).first()
    assert (row.seq, row.columns_served, row.request) == ("1", '["a","b,\\"c"]', 'x, "y"')


def test_quality(spark):
    child = frame(spark, [(1, "a"), (2, "b"), (3, None), (4, "b"), (4, "a")], "id long, ref string")
    parent = frame(spark, [("a",)], "pk string")
    assert [tuple(r) for r in quality.dup_keys(child, "id").collect()] == [(4, 2)]
    assert sorted(r.id for r in quality.orphans(child, "ref", parent, "pk").collect()) == [2, 4]
    rules = {"known": F.col("ref").isin("a"), "positive": F.col("id") > 0}
    assert {tuple(r) for r in quality.domain_violations(child, rules).collect()} == {("known", 2), ("positive", 0)}


class FakeSession:
    """Just what `shared_dir` asks of a session."""

    def __init__(self, configured, master):
        self.used = None
        none = SimpleNamespace(isEmpty=lambda: True, isDefined=lambda: False)
        made = lambda: none if self.used is None else SimpleNamespace(isEmpty=lambda: False, isDefined=lambda: True, get=lambda: self.used)
        self.conf = SimpleNamespace(get=lambda k, d: d)
        self.sparkContext = SimpleNamespace(
            getConf=lambda: {"spark.checkpoint.dir": configured}, master=master, setCheckpointDir=lambda d: setattr(self, "used", d),
            _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=made)))


def test_shared_dir_is_the_session_setting():
    assert shared_dir(FakeSession("/shared/x", "spark://host:7077")) == "/shared/x"
    assert shared_dir(FakeSession(None, "local[4]"))  # a temporary folder, in local mode only
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession(None, "spark://host:7077"))
