"""The stages one after the other, each against its own input."""

from __future__ import annotations

import corpus_pipeline
import __spark_entry__ as entry
from wardline.llm import decontam, jaccard_join, queries, secrets
from wardline.llm.text import stage

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF))
        assert set(columns) <= set(docs.columns), name
        assert docs.select("doc_id").distinct().count() == docs.count() > 0
        seen.append(docs)
    assert seen[4].columns == columns
    groups = jaccard_join.join(seen[1]).toPandas()
    assert set(seen[2].toPandas().doc_id) == set(groups.component_id)
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    held = {x.doc_id for x in decontam.leaks(seen[2], benchmark).collect()}
    assert set(seen[3].toPandas().doc_id) == set(seen[2].toPandas().doc_id) - held
    assert secrets.scan(seen[4]).select(secrets.listed(("assign", "access", "hex")).alias("s")).filter("s <> ''").count() == 0
    last = seen[5].toPandas()
    assert (last.copies >= 1).all() and (last.taken == last.copies * last["size"]).all()


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "taken" in out.columns


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLES) <= set(queries.QUERIES)
