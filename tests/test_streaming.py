"""Streams over several micro-batches."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from tests.helpers import edit, frame
from tests.test_audit import ALL
from tests.test_credentials import FUTURE, token
from wardline.streaming import jobs

T0 = dt.datetime(2024, 1, 16, 0, 0, 1, tzinfo=dt.timezone.utc)


def test_seal_carries_the_chain_across_batches_and_restarts(spark, keys, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def put_and_run(seqs):
        frame(spark, [(s, "default", f"event {s}") for s in seqs], "seq long, kid string, note string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("seq long, kid string, note string").option("maxFilesPerTrigger", 1).parquet(src)
        jobs.stream_audit(stream, keys, F.col("note"), out, ck, 4).awaitTermination()

    put_and_run([0, 1, 4])
    put_and_run([2, 3, 5])  # a new query on the same checkpoint
    rows = sorted(spark.read.parquet(out).collect(), key=lambda r: (r.segment, r.pos))
    assert [(r.segment, r.pos, r.seq) for r in rows] == [(0, 1, 0), (0, 2, 1), (0, 3, 2), (0, 4, 3), (1, 1, 4), (1, 2, 5)]
    for a, b in zip(rows, rows[1:], strict=False):
        assert b.prev_hash == (a.hash if a.segment == b.segment else None)


def test_revocation_bites_on_the_next_batch(spark, world, keys, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "request_id long, event_ts timestamp, token string, columns array<string>, request string"
    claims = {"sub": "bo-plan", "grant_id": "g-trade", "delegation_id": "d-plan", "exp": FUTURE}
    state = {"now": world}

    def governance():
        return {**state["now"], "keys": keys}

    def put_and_run(rows):
        frame(spark, rows, schema).write.mode("append").parquet(src)
        jobs.stream_guarded(spark.readStream.schema(schema).parquet(src), governance, out, ck).awaitTermination()

    ask = lambda i, tok: (i, T0, tok, ALL, json.dumps({"k": 42}))
    put_and_run([ask(1, token(claims)), ask(2, token(claims, b"forged")), ask(3, None)])
    state["now"] = edit(world, "delegation", "delegation_id", "d-plan", revoked_at=F.lit("2024-01-16").cast("timestamp"))
    put_and_run([ask(4, token(claims))])
    events = {r.seq: (r.decision, r.row_count, r.subject) for r in spark.read.parquet(f"{out}/events").collect()}
    assert events == {1: ("allow", 1, "bo-plan"), 2: ("deny", 0, None), 3: ("deny", 0, None), 4: ("deny", 0, None)}
    assert [r.row_ids for r in spark.read.schema("set_id string, chunk long, row_ids array<long>").parquet(f"{out}/rows").collect()] == [[3]]


def test_denial_counts_update_and_late_events_drop(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "seq long, event_ts timestamp, subject string, decision string, request string"
    event = lambda i, day, hour, who, decision="deny": (
        i, dt.datetime(2024, 1, day, hour, tzinfo=dt.timezone.utc), None, decision, json.dumps({"claimed_sub": who}))

    def put_and_run(rows):
        frame(spark, rows, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.stream_denials(spark.readStream.schema(schema).parquet(src), out, ck).awaitTermination()

    put_and_run([event(1, 1, 1, "a"), event(2, 1, 2, "a"), event(3, 1, 3, "b"), event(4, 1, 4, "a", "allow")])
    put_and_run([event(5, 1, 5, "a"), event(6, 5, 1, "b")])
    put_and_run([event(7, 1, 6, "a"), event(8, 5, 2, "b")])  # the first window has closed by now
    got = {(r.window_start.day, r.claimed_sub): r.n for r in jobs.latest_counts(spark.read.parquet(out)).collect()}
    assert got == {(1, "a"): 3, (1, "b"): 1, (5, "b"): 2}
