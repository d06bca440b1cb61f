"""Revocation replay against a plain request-by-request simulation."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import frame
from wardline.operators import replay

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
REQ = "request_id long, event_ts timestamp, subject string, grant_id string, delegation_id string"
RES = "subject string, grant_id string, delegation_id string, opens_at timestamp, closes_at timestamp, revoked_at timestamp"


def at(s):
    return BASE + dt.timedelta(microseconds=round(s * 1e6))


def simulate(times, opens, closes, ttl):
    until, out, fill = None, [], None
    for t in times:
        if until is not None and t < until:
            out.append(True)
            continue
        ok = opens <= t < closes
        until = t + ttl if ok else None
        fill = t if ok else fill
        out.append(ok)
    return out, fill


@pytest.mark.parametrize("seed,slots,ttl", [(1, 1, 5), (2, 7, 1), (3, 1 << 16, 5), (4, 1 << 16, 300)])
def test_cache_replay_matches_simulation(spark, seed, slots, ttl):
    rnd = random.Random(seed)
    cases, reqs, res, i = {}, [], [], 0
    for c in range(12):
        span, n = rnd.choice([40, 200]), rnd.choice([1, 5, 60, 400])
        # copies of one instant, dense and sparse callers
        times = sorted(round(rnd.choice([rnd.uniform(0, span), float(rnd.randint(0, span))]), 3) for _ in range(n))
        opens, closes = sorted((rnd.uniform(-5, span), rnd.uniform(0, span + 20)))
        opens, closes = round(opens, 3), round(closes, 3)
        dele = None if c % 2 else f"d{c}"
        res.append((f"s{c}", "g", dele, at(opens), at(closes), at(closes)))
        want, fill = simulate(times, opens, closes, ttl)
        for t, ok in zip(times, want, strict=True):
            reqs.append((i, at(t), f"s{c}", "g", dele))
            cases[i] = ok
            i += 1
    requests, resolved = frame(spark, reqs, REQ), frame(spark, res, RES)
    got = {r.request_id: r.allowed for r in replay.replay_cache(requests, resolved, ttl, slots).collect()}
    assert got == cases


def test_cache_replay_of_a_caller_with_most_requests(spark):
    rnd, ttl = random.Random(9), 2
    busy = sorted(round(rnd.uniform(0, 300), 6) for _ in range(3000))
    calls = {"busy": busy, **{f"s{i}": [float(i), i + 1.5, i + 40.0] for i in range(200)}}
    requests = frame(spark, [(n, at(t), s, "g", None) for n, (s, t) in enumerate((s, t) for s, ts in calls.items() for t in ts)], REQ)
    resolved = frame(spark, [(s, "g", None, at(1), at(250), at(250)) for s in calls], RES)
    fills = replay.last_refresh(requests, resolved, ttl)
    want = {s: simulate(ts, 1, 250, ttl)[1] for s, ts in calls.items()}
    assert {r.subject: r.refreshed_at for r in fills.collect()} == {s: at(t).replace(tzinfo=None) for s, t in want.items() if t is not None}


def test_cache_replay_runs_no_python_and_takes_no_requests(spark, capsys):
    resolved = frame(spark, [("s", "g", None, at(0), at(9), at(9))], RES)
    none = frame(spark, [], REQ)
    assert replay.last_refresh(none, resolved, 5).count() == 0
    assert replay.replay_cache(none, resolved, 5).columns == [*none.columns, "allowed"]
    times = frame(spark, [(("s", "g", None), 1), (("s", "g", None), 9)], "c struct<subject string, grant_id string, delegation_id string>, t long")
    reach = replay._reach(times, 1, 9, 4, 1 << 16)
    assert sorted((r.t, r.prev, r.exit) for r in reach.collect()) == [(1, None, 9), (9, 1, None)]
    reach.explain()
    plan = capsys.readouterr().out
    assert "Exchange" in plan and "Arrow" not in plan and "Python" not in plan
    with pytest.raises(ValueError):
        replay.last_refresh(none, resolved, 0)


def test_live_token_and_inflight(spark):
    requests = frame(spark, [(n, at(t), "s", "g", None) for n, t in enumerate([0.0, 1.0, 9.9, 10.0, 12.0])], REQ)
    resolved = frame(spark, [("s", "g", None, at(0.5), at(10), at(10))], RES)
    live = {r.request_id: r.allowed for r in replay.replay_live(requests, resolved).collect()}
    assert live == {0: False, 1: True, 2: True, 3: False, 4: False}
    token = replay.replay_token(requests.withColumn("token_exp", F.lit(at(11)))).collect()
    assert [r.allowed for r in sorted(token)] == [True, True, True, True, False]
    running = replay.replay_inflight(requests.withColumn("end_ts", F.col("event_ts") + F.expr("interval 1 second")), resolved)
    assert [r.request_id for r in running.collect()] == [2]


def test_halt_and_damage(spark):
    judged = frame(spark, [(0, at(9), "s", "g", None, True, 5), (1, at(10.0), "s", "g", None, True, 5), (2, at(12), "s", "g", None, True, 5),
                           (3, at(13), "s", "g", None, True, 0), (4, at(14), "s", "g", None, False, 5), (5, at(11), "q", "g", None, True, 3),
                           (6, at(40), "q", "g", None, True, 3)],
                   REQ + ", allowed boolean, n_rows long")
    resolved = frame(spark, [(s, "g", None, at(0), at(10), at(10)) for s in ("s", "q", "quiet")], RES)
    halts = replay.first_denial(judged, replay.revocations(resolved), 20)
    trials = replay.until_halt(judged, halts, 20)
    got = {r.subject: (r.halt_latency_s, r.rows_after, r.requests_after) for r in trials.collect()}
    assert got == {"s": (3.0, 10, 3), "q": (20.0, 3, 1), "quiet": (20.0, 0, 0)}  # an empty answer halts; never halting is capped
    one = replay.mode_summary(trials.withColumn("mode", F.lit("m")).withColumn("bound_s", F.lit(5.0))).first()
    assert (one.trials, one.halt_mean_s, one.halt_max_s, one.rows_after_max, one.rows_after_mean, one.n_within, one.all_within) == (
        3, 14.3333, 20.0, 10, 4.33, 1, False)
