"""The audit day, sealing, tampering, and reconciliation."""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import frame
from wardline.operators import audit, auth
from wardline.plans.placement import stage

ALL = ("shipment_id,owner_org,region,classification,partner_org,carrier,status,units,updated_at,unit_cost_usd,margin_pct,"
       "contact_email,contact_phone").split(",")
REQUEST = "request_id long, event_ts timestamp, subject string, grant_id string, delegation_id string, action string, request string, columns array<string>"
T0 = dt.datetime(2024, 1, 16, 0, 0, 1, tzinfo=dt.timezone.utc)


def request(i, subject, grant="g-trade", dele=None, columns=ALL, k=42):
    return (i, T0, subject, grant, dele, "read", json.dumps({"k": k}), columns)


DAY = [
    request(1, "bo-kira"), request(2, "bo-plan", dele="d-plan"), request(3, "bo-route", dele="d-route", columns=["shipment_id", "carrier"]),
    request(4, "cb-mina", "g-cobalt", k=29), request(5, "cb-bot", dele="d-plan"), request(6, "bo-kira", dele="d-plan"),
    request(7, "bo-kira", columns=["shipment_id", "nope"]), request(9, "bo-kira", k=81),
]


@pytest.fixture(scope="module")
def day(spark, world):
    asked = frame(spark, DAY, REQUEST)
    resolved = stage(auth.resolve(auth.credentials_of(asked), world["data_grant"], world["delegation"], world["principal"]))
    events, rows = audit.audit_reads(asked, resolved, world["shipment"])
    return stage(events), stage(rows), resolved


@pytest.fixture(scope="module")
def sealed(day, keys):
    return stage(audit.seal(day[0], keys, 4))


def test_every_request_leaves_one_event(day):
    got = {r.seq: r for r in day[0].collect()}
    assert {s: (r.decision, r.subject, r.row_count) for s, r in got.items()} == {
        1: ("allow", "bo-kira", 1), 2: ("allow", "bo-plan", 1), 3: ("allow", "bo-route", 1), 4: ("allow", "cb-mina", 1),
        5: ("deny", None, 0), 6: ("deny", None, 0), 7: ("deny", None, 0), 9: ("allow", "bo-kira", 0)}
    assert got[7].deny_reason == 'unknown columns: ["nope"]' and got[5].deny_reason == auth.NO_AUTH
    assert json.loads(got[6].request)["claimed_sub"] == "bo-kira"
    assert (got[2].acting_for, got[2].chain, got[3].chain) == ("bo-kira", '["d-plan"]', '["d-route","d-plan"]')
    assert got[2].columns_masked == ["unit_cost_usd", "margin_pct", "contact_email", "contact_phone"]
    assert got[1].columns_masked == ["contact_email", "contact_phone"] and got[4].columns_masked == []
    assert got[5].provider_org is None and got[9].row_digest == hashlib.sha256(b"").hexdigest()


def test_exact_rows_are_on_record(day):
    events, rows, _ = day
    served = events.join(audit.chunked(rows, ["set_id"]), "set_id").select("seq", F.explode("row_ids").alias("id")).collect()
    assert sorted(map(tuple, served)) == [(1, 3), (2, 3), (3, 3), (4, 2)]


def test_root_names_a_set(spark):
    ids = spark.range(0, 9000).select(F.lit("s").alias("set_id"), F.col("id").alias("shipment_id"))
    header = lambda df: tuple(audit.set_headers(df).first())
    assert header(ids) == header(ids.orderBy(F.desc("shipment_id")).repartition(5)) and header(ids)[1] == 9000
    assert header(ids) != header(ids.filter("shipment_id <> 7"))


def test_changes_and_reads_make_one_trail(spark, day, keys):
    """Dense numbers over all sources, a chain over them, and a change that is taken out shows at the next row."""
    changes = frame(spark, [(i, T0 - dt.timedelta(seconds=2 - i), "al-jonas", "g-trade", "grant.revoke", "data_grant", "{}", "allow", 1) for i in range(4)],
                    "cmd_id long, event_ts timestamp, subject string, grant_id string, action string, resource string, request string, decision string, row_count long")
    trail = stage(audit.one_trail(day[0], changes))
    rows = trail.orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(12))
    assert [(r.action, r.own) for r in rows] == [("grant.revoke", 0), ("grant.revoke", 1), ("grant.revoke", 2), *[("read", i) for i in (1, 2, 3, 4, 5, 6, 7, 9)], ("grant.revoke", 3)]
    done = stage(audit.seal(trail, keys, 4))
    assert tuple(audit.verify_chain(done, audit.heads(done), keys).first()) == (12, None)
    assert [r.seq for r in audit.bad_rows(done.filter("seq <> 1"), audit.heads(done), keys).filter("bad").collect()] == [2]


def test_chunks_are_bounded(spark):
    rows = spark.range(0, 20000).select(F.lit("s").alias("set_id"), F.col("id").alias("shipment_id"))
    sizes = audit.chunked(rows, ["set_id"]).select(F.size("row_ids")).collect()
    assert sum(r[0] for r in sizes) == 20000 and max(r[0] for r in sizes) == audit.CHUNK


def test_seal_matches_plain_hmac(sealed):
    rows = sealed.withColumn("text", audit.payload()).orderBy("seq").collect()
    key, prev, segment = hashlib.sha256(b"one").digest(), "", None
    for r in rows:
        prev = "" if r.segment != segment else prev
        segment = r.segment
        assert r.prev_hash == (prev or None)
        prev = hmac.new(key, f"{len(prev)}:{prev}{r.text}".encode(), hashlib.sha256).hexdigest()
        assert r.hash == prev


def test_untouched_trail_verifies(sealed, keys):
    assert tuple(audit.verify_chain(sealed, audit.heads(sealed), keys).first()) == (8, None)


@pytest.mark.parametrize("column,value", [
    ("row_count", 99), ("provider_org", "cobalt"), ("grantee_org", "cobalt"), ("chain", "[]"), ("deny_reason", "x"), ("row_digest", "1:1"),
    ("columns_served", None), ("subject", "bo-lev"), ("hash", "00"), ("prev_hash", "00"),
])
def test_an_edit_is_found_at_its_row(sealed, keys, column, value):
    edited = sealed.withColumn(column, F.when(F.col("seq") == 2, F.lit(value)).otherwise(F.col(column)))
    assert audit.verify_chain(edited, audit.heads(sealed), keys).first().first_bad_seq == 2


def test_deletions(sealed, keys):
    middle = sealed.filter("seq <> 2")
    anchored = audit.heads(sealed)
    assert audit.verify_chain(middle, anchored, keys).first().first_bad_seq == 3
    tail, segment = sealed.filter("seq <> 9"), sealed.filter("segment <> 0")
    assert audit.verify_chain(tail, anchored, keys).first().first_bad_seq is None  # no row is left that could show it
    assert [(r.segment, r.n_missing) for r in audit.missing_tails(tail, anchored).collect()] == [(2, 1)]
    assert [r.segment for r in audit.missing_tails(segment, anchored).collect()] == [0]
    assert audit.verify_chain(segment, anchored, keys).first().first_bad_seq == 4
    assert audit.verify_chain(sealed.filter("segment <> 1"), anchored, keys).first().first_bad_seq == 9
    ends = [r.last_seq for r in anchored.collect() if r.segment < 2]
    assert audit.verify_chain(sealed.filter(~F.col("seq").isin(ends)), anchored, keys).first().first_bad_seq == 4


def test_batches_seal_like_one(day, keys, sealed):
    done = None
    for part in ("seq < 3", "seq between 3 and 6", "seq > 6"):
        batch = stage(audit.seal(day[0].filter(part), keys, 4, anchored=audit.heads(done) if done is not None else None))
        done = batch if done is None else done.unionByName(batch)
    assert sorted((r.seq, r.hash) for r in done.collect()) == sorted((r.seq, r.hash) for r in sealed.collect())
    assert audit.verify_chain(done, audit.heads(done), keys).first().first_bad_seq is None


def test_edited_heads_do_not_fit_their_seals(sealed, keys):
    anchored = audit.heads(sealed)
    seals = stage(audit.seal_heads(anchored, keys, 4))
    assert audit.bad_heads(anchored, seals, keys, 4).isEmpty()
    edited = anchored.withColumn("last_hash", F.when(F.col("segment") == 1, F.lit("00")).otherwise(F.col("last_hash")))
    assert {(r.level, r.segment) for r in audit.bad_heads(edited, seals, keys, 4).collect()} == {(1, 0), (2, 0), (3, 0)}


def test_top_hash_covers_all_heads(sealed, keys):
    top = lambda df: audit.seal_heads(audit.heads(df), keys, 4).filter("level = 3").first().hash
    changed = sealed.withColumn("hash", F.when(F.col("seq") == 9, F.lit("00")).otherwise(F.col("hash")))
    assert top(sealed) == top(sealed.filter("true")) != top(changed)


def test_key_rotation_verifies_by_segment(day, keys):
    rotated = day[0].withColumn("kid", F.when(F.col("seq") < 4, "default").otherwise("k2"))
    sealed = stage(audit.seal(rotated, keys, 4))
    spoiled = sealed.withColumn("kid", F.lit("default"))
    per = {r.kid: (r.checked, r.first_bad_seq) for r in audit.verify_chain(sealed, audit.heads(sealed), keys, ["kid"]).collect()}
    assert per == {"default": (3, None), "k2": (5, None)}
    assert audit.verify_chain(spoiled, audit.heads(sealed), keys).first().first_bad_seq == 4


def test_two_sides_see_their_own(spark, day):
    viewers = frame(spark, [("al-ines", "alpina"), ("bo-kira", "borealis"), ("bo-lev", "borealis")], "sub string, viewer_org string")
    provider = {r.seq for r in audit.provider_view(day[0], viewers).collect()}
    consumer = {r.seq for r in audit.consumer_view(day[0], viewers).collect()}
    assert provider == {1, 2, 3, 4, 9} and consumer == {1, 2, 3, 9}
    assert [r.seq for r in audit.latest(audit.consumer_view(day[0], viewers), 2).collect()] == [3, 9]
    assert audit.provider_view(day[0], viewers.limit(0)).count() == 0


def test_reconciliation(day, world):
    events, rows, resolved = day
    args = (rows, world["shipment"], world["data_grant"])
    assert audit.reconcile(events, *args).count() == audit.reconcile(events, *args, resolved).count() == 0
    assert audit.unapproved(events, world["data_grant"]).count() == 0
    # a read of another partner's row, filed under g-trade
    wrong = events.withColumn("grant_id", F.when(F.col("seq") == 4, "g-trade").otherwise(F.col("grant_id")))
    flagged = audit.reconcile(wrong, *args)
    assert [tuple(r) for r in flagged.collect()] == [(4, 1)]
    assert [tuple(r) for r in audit.reconcile_rows(wrong, *args).collect()] == [(4, 2)]
    found = {r.seq: r.incident for r in audit.classify(wrong, flagged).collect()}
    assert found == {1: "as_configured", 2: "as_configured", 3: "as_configured", 4: "enforcement_fault", 5: "attempt", 6: "attempt",
                     7: "attempt", 9: "as_configured"}
    lapsed = events.withColumn("grant_id", F.when(F.col("seq") == 1, "g-asked").otherwise(F.col("grant_id")))
    assert [r.seq for r in audit.unapproved(lapsed, world["data_grant"]).collect()] == [1]


def test_strict_reconciliation_sees_the_region(day, world):
    events, rows, resolved = day
    moved = world["shipment"].withColumn("region", F.when(F.col("shipment_id") == 3, "west").otherwise(F.col("region")))
    assert audit.reconcile(events, rows, moved, world["data_grant"]).count() == 0  # west is inside the grant
    strict = audit.reconcile(events, rows, moved, world["data_grant"], resolved).collect()
    assert sorted(r.seq for r in strict) == [2, 3]  # but not inside the delegations


def test_previous_by_seq_over_gaps(spark):
    seqs = [0, 1, 5, 17, 18, 19, 300, 301, 5000]
    rows = frame(spark, [(s, f"h{s}") for s in seqs], "seq long, hash string")
    got = {r.seq: r.prev_value for r in audit.previous_by_seq(rows, width=4, levels=3).collect()}
    assert got == {s: (f"h{seqs[i - 1]}" if i else None) for i, s in enumerate(seqs)}


def test_reconstruct_reports_direct_and_delegated(day, world):
    got = {r.seq: r for r in audit.reconstruct(day[0], world["data_grant"], world["delegation"]).collect()}
    assert (got[1].approved_by, got[1].delegator) == ("al-ines", None)
    assert (got[3].delegator, got[3].delegatee, got[3].depth, got[3].purpose) == ("bo-plan", "bo-route", 2, "finds routes for the plan")
