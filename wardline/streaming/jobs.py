"""Streaming jobs: guarded reads, sealing, and counting refusals.

Sinks are written per micro-batch under `batch=<id>` in overwrite mode, so a batch that is run again after a lost
executor or a restart replaces its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.functions.crypto import key_pads
from wardline.operators import audit, auth, credentials
from wardline.plans.placement import lookup_join, stage

Governance = Callable[[], dict[str, DataFrame]]
AVAILABLE = {"availableNow": True}


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def stream_guarded(
    tokens: DataFrame, governance: Governance, path: str, checkpoint: str, at: str = "event_ts", trigger: dict | None = None
) -> StreamingQuery:
    """Presented tokens → verified → resolved → served rows and audit events.

    `tokens` has request_id, event_ts, token, columns and request (JSON with the bound `k`). `governance` is called
    for every micro-batch and must read the tables anew: a frame planned once would never see a revocation. The
    revocation bound is therefore one micro-batch. A token that does not verify gives a refused event, which keeps whom the
    token claimed to speak for. `trigger` holds `DataStreamWriter.trigger` arguments; by default what is there is read.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        state = governance()
        said = credentials.claimed(batch, ("sub",))
        seen = credentials.verify_tokens(said, state["keys"], F.col(at)).withColumnRenamed("sub", "subject")
        asked = stage(seen.drop("token", "verified").withColumn("action", F.lit("read")))
        resolved = stage(
            auth.resolve(
                auth.credentials_of(asked.filter(F.col("subject").isNotNull())), state["data_grant"], state["delegation"],
                state["principal"],
            )
        )
        events, rows = audit.audit_reads(asked, resolved, state["shipment"])
        _put(events, f"{path}/events", batch_id)
        _put(audit.chunked(rows, ["set_id"]), f"{path}/rows", batch_id)

    return (
        tokens.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or AVAILABLE)).start()
    )


SEAL_SCHEMA = "segment long, pos long, seq long, kid string, body string, prev_hash string, hash string"


def seal_stream(outcomes: DataFrame, keys: DataFrame, body: Column, segment: int = audit.SEGMENT) -> DataFrame:
    """Link a stream of outcomes (seq, kid, …) in arrival order inside each segment.

    The state of a segment is its last hash and length, kept in the checkpoint; it is dropped once the segment is
    full, so state does not grow with the trail.
    """
    prepared = lookup_join(
        outcomes.withColumn("segment", F.floor(F.col("seq") / segment)).withColumn("body", body),
        key_pads(keys), ["kid"], "left",
    ).select("segment", "seq", "kid", "body", "ipad", "opad")

    def link(key, frames, state) -> Iterator:
        import hashlib

        import pandas as pd

        rows = pd.concat(list(frames)).sort_values("seq")  # at most one segment
        prev, pos = state.get if state.exists else ("", 0)
        out = []
        for r in rows.itertuples(index=False):
            inner = hashlib.sha256(r.ipad + f"{len(prev)}:{prev}{r.body}".encode()).digest()
            now = hashlib.sha256(r.opad + inner).hexdigest()
            pos += 1
            out.append((key[0], pos, r.seq, r.kid, r.body, prev or None, now))
            prev = now
        if pos >= segment:
            state.remove()
        else:
            state.update((prev, pos))
        yield pd.DataFrame(out, columns=["segment", "pos", "seq", "kid", "body", "prev_hash", "hash"])

    return prepared.groupBy("segment").applyInPandasWithState(
        link, SEAL_SCHEMA, "prev string, pos long", "append", "NoTimeout"
    )


def stream_audit(outcomes: DataFrame, keys: DataFrame, body: Column, path: str, checkpoint: str,
                 segment: int = audit.SEGMENT, trigger: dict | None = None) -> StreamingQuery:
    """Sealed outcomes appended to a Parquet folder, exactly once by the file sink's own log."""
    sealed = seal_stream(outcomes, keys, body, segment)
    return (
        sealed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or AVAILABLE)).start()
    )


def denial_counts(events: DataFrame, window: str = "1 day") -> DataFrame:
    """Unattributed refusals per claimed subject and time window; the same expression for batch and stream."""
    refused = events.filter((F.col("decision") == "deny") & F.col("subject").isNull())
    claimed = refused.withColumn("claimed_sub", F.get_json_object("request", "$.claimed_sub"))
    counts = claimed.groupBy(F.window("event_ts", window).alias("w"), "claimed_sub").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "claimed_sub", "n")


def stream_denials(events: DataFrame, path: str, checkpoint: str, window: str = "1 day", late: str = "1 hour",
                   trigger: dict | None = None) -> StreamingQuery:
    """Running counts, one file set per micro-batch; events later than the watermark are dropped.

    Read back with `latest_counts`.
    """
    counts = denial_counts(events.withWatermark("event_ts", late), window)

    def run(batch: DataFrame, batch_id: int) -> None:
        _put(batch, path, batch_id)

    return (
        counts.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE)).start()
    )


def latest_counts(updates: DataFrame) -> DataFrame:
    """Last count written for each window and subject (`updates` carries the `batch` partition column)."""
    return updates.groupBy("window_start", "claimed_sub").agg(F.max_by("n", "batch").alias("n"))
