"""Writers for the audit trail, reports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def append_audit(events: DataFrame, path: str) -> None:
    """Append events, laid out by day. Never overwrites."""
    dated = events.withColumn("event_date", F.to_date("event_ts"))
    dated.write.mode("append").partitionBy("event_date").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("errorifexists").json(path)


def export_trail(audit: DataFrame, path: str) -> None:
    """The whole trail as CSV with a header, arrays as JSON text, for archiving before a key rotation."""
    flat = audit.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name) for f in audit.schema.fields]
    )
    flat.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
