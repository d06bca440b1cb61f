"""Readers under fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.schemas import BASE, GOVERNANCE


def base_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The supplied tables this package uses, each scanned only for the columns a plan asks for."""
    return {name: spark.read.schema(st).parquet(f"{directory}/{name}.parquet") for name, st in BASE.items()}


def load(spark: SparkSession, directory: str, names: tuple[str, ...] = tuple(GOVERNANCE)) -> dict[str, DataFrame]:
    """Stored governance tables. Shipments are laid out by (owner_org, region), audit events by event_date."""
    return {name: spark.read.schema(GOVERNANCE[name]).parquet(f"{directory}/{name}") for name in names}


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, one branch per table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def request_fields(audit: DataFrame, fields: dict[str, str], column: str = "request") -> DataFrame:
    """Read fields back out of the stored request JSON: `{output column: field}`."""
    parsed = audit
    for out, field in fields.items():
        parsed = parsed.withColumn(out, F.get_json_object(F.col(column), f"$.{field}"))
    return parsed
