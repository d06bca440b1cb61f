from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wardline.operators import auth, guard

CRED = "subject string, grant_id string, delegation_id string"


def frame(spark, rows, ddl):
    """A small frame as a local relation."""
    schema = StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl
    names = schema.fieldNames()
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], to_arrow_schema(schema)))


def creds(spark, *rows):
    return frame(spark, rows, CRED)


def auths(world, credentials: DataFrame, at, **rules) -> DataFrame:
    return guard.with_auth_id(
        auth.current_auth(credentials, world["data_grant"], world["delegation"], world["principal"], at, **rules)
    )


def rows_by_auth(df: DataFrame) -> dict[str, list[int]]:
    return {r["auth_id"]: r["ids"] for r in df.groupBy("auth_id").agg(F.sort_array(F.collect_list("shipment_id")).alias("ids")).collect()}


def edit(world, table, key, value, **changes):
    """A copy of the scenario with some columns of one row replaced."""
    df = world[table]
    out = df.select(*[
        F.when(F.col(key) == value, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns
    ])
    return {**world, table: out}
