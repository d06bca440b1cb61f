"""Shared text helpers: the word pattern as Columns, let-bindings for nested array expressions, staged tables."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.plans.placement import stage
from wardline.session import scratch, shared_dir

__all__ = ["BLANKS", "WORD", "body", "let", "read", "scratch", "shared_dir", "stage", "words", "discard", "packed", "parted", "release"]

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def body(column: str | Column = "text") -> Column:
    """The text, an absent one read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of anything but the six ASCII blanks."""
    return F.array_remove(F.split(text, BLANKS), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it as often as wanted, also inside other lambdas."""
    return F.transform(F.array(value), use)[0]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        roots = {f.rpartition("/")[0] for f in df.inputFiles()}
        for root in roots:
            if shared_dir(spark).removeprefix("file://").rstrip("/") in root:
                path = jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(conf).delete(path, True)


def packed(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """`docs` with the columns in `used` and all others put away in one, so that no name of theirs can clash, and the way back."""
    rest = [c for c in docs.columns if c not in used]
    small = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c in used], F.struct(F.lit(0), *[F.col(f"`{c}`") for c in rest]).alias("_rest"))

    def unpacked(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*[F.col("_rest").getField(c).alias(c) if c in rest else F.col(c) for c in docs.columns], *more)

    return small, unpacked


def parted(df: DataFrame, key: str, keys: DataFrame, bits: int = 23) -> tuple[DataFrame, DataFrame]:
    """(rows whose long `key` may be in the one column of `keys`, rows whose key is surely not in it).

    A bitmap of 2^bits places (1 MB by default, so it may be broadcast) tells them apart; only the first part need go through a
    join with `keys`. A null key is surely not in it. The more keys, the larger the first part; what comes out stays right."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    marks = keys.select(place(F.col(f"`{keys.columns[0]}`")).alias("p")).groupBy(F.shiftright("p", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("_bits"))
    looked_up = df.withColumn("_place", F.when(F.col(key).isNotNull(), place(F.col(key)))).join(
        F.broadcast(marks), F.shiftright("_place", 6) == F.col("_word"), "left")
    marked = F.coalesce(F.expr("shiftrightunsigned(_bits, cast(_place & 63 as int)) & 1 = 1"), F.lit(False))
    rid = lambda x: x.drop("_place", "_word", "_bits")
    return rid(looked_up.filter(marked)), rid(looked_up.filter(~marked))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are staged: it does so when its driver collects garbage.

    Python gives up its references, and Spark deletes the files, in the background: hence a second time and the pauses."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
