"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bayes_quality, centroids, decontam, filter_audit, html_main, jaccard_join, langid, licenses, mixing, oracles, pitman_yor, quality_rules, secrets, sharding
from wardline.llm.text import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query(oracles.SECRETS)
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ("assign", "access", "hex")
    return found.select(
        "doc_id",
        *[F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in base],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(secrets.KINDS).alias("spans"),
    )


@query(oracles.QUALITY)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


@query(oracles.LEAKS)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query()
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query()
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"))


@query()
def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(read(spark, sf_dir, "documents"))


@query()
def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read(spark, sf_dir, "documents"))


@query()
def op5_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_main.extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "path")


@query()
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source / thousands / hundreds / doc_id."""
    docs = read(spark, sf_dir, "documents")
    bin_of = lambda size: F.floor(F.col("doc_id") / size).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), bin_of(1000), bin_of(100), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    found = licenses.scan(docs.select(F.col("doc_id").alias("key"), path.alias("path"), "text"))
    return found.withColumnRenamed("key", "doc_id")


@query()
def op9_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes_quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query(oracles.FILTERS)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(read(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(oracles.CENTROIDS)
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(read(spark, sf_dir, "embeddings"))
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))
