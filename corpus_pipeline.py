"""The corpus pipeline: rules, near-duplicates, decontamination, secrets, mixing. Each stage works on what the one before
kept; the driver of a job writes each stage's result as Parquet and hands the reread table to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import decontam, jaccard_join, mixing, quality_rules, secrets
from wardline.llm.text import read, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents of a host share are cut; rejected documents go."""
    return quality_rules.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies stays."""
    return jaccard_join.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, each once, with size, source_size, target, copies and taken (words, repeats counted)."""
    return mixing.mixed(docs)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secret_scan),
    ("mixing", mix),
]

# The draw of the last stage is pseudo-random, which SQL cannot follow; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for at, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        docs = stage(docs) if at < len(STAGES) - 1 else docs
    return docs
