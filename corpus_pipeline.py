"""The corpus pipeline over ``documents``.

Quality rules, near duplicates, decontamination and secret redaction keep the columns of
``documents``; the last stage returns the packed pieces. Each stage reads what its predecessor
wrote.

Defined results: null and empty texts fail the quality rules and go; rows with a null lang or source
have fences of their own; of near duplicates, the row with the least doc_id stays; documents
that hold a benchmark item go, whatever else they hold; redaction changes texts and n_chars only; an
empty table gives no pieces; further columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geopulse.llm import decontamination, jaccard_join, packing, quality, secret_scan
from geopulse.llm.text import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join stays: five words, similarity 0.8."""
    return jaccard_join.drop_near_duplicates(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays."""
    return secret_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, a row for each piece."""
    return packing.op1_packing(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]

#: Decontamination, secret scans and packing can't be expressed in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written as Parquet in the shared folder and read again."""
    run_id = spark.sql("select uuid()").head()[0]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/corpus_pipeline/{run_id}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
