"""A training corpus from raw documents: keep known languages, drop exact and near copies, mix the sources, pack sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm.exact_dedup import drop_copies
from sluice.llm.language_id import accepted_documents
from sluice.llm.mixing import repeat_to_targets
from sluice.llm.near_dedup import STAGE, drop_near_copies
from sluice.llm.packing import packed
from sluice.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the table's labels name."""
    return accepted_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 80 % similarity the document with the smallest doc_id."""
    return drop_near_copies(docs, STAGE)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times."""
    return repeat_to_targets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in packed sequences."""
    return packed(docs)


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("MinHash near-dedup", near_dedup),
          ("mixing sources", mixing), ("best-fit packing", packing)]

# Tokens and hashing rule SQL out; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
