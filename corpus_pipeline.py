"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing, each over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import mixing, near_dup, packing, quality, suffix_dedup
from paperloom.session import materialize, release

STAGES = [
    ("quality_rules", quality.stage),
    ("near_duplicates", near_dup.stage),
    ("repeated_passages", suffix_dedup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: SQL can't express MinHash groups, byte-wise cuts and a tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that the stages keep; every stage's rows are written before the next begins, and
    what a stage wrote on its way is removed then. An empty table of documents gives no pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, keep=docs.inputFiles())
    return docs
