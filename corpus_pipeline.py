"""From raw documents to training tokens: quality, near-dedup, secrets, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import stages
from siltstone.llm.shared import dropped, stored

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("near_dedup", stages.near_dedup),
    ("secret_scan", stages.secret_scan),
    ("source_mixing", stages.source_mixing),
    ("bpe_encoding", stages.bpe_encoding),
]

#: Mixing orders rows by Spark's own 64-bit hash and encoding needs the vocabulary's merges: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what its predecessor kept, by way of Parquet in the shared folder."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir))
        if last:
            dropped(spark, last)
        last = path
    return docs
