"""The training-data pipeline: each stage works on all that its predecessor kept, written and read between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact, ngram_join, packing, quality, substring
from tessera.llm.common import discard, durable

STAGES = [
    ("quality rules", quality.stage),
    ("exact dedup", exact.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("substring dedup", substring.stage),
    ("packing", packing.stage),
]

#: The tokenizer's merges can't be said in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
