"""The corpus pipeline: each stage's output is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamgrid.llm import stages
from loamgrid.runtime import scratch

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("language_id", stages.language),
    ("toxicity", stages.toxic),
    ("exact_dedup", stages.exact),
    ("simhash_near_dedup", stages.near),
    ("packing", stages.pack),
]

#: Learned models, fingerprint components and token ids are beyond SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage gives is written to the cluster's shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
