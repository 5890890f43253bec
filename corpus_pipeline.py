"""Corpus pipeline over ``documents``: each stage's rows are written as Parquet
and reread as the next stage's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tickvault.llm import jaccard_join, packing, quality, secrets, toxicity
from tickvault.llm.common import importable
from tickvault.session import shared_dir

STAGES = [
    ("toxicity", toxicity.stage),
    ("quality rules", quality.stage),
    ("n-gram Jaccard join", jaccard_join.stage),
    ("secret scans", secrets.stage),
    ("packing", packing.stage),
]

#: Trained models, components and tokenizer ids are beyond SQL; tests/llm holds
#: the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = shared_dir(spark, f"pipeline/{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/stage{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
