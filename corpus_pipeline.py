"""A corpus pipeline: toxic documents go, then exact and near copies; sources are mixed and texts encoded."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from kindred.cluster import shared_folder
from kindred.llm.byte_bpe import encode_documents
from kindred.llm.exact_dedup import drop_exact_copies
from kindred.llm.mixing import mixed_documents
from kindred.llm.simhash import drop_near_copies
from kindred.llm.toxicity import drop_toxic


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("exact dedup", _exact),
    ("simhash near-dedup", _near),
    ("mixing", _mix),
    ("byte-level bpe", _encode),
]

#: SQL has no expression for the learned scores, the similarity of near copies, the rounding and the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over documents; each stage's rows are written as Parquet in the shared folder and read again."""
    top = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
