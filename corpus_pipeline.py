"""A training corpus from raw documents, stage by stage.

toxicity: documents scored as toxic go; simhash: one document of each
near-duplicate group stays; secrets: found secrets are masked in the text;
mix: rows are repeated or left out so that sources meet their target
weights; bpe: texts become token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklens.llm import bpe, mixing, secret_scan, simhash, toxicity
from tracklens.llm.common import stage


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_per_group(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask_secrets(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(docs, ["doc_id", "source"])


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_dedup", simhash_stage),
    ("secret_scan", secrets_stage),
    ("source_mixing", mix_stage),
    ("bpe", bpe_stage),
]

#: the stages are not expressible in SQL; tests compare them with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage_of in STAGES:
        docs = stage(stage_of(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
