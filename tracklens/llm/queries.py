"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm import (
    bpe,
    hnsw,
    html_extract,
    license_scan,
    lsh_search,
    merkle,
    mixing,
    resample,
    secret_scan,
    sharding,
    simhash,
    token_counts,
    toxicity,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract_main_text(_read(spark, d, "pages"))


def licenses(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, d, "documents"))


def embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    return hnsw.near_duplicates(_read(spark, d, "embeddings"))


def nearest(spark: SparkSession, d: str) -> DataFrame:
    asks = F.col("vec_id") % lsh_search.QUERY_STEP == 0
    return lsh_search.nearest_vectors(_read(spark, d, "embeddings"), asks)


def source_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_read(spark, d, "documents"))


def bpe_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(_read(spark, d, "documents")).drop("ids")


def toxicity_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, _read(spark, d, "labels")))


def secrets(spark: SparkSession, d: str) -> DataFrame:
    return secret_scan.scan_documents(_read(spark, d, "documents"))


def rendezvous_shards(spark: SparkSession, d: str) -> DataFrame:
    out = sharding.shard_records(_read(spark, d, "documents"))
    return out.withColumn("law", F.lit("key"))


def simhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, d, "documents"))


def target_resampling(spark: SparkSession, d: str) -> DataFrame:
    return resample.resample(_read(spark, d, "documents"), _read(spark, d, "benchmark"))


def token_limits(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.over_limit(_read(spark, d, "documents"))


def merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    return merkle.verified(_read(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": html_extraction,
    "op2_license_scan": licenses,
    "op3_embedding_dedup": embedding_dedup,
    "op4_nearest_vectors": nearest,
    "op5_source_mixing": source_mixing,
    "op6_bpe_round_trip": bpe_round_trip,
    "op7_toxicity": toxicity_scores,
    "op8_secret_scan": secrets,
    "op9_rendezvous_shards": rendezvous_shards,
    "op10_simhash_dedup": simhash_dedup,
    "op11_target_resampling": target_resampling,
    "op12_token_counts": token_limits,
    "op13_merkle_manifest": merkle_manifest,
}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan.oracle(), "op13_merkle_manifest": merkle.oracle()}
