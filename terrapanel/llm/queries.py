"""The registered queries: thin digests of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm import (
    compression,
    conversations,
    decontamination,
    fingerprints,
    html,
    near_duplicates,
    periodicity,
    scoring,
    secrets,
    sharding,
    tokenization,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@register
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.stored_and_read(table(spark, sf_dir, "pages")))


@register
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.digest(decontamination.contamination(documents, benchmark))


@register
def op5_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.language_scores(table(spark, sf_dir, "documents"))


@register
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.scores(documents, toxicity.train(documents, table(spark, sf_dir, "labels"))))


@register
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenization.digest(tokenization.round_trip(table(spark, sf_dir, "documents")))


@register
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.digest(html.main_texts(table(spark, sf_dir, "pages")))


@register
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(fingerprints.fingerprint_with_next(table(spark, sf_dir, "documents")))


@register
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.digest(conversations.repaired(damaged))


@register
def op12_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.quality(table(spark, sf_dir, "documents"))


@register
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodicity.digest(periodicity.periodic_runs(periodicity.with_planted_periods(table(spark, sf_dir, "documents"))))
