"""From raw documents to token ids: reject toxic texts, drop near-duplicates and benchmark texts, hide secrets, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared folder and read
again as the next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrapanel.llm import decontamination, near_duplicates, secrets, tokenization, toxicity
from terrapanel.session import staged

SHINGLE = 5  # words; the two of op6_minhash_near_dedup are that query's contract, and link far more


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's threshold. The classifier learns from the labels of this stage's documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by sets of five words at a similarity of 0.8."""
    return near_duplicates.deduplicated(docs, size=SHINGLE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text."""
    return secrets.cleaned(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the token ids of their text."""
    return tokenization.encode(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", hide_secrets),
    ("encoding", encode),
]

# The classifier, the signatures and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
