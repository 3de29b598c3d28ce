"""A stored list of the grid files that have arrived, extended by each batch of a stream.

One row per file, by year and batch. A batch writes its own folders, so one that is repeated after a failure writes the same rows
again, and a reader of some years opens only these. What is known of a month is asked of this list, not of the landing folder.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.operators.upsert import laid_out
from terrapanel.sources.daily_grid import FILE_TAGS

COLUMNS = [*[c for c in FILE_TAGS if c != "period_year"], "path"]
LAYOUT = T.StructType(
    [
        T.StructField(c, T.IntegerType() if c in ("period_month", "status_rank") else T.StringType())
        for c in COLUMNS
    ]
    + [T.StructField("period_year", T.IntegerType()), T.StructField("batch", T.StringType())]
)


def batch_name(stream: str, number: int) -> str:
    """Names a batch of a stream, the same again when the batch is repeated."""
    return f"{hashlib.sha1(stream.encode()).hexdigest()[:12]}-{number:08d}"


def remember(files: DataFrame, memory: str, batch: str) -> None:
    """Add files (with their tags) to the list. Runs a job."""
    rows = files.select(*COLUMNS, "period_year", F.lit(batch).alias("batch"))
    (
        laid_out(rows, "period_year", ["period_month"])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("period_year", "batch")
        .parquet(memory)
    )


def remembered(spark: SparkSession, memory: str) -> DataFrame:
    """All files known, each once. Filters on the year prune what is read."""
    return spark.read.schema(LAYOUT).parquet(memory).drop("batch").distinct()


def months_of(spark: SparkSession, memory: str, batch: str) -> list[int]:
    """The months (yyyymm) a batch brought files for; at most one for each calendar month."""
    rows = spark.read.schema(LAYOUT).parquet(memory).where(F.col("batch") == batch)
    return sorted(r[0] for r in rows.select(period()).distinct().collect())


def period() -> Column:
    return (F.col("period_year") * 100 + F.col("period_month")).alias("period")


def in_months(months: list[int]) -> Column:
    """A predicate that also names the years, so that partitions are pruned."""
    years = sorted({m // 100 for m in months})
    return F.col("period_year").isin(years) & (F.col("period_year") * 100 + F.col("period_month")).isin(months)


def compact(spark: SparkSession, memory: str, before: int) -> None:
    """Put the batches of the years before one together, in one folder each. Runs a job; no stream may run meanwhile."""
    old = remembered(spark, memory).where(F.col("period_year") < before)
    years = [r[0] for r in old.select("period_year").distinct().collect()]
    if not years:
        return
    from terrapanel.session import discard, folders, staged

    whole = staged(old, "file_list")
    parts = {y: [f"{memory}/period_year={y}/{b}" for b in folders(spark, f"{memory}/period_year={y}")] for y in years}
    remember(whole, memory, "compacted")
    for y in years:
        discard(spark, *[p for p in parts[y] if not p.endswith("batch=compacted")])
