"""Key-based merge of a batch into a table, and its storage form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.operators.quality import duplicate_keys, key_counts
from terrapanel.session import read_if_exists, staged


class DuplicateKeys(ValueError):
    """A batch names one key twice."""


class DifferentColumns(ValueError):
    """A batch lacks a column of the table, or has one more."""


def replace_rows(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Insert, or replace the whole row of an existing key; a null in the batch replaces too.

    The table is only anti-joined against the batch, so a batch small enough for
    Spark to broadcast leaves the table unshuffled.
    """
    return existing.join(batch.select(*keys), keys, "left_anti").unionByName(batch)


def _merge(existing: DataFrame, batch: DataFrame, keys: list[str], from_batch) -> DataFrame:
    """Full outer join on the keys; from_batch says per column when the batch's value is taken."""
    old = existing.withColumn("_present", F.lit(True)).alias("old")
    new = batch.withColumn("_present", F.lit(True)).alias("new")
    joined = old.join(new, keys, "full_outer")

    def column(name: str) -> Column:
        if name in keys:
            return F.col(name)
        return F.when(from_batch(name), F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    return joined.select(*[column(name) for name in existing.columns])


def patch_rows(existing: DataFrame, batch: DataFrame, keys: list[str], updates: list[str]) -> DataFrame:
    """Insert, or overwrite only the given columns of an existing key."""
    known, offered = F.col("old._present").isNotNull(), F.col("new._present").isNotNull()
    return _merge(existing, batch, keys, lambda name: offered if name in updates else ~known)


def replace_unless_better(
    existing: DataFrame, batch: DataFrame, keys: list[str], rank: str = "status_rank"
) -> DataFrame:
    """As replace_rows, but a row never gives way to one of a larger rank."""
    new_key = F.col("old._present").isNull()
    as_good = F.col(f"new.{rank}") <= F.col(f"old.{rank}")
    return _merge(existing, batch, keys, lambda _: new_key | F.coalesce(as_good, F.lit(False)))


def replace_rows_by_join(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows as replace_rows, by a full outer join: for a table that already lies by its keys."""
    return _merge(existing, batch, keys, lambda _: F.col("new._present").isNotNull())


def require_unique(batch: DataFrame, keys: list[str]) -> DataFrame:
    """Raise if a key occurs twice. Runs a job."""
    clash = duplicate_keys(batch, keys).limit(1).collect()
    if clash:
        raise DuplicateKeys(f"batch holds a key more than once: {clash[0].asDict()}")
    return batch


def upsert_table(
    path: str,
    batch: DataFrame,
    keys: list[str],
    partition: str = "period_year",
    updates: list[str] | None = None,
    rank: str | None = None,
    counts: str | None = None,
) -> int:
    """Merge a batch into the Parquet table at path, rewriting only the touched partitions. Runs jobs.

    With updates only these columns of a known key change; with rank, a column of both, a row never gives way to one
    of a larger rank. With counts, a path, the key counts kept there are brought up to date: only the touched partitions are
    counted, see keep_key_counts. Returns the number of rows in the batch.

    The batch and the merged partitions are first written to the shared folder, so the
    swap reads nothing it replaces. Until the swap a failed run leaves the table as it
    was. Should the driver end within the swap, the logged merged folder is complete:
    pass what it holds to write_partitioned again.
    """
    spark = batch.sparkSession
    table = read_if_exists(spark, path)
    if table is not None and set(table.columns) != set(batch.columns):
        raise DifferentColumns(f"table has {sorted(table.columns)}, batch has {sorted(batch.columns)}")
    batch = require_unique(staged(batch, "batch"), keys)
    # At most one value per calendar year.
    touched = [row[0] for row in batch.select(partition).distinct().collect()]
    if not touched:
        return 0
    merged = batch
    if table is not None:
        existing = table.where(F.col(partition).isin(touched)).select(*batch.columns)
        if rank is not None:
            merged = replace_unless_better(existing, batch, keys, rank)
        elif updates is None:
            merged = replace_rows(existing, batch, keys)
        else:
            merged = patch_rows(existing, batch, keys, updates)
        merged = staged(merged, "merged")
    write_partitioned(merged, path, partition, keys)
    if counts is not None:
        keep_key_counts(spark.read.parquet(path), counts, keys, partition, touched)
    return batch.count()


def keep_key_counts(table: DataFrame, path: str, keys: list[str], partition: str, touched: list) -> None:
    """Count keys in some partitions of a table and keep the counts beside those of the others. Runs a job that reads these
    partitions only."""
    write_partitioned(key_counts(table.where(F.col(partition).isin(touched)), keys, partition), path, partition, [partition])


def laid_out(df: DataFrame, partition: str, sort: list[str]) -> DataFrame:
    """Even files per partition, also for a hot one, sorted so that row groups can be skipped by key."""
    order = [partition, *[name for name in sort if name != partition]]
    return df.hint("rebalance", partition).sortWithinPartitions(*order)


def write_partitioned(df: DataFrame, path: str, partition: str, sort: list[str]) -> None:
    """Overwrite the partitions present in df and leave the others. Runs a job."""
    (
        laid_out(df, partition, sort)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def write_whole(df: DataFrame, path: str, partition: str, sort: list[str]) -> None:
    """Replace the table at path, partitions df does not have included. Runs a job."""
    laid_out(df, partition, sort).write.mode("overwrite").partitionBy(partition).parquet(path)


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """Staging and intermediate layers: a view, composed lazily."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def publish_table(df: DataFrame, name: str, path: str, partition: str, sort: list[str]) -> DataFrame:
    """Marts: a Parquet table below path, by year. The new version is written to a folder of its own, then the catalog's partitions are
    pointed at it; if the write fails, the old version stays. Runs a job."""
    from terrapanel.operators.tables import PARTITION, YearTable

    if partition != PARTITION:
        raise ValueError(f"published tables are by {PARTITION}, not by {partition}")
    table = YearTable(df.sparkSession, name, path, tuple(sort)).create(df.schema)
    table.replace_all(df)
    return table.read()
