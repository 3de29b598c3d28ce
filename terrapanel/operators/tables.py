"""Catalog tables by year whose partitions are switched, not overwritten.

A write goes to a folder of its own. Only when it is complete, the catalog's partitions are pointed at it; so a failed write
leaves the table as it was, readers never meet half a partition, and data is written once. Each partition is switched by
one catalog entry; a switch of several years is not one step. Folders that no partition points at any more stay until `retire`.

With buckets, rows of a year are divided by the hash of region and period and sorted by them, so that a merge joins bucket with
bucket and only the batch is moved.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.operators.upsert import (
    DifferentColumns,
    laid_out,
    replace_rows_by_join,
    replace_unless_better,
    require_unique,
)
from terrapanel.session import discard, folders, staged, version_name

PARTITION = "period_year"
PERIOD = "period"  # yyyymm: with the region a whole key, which the partition column may not be part of


def with_period(df: DataFrame) -> DataFrame:
    return df.withColumn(PERIOD, F.col("period_year") * 100 + F.col("period_month"))


@dataclass(frozen=True)
class YearTable:
    """A catalog table partitioned by year. `sort` orders rows in files; with buckets it also names the bucket columns."""

    spark: SparkSession
    name: str
    root: str
    sort: tuple[str, ...]
    buckets: int = 0

    def create(self, schema: T.StructType) -> YearTable:
        """Enter it in the catalog if it isn't there."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = ", ".join(self.sort)
        clause = f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS" if self.buckets else ""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet PARTITIONED BY ({PARTITION}) {clause} "
            f"LOCATION '{self.root}'"
        )
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def years(self) -> list[int]:
        """From the catalog; at most one for each calendar year."""
        return sorted(int(r[0].partition("=")[2]) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())

    def location(self, year: int) -> str:
        rows = self.spark.sql(f"DESCRIBE EXTENDED {self.name} PARTITION ({PARTITION}={year})").collect()
        return next(r.data_type for r in rows if r.col_name == "Location")

    def _write_version(self, df: DataFrame) -> dict[int, str]:
        """Write to a new folder; location of each year written. Runs a job."""
        written = YearTable(self.spark, f"version_{uuid.uuid4().hex}", f"{self.root}/{version_name()}", self.sort, self.buckets)
        columns = [f.name for f in self.read().schema]
        if self.buckets:
            writer = df.select(*columns).write.bucketBy(self.buckets, *self.sort).sortBy(*self.sort)
        else:
            writer = laid_out(df.select(*columns), PARTITION, list(self.sort)).write
        writer.format("parquet").partitionBy(PARTITION).option("path", written.root).saveAsTable(written.name)
        try:
            return {year: written.location(year) for year in written.years()}
        finally:
            self.spark.sql(f"DROP TABLE {written.name}")  # the folder stays, as it was given by path

    def _switch(self, places: dict[int, str]) -> None:
        for year, place in places.items():
            spec = f"PARTITION ({PARTITION}={year})"
            self.spark.sql(f"ALTER TABLE {self.name} ADD IF NOT EXISTS {spec} LOCATION '{place}'")
            self.spark.sql(f"ALTER TABLE {self.name} {spec} SET LOCATION '{place}'")
        self.spark.sql(f"REFRESH TABLE {self.name}")

    def replace_years(self, df: DataFrame) -> list[int]:
        """The years in df take the place of what the table has of them; the others stay. Runs a job."""
        places = self._write_version(df)
        self._switch(places)
        return sorted(places)

    def replace_all(self, df: DataFrame) -> list[int]:
        """As replace_years, and years df doesn't have leave the table."""
        kept = self.replace_years(df)
        for year in set(self.years()) - set(kept):
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({PARTITION}={year})")
        return kept

    def merge(self, batch: DataFrame, rank: str | None = None) -> list[int]:
        """Insert, or replace rows of the keys in `sort`; with rank, a row never gives way to one of a larger rank. Returns
        the years touched. Runs jobs: the batch is staged, the merged years are written once and switched."""
        if set(batch.columns) != set(self.read().columns):
            raise DifferentColumns(f"table has {sorted(self.read().columns)}, batch has {sorted(batch.columns)}")
        batch = require_unique(staged(batch, "batch"), list(self.sort))
        touched = [row[0] for row in batch.select(PARTITION).distinct().collect()]
        if not touched:
            return []
        return self.replace_years(self.merged(batch, touched, rank))

    def merged(self, batch: DataFrame, touched: list[int], rank: str | None = None) -> DataFrame:
        """The touched years with the batch merged in, as merge writes them."""
        existing = self.read().where(F.col(PARTITION).isin(touched))
        if rank is not None:
            return replace_unless_better(existing, batch, list(self.sort), rank)
        return replace_rows_by_join(existing, batch, list(self.sort))

    def retire(self) -> list[str]:
        """Remove folders of versions that no partition points at. To be called when no reader is left that began before the
        last switch. Returns what was removed."""
        used = {self.location(year).rstrip("/") for year in self.years()}
        gone = []
        for version in folders(self.spark, self.root):
            whole = f"{self.root}/{version}"
            years = [f for f in folders(self.spark, whole) if f.startswith(f"{PARTITION}=")]
            stale = [y for y in years if not any(u.endswith(f"/{version}/{y}") for u in used)]
            if len(stale) == len(years):
                gone.append(whole)
            else:
                gone += [f"{whole}/{y}" for y in stale]
        discard(self.spark, *gone)
        return gone


def bucketed_copy(df: DataFrame, keys: list[str], buckets: int, root: str) -> DataFrame:
    """df at rest in buckets of keys, read back: joins and aggregates on these keys need no exchange. Runs a job with one shuffle."""
    name = f"bucketed_{uuid.uuid4().hex}"
    placed = df.repartition(buckets, *keys)
    placed.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", root).saveAsTable(name)
    return df.sparkSession.table(name)
