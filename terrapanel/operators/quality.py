"""Data-quality reports: one row per rule with the number of failing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT = ["rule", "table_name", "subject", "failing_rows"]


def _report(counts: DataFrame, rule: str, table: str) -> DataFrame:
    """One-row frame of counts to one report row per column."""
    long = counts.unpivot([], counts.columns, "subject", "failing_rows")
    return long.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), "subject", "failing_rows")


def not_null(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """All columns in one pass."""
    return _report(df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]), "not_null", table)


def domain_check(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """Rows for which a rule does not hold; an unknown outcome counts as failing."""
    failing = [F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    return _report(df.agg(*failing), "domain", table)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def unique_key(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Number of keys held by more than one row."""
    counts = duplicate_keys(df, keys).agg(F.count("*").alias("+".join(keys)))
    return _report(counts, "unique_key", table)


def key_counts(df: DataFrame, keys: list[str], partition: str) -> DataFrame:
    """Per value of the partition column, which is one of the keys: rows, keys, and keys held by more than one row. Equal keys
    lie in one partition, so the counts of a table are those of its partitions added up."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("copies"))
    return per_key.groupBy(partition).agg(
        F.sum("copies").alias("row_count"), F.count("*").alias("key_count"), F.count_if(F.col("copies") > 1).alias("repeated")
    )


def unique_key_from_counts(counts: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """The report of `unique_key`, from kept counts."""
    total = counts.agg(F.coalesce(F.sum("repeated"), F.lit(0)).cast("long").alias("+".join(keys)))
    return _report(total, "unique_key", table)


def panel_stats(df: DataFrame, region: str, year: str = "period_year") -> DataFrame:
    """Rows, distinct regions, first and last year. Regions are grouped first, so no
    task meets more than one row per region and map task."""
    per_region = df.groupBy(region).agg(
        F.count("*").alias("n"), F.min(year).alias("first"), F.max(year).alias("last")
    )
    return per_region.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(region).alias("regions"),
        F.min("first").alias("min_year"),
        F.max("last").alias("max_year"),
    )


def completeness(df: DataFrame, regions: int, first_year: int, region: str) -> DataFrame:
    """Rows found against regions x years since first_year."""
    expected = regions * (F.col("max_year") - first_year + 1)
    return panel_stats(df, region).select(
        "row_count",
        expected.cast("long").alias("expected_rows"),
        (F.col("row_count") == expected).alias("is_complete"),
    )


def missing_cells(df: DataFrame, regions: DataFrame, first_year: int, region: str) -> DataFrame:
    """(region, year) pairs without a row, up to the newest year of the panel."""
    newest = df.agg(F.max("period_year")).scalar()
    spine = regions.select(
        region, F.explode(F.sequence(F.lit(first_year), newest)).alias("period_year")
    )
    return spine.join(df, [region, "period_year"], "left_anti")


def unmapped_report(unmatched: DataFrame, code: str = "region_code") -> DataFrame:
    """Dropped rows per unknown code."""
    return unmatched.groupBy(code).agg(F.count("*").alias("dropped_rows"))
